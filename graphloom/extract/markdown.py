"""Markdown: a document and a section per heading."""

from __future__ import annotations

import re

from .base import Collector, stem

_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_FENCE = re.compile(r"```.*?```", re.S)


def slug(title: str) -> str:
    low = re.sub(r"[^\w\s-]", "", title.lower())
    return re.sub(r"-+", "-", re.sub(r"[\s_]+", "-", low)).strip("-")


def extract(path: str, text: str) -> Collector:
    """Lines in code fences count as headings too; a section ends before the next one of its level or above."""
    out, lines = Collector(path), text.splitlines()
    plain = (p.strip() for p in re.split(r"\n\n+", _FENCE.sub("", text)))
    about = next((p[:500] for p in plain if p and not p.startswith("#")), None)
    document = out.entity("document", stem(path), stem(path), 1, len(lines), docstring=about)
    found = [(len(m[1]), m[2].strip(), n) for n, line in enumerate(lines, 1) if (m := _HEADING.match(line))]
    above: list[tuple[int, str]] = [(0, document)]
    for k, (level, title, line) in enumerate(found):
        end = next((n - 1 for other, _, n in found[k + 1 :] if other <= level), len(lines))
        section = out.entity("section", title, title, line, end, suffix=slug(title), metadata={"level": str(level)})
        while above[-1][0] >= level:
            above.pop()
        out.edge("contains", above[-1][1], section)
        above.append((level, section))
    return out
