"""YAML: a document and a key per mapping entry, through nested mappings but not through lists."""

from __future__ import annotations

from .base import Collector, stem

PREVIEW = 100


def _line_of(key: str, depth: int, lines: list[str]) -> int:
    """The first line that begins with the key, indented about two columns per level; 1 if there is none."""
    for n, line in enumerate(lines, 1):
        bare = line.lstrip()
        if bare.startswith(f"{key}:") and abs(len(line) - len(bare) - 2 * depth) <= 2:
            return n
    return 1


def extract(path: str, text: str) -> Collector:
    import yaml

    out, lines = Collector(path), text.splitlines()
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        out.error(f"YAML error: {e}")
        return out
    document = out.entity("document", stem(path), stem(path), 1, len(lines))
    todo = [(document, "", 0, data)] if isinstance(data, dict) else []

    def walk(parent: str, prefix: str, depth: int, mapping: dict) -> None:
        for raw, value in mapping.items():
            key = str(raw)
            if isinstance(value, dict):
                shown = "{...}"
            elif isinstance(value, list):
                shown = f"[{len(value)} items]"
            else:
                shown = str(value)[:PREVIEW]
            at = _line_of(key, depth, lines)
            found = out.entity("config_key", key, prefix + key, at, at, metadata={"value_type": type(value).__name__, "value_preview": shown})
            out.edge("contains", parent, found)
            if isinstance(value, dict):
                walk(found, f"{prefix}{key}.", depth + 1, value)

    for item in todo:
        walk(*item)
    return out
