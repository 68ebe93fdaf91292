"""JavaScript, TypeScript and Java by a light scanner of braces.

Comments, strings, templates and regular expressions are blanked first (line numbers
stay), then declarations are found by pattern and their bodies by matching braces. Each
call is one edge.
"""

from __future__ import annotations

import re

from .base import Collector, lines_between, stem

#: Words before a parenthesis that are no calls.
NO_CALL = frozenset("if for while switch catch return function typeof super constructor synchronized try do else new throw instanceof assert import await yield void delete in of case".split())

_BLANK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_JS_BLANK = re.compile(r"(?<=[=(,:;!&|?{\[])\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/|" + _BLANK.pattern, re.S)
_CALL = re.compile(r"(?:(?<![\w$.])|(?<=[)\]]\.))((?:new\s+)?)([A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*)\s*(?:<[\w\s,.<>?]*>)?\s*\(")
_JS_IMPORT = re.compile(r"^[ \t]*import\s+(?:[\w*{}\s,$]+\s+from\s+)?([\"'])([^\"'\n]+)\1", re.M)
_JS_CLASS = re.compile(r"\bclass\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([A-Za-z_$][\w$.]*))?[^{;]*\{")
_JS_FUNCTION = re.compile(r"(?<![\w$.])(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\([^)]*\)[^{;]*\{")
_JS_ARROW = re.compile(r"(?<![\w$.])(?:var|let|const)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>\s*(\{)?")
_JS_METHOD = re.compile(r"(?:^|(?<=[;{}\n]))\s*(?:(?:static|async|get|set|public|private|protected)\s+)*\*?(#?[A-Za-z_$][\w$]*)\s*\([^)]*\)\s*(?::[^{;=]+)?\{")
_JAVA_IMPORT = re.compile(r"(?:^|(?<=;))[ \t]*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", re.M)
_JAVA_TYPE = re.compile(r"\b(?:class|interface)\s+([A-Za-z_$][\w$]*)(?:\s*<[^{]*?>)?(?:\s+extends\s+([A-Za-z_$][\w$.]*))?[^{;]*\{")
_JAVA_METHOD = re.compile(r"(?:^|(?<=[;{}\n]))\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s*)?(?:([\w$.<>\[\],? ]+?)\s+)?([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*(?:throws\s+[\w.,\s]+)?(\{|;)")


def blanked(text: str, pattern: re.Pattern = _BLANK) -> str:
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def body_end(code: str, start: int) -> int:
    """The place after the brace that closes the one at ``start``; the end of the text if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def _depths(code: str) -> list[int]:
    out, depth = [], 0
    for c in code:
        depth -= c == "}"
        out.append(depth)
        depth += c == "{"
    return out


class _File:
    def __init__(self, path: str, text: str, pattern: re.Pattern = _BLANK):
        self.out, self.text, self.lines = Collector(path), text, text.splitlines()
        self.code = blanked(text, pattern)
        self.depth = _depths(self.code)
        if self.code.count("{") != self.code.count("}") or min(self.depth, default=0) < 0:
            self.out.error(f"{path}: braces do not match")  # what can be read is given all the same
        self.module = self.out.entity("module", stem(path), stem(path), 1, len(self.lines))

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def define(self, kind: str, name: str, qualified: str, parent: str, start: int, end: int) -> str:
        a, b = self.line(start), self.line(max(start, end - 1))
        found = self.out.entity(kind, name, qualified, a, b, source_code=lines_between(self.lines, a, b))
        self.out.edge("contains", parent, found)
        return found

    def calls(self, owner: str, start: int, end: int) -> None:
        for m in _CALL.finditer(self.code, start, end):
            name = re.sub(r"\s+", "", m[2])
            if name.split(".")[0] not in NO_CALL or "." in name and name.split(".")[0] not in NO_CALL - {"super"}:
                self.out.reference("calls", owner, name)


def _first_letter(m: re.Match) -> int:
    return m.start() + len(m[0]) - len(m[0].lstrip())


def javascript(path: str, text: str) -> Collector:
    """Imports, classes with methods, functions and arrow functions at the top level, and what they call."""
    f = _File(path, text, _JS_BLANK)
    for m in _JS_IMPORT.finditer(text):
        if f.code[m.start() : m.end()].lstrip().startswith("import"):
            f.out.external(f.module, m[2])
    for m in _JS_CLASS.finditer(f.code):
        if f.depth[m.start()] == 0:
            end = body_end(f.code, m.end() - 1)
            owner = f.define("class", m[1], m[1], f.module, m.start(), end)
            if m[2]:
                f.out.reference("inherits", owner, m[2])
            for k in _JS_METHOD.finditer(f.code, m.end(), end):
                if f.depth[k.end() - 1] == 1 and k[1] not in NO_CALL - {"constructor"}:
                    stop = body_end(f.code, k.end() - 1)
                    method = f.define("method", k[1], f"{m[1]}.{k[1]}", owner, _first_letter(k), stop)
                    f.calls(method, k.end(), stop)
    for m in _JS_FUNCTION.finditer(f.code):
        if f.depth[m.start()] == 0:
            end = body_end(f.code, m.end() - 1)
            f.calls(f.define("function", m[1], m[1], f.module, m.start(), end), m.end(), end)
    for m in _JS_ARROW.finditer(f.code):
        if f.depth[m.start()] == 0:
            end = body_end(f.code, m.end() - 1) if m[2] else (f.code.find("\n", m.end()) + 1 or len(f.code))
            f.calls(f.define("function", m[1], m[1], f.module, m.start(), end), m.end(), end)
    return f.out


def java(path: str, text: str) -> Collector:
    """Imports, classes and interfaces (as classes) with ``extends``, methods and constructors, and what they call."""
    f = _File(path, text)
    for m in _JAVA_IMPORT.finditer(f.code):
        f.out.external(f.module, m[1])
    for m in _JAVA_TYPE.finditer(f.code):
        if f.depth[m.start()] == 0:
            end = body_end(f.code, m.end() - 1)
            owner = f.define("class", m[1], m[1], f.module, m.start(), end)
            if m[2]:
                f.out.reference("inherits", owner, m[2])
            for k in _JAVA_METHOD.finditer(f.code, m.end(), end):
                kind, name = (k[1] or "").strip(), k[2]
                if f.depth[k.end() - 1] != 1 or name in NO_CALL or (not kind and name != m[1]) or kind.split(" ")[-1] in ("new", "return", "throw"):
                    continue
                stop = body_end(f.code, k.end() - 1) if k[3] == "{" else k.end()
                method = f.define("method", name, f"{m[1]}.{name}", owner, _first_letter(k), stop)
                if k[3] == "{":
                    f.calls(method, k.end(), stop)
    return f.out
