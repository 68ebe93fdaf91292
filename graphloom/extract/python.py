"""Python sources by the standard library's syntax tree."""

from __future__ import annotations

import ast

from .base import Collector, lines_between, stem

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(node: ast.expr) -> str | None:
    """``a.b.c`` of names and attributes; from the first other expression on, only what follows it."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts)) or None


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """Name, plain, * and ** parameters with annotations, and the result; no defaults or keyword-only parameters."""
    marked = [("", a) for a in node.args.args] + [("*", node.args.vararg), ("**", node.args.kwarg)]
    shown = [star + a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for star, a in marked if a]
    result = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({', '.join(shown)}){result}"


def extract(path: str, text: str) -> Collector:
    """Module, top-level classes and functions, direct methods; containment, inheritance, calls and imports."""
    out, lines = Collector(path), text.splitlines()
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        out.error(f"syntax error: {e}")
        return out
    module = out.entity("module", stem(path), stem(path), 1, len(lines), docstring=ast.get_docstring(tree))
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for alias in node.names:
                out.external(module, alias.name)
        elif isinstance(node, ast.ImportFrom) and node.module:
            out.external(module, node.module)

    def define(node, kind: str, qualified: str, parent: str, sign: str | None) -> str:
        found = out.entity(kind, node.name, qualified, node.lineno, node.end_lineno, docstring=ast.get_docstring(node), signature=sign, source_code=lines_between(lines, node.lineno, node.end_lineno))
        out.edge("contains", parent, found)
        return found

    def routine(node, kind: str, qualified: str, parent: str) -> None:
        found = define(node, kind, qualified, parent, signature(node))
        for inner in ast.walk(node):
            if isinstance(inner, ast.Call) and isinstance(inner.func, ast.Name | ast.Attribute) and (name := dotted(inner.func)):
                out.reference("calls", found, name)

    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            owner = define(node, "class", node.name, module, None)
            for base in node.bases:
                if isinstance(base, ast.Name | ast.Attribute) and (name := dotted(base)):
                    out.reference("inherits", owner, name)
            for inner in node.body:
                if isinstance(inner, _DEFS):
                    routine(inner, "method", f"{node.name}.{inner.name}", owner)
        elif isinstance(node, _DEFS):
            routine(node, "function", node.name, module)
    return out
