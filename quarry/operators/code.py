"""Symbols of source files: one row for each function, method, class or struct, with byte and line places.

Python files go through the standard parser. Those it rejects fall back to lines at column 0 that begin a definition
(``is_heuristic``). Go and TypeScript files are read by masking strings and comments and matching brackets; methods of
object literals and regular expressions with brackets or quotes aren't understood there.
A file without text gives no rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = (
    "file_path string, language string, symbol_name string, symbol_type string, parent_symbol string, start_byte long, end_byte long, start_line int, end_line int, "
    "chunk_text string, file_docstring string, imports array<string>, cross_references array<string>, is_heuristic boolean"
)
_HEADER = re.compile(rb"^(?:async +def|def|class) +([^\W\d]\w*)", re.M)
_GO_MASK = re.compile(rb"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`", re.S)
_GO_FUNC = re.compile(rb"^func\s+(?:\(\s*(?:\w+\s+)?(\*?)\s*(\w+)(\[[^\]]*\])?\s*\)\s*)?(\w+)", re.M)
_GO_TYPE = re.compile(rb"^type\s*(\()?\s*(\w+)(?:\[[^\]]*\])?\s+struct\b", re.M)


def _row(data: bytes, start: int, end: int, name: str, kind: str, parent: str | None = None, **more) -> dict:
    """A symbol's row; its span takes in the line end that follows."""
    tail = re.match(rb"\r\n|\n|\r", data[end : end + 2])
    end += len(tail.group()) if tail else 0
    first = data.count(b"\n", 0, start) + 1
    last = first + data.count(b"\n", start, max(start, end - 1))
    base = {"file_docstring": None, "imports": [], "cross_references": [], "is_heuristic": False}
    return base | {"symbol_name": name, "symbol_type": kind, "parent_symbol": parent, "start_byte": start, "end_byte": end, "start_line": first, "end_line": last, "chunk_text": data[start:end].decode("utf-8", "replace")} | more


def by_lines(data: bytes) -> list[dict]:
    """From each header at column 0 to the next one or the end; nothing without headers."""
    heads = list(_HEADER.finditer(data))
    ends = [h.start() for h in heads[1:]] + [len(data)] * bool(heads)
    return [_row(data, h.start(), e, h.group(1).decode(), "class" if h.group().startswith(b"class") else "function", is_heuristic=True) for h, e in zip(heads, ends, strict=True)]


def python_symbols(data: bytes) -> list[dict]:
    """Functions, methods and classes with decorators, the module's docstring and imports, and names they call."""
    try:
        tree = ast.parse(data)
    except (SyntaxError, ValueError, RecursionError):
        return by_lines(data)
    starts = [0] + [m.end() for m in re.finditer(rb"\r\n|\n|\r", data)]

    def span(node) -> tuple[int, int]:
        line, column = min([(node.lineno, node.col_offset)] + [(d.lineno, d.col_offset) for d in getattr(node, "decorator_list", [])])
        at = starts[line - 1] + column
        if getattr(node, "decorator_list", []):
            at = data.rindex(b"@", 0, at)
        return at, starts[node.end_lineno - 1] + node.end_col_offset

    def cut(node) -> str:
        return data[slice(*span(node))].decode("utf-8", "replace").rstrip()

    found, calls, todo = [], [], [(tree, None)]
    while todo:  # before its children, in order
        node, above = todo.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if isinstance(above, ast.ClassDef) else "function"
            found.append((node, kind, above.name if above else None))
            above = node
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            calls.append((span(node)[0], node.func.id))
        todo.extend((child, above) for child in reversed(list(ast.iter_child_nodes(node))))
    imports = [cut(n) for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom)]
    first, doc = tree.body[0] if tree.body else None, None
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        quoted = re.fullmatch(r"[A-Za-z]{0,2}(\"\"\"|'''|\"|')(.*)\1", cut(first), re.S)
        doc = quoted.group(2) if quoted else cut(first)
    rows = []
    for node, kind, parent in found:
        a, b = span(node)
        own = list(dict.fromkeys(name for at, name in sorted(calls, key=lambda c: c[0]) if a <= at < b))
        rows.append(_row(data, a, b, node.name, kind, parent, file_docstring=doc, imports=imports, cross_references=own))
    return sorted(rows, key=lambda r: r["start_byte"])


def _closing(text: bytes, at: int) -> int:
    """The place after the bracket that closes the one at ``at``; the end where none does."""
    depth = 0
    for m in re.compile(rb"[(){}\[\]]").finditer(text, at):
        depth += 1 if m.group() in b"({[" else -1
        if not depth:
            return m.end()
    return len(text)


def go_symbols(data: bytes) -> list[dict]:
    """Functions, methods with their receiver's type, and structs; of grouped types the first."""
    text = _GO_MASK.sub(lambda m: re.sub(rb"[^\n]", b" ", m.group()), data)
    rows = []
    for m in _GO_FUNC.finditer(text):
        at = m.end()
        while at < len(text) and text[at : at + 1] != b"\n":
            c = text[at : at + 1]
            if c == b"{" and not re.search(rb"\b(?:interface|struct)\s*$", text[m.end() : at]):
                at = _closing(text, at)
                break
            at = _closing(text, at) if c in (b"(", b"[", b"{") else at + 1
        star, name, generic, own = m.groups()
        receiver = None if not name or star and generic else (name + (generic or b"")).decode()
        rows.append(_row(data, m.start(), at, own.decode(), "method" if name else "function", receiver))
    for m in _GO_TYPE.finditer(text):
        opening = m.start(1) if m.group(1) else text.find(b"{", m.end())
        if opening >= 0:
            rows.append(_row(data, m.start(), _closing(text, opening), m.group(2).decode(), "struct"))
    return sorted(rows, key=lambda r: r["start_byte"])


_TS_MASK = re.compile(_GO_MASK.pattern.replace(rb"`[^`]*`", rb"`(?:\\.|[^`\\])*`"), re.S)
_TS_DEFINITION = re.compile(rb"(?<![\w$.])(?:(?P<abstract>abstract\s+)?class\s+(?P<class>[\w$]+)|(?:async\s+)?function\s*\*?\s*(?P<function>[\w$]+)|(?:const|let|var)\s+(?P<arrow>[\w$]+)(?=\s*[:=]))")
_TS_MEMBER = re.compile(rb"(?:(?:public|private|protected|static|async|override|get|set)\s+|\*\s*)*(?P<name>[\w$#]+)\s*(?:<[^<>()]*>\s*)?\(")
_TS_VALUE = re.compile(rb"\s*(?::[^=;]*?(?:=>[^=;]*?)?)?=(?!=)\s*(?:async\s+)?(?:<[^<>()]*>\s*)?(?P<params>\(|[\w$]+\s*=>)")


def _body(text: bytes, at: int) -> int:
    """The place of the ``{`` that opens a body after parameters; -1 where a signature ends without one."""
    for m in re.compile(rb"[{;(\[}]").finditer(text, at):
        if m.start() < at:
            continue
        if m.group() in b";}":
            return -1
        if m.group() == b"{" and not re.search(rb"(?:[:|&<,]|=>)\s*$", text[max(0, m.start() - 200) : m.start()]):
            return m.start()
        at = _closing(text, m.start())
    return -1


def _expression_end(text: bytes, at: int) -> int:
    """The end of an arrow function's body that begins at or after ``at``."""
    at += len(text[at:]) - len(text[at:].lstrip())
    if text[at : at + 1] == b"{":
        return _closing(text, at)
    while at < len(text) and text[at : at + 1] not in (b";", b"\n", b",", b")", b"}", b"]"):
        at = _closing(text, at) if text[at : at + 1] in (b"(", b"[", b"{") else at + 1
    return at


def typescript_symbols(data: bytes) -> list[dict]:
    """Function declarations, arrow functions with a name, classes and their methods; interfaces and types are left out."""
    text = _TS_MASK.sub(lambda m: re.sub(rb"[^\n]", b" ", m.group()), data)
    found: list[tuple[int, int, str, str]] = []  # start, end, name, kind
    for m in _TS_DEFINITION.finditer(text):
        before = text[max(0, m.start() - 200) : m.start()].rstrip()
        if m["arrow"]:
            value = _TS_VALUE.match(text, m.end())
            if not value:
                continue
            at = value.end()
            if value["params"] == b"(":
                arrow = re.compile(rb"\s*(?::[^;={}]*)?=>").match(text, _closing(text, at - 1))
                if not arrow:
                    continue
                at = arrow.end()
            found.append((m.start("arrow"), _expression_end(text, at), m["arrow"].decode(), "function"))
        elif re.search(rb"(?:[=(,:?\[!&|+]|\b(?:return|new|typeof|await|yield))$", before):
            continue  # an expression
        elif m["function"]:
            opening = text.find(b"(", m.end())
            body = _body(text, _closing(text, opening)) if opening >= 0 else -1
            if body >= 0:
                found.append((m.start(), _closing(text, body), m["function"].decode(), "function"))
        elif not m["abstract"]:
            opening = text.find(b"{", m.end())
            if opening < 0:
                continue
            end, at = _closing(text, opening), opening + 1
            found.append((m.start(), end, m["class"].decode(), "class"))
            while at < end:
                member = _TS_MEMBER.match(text, at)
                if member and not re.match(rb"[\w$#.@=]", text[at - 1 : at]):
                    after = _closing(text, member.end() - 1)
                    ahead = re.compile(rb"\s*[{:]").match(text, after)
                    body = _body(text, after) if ahead else -1
                    if body >= 0:
                        after = _closing(text, body)
                        found.append((at, after, member["name"].decode(), "method"))
                    at = after
                else:
                    at = _closing(text, at) if text[at : at + 1] in (b"{", b"(", b"[") else at + 1
    found.sort(key=lambda f: (f[0], -f[1]))
    rows, open_ = [], []
    for start, end, name, kind in found:
        open_ = [o for o in open_ if o[0] >= end]
        rows.append(_row(data, start, end, name, kind, open_[-1][1] if open_ else None))
        open_.append((end, name))
    return rows


SEGMENTERS = {"python": python_symbols, "go": go_symbols, "typescript": typescript_symbols}


def cut(language: str, data: bytes) -> list[dict]:
    """A file's symbols; one that its reader fails on is cut at lines, so other files go on."""
    try:
        return SEGMENTERS.get(language, by_lines)(data)
    except Exception:  # noqa: BLE001
        return by_lines(data)


def symbols(files: DataFrame) -> DataFrame:
    """The symbols of files (file_path, language, text); a file's rows come in order of their place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [{"file_path": p, "language": k} | r for p, k, t in batch.itertuples(index=False) if t for r in cut(k, t.encode())]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("file_path", "language", "text").mapInPandas(run, SCHEMA)
