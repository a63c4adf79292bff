"""The index as tools for a program that speaks JSON-RPC on standard input and output, one object a line."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.errors import PySparkException

from quarry.app import Index, Options
from quarry.operators import formats

#: Codes of JSON-RPC errors (fixed values).
PARSE, METHOD, PARAMS, INTERNAL = -32700, -32601, -32602, -32603
PROTOCOL = "2024-11-05"
TOOLS = [
    {"name": name, "description": text, "inputSchema": {"type": "object", "properties": fields, "required": need}}
    for name, text, fields, need in [
        ("search", "Find functions, classes and methods by words, within a token budget.", {"query": {"type": "string"}, "max_tokens": {"type": "integer", "default": 4000}, "file_filter": {"type": "string", "default": None}}, ["query"]),
        ("update", "Read the named files again.", {"files": {"type": "array", "items": {"type": "string"}}}, ["files"]),
        ("outline", "List the symbols of a file or folder.", {"path": {"type": "string"}, "max_tokens": {"type": "integer", "default": 2000}}, ["path"]),
    ]
]


class CallError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _text(args: dict, key: str) -> str:
    if not isinstance(args.get(key), str):
        raise CallError(PARAMS, f"{key}: a string is required")
    return args[key]


def _count(args: dict, key: str, default: int) -> int:
    value = args.get(key)
    if value is not None and (type(value) is not int or value < 0):
        raise CallError(PARAMS, f"{key}: not a whole number of at least 0")
    return default if value is None else value


class Server:
    def __init__(self, index: Index, root: str):
        self.index, self.root = index, root
        #: What the last search had to refresh.
        self.healed: dict[str, int] = {}

    def call(self, name: str, args: dict) -> str:
        """The text a tool gives."""
        if name == "search":
            glob = args.get("file_filter")
            options = Options(max_tokens=_count(args, "max_tokens", 4000), file_filter=[glob] if isinstance(glob, str) else None)
            packed, asked, self.healed = self.index.search_fresh(self.root, _text(args, "query"), options)
            return formats.as_text(packed, asked).first().output
        if name == "update":
            names = args.get("files")
            if not isinstance(names, list) or not all(isinstance(f, str) for f in names):
                raise CallError(PARAMS, "files: a list of strings is required")
            done = self.index.update(self.root, names, force=True)
            return f"Updated {done['n_files']} file{'s' * (done['n_files'] != 1)}, {done['n_chunks']} chunk{'s' * (done['n_chunks'] != 1)}"
        if name == "outline":
            rows = self.index.outline(_text(args, "path"), _count(args, "max_tokens", 2000)).orderBy("line_no").collect()  # bounded by its budget
            return "".join(r.line + "\n" for r in rows)
        raise CallError(PARAMS, f"unknown tool: {name}")

    def answer(self, line: str) -> dict | None:
        """The response to one line; None for a notification."""
        try:
            request = json.loads(line)
        except json.JSONDecodeError as e:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": str(e)}}
        if not isinstance(request, dict) or "id" not in request:
            return None
        params = request.get("params") if isinstance(request.get("params"), dict) else {}
        base = {"jsonrpc": "2.0", "id": request["id"]}
        try:
            match request.get("method"):
                case "initialize":
                    result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "quarry", "version": self.index.config.version}}
                case "tools/list":
                    result = {"tools": TOOLS}
                case "tools/call":
                    args = params.get("arguments") if isinstance(params.get("arguments"), dict) else {}
                    result = {"content": [{"type": "text", "text": self.call(str(params.get("name")), args)}]}
                case other:
                    raise CallError(METHOD, f"unknown method: {other}")
        except CallError as e:
            return base | {"error": {"code": e.code, "message": str(e)}}
        except ValueError as e:
            return base | {"error": {"code": PARAMS, "message": str(e)}}
        except (PySparkException, RuntimeError) as e:
            return base | {"error": {"code": INTERNAL, "message": str(e)}}
        return base | {"result": result}

    def run(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            if line.strip() and (response := self.answer(line)) is not None:
                yield json.dumps(response)
