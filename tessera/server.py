"""Tools over standard input and output: JSON-RPC, a message a line or framed by Content-Length."""

from __future__ import annotations

import json
import sys
from typing import BinaryIO

from tessera.api import Engine
from tessera.operators import region
from tessera.sources.scan import to_json

VERSIONS = ("2024-11-05", "2025-03-26", "2025-06-18")
MOST_IMPACTED = 50
SLIM = ("id", "file_path", "kind", "qualified_name", "signature", "span")
_TEXT, _NUMBER, _FLAG, _OBJECT = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}, {"type": "object"}
#: name: (what it does, its arguments, those it must have)
TOOLS = {
    "index": ("Bring the store up to the tree.", {"force": _FLAG}, ()),
    "query": ("Symbols by meaning, best first.", {"intent": _TEXT, "limit": _NUMBER}, ("intent",)),
    "symbols": ("Symbols by name, path or signature.", {"query": _TEXT, "limit": _NUMBER}, ()),
    "deps": ("Edges that touch a file.", {"file": _TEXT}, ("file",)),
    "impact": ("What depends on a symbol or file.", {"query": _TEXT, "file": _TEXT, "maxDepth": _NUMBER}, ()),
    "tests": ("Tests that reach a symbol or file.", {"query": _TEXT, "file": _TEXT}, ()),
    "icr": ("The region that an intent would change.", {"intent": _TEXT}, ("intent",)),
    "conflicts": ("Where two regions overlap.", {"a": _OBJECT, "b": _OBJECT}, ("a", "b")),
    "certify": ("Whether a diff may pass.", {"diff": _TEXT, "requireTests": _FLAG}, ("diff",)),
}


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def read_message(stream: BinaryIO) -> bytes | None:
    """The next message; None at the end. A line that begins a header is followed by as many bytes as it says."""
    while line := stream.readline():
        text = line.strip()
        if not text:
            continue
        if not text.lower().startswith(b"content-length:"):
            return text
        size = int(text.split(b":", 1)[1])
        while (line := stream.readline()) and line.strip():
            pass
        return stream.read(size)
    return None


class Server:
    def __init__(self, engine: Engine):
        self.engine = engine

    def call(self, name: str, given: dict) -> object:
        """The result of a tool."""
        e = self.engine
        if name not in TOOLS:
            raise RpcError(-32602, f"no such tool: {name}")
        for key in TOOLS[name][2]:
            if not given.get(key):
                raise RpcError(-32602, f"{name}: {key} is required")
        target = given.get("query") or given.get("file") or ""
        rows = lambda df: json.loads(to_json(df))
        match name:
            case "index":
                return e.index(bool(given.get("force")))
            case "query":
                return {"results": rows(e.query(given["intent"], int(given.get("limit", 50))).select(*SLIM, "tier"))}
            case "symbols":
                return {"symbols": rows(e.symbols(given.get("query", ""), int(given.get("limit", 50))).select(*SLIM, "rank"))}
            case "deps":
                return {"edges": rows(e.deps(given["file"]))}
            case "impact":
                found = e.impact(target, int(given.get("maxDepth", 3))).select(*SLIM, "depth")
                count = found.count()
                more = {"note": f"the first {MOST_IMPACTED} of {count}"} if count > MOST_IMPACTED else {}
                return {"count": count, "nodes": rows(found.orderBy("file_path", "span.start", "id").limit(MOST_IMPACTED))} | more
            case "tests":
                return {"tests": rows(e.tests(target).select(*SLIM))}
            case "icr":
                return rows(e.icr(given["intent"]))[0]
            case "conflicts":
                a, b = (e.spark.createDataFrame([(list(given[k].get("exclusive", [])), list(given[k].get("exclusive_files", [])))], "exclusive array<string>, exclusive_files array<string>") for k in ("a", "b"))
                return rows(region.conflicts(a, b))[0]
            case "certify":
                return e.certify(given["diff"], bool(given.get("requireTests")))

    def handle(self, method: str, given: dict) -> dict:
        if method == "initialize":
            asked = given.get("protocolVersion")
            return {"protocolVersion": asked if asked in VERSIONS else VERSIONS[1], "serverInfo": {"name": "tessera", "version": "0.1.0"}, "capabilities": {"tools": {}}}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": list(r)}} for n, (d, p, r) in TOOLS.items()]}
        if method == "tools/call":
            try:
                value = self.call(given.get("name", ""), given.get("arguments") or {})
            except RpcError:
                raise
            except Exception as error:
                raise RpcError(-32000, str(error)) from error
            return {"content": [{"type": "text", "text": json.dumps(value, separators=(",", ":"), default=str)}]}
        raise RpcError(-32601, f"no such method: {method}")

    def answer(self, raw: bytes) -> dict | None:
        """The response to a message; None to a notification."""
        try:
            message = json.loads(raw)
        except ValueError:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if "id" not in message:
            return None
        try:
            return {"jsonrpc": "2.0", "id": message["id"], "result": self.handle(message.get("method", ""), message.get("params") or {})}
        except RpcError as error:
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": error.code, "message": str(error)}}

    def serve(self, source: BinaryIO | None = None, sink: BinaryIO | None = None) -> None:
        source, sink = source or sys.stdin.buffer, sink or sys.stdout.buffer
        while (raw := read_message(source)) is not None:
            if (response := self.answer(raw)) is not None:
                sink.write(json.dumps(response).encode() + b"\n")
                sink.flush()
