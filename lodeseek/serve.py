"""The engine's three tools over JSON-RPC: lines on standard input and output, or HTTP posts without sessions."""

from __future__ import annotations

import json
import logging
import sys
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import IO, Any

from .plans.session import CodeSearch

VERSION = "2025-03-26"
LOG = logging.getLogger("lodeseek.tools")

_TEXT = {"type": "string"}
TOOLS = {
    "search_code": ("Ranked chunks for a query.", {"query": _TEXT, "top_k": {"type": "integer"}, "language": _TEXT, "symbol_type": _TEXT, "project": _TEXT}, ["query"]),
    "get_file_outline": ("Symbols of a file, or of the first whose path holds the text.", {"file_path": _TEXT}, ["file_path"]),
    "get_chunk": ("A chunk by its id; null if there is none.", {"chunk_id": _TEXT}, ["chunk_id"]),
}


def log_to(path: str) -> None:
    """Every call and its result, with the time, goes to that file."""
    handler = logging.FileHandler(path, encoding="utf-8")
    handler.setFormatter(logging.Formatter("[%(asctime)s.%(msecs)03d] %(message)s", "%Y-%m-%d %H:%M:%S"))
    LOG.addHandler(handler)
    LOG.setLevel(logging.INFO)


def call(engine: CodeSearch, name: str, arguments: dict[str, Any]) -> Any:
    """What a tool returns, as plain values; results are few rows."""
    if name not in TOOLS:
        raise KeyError(f"no tool {name}")
    unknown = set(arguments) - set(TOOLS[name][1])
    missing = set(TOOLS[name][2]) - set(arguments)
    if unknown or missing:
        raise ValueError(f"{name}: unknown {sorted(unknown)}, missing {sorted(missing)}")
    LOG.info("[INPUT] %s %s", name, json.dumps(arguments, ensure_ascii=False))
    if name == "search_code":
        rows = engine.search(**arguments).drop("content_hash", "rank")
    elif name == "get_file_outline":
        rows = engine.outline(arguments["file_path"])
    else:
        rows = engine.get_chunk(arguments["chunk_id"])
    found = [json.loads(r) for r in rows.toJSON().collect()]
    out = next(iter(found), None) if name == "get_chunk" else found
    LOG.info("[OUTPUT] %s %s", name, json.dumps(out, ensure_ascii=False))
    return out


def answer(engine: CodeSearch, request: dict[str, Any]) -> dict[str, Any] | None:
    """The response to one request; None to a notification."""
    method, ident, params = request.get("method"), request.get("id"), request.get("params") or {}
    if ident is None:
        return None
    try:
        if method == "initialize":
            result: Any = {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "lodeseek", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}
        elif method == "tools/call":
            try:
                body, failed = json.dumps(call(engine, params.get("name", ""), params.get("arguments") or {}), ensure_ascii=False), False
            except Exception as e:  # a tool's failure is its result
                body, failed = str(e), True
            result = {"content": [{"type": "text", "text": body}], "isError": failed}
        else:
            return {"jsonrpc": "2.0", "id": ident, "error": {"code": -32601, "message": f"no method {method}"}}
    except Exception as e:
        return {"jsonrpc": "2.0", "id": ident, "error": {"code": -32603, "message": str(e)}}
    return {"jsonrpc": "2.0", "id": ident, "result": result}


def answers(engine: CodeSearch, lines: Iterator[str]) -> Iterator[str]:
    for line in lines:
        if not line.strip():
            continue
        try:
            response = answer(engine, json.loads(line))
        except ValueError as e:
            response = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if response is not None:
            yield json.dumps(response, ensure_ascii=False)


def serve_lines(engine: CodeSearch, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    for out in answers(engine, iter(source.readline, "")):
        print(out, file=sink, flush=True)


def http_server(engine: CodeSearch, port: int, host: str = "127.0.0.1") -> HTTPServer:
    """Answers each post on its own; call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            out = "".join(answers(engine, iter([body])))
            self.send_response(200 if out else 202)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out.encode())))
            self.end_headers()
            self.wfile.write(out.encode())

        def log_message(self, *_: Any) -> None:
            pass

    return HTTPServer((host, port), Handler)
