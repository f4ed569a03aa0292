"""The tools as a server of the Model Context Protocol: JSON-RPC 2.0, one message a line, on standard input and output."""
from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from noteloom import api
from noteloom.config import EXTRACTIONS, MODES, AppConfig
from noteloom.plans.searcher import Searcher

VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE, REQUEST, METHOD, PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
_TYPES = {"string": str, "integer": int, "boolean": bool}


def _schema(required: tuple[str, ...] = (), **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(required)}


TOOLS: dict[str, tuple[str, dict, Callable[..., str]]] = {
    "query_memos": (
        "Search the memos by keywords, by meaning, or both",
        _schema(
            query={"type": "string", "description": "What to search for", "default": ""}, top_k={"type": "integer", "minimum": 0, "default": 10}, tag_filter={"type": "string"},
            mode={"type": "string", "enum": list(MODES)}, extraction_mode={"type": "string", "enum": list(EXTRACTIONS)}, max_chars={"type": "integer", "minimum": 0, "default": 5000},
            include_summary={"type": "boolean", "default": True}, include_raw={"type": "boolean", "default": True}, use_llm_summary={"type": "boolean", "default": False},
        ),
        api.render_memos,
    ),
    "list_tags": ("All tags with their numbers of memos", _schema(), lambda searcher, config: api.render_tags(searcher)),
    "get_recent_memos": ("The newest memos", _schema(limit={"type": "integer", "minimum": 0, "default": 10}), lambda searcher, config, **args: api.render_recent(searcher, **args)),
}


class Failure(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def checked(name: str, args) -> dict:
    """Arguments of a tool call, of the types that the tool asks for. Null arguments are as good as none."""
    if name not in TOOLS:
        raise Failure(PARAMS, f"no such tool: {name}")
    if not isinstance(args, dict):
        raise Failure(PARAMS, "arguments must be an object")
    known, out = TOOLS[name][1]["properties"], {}
    for key, value in args.items():
        if key not in known:
            raise Failure(PARAMS, f"{name} has no argument {key}")
        if value is None:
            continue
        kind = known[key]["type"]
        if not isinstance(value, _TYPES[kind]) or kind == "integer" and (isinstance(value, bool) or value < 0):
            raise Failure(PARAMS, f"{key} must be of type {kind}")
        out[key] = value
    return out


class Server:
    def __init__(self, searcher: Searcher, settings: AppConfig):
        self.searcher, self.settings = searcher, settings

    def initialize(self, params: dict) -> dict:
        asked = params.get("protocolVersion")
        return {
            "protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "noteloom", "version": "2"},
            "instructions": "Searches memos by keywords and by meaning",
        }

    def tools(self, params: dict) -> dict:
        return {"tools": [{"name": name, "description": text, "inputSchema": schema} for name, (text, schema, _) in TOOLS.items()]}

    def call(self, params: dict) -> dict:
        name = params.get("name")
        args = checked(name, params.get("arguments") or {})
        return {"content": [{"type": "text", "text": TOOLS[name][2](self.searcher, config=self.settings, **args)}], "isError": False}

    def answer(self, line: str) -> dict | None:
        """The answer to one message; none to a notification."""
        try:
            message = json.loads(line)
        except ValueError as error:
            return _failed(None, PARSE, str(error))
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            return _failed(message.get("id") if isinstance(message, dict) else None, REQUEST, "not a request")
        if "id" not in message:
            return None
        methods = {"initialize": self.initialize, "ping": lambda _: {}, "tools/list": self.tools, "tools/call": self.call}
        if message["method"] not in methods:
            return _failed(message["id"], METHOD, f"no such method: {message['method']}")
        params = message.get("params") or {}
        if not isinstance(params, dict):
            return _failed(message["id"], PARAMS, "params must be an object")
        try:
            return {"jsonrpc": "2.0", "id": message["id"], "result": methods[message["method"]](params)}
        except Failure as error:
            return _failed(message["id"], error.code, str(error))
        except Exception as error:  # a server goes on after a call that failed
            return _failed(message["id"], INTERNAL, str(error))

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            if line.strip() and (found := self.answer(line)) is not None:
                yield json.dumps(found, ensure_ascii=False)


def _failed(id_, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}
