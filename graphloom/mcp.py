"""A line-based JSON-RPC server over the engine."""

from __future__ import annotations

import json
from typing import IO

from graphloom.api import Engine
from graphloom.cli import plain

_N, _I, _B = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}


def _t(text: str, required: tuple[str, ...] = (), **properties) -> dict:
    return {"description": text, "inputSchema": {"type": "object", "properties": properties, "required": list(required)}}


TOOLS = {
    "index": _t("Index a source tree", ("tree",), tree=_N, root_id=_N, force=_B),
    "stats": _t("Counts of the index"),
    "workspace_status": _t("State of each root"),
    "find_symbol": _t("Definitions of a name", ("name",), name=_N, limit=_I, fuzzy=_B),
    "callers": _t("References to a name", ("name",), name=_N, limit=_I, window=_N, mode=_N),
    "blast_radius": _t("What a change to a name touches", ("name",), name=_N, depth=_I, limit=_I),
    "graph": _t("Nodes and edges around a name", ("name",), name=_N, direction=_N, depth=_I, sound=_B),
    "who_calls": _t("Callers and implementors apart", ("name",), name=_N, limit=_I, noisy=_B),
    "impact": _t("The walk backwards from a name", ("name",), name=_N, depth=_I, limit=_I, window=_N, sound=_B),
    "macro_status": _t("State of the side dataset"),
    "macro_rebuild": _t("Index an expanded tree", ("tree", "side", "source"), tree=_N, side=_N, source=_N),
    "subset": _t("Violations and clean parts"),
    "graph_diff": _t("Edges that came and went", limit=_I, exact_only=_B, promote=_B),
    "related_files": _t("Files related to a name", ("name",), name=_N, limit=_I),
    "importers": _t("Importers of a file or package", ("name",), name=_N, limit=_I),
    "enrich": _t("Symbols that lack a description", limit=_I),
}


def call(engine: Engine, tool: str, a: dict):
    name = a.pop("name", None)
    if tool == "index":
        return engine.build(a["tree"], a.get("root_id", ""), a.get("force", False))
    if tool == "find_symbol":
        return plain(engine.find(name, **a))
    if tool == "callers":
        return engine.callers_payload(name, **a)
    if tool in ("blast_radius", "who_calls", "graph"):
        return getattr(engine, tool)(name, **a)
    if tool == "impact":
        return plain(engine.impact(name, **a).orderBy("rank"))
    if tool == "related_files":
        return plain(engine.related(name, **a).orderBy("rank"))
    if tool == "importers":
        return plain(engine.importers(name, **a).orderBy("rank"))
    if tool == "graph_diff":
        return engine.diff(**a)
    if tool == "macro_status":
        return engine.side_status()
    if tool == "macro_rebuild":
        return engine.build_side(a["tree"], a["side"], a["source"])
    if tool == "enrich":
        from graphloom.operators.lookup import undescribed

        return plain(undescribed(engine.symbols, a.get("limit", 100)))
    return getattr(engine, tool)()


def answer(engine: Engine, message: dict) -> dict | None:
    """The reply to one message; notifications have none."""
    ident, method = message.get("id"), message.get("method")
    if ident is None:
        return None
    ok = lambda result: {"jsonrpc": "2.0", "id": ident, "result": result}
    if method == "initialize":
        return ok({"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "1"}})
    if method == "ping":
        return ok({})
    if method == "tools/list":
        return ok({"tools": [{"name": n, **t} for n, t in TOOLS.items()]})
    if method == "tools/call":
        p = message.get("params") or {}
        if p.get("name") not in TOOLS:
            return {"jsonrpc": "2.0", "id": ident, "error": {"code": -32602, "message": f"no tool {p.get('name')!r}"}}
        try:
            got = call(engine, p["name"], dict(p.get("arguments") or {}))
            return ok({"content": [{"type": "text", "text": json.dumps(got, ensure_ascii=False, default=str)}]})
        except (LookupError, ValueError, TypeError) as err:
            return ok({"content": [{"type": "text", "text": str(err)}], "isError": True})
    return {"jsonrpc": "2.0", "id": ident, "error": {"code": -32601, "message": f"no method {method!r}"}}


def serve(engine: Engine, source: IO[str], sink: IO[str]) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            reply = answer(engine, json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
