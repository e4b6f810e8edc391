"""Chat formatting: tool calls and results linked, ordered, validated, and serialised.

Messages become nodes: plain messages, calls and results. Results meet calls, and calls the
calls they depend on, by a hash join on (conversation, identifier), so the calls of a very long
conversation spread over all tasks. Order keys come from iterative joins over dependencies; a
node's place in its conversation is a rank that no single task has to hold.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import slices
from graphloom.llm.common import row_rank, written

#: Turns of a conversation that are ranked in one task.
TURNS = 256
#: Levels of dependencies that joins follow; longer chains are followed by conversation.
MOST_LEVELS = 32
#: Depth of what depends on a cycle: after all else of its turn.
LAST = (1 << 31) - 1

SURROGATES = re.compile("[\ud800-\udfff]")
_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def plain(text: str) -> str:
    """``text`` with half surrogates, which no UTF-8 can hold, written as JSON escapes."""
    return SURROGATES.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks and no escapes but the required ones."""
    return plain(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")))


def fits(value: object, kind: str) -> bool:
    """Whether a JSON value has this type; types of no known name fit all values."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "number":
        return number
    if kind == "integer":
        return number and (isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES.get(kind, object))


def equal(a: object, b: object) -> bool:
    """Equality of JSON values: booleans are not numbers."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    return a == b


def problems(value: object, schema: dict | bool, at: str = "$") -> list[str]:
    """What in ``value`` breaks a schema of types (one or a list), enums, properties, required
    names, items and bounds, or a schema that is only true or false; names beyond the schema break it only if additionalProperties is false."""
    out: list[str] = []
    if not isinstance(schema, dict):
        return [] if schema else [f"{at}: not allowed"]
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(fits(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and not any(equal(value, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if fits(value, "number") and ("minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]):
        out.append(f"{at}: out of bounds")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    return out


def parse_message(role: str | None, text: str | None, tools: dict[str, dict] | None) -> list[tuple]:
    """The nodes of one message: (kind, call_id, name, depends_on, error, json).

    An assistant's JSON object with ``tool_calls`` gives a call each; a tool's object with
    ``tool_call_id`` a result; everything else is a plain message, and so is JSON that is nested
    too deeply to be read or written.
    """
    try:
        found = parse_body(role, text, tools)
    except RecursionError:
        found = []
    if not found:
        return [("message", None, None, [], "", canonical({"role": role, "content": text}))]
    clean = lambda x: None if x is None else plain(x)
    return [(kind, clean(ident), clean(name), [plain(x) for x in needs], plain(bad), body) for kind, ident, name, needs, bad, body in found]


def parse_body(role: str | None, text: str | None, tools: dict[str, dict] | None) -> list[tuple]:
    """The calls or the result of a message; none if it is neither."""
    body = None
    if role in ("assistant", "tool") and text and text.lstrip()[:1] == "{":
        try:
            body = json.loads(text)
        except (ValueError, RecursionError):
            body = None
    if role == "tool" and isinstance(body, dict) and isinstance(body.get("tool_call_id"), str):
        return [("result", body["tool_call_id"], None, [], "", canonical({"role": "tool", "tool_call_id": body["tool_call_id"], "content": body.get("content")}))]
    if role == "assistant" and isinstance(body, dict) and isinstance(body.get("tool_calls"), list) and all(isinstance(c, dict) for c in body["tool_calls"]) and body["tool_calls"]:
        out = []
        for c in body["tool_calls"]:
            ident, name, args = c.get("id"), c.get("name"), c.get("arguments", {})
            if isinstance(args, str):
                try:
                    args = json.loads(args)
                except (ValueError, RecursionError):
                    pass
            bad = [] if isinstance(ident, str) else ["id: missing"]
            bad += [] if isinstance(name, str) else ["name: missing"]
            if tools is not None and isinstance(name, str):
                bad += problems(args, tools[name]) if name in tools else [f"name: no tool {name}"]
            needs = [x for x in c.get("depends_on", []) if isinstance(x, str)] if isinstance(c.get("depends_on", []), list) else []
            out.append(("call", ident if isinstance(ident, str) else None, name if isinstance(name, str) else None, needs, "; ".join(bad), canonical({"role": "assistant", "tool_call": {"id": ident, "name": name, "arguments": args}})))
        return out
    return []


def nodes(messages: DataFrame, tools: dict[str, dict] | None, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(3)):
                part = batch.slice(a, b - a)
                at, seq, out = [], [], []
                for i, (r, t) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    for k, node in enumerate(parse_message(r, t, tools)):
                        at.append(i)
                        seq.append(k)
                        out.append(node)
                columns = list(zip(*out, strict=True)) or [()] * 6
                own = [part.column(i).take(pa.array(at, pa.int64())) for i in (0, 1, 2)]
                kinds = [pa.string()] * 3 + [pa.list_(pa.string())] + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([*own, pa.array(seq, pa.int32()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["conv", "turn", "role", "seq", "kind", "call_id", "name", "needs", "error", "json"])

    return rows.mapInArrow(run, f"conv {kind}, turn long, role string, seq int, kind string, call_id string, name string, needs array<string>, error string, json string")


def order_keys(linked: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node (nid) its eff and depth, such that what it needs sorts before it.

    ``linked`` (nid, conv, turn), ``edges`` (nid, before), both written. eff is the greatest turn
    of a node and all it needs, depth the longest chain to it. Only nodes that need something are
    joined. What has not settled within the levels lies on long chains or behind cycles; that rest
    is placed in one task a conversation, in time linear in its edges. Cyclic is what can never be
    placed: the nodes of cycles and those that need them.
    """
    turns = linked.select("nid", "turn")
    state = written(edges.select("nid").union(edges.select("before")).distinct().join(turns, "nid").select("nid", F.coalesce("turn", F.lit(0)).alias("eff"), F.lit(0).alias("depth")), "order")
    moved = None
    for _ in range(MOST_LEVELS):
        up = edges.join(state.select(F.col("nid").alias("before"), F.col("eff").alias("e"), (F.col("depth") + 1).alias("d")), "before").groupBy("nid").agg(F.max("e").alias("e"), F.max("d").alias("d"))
        new = state.join(up, "nid", "left").select("nid", F.greatest("eff", "e").alias("eff"), F.greatest("depth", "d").alias("depth"), ((F.coalesce("e", "eff") > F.col("eff")) | (F.coalesce("d", "depth") > F.col("depth"))).alias("moved"))
        new = written(new, "order")
        state, moved = new.drop("moved"), new.where("moved").select("nid")
        if moved.isEmpty():
            moved = None
            break
    if moved is None:
        return state.withColumn("cyclic", F.lit(False))
    needed = state.select(F.col("nid").alias("before"), F.col("eff").alias("e"), F.col("depth").alias("d")).join(moved.select(F.col("nid").alias("before"), F.lit(True).alias("open")), "before", "left")
    rest = edges.join(moved, "nid").join(state.select("nid", "eff"), "nid").join(needed, "before").join(linked.select("nid", "conv"), "nid")
    rest = rest.select("conv", "nid", "eff", "before", "e", "d", F.coalesce("open", F.lit(False)).alias("open"))
    settled = written(rest.groupBy("conv").applyInArrow(place_rest, "nid long, last long, far int, cyclic boolean"), "settled")
    return state.join(settled, "nid", "left").select("nid", F.coalesce("last", "eff").alias("eff"), F.coalesce("far", "depth").alias("depth"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def place_rest(table: pa.Table) -> pa.Table:
    """The eff and depth of the nodes of one conversation that joins did not settle.

    Rows (nid, eff, before, e, d, open): a node, the greatest turn known for it, and one node that
    it needs with its eff and depth, which are final unless it is ``open`` itself.
    """
    nid, before, still = (table[c].to_numpy() for c in ("nid", "before", "open"))
    names, first, node = np.unique(nid, return_index=True, return_inverse=True)
    eff, depth = table["eff"].to_numpy()[first].copy(), np.zeros(len(names), np.int64)
    np.maximum.at(eff, node[~still], table["e"].to_numpy()[~still])
    np.maximum.at(depth, node[~still], table["d"].to_numpy()[~still].astype(np.int64) + 1)
    source, target = np.searchsorted(names, before[still]), node[still]
    order = np.argsort(source, kind="stable")
    source, target = source[order], target[order]
    start = np.searchsorted(source, np.arange(len(names) + 1)).tolist()
    target, eff, depth, waits = target.tolist(), eff.tolist(), depth.tolist(), np.bincount(target, minlength=len(names)).tolist()
    ready = [k for k, w in enumerate(waits) if not w]
    while ready:
        k = ready.pop()
        for t in target[start[k] : start[k + 1]]:
            eff[t], depth[t], waits[t] = max(eff[t], eff[k]), max(depth[t], depth[k] + 1), waits[t] - 1
            if not waits[t]:
                ready.append(t)
    # Turns go round cycles from the greatest on, so each node takes one once.
    never = [k for k, w in enumerate(waits) if w]
    seen = set()
    for top in sorted(never, key=lambda k: -eff[k]):
        ready = [] if top in seen else [top]
        seen.add(top)
        while ready:
            k = ready.pop()
            depth[k] = LAST
            for t in target[start[k] : start[k + 1]]:
                if t not in seen:
                    seen.add(t)
                    eff[t] = eff[k]
                    ready.append(t)
    return pa.table({"nid": pa.array(names, pa.int64()), "last": pa.array(eff, pa.int64()), "far": pa.array(depth, pa.int32()), "cyclic": pa.array([w > 0 for w in waits], pa.bool_())})


def link(messages: DataFrame, tools: dict[str, dict] | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: conv, turn, seq, position, kind, call_id, name, linked, valid, error, json.

    ``position`` is the node's gapless place in its conversation: by turn, but results follow
    their calls and calls what they depend on. A result links to the call with its identifier
    (of several, the first); ``valid`` is false for calls that break their tool's schema,
    results without a call, and cycles with all that needs them. Null conversations form one conversation, null turns
    sort first and ties are broken by the canonical JSON. Repeated messages stay repeated.
    Other columns are not read; an empty table gives an empty result.
    """
    found = written(nodes(messages, tools, conv, turn, role, text).withColumn("nid", F.monotonically_increasing_id()), "nodes")
    calls = found.where("kind = 'call' AND call_id IS NOT NULL").groupBy("conv", "call_id").agg(F.min_by(F.struct("nid", "name"), F.struct("turn", "seq", "json", "nid")).alias("c"))
    calls = written(calls.select(F.col("conv").alias("c_conv"), F.col("call_id").alias("c_id"), F.col("c.nid").alias("before"), F.col("c.name").alias("c_name")), "calls")
    needs = found.where("kind = 'result'").select("nid", "conv", F.col("call_id").alias("need")).union(found.where("kind = 'call' AND size(needs) > 0").select("nid", "conv", F.explode("needs")))
    met = needs.join(calls, F.col("conv").eqNullSafe(F.col("c_conv")) & (F.col("need") == F.col("c_id"))).where("nid <> before")
    edges = written(met.select("nid", "before", "c_name").distinct(), "edges")
    keys = order_keys(found, edges.select("nid", "before"))
    names = edges.groupBy("nid").agg(F.min("c_name").alias("c_name"), F.lit(True).alias("_met"))
    rows = found.join(written(keys.join(names, "nid", "left"), "keys"), "nid", "left")
    missing = (F.col("kind") == "result") & F.col("_met").isNull()
    error = F.concat_ws("; ", F.nullif("error", F.lit("")), F.when(missing, F.lit("no such call")), F.when(F.coalesce("cyclic", F.lit(False)), F.lit("cyclic")))
    rows = rows.select(
        "conv", "turn", "seq", "kind", "call_id", F.when(F.col("kind") == "result", F.col("c_name")).otherwise(F.col("name")).alias("name"),
        (F.col("kind") == "result").__and__(F.col("_met").isNotNull()).alias("linked"), (error == "").alias("valid"), error.alias("error"), "json",
        F.coalesce("eff", "turn", F.lit(-(1 << 40))).alias("eff"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )
    rows = written(rows, "linked")
    placed = row_rank(rows, ["conv"], ["eff", "depth", "turn", "seq", "json"], "position", bucket=F.floor(F.col("eff") / TURNS))
    return placed.select(F.col("conv").alias(conv), F.col("turn").alias(turn), "seq", "position", "kind", "call_id", "name", "linked", "valid", "error", "json")


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations in the form of tool use: an assistant's turn t is call ``c<t>`` of tool
    ``say``, the user's turn after it its result."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":|\}$', "")
    id: Column = F.col("turn").cast("string")
    call = F.concat(F.lit('{"tool_calls":[{"id":"c'), id, F.lit('","name":"say","arguments":{"text":'), quoted("text"), F.lit(',"turn":'), id, F.lit("}}]}"))
    result = F.concat(F.lit('{"tool_call_id":"c'), (F.col("turn") - 1).cast("string"), F.lit('","content":'), quoted("text"), F.lit("}"))
    some = F.col("text").isNotNull() & F.col("turn").isNotNull()
    role = F.when(some & (F.col("role") == "user") & (F.col("turn") > 0), F.lit("tool")).otherwise(F.col("role"))
    text = F.when(some & (F.col("role") == "assistant"), call).when(some & (F.col("role") == "user") & (F.col("turn") > 0), result).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))


SAY = {"say": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}}}}
