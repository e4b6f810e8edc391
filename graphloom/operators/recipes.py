"""Answers composed of several operators: who calls a name, and what a change to it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom import schema as s
from graphloom.functions import exprs as e
from graphloom.operators import gate, lookup, rank, traverse


def _gate(files: DataFrame, violations: DataFrame, roots: list[str] | None) -> dict:
    mine = lookup.in_root(violations, roots)
    clean = mine.isEmpty()
    languages = [r[0] for r in lookup.in_root(files, roots).select("language").distinct().collect() if r[0]]
    tier, text = e.promise(languages, clean)
    found = [r.asDict() for r in gate.sound_candidates(gate.buckets(files, violations)).collect()]
    root = roots[0] if roots and len(roots) == 1 else None
    return {"subset_ok": clean, "promise_tier": tier, "promise": text, "sound_candidates": found, **gate.guidance(clean, root, found)}


def budget(rows: list[dict], spark, most: int = rank.BUDGET) -> dict:
    """The files that an answer's nodes select."""
    if not rows:
        return rank.selection([], most)
    data = [("q", r["path"], 2.0 if r.get("confidence") == "exact" else 0.0, r.get("edge_role"), int(r.get("depth", 1)), r.get("root_id") or "") for r in rows]
    frame = spark.createDataFrame(data, "query string, path string, score double, edge_role string, depth int, root_id string")
    return rank.selection(rank.select_files(frame, ["query"], most).collect(), most)


def who_calls(files: DataFrame, refs: DataFrame, violations: DataFrame, name: str, limit: int = 50, noisy: bool = False, roots: list[str] | None = None) -> dict:
    payload = lookup.callers_payload(refs, name, limit=limit, mode="include_implementors" if noisy else "separate", roots=roots)
    calls, impl = (payload, []) if isinstance(payload, list) else (payload["callers"], payload["implementors"])
    for r in [*calls, *impl]:
        r["edge_role"] = "implementor" if r["rule_id"] in s.IMPLEMENTOR_RULES else "registration" if r["rule_id"] in s.REGISTRATION_RULES else "call"
    g = _gate(files, violations, roots)
    return {"symbol": name, "window": "default", "callers": calls, "implementors": impl, "high_freq_name": name.lower() in s.HIGH_FREQUENCY, **budget([*calls, *impl], refs.sparkSession), **{k: g[k] for k in ("subset_ok", "promise_tier", "promise", "recommendation")}}


def definition_home(symbols: DataFrame, name: str, nodes: list[dict]) -> str | None:
    """The file that defines a name, by how well its directory fits it; roots are not considered.

    Without a fitting one, the least file that the nodes resolve to."""
    best, score = None, 0
    for r in lookup.find_ranked(symbols, name, 20).collect():
        dirs = r["path"].split("/")[:-1]
        fit = 4 * (not any(d.lower() in e.HARD_DECOY_DIRS for d in dirs))
        fit += 6 * bool(dirs and len(dirs[-1]) >= 3 and dirs[-1].lower() in name.lower())
        fit -= 3 * any(f"/{d}/" in f"/{r['path']}" for d in ("api", "cli", "shared"))
        if fit > 0 and fit >= score:
            best, score = r["path"], fit
    if best is None:
        targets = sorted({n["resolved"] for n in nodes if n.get("resolved")})
        best = next((t for t in targets if not any(d in e.HARD_DECOY_DIRS for d in t.split("/"))), None)
    return best


def blast_radius(files: DataFrame, symbols: DataFrame, refs: DataFrame, violations: DataFrame, name: str, depth: int = 3, limit: int = 100, roots: list[str] | None = None) -> dict:
    """The impact walk in the widest window that the gate allows, with the definition's home and
    the files that the nodes import, and the budgeted files."""
    spark = refs.sparkSession
    g = _gate(files, violations, roots)
    walk = traverse.impact(refs, symbols, files, lookup.names(spark, name), depth, limit, roots=roots, sound=g["window"] == "sound")
    nodes = [{k: v for k, v in r.asDict().items() if k not in ("query", "rank")} | {"at": f"{r['path']}:{r['line']}"} for r in walk.orderBy("rank").collect()]
    paths = list(dict.fromkeys(n["path"] for n in nodes))
    home = definition_home(symbols, name, nodes)
    extra = []
    if home and home not in paths:
        extra.append({"path": home, "edge_role": "define", "depth": 0, "confidence": "exact"})
    if paths:
        hop = lookup.one_hop_imports(lookup.in_root(refs, roots), spark.createDataFrame([(p,) for p in paths], "query string"))
        seen = {*paths, home}
        for r in sorted(hop.collect(), key=lambda r: (paths.index(r["path"]), r["resolved"])):
            if r["resolved"] not in seen:
                seen.add(r["resolved"])
                extra.append({"path": r["resolved"], "edge_role": "import", "depth": 2, "confidence": "exact"})
    note = "Edges come from static reading; calls that only a running program makes may be missing."
    return {"symbol": name, "nodes": nodes, "definition": home, "related": [x["path"] for x in extra], **budget([*nodes, *extra], spark), **g, "note": note}


def sound_report(files: DataFrame, refs: DataFrame, violations: DataFrame, name: str, limit: int = 50, roots: list[str] | None = None) -> dict:
    """Callers over sound edges with the gate's state."""
    g = _gate(files, violations, roots)
    rows = lookup.callers_sound(refs, lookup.names(refs.sparkSession, name), limit, roots).orderBy("rank").collect()
    bad = [r.asDict() for r in lookup.in_root(violations, roots).orderBy("root_id", "path", "line", "kind").collect()]
    return {"mode": "sound", "subset_ok": g["subset_ok"], "promise_tier": g["promise_tier"], "promise": g["promise"], "subset_violations": bad, "callers": [{k: v for k, v in r.asDict().items() if k not in ("query", "rank")} for r in rows]}


def as_table(df: DataFrame) -> list[dict]:
    """All rows as plain data; it is an answer for people, so it is read on the driver."""
    return [r.asDict() for r in df.collect()]


def markdown(report: dict, most: int = 20) -> str:
    """A blast radius as a comment for a code review."""
    lines = [f"### Blast radius of `{report['symbol']}`", "", f"Window: **{report['window']}**; gate: {'clean' if report['subset_ok'] else 'not clean'}.", "", "| depth | site | in | role |", "|---|---|---|---|"]
    lines += [f"| {n['depth']} | `{n['at']}` | `{n['enclosing'] or '-'}` | {n['edge_role']} |" for n in report["nodes"][:most]]
    if len(report["nodes"]) > most:
        lines.append(f"\n… and {len(report['nodes']) - most} more.")
    lines += ["", "Files to read: " + (", ".join(f"`{p}`" for p in report["selected"]) or "none"), "", report["note"]]
    return "\n".join(lines)


