"""The command line: every answer is JSON on standard output."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame

from graphloom.api import Engine
from graphloom.config import macro_default
from graphloom.operators import graphview, lookup, recipes
from graphloom.session import session
from graphloom.sources import workspace
from graphloom.streaming.watch import poll


def window_of(a: argparse.Namespace) -> str:
    """Exact wins over wider windows; sound excludes all of them."""
    if a.sound and (a.exact_only or a.recall or a.include_dynamic):
        raise SystemExit("--sound goes with no other window")
    return "exact" if a.exact_only else "recall" if a.recall or a.include_dynamic else "default"


def plain(x):
    return [r.asDict() for r in x.collect()] if isinstance(x, DataFrame) else x


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("--index", default=".graphloom/index")
    p.add_argument("--root", action="append", dest="roots")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, **options):
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n.rstrip("?"), nargs="?" if n.endswith("?") else None)
        for k, v in options.items():
            flag = "--" + k.replace("_", "-")
            c.add_argument(flag, action="store_true") if v is False else c.add_argument(flag, type=type(v) if v is not None else str, default=v)
        return c

    windows = {"exact_only": False, "include_dynamic": False, "recall": False, "sound": False}
    command("index", "tree", root_id="", force=False)
    command("workspace-index", "manifest", force=False)
    command("workspace-status")
    command("stats")
    command("find", "name", limit=20, fuzzy=False)
    command("callers", "name", limit=50, with_macro=False, no_macro_dedup=False, include_implementors=False, implementors_only=False, **windows)
    command("impact", "name", depth=2, limit=100, with_macro=False, **windows)
    command("watch", "tree", root_id="", interval=2.0, rounds=0)
    command("enrich", limit=100)
    command("who-calls", "name", limit=50, noisy=False)
    command("blast-radius", "name", depth=3, limit=100, markdown=False)
    command("related", "name", limit=10)
    command("importers", "name", limit=50)
    command("subset")
    command("diff", limit=100, exact_only=False, baseline=None, promote=False)
    command("graph", "name", "out?", direction="impact", depth=2, sound=False)
    command("export", "kind", "out", project="project", window="default")
    command("macro-build", "tree", "side", "source")
    command("macro-status")
    command("bench-query", "name", runs=20)
    command("mcp")
    return p


def run(engine: Engine, a: argparse.Namespace):
    c = a.command
    macro = getattr(a, "with_macro", False) or (c in ("callers", "impact") and macro_default(".")[0] != "off" and bool(engine.index.meta().get("sidecar")))
    if c == "index":
        return engine.build(a.tree, a.root_id, a.force)
    if c == "workspace-index":
        import os

        with open(a.manifest, encoding="utf-8") as f:
            return engine.build_workspace(workspace.manifest(f.read(), os.path.dirname(os.path.abspath(a.manifest))), force=a.force)
    if c == "workspace-status":
        return engine.workspace_status()
    if c == "stats":
        return engine.stats()
    if c == "find":
        return plain(engine.find(a.name, a.limit, a.fuzzy))
    if c == "callers":
        if a.include_implementors and a.implementors_only:
            raise SystemExit("--include-implementors and --implementors-only exclude each other")
        w = window_of(a)
        if a.sound:
            return recipes.sound_report(engine.files, engine.refs, engine.violations, a.name, a.limit, engine.roots)
        if macro and not (a.include_implementors or a.implementors_only):
            return plain(engine.callers(a.name, window=w, limit=a.limit, macro=w != "exact", dedup=not a.no_macro_dedup))
        mode = "include_implementors" if a.include_implementors else "implementors_only" if a.implementors_only else "separate"
        return engine.callers_payload(a.name, w, a.limit, mode)
    if c == "impact":
        return plain(engine.impact(a.name, depth=a.depth, limit=a.limit, window=window_of(a), sound=a.sound, macro=macro and not a.sound).orderBy("rank"))
    if c == "watch":
        return {"built": poll(engine, a.tree, a.root_id, a.interval, a.rounds or None, lambda done: print(json.dumps(done), flush=True))}
    if c == "enrich":
        # No labeler is shipped: these are the symbols that one would be asked about.
        return plain(lookup.undescribed(engine.symbols, a.limit).select("root_id", "path", "qualified_name", "kind"))
    if c == "who-calls":
        return engine.who_calls(a.name, a.limit, a.noisy)
    if c == "blast-radius":
        got = engine.blast_radius(a.name, a.depth, a.limit)
        return recipes.markdown(got) if a.markdown else got
    if c == "related":
        return plain(engine.related(a.name, limit=a.limit).orderBy("rank"))
    if c == "importers":
        return plain(engine.importers(a.name, limit=a.limit).orderBy("rank"))
    if c == "subset":
        return engine.subset()
    if c == "diff":
        return engine.diff(a.limit, a.exact_only, a.baseline, a.promote)
    if c == "graph":
        got = engine.graph(a.name, a.direction, a.depth, a.sound)
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(graphview.page(got))
        return got
    if c == "export":
        engine.export(a.kind, a.out, a.project, window=a.window)
        return {"written": a.out}
    if c == "macro-build":
        return engine.build_side(a.tree, a.side, a.source)
    if c == "macro-status":
        return engine.side_status()
    if c == "bench-query":
        return bench(engine, a.name, a.runs)
    raise SystemExit(f"unknown command {c}")


def bench(engine: Engine, name: str, runs: int) -> dict:
    """Nearest-rank percentiles of callers and impact, in milliseconds."""
    out = {}
    for what, ask in (("callers", lambda: engine.callers(name, limit=20).collect()), ("impact", lambda: engine.impact(name, depth=2, limit=50).collect())):
        took = []
        for _ in range(max(1, runs)):
            start = time.perf_counter()
            ask()
            took.append((time.perf_counter() - start) * 1000)
        took.sort()
        at = lambda q: round(took[max(0, -(-len(took) * q // 100) - 1)], 3)
        out[what] = {"p50": at(50), "p95": at(95), "p99": at(99), "max": round(took[-1], 3)}
    return out


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, a.index)
    engine.roots = engine.root_ids(a.roots) if a.roots else None
    if a.command == "mcp":
        from graphloom.mcp import serve

        serve(engine, sys.stdin, sys.stdout)
        return 0
    try:
        got = run(engine, a)
    except (LookupError, ValueError) as err:
        print(json.dumps({"error": str(err)}))
        return 1
    print(got if isinstance(got, str) else json.dumps(got, ensure_ascii=False, default=str))
    return 2 if a.command == "subset" and not got["subset_ok"] else 0


if __name__ == "__main__":
    sys.exit(main())
