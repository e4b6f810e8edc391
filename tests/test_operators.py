"""Operators against plain Python on small graphs."""

from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom import schema as s
from graphloom.functions import exprs as e
from graphloom.operators import diff, gate, link, lookup, metrics, rank, sidecar, traverse

QUICK = {"deadline": None, "suppress_health_check": [HealthCheck.function_scoped_fixture]}


def ref(name, enclosing=None, path="a.ts", line=1, root="", confidence="exact", rule=None, kind="call", qualifier=None, module=None, resolved=None):
    return (root, name, kind, path, line, enclosing, module, resolved, qualifier, confidence, f"{qualifier}.{name}" if qualifier else None, rule, None)


def symbol(name, path="a.ts", root="", kind="function", qualified=None, line=1, parent=None, returns=None, description=None):
    return (root, path, name, qualified or name, kind, line, line + 1, parent, description, 0, 1, returns)


def file(path, language="typescript", root=""):
    return (root, path, "h", language, 1, 1)


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def order(r):
    none = lambda x: (x is not None, x or "")
    return (r[0], r[3], r[4], r[1], r[2], r[9], none(r[11]), none(r[5]))


def walk(refs, symbols, files, start, depth, limit):
    """The first-in first-out walk, one name at a time."""
    bare, dotted = e.split_name(start)
    languages = {}
    for f in files:
        languages.setdefault(f[1], set()).add(f[3])
    named = {}
    for x in symbols:
        named.setdefault(x[2], set()).update(languages.get(x[1], set()))
    seen, places, out, todo = {start}, set(), [], deque([(start, 0)])
    while todo:
        name, d = todo.popleft()
        if d >= depth or len(out) >= limit:
            continue
        hit = [r for r in refs if (r[1] == bare if name == start and not dotted else (r[10] == dotted or r[1] == dotted) if name == start else r[1] == name)]
        for r in sorted(hit, key=order):
            if len(out) >= limit:
                break
            place = (r[0], r[1], r[4], r[3])
            if place in places:
                continue
            places.add(place)
            out.append((d + 1, r[1], r[3], r[4], r[5]))
            leaf = (r[5] or "").replace(":", ".").split(".")[-1]
            if leaf and leaf not in seen:
                seen.add(leaf)
                spoken = min(languages[r[3]]) if r[3] in languages else None
                if leaf in named and (spoken is None or spoken in named[leaf]):
                    todo.append((leaf, d + 1))
    return out


names = st.sampled_from(["a", "b", "c", "d", "e"])
enclosings = st.one_of(st.none(), st.just(""), names, st.builds("T.{}".format, names), st.builds("m::{}".format, names))
paths = st.sampled_from(["a.ts", "b.ts", "c.py", "x.md"])
refs_ = st.builds(ref, names, enclosings, paths, st.integers(1, 3), st.sampled_from(["", "r"]), qualifier=st.sampled_from([None, "T"]))
symbols_ = st.builds(symbol, names, paths)


@settings(max_examples=12, **QUICK)
@given(st.lists(refs_, max_size=14), st.lists(symbols_, max_size=6), st.integers(1, 4), st.sampled_from([1, 3, 100]))
def test_impact_is_the_queue_walk(spark, refs, symbols, depth, limit):
    files = [file("a.ts"), file("b.ts"), file("c.py", "python"), file("b.ts", "typescript", "r")]
    starts = ["a", "b", "T.a"]
    got = traverse.impact(frame(spark, refs, s.REFS), frame(spark, symbols, s.SYMBOLS), frame(spark, files, s.FILES), lookup.names(spark, *starts), depth, limit).collect()
    for start in starts:
        mine = [(r.depth, r.name, r.path, r.line, r.enclosing) for r in sorted((r for r in got if r.query == start), key=lambda r: r["rank"])]
        assert mine == walk(refs, symbols, files, start, depth, limit)


def test_walk_shuffles_no_wide_row_by_place(spark, monkeypatch):
    # Bare queries can not meet a place twice: a level is one shuffle by query, and only steps and inner levels are written.
    plans, keep = [], traverse.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(traverse, "written", lambda df, name: plans.append((name, plan(df))) or keep(df, name))
    rows = [ref("a", "b"), ref("b", "c", line=2), ref("c", "d", line=3)]
    got = traverse.impact(frame(spark, rows, s.REFS), frame(spark, [symbol("b"), symbol("c")], s.SYMBOLS), frame(spark, [file("a.ts")], s.FILES), lookup.names(spark, "a"), 3)
    assert [(r.depth, r.name, r["rank"]) for r in got.orderBy("rank").collect()] == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    assert [n for n, _ in plans] == ["steps", "hits"]
    assert not any("hashpartitioning(query" in x and "root_id" in x.split("hashpartitioning(query")[1].split(")")[0] for x in [*[p for _, p in plans], plan(got)])


def test_common_names_are_walked_like_others(spark, monkeypatch):
    rows = [ref("a", f"b{i % 4}", f"p{i:02}.ts", i % 3) for i in range(30)] + [ref(f"b{i}", "c", line=i) for i in range(4)] + [ref("c", "d")] * 3
    frames = [frame(spark, rows, s.REFS), frame(spark, [symbol(f"b{i}") for i in range(4)], s.SYMBOLS), frame(spark, [file("a.ts")], s.FILES), lookup.names(spark, "a", "c")]
    answers = []
    for common in (2, 100_000):
        monkeypatch.setattr(lookup, "COMMON", common)
        answers.append((sorted(map(repr, traverse.impact(*frames, 3, 12).collect())), sorted(map(repr, lookup.callers(frames[0], frames[3], limit=7).collect()))))
    assert answers[0] == answers[1] and len(answers[0][1]) == 10


def test_callers_shuffle_refs_once(spark):
    refs = frame(spark, [ref("a", "x", line=i) for i in range(9)] + [ref("b", qualifier="T")], s.REFS)
    got = lookup.callers(refs, lookup.names(spark, "a", "zip"), limit=4)
    assert sorted((r.line, r["rank"]) for r in got.collect()) == [(i, i + 1) for i in range(4)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(name" in plan and "windowspecdefinition(query" not in plan and plan.count("Join Inner") == 2
    assert [r["query"] for r in lookup.callers(refs, lookup.names(spark, "T.b", "zip")).collect()] == ["T.b"]


def test_imports_of_a_file_are_cut_before_its_names_meet_them(spark, monkeypatch):
    sizes, keep = [], rank.top
    monkeypatch.setattr(rank, "top", lambda rows, *a: sizes.append(rows.count()) or keep(rows, *a))
    symbols = frame(spark, [symbol(f"n{i}", "m.ts", line=i) for i in range(40)], s.SYMBOLS)
    refs = frame(spark, [ref("m", path=f"p{i % 5}.ts", line=i, kind="import", resolved="m.ts") for i in range(60)], s.REFS)
    got = rank.related_files(symbols, refs, symbols.selectExpr("name AS query"), 3).collect()
    # 30 of the 60 rows count: 12 of p0, 12 of p1 and 6 of p2.
    assert {(r.path, r.score) for r in got} == {("p0.ts", 36), ("p1.ts", 36), ("p2.ts", 18)} and len(got) == 120
    assert max(sizes) < 40 * 30


def test_gate_closes_a_leaf_for_good(spark):
    refs = [ref("c", "b", "a.py", 1), ref("c", "b", "z.ts", 2), ref("b", "a", "z.ts", 3)]
    files = [file("a.py", "python"), file("z.ts")]
    got = traverse.impact(frame(spark, refs, s.REFS), frame(spark, [symbol("b", "z.ts")], s.SYMBOLS), frame(spark, files, s.FILES), lookup.names(spark, "c"), 3)
    assert sorted((r.depth, r.name) for r in got.collect()) == [(1, "c"), (1, "c")]


def test_implementors_do_not_starve_callers(spark):
    flood = [ref("fmt", f"T{i}", f"p{i:02}.rs", 1, confidence="heuristic", rule="rs.di.impl_trait") for i in range(30)]
    refs = frame(spark, flood + [ref("fmt", "main", "z.rs", 9)], s.REFS)
    got = lookup.callers_payload(refs, "fmt", limit=25)
    assert len(got["callers"]) == 1 and len(got["implementors"]) == 20 and got["implementor_count"] == 30 and got["implementors_truncated"]
    assert lookup.callers_payload(refs, "fmt", limit=25, mode="include_implementors")[0]["name"] == "fmt"
    assert lookup.callers_payload(refs, "none") == []


def test_fuzzy_find_takes_no_wildcards(spark):
    rows = [symbol("a%b"), symbol("aXb"), symbol("A_B"), symbol("É")]
    got = lambda t: {r.name for r in lookup.find_fuzzy(frame(spark, rows, s.SYMBOLS), t).collect()}
    assert got("%") == {"a%b"} and got("a_b") == {"A_B"} and got("é") == set() and got("AXB") == {"aXb"}
    with pytest.raises(LookupError):
        lookup.find(frame(spark, rows, s.SYMBOLS), "nothing")


def test_diff_is_a_bag(spark):
    kind = s.EDGES
    old = frame(spark, [("f", "a", 1, "exact", None, "r1"), ("g", "a", 2, "heuristic", "x", "")], kind)
    new = frame(spark, [("f", "a", 1, "exact", "", "r2"), ("h", "a", 3, "exact", None, ""), ("h", "a", 3, "exact", None, "")], kind)
    assert diff.added(old, new).count() == 2 and diff.removed(old, new).count() == 1
    assert diff.summary(old, new).first().asDict() == {"added": 2, "removed": 1, "old_edges": 2, "new_edges": 3}
    assert diff.report(old, new, limit=1)["summary"] == {"added": 2, "removed": 1}
    assert diff.choose_baseline(new, new, old) is old and diff.choose_baseline(old, new, old) is new


def test_linking_tiers(spark):
    symbols = frame(spark, [symbol("m", "a.ts", "r", qualified="T.m"), symbol("m", "b.ts", "q", qualified="U::m"), symbol("n", "a.ts", "q"), symbol("n", "b.ts", "r")], s.SYMBOLS)
    rows = [ref("m", root="q", qualifier="T"), ref("m", root="r", qualifier="U"), ref("m", root="q", qualifier="Z"), ref("n", root="r", path="c.ts"), ref("n", root="zz"), ref("zip")]
    got = [(r.symbol_name, r.symbol_path) for r in link.link_symbols(frame(spark, rows, s.REFS), symbols).orderBy("name", "root_id", "qualifier").collect()]
    assert got == [("T.m", "a.ts"), ("U::m", "b.ts"), ("U::m", "b.ts"), ("n", "b.ts"), ("n", "a.ts"), (None, None)]


def test_linking_joins_refs_once_a_key(spark):
    symbols = frame(spark, [symbol("m", "a.ts", "r", qualified="a.T.m"), symbol("n", "b.ts", "q", qualified="U::V.n"), symbol("z", "c.ts", qualified="..z")], s.SYMBOLS)
    rows = [ref("m", qualifier="a.T"), ref("T.m", qualifier="a"), ref("V.n", qualifier="U"), ref("n", qualifier="U::V"), ref("z", qualifier="."), ref(".z", qualifier="."), ref("none", qualifier="T"), ref("n", qualifier="")]
    got = link.link_symbols(frame(spark, rows, s.REFS), symbols)
    assert {(r.qualifier, r.name): r.symbol_name for r in got.collect()} == {("a.T", "m"): "a.T.m", ("a", "T.m"): "a.T.m", ("U", "V.n"): "U::V.n", ("U::V", "n"): "U::V.n", (".", "z"): "..z", (".", ".z"): None, ("T", "none"): None, ("", "n"): "U::V.n"}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_qualifiers_need_one_factory_of_the_directory(spark):
    symbols = [symbol("make", "d/a.go", returns="T"), symbol("two", "d/a.go", returns="T"), symbol("two", "d/b.go", returns="T"), symbol("far", "e/a.go", returns="T"), symbol("S", "d/a.go", kind="struct")]
    refs = [ref(v, path="d/m.go", kind="define", module=m) for v, m in (("x", "make"), ("y", "two"), ("z", "far"), ("S", "make"))]
    refs += [ref("go", path="d/m.go", qualifier=v) for v in ("x", "y", "z", "S")]
    got = {r.pre_qual or r.qualifier: r.qualifier for r in link.upgrade_qualifiers(frame(spark, refs, s.REFS), frame(spark, symbols, s.SYMBOLS)).where("kind = 'call'").collect()}
    assert got == {"x": "T", "y": "y", "z": "z", "S": "S"}


def test_dispatch_is_emits_times_distinct_handlers(spark):
    emit = ref("emit", "f", line=3, confidence="dynamic_candidate", rule="ts.event.emit", module="ev")
    on = [ref(h, line=i, confidence="heuristic", rule="ts.event.subscribe", module=m) for i, (h, m) in enumerate([("h", "ev"), ("h", "ev"), ("k", "ev"), ("z", "other")])]
    once = link.with_dispatch(frame(spark, [emit, emit, *on], s.REFS))
    again = link.with_dispatch(once)
    rows = [r.name for r in again.where("rule_id = 'ts.event.dispatch'").collect()]
    assert sorted(rows) == ["h", "h", "k", "k"]


def test_package_keys(spark):
    aliases = frame(spark, [("@a/p", "r1", "i.ts", None, "j"), ("@a/p/sub", "r1", "s.ts", None, "j"), ("@b/*", "r2", None, "src/*.ts", "t")], s.ALIASES)
    aliases = aliases.union(frame(spark, [("@/*", "r3", "src/*", None, "t"), ("@/deep/*", "r3", "lib/*", None, "t")], s.ALIASES))
    files = frame(spark, [file("src/util.ts", root="r2"), file("src/$lib/x.tsx", root="r3"), file("lib/y/index.js", root="r3"), file("src/z", root="r2")], s.FILES)
    rows = [ref("x", kind="import", module=m) for m in ("@a/p", "@a/p/other", "@a/p/sub/deep", "@b/util", "@A/P", "lodash", "@/$lib/x", "@/deep/y", "@/nothere", "@/z", "./@/z")]
    got = {r.module: r.resolved for r in link.link_packages(frame(spark, rows, s.REFS), aliases, files).collect()}
    assert got == {"@a/p": "i.ts", "@a/p/other": "i.ts", "@a/p/sub/deep": "s.ts", "@b/util": "src/util.ts", "@A/P": "i.ts", "lodash": None, "@/$lib/x": "src/$lib/x.tsx", "@/deep/y": "lib/y/index.js", "@/nothere": None, "@/z": None, "./@/z": None}
    # Any alias that a specifier lies behind makes it one of the workspace.
    marked = {r.module: r.external_dependency for r in lookup.external_dependency(frame(spark, rows, s.REFS), aliases).collect()}
    assert marked == {m: m in ("@A/P", "lodash") for m in got}


def test_rows_without_a_module_do_not_meet_in_one_task(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        aliases = frame(spark, [("pkg", "r1", None, "b.ts", "j")], s.ALIASES)
        refs = frame(spark, [ref(f"n{i}") for i in range(40)] + [ref("x", kind="import", module="pkg/a"), ref("y", kind="call", module="pkg", resolved="own.ts")], s.REFS).repartition(4)
        for got in (link.link_packages(refs, aliases, frame(spark, [], s.FILES)), lookup.external_dependency(refs, aliases)):
            assert got.count() == 42 and got.where("module IS NULL").selectExpr("spark_partition_id() AS p").distinct().count() == 4
        assert {r.name: r.resolved for r in link.link_packages(refs, aliases, frame(spark, [], s.FILES)).where("module IS NOT NULL").collect()} == {"x": "b.ts", "y": "own.ts"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_importers_of_deep_paths(spark):
    aliases = frame(spark, [("pkg", "r1", None, "b.ts", "j")], s.ALIASES)
    rows = [ref("x", line=i, kind="import", module=m, resolved=t) for i, (m, t) in enumerate([("pkg/a/b/c", None), ("pkg/a", None), ("pkg/ab", None), ("./q", "b.ts")])]
    got = lookup.importers_of_package(frame(spark, rows, s.REFS), lookup.names(spark, "pkg/a", "pkg"), aliases).collect()
    assert {(r.query, r.module) for r in got} == {("pkg/a", "pkg/a/b/c"), ("pkg/a", "pkg/a"), ("pkg/a", "./q"), ("pkg", "pkg/a/b/c"), ("pkg", "pkg/a"), ("pkg", "pkg/ab"), ("pkg", "./q")}


def test_ids_tell_nulls_apart(spark):
    one = [ref("n", "X", qualifier=None), ref("n", None, qualifier="X")]
    assert link.with_id(frame(spark, one, s.REFS)).select("ref_id").distinct().count() == 2


def test_import_resolution(spark):
    files = frame(spark, [file(p) for p in ("s/b.ts", "s/b/index.ts", "s/c/index.js", "p/__init__.py", "p/q/m.py", "g/x/y/k.go", "v/ex.com/x/y/k.go", "v/w/ex.com/x/y/a.go", "k/src/lib.rs", "k/src/a/mod.rs", "k/src/a/b.rs", "k/src/c.rs")], s.FILES)
    ts = [ref("b", kind="import", path="s/a.ts", module=m) for m in ("./b", "./c", "../s/b.ts", "./none", "react")]
    got = {r.module: r.resolved for r in link.resolve_imports(frame(spark, ts, s.REFS), files, link.ts_candidates()).collect()}
    assert got == {"./b": "s/b.ts", "./c": "s/c/index.js", "../s/b.ts": "s/b.ts", "./none": None, "react": None}
    py = [ref("m", kind="import", path="p/q/n.py", module=m) for m in (".m", "..", "p.q.m", "os")]
    got = {r.module: r.resolved for r in link.resolve_imports(frame(spark, py, s.REFS), files, link.py_candidates()).collect()}
    assert got == {".m": "p/q/m.py", "..": "p/__init__.py", "p.q.m": "p/q/m.py", "os": None}
    go = [ref("k", kind="import", path="g/m.go", module=m) for m in ("ex.com/x/y", "fmt", "other.org/z/x/y")]
    assert {r.module: r.resolved for r in link.go_resolve(frame(spark, go, s.REFS), files).collect()} == {"ex.com/x/y": "v/ex.com/x/y/k.go", "fmt": None, "other.org/z/x/y": None}


def test_rust_paths(spark):
    files = frame(spark, [file(p) for p in ("k/src/lib.rs", "k/src/a/mod.rs", "k/src/a/b.rs", "k/src/c.rs")], s.FILES)
    rows = [ref(str(i), kind="import", path=p, module=m) for i, (p, m) in enumerate([("k/src/c.rs", "crate::a::b::Thing"), ("k/src/a/b.rs", "super::helper"), ("k/src/a/b.rs", "super::super::c"), ("k/src/a/mod.rs", "self::b"), ("k/src/c.rs", "std::fmt"), ("k/src/c.rs", "crate::Top")])]
    got = {r.name: r.resolved for r in link.resolve_imports(frame(spark, rows, s.REFS), files, link.rs_candidates()).collect()}
    assert got == {"0": "k/src/a/b.rs", "1": "k/src/a/mod.rs", "2": "k/src/c.rs", "3": "k/src/a/b.rs", "4": None, "5": "k/src/lib.rs"}


def test_budget(spark):
    rows = [("q", p, 0.0, "call", d, r) for p, d, r in [("legacy/a.ts", 0, ""), ("s/a.ts", 1, ""), ("s/b.ts", 1, ""), ("s/c.ts", 1, ""), ("t/a.ts", 2, ""), ("@alias:x", 0, ""), ("u/d.ts", 1, ""), ("v/e.ts", 1, ""), ("w/f.ts", 1, ""), ("x/g.ts", 1, "mock")]]
    got = {r.path: r.why for r in rank.select_files(spark.createDataFrame(rows, "query string, path string, score double, edge_role string, depth int, root_id string"), ["query"]).collect()}
    assert got == {"legacy/a.ts": "decoy_dir", "s/a.ts": "selected", "s/b.ts": "selected", "s/c.ts": "dir_full", "t/a.ts": "same_basename", "@alias:x": "not_a_file", "u/d.ts": "selected", "v/e.ts": "selected", "w/f.ts": "budget", "x/g.ts": "decoy_dir"}


def test_buckets_keep_clean_parts(spark):
    files = frame(spark, [file("a/x.ts"), file("b/y.ts", root="r"), file("z.ts", root="r")], s.FILES)
    bad = frame(spark, [("r", "b/y.ts", k, 1, "") for k in ("eval", "with", "with")], s.VIOLATIONS)
    got = {r.bucket: (r.violations, r.top_kinds, r.eligible) for r in gate.buckets(files, bad).collect()}
    assert got == {"default": (0, "", True), "r": (3, "with,eval", False)}
    assert {r.bucket for r in gate.buckets(files, bad, "dir").collect()} == {"a", "b", "(root)"}
    assert gate.window_for(False) == "default" and not gate.subset_ok(bad) and gate.subset_ok(bad, "")


def test_side_paths_and_union(spark):
    side = spark.createDataFrame([("f", "e", "x/expanded/src/a.rs"), ("g", None, "m/lib.rs"), ("h", None, "far/z.rs")], "name string, enclosing string, path string")
    pairs = spark.createDataFrame([("x/expanded", "x", True), ("m/lib.rs", "m/src/lib.rs", False)], "expanded string, source string, prefix boolean")
    mapped = sidecar.mapped_path(side, pairs, frame(spark, [file("q.rs")], s.FILES))
    assert {r.name: r.mapped for r in mapped.collect()} == {"f": "x/src/a.rs", "g": "m/src/lib.rs", "h": None}
    main = spark.createDataFrame([("f", "e", "x/src/a.rs", "exact"), ("g", "", "m/src/lib.rs", "heuristic")], "name string, enclosing string, path string, confidence string")
    assert sidecar.dedup_stats(main, mapped).first().asDict() == {"merged_exact": 1, "merged_heuristic": 1, "kept": 0, "unmapped": 1}
    assert [r.name for r in sidecar.union(main, mapped).where("origin = 'macro_expanded'").collect()] == ["h"]


@settings(max_examples=5, **QUICK)
@given(st.lists(st.tuples(names, names), min_size=1, max_size=10), st.sets(names, min_size=1))
def test_closure(spark, edges, defined):
    got = {(r.a, r.b) for r in traverse.closure(spark.createDataFrame(edges, "caller string, callee string"), spark.createDataFrame([(d,) for d in defined], "name string")).collect()}
    want = {(a, b) for a, b in edges if a in defined and b in defined}
    while True:
        more = want | {(a, d) for a, b in want for c, d in want if b == c}
        if more == want:
            break
        want = more
    assert got == want


def test_closure_stops_when_no_pair_goes_on(spark, monkeypatch):
    rounds, keep = [], traverse.written
    monkeypatch.setattr(traverse, "written", lambda df, name: rounds.append(df) or keep(df, name))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("x", None), ("q", "c")], "caller string, callee string")
    got = traverse.closure(edges, spark.createDataFrame([(n,) for n in "aabcx"], "name string"))
    assert sorted(map(tuple, got.collect())) == [("a", "b"), ("a", "c"), ("b", "c"), ("x", "c")] and len(rounds) == 2


def test_exports_join_names_defined_once_by_one_join(spark):
    rows, once = frame(spark, [ref("m", qualifier="T"), ref("n"), ref("zip")], s.REFS), [symbol("n", "b.ts", qualified="U.n", line=4)]
    got = link.unique_definition(rows, frame(spark, [*once, symbol("m", "a.ts", qualified="T.m")], s.SYMBOLS))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert {(r.name, r.symbol_path, r.symbol_name, r.symbol_line) for r in got.collect()} == {("m", "a.ts", "T.m", 1), ("n", "b.ts", "U.n", 4)}
    got = link.unique_definition(rows, frame(spark, [*once, symbol("m", "a.ts", qualified="T.m"), symbol("m", "a.ts", qualified="V.m")], s.SYMBOLS))
    assert {(r.name, r.symbol_path, r.symbol_name, r.symbol_line) for r in got.collect()} == {("m", "a.ts", "T.m", 1), ("n", "b.ts", "U.n", 4)}


def test_expressions(spark):
    row = spark.createDataFrame([("A.b::c", "src/x/../y/./z.test.ts", "@s/p/q", ".\\a//b")], "n string, p string, m string, i string").select(
        e.last_segment("n").alias("a"), e.repo_path("p").alias("b"), e.package_of("m").alias("c"), e.import_path("i").alias("d"), e.base_stem("p").alias("f"), e.language("p").alias("g"), e.path_penalty("p").alias("h"), e.top_dir("p").alias("i"), e.directory("p").alias("j"), e.percent_encoded("m").alias("k")
    ).first()
    assert tuple(row) == ("c", "src/y/z.test.ts", "@s/p", "a/b", "z.test", "typescript", 0.0, "src", "src/x/../y/.", "%40s/p/q")
    assert e.split_name("a.b.c") == ("a.b.c", "") and e.split_name("A::b") == ("b", "A.b") and e.split_name("T.m") == ("m", "T.m")


def test_metrics(spark):
    tasks = spark.createDataFrame([(1, ["a", "b", "z"], ["a", "c"])], "task int, found array<string>, expected array<string>")
    r = metrics.file_set_scores(tasks, 2).first()
    assert (r.recall, r.extra_noise, r.precision_at_k) == (0.5, 2, 0.5)
    p = metrics.percentiles(spark.createDataFrame([("q", float(i)) for i in range(1, 101)], "k string, v double"), "k", "v").first()
    assert (p.p50, p.p95, p.p99, p.max) == (50.0, 95.0, 99.0, 100.0)
