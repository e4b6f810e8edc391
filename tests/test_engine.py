"""The engine end to end on a small tree, its sources, exports, commands and streams."""

import io
import json

import pytest

from graphloom import cli, config
from graphloom.api import Engine
from graphloom.mcp import TOOLS, answer, serve
from graphloom.operators import export, graphview, recipes, sidecar
from graphloom.sources import walk, workspace
from graphloom.sources.ingest import relative
from graphloom.streaming import watch

TREE = {
    "src/a.py": "from .b import work\n\ndef start():\n    work()\n",
    "src/b.py": "def work():\n    return inner()\n\ndef inner():\n    return 1\n",
    "src/c.ts": "import { d } from './d';\nexport function run() { d(); bus.emit('go'); }\nbus.on('go', onGo);\n",
    "src/d.ts": "export function d() {}\nexport function onGo() {}\n",
    "src/lib.min.js": "x()",
    "node_modules/x.js": "x()",
    "secret/e.py": "def hidden(): pass\n",
    ".gitignore": "secret/\n",
    "README.md": "text",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in TREE.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path / "tree"


@pytest.fixture
def engine(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "index"))
    assert e.build(str(tree))["indexed"] == 4
    return e


def test_walk(spark, tree):
    got = {r.path: r.fate for r in walk.walk(spark, str(tree)).select("path", "fate").collect()}
    assert got == {"src/a.py": "source", "src/b.py": "source", "src/c.ts": "source", "src/d.ts": "source", "src/lib.min.js": "minified", "node_modules/x.js": "noise", "secret/e.py": "other", ".gitignore": "other", "README.md": "other"}


def test_questions(engine):
    assert [r.name for r in engine.find("work").collect()] == ["work"]
    assert [(r.path, r.enclosing) for r in engine.callers("work").where("kind = 'call'").collect()] == [("src/a.py", "start")]
    assert {r.enclosing for r in engine.impact("inner", depth=3).collect()} == {"work", "start", None}
    assert [r.path for r in engine.importers("src/b.py").collect()] == ["src/a.py"] and [r.path for r in engine.importers("src/d.ts").collect()] == ["src/c.ts"]
    assert engine.callers("onGo").where("rule_id = 'ts.event.dispatch'").count() == 1
    assert engine.related("work").orderBy("rank").first().path == "src/b.py"
    s = engine.stats()
    assert s["files"] == 4 and s["symbols"] == 6
    assert {v["kind"] for v in engine.subset()["violations"]} == {"parse_error"} and not engine.subset()["subset_ok"]
    blast = engine.blast_radius("inner")
    assert blast["window"] == "default" and "src/b.py" in blast["selected"] and "inner" in recipes.markdown(blast)
    assert engine.who_calls("work")["callers"][0]["path"] == "src/a.py"
    page = graphview.page(engine.graph("inner", "both"))
    assert "<svg" in page and "inner" in page
    with pytest.raises(LookupError):
        engine.find("nothing")


def test_incremental(engine, tree):
    assert engine.build(str(tree))["noop"]
    engine.enrich(lambda r: f"about {r['name']}", 10)
    assert engine.stats()["described"] == 6
    (tree / "src/b.py").write_text("def work():\n    return other()\n\ndef other():\n    return 1\n")
    (tree / "src/d.ts").unlink()
    done = engine.build(str(tree))
    assert (done["indexed"], done["deleted"]) == (1, 1)
    assert {r.name for r in engine.symbols.collect()} == {"start", "work", "other", "run"}
    assert {r.name: r.description for r in engine.symbols.collect()}["work"] == "about work"
    got = engine.diff()
    assert {r["name"] for r in got["added"]} == {"other"} and "inner" in {r["name"] for r in got["removed"]}
    engine.diff(promote=True)
    assert engine.diff()["summary"] == {"added": 0, "removed": 0}


def test_a_named_root_takes_over(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "index"))
    e.build(str(tree))
    e.build_workspace([{"id": "main", "path": str(tree)}])
    assert {r.root_id for r in e.files.collect()} == {"main"}
    assert e.workspace_status()[0]["files"] == 4
    with pytest.raises(LookupError):
        Engine(spark, str(tmp_path / "none")).stats()


def test_exports(engine, tmp_path):
    occ = export.occurrences(engine.symbols, engine.refs, engine.files)
    assert occ.where("roles = 1").count() == 6 and occ.where("roles = 0").count() >= 4
    docs = export.scip_documents(engine.symbols, engine.refs, engine.files).collect()
    assert len(docs) == 4 and all(bytes(r.message)[0] == 2 << 3 | 2 for r in docs)
    engine.export("lsif", str(tmp_path / "lsif"), root="/r")
    lines = [json.loads(x) for p in sorted((tmp_path / "lsif").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["id"] for x in lines] == list(range(1, len(lines) + 1)) and lines[0]["label"] == "metaData"
    engine.export("scip-json", str(tmp_path / "json"))
    # References have the columns that their words have in the sources.
    documents = [json.loads(x) for p in (tmp_path / "json").glob("part-*") for x in p.read_text().splitlines()]
    spans = [o["range"] for d in documents if d["relativePath"] == "src/b.py" for o in d["occurrences"] if not o["symbolRoles"]]
    assert spans == [[1, 11, 16]]
    with pytest.raises(ValueError):
        engine.export("other", str(tmp_path / "x"))


def test_columns_of_words(spark, engine):
    lines = spark.createDataFrame([("", "src/a.py", 4, "    😀 = work(); work2()")], "root_id string, path string, line int, text string")
    got = export.occurrences(engine.symbols, engine.refs, engine.files, lines=lines).where("roles = 0 AND path = 'src/a.py' AND line = 3").collect()
    assert [(r.col, r.end_col) for r in got] == [(9, 13)]


def test_side_dataset(spark, engine, tree, tmp_path):
    side = tmp_path / "expanded" / "src"
    side.mkdir(parents=True)
    (side / "a.py").write_text("def start():\n    work()\n    extra()\n")
    with pytest.raises(ValueError):
        engine.build_side(str(tree / "src"), str(tmp_path / "side"), str(tree))
    engine.build_side(str(tmp_path / "expanded"), str(tmp_path / "side"), str(tree))
    status = engine.side_status()
    assert not status["stale"] and status["dedup"]["merged_exact"] == 1
    assert [(r.path, r.origin) for r in engine.callers("extra", macro=True).collect()] == [("src/a.py", "macro_expanded")]


    assert {r.name for r in engine.impact("extra", macro=True).collect()} == {"extra"} and engine.impact("extra").count() == 0
    assert ("src/a.py", "src/a.py", False) in [tuple(x) for x in engine.index.meta()["path_map"]]
    # A sidecar that is older than the sources is not used.
    (tree / "src" / "b.py").write_text("def work():\n    return 2\n")
    engine.build(str(tree))
    assert engine.side_status()["stale"] and engine.callers("extra", macro=True).count() == 0


def test_path_maps_of_crates(spark):
    files = spark.createDataFrame([("crates/foo/src/lib.rs",), ("crates/foo/src/a/b.rs",), ("crates/bar/src/lib.rs",)], "path string")
    expanded = spark.createDataFrame([("expanded-view/foo/a/b.rs",), ("bar.rs",), ("none/x.rs",)], "path string")
    given = spark.createDataFrame([], "expanded string, source string, prefix boolean")
    got = {tuple(r) for r in sidecar.discovered(expanded, given, files).collect()}
    assert got == {("expanded-view/foo/a/b.rs", "crates/foo/src/a/b.rs", False), ("bar.rs", "crates/bar/src/lib.rs", False), ("foo/", "crates/foo/src/", True)}


def test_states_of_the_index(engine, tree):
    import os

    before = engine.index.meta()
    names = [f.getPath().getName() for f in engine.index._fs.listStatus(engine.index._p("")) if f.isFile()]
    assert 1 <= len([n for n in names if n.startswith("meta-")]) <= 2 and not [n for n in names if n.endswith(".tmp")]
    # A touched file is known again at once: its time is kept, nothing is read into the relations.
    os.utime(tree / "src" / "a.py", ns=(10**18, 10**18))
    assert engine.build(str(tree))["noop"]
    assert engine.files.where("path = 'src/a.py'").first().mtime_ns == 10**18
    assert engine.index.meta()["versions"]["refs"] == before["versions"]["refs"]
    (tree / "src" / "b.py").write_text("def work():\n    return 2\n")
    assert engine.build(str(tree))["indexed"] == 1 and engine.index.vacuum() > 0
    assert engine.stats()["files"] == 4 and engine.callers("work").count() == 2


def test_poll(engine, tree):
    assert watch.poll(engine, str(tree), every=0, rounds=2) == 1


def test_root_filters(engine, tmp_path):
    engine.index.save_meta(engine.index.meta() | {"workspace_roots": [{"id": "one", "path": str(tmp_path / "x")}]})
    assert engine.root_ids([str(tmp_path / "y" / ".." / "x"), "one", "/else/two"]) == ["one", "one", "two"]


def test_commands(engine):
    ask = lambda *a: cli.run(engine, cli.parser().parse_args(a))
    assert ask("callers", "work", "--exact-only")[0]["path"]
    assert ask("callers", "work", "--sound")["mode"] == "sound"
    assert ask("impact", "inner", "--depth", "1")[0]["enclosing"] == "work"
    assert set(ask("bench-query", "work", "--runs", "1")) == {"callers", "impact"}
    with pytest.raises(SystemExit):
        ask("callers", "work", "--sound", "--recall")
    with pytest.raises(SystemExit):
        ask("callers", "work", "--include-implementors", "--implementors-only")


def test_server(engine):
    lines = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "note"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "stats"}}, {"jsonrpc": "2.0", "id": 4, "method": "nope"}]
    out = io.StringIO()
    serve(engine, io.StringIO("\n".join(json.dumps(x) for x in lines) + "\nbroken\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in got] == [1, 2, 3, 4, None] and len(got[1]["result"]["tools"]) == len(TOOLS) == 16
    assert json.loads(got[2]["result"]["content"][0]["text"])["files"] == 4 and got[3]["error"]["code"] == -32601
    assert answer(engine, {"id": 5, "method": "tools/call", "params": {"name": "find_symbol", "arguments": {"name": "nothing"}}})["result"]["isError"]


def test_workspace_files(tmp_path):
    roots = workspace.manifest('{"roots": [{"id": "a b", "path": "x"}, "y", "z/y"]}', "/w")
    assert [(r["id"], r["path"]) for r in roots][:2] == [("a-b", "/w/x"), ("y", "/w/y")] and roots[2]["id"].startswith("y-")
    files = {"/w/x/package.json": '{"name": "@s/x", "exports": {".": {"types": "t.d.ts", "import": {"default": "./i.ts"}}, "./sub": "./s.ts", "./*": "n"}}', "/w/y/package.json": '{"name": "@s/x"}', "/w/x/tsconfig.json": '{"compilerOptions": {// note\n"paths": {"@k/*": ["./src/*"]}}}', "/w/x/src/index.ts": ""}
    with pytest.raises(ValueError):
        workspace.aliases(roots, read=files.get, exists=files.__contains__)
    got = workspace.aliases(roots, {"@s/x": "a-b"}, files.get, files.__contains__)
    assert got == [("@k/*", "a-b", "src/*", None, "tsconfig_paths"), ("@s/x", "a-b", None, "src/index.ts", "cli"), ("@s/x/sub", "a-b", "s.ts", None, "package.json_exports")]


def test_config(tmp_path):
    assert config.macro_default(str(tmp_path), {}) == ("off", "default")
    (tmp_path / "graphloom.toml").write_text('[macro]\ndefault = "if_fresh"\n')
    assert config.macro_default(str(tmp_path), {"GRAPHLOOM_MACRO_DEFAULT": "maybe"}) == ("if_fresh", "graphloom.toml")
    assert config.macro_default(str(tmp_path), {"GRAPHLOOM_MACRO_DEFAULT": "on"}) == ("on", "env")
    assert relative("/a/b", "/a/b/c.py") == "c.py" and relative("/a/b", "/x") is None


def test_watch(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    rows = [{"root_id": "", "path": p, "ts": f"2024-01-01T00:00:0{i}"} for i, p in enumerate(["a.py", "b.md", "node_modules/c.js", "d.ts", "a.py"])]
    (source / "1.json").write_text("\n".join(json.dumps(r) for r in rows))
    bursts = []
    q = watch.watch(spark, str(source), bursts.append, str(tmp_path / "check"), "100 milliseconds")
    q.processAllAvailable()
    q.stop()
    assert bursts == [["a.py", "d.ts"]]
    assert watch.scope_of([f"f{i}" for i in range(65)]) is None and watch.scope_of(["a"], directories=True) is None
    stream = spark.readStream.schema(watch.EVENTS).json(str(source))
    q = watch.debounced(stream, "2 seconds", "0 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").start()
    (source / "2.json").write_text(json.dumps({"root_id": "", "path": "z.py", "ts": "2024-01-01T01:00:00"}))
    q.processAllAvailable()
    q.stop()
    assert [sorted(r.paths) for r in spark.table("bursts").orderBy("started").collect()] == [["a.py"], ["a.py", "d.ts"]]
