"""Extraction from small sources written for these tests."""

import pytest

from graphloom import extract as x
from graphloom import schema as s
from graphloom.extract import go, python, rust, typescript
from graphloom.extract.lex import Lines, ParseError


def symbols(f):
    return {(r["qualified_name"], r["kind"]) for r in f.symbols}


def exact(f, kind="call"):
    return {(r["enclosing"], r["qualifier"], r["name"]) for r in f.refs if not r["rule_id"] and r["kind"] == kind}


def ruled(f, rule):
    return sorted((r["enclosing"], r["name"], r["module"]) for r in f.refs if r["rule_id"] == rule)


def kinds(f):
    return sorted({v["kind"] for v in f.violations})


def test_python():
    f = python.extract(
        "import os.path as p, json\nfrom ..core import Base, helper as h\n"
        "class Plug(Base):\n    def run(self, db=Depends(get_db)) -> Out:\n        self.go()\n        return getattr(self, 'stop')()\n"
        "@inject(Service)\ndef main(x):\n    Plug().run()\n    importlib.import_module('a.b')\n    entry_points(group='my.plugins')\n"
    )
    assert symbols(f) == {("Plug", "class"), ("Plug.run", "function"), ("main", "function")}
    assert ("Plug.run", None, "go") in exact(f) and ("main", None, "Plug") in exact(f)
    assert {(r["name"], r["module"]) for r in f.refs if r["kind"] == "import"} == {("p", "os.path"), ("json", "json"), ("Base", "..core"), ("helper", "..core")}
    assert ruled(f, "py.di.depends") == [("run", "get_db", None)] * 2
    assert ruled(f, "py.dynamic.getattr") == [("run", "stop", None)] and ruled(f, "py.di.inject") == [("main", "Service", None)]
    assert ruled(f, "py.dynamic.import_module") == [("main", "b", "a.b")] and ruled(f, "py.di.entry_points") == [("main", "my.plugins", "my.plugins")]
    assert next(r["return_type"] for r in f.symbols if r["name"] == "run") == "Out" and not f.violations


def test_python_violations_and_hooks():
    f = python.extract("import ctypes\ne = eval\neval('1')\n__import__(n)\nsetattr(a, 'b', 1)\ngetattr(a, n)\nimport_module(n)\nvars(a)['x']\nfrom builtins import exec\nclass A:\n    def __init_subclass__(cls): pass\nclass B(A): pass\nclass C:\n    def __getattr__(self, n): pass\n")
    assert kinds(f) == ["py___import__", "py_builtins", "py_ctypes", "py_dynamic_attr", "py_eval_alias", "py_eval_exec", "py_getattr_dynamic", "py_import_module_dynamic", "py_setattr", "py_vars_subscript"]
    assert ruled(f, "py.framework.init_subclass") == [(None, "B", None)]


def test_python_columns():
    f = python.extract("def e(): pass\nclass s(A, B): pass\nasync def d(): pass\nclass  \\\n  far: pass\n@x\ndef g(): pass\n")
    assert [(r["name"], r["start_col"]) for r in f.symbols] == [("e", 4), ("s", 6), ("d", 10), ("far", 2), ("g", 4)]


def test_bodies_are_never_skipped():
    assert kinds(typescript.extract("@Dec(eval('x')) class A {}")) == ["eval"]
    f = rust.extract("inventory::submit! { P::new(unsafe { g() }) }")
    assert kinds(f) == ["unsafe"] and ruled(f, "rs.di.inventory_submit")


@pytest.mark.parametrize(("text", "hit"), [("use inventory::submit; submit! { P::new() }", True), ("use inventory::{submit as put}; put!(P::new());", True), ("submit! { P::new() }", False), ("use evil::{inventory::submit}; submit! { P::new() }", False), ("crate::inventory::submit! { P::new() }", True), ("evil::inventory::submit! { P::new() }", False), ("use inventory as inv; inv::submit! { P::new() }", True), ("use inventory::submit as put; submit! { P::new() }", False)])
def test_inventory_names(text, hit):
    assert bool(ruled(rust.extract(text), "rs.di.inventory_submit")) is hit


def test_any_fault_is_a_parse_error():
    found = x.one_file("rust", b"#[distributed_slice(S)]static X: Tstatic X: T {use a::{b, c} c} ;")
    assert all(isinstance(r, dict) for _, r in found)
    assert x.one_file("cobol", b"x") == []


def test_typescript():
    f = typescript.extract(
        "import def, { A, B as C } from './m'; import * as ns from 'n'; export { A as Pub } from './m';\n"
        "// comment ' with a quote\nexport class Shop extends Base {\n  constructor(private readonly repo: Repo, n: string) {}\n  async buy(item: Item): Promise<void> { this.pay(); item.take(`x ${item.name}`); new Cart(); }\n}\n"
        "interface Face {}\ntype T = string;\nconst go = (s: Shop) => { s.buy(1); };\nfunction* gen() { yield go(); }\nconst r = /[/'\"]/g;\n"
        "app.get('/x', auth, handler); bus.on('ev', onEv); bus.emit('ev'); c.bind(Svc).to(Impl); c.register(Thing); table['run']();\n"
        "@Module({ providers: [P1, { provide: 'TOK', useClass: K }], imports: [Db.forRoot(), forwardRef(() => M2)] })\nexport class Mod { handle(@Inject(Q) q) { return q; } }\n"
    )
    assert {("Shop", "class"), ("Shop.constructor", "method"), ("Shop.buy", "method"), ("Face", "interface"), ("T", "type_alias"), ("go", "function"), ("gen", "function"), ("Pub", "module"), ("Mod", "class"), ("Mod.handle", "method")} == symbols(f)
    assert {(r["name"], r["module"]) for r in f.refs if r["kind"] == "import"} == {("def", "./m"), ("A", "./m"), ("B", "./m"), ("Pub", "./m")}
    assert {("Shop.buy", None, "pay"), ("Shop.buy", "Item", "take"), ("Shop.buy", None, "Cart"), ("go", "Shop", "buy"), ("gen", None, "go")} <= exact(f)
    assert ruled(f, "ts.nest.ctor_inject") == [("Shop", "Repo", None)]
    assert [n for _, n, _ in ruled(f, "ts.framework.register")] == ["auth", "handler"]
    assert ruled(f, "ts.event.subscribe") == [(None, "onEv", "ev")] and ruled(f, "ts.event.emit") == [(None, "emit", "ev")]
    assert [ruled(f, f"ts.di.{k}")[0][1] for k in ("bind", "to", "register")] == ["Svc", "Impl", "Thing"]
    assert ruled(f, "ts.dynamic.computed") == [(None, "run", None)]
    assert {n for _, n, _ in ruled(f, "ts.nest.module_providers")} >= {"P1", "K", "TOK"} and {n for _, n, _ in ruled(f, "ts.nest.module_imports")} >= {"Db", "M2"}
    assert [n for _, n, _ in ruled(f, "ts.di.decorator")] == ["Q"] and not f.violations


def test_typescript_violations():
    f = typescript.extract("eval('x'); new Function('a'); new Proxy(a, b); Reflect.get(a, b); require(n); import(n); with (a) {} o[k + 1](); o[`a${b}`](); const e = eval; bus.emit(name); bus.on('a', 5); A.prototype.m = f;", "javascript")
    assert kinds(f) == ["Function", "Proxy", "Reflect", "eval", "eval_alias", "import_dynamic", "monkey_patch", "nonliteral_computed_key", "nonliteral_event_key", "require_dynamic", "template_computed_key", "unmodeled_event_handler", "with"]


def test_go():
    f = go.extract(
        'package m\nimport (\n  "fmt"\n  s "ex.com/store"\n)\ntype Store interface {\n  Get(k string) string\n}\ntype Mem struct { n int }\nvar _ Store = (*Mem)(nil)\n'
        "func (m *Mem) Get(k string) string { return m.find(k) }\nfunc NewMem() *Mem { return &Mem{} }\n"
        'func main() {\n  x := NewMem()\n  x.Get("a")\n  fmt.Println(s.Open())\n  r.GET("/a", h.List)\n}\nvar table = map[string]http.HandlerFunc{ "a": doA, "b": api.DoB }\n',
    )
    assert symbols(f) == {("Store", "interface"), ("Mem", "struct"), ("Mem.Get", "method"), ("NewMem", "function"), ("main", "function")}
    assert {("Mem.Get", "Mem", "find"), ("main", "Mem", "Get"), ("main", None, "NewMem"), ("main", "fmt", "Println"), ("main", "s", "Open")} <= exact(f)
    assert exact(f, "import") == {(None, None, "fmt"), (None, None, "s")} and {(r["name"], r["module"]) for r in f.refs if r["kind"] == "define"} == {("x", "NewMem")}
    assert ruled(f, "go.di.interface_impl") == [("Mem", "Get", None)] and ruled(f, "go.di.interface_impl_v2") == [("Mem", "Get", "Store")]
    assert ruled(f, "go.di.interface_assert") == [("Mem", "Store", None)] and ruled(f, "go.di.route_register") == [(None, "List", None)]
    assert [n for _, n, _ in ruled(f, "go.di.handler_map")] == ["DoB", "doA"] and not f.violations
    assert kinds(go.extract('package m\nimport "unsafe"\n//go:linkname a b\nfunc f() { unsafe.Pointer(x) }\n')) == ["go_cgo_linkname", "go_unsafe"]


def test_rust():
    f = rust.extract(
        "use std::{fmt, io::{self, Read as R}};\nuse crate::a::*;\npub struct Cat<'a> { n: &'a str }\nenum E { A }\ntrait Pet { fn speak(&self); }\n"
        "impl Pet for Cat<'_> { fn speak(&self) { self.purr(); } }\nimpl<'a> Cat<'a> { fn purr(&self) {} fn make(n: Name) -> Cat<'a> { n.check(); Cat::purr(&n); Vec::<u8>::new() } }\n"
        "mod inner { pub fn go(p: &dyn Pet) { p.speak(); } }\ntype X = E;\n#[distributed_slice(ALL)]\nstatic C: Plugin = Plugin::new();\ninventory::submit! { Route::build(Cmd::new()) }\nother::inventory::submit!{ No }\nfn c() { let r = r#\"a \" b\"#; let ch = '\\''; }\n"
    )
    assert {("Cat", "struct"), ("E", "enum"), ("Pet", "trait"), ("Pet::speak", "method"), ("Cat::speak", "method"), ("Cat::purr", "method"), ("Cat::make", "method"), ("inner", "module"), ("inner::go", "function"), ("X", "type_alias"), ("c", "function")} == symbols(f)
    assert {("Cat::speak", "Cat", "purr"), ("Cat::make", "Name", "check"), ("Cat::make", "Cat", "purr"), ("Cat::make", "Vec", "new"), ("go", "Pet", "speak")} <= exact(f)
    assert {(r["name"], r["module"]) for r in f.refs if r["kind"] == "import"} == {("fmt", "std::fmt"), ("io", "std::io::self"), ("Read", "std::io::Read")}
    assert ruled(f, "rs.di.impl_trait") == [("Cat", "speak", "Pet")] and ruled(f, "rs.di.dyn_trait_method") == [("go", "speak", "Pet")]
    assert {n for _, n, _ in ruled(f, "rs.di.linkme_distributed_slice")} == {"ALL", "Plugin"} and {n for _, n, _ in ruled(f, "rs.di.inventory_submit")} == {"Route", "Cmd"}
    assert not f.violations
    assert kinds(rust.extract("unsafe fn a() { asm!(\"\"); std::mem::transmute(x); std::ptr::read(p); unsafe { b() } }")) == ["asm", "std_ptr", "transmute", "unsafe"]


@pytest.mark.parametrize(("read", "text"), [(typescript.extract, "function a( {"), (typescript.extract, "const a = 'x\n"), (go.extract, "func a() { `x"), (rust.extract, "/* /* */"), (python.extract, "def a(:")])
def test_broken_texts_fail_closed(read, text):
    with pytest.raises(ParseError):
        read(text)


def test_columns_are_utf16():
    lines = Lines("a\n😀é x")
    assert lines.line(5) == 2 and lines.column(5) == 4


def test_frames(spark):
    rows = [("r", "a.py", "python", b"def f():\n    g()\n"), ("r", "b.ts", "typescript", b"function h( {"), ("r", "c.go", "go", b"\xff\xfe"), ("r", "d.txt", "text", b"x"), ("r", "e.rs", "rust", None)]
    got = x.extract(spark.createDataFrame(rows, "root_id string, path string, language string, content binary"))
    assert [tuple(r) for r in got["symbols"].select("path", "name").collect()] == [("a.py", "f")]
    assert [r.name for r in got["refs"].collect()] == ["g"] and got["refs"].columns == s.REFS.names
    assert sorted((r.path, r.kind) for r in got["violations"].collect()) == [("b.ts", "parse_error"), ("c.go", "parse_error"), ("e.rs", "parse_error")]
