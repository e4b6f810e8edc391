"""Queries over sources and imports that are made from the documents by a template.

Each document gives one file, so that extraction and import resolution run on as many files as
there are documents, and SQL can say which rows they have to give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import extract as extraction
from graphloom import schema as s
from graphloom.operators import link, lookup
from graphloom.plans.catalog import query
from graphloom.plans.views import Frames

#: One file a language: ``{i}`` is the document's number, ``{k}`` the number modulo 97.
TEMPLATES = {
    "python": "import lib{k}\nclass C{i}(Base):\n    def run(self, db=Depends(get{k})):\n        return helper{k}()\ndef main{i}():\n    getattr(self, 'stop{k}')()\n    eval('x')\n",
    "typescript": "import { lib{k} } from './m{k}';\nexport class S{i} {\n  constructor(private r: Repo{k}) {}\n  buy() { this.pay(); helper{k}(); }\n}\nbus.on('ev{k}', on{k});\nbus.emit('ev{k}');\nc.bind(Svc{k});\n@Dec(eval('x')) class D {}\n",
    "go": 'package m\ntype Store{k} interface {\n  Get(k string) string\n}\ntype Mem{i} struct { n int }\nvar _ Store{k} = (*Mem{i})(nil)\nfunc (m *Mem{i}) Get(k string) string { return helper{k}(k) }\nfunc main() {\n  r.GET("/a", h.List{k})\n}\n//go:linkname a b\n',
    "rust": "trait Pet{k} { fn speak(&self); }\nstruct Cat{i};\nimpl Pet{k} for Cat{i} { fn speak(&self) { helper{k}(); } }\nfn go(p: &dyn Pet{k}) { p.speak(); }\nuse inventory::submit;\nsubmit! { Route{k}::build(Cmd::new(unsafe { b() })) }\n",
}
LANGUAGES = tuple(TEMPLATES)


def sources(f: Frames) -> DataFrame:
    """root_id, path, language, content: a file for each document."""
    i, k = F.col("doc_id").cast("string"), (F.col("doc_id") % 97).cast("string")
    language = F.get(F.array(*map(F.lit, LANGUAGES)), (F.col("doc_id") % 4).cast("int"))

    def text(name: str) -> Column:
        return F.replace(F.replace(F.lit(TEMPLATES[name]), F.lit("{i}"), i), F.lit("{k}"), k)

    body = F.when(language == LANGUAGES[0], text(LANGUAGES[0]))
    for name in LANGUAGES[1:]:
        body = body.when(language == name, text(name))
    return f["documents"].select(F.col("source").alias("root_id"), F.concat(F.lit("d"), i).alias("path"), language.alias("language"), F.encode(body, "UTF-8").alias("content"))


def expected(columns: str, rows: list[tuple]) -> str:
    """SQL for a row of each file's own language, ``{i}`` and ``{k}`` filled in."""
    names = columns.split()
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join([str(LANGUAGES.index(r[0])), *map(lit, r[1:])]) + ")" for r in rows)
    texts = {n for at, n in enumerate(names, 1) if any(isinstance(r[at], str) for r in rows)}
    fill = lambda n: f"replace(replace(t.{n}, '{{i}}', CAST(doc_id AS STRING)), '{{k}}', CAST(doc_id % 97 AS STRING)) AS {n}" if n in texts else f"CAST(t.{n} AS INT) AS {n}"
    return f"SELECT source AS root_id, 'd' || CAST(doc_id AS STRING) AS path, {', '.join(map(fill, names))} FROM documents JOIN (VALUES {values}) t(lang_no, {', '.join(names)}) ON t.lang_no = doc_id % 4"


P, T, G, R = LANGUAGES
H, D = "heuristic", "dynamic_candidate"

RULES = [
    (P, "get{k}", 3, "run", None, H, "py.di.depends"), (P, "get{k}", 3, "run", None, H, "py.di.depends"), (P, "stop{k}", 6, "main{i}", None, D, "py.dynamic.getattr"),
    (T, "Repo{k}", 3, "S{i}", None, H, "ts.nest.ctor_inject"), (T, "on{k}", 6, None, "ev{k}", H, "ts.event.subscribe"), (T, "emit", 7, None, "ev{k}", D, "ts.event.emit"), (T, "Svc{k}", 8, None, None, H, "ts.di.bind"),
    (G, "Store{k}", 6, "Mem{i}", None, H, "go.di.interface_assert"), (G, "Get", 7, "Mem{i}", None, H, "go.di.interface_impl"), (G, "Get", 7, "Mem{i}", "Store{k}", H, "go.di.interface_impl_v2"), (G, "List{k}", 9, None, None, H, "go.di.route_register"),
    (R, "speak", 3, "Cat{i}", "Pet{k}", H, "rs.di.impl_trait"), (R, "speak", 4, "go", "Pet{k}", H, "rs.di.dyn_trait_method"), (R, "Route{k}", 6, None, None, H, "rs.di.inventory_submit"), (R, "Cmd", 6, None, None, H, "rs.di.inventory_submit"),
]


@query("extract_rules", expected("name line enclosing module confidence rule_id", RULES))
def extract_rules(f):
    return extraction.extract(sources(f))["refs"].where("rule_id IS NOT NULL").select("root_id", "path", "name", "line", "enclosing", "module", "confidence", "rule_id")


CALLS = [
    (P, "Depends", 3, "C{i}.run", None), (P, "helper{k}", 4, "C{i}.run", None), (P, "getattr", 6, "main{i}", None), (P, "eval", 7, "main{i}", None),
    (T, "pay", 4, "S{i}.buy", None), (T, "helper{k}", 4, "S{i}.buy", None), (T, "on", 6, None, "bus"), (T, "emit", 7, None, "bus"), (T, "bind", 8, None, "c"), (T, "eval", 9, None, None),
    (G, "helper{k}", 7, "Mem{i}.Get", None), (G, "GET", 9, "main", "r"),
    (R, "helper{k}", 3, "Cat{i}::speak", None), (R, "speak", 4, "go", "Pet{k}"), (R, "build", 6, None, "Route{k}"), (R, "new", 6, None, "Cmd"), (R, "b", 6, None, None),
]


@query("extract_calls", expected("name line enclosing qualifier", CALLS))
def extract_calls(f):
    return extraction.extract(sources(f))["refs"].where("rule_id IS NULL AND kind = 'call'").select("root_id", "path", "name", "line", "enclosing", "qualifier")


SYMBOLS = [
    (P, "C{i}", "class", 2, 4, 6), (P, "C{i}.run", "function", 3, 4, 8), (P, "main{i}", "function", 5, 7, 4),
    (T, "S{i}", "class", 2, 5, 13), (T, "S{i}.constructor", "method", 3, 3, 2), (T, "S{i}.buy", "method", 4, 4, 2), (T, "D", "class", 9, 9, 22),
    (G, "Store{k}", "interface", 2, 4, 5), (G, "Mem{i}", "struct", 5, 5, 5), (G, "Mem{i}.Get", "method", 7, 7, 12), (G, "main", "function", 8, 10, 5),
    (R, "Pet{k}", "trait", 1, 1, 6), (R, "Pet{k}::speak", "method", 1, 1, 12), (R, "Cat{i}", "struct", 2, 2, 7), (R, "Cat{i}::speak", "method", 3, 3, 18), (R, "go", "function", 4, 4, 3),
]

#: Columns move with the length of the numbers before a name.
_SHIFT = f"CASE WHEN lang_no = {LANGUAGES.index(G)} AND qualified_name LIKE '%.Get' THEN length(CAST(doc_id AS STRING)) + 2 WHEN lang_no = {LANGUAGES.index(R)} AND qualified_name LIKE 'Pet%::speak' THEN length(CAST(doc_id % 97 AS STRING)) + 3 WHEN lang_no = {LANGUAGES.index(R)} AND qualified_name LIKE 'Cat%::speak' THEN length(CAST(doc_id AS STRING)) + length(CAST(doc_id % 97 AS STRING)) + 4 ELSE 0 END"


@query("extract_symbols", f"SELECT root_id, path, qualified_name, kind, start_line, end_line, CAST(start_col + extra AS INT) AS start_col FROM ({expected('qualified_name kind start_line end_line start_col', SYMBOLS).replace(' FROM documents', f', {_SHIFT} AS extra FROM documents', 1)}) x")
def extract_symbols(f):
    return extraction.extract(sources(f))["symbols"].select("root_id", "path", "qualified_name", "kind", "start_line", "end_line", "start_col")


@query("extract_violations", expected("kind line", [(P, "py_eval_exec", 7), (T, "eval", 9), (G, "go_cgo_linkname", 11), (R, "unsafe", 6)]))
def extract_violations(f):
    return extraction.extract(sources(f))["violations"].select("root_id", "path", "kind", "line")


# ---- imports ------------------------------------------------------------------------------


def imports(rows: DataFrame, **values: Column) -> DataFrame:
    """Import refs with the given columns; all others are plain."""
    plain = {"root_id": F.lit("w"), "name": F.lit("x"), "kind": F.lit("import"), "path": F.lit("m"), "line": F.lit(1), "confidence": F.lit("exact")} | values
    return rows.select(*[plain.get(c.name, F.lit(None)).cast(c.dataType).alias(c.name) for c in s.REFS])


def file_rows(paths: DataFrame) -> DataFrame:
    return paths.select(F.lit("w").alias("root_id"), "path").distinct()


def _text(c: Column) -> Column:
    return c.cast("string")


@query("go_import_resolve", """WITH f AS (SELECT 'v' || CAST(doc_id % 3 AS STRING) || '/' || lang || '.org/' || source AS dir, doc_id FROM documents), p AS (SELECT dir, dir || '/f' || CAST(doc_id AS STRING) || '.go' AS path FROM f),
i AS (SELECT lang || '.org/' || source AS module FROM documents UNION SELECT 'x.' || lang || '.org/' || source FROM documents UNION SELECT source FROM documents),
r AS (SELECT i.module, p.path, row_number() OVER (PARTITION BY i.module ORDER BY length(p.path), p.path) AS one FROM i JOIN p ON p.dir = i.module OR p.dir LIKE '%/' || i.module WHERE split_part(i.module, '/', 1) LIKE '%.%')
SELECT i.module, r.path AS resolved FROM i LEFT JOIN r ON r.module = i.module AND r.one = 1""")
def go_import_resolve(f):
    d = f["documents"]
    own = F.concat("lang", F.lit(".org/"), "source")
    files = file_rows(d.select(F.concat(F.lit("v"), _text(F.col("doc_id") % 3), F.lit("/"), own, F.lit("/f"), _text(F.col("doc_id")), F.lit(".go")).alias("path")))
    modules = d.select(own.alias("module")).union(d.select(F.concat(F.lit("x."), own))).union(d.select("source")).distinct()
    return link.go_resolve(imports(modules, module=F.col("module")), files).select("module", "resolved")


_ALIASED = "SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN '@/' || source || '/d' || CAST(doc_id % 500 AS STRING) WHEN 1 THEN '@/deep/$d' || CAST(doc_id % 500 AS STRING) WHEN 2 THEN 'ext/' || source ELSE './' || source END AS module FROM documents"


def _aliased(f: Frames) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Import refs, aliases with two wildcards, and the files that half of the imports mean."""
    d, number, kind = f["documents"], _text(F.col("doc_id") % 500), F.col("doc_id") % 4
    module = F.when(kind == 0, F.concat(F.lit("@/"), "source", F.lit("/d"), number)).when(kind == 1, F.concat(F.lit("@/deep/$d"), number)).when(kind == 2, F.concat(F.lit("ext/"), "source")).otherwise(F.concat(F.lit("./"), "source"))
    tail = F.when(F.col("doc_id") % 3 == 0, ".ts").when(F.col("doc_id") % 3 == 1, "/index.js").otherwise(".d.ts")
    some = d.where("doc_id % 8 < 2")
    files = file_rows(some.select(F.when(kind == 0, F.concat(F.lit("lib/"), "source", F.lit("/d"), number, tail)).otherwise(F.concat(F.lit("deep/$d"), number, F.lit(".tsx"))).alias("path")))
    aliases = d.sparkSession.createDataFrame([("@/*", "w", "lib/*", None, "tsconfig_paths"), ("@/deep/*", "w", "deep/*", None, "tsconfig_paths")], s.ALIASES)
    return imports(d.select(module.alias("module")).distinct(), module=F.col("module")), aliases, files


@query("wildcard_link", f"""WITH m AS ({_ALIASED}), f AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN 'lib/' || source || '/d' || CAST(doc_id % 500 AS STRING) || CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.js' ELSE '.d.ts' END ELSE 'deep/$d' || CAST(doc_id % 500 AS STRING) || '.tsx' END AS path FROM documents WHERE doc_id % 8 < 2),
t AS (SELECT module, CASE WHEN module LIKE '@/deep/%' THEN 'deep/' || substring(module, 8) WHEN module LIKE '@/%' THEN 'lib/' || substring(module, 3) END AS base FROM m),
c AS (SELECT t.module, f.path, row_number() OVER (PARTITION BY t.module ORDER BY x.pos) AS one FROM t JOIN (VALUES {", ".join(f"('{t}', {k})" for k, t in enumerate(link.ALIAS_TAILS))}) x(tail, pos) ON TRUE JOIN f ON f.path = t.base || x.tail)
SELECT m.module, c.path AS resolved FROM m LEFT JOIN c ON c.module = m.module AND c.one = 1""")
def wildcard_link(f):
    return link.link_packages(*_aliased(f)).select("module", "resolved")


@query("external_alias", f"SELECT module, module LIKE 'ext/%' AS external_dependency FROM ({_ALIASED}) m")
def external_alias(f):
    refs, aliases, _ = _aliased(f)
    return lookup.external_dependency(refs, aliases).select("module", "external_dependency")


@query("importers_deep", f"""WITH d AS (SELECT 'm' || CAST(doc_id % 20 AS STRING) AS a, lang, source, 'a' || CAST(doc_id % 50 AS STRING) || '.ts' AS path, CAST(doc_id % 300 AS INT) AS line FROM documents),
q AS (SELECT DISTINCT a AS query FROM d UNION SELECT DISTINCT a || '/' || lang FROM d UNION SELECT DISTINCT a || '/' || lang || '/' || source FROM d),
hit AS (SELECT DISTINCT q.query, d.path, d.line FROM q JOIN d ON d.a || '/' || d.lang || '/' || d.source || '/x' LIKE q.query || '/%'),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY path, line) AS rank FROM hit) SELECT query, path, line, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 50""")
def importers_deep(f):
    d = f["documents"].withColumn("a", F.concat(F.lit("m"), _text(F.col("doc_id") % 20)))
    refs = imports(d, module=F.concat_ws("/", "a", "lang", "source", F.lit("x")), path=F.concat(F.lit("a"), _text(F.col("doc_id") % 50), F.lit(".ts")), line=F.col("doc_id") % 300)
    asked = d.select(F.col("a").alias("query")).union(d.select(F.concat_ws("/", "a", "lang"))).union(d.select(F.concat_ws("/", "a", "lang", "source"))).distinct()
    none = d.sparkSession.createDataFrame([], s.ALIASES)
    return lookup.importers_of_package(refs, asked, none).select("query", "path", "line", F.col("rank").cast("long").alias("rank"))
