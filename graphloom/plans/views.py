"""The supplied business tables, seen as a reference graph.

Each view is one SELECT over base tables in SQL that Spark and DuckDB read alike. In Spark it
becomes a lazy DataFrame over the Parquet scan, so filters and column choices on a view reach
the files.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

_NULLS = "CAST(NULL AS STRING)"


def _ref(name: str, kind: str, path: str, line: str, enclosing: str, *, root: str, table: str, module: str = _NULLS, resolved: str = _NULLS, qualifier: str = _NULLS, confidence: str = "'exact'", rule: str = _NULLS) -> str:
    qual = _NULLS if qualifier == _NULLS else f"{qualifier} || '.' || {name}"
    return (
        f"SELECT {root} AS root_id, {name} AS name, {kind} AS kind, {path} AS path, CAST({line} AS INT) AS line, {enclosing} AS enclosing, "
        f"{module} AS module, {resolved} AS resolved, {qualifier} AS qualifier, {confidence} AS confidence, {qual} AS qual_name, {rule} AS rule_id FROM {table}"
    )


def _t(x: str) -> str:
    return f"CAST({x} AS STRING)"


VIEWS: dict[str, str] = {}

VIEWS["g_refs"] = "\nUNION ALL\n".join(
    [
        _ref(
            f"'P' || {_t('l_partkey')}", "'call'", f"'supplier/S' || {_t('l_suppkey')}", "l_linenumber", f"'O' || {_t('l_orderkey')}",
            root=f"'root' || {_t('l_suppkey % 3')}", table="lineitem", qualifier=f"'S' || {_t('l_suppkey')}",
            confidence="CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'heuristic' ELSE 'dynamic_candidate' END",
            rule="CASE l_returnflag || l_linestatus WHEN 'NF' THEN 'rs.di.impl_trait' WHEN 'NO' THEN 'ts.di.register' WHEN 'RF' THEN 'ts.dynamic.computed' WHEN 'RO' THEN 'ts.dynamic.other' ELSE NULL END",
        ),
        _ref(
            f"'O' || {_t('o_orderkey')}", "CASE WHEN o_orderkey % 2 = 0 THEN 'import' ELSE 'call' END", f"'customer/C' || {_t('o_custkey')}", "o_orderkey % 97 + 1", f"'C' || {_t('o_custkey')}",
            root=f"'root' || {_t('o_custkey % 3')}", table="orders", module="CASE WHEN o_orderkey % 2 = 0 THEN 'pkg' || CAST(o_custkey % 50 AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN '/sub' ELSE '' END END",
            resolved="CASE WHEN o_orderkey % 4 = 0 THEN 'part/P' || CAST(o_custkey % 200 AS STRING) END",
        ),
        _ref(f"'C' || {_t('c_custkey')}", "'define'", f"'nation/N' || {_t('c_nationkey')}", "c_custkey % 89 + 1", f"'N' || {_t('c_nationkey')}", root=f"'root' || {_t('c_custkey % 3')}", table="customer", module=f"'P' || {_t('c_custkey % 200')}"),
        _ref(f"'S' || {_t('s_suppkey')}", "'call'", f"'nation/N' || {_t('s_nationkey')}", "s_suppkey % 83 + 1", f"'N' || {_t('s_nationkey')}", root=f"'root' || {_t('s_suppkey % 3')}", table="supplier"),
        _ref(f"'N' || {_t('n_nationkey')}", "'import'", f"'region/R' || {_t('n_regionkey')}", "n_nationkey + 1", f"'R' || {_t('n_regionkey')}", root="'root0'", table="nation", module="'./nation'"),
    ]
)


def _symbol(name: str, kind: str, path: str, key: str, table: str, *, parent: str = _NULLS, described: str = _NULLS, returns: str = _NULLS) -> str:
    qualified = name if parent == _NULLS else f"{parent} || '.' || {name}"
    return (
        f"SELECT 'root' || {_t(key + ' % 3')} AS root_id, {path} AS path, {name} AS name, {qualified} AS qualified_name, {kind} AS kind, CAST({key} % 400 + 1 AS INT) AS start_line, "
        f"CAST({key} % 400 + 9 AS INT) AS end_line, {parent} AS parent, {described} AS description, CAST(0 AS INT) AS start_col, CAST(8 AS INT) AS end_col, {returns} AS return_type FROM {table}"
    )


VIEWS["g_symbols"] = "\nUNION ALL\n".join(
    [
        _symbol(f"'P' || {_t('p_partkey')}", "'function'", f"'part/P' || {_t('p_partkey % 200')}", "p_partkey", "part", described="CASE WHEN p_size > 25 THEN p_type END", returns="CASE WHEN p_partkey % 3 > 0 THEN 'C' || CAST(p_partkey % 40 AS STRING) END"),
        _symbol(f"'O' || {_t('o_orderkey')}", "'method'", f"'orders/O' || {_t('o_orderkey % 1000')}", "o_orderkey", "orders", parent=f"'C' || {_t('o_custkey')}"),
        _symbol(f"'C' || {_t('c_custkey')}", "'class'", f"'customer/C' || {_t('c_custkey')}", "c_custkey", "customer", parent=f"'N' || {_t('c_nationkey')}", described="CASE WHEN c_acctbal > 0 THEN c_mktsegment END"),
        _symbol(f"'S' || {_t('s_suppkey')}", "'interface'", f"'supplier/S' || {_t('s_suppkey')}", "s_suppkey", "supplier"),
        _symbol(f"'N' || {_t('n_nationkey')}", "'module'", f"'nation/N' || {_t('n_nationkey')}", "n_nationkey", "nation"),
        _symbol(f"'R' || {_t('r_regionkey')}", "'struct'", f"'region/R' || {_t('r_regionkey')}", "r_regionkey", "region"),
    ]
)

_PATHS = "\nUNION ALL\n".join(
    f"SELECT {path} AS path, {key} AS k FROM {table}"
    for path, key, table in [
        (f"'supplier/S' || {_t('s_suppkey')}", "s_suppkey", "supplier"),
        (f"'customer/C' || {_t('c_custkey')}", "c_custkey", "customer"),
        (f"'nation/N' || {_t('n_nationkey')}", "n_nationkey", "nation"),
        (f"'region/R' || {_t('r_regionkey')}", "r_regionkey", "region"),
        (f"'orders/O' || {_t('o_orderkey % 1000')}", "o_orderkey % 1000", "orders"),
        (f"'part/P' || {_t('p_partkey % 200')}", "p_partkey % 200", "part"),
    ]
)
VIEWS["g_files"] = f"""SELECT DISTINCT 'root' || CAST(k % 3 AS STRING) AS root_id, path, 'h' || CAST(k AS STRING) AS hash,
CASE WHEN k % 5 < 3 THEN 'typescript' WHEN k % 5 = 3 THEN 'python' ELSE 'go' END AS language, CAST(k * 1000 AS BIGINT) AS mtime_ns, CAST(k * 10 + 1 AS BIGINT) AS size FROM ({_PATHS}) x"""

VIEWS["g_violations"] = """SELECT source AS root_id, lang || '/' || source || '/d' || CAST(doc_id AS STRING) AS path,
CASE WHEN lower(text) LIKE '%license%' THEN 'eval' WHEN lower(text) LIKE '%password%' OR lower(text) LIKE '%secret%' OR lower(text) LIKE '%token%' THEN 'unsafe'
WHEN text LIKE '%@%' THEN 'Proxy' WHEN text LIKE '%!!%' THEN 'with' ELSE 'monkey_patch' END AS kind, CAST(doc_id % 50 + 1 AS INT) AS line, substring(text, 1, 20) AS snippet
FROM documents WHERE lower(text) LIKE '%license%' OR lower(text) LIKE '%password%' OR lower(text) LIKE '%secret%' OR lower(text) LIKE '%token%' OR text LIKE '%@%' OR text LIKE '%!!%' OR text LIKE '%***%'"""

VIEWS["g_docfiles"] = "SELECT source AS root_id, lang || '/' || source || '/d' || CAST(doc_id AS STRING) AS path, 'h' AS hash, lang AS language, CAST(doc_id AS BIGINT) AS mtime_ns, CAST(n_chars AS BIGINT) AS size FROM documents"

VIEWS["g_events"] = """SELECT 'root' || CAST(user_id % 3 AS STRING) AS root_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'U' || CAST(user_id % 20 AS STRING) END AS name, 'call' AS kind,
'app/U' || CAST(user_id AS STRING) AS path, CAST(event_id % 300 + 1 AS INT) AS line, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'E' || CAST(event_id % 7 AS STRING) END AS enclosing, event_type AS module, CAST(NULL AS STRING) AS resolved,
CAST(NULL AS STRING) AS qualifier, CASE WHEN event_id % 2 = 0 THEN 'dynamic_candidate' ELSE 'heuristic' END AS confidence, CAST(NULL AS STRING) AS qual_name,
CASE WHEN event_id % 2 = 0 THEN 'ts.event.emit' ELSE 'ts.event.subscribe' END AS rule_id FROM events"""

_EDGES = """SELECT 'P' || CAST(l_partkey % 300 AS STRING) AS name, 'supplier/S' || CAST(l_suppkey % 40 AS STRING) AS path, CAST(l_linenumber AS INT) AS line,
CASE l_returnflag WHEN 'A' THEN 'exact' ELSE 'heuristic' END AS confidence, CASE WHEN l_orderkey % 5 = 0 THEN {none} ELSE 'O' || CAST(l_orderkey % 30 AS STRING) END AS enclosing, '{root}' AS root_id
FROM lineitem WHERE {part}"""
#: Two overlapping snapshots with repeated edges; one writes a missing enclosing as null, the other as ''.
VIEWS["g_edges_old"] = _EDGES.format(none="CAST(NULL AS STRING)", root="root0", part="l_orderkey % 10 < 7")
VIEWS["g_edges_new"] = _EDGES.format(none="''", root="root1", part="l_orderkey % 10 > 2")


class Frames(dict):
    """Tables and views of one data directory, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name in TABLES:
            self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        else:
            sql = VIEWS[name]
            used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", sql)]
            for t in used:
                sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
            self[name] = self.spark.sql(sql, **{t: self[t] for t in used})
        return self[name]


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    return Frames(spark, sf_dir)


def sql_with_views(body: str) -> str:
    """``body`` (a query, or CTEs and a query) behind the views that it names."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    heads = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = body.strip()
    if not used:
        return body
    recursive = bool(re.match(r"WITH RECURSIVE\b", body, re.I))
    rest = re.sub(r"^WITH( RECURSIVE)?\b", "", body, flags=re.I) if re.match(r"WITH\b", body, re.I) else None
    return f"WITH {'RECURSIVE ' if recursive else ''}{heads}" + (f",\n{rest}" if rest is not None else f"\n{body}")
