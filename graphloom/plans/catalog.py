"""Queries over the views, each with the SQL that gives the same rows.

``CATALOG[name] = (function of the frames, SQL or None)``. All run over whole tables: where an
operator takes a set of names, the set is every symbol's name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.functions import exprs as e
from graphloom.operators import diff, gate, link, lookup, metrics, rank, sidecar, traverse
from graphloom.plans.views import Frames, sql_with_views

CATALOG: dict[str, tuple[Callable[[Frames], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[Frames], DataFrame]):
        CATALOG[name] = (f, sql_with_views(sql) if sql else None)
        return f

    return keep


def quoted(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


ROLE = f"CASE WHEN confidence = 'dynamic_candidate' THEN 'dynamic' WHEN rule_id IN ({quoted(s.IMPLEMENTOR_RULES)}) THEN 'implementor' WHEN rule_id IN ({quoted(s.REGISTRATION_RULES)}) THEN 'registration' ELSE 'call' END"
SOUND = f"CASE WHEN confidence = 'exact' THEN 'sound' WHEN confidence = 'heuristic' AND rule_id IN ({quoted(s.SOUND_RULES)}) THEN 'sound' WHEN confidence = 'dynamic_candidate' AND rule_id IN ({quoted(s.FINITE_RULES)}) THEN 'sound_finite_domain' ELSE 'unsound' END"
IMPLEMENTOR = f"coalesce(rule_id, '') IN ({quoted(s.IMPLEMENTOR_RULES)})"
PLACE = "root_id, path, line, name, kind, confidence, rule_id NULLS FIRST, enclosing NULLS FIRST"
WINDOW = {w: f"confidence IN ({quoted(c)})" for w, c in s.WINDOWS.items()}
HIGH = quoted(s.HIGH_FREQUENCY)
REF = ("query", "name", "kind", "path", "line", "root_id", "enclosing", "confidence", "rule_id", "rank")
REF_SQL = "query, name, kind, path, line, root_id, enclosing, confidence, rule_id, CAST(rank AS BIGINT) AS rank"


def every_name(f: Frames) -> DataFrame:
    return f["g_symbols"].select(F.col("name").alias("query")).distinct()


def every_qualified_name(f: Frames) -> DataFrame:
    return f["g_refs"].where("qual_name IS NOT NULL").select(F.col("qual_name").alias("query")).distinct()


def shown(df: DataFrame) -> DataFrame:
    return df.select(*REF[:-1], F.col("rank").cast("long").alias("rank"))


# ---- lookup -------------------------------------------------------------------------------


@query("find_exact", """WITH hit AS (SELECT q.query, s.*, CASE WHEN s.name = q.query THEN 0 ELSE 1 END AS by_name FROM (SELECT DISTINCT qualified_name AS query FROM g_symbols) q JOIN g_symbols s ON s.name = q.query OR s.qualified_name = q.query),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY by_name, root_id, path, start_line, qualified_name, kind) AS rank FROM hit)
SELECT query, name, qualified_name, kind, path, root_id, start_line, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 20""")
def find_exact(f):
    q = f["g_symbols"].select(F.col("qualified_name").alias("query")).distinct()
    return lookup.find_exact(f["g_symbols"], q).select("query", "name", "qualified_name", "kind", "path", "root_id", "start_line", F.col("rank").cast("long").alias("rank"))


@query("find_fuzzy", "SELECT name, kind, path, root_id, start_line FROM g_symbols WHERE lower(name) LIKE '%p1%' ORDER BY root_id, path, start_line, name, kind LIMIT 20")
def find_fuzzy(f):
    return lookup.find_fuzzy(f["g_symbols"], "p1").select("name", "kind", "path", "root_id", "start_line")


@query("find_ranked", "SELECT name, kind, path, root_id, start_line, tier FROM (SELECT *, CASE WHEN name = 'N1' THEN 0 WHEN qualified_name = 'N1' THEN 1 WHEN lower(name) LIKE '%n1%' THEN 2 END AS tier FROM g_symbols) x WHERE tier IS NOT NULL ORDER BY tier, root_id, path, start_line, name LIMIT 20")
def find_ranked(f):
    return lookup.find_ranked(f["g_symbols"], "N1").select("name", "kind", "path", "root_id", "start_line", "tier")


def callers_sql(window: str, limit: int, where: str = "TRUE") -> str:
    return f"""WITH q AS (SELECT DISTINCT name AS query FROM g_symbols), hit AS (SELECT q.query, r.* FROM q JOIN g_refs r ON r.name = q.query WHERE {WINDOW[window]} AND {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {PLACE}) AS rank FROM hit) SELECT {REF_SQL} FROM ranked WHERE rank <= {limit}"""


for _w in s.WINDOWS:
    CATALOG[f"callers_{_w}"] = (lambda f, w=_w: shown(lookup.callers(f["g_refs"], every_name(f), w, 50)), sql_with_views(callers_sql(_w, 50)))

CATALOG["callers_sound"] = (lambda f: shown(lookup.callers_sound(f["g_refs"], every_name(f), 50)), sql_with_views(callers_sql("recall", 50, f"({SOUND}) <> 'unsound'")))


@query("callers_qualified", f"""WITH q AS (SELECT DISTINCT qual_name AS query FROM g_refs WHERE qual_name IS NOT NULL), hit AS (SELECT q.query, r.* FROM q JOIN g_refs r ON r.qual_name = q.query WHERE {WINDOW["default"]}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {PLACE}) AS rank FROM hit) SELECT {REF_SQL} FROM ranked WHERE rank <= 50""")
def callers_qualified(f):
    return shown(lookup.callers(f["g_refs"], every_qualified_name(f), "default", 50))


BY_ROLE = f"""q AS (SELECT DISTINCT name AS query FROM g_symbols), hit AS (SELECT q.query, r.*, {IMPLEMENTOR} AS implementor FROM q JOIN g_refs r ON r.name = q.query WHERE {WINDOW["default"]}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query, implementor ORDER BY {PLACE}) AS rank FROM hit), kept AS (SELECT * FROM ranked WHERE implementor OR rank <= 5)"""


@query("callers_roles", f"WITH {BY_ROLE} SELECT {REF_SQL}, implementor FROM kept")
def callers_roles(f):
    return lookup.callers_by_role(f["g_refs"], every_name(f), "default", 5).select(*REF[:-1], F.col("rank").cast("long").alias("rank"), "implementor")


@query("callers_payload_counts", f"""WITH {BY_ROLE}, c AS (SELECT query, sum(CASE WHEN implementor THEN 0 ELSE 1 END) AS callers, sum(CASE WHEN implementor THEN 1 ELSE 0 END) AS n, CASE WHEN lower(query) IN ({HIGH}) THEN 5 ELSE 5 END AS cap FROM kept GROUP BY query)
SELECT query, CAST(callers AS BIGINT) AS callers, CAST(least(n, cap) AS BIGINT) AS implementors, CAST(n AS BIGINT) AS implementor_count, n > cap AS implementors_truncated FROM c""")
def callers_payload_counts(f):
    return lookup.callers_counts(f["g_refs"], every_name(f), "default", 5)


@query("high_freq_cap", f"SELECT type, CAST(n AS BIGINT) AS n, cap FROM (SELECT event_type AS type, count(*) AS n, CASE WHEN lower(event_type) IN ({HIGH}) THEN 20 ELSE 50 END AS cap FROM events GROUP BY event_type) x")
def high_freq_cap(f):
    return f["events"].groupBy(F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n")).withColumn("cap", F.when(e.high_frequency("type"), s.HIGH_FREQUENCY_CAP).otherwise(50))


@query("edge_role_counts", f"SELECT {ROLE} AS edge_role, count(*) AS n FROM g_refs GROUP BY 1")
def edge_role_counts(f):
    return gate.edge_roles(f["g_refs"])


@query("sound_class_counts", f"SELECT {SOUND} AS sound_class, count(*) AS n FROM g_refs GROUP BY 1")
def sound_class_counts(f):
    return gate.sound_classes(f["g_refs"])


@query("importers_of_file", f"""WITH q AS (SELECT DISTINCT path AS query FROM g_symbols), hit AS (SELECT q.query, r.* FROM q JOIN g_refs r ON r.resolved = q.query WHERE r.kind = 'import'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {PLACE}) AS rank FROM hit) SELECT {REF_SQL} FROM ranked WHERE rank <= 50""")
def importers_of_file(f):
    return shown(lookup.importers_of_file(f["g_refs"], f["g_symbols"].select(F.col("path").alias("query")).distinct()))


def aliases(f: Frames) -> DataFrame:
    """A workspace in which each customer's key modulo 50 below 30 is a package of ours."""
    return f["customer"].where("c_custkey < 50 AND c_custkey % 5 < 3").select(F.concat(F.lit("pkg"), F.col("c_custkey").cast("string")).alias("package"), F.concat(F.lit("root"), (F.col("c_custkey") % 3).cast("string")).alias("root_id"), F.lit(None).cast("string").alias("entry"), F.concat(F.lit("part/P"), F.col("c_custkey").cast("string")).alias("barrel"), F.lit("package.json").alias("source"))


ALIASES = "a AS (SELECT 'pkg' || CAST(c_custkey AS STRING) AS package, 'root' || CAST(c_custkey % 3 AS STRING) AS root_id, 'part/P' || CAST(c_custkey AS STRING) AS barrel FROM customer WHERE c_custkey < 50 AND c_custkey % 5 < 3)"


@query("importers_of_package", f"""WITH {ALIASES}, hit AS (
  SELECT a.package AS query, r.*, 0 AS tier FROM a JOIN g_refs r ON r.kind = 'import' AND (r.module = a.package OR r.module LIKE a.package || '/%')
  UNION ALL SELECT a.package, r.*, 1 FROM a JOIN g_refs r ON r.kind = 'import' AND (r.resolved = a.barrel OR r.resolved = '@alias:' || a.package || '→' || a.root_id)),
once AS (SELECT *, row_number() OVER (PARTITION BY query, path, line, name ORDER BY tier, {PLACE}) AS f FROM hit), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, {PLACE}) AS rank FROM once WHERE f = 1)
SELECT {REF_SQL}, coalesce(module, '') <> '' AND module NOT LIKE '.%' AND module NOT LIKE '/%' AND resolved IS NULL AND split_part(module, '/', 1) NOT IN (SELECT package FROM a) AS external_dependency FROM ranked WHERE rank <= 50""")
def importers_of_package(f):
    a = aliases(f)
    got = lookup.importers_of_package(f["g_refs"], a.select(F.col("package").alias("query")), a)
    return got.select(*REF[:-1], F.col("rank").cast("long").alias("rank"), "external_dependency")


#: Every package that an import names, whether the workspace has it or not.
PACKAGES = "p AS (SELECT DISTINCT split_part(module, '/', 1) AS package FROM g_refs WHERE kind = 'import' AND module <> '' AND module NOT LIKE '.%' AND module NOT LIKE '/%')"


@query("importers_of_every_package", f"""WITH {ALIASES}, {PACKAGES}, hit AS (
  SELECT p.package AS query, r.*, 0 AS tier FROM p JOIN g_refs r ON r.kind = 'import' AND (r.module = p.package OR r.module LIKE p.package || '/%')
  UNION ALL SELECT a.package, r.*, 1 FROM p JOIN a ON a.package = p.package JOIN g_refs r ON r.kind = 'import' AND (r.resolved = a.barrel OR r.resolved = '@alias:' || a.package || '→' || a.root_id)),
once AS (SELECT *, row_number() OVER (PARTITION BY query, path, line, name ORDER BY tier, {PLACE}) AS f FROM hit), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, {PLACE}) AS rank FROM once WHERE f = 1)
SELECT {REF_SQL}, coalesce(module, '') <> '' AND module NOT LIKE '.%' AND module NOT LIKE '/%' AND resolved IS NULL AND split_part(module, '/', 1) NOT IN (SELECT package FROM a) AS external_dependency FROM ranked WHERE rank <= 50""")
def importers_of_every_package(f):
    asked = f["g_refs"].where("kind = 'import' AND module <> '' AND module NOT LIKE '.%' AND module NOT LIKE '/%'").select(F.split_part("module", F.lit("/"), F.lit(1)).alias("query")).distinct()
    got = lookup.importers_of_package(f["g_refs"], asked, aliases(f))
    return got.select(*REF[:-1], F.col("rank").cast("long").alias("rank"), "external_dependency")


@query("external_dependency", f"""WITH {ALIASES}, m AS (SELECT module, resolved, CASE WHEN module LIKE '.%' OR module LIKE '/%' THEN '' ELSE split_part(module, '/', 1) END AS p FROM g_refs WHERE kind = 'import')
SELECT module, coalesce(coalesce(module, '') <> '' AND module NOT LIKE '.%' AND module NOT LIKE '/%' AND resolved IS NULL AND a.package IS NULL, false) AS external_dependency, count(*) AS n FROM m LEFT JOIN a ON a.package = m.p GROUP BY 1, 2""")
def external_dependency(f):
    got = lookup.external_dependency(f["g_refs"].where("kind = 'import'"), aliases(f))
    return got.groupBy("module", "external_dependency").agg(F.count(F.lit(1)).alias("n"))


@query("one_hop_imports", """WITH d AS (SELECT DISTINCT path, resolved FROM g_refs WHERE kind = 'import' AND resolved IS NOT NULL AND resolved <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY resolved) AS k FROM d) SELECT path, resolved FROM r WHERE k <= 32""")
def one_hop_imports(f):
    return lookup.one_hop_imports(f["g_refs"], f["g_refs"].select(F.col("path").alias("query")).distinct())


@query("symbols_needing_description", f"SELECT name, kind, path, root_id FROM (SELECT * FROM g_symbols WHERE description IS NULL AND kind IN ({quoted(s.DESCRIBED_KINDS)}) ORDER BY root_id, path, start_line, name, kind LIMIT 100) x")
def symbols_needing_description(f):
    return lookup.undescribed(f["g_symbols"]).select("name", "kind", "path", "root_id")


# ---- traversal ----------------------------------------------------------------------------


def impact_sql(depth: int, limit: int, edges: str, gated: bool = True, start: str = "SELECT DISTINCT name AS query FROM g_symbols") -> str:
    """The level-wise walk, written out: hits, first per place, new leaves, gate."""
    place, cols = "query, root_id, name, line, path", "query, name, kind, path, line, root_id, enclosing, confidence, rule_id"
    parts = [
        f"q AS ({start})",
        f"edge AS (SELECT r.*, c.cited FROM g_refs r LEFT JOIN (SELECT path, min(language) AS cited FROM g_files GROUP BY path) c ON c.path = r.path WHERE {edges})",
        "opened AS (SELECT DISTINCT s.name AS leaf, g.language FROM g_symbols s JOIN g_files g ON g.path = s.path UNION SELECT DISTINCT name, NULL FROM g_symbols)",
        "front1 AS (SELECT query, query AS leaf, 1 AS ord FROM q)",
        "vis1 AS (SELECT query, query AS leaf FROM q)",
    ]
    for d in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT {place} FROM hit{k}" for k in range(1, d))
        unseen = f"WHERE NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.query = f.query AND b.root_id = f.root_id AND b.name = f.name AND b.line = f.line AND b.path = f.path)" if d > 1 else ""
        parts.append(f"raw{d} AS (SELECT x.query, x.ord, edge.* FROM front{d} x JOIN edge ON edge.name = x.leaf)")
        parts.append(f"first{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {place} ORDER BY ord, {PLACE}) AS one FROM raw{d}) y WHERE one = 1)")
        parts.append(f"hit{d} AS (SELECT {cols}, cited, {d} AS depth, regexp_extract(enclosing, '[^.:]*$', 0) AS leaf, row_number() OVER (PARTITION BY query ORDER BY ord, {PLACE}) AS spot FROM first{d} f {unseen})")
        if d < depth:
            parts.append(f"new{d} AS (SELECT query, leaf, cited, spot FROM (SELECT *, row_number() OVER (PARTITION BY query, leaf ORDER BY spot) AS one FROM hit{d} WHERE leaf <> '') y WHERE one = 1 AND NOT EXISTS (SELECT 1 FROM vis{d} v WHERE v.query = y.query AND v.leaf = y.leaf))")
            gate_sql = "WHERE EXISTS (SELECT 1 FROM opened o WHERE o.leaf = n.leaf AND o.language IS NOT DISTINCT FROM n.cited)" if gated else ""
            parts.append(f"front{d + 1} AS (SELECT query, leaf, spot AS ord FROM new{d} n {gate_sql})")
            parts.append(f"vis{d + 1} AS (SELECT * FROM vis{d} UNION ALL SELECT query, leaf FROM new{d})")
    union = " UNION ALL ".join(f"SELECT {cols}, depth, spot FROM hit{d}" for d in range(1, depth + 1))
    parts.append(f"ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY depth, spot) AS rank FROM ({union}) u)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT {cols}, depth, CAST(rank AS BIGINT) AS rank, {ROLE} AS edge_role FROM ranked WHERE rank <= {limit}"


def impact_rows(df: DataFrame) -> DataFrame:
    return df.select(*REF[:-1], "depth", F.col("rank").cast("long").alias("rank"), "edge_role")


@query("impact_default", impact_sql(2, 100, WINDOW["default"]))
def impact_default(f):
    return impact_rows(traverse.impact(f["g_refs"], f["g_symbols"], f["g_files"], every_name(f)))


@query("impact_sound", impact_sql(3, 100, f"({SOUND}) <> 'unsound'"))
def impact_sound(f):
    return impact_rows(traverse.impact(f["g_refs"], f["g_symbols"], f["g_files"], every_name(f), 3, 100, sound=True))


@query("impact_ungated", impact_sql(3, 40, WINDOW["recall"], gated=False))
def impact_ungated(f):
    return impact_rows(traverse.impact(f["g_refs"], f["g_symbols"], f["g_files"], every_name(f), 3, 40, "recall", gated=False))


@query("transitive_closure", """WITH RECURSIVE ok AS (SELECT DISTINCT r.enclosing AS a, r.name AS b FROM g_refs r WHERE r.kind <> 'import' AND r.enclosing IN (SELECT name FROM g_symbols) AND r.name IN (SELECT name FROM g_symbols)),
up AS (SELECT a, b FROM ok UNION SELECT up.a, ok.b FROM up JOIN ok ON ok.a = up.b) SELECT a, b FROM up""")
def transitive_closure(f):
    edges = f["g_refs"].where("kind <> 'import'").select(F.col("enclosing").alias("caller"), F.col("name").alias("callee"))
    return traverse.closure(edges, f["g_symbols"].select("name").distinct())


# ---- rank ---------------------------------------------------------------------------------


@query("related_files", f"""WITH q AS (SELECT DISTINCT name AS query FROM g_symbols), d AS (SELECT q.query, s.path, s.kind, s.description, s.start_line FROM q JOIN g_symbols s ON s.name = q.query OR s.qualified_name = q.query),
one AS (SELECT query, path, count(*) * 10 AS score, count(*) AS defs, max_by('definition:' || kind || CASE WHEN description IS NOT NULL THEN '+llm' ELSE '' END, start_line * 1000 + length(kind)) AS reason FROM d GROUP BY query, path),
imp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, resolved ORDER BY {PLACE}) AS k FROM (SELECT one.query, one.defs, r.* FROM one JOIN g_refs r ON r.kind = 'import' AND r.resolved = one.path) j) x WHERE k <= 100),
two AS (SELECT query, path, sum(defs) * 3 AS score, 'imports:' || min(resolved) AS reason FROM imp GROUP BY query, path),
call AS (SELECT * FROM (SELECT q.query, r.*, row_number() OVER (PARTITION BY q.query ORDER BY {PLACE}) AS k FROM q JOIN g_refs r ON r.name = q.query WHERE {WINDOW["default"]}) x WHERE k <= 200),
three AS (SELECT query, path, count(*) AS score, 'reference:' || min_by(kind, k) AS reason FROM call GROUP BY query, path),
parts AS (SELECT query, path, score, reason, 0 AS tier FROM one UNION ALL SELECT *, 1 FROM two UNION ALL SELECT *, 2 FROM three),
total AS (SELECT query, path, CAST(sum(score) AS BIGINT) AS score, min_by(reason, tier) AS reason FROM parts GROUP BY query, path)
SELECT query, path, score, reason, CAST(k AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS k FROM total) x WHERE k <= 10""")
def related_files(f):
    return rank.related_files(f["g_symbols"], f["g_refs"], every_name(f)).withColumn("rank", F.col("rank").cast("long"))


def candidates(f: Frames) -> DataFrame:
    """Parts as files: directories from the type, names from the brand, some of them decoys."""
    k = F.col("p_partkey")
    top_dir = F.element_at(F.array(*[F.lit(x) for x in ("src", "lib", "legacy", "tests", "core", "api", "docs")]), (k % 7 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("index", "utils", "order", "invoice", "handler")]), (F.floor(k / 7) % 5 + 1).cast("int"))
    return f["part"].select(
        F.concat(F.lit("S"), (k % 100).cast("string")).alias("query"),
        F.concat(F.when(k % 31 == 0, F.lit("@alias:")).otherwise(F.lit("")), top_dir, F.lit("/b"), (k % 3).cast("string"), F.lit("/"), name, F.when(k % 2 == 0, (k % 11).cast("string")).otherwise(F.lit("")), F.lit(".ts")).alias("path"),
        (F.col("p_size") % 4 * 0.5).cast("double").alias("score"),
        F.element_at(F.array(*[F.lit(x) for x in ("call", "registration", "define", "implementor", "dynamic", "import", "other")]), (k % 7 + 1).cast("int")).alias("edge_role"),
        (k % 4).cast("int").alias("depth"),
        F.element_at(F.array(F.lit("app"), F.lit("cli"), F.lit("web"), F.lit("mock"), F.lit("core")), (F.floor(k / 5) % 5 + 1).cast("int")).alias("root_id"),
    )


CANDIDATES = """cand AS (SELECT 'S' || CAST(k % 100 AS STRING) AS query, CASE WHEN k % 31 = 0 THEN '@alias:' ELSE '' END || (['src','lib','legacy','tests','core','api','docs'])[k % 7 + 1] || '/b' || CAST(k % 3 AS STRING) || '/' || (['index','utils','order','invoice','handler'])[(k // 7) % 5 + 1] || CASE WHEN k % 2 = 0 THEN CAST(k % 11 AS STRING) ELSE '' END || '.ts' AS path,
CAST(p_size % 4 AS DOUBLE) * 0.5 AS score, (['call','registration','define','implementor','dynamic','import','other'])[k % 7 + 1] AS edge_role, k % 4 AS depth, (['app','cli','web','mock','core'])[(k // 5) % 5 + 1] AS root_id FROM (SELECT p_partkey AS k, p_size FROM part) p),
seg AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM cand),
rated AS (SELECT *, lower(regexp_replace(parts[-1], '\\.[^.]*$', '')) AS stem, parts[:-2] AS dirs FROM seg),
fine AS (SELECT *, len(list_filter(dirs, lambda x: lower(x) IN ({low}))) * 8.0 + CASE WHEN stem IN ({common}) THEN 10.0 ELSE 0.0 END + CASE WHEN stem IN ({barrel}) THEN 6.0 ELSE 0.0 END AS pen FROM rated),
total AS (SELECT query, path, root_id, score + CASE edge_role WHEN 'call' THEN 12.0 WHEN 'import' THEN 12.0 WHEN 'registration' THEN 10.0 WHEN 'define' THEN 8.0 WHEN 'implementor' THEN 3.0 WHEN 'dynamic' THEN 1.0 ELSE 4.0 END
 + CASE depth WHEN 0 THEN 5.0 WHEN 1 THEN 3.0 WHEN 2 THEN 1.5 ELSE 0.5 END - pen - CASE WHEN root_id IN ({roots}) THEN 12.0 ELSE 0.0 END AS total FROM fine)""".format(
    low=quoted(e.LOW_PRIORITY_DIRS), common=quoted(e.COMMON_BASENAMES), barrel=quoted(e.BARREL_STEMS), roots=quoted(e.DECOY_ROOTS)
)


@query("file_scores", f"WITH {CANDIDATES} SELECT query, path, CAST(max(total) AS DOUBLE) AS score FROM total GROUP BY query, path")
def file_scores(f):
    return rank.file_scores(candidates(f), ["query"]).select("query", "path", "score")


@query("budget_select")
def budget_select(f):
    return rank.select_files(candidates(f), ["query"])


# ---- gate and statistics ------------------------------------------------------------------


@query("stats_overview", """SELECT (SELECT count(*) FROM g_files) AS files, (SELECT count(DISTINCT language) FROM g_files) AS languages, (SELECT count(*) FROM g_symbols) AS symbols, (SELECT count(description) FROM g_symbols) AS described, (SELECT count(*) FROM g_refs) AS refs,
(SELECT count(*) FROM g_refs WHERE confidence = 'exact') AS refs_exact, (SELECT count(*) FROM g_refs WHERE confidence = 'heuristic') AS refs_heuristic, (SELECT count(*) FROM g_refs WHERE confidence = 'dynamic_candidate') AS refs_dynamic_candidate""")
def stats_overview(f):
    return gate.stats(f["g_files"], f["g_symbols"], f["g_refs"])


@query("refs_by_confidence", "SELECT confidence, count(*) AS n FROM g_refs GROUP BY 1")
def refs_by_confidence(f):
    return gate.refs_by_confidence(f["g_refs"])


STATUS = """status AS (SELECT coalesce(a.root_id, b.root_id, c.root_id, d.root_id) AS root_id, coalesce(a.files, 0) AS files, coalesce(b.symbols, 0) AS symbols, coalesce(c.refs, 0) AS refs, coalesce(c.x, 0) AS exact, coalesce(c.h, 0) AS heuristic, coalesce(c.y, 0) AS dynamic_candidate, coalesce(d.violations, 0) AS violations, coalesce(a.languages, '') AS languages
FROM (SELECT root_id, count(*) AS files, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM (SELECT root_id, language FROM g_files UNION ALL SELECT root_id, language FROM g_docfiles) u GROUP BY 1) a FULL JOIN (SELECT root_id, count(*) AS symbols FROM g_symbols GROUP BY 1) b ON a.root_id = b.root_id
FULL JOIN (SELECT root_id, count(*) AS refs, count(CASE WHEN confidence = 'exact' THEN 1 END) AS x, count(CASE WHEN confidence = 'heuristic' THEN 1 END) AS h, count(CASE WHEN confidence = 'dynamic_candidate' THEN 1 END) AS y FROM g_refs GROUP BY 1) c ON coalesce(a.root_id, b.root_id) = c.root_id
FULL JOIN (SELECT root_id, count(*) AS violations FROM g_violations GROUP BY 1) d ON coalesce(a.root_id, b.root_id, c.root_id) = d.root_id)"""


def status(f: Frames) -> DataFrame:
    files = f["g_files"].select("root_id", "language").unionByName(f["g_docfiles"].select("root_id", "language"))
    return gate.roots_status(files, f["g_symbols"], f["g_refs"], f["g_violations"])


@query("root_status_pivot", f"WITH {STATUS} SELECT *, files = 0 AS missing, CASE WHEN violations = 0 THEN 'ast_modeled' ELSE 'disabled' END AS tier FROM status")
def root_status_pivot(f):
    return status(f)


@query("weakest_root", f"WITH {STATUS} SELECT root_id, violations FROM status WHERE violations > 0 ORDER BY violations DESC, root_id LIMIT 1")
def weakest_root(f):
    return gate.weakest_root(status(f))


@query("subset_by_root", "SELECT root_id, kind, count(*) AS n FROM g_violations GROUP BY 1, 2")
def subset_by_root(f):
    return gate.violation_counts(f["g_violations"])


@query("subset_top_kinds", "WITH c AS (SELECT root_id, kind, count(*) AS n FROM g_violations GROUP BY 1, 2) SELECT root_id, kind, n, CAST(k AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY n DESC, kind) AS k FROM c) x WHERE k <= 5")
def subset_top_kinds(f):
    return gate.top_kinds(f["g_violations"]).withColumn("rank", F.col("rank").cast("long"))


def _buckets_sql(key: str) -> str:
    return f"""WITH k AS (SELECT DISTINCT {key} AS bucket FROM g_docfiles), c AS (SELECT {key} AS bucket, kind, count(*) AS n FROM g_violations GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, kind) AS r, sum(n) OVER (PARTITION BY bucket) AS total FROM c),
g AS (SELECT bucket, max(total) AS violations, string_agg(kind, ',' ORDER BY r) FILTER (WHERE r <= 5) AS top_kinds FROM t GROUP BY bucket) SELECT coalesce(k.bucket, g.bucket) AS bucket, CAST(coalesce(violations, 0) AS BIGINT) AS violations, coalesce(top_kinds, '') AS top_kinds, violations IS NULL AS eligible FROM k FULL JOIN g ON k.bucket = g.bucket"""


@query("scoped_sound_candidates", _buckets_sql("CASE WHEN coalesce(root_id, '') = '' THEN 'default' ELSE root_id END"))
def scoped_sound_candidates(f):
    return gate.buckets(f["g_docfiles"], f["g_violations"], "root")


@query("scoped_sound_dirs", _buckets_sql("CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '(root)' END"))
def scoped_sound_dirs(f):
    return gate.buckets(f["g_docfiles"], f["g_violations"], "dir")


# ---- linking ------------------------------------------------------------------------------


@query("symbol_link", """WITH r AS (SELECT *, row_number() OVER () AS rid FROM g_refs), k AS (
  SELECT r.*, 0 AS tier, d.root_id AS d_root, d.path AS d_path, d.start_line AS d_line, d.qualified_name AS d_name FROM r JOIN g_symbols d ON coalesce(r.qualifier, '') <> '' AND d.qualified_name = r.qualifier || '.' || r.name
  UNION ALL SELECT r.*, 2, d.root_id, d.path, d.start_line, d.qualified_name FROM r JOIN g_symbols d ON d.name = r.name),
p AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY tier, CASE WHEN d_root = root_id AND d_path = path THEN 0 WHEN d_root = root_id OR d_root = 'root1' THEN 1 ELSE 2 END, d_path, d_root, d_line, d_name) AS one FROM k)
SELECT r.name, r.path, r.line, r.root_id, r.enclosing, r.confidence, p.d_root AS symbol_root, p.d_path AS symbol_path, p.d_name AS symbol_name FROM r LEFT JOIN p ON p.rid = r.rid AND p.one = 1""")
def symbol_link(f):
    return link.link_symbols(f["g_refs"], f["g_symbols"], "root1").select("name", "path", "line", "root_id", "enclosing", "confidence", "symbol_root", "symbol_path", "symbol_name")




def _typed_refs(f: Frames) -> DataFrame:
    """Defines of variables and calls on them, placed in the parts' directory."""
    r = f["g_refs"]
    defines = r.where("kind = 'define'").withColumn("path", F.concat(F.lit("part/P"), F.regexp_extract("name", "[0-9]+", 0).cast("long") % 200))
    calls = r.where("qualifier IS NOT NULL").withColumn("qualifier", F.concat(F.lit("C"), F.regexp_extract("qualifier", "[0-9]+", 0))).withColumn("path", F.concat(F.lit("part/P"), F.regexp_extract("qualifier", "[0-9]+", 0).cast("long") % 200))
    return defines.unionByName(calls)


@query("qualifier_upgrade", """WITH num AS (SELECT *, CAST(regexp_extract(CASE WHEN kind = 'define' THEN name ELSE qualifier END, '[0-9]+', 0) AS BIGINT) AS k FROM g_refs WHERE kind = 'define' OR qualifier IS NOT NULL),
r AS (SELECT name, kind, line, enclosing, module, 'part/P' || CAST(k % 200 AS STRING) AS path, CASE WHEN qualifier IS NOT NULL THEN 'C' || CAST(k AS STRING) END AS qualifier FROM num),
fn AS (SELECT name, return_type FROM g_symbols WHERE kind = 'function'), many AS (SELECT name FROM fn GROUP BY name HAVING count(*) > 1),
t AS (SELECT r.path, r.name AS var, min(fn.return_type) AS lo, max(fn.return_type) AS hi, bool_or(r.module IN (SELECT name FROM many)) AS several FROM r JOIN fn ON fn.name = r.module WHERE r.kind = 'define' AND fn.return_type IS NOT NULL AND fn.return_type <> '' GROUP BY 1, 2),
y AS (SELECT path, var, lo AS type FROM t WHERE lo = hi AND NOT several), types AS (SELECT DISTINCT name FROM g_symbols WHERE kind IN ('class','struct','interface','enum','trait'))
SELECT coalesce(CASE WHEN r.kind = 'call' AND y.type <> r.qualifier AND r.qualifier NOT IN (SELECT name FROM types) THEN y.type END, r.qualifier) AS qualifier, CASE WHEN r.kind = 'call' AND y.type <> r.qualifier AND r.qualifier NOT IN (SELECT name FROM types) THEN r.qualifier END AS pre_qual, count(*) AS n
FROM r LEFT JOIN y ON y.path = r.path AND y.var = r.qualifier GROUP BY 1, 2""")
def qualifier_upgrade(f):
    return link.upgrade_qualifiers(_typed_refs(f), f["g_symbols"]).groupBy("qualifier", "pre_qual").agg(F.count(F.lit(1)).alias("n"))


@query("event_dispatch", """WITH h AS (SELECT DISTINCT root_id, module, name AS handler FROM g_events WHERE rule_id = 'ts.event.subscribe' AND module IS NOT NULL)
SELECT h.handler AS name, e.root_id, e.path, e.line, coalesce(e.enclosing, '') AS enclosing, e.module, 'heuristic' AS confidence, 'ts.event.dispatch' AS rule_id FROM g_events e JOIN h ON h.root_id = e.root_id AND h.module = e.module WHERE e.rule_id = 'ts.event.emit'""")
def event_dispatch(f):
    return link.dispatch(f["g_events"]).select("name", "root_id", "path", "line", "enclosing", "module", "confidence", "rule_id")


@query("package_link", f"""WITH {ALIASES}, k AS (SELECT r.name, r.path, r.line, r.module, r.kind, r.resolved, (SELECT max(a.package) FROM a WHERE r.kind = 'import' AND (r.module = a.package OR r.module LIKE a.package || '/%')) AS p FROM g_refs r)
SELECT k.name, k.path, k.line, k.module, coalesce(a.barrel, k.resolved) AS resolved FROM k LEFT JOIN a ON a.package = k.p""")
def package_link(f):
    return link.link_packages(f["g_refs"], aliases(f), f["g_files"]).select("name", "path", "line", "module", "resolved")


def _page_imports(f: Frames) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit('href="(/[^"?#]*)"'), F.lit(1))
    rows = f["pages"].select(F.concat(F.lit("web/d"), (F.col("page_id") % 7).cast("string"), F.lit("/p"), F.col("page_id").cast("string"), F.lit(".ts")).alias("path"), F.explode(F.array_distinct(hrefs)).alias("href"))
    return rows.select(F.lit("web").alias("root_id"), "path", F.concat(F.lit(".."), "href").alias("module"), F.lit(None).cast("string").alias("resolved"))


def _page_files(f: Frames) -> DataFrame:
    return _page_imports(f).select("root_id", F.concat(F.lit("web"), F.substring("module", 3, 1000), F.when(F.length("module") % 3 == 0, F.lit(".ts")).when(F.length("module") % 3 == 1, F.lit("/index.js")).otherwise(F.lit(".d.ts"))).alias("path")).distinct()


@query("ts_import_resolve", f"""WITH i AS (SELECT DISTINCT 'web/d' || CAST(page_id % 7 AS STRING) || '/p' || CAST(page_id AS STRING) || '.ts' AS path, '..' || unnest(list_distinct(regexp_extract_all(html, 'href="(/[^"?#]*)"', 1))) AS module FROM pages),
f AS (SELECT DISTINCT 'web' || substring(module, 3) || CASE WHEN length(module) % 3 = 0 THEN '.ts' WHEN length(module) % 3 = 1 THEN '/index.js' ELSE '.d.ts' END AS path FROM i),
c AS (SELECT i.path, i.module, f.path AS file, t.pos FROM i, (SELECT unnest([{quoted(link.TS_TAILS)}]) AS tail, unnest(range({len(link.TS_TAILS)})) AS pos) t JOIN f ON f.path = rtrim('web' || substring(i.module, 3), '/') || t.tail)
SELECT i.path, i.module, (SELECT min_by(c.file, c.pos) FROM c WHERE c.path = i.path AND c.module = i.module) AS resolved FROM i""")
def ts_import_resolve(f):
    return link.resolve_imports(_page_imports(f), _page_files(f), link.ts_candidates()).select("path", "module", "resolved")


@query("export_pick_symbol", """WITH n AS (SELECT name, count(*) AS c FROM g_symbols GROUP BY name) SELECT r.name, r.path, r.line, s.qualified_name AS symbol_name, s.path AS symbol_path, count(*) AS n FROM g_refs r JOIN n ON n.name = r.name AND n.c = 1 JOIN g_symbols s ON s.name = r.name GROUP BY 1, 2, 3, 4, 5""")
def export_pick_symbol(f):
    return link.unique_definition(f["g_refs"], f["g_symbols"]).groupBy("name", "path", "line", "symbol_name", "symbol_path").agg(F.count(F.lit(1)).alias("n"))


# ---- ingestion ----------------------------------------------------------------------------


@query("prune_missing", "SELECT s.name, s.path, s.root_id FROM g_symbols s WHERE EXISTS (SELECT 1 FROM g_files f WHERE f.path = s.path AND f.root_id = s.root_id)")
def prune_missing(f):
    from graphloom.sources.ingest import pruned

    rows = f["g_symbols"]
    for r in [r[0] for r in rows.select("root_id").distinct().collect()]:
        rows = pruned(rows, f["g_files"], r)
    return rows.select("name", "path", "root_id")


@query("dirty_paths", "SELECT w.root_id, w.path FROM (SELECT root_id, path, mtime_ns + CASE WHEN size % 3 = 0 THEN 1 ELSE 0 END AS mtime_ns, size FROM g_files WHERE size % 7 > 0) w LEFT JOIN g_files f ON f.root_id = w.root_id AND f.path = w.path WHERE f.path IS NULL OR f.mtime_ns <> w.mtime_ns OR f.size <> w.size OR w.mtime_ns = 0")
def dirty_paths(f):
    from graphloom.sources.ingest import dirty

    walk = f["g_files"].where("size % 7 > 0").withColumn("mtime_ns", F.col("mtime_ns") + F.when(F.col("size") % 3 == 0, 1).otherwise(0))
    return dirty(walk, f["g_files"]).select("root_id", "path")


# ---- diff ---------------------------------------------------------------------------------


def _diff_sql(left: str, right: str, exact: bool) -> str:
    only = " AND l.confidence = 'exact'" if exact else ""
    return f"SELECT l.* FROM {left} l WHERE NOT EXISTS (SELECT 1 FROM {right} r WHERE r.name = l.name AND r.path = l.path AND r.line = l.line AND r.confidence = l.confidence AND coalesce(r.enclosing, '') = coalesce(l.enclosing, '')){only}"


@query("diff_added", _diff_sql("g_edges_new", "g_edges_old", False))
def diff_added(f):
    return diff.added(f["g_edges_old"], f["g_edges_new"])


@query("diff_removed", _diff_sql("g_edges_old", "g_edges_new", False))
def diff_removed(f):
    return diff.removed(f["g_edges_old"], f["g_edges_new"])


@query("diff_summary_exact_only", f"SELECT (SELECT count(*) FROM ({_diff_sql('g_edges_new', 'g_edges_old', True)}) a) AS added, (SELECT count(*) FROM ({_diff_sql('g_edges_old', 'g_edges_new', True)}) b) AS removed, (SELECT count(*) FROM g_edges_old WHERE confidence = 'exact') AS old_edges, (SELECT count(*) FROM g_edges_new WHERE confidence = 'exact') AS new_edges")
def diff_summary_exact_only(f):
    return diff.summary(f["g_edges_old"], f["g_edges_new"], True)


# ---- side dataset -------------------------------------------------------------------------

_KNOWN = "known AS (SELECT name, coalesce(enclosing, '') AS enc, path AS mapped, bool_or(confidence = 'exact') AS x FROM g_edges_old GROUP BY 1, 2, 3), side AS (SELECT s.*, CASE WHEN s.line % 4 = 0 THEN NULL ELSE s.path END AS mapped FROM g_edges_new s), m AS (SELECT side.*, known.x FROM side LEFT JOIN known ON known.name = side.name AND known.enc = coalesce(side.enclosing, '') AND known.mapped = side.mapped)"


def _side(f: Frames) -> DataFrame:
    return f["g_edges_new"].withColumn("mapped", F.when(F.col("line") % 4 != 0, F.col("path")))


@query("sidecar_union_dedup", f"WITH {_KNOWN} SELECT name, path, line, confidence, enclosing, root_id, 'source' AS origin FROM g_edges_old UNION ALL SELECT name, path, line, confidence, enclosing, root_id, 'macro_expanded' FROM m WHERE x IS NULL")
def sidecar_union_dedup(f):
    return sidecar.union(f["g_edges_old"], _side(f)).drop("mapped")


@query("dedup_stats", f"WITH {_KNOWN} SELECT count(CASE WHEN x THEN 1 END) AS merged_exact, count(CASE WHEN NOT x THEN 1 END) AS merged_heuristic, count(CASE WHEN x IS NULL AND mapped IS NOT NULL THEN 1 END) AS kept, count(CASE WHEN mapped IS NULL THEN 1 END) AS unmapped FROM m")
def dedup_stats(f):
    return sidecar.dedup_stats(f["g_edges_old"], _side(f))


# ---- graph view and export ----------------------------------------------------------------

_RANK = "CASE confidence WHEN 'exact' THEN 1 WHEN 'heuristic' THEN 2 ELSE 3 END"


@query("graph_nodes", f"SELECT id, CAST(min(k) AS INT) AS confidence_rank, count(*) AS degree FROM (SELECT name AS id, {_RANK} AS k FROM g_refs UNION ALL SELECT enclosing, {_RANK} FROM g_refs WHERE coalesce(enclosing, '') <> '') x GROUP BY id")
def graph_nodes(f):
    from graphloom.operators.graphview import nodes

    return nodes(f["g_refs"]).select("id", "confidence_rank", "degree")


@query("graph_edges", f"SELECT source, target, CAST(min(k) AS INT) AS confidence_rank, count(*) AS n FROM (SELECT enclosing AS source, name AS target, {_RANK} AS k FROM g_refs WHERE coalesce(enclosing, '') <> '') x GROUP BY 1, 2")
def graph_edges(f):
    from graphloom.operators.graphview import edges

    return edges(f["g_refs"]).select("source", "target", "confidence_rank", "n")


@query("scip_descriptor", """SELECT qualified_name, CASE WHEN coalesce(parent, '') <> '' THEN parent || '#' ELSE '' END || CASE WHEN kind IN ('function','method') THEN name || '().' WHEN kind IN ('class','interface','type_alias','struct','enum','trait') THEN name || '#' WHEN kind = 'module' THEN name || '/' ELSE name || '.' END AS descriptor, count(*) AS n FROM g_symbols GROUP BY 1, 2""")
def scip_descriptor(f):
    return f["g_symbols"].groupBy("qualified_name", e.scip_descriptor().alias("descriptor")).agg(F.count(F.lit(1)).alias("n"))


# ---- metrics ------------------------------------------------------------------------------


@query("recall_noise_precision", """WITH t AS (SELECT o_custkey AS task, list(DISTINCT l_partkey % 40) FILTER (WHERE l_linenumber <= 3) AS found, list(DISTINCT l_partkey % 40) FILTER (WHERE l_linenumber >= 2) AS expected FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
s AS (SELECT task, list_sort(coalesce(found, [])) AS found, coalesce(expected, []) AS expected FROM t)
SELECT task, CASE WHEN len(expected) > 0 THEN len(list_intersect(found, expected)) / len(expected) ELSE 1.0 END AS recall, CAST(len(list_filter(found, lambda x: NOT list_contains(expected, x))) AS BIGINT) AS extra_noise, CASE WHEN len(found) > 0 THEN len(list_intersect(found[1:5], expected)) / len(found[1:5]) ELSE 0.0 END AS precision_at_k FROM s""")
def recall_noise_precision(f):
    k = F.col("l_partkey") % 40
    rows = f["orders"].join(f["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"))
    tasks = rows.groupBy(F.col("o_custkey").alias("task")).agg(F.array_sort(F.collect_set(F.when(F.col("l_linenumber") <= 3, k))).alias("found"), F.collect_set(F.when(F.col("l_linenumber") >= 2, k)).alias("expected"))
    return metrics.file_set_scores(tasks, 5)


@query("golden_recall", """WITH g AS (SELECT 'c' || CAST(p_size % 10 AS STRING) AS corpus, 'P' || CAST(p_partkey AS STRING) AS symbol, 'supplier/S' || CAST(p_size AS STRING) AS site_file, 1 AS site_line FROM part), b AS (SELECT name, path, line, max(CASE WHEN confidence = 'exact' THEN 1 ELSE 0 END) AS x FROM g_refs WHERE confidence IN ('exact','heuristic') GROUP BY 1, 2, 3)
SELECT corpus, count(*) AS golden, count(CASE WHEN x = 1 THEN 1 END) AS found_exact, count(x) AS found_default FROM g LEFT JOIN b ON b.name = g.symbol AND b.path = g.site_file AND b.line = g.site_line GROUP BY corpus""")
def golden_recall(f):
    g = f["part"].select(F.concat(F.lit("c"), (F.col("p_size") % 10).cast("string")).alias("corpus"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.concat(F.lit("supplier/S"), F.col("p_size").cast("string")).alias("site_file"), F.lit(1).alias("site_line"))
    return metrics.golden_recall(g, f["g_refs"])


@query("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max, count(value) AS n FROM events GROUP BY 1")
def latency_percentiles(f):
    return metrics.percentiles(f["events"].where("value IS NOT NULL"), "event_type", "value")


@query("heuristic_rule_counts", "SELECT confidence, coalesce(rule_id, '-') AS rule_id, count(*) AS n FROM g_refs GROUP BY 1, 2")
def heuristic_rule_counts(f):
    return metrics.rule_counts(f["g_refs"])


@query("heuristic_top_names", "SELECT name, coalesce(rule_id, '-') AS rule_id, count(*) AS n FROM g_refs WHERE confidence = 'heuristic' GROUP BY 1, 2 ORDER BY n DESC, name, rule_id LIMIT 25")
def heuristic_top_names(f):
    return metrics.top_heuristic_names(f["g_refs"])


@query("top_inbound", "SELECT name, count(*) AS n FROM g_refs GROUP BY 1 ORDER BY n DESC, name LIMIT 20")
def top_inbound(f):
    return metrics.top_inbound(f["g_refs"])


@query("trace_recall_gap", """WITH t AS (SELECT DISTINCT 'O' || CAST(l_orderkey AS STRING) AS f, 'P' || CAST((l_partkey + l_linenumber % 2) % 2000 AS STRING) AS t FROM lineitem), s AS (SELECT DISTINCT enclosing, name FROM g_refs WHERE kind = 'call' AND enclosing IS NOT NULL), g AS (SELECT DISTINCT 'O' || CAST(o_orderkey AS STRING) AS f, 'P' || CAST(o_custkey AS STRING) AS t FROM orders)
SELECT 'crate::' || f AS "from", 'crate::' || t AS "to" FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.enclosing = t.f AND s.name = t.t) AND NOT EXISTS (SELECT 1 FROM g WHERE g.f = t.f AND g.t = t.t)""")
def trace_recall_gap(f):
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    part = (F.col("l_partkey") + F.col("l_linenumber") % 2) % 2000
    trace = f["lineitem"].select(name("crate::O", F.col("l_orderkey")).alias("from"), name("crate::P", part).alias("to"))
    ledger = f["orders"].select(name("O", F.col("o_orderkey")).alias("from"), name("P", F.col("o_custkey")).alias("to"))
    return metrics.trace_gap(trace, f["g_refs"], ledger)


@query("debounce_sessions", """WITH o AS (SELECT user_id, event_type, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, min(ts) AS started, count(*) AS n, count(DISTINCT event_type) AS paths FROM g GROUP BY user_id, s""")
def debounce_sessions(f):
    from graphloom.streaming.watch import sessions

    return sessions(f["events"], "user_id", "ts", "event_type", "30 minutes").select("user_id", "started", "n", F.size("paths").cast("long").alias("paths"))


