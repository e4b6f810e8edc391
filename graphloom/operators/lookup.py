"""Symbol lookup, callers, importers.

Every query takes a set of names: a DataFrame with a column ``query``. One job answers them
all; a single name is a set of one. A set is joined by name, so its side is broadcast by Spark
only when its measured size allows that, and rows are limited per name by a window that
shuffles by name after the join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import schema as s
from graphloom.functions import exprs as e
from graphloom.operators.link import wildcard_hits

#: The canonical order, with the ties that a place leaves open.
PLACE = ("root_id", "path", "line", "name", "kind", "confidence", "rule_id", "enclosing")


def names(spark: SparkSession, *queries: str) -> DataFrame:
    return spark.createDataFrame([(q,) for q in queries], "query string")


def top(rows: DataFrame, by: list[str], order: list[Column], limit: int | None, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each group, with their rank from 1."""
    got = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return got if limit is None else got.where(F.col(rank) <= limit)


#: A name with more rows than this is cut before its rows are shuffled.
COMMON = 100_000


def by_name(rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make`` of the rows, for a ``make`` that ranks the rows of each name and keeps the first.

    Spark can cut by rank before it shuffles, so that the rows of a very common name do not meet
    in one task, but for that it sorts whole splits of the input. So only the few names that are
    that common go that way; there can be no more of them than a :data:`COMMON` th of the rows.
    """
    common = F.broadcast(rows.groupBy("name").count().where(F.col("count") > COMMON).select("name"))
    return make(rows.join(common, "name", "left_anti").repartition("name")).unionByName(make(rows.join(common, "name", "left_semi")))


def in_root(rows: DataFrame, roots: list[str] | None) -> DataFrame:
    """One root filters; none, or several, do not."""
    return rows.where(F.col("root_id") == roots[0]) if roots and len(roots) == 1 else rows


def with_language(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return symbols.join(files.select("root_id", "path", "language"), ["root_id", "path"])


def find_exact(symbols: DataFrame, queries: DataFrame, limit: int = 20, roots: list[str] | None = None) -> DataFrame:
    """Symbols whose name or qualified name is a query; name matches come first."""
    rows = in_root(symbols, roots)
    by_name = queries.join(rows, F.col("query") == F.col("name")).withColumn("by_name", F.lit(0))
    by_qual = queries.join(rows, (F.col("query") == F.col("qualified_name")) & (F.col("query") != F.col("name"))).withColumn("by_name", F.lit(1))
    order = [F.col(c) for c in ("by_name", "root_id", "path", "start_line", "qualified_name", "kind")]
    return top(by_name.unionByName(by_qual), ["query"], order, limit).drop("by_name")


def find_fuzzy(symbols: DataFrame, text: str, limit: int = 20, roots: list[str] | None = None) -> DataFrame:
    """Symbols whose name contains ``text``, ASCII case ignored; no character is a wildcard."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.translate("name", upper, lower)
    hit = in_root(symbols, roots).where(low.contains(text.translate(str.maketrans(upper, lower))))
    return hit.orderBy("root_id", "path", "start_line", "name", "kind").limit(limit)


def find(symbols: DataFrame, name: str, limit: int = 20, roots: list[str] | None = None) -> DataFrame:
    """Exact matches, else fuzzy ones; a name without either is an error."""
    got = find_exact(symbols, names(symbols.sparkSession, name), limit, roots).drop("query", "rank")
    if not got.isEmpty():
        return got
    got = find_fuzzy(symbols, name, limit, roots)
    if got.isEmpty():
        raise LookupError(f"no symbol matches {name!r}")
    return got


def find_ranked(symbols: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Exact, qualified and containing matches in one list, in this order (tier 0, 1, 2)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tier = F.when(F.col("name") == text, 0).when(F.col("qualified_name") == text, 1).when(F.translate("name", upper, lower).contains(text.translate(str.maketrans(upper, lower))), 2)
    return symbols.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", "root_id", "path", "start_line", "name").limit(limit)


def keyed(queries: DataFrame) -> DataFrame:
    """query, bare, dotted: what a query matches by. Names are split as :func:`exprs.split_name` does."""
    q = F.col("query")
    colon, plain = q.contains("::"), q.rlike(r"^[\p{L}\p{N}_:]*\.[^.]*$")
    bare = F.when(colon, F.substring_index(q, "::", -1)).when(plain, F.substring_index(q, ".", -1)).otherwise(q)
    dotted = F.when(colon, F.concat(F.regexp_extract(q, "^(.*)::", 1), F.lit("."), F.substring_index(q, "::", -1))).when(plain, q)
    return queries.withColumn("bare", bare).withColumn("dotted", dotted)


def matches(refs: DataFrame, queries: DataFrame) -> DataFrame:
    """The refs of each query. A dotted query matches qualified names; a bare one, names.

    Two equi-joins instead of one join on an OR, which could only be a nested loop. The second
    is left out where no query is dotted.
    """
    k = keyed(queries)
    one = k.withColumn("key", F.coalesce("dotted", "bare")).select("query", "key", F.col("dotted").isNotNull().alias("qualified"))
    by_name = one.join(refs, F.col("key") == F.col("name")).drop("key", "qualified")
    if one.where("qualified").isEmpty():
        return by_name
    full = F.coalesce(F.col("qual_name"), F.concat("qualifier", F.lit("."), "name"))
    by_qual = one.where("qualified").join(refs.withColumn("_full", full), F.col("key") == F.col("_full")).where(F.col("key") != F.col("name")).drop("_full", "key", "qualified")
    return by_name.unionByName(by_qual)


def callers(refs: DataFrame, queries: DataFrame, window: str = "default", limit: int | None = 50, roots: list[str] | None = None) -> DataFrame:
    """The first ``limit`` refs of each query in canonical order.

    A bare query has the refs of its name, so these are ranked by name, before the join, and one
    shuffle by name serves both.
    """
    rows, order = in_root(refs.where(e.in_window(window)), roots), [F.col(c) for c in PLACE]
    base = keyed(queries.select("query").distinct())
    bare, dotted = base.where("dotted IS NULL").select("query"), base.where("dotted IS NOT NULL").select("query")
    got = by_name(rows, lambda x: bare.join(top(x, ["name"], order, limit), F.col("query") == F.col("name")))
    if dotted.isEmpty():
        return got
    return got.unionByName(top(matches(rows, dotted), ["query"], order, limit))


def callers_by_role(refs: DataFrame, queries: DataFrame, window: str = "default", limit: int = 50, roots: list[str] | None = None) -> DataFrame:
    """Call sites up to the limit, then all implementors: a flood of these starves no call site."""
    rows = in_root(refs.where(e.in_window(window)), roots)
    got = matches(rows, queries).withColumn("implementor", e.is_implementor())
    got = top(got, ["query", "implementor"], [F.col(c) for c in PLACE], None)
    return got.where(F.col("implementor") | (F.col("rank") <= max(limit, 1)))


def callers_counts(refs: DataFrame, queries: DataFrame, window: str = "default", limit: int = 50) -> DataFrame:
    """Per query: callers, implementors shown and in all, and whether implementors are cut."""
    got = callers_by_role(refs, queries, window, limit)
    cap = F.when(e.high_frequency("query"), F.least(F.lit(s.HIGH_FREQUENCY_CAP), F.lit(limit))).otherwise(F.lit(limit))
    counts = got.groupBy("query").agg(F.sum(F.when(~F.col("implementor"), 1).otherwise(0)).alias("callers"), F.sum(F.when(F.col("implementor"), 1).otherwise(0)).alias("implementor_count"))
    return counts.select("query", "callers", F.least("implementor_count", cap).cast("long").alias("implementors"), "implementor_count", (F.col("implementor_count") > cap).alias("implementors_truncated"))


def callers_payload(refs: DataFrame, name: str, window: str = "default", limit: int = 50, mode: str = "separate", roots: list[str] | None = None):
    """The callers answer as plain data. ``mode``: separate, include_implementors, implementors_only."""
    rows = [r.asDict() for r in callers_by_role(refs, names(refs.sparkSession, name), window, limit, roots).orderBy("implementor", "rank").collect()]
    shown = [{k: v for k, v in r.items() if k not in ("query", "rank", "implementor")} | {"at": f"{r['path']}:{r['line']}"} for r in rows]
    calls = [x for x, r in zip(shown, rows, strict=True) if not r["implementor"]]
    impl = [x for x, r in zip(shown, rows, strict=True) if r["implementor"]]
    cap = min(limit, s.HIGH_FREQUENCY_CAP) if name.lower() in s.HIGH_FREQUENCY else limit
    if mode == "implementors_only":
        return impl[:cap]
    if mode == "include_implementors":
        return (calls + impl)[:limit]
    if not impl:
        return calls[:limit]
    note = "Implementors are definitions reached through a trait or an interface, listed apart from call sites."
    return {"callers": calls[:limit], "implementors": impl[:cap], "implementor_count": len(impl), "implementors_truncated": len(impl) > cap, "truncated": len(calls) > limit, "note": note}


def callers_sound(refs: DataFrame, queries: DataFrame, limit: int = 50, roots: list[str] | None = None) -> DataFrame:
    """Sound edges only. The filter comes before the limit, which counts eligible rows."""
    return callers(refs.where(e.is_sound()), queries, "recall", limit, roots)


def importers_of_file(refs: DataFrame, paths: DataFrame, limit: int = 50) -> DataFrame:
    """Import rows that resolve to a path. ``paths`` has a column ``query``."""
    wanted = paths.withColumn("resolved", e.import_path("query"))
    return top(refs.where("kind = 'import'").join(wanted, "resolved"), ["query"], [F.col(c) for c in PLACE], limit)


def importers_of_package(refs: DataFrame, packages: DataFrame, aliases: DataFrame, limit: int = 50) -> DataFrame:
    """Imports of a package or a path below it, then those resolved to its barrel or alias.

    ``aliases`` (see schema.ALIASES) is the workspace's package table. Rows are told apart by
    (path, line, name); ``external_dependency`` marks rows that nothing in the workspace backs.
    """
    imports = refs.where("kind = 'import'")
    below = imports.withColumn("_key", F.explode(e.specifier_prefixes("module")))
    direct = packages.join(below, F.lower("query") == F.col("_key")).where((F.col("module") == F.col("query")) | F.lower("module").startswith(F.concat(F.lower("query"), F.lit("/")))).drop("_key").withColumn("tier", F.lit(0))
    # A query is an alias itself, or lies in a package that is one.
    asked = packages.select("query", F.posexplode(F.array("query", e.package_of("query"))).alias("pos", "package"))
    hit = asked.join(aliases, "package").groupBy("query").agg(F.min_by(F.struct("package", "root_id", "entry", "barrel"), "pos").alias("a")).select("query", "a.*")
    targets = hit.select("query", F.explode(F.array_compact(F.array("barrel", "entry", F.concat(F.lit("@alias:"), "package", F.lit("→"), F.col("root_id"))))).alias("resolved")).distinct()
    through = imports.join(targets, "resolved").withColumn("tier", F.lit(1))
    rows = direct.unionByName(through)
    once = top(rows, ["query", "path", "line", "name"], [F.col("tier"), *[F.col(c) for c in PLACE]], 1, "_first").drop("_first")
    got = top(once, ["query"], [F.col("tier"), *[F.col(c) for c in PLACE]], limit)
    return external_dependency(got, aliases)


def external_dependency(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mark imports of packages: not relative, unresolved, and behind no alias: neither the
    specifier, nor its package, nor the beginning of a wildcard."""
    modules = refs.where("module IS NOT NULL").select("module").distinct()
    keys = modules.withColumn("package", F.explode(F.array("module", e.package_of("module"))))
    known = keys.join(aliases.select("package").distinct(), "package", "left_semi").select("module").union(wildcard_hits(modules, aliases).select("module")).distinct()
    named = F.col("module").isNotNull()
    outside = e.is_external_module() & F.col("resolved").isNull() & F.col("_known").isNull()
    rows = refs.where(named).join(known.withColumn("_known", F.lit(True)), "module", "left").withColumn("external_dependency", F.coalesce(outside, F.lit(False))).select(*refs.columns, "external_dependency")
    return refs.where(~named).withColumn("external_dependency", F.lit(False)).unionByName(rows)


def one_hop_imports(refs: DataFrame, paths: DataFrame, most: int = 32) -> DataFrame:
    """Distinct files that each path imports, the first ``most`` by name."""
    rows = refs.where("kind = 'import' AND resolved IS NOT NULL AND resolved <> ''").join(paths.select(F.col("query").alias("path")), "path").select("path", "resolved").distinct()
    return top(rows, ["path"], [F.col("resolved")], most).drop("rank")


def undescribed(symbols: DataFrame, limit: int = 100) -> DataFrame:
    """Symbols that an enrichment run would describe next."""
    rows = symbols.where(F.col("kind").isin(*s.DESCRIBED_KINDS) & F.col("description").isNull())
    return rows.orderBy("root_id", "path", "start_line", "name", "kind").limit(limit)


def require_index(files: DataFrame) -> None:
    if files.isEmpty():
        raise LookupError("the index is empty: index a source tree first")
