"""Snapshot edge diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ORDER = ("name", "path", "line", "confidence")


def keyed(edges: DataFrame, exact_only: bool = False) -> DataFrame:
    rows = edges.where("confidence = 'exact'") if exact_only else edges
    return rows.withColumn("_enclosing", F.coalesce("enclosing", F.lit("")))


def missing_from(left: DataFrame, right: DataFrame, exact_only: bool = False) -> DataFrame:
    """Rows of ``left`` whose edge ``right`` does not have. It is a bag: repeated rows stay."""
    on = [*ORDER, "_enclosing"]
    known = keyed(right, exact_only).select(*on).distinct()
    return keyed(left, exact_only).join(known, on, "left_anti").select(*left.columns)


def added(old: DataFrame, new: DataFrame, exact_only: bool = False) -> DataFrame:
    return missing_from(new, old, exact_only)


def removed(old: DataFrame, new: DataFrame, exact_only: bool = False) -> DataFrame:
    return missing_from(old, new, exact_only)


def ordered(rows: DataFrame, limit: int | None = None) -> DataFrame:
    got = rows.orderBy(*ORDER, F.asc_nulls_first("enclosing"), "root_id")
    return got if limit is None else got.limit(limit)


def summary(old: DataFrame, new: DataFrame, exact_only: bool = False) -> DataFrame:
    """One row: added, removed, old_edges, new_edges. Limits never touch these counts.

    One shuffle: both sides are counted by key, and a key's rows are new or gone if the other
    side has none.
    """
    tag = lambda df, a, b: keyed(df, exact_only).select(*ORDER, "_enclosing", F.lit(a).alias("o"), F.lit(b).alias("n"))
    keys = tag(old, 1, 0).union(tag(new, 0, 1)).groupBy(*ORDER, "_enclosing").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    return keys.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name) for x, name in ((F.when(F.col("o") == 0, F.col("n")), "added"), (F.when(F.col("n") == 0, F.col("o")), "removed"), (F.col("o"), "old_edges"), (F.col("n"), "new_edges"))])


def same_edges(a: DataFrame, b: DataFrame) -> bool:
    """Equal length and equal key sets."""
    r = summary(a, b).first()
    return r["old_edges"] == r["new_edges"] and not r["added"] and not r["removed"]


def choose_baseline(live: DataFrame, latest: DataFrame | None, previous: DataFrame | None) -> DataFrame:
    """The snapshot before the latest if nothing changed since the latest; else the latest."""
    if latest is None:
        raise LookupError("there is no snapshot to compare with")
    if previous is not None and same_edges(live, latest):
        return previous
    return latest


def edges_of(refs: DataFrame) -> DataFrame:
    return refs.select("name", "path", "line", "confidence", "enclosing", "root_id")


def report(old: DataFrame, new: DataFrame, limit: int = 100, exact_only: bool = False, stale: bool = False) -> dict:
    s = summary(old, new, exact_only).first().asDict()
    rows = lambda df: [r.asDict() | {"at": f"{r['path']}:{r['line']}"} for r in ordered(df, limit).collect()]
    return {"summary": {"added": s["added"], "removed": s["removed"]}, "added": rows(added(old, new, exact_only)), "removed": rows(removed(old, new, exact_only)), "baseline_stale": stale}


