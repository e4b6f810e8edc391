"""The soundness gate: violations, buckets, tiers and what they decide; index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.functions import exprs as e
from graphloom.operators.lookup import top


def subset_ok(violations: DataFrame, root: str | None = None) -> bool:
    rows = violations if root is None else violations.where(F.col("root_id") == root)
    return rows.isEmpty()


def stats(files: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: files, languages, symbols, described, refs. Three scans, each reduced to a row."""
    f = files.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("language").alias("languages"))
    d = symbols.agg(F.count(F.lit(1)).alias("symbols"), F.count("description").alias("described"))
    r = refs.agg(F.count(F.lit(1)).alias("refs"), *[F.count(F.when(F.col("confidence") == c, 1)).alias(f"refs_{c}") for c in s.CONFIDENCES])
    one = lambda x: x.withColumn("_one", F.lit(1))
    return one(f).join(one(d), "_one").join(one(r), "_one").drop("_one")


def refs_by_confidence(refs: DataFrame) -> DataFrame:
    return refs.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


def roots_status(files: DataFrame, symbols: DataFrame, refs: DataFrame, violations: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """Counts by root, refs by confidence, languages and tier; recorded roots without rows are
    ``missing``. Each table is aggregated by root before the few roots are joined."""
    n = lambda df, name: df.groupBy("root_id").agg(F.count(F.lit(1)).alias(name))
    f = files.groupBy("root_id").agg(F.count(F.lit(1)).alias("files"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    r = refs.groupBy("root_id").agg(F.count(F.lit(1)).alias("refs"), *[F.count(F.when(F.col("confidence") == c, 1)).alias(c) for c in s.CONFIDENCES])
    out = f
    for part in (n(symbols, "symbols"), r, n(violations, "violations")):
        out = out.join(part, "root_id", "full_outer")
    if recorded is not None:
        out = out.join(recorded.select("root_id"), "root_id", "full_outer")
    counts = ["files", "symbols", "refs", *s.CONFIDENCES, "violations"]
    out = out.select("root_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("languages", F.lit("")).alias("languages"))
    return out.withColumn("missing", F.col("files") == 0).withColumn("tier", F.when(F.col("violations") == 0, F.lit("ast_modeled")).otherwise(F.lit("disabled")))


def weakest_root(status: DataFrame) -> DataFrame:
    """The root with most violations, the first by name among equals; none if all are clean."""
    return status.where("violations > 0").orderBy(F.desc("violations"), "root_id").limit(1).select("root_id", "violations")


def violation_counts(violations: DataFrame, by: str = "root_id") -> DataFrame:
    return violations.groupBy(by, "kind").agg(F.count(F.lit(1)).alias("n"))


def top_kinds(violations: DataFrame, by: str = "root_id", most: int = 5) -> DataFrame:
    """The ``most`` frequent kinds of each bucket: bucket, kind, n, rank."""
    return top(violation_counts(violations, by), [by], [F.desc("n"), F.col("kind")], most)


def buckets(files: DataFrame, violations: DataFrame, by: str = "root") -> DataFrame:
    """Buckets by root or top directory: count, kinds, eligible. Clean buckets appear too."""
    key = (lambda: e.shown_root()) if by == "root" else (lambda: e.top_dir("path"))
    keys = files.select(key().alias("bucket")).distinct()
    counts = violations.select(key().alias("bucket"), "kind").groupBy("bucket", "kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = top(counts, ["bucket"], [F.desc("n"), F.col("kind")], 5).groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "kind"))), lambda x: x["kind"]), ",").alias("top_kinds"))
    total = counts.groupBy("bucket").agg(F.sum("n").alias("violations"))
    rows = keys.join(total, "bucket", "full_outer").join(kinds, "bucket", "left")
    return rows.select("bucket", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"), F.coalesce("top_kinds", F.lit("")).alias("top_kinds"), F.col("violations").isNull().alias("eligible"))


def sound_candidates(found: DataFrame) -> DataFrame:
    """Eligible buckets first, then by name."""
    return found.orderBy(F.desc("eligible"), "bucket")


def window_for(clean: bool) -> str:
    """A clean gate walks sound edges; otherwise the default window, never recall."""
    return "sound" if clean else "default"


def edge_roles(refs: DataFrame) -> DataFrame:
    return refs.groupBy(e.edge_role().alias("edge_role")).agg(F.count(F.lit(1)).alias("n"))


def sound_classes(refs: DataFrame) -> DataFrame:
    return refs.groupBy(e.sound_class().alias("sound_class")).agg(F.count(F.lit(1)).alias("n"))


def guidance(clean: bool, root: str | None, found: list[dict]) -> dict:
    """What to run next, given the gate's state and its buckets."""
    eligible = [b["bucket"] for b in found if b["eligible"]]
    if clean:
        return {"window": "sound", "recommendation": "The gate is clean; sound walks cover the modelled subset.", "example": "impact NAME --sound"}
    if eligible:
        return {"window": "default", "recommendation": f"Narrow the question to a clean part: {', '.join(eligible[:5])}.", "example": f"impact NAME --root {eligible[0]} --sound"}
    where = f" in {root}" if root else ""
    return {"window": "default", "recommendation": f"No part{where} is clean; answers use the default window.", "example": "impact NAME"}
