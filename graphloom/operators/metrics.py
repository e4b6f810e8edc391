"""Evaluation metrics: file sets, edges, latencies, rule statistics, trace checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import exprs as e


def file_set_scores(tasks: DataFrame, k: int = 5) -> DataFrame:
    """recall, extra_noise and precision_at_k of each task.

    ``tasks`` (task, found array, expected array, noise array), found best first.
    """
    hit = F.size(F.array_intersect("found", "expected"))
    first = F.slice(F.array_distinct("found"), 1, k)
    return tasks.select(
        "task",
        F.when(F.size("expected") > 0, hit / F.size("expected")).otherwise(F.lit(1.0)).alias("recall"),
        F.size(F.array_except("found", "expected")).cast("long").alias("extra_noise"),
        F.when(F.size(first) > 0, F.size(F.array_intersect(first, F.col("expected"))) / F.size(first)).otherwise(F.lit(0.0)).alias("precision_at_k"),
    )


def golden_recall(golden: DataFrame, refs: DataFrame) -> DataFrame:
    """Per corpus: golden edges, and how many are found exactly and in the default window."""
    key = ["symbol", "site_file", "site_line"]
    edges = refs.select(F.col("name").alias("symbol"), F.col("path").alias("site_file"), F.col("line").alias("site_line"), "confidence").where(e.in_window("default"))
    best = edges.groupBy(*key).agg(F.max((F.col("confidence") == "exact").cast("int")).alias("_exact"))
    rows = golden.join(best, key, "left")
    return rows.groupBy("corpus").agg(F.count(F.lit(1)).alias("golden"), F.count(F.when(F.col("_exact") == 1, 1)).alias("found_exact"), F.count("_exact").alias("found_default"))


def percentiles(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Nearest-rank p50, p95, p99 and max of each group."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return samples.groupBy(by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max(value).alias("max"), F.count(F.lit(1)).alias("n"))


def rule_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("confidence", F.coalesce("rule_id", F.lit("-")).alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))


def top_heuristic_names(refs: DataFrame, most: int = 25) -> DataFrame:
    return refs.where("confidence = 'heuristic'").groupBy("name", F.coalesce("rule_id", F.lit("-")).alias("rule_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name", "rule_id").limit(most)


def top_inbound(refs: DataFrame, most: int = 20) -> DataFrame:
    return refs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most)


def trace_gap(trace: DataFrame, refs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Traced calls (from, to) that neither the static edges nor the ledger of known gaps has.

    A static edge fits by the last segments of both sides, or by the whole left side.
    """
    seg = lambda c: F.substring_index(c, "::", -1)
    t = trace.select("from", "to").distinct().withColumn("_f", seg("from")).withColumn("_t", seg("to"))
    static = refs.where("kind = 'call' AND enclosing IS NOT NULL").select(F.col("enclosing"), F.col("name").alias("_t")).distinct()
    short = static.select(e.last_segment("enclosing").alias("_f"), "_t").distinct()
    whole = static.select(F.col("enclosing").alias("from"), "_t").distinct()
    left = t.join(short, ["_f", "_t"], "left_anti").join(whole, ["from", "_t"], "left_anti")
    gap = ledger.select(seg("from").alias("_f"), seg("to").alias("_t")).distinct()
    return left.join(gap, ["_f", "_t"], "left_anti").select("from", "to")


def missing_edges(observed: DataFrame, closed: DataFrame) -> DataFrame:
    """Observed edges (a, b) outside a closure: empty if the closure covers them."""
    return observed.join(closed, ["a", "b"], "left_anti")
