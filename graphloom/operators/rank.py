"""Related files, file scores and budgeted selection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import exprs as e
from graphloom.operators.lookup import PLACE, callers, top

BUDGET = 5
MOST_SELECTED = 4


def related_files(symbols: DataFrame, refs: DataFrame, queries: DataFrame, limit: int = 10, aliases: DataFrame | None = None) -> DataFrame:
    """Files related to each query: query, path, score, reason, best first.

    +10 per definition, +3 per import row of a defining file (per definition, at most
    10 * limit each), +1 per caller row (at most 20 * limit) and, with ``aliases``, +2 per
    import of a package whose root defines the name. A definition's reason outranks an
    import's, that a caller's.
    """
    q = queries.select("query").distinct()
    by_name = q.join(symbols, F.col("query") == F.col("name"))
    by_qual = q.join(symbols, F.col("query") == F.col("qualified_name")).where(F.col("query") != F.col("name"))
    defs = by_name.unionByName(by_qual).select("query", "path", "kind", "description", "root_id", "start_line")
    label = F.concat(F.lit("definition:"), "kind", F.when(F.col("description").isNotNull(), F.lit("+llm")).otherwise(F.lit("")))
    one = defs.groupBy("query", "path").agg((F.count(F.lit(1)) * 10).alias("score"), F.max_by(label, F.struct("start_line", "kind")).alias("reason"), F.count(F.lit(1)).alias("defs")).withColumn("tier", F.lit(0))
    # The first rows of a file are the same for every query, so they are cut and counted before the join.
    imports = top(refs.where("kind = 'import' AND resolved IS NOT NULL").select("resolved", *PLACE), ["resolved"], [F.col(c) for c in PLACE], 10 * limit)
    imports = imports.groupBy("resolved", F.col("path").alias("_by")).agg(F.count(F.lit(1)).alias("rows"))
    hit = one.select("query", F.col("path").alias("resolved"), "defs").join(imports, "resolved").withColumnRenamed("_by", "path")
    two = hit.groupBy("query", "path").agg((F.sum(F.col("defs") * F.col("rows")) * 3).alias("score"), F.concat(F.lit("imports:"), F.min("resolved")).alias("reason")).withColumn("tier", F.lit(1))
    calls = callers(refs, q, "default", 20 * limit)
    three = calls.groupBy("query", "path").agg(F.count(F.lit(1)).alias("score"), F.concat(F.lit("reference:"), F.min_by("kind", "rank")).alias("reason")).withColumn("tier", F.lit(2))
    parts = one.drop("defs").unionByName(two).unionByName(three)
    if aliases is not None:
        homes = defs.where("root_id <> ''").select("query", "root_id").distinct().join(aliases.select("package", "root_id"), "root_id")
        below = refs.where("kind = 'import'").withColumn("_p", e.package_of("module"))
        four = homes.join(below.drop("root_id"), F.col("package") == F.col("_p")).groupBy("query", "path").agg((F.count(F.lit(1)) * 2).alias("score"), F.concat(F.lit("package_import:"), F.min("package")).alias("reason")).withColumn("tier", F.lit(3))
        parts = parts.unionByName(four)
    total = parts.groupBy("query", "path").agg(F.sum("score").cast("long").alias("score"), F.min_by("reason", "tier").alias("reason"))
    return top(total, ["query"], [F.desc("score"), F.col("path")], limit)


def file_scores(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The best candidate of each path in each group: score, exact_call, stem, directory."""
    scored = candidates.withColumn("path", F.regexp_replace("path", r"\\", "/")).withColumn("total", e.candidate_score())
    exact = F.coalesce(F.col("edge_role").isin("call", "import", "define"), F.lit(False)) & (F.col("depth") <= 1)
    best = scored.withColumn("exact_call", exact).groupBy(*by, "path").agg(F.max(F.struct("total", "exact_call", "root_id")).alias("b"))
    rows = best.select(*by, "path", F.col("b.total").alias("score"), F.col("b.exact_call").alias("exact_call"), F.col("b.root_id").alias("root_id"))
    parts = e.segments("path")
    return rows.select("*", e.base_stem("path").alias("stem"), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/").alias("dir"), e.hard_decoy().alias("hard"), e.real_source_path().alias("real"), (e.path_penalty("path") >= 8.0).alias("low"))


SELECTION = "path string, score double, place int, selected boolean, why string"


def fold(rows: list[dict], budget: int) -> Iterator[tuple[bool, str]]:
    """The verdict on each file of one group, best first. What was chosen decides what may follow."""
    chosen, decoys, dirs = 0, 0, {}
    best: dict[str, str] = {}
    for r in rows:
        best.setdefault(r["stem"], r["path"])
    for r in rows:
        decoy = r["low"] and not r["exact_call"]
        if not r["real"]:
            why = "not_a_file"
        elif r["hard"] and not (r["exact_call"] and not chosen):
            why = "decoy_dir"
        elif dirs.get(r["dir"], 0) >= 2:
            why = "dir_full"
        elif decoy and decoys:
            why = "second_decoy"
        elif best[r["stem"]] != r["path"]:
            why = "same_basename"
        elif chosen >= min(budget, MOST_SELECTED):
            why = "budget"
        else:
            chosen += 1
            decoys += decoy
            dirs[r["dir"]] = dirs.get(r["dir"], 0) + 1
            yield True, "selected"
            continue
        yield False, why


def select_files(candidates: DataFrame, by: list[str], budget: int = BUDGET) -> DataFrame:
    """Budgeted selection per group: path, score, place, selected, why.

    ``candidates`` (by.., path, score, edge_role, depth, root_id). Scores are columns; only the
    sequential choice runs in Python, over one group's distinct paths. A group is one query's
    answer, which its limit bounds.
    """
    budget = max(1, budget)
    kinds = dict(candidates.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "path"], ascending=[False, True])
        got = list(fold(pdf.to_dict("records"), budget))
        return pdf[[*by, "path", "score"]].assign(place=range(1, len(pdf) + 1), selected=[x for x, _ in got], why=[w for _, w in got])

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + SELECTION
    return file_scores(candidates, by).groupBy(*by).applyInPandas(run, schema)


def selection(rows: list, budget: int = BUDGET) -> dict:
    """The payload of one group's selection."""
    picked = [r["path"] for r in sorted(rows, key=lambda r: r["place"]) if r["selected"]]
    left = [r["path"] for r in sorted(rows, key=lambda r: r["place"]) if not r["selected"]]
    reason = "empty_candidates" if not rows else f"all_{len(picked)}_files_within_budget_{budget}" if not left else f"precision_budget_{budget}; pruned_{len(left)}"
    return {"file_budget": max(1, budget), "selected": picked, "pruned": left, "pruned_count": len(left), "selection_reason": reason}
