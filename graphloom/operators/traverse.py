"""Bounded transitive impact, many sources at once, and transitive closure.

The walk is by levels: the driver loops over depths, never over rows. Per level one join
finds the refs of the frontier, and windows reproduce first-in first-out order, which decides
both the language gate and the limit. Visited names are anti-joined; each level but the last is
a table in the shared folder, so plans do not grow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import exprs as e
from graphloom.operators.lookup import PLACE, by_name, in_root, keyed, matches, top
from graphloom.session import written

COLUMNS = ("query", "depth", "name", "kind", "path", "line", "root_id", "enclosing", "resolved", "confidence", "rule_id")


def doors(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """The names that a walk can come to: those asked for, and those that an edge leads on to."""
    start = asked.select(F.col("query").alias("name"), F.lit(True).alias("asked"), F.lit(False).alias("entered"))
    on = edges.where("leaf <> ''").select(F.col("leaf").alias("name"), F.lit(False).alias("asked"), F.lit(True).alias("entered"))
    return start.unionByName(on).groupBy("name").agg(F.max("asked").alias("asked"), F.max("entered").alias("entered"))


def gate_languages(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """name, spoken: the languages of the files that define a name. Files are joined on the path
    alone, so a like path in another root opens the gate too."""
    by_path = files.select("path", "language").distinct()
    return symbols.select("name", "path").join(by_path, "path", "left").groupBy("name").agg(F.collect_set("language").alias("spoken"))


def placed(edges: DataFrame, limit: int) -> DataFrame:
    """Of each name the first edge of each of its first ``limit`` places, numbered from 1 by ``n``.

    A place is a line of a file. Its edges follow each other in the canonical order, so a rank of
    places is enough. One shuffle by name serves all windows here.
    """
    by_place = ["root_id", "path", "line"]
    got = edges.withColumn("n", F.dense_rank().over(Window.partitionBy("name").orderBy(*by_place))).where(F.col("n") <= limit)
    return top(got, ["name", *by_place], [F.col(c) for c in PLACE[4:]], 1, "_first").drop("_first").withColumn("n", F.col("n").cast("long"))


def onward(hits: DataFrame, by: str) -> DataFrame:
    """Add ``left`` (the room after these hits of a query) and ``first`` (the first of its leaf)."""
    left = F.col("room") - F.count(F.lit(1)).over(Window.partitionBy(by))
    return hits.withColumn("left", left).withColumn("first", F.row_number().over(Window.partitionBy(by, "leaf").orderBy("at")) == 1)


def impact(refs: DataFrame, symbols: DataFrame, files: DataFrame, queries: DataFrame, depth: int = 2, limit: int = 100, window: str = "default", roots: list[str] | None = None, sound: bool = False, gated: bool = True) -> DataFrame:
    """What each query reaches backwards, with depth, in walk order (``rank`` from 1).

    A name is marked visited before the gate is asked, so a name first met from a file of
    another language stays closed. The limit counts emitted rows of a query: rows beyond it are
    dropped level by level, and a query that is full leaves the walk.

    Which edges of a name count, and in what order, is the same for every query, so that is
    settled once in a table of steps. For queries of a bare name the first level is a part of
    this table. Later levels join the narrow frontier with the steps whose name an edge leads on
    to, and shuffle the hits once, by query. A place can only be met twice by a qualified
    query, whose first hits have another name than the query; the others need no check.
    """
    edges = in_root(refs.where(e.is_sound() if sound else e.in_window(window)), roots).withColumn("leaf", e.last_segment("enclosing"))
    base = keyed(queries.select("query").distinct())
    bare, dotted = base.where("dotted IS NULL").select("query"), base.where("dotted IS NOT NULL").select("query")
    names = doors(edges, bare)
    edges = edges.select("name", "kind", "path", "line", "root_id", "enclosing", "resolved", "confidence", "rule_id", "qualifier", "qual_name", "leaf")
    one_language = files.groupBy("path").agg(F.min("language").alias("cited"))
    edges = edges.join(one_language, "path", "left") if gated else edges.withColumn("cited", F.lit(None).cast("string"))
    spoken = gate_languages(symbols, files) if gated else None

    def settled(rows: DataFrame) -> DataFrame:
        got = placed(rows, limit).join(names, "name")
        got = got.join(spoken, "name", "left") if gated else got.withColumn("spoken", F.lit(None).cast("array<string>"))
        return onward(got.withColumn("at", F.col("n")).withColumn("room", F.lit(limit).cast("long")), "name")

    steps = by_name(edges.drop("qualifier", "qual_name"), settled)
    steps = written(steps, "steps")
    kept = [*COLUMNS, "cited", "leaf", "at", "room", "left", "first"]
    levels = [steps.where("asked").withColumn("query", F.col("name")).withColumn("depth", F.lit(1)).select(*kept)]
    place, seen = ["query", "root_id", "name", "line", "path"], None
    if not dotted.isEmpty():
        order = [F.col(c) for c in PLACE]
        hits = top(matches(edges, dotted), place, order, 1, "_first").drop("_first")
        hits = top(hits, ["query"], order, limit, "at").withColumn("at", F.col("at").cast("long")).withColumn("room", F.lit(limit).cast("long"))
        hits = written(onward(hits, "query").withColumn("depth", F.lit(1)).select(*kept), "hits")
        levels[0] = levels[0].unionByName(hits)
        seen = hits.select(*place)
    ahead = steps.where("entered").select(*[c for c in COLUMNS if c not in ("query", "depth")], "cited", "leaf", "n", "spoken")
    for level in range(2, depth + 1):
        fresh = levels[-1].where("first AND leaf <> '' AND leaf <> query AND left > 0")
        frontier = fresh.select("query", F.col("leaf").alias("_leaf"), F.col("cited").alias("_cited"), F.col("at").alias("ord"), F.col("left").alias("room"))
        for earlier in levels[:-1]:
            known = earlier.where("first AND leaf <> '' AND left > 0").select("query", F.col("leaf").alias("_leaf"))
            frontier = frontier.join(known, ["query", "_leaf"], "left_anti")
        hits = frontier.join(ahead, F.col("_leaf") == F.col("name"))
        if gated:
            hits = hits.where(F.col("spoken").isNotNull() & (F.col("_cited").isNull() | F.array_contains("spoken", F.col("_cited"))))
        hits = hits.drop("_leaf", "_cited", "spoken")
        if seen is not None:
            hits = hits.join(seen, place, "left_anti")
        hits = top(hits, ["query"], [F.col("ord"), F.col("n")], limit, "at").where(F.col("at") <= F.col("room")).withColumn("at", F.col("at").cast("long")).withColumn("depth", F.lit(level))
        if level == depth:
            levels.append(hits)
            break
        hits = written(onward(hits, "query").select(*kept), "hits")
        levels.append(hits)
        if hits.isEmpty():
            break
    rank = (F.col("at") + F.lit(limit) - F.col("room")).cast("int").alias("rank")
    out = reduce(DataFrame.unionByName, [x.select(*COLUMNS, rank) for x in levels])
    return out.withColumn("edge_role", e.edge_role())


def closure(edges: DataFrame, defined: DataFrame, most: int = 64) -> DataFrame:
    """Pairs (a, b) such that b can be called from a through defined names.

    ``edges`` (caller, callee), ``defined`` (name). Paths double each round, so rounds grow
    with the logarithm of the longest chain. A round joins what the last one found to all pairs
    behind it, and then older pairs to it, so no two pairs are joined twice. Only pairs that can
    go on are joined: ``into`` says that a is called, ``on`` that b calls. Pairs of a round are
    written once and never again.
    """
    said = [defined.select("name", F.lit(True).alias("known"), F.lit(False).alias("calls"), F.lit(False).alias("called"))]
    said += [edges.select(F.col(c).alias("name"), F.lit(False), F.lit(c == "caller"), F.lit(c == "callee")) for c in ("caller", "callee")]
    nodes = reduce(DataFrame.union, said).groupBy("name").agg(*[F.max(c).alias(c) for c in ("known", "calls", "called")]).where("known")
    ok = edges.distinct().join(nodes.select(F.col("name").alias("callee"), F.col("calls").alias("on")), "callee").join(nodes.select(F.col("name").alias("caller"), F.col("called").alias("into")), "caller")
    rounds = [written(ok.select(F.col("caller").alias("a"), F.col("callee").alias("b"), "into", "on"), "paths")]
    for _ in range(most):
        fresh, older, paths = rounds[-1], rounds[:-1], reduce(DataFrame.union, rounds)
        if fresh.where("into OR on").isEmpty():
            break
        after = paths.where("into").select(F.col("a").alias("m"), F.col("b").alias("z"), F.col("on").alias("zon"))
        found = fresh.where("on").select("a", F.col("b").alias("m"), "into").join(after, "m").select("a", "z", "into", "zon")
        if older:
            before = reduce(DataFrame.union, older).where("on").select(F.col("a").alias("w"), F.col("b").alias("m"), F.col("into").alias("win"))
            found = found.union(fresh.where("into").select(F.col("a").alias("m"), "b", "on").join(before, "m").select("w", "b", "win", "on"))
        # One shuffle makes pairs distinct and drops those that are known.
        tagged = found.toDF("a", "b", "into", "on").withColumn("new", F.lit(True)).union(paths.withColumn("new", F.lit(False)))
        got = tagged.groupBy("a", "b").agg(F.max("into").alias("into"), F.max("on").alias("on"), F.min("new").alias("new"))
        rounds.append(written(got.where("new").drop("new"), "paths"))
    return reduce(DataFrame.union, rounds).select("a", "b")
