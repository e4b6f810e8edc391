"""The node and edge view of a reference graph, and its HTML page."""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.functions import exprs as e

MOST_NODES = 300


def ends(refs: DataFrame) -> DataFrame:
    """Both ends of each edge; a missing enclosing gives only the target."""
    k = e.confidence_rank()
    root = F.col("root_id") if "root_id" in refs.columns else F.lit("")
    target = refs.select(F.col("name").alias("id"), k.alias("k"), "path", root.alias("root_id"))
    source = refs.where("coalesce(enclosing, '') <> ''").select(F.col("enclosing").alias("id"), k.alias("k"), "path", root.alias("root_id"))
    return target.unionByName(source)


def nodes(refs: DataFrame) -> DataFrame:
    """id, confidence_rank (the tightest), degree, and the least path and root."""
    return ends(refs).groupBy("id").agg(F.min("k").alias("confidence_rank"), F.count(F.lit(1)).alias("degree"), F.min(F.struct("path", "root_id")).alias("home")).select("id", "confidence_rank", "degree", F.col("home.path").alias("path"), F.col("home.root_id").alias("root_id"))


def edges(refs: DataFrame) -> DataFrame:
    """source -> target with the tightest confidence and the number of refs."""
    rows = refs.where("coalesce(enclosing, '') <> ''").select(F.col("enclosing").alias("source"), F.col("name").alias("target"), e.confidence_rank().alias("k"), e.edge_role().alias("role"))
    return rows.groupBy("source", "target").agg(F.min("k").alias("confidence_rank"), F.count(F.lit(1)).alias("n"), F.min("role").alias("role"))


def merged(*graphs: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Graphs in one: nodes keep their tightest confidence, edges their first occurrence."""
    n = graphs[0][0].withColumn("_g", F.lit(0))
    m = graphs[0][1].withColumn("_g", F.lit(0))
    for i, (x, y) in enumerate(graphs[1:], 1):
        n, m = n.unionByName(x.withColumn("_g", F.lit(i))), m.unionByName(y.withColumn("_g", F.lit(i)))
    n = n.groupBy("id").agg(F.min("confidence_rank").alias("confidence_rank"), F.max("degree").alias("degree"), F.min_by("path", "_g").alias("path"), F.min_by("root_id", "_g").alias("root_id"))
    m = m.groupBy("source", "target").agg(*[F.min_by(c, "_g").alias(c) for c in ("confidence_rank", "n", "role")])
    return n, m


def view(nodes: DataFrame, edges: DataFrame, centre: str, most: int = MOST_NODES) -> dict:
    """At most ``most`` nodes, the best connected, with the edges between them, as plain data."""
    kept = nodes.orderBy(F.desc(F.col("id") == centre), F.desc("degree"), "id").limit(most)
    rows = [r.asDict() for r in kept.collect()]
    ids = kept.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    links = [r.asDict() for r in inner.orderBy("source", "target").collect()]
    return {"centre": centre, "nodes": [r | {"confidence": s.CONFIDENCES[r["confidence_rank"] - 1], "label": _label(r["id"])} for r in rows], "edges": links}


def _label(text: str, most: int = 22) -> str:
    return text if len(text) <= most else text[:most] + "…"


def page(data: dict) -> str:
    """A page without outside parts: the view's nodes on circles around the centre, as SVG."""
    rest = [n for n in data["nodes"] if n["id"] != data["centre"]]
    at = {data["centre"]: (500.0, 400.0)}
    for i, n in enumerate(rest):
        ring, turn = 140 + 90 * (i // 40), 2 * math.pi * (i % 40) / min(40, max(1, len(rest)))
        at[n["id"]] = (500 + ring * math.cos(turn), 400 + ring * math.sin(turn))
    lines = "".join(f'<line x1="{at[e["source"]][0]:.1f}" y1="{at[e["source"]][1]:.1f}" x2="{at[e["target"]][0]:.1f}" y2="{at[e["target"]][1]:.1f}" class="{e["role"]}"/>' for e in data["edges"])
    dots = "".join(f'<g><title>{html.escape(n["id"])} {html.escape(n["path"] or "")}</title><circle cx="{at[n["id"]][0]:.1f}" cy="{at[n["id"]][1]:.1f}" r="6" class="{n["confidence"]}"/><text x="{at[n["id"]][0] + 8:.1f}" y="{at[n["id"]][1] + 4:.1f}">{html.escape(n["label"])}</text></g>' for n in data["nodes"])
    raw = json.dumps(data, ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    style = "line{stroke:#999}.registration{stroke-dasharray:4}.exact{fill:#247}.heuristic{fill:#b72}.dynamic_candidate{fill:#a33}text{font:11px sans-serif}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(data["centre"])}</title><style>{style}</style></head><body><svg viewBox="0 0 1000 800">{lines}{dots}</svg><script type="application/json" id="graph">{raw}</script></body></html>'
