"""Embedding near-duplicates by an epsilon grid order join.

Equal vectors form one class. The classes of each vector length are normalised, so that a
cosine threshold is a Euclidean radius, projected on a few leading principal directions, and
sorted by the cells of a grid as wide as that radius. The sequence is cut into intervals of bounded
length. Pairs of intervals whose bounding boxes are further apart than the radius are never
formed; the others meet by tiles of a few intervals, in one task for two tiles, by recursion on halves, which again skips distant blocks, down to
blocks that one matrix product compares. A task returns counts and a spanning forest, not the
linked pairs, so a dense group does not multiply rows. The result is exact: projections can
only shorten distances. The length of what a projection leaves out is one more coordinate: two
remainders are at least as far apart as their lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import components, spent, written

THRESHOLD = 0.9
#: Leading principal directions that are used; they are fitted on at most SAMPLE classes.
LEADING = 8
SAMPLE = 4096
#: Classes of one interval; pairs of intervals are what boxes rule out.
INTERVAL = 4096
#: Intervals of a tile: two tiles are what a task holds, so a class is copied once a tile.
TILE = 4
#: Bytes of vectors that a tile may hold; longer vectors make shorter intervals.
TILE_BYTES = 64 << 20
#: Classes of a block that is compared without further recursion.
BLOCK = 512


def vectors(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """id, dim (0 for vectors that link with nothing), key (digest of the components), vec.

    ``vec`` has the components divided by their length, as double bytes.
    """
    got = rows.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kind = dict(got.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, key, vec = [], [], []
            for x in batch.column(1):
                v = None if not x.is_valid or x.values.null_count else np.asarray(x.values.to_numpy(zero_copy_only=False), float)
                top = 0.0 if v is None or not len(v) or not np.isfinite(v).all() else np.abs(v).max()
                if top > 0:
                    v = v + 0.0  # one zero
                    unit = v / top
                    dim.append(len(v))
                    key.append(hashlib.md5(v.tobytes()).digest())
                    vec.append((unit / np.sqrt(unit @ unit)).tobytes())
                else:
                    dim.append(0)
                    key.append(None)
                    vec.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dim, pa.int32()), pa.array(key, pa.binary()), pa.array(vec, pa.binary())], ["id", "dim", "key", "vec"])

    return got.mapInArrow(run, f"id {kind}, dim int, key binary, vec binary")


def directions(classes: DataFrame, dim: int, leading: int = LEADING) -> np.ndarray:
    """Leading principal directions (dim x leading) of the classes with the least digests."""
    sample = [np.frombuffer(r["vec"]) for r in classes.select("key", "vec").orderBy("key").limit(SAMPLE).collect()]
    if not sample:
        return np.eye(dim)[:, :leading]
    _, vectors = np.linalg.eigh(np.cov(np.stack(sample).T).reshape(dim, dim) if len(sample) > 1 else np.eye(dim))
    return np.ascontiguousarray(vectors[:, ::-1][:, :leading])


def in_grid_order(classes: DataFrame, basis: np.ndarray, radius: float, interval: int) -> DataFrame:
    """The classes with their projections y0.., the length of the remainder as the last of them,
    and the number of their interval, written."""
    names = [f"y{i}" for i in range(basis.shape[1] + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(batch.num_rows, -1)
            y = v @ basis
            cells = np.floor(y / radius).astype(np.int32)
            y = np.column_stack((y, np.linalg.norm(v - y @ basis.T, axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32())), *[pa.array(np.ascontiguousarray(c)) for c in y.T]], ["key", "n", "vec", "cells", *names])

    placed = classes.select("key", "n", "vec").mapInArrow(run, "key binary, n long, vec binary, cells array<int>, " + ", ".join(f"{n} double" for n in names))
    parts = max(1, -(-classes.count() // interval))
    # Sorted inside range partitions, the row number within a partition is a place in the sequence.
    ordered = placed.repartitionByRange(parts, "cells", "key").sortWithinPartitions("cells", "key").withColumn("at", F.monotonically_increasing_id())
    ordered = written(ordered.drop("cells"), "ordered")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("part")).count().orderBy("part").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["count"]
    shift = ordered.sparkSession.createDataFrame(before or [(0, 0)], "part long, shift long")
    return ordered.withColumn("part", part).join(shift, "part").withColumn("at", row + F.col("shift")).withColumn("interval", F.floor(F.col("at") / interval).cast("long")).drop("part", "shift")


def near_intervals(ordered: DataFrame, radius: float, leading: int) -> DataFrame:
    """Pairs (a <= b) of intervals whose boxes are within the radius.

    Boxes meet through the cells of the first direction, of which unit vectors have few; no
    pair of intervals is formed that is apart in it.
    """
    box = ordered.groupBy("interval").agg(*[f(f"y{i}").alias(f"{n}{i}") for i in range(leading) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    box = written(box, "boxes")
    cell = lambda c, k=0: (F.floor(F.col(c) / radius) + k).cast("int")
    a = box.select(*[F.col(c).alias(f"a_{c}") for c in box.columns], F.explode(F.sequence(cell("lo0"), cell("hi0"))).alias("cell"))
    b = box.select(*[F.col(c).alias(f"b_{c}") for c in box.columns], F.explode(F.sequence(cell("lo0", -1), cell("hi0", 1))).alias("cell"))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}")), 2) for i in range(leading)), F.lit(0.0))
    pairs = a.join(b, "cell").where((F.col("a_interval") <= F.col("b_interval")) & (gap <= radius * radius))
    return pairs.select(F.col("a_interval").alias("a"), F.col("b_interval").alias("b")).distinct()


class Links:
    """What a pair of intervals yields: for each class the rows it links to, and a forest."""

    def __init__(self, y: np.ndarray, v: np.ndarray, n: np.ndarray, radius: float, threshold: float):
        self.y, self.v, self.n, self.radius, self.threshold = y, v, n, radius, threshold
        self.count = np.zeros(len(n), np.int64)
        self.root = np.arange(len(n))

    def distant(self, a: slice, b: slice) -> bool:
        x, z = self.y[a], self.y[b]
        gap = np.maximum(0, np.maximum(x.min(0) - z.max(0), z.min(0) - x.max(0)))
        return float(gap @ gap) > self.radius * self.radius

    def join(self, a: slice, b: slice) -> None:
        """Join two parts of the sequence; they are the same part, or a lies before b."""
        if a.stop == a.start or b.stop == b.start or (a != b and self.distant(a, b)):
            return
        if max(a.stop - a.start, b.stop - b.start) <= BLOCK:
            self.compare(a, b)
            return
        halves = lambda s: (slice(s.start, (s.start + s.stop) // 2), slice((s.start + s.stop) // 2, s.stop)) if s.stop - s.start > BLOCK else (s,)
        for i, x in enumerate(halves(a)):
            for j, z in enumerate(halves(b)):
                if a != b or i <= j:
                    self.join(x, z)

    def compare(self, a: slice, b: slice) -> None:
        hits = self.v[a] @ self.v[b].T >= self.threshold
        if a == b:
            hits = np.triu(hits, 1)
        i, j = np.nonzero(hits)
        if not len(i):
            return
        i, j = i + a.start, j + b.start
        np.add.at(self.count, i, self.n[j])
        np.add.at(self.count, j, self.n[i])
        while True:
            p, q = self.root[i], self.root[j]
            apart = p != q
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]


def linked(ordered: DataFrame, pairs: DataFrame, radius: float, threshold: float, leading: int) -> DataFrame:
    """For each class and pair of tiles in which it links: key, links, root (a class)."""
    tiles = pairs.select(F.floor(F.col("a") / TILE).alias("a"), F.floor(F.col("b") / TILE).alias("b")).distinct()
    sides = tiles.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    rows = ordered.withColumn("tile", F.floor(F.col("interval") / TILE)).join(sides, "tile")
    names = [f"y{i}" for i in range(leading)]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("at")
        inside = table["tile"].to_numpy()
        links = Links(np.stack([table[c].to_numpy() for c in names], 1), np.frombuffer(b"".join(table["vec"].to_pylist())).reshape(len(inside), -1), table["n"].to_numpy(), radius, threshold)
        cut = int(np.searchsorted(inside, inside[0], side="right"))
        links.join(slice(0, cut), slice(0, cut) if cut == len(inside) else slice(cut, len(inside)))
        at = np.flatnonzero(links.count)
        keys = table["key"].combine_chunks()
        return pa.table({"key": keys.take(pa.array(at)), "links": links.count[at], "root": keys.take(pa.array(links.root[at]))})

    return rows.select("a", "b", "tile", "at", "key", "n", "vec", *names).groupBy("a", "b").applyInArrow(run, "key binary, links long, root binary")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, id: str = "vec_id", vector: str = "embedding", interval: int = INTERVAL, leading: int = LEADING) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept (id = component_id).

    Null vectors, vectors with null or non-finite components and zero vectors link with nothing
    and are their own component. Vectors of different lengths do not link; those of each length
    are joined by themselves. Repeated rows are vectors of their own: equal vectors link with
    each other, and rows that share the least id of a component are all kept. A null id is never
    a component's least id unless all its ids are null. Other columns are not read. Empty tables
    give empty results.
    """
    all_rows = written(vectors(rows, id, vector), "vectors")
    classes = written(all_rows.where("dim > 0").groupBy("dim", "key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")), "classes")
    # A hair wider than exact, so that rounding never skips a link.
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    found = rows.sparkSession.createDataFrame([], "key binary, links long, root binary")
    # A length of one class has no pair to compare.
    for dim in sorted(r["dim"] for r in classes.groupBy("dim").count().where("count > 1").collect()):
        mine, lead = classes.where(F.col("dim") == dim), min(leading, dim)
        size = max(BLOCK, min(interval, TILE_BYTES // (8 * dim * TILE))) if interval > BLOCK else interval
        ordered = written(in_grid_order(mine, directions(mine, dim, lead), radius, size), "grid")
        near = written(near_intervals(ordered, radius, lead + 1), "near")
        found = found.union(written(linked(ordered, near, radius, threshold, lead + 1), "linked"))
        spent(ordered, near)
    group = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.select("key", "least", "n").join(links, "key", "left").join(group.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    known = written(known, "known")
    lowest = known.groupBy("comp").agg(F.min("least").alias("lowest"))
    done = written(known.join(lowest, "comp").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "lowest"), "done")
    out = all_rows.select("id", "key").join(done, "key", "left")
    component = F.coalesce("lowest", "id")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
