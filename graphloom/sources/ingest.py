"""The incremental index: what changed, and how the relations take it in.

Relations are versioned Parquet folders. A change writes a new version and then points at it,
so a reader never sees half of one, and a lost executor only repeats its tasks.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema as s

RELATIONS = {"files": s.FILES, "symbols": s.SYMBOLS, "refs": s.REFS, "violations": s.VIOLATIONS}


def dirty(walk: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """Walked files that are new, or whose time or size differ from the indexed ones."""
    if force:
        return walk
    known = files.select("root_id", "path", F.col("mtime_ns").alias("_m"), F.col("size").alias("_s"))
    rows = walk.join(known, ["root_id", "path"], "left")
    return rows.where(F.col("_m").isNull() | (F.col("_m") != F.col("mtime_ns")) | (F.col("_s") != F.col("size")) | (F.col("mtime_ns") == 0)).drop("_m", "_s")


def deleted(walk: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Indexed files of a root that the walk no longer meets."""
    return files.where(F.col("root_id") == root).join(walk, ["root_id", "path"], "left_anti").select("root_id", "path")


def replaced(old: DataFrame, new: DataFrame, paths: DataFrame, root: str) -> DataFrame:
    """``old`` without the rows of ``paths``, and ``new``. A named root also takes over the
    unnamed root's rows of the same path."""
    kept = old.join(paths.select("root_id", "path"), ["root_id", "path"], "left_anti")
    if root:
        claimed = paths.select("path").withColumn("root_id", F.lit(""))
        kept = kept.join(claimed, ["root_id", "path"], "left_anti")
    return kept.unionByName(new.select(*old.columns))


def with_descriptions(new: DataFrame, old: DataFrame) -> DataFrame:
    """Symbols of a changed file keep the description of their qualified name."""
    known = old.where("description IS NOT NULL").groupBy("root_id", "path", "qualified_name").agg(F.min("description").alias("_d"))
    return new.join(known, ["root_id", "path", "qualified_name"], "left").withColumn("description", F.coalesce("description", "_d")).drop("_d").select(*new.columns)


def pruned(rows: DataFrame, keep: DataFrame, root: str) -> DataFrame:
    """Rows of a root whose path is kept, and all rows of other roots."""
    other = rows.where(F.col("root_id") != root)
    return other.unionByName(rows.where(F.col("root_id") == root).join(keep.select("root_id", "path"), ["root_id", "path"], "left_semi").select(*rows.columns))


def parse_errors(failed: DataFrame) -> DataFrame:
    """Violations for files that could not be read; ``failed`` (root_id, path, reason)."""
    return failed.select("root_id", "path", F.lit("parse_error").alias("kind"), F.lit(1).alias("line"), F.substring("reason", 1, 200).alias("snippet"))


class Index:
    """The relations under one folder, by version; paths go through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _metas(self) -> list[str]:
        """The names of the states, oldest first."""
        found = self._fs.globStatus(self._p("meta-*.json")) or []
        return sorted(f.getPath().getName() for f in found)

    def meta(self, name: str | None = None) -> dict:
        name = name or next(reversed(self._metas()), None)
        if name is None:
            return {"schema_version": "2", "index_seq": 0, "versions": {}}
        text = "\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.path}/{name}").collect())
        return json.loads(text)

    def save_meta(self, meta: dict) -> None:
        """Add a state with the next number: it is written beside and renamed to a name that is
        free, so readers see one whole state or the other, and of two writers one fails. The state
        before stays for readers that just chose it; older ones go."""
        known = self._metas()
        number = int(known[-1].removeprefix("meta-").removesuffix(".json")) + 1 if known else 1
        new, live = self._p(f".meta.{time.time_ns()}.tmp"), self._p(f"meta-{number:012d}.json")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps(meta, sort_keys=True).encode()))
        out.close()
        if not self._fs.rename(new, live):
            raise RuntimeError(f"another writer made {live.getName()}")
        for name in known[:-1]:
            self._fs.delete(self._p(name), False)

    def vacuum(self) -> int:
        """Delete the folders that neither the current state nor the one before names; how many."""
        used = {v for name in self._metas() for v in self.meta(name)["versions"].values()}
        kinds = {n.split("-")[0] for n in used}
        old = [f.getPath() for f in self._fs.listStatus(self._p("")) if f.isDirectory() and f.getPath().getName().split("-")[0] in kinds and f.getPath().getName() not in used] if used else []
        for path in old:
            self._fs.delete(path, True)
        return len(old)

    def read(self, name: str, version: str | None = None) -> DataFrame:
        version = version or self.meta()["versions"].get(name)
        kind = RELATIONS.get(name, s.EDGES)
        if version is None:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.path}/{version}")

    def write(self, frames: dict[str, DataFrame], **meta) -> dict:
        """Write a new version of the frames' relations and make it the current one."""
        state = self.meta()
        stamp = f"v{time.time_ns()}"
        for name, df in frames.items():
            df.write.parquet(f"{self.path}/{name}-{stamp}")
            state["versions"][name] = f"{name}-{stamp}"
        self.save_meta(state | meta)
        return state | meta

    def snapshot(self) -> None:
        """Keep the current edges as the latest snapshot, and the latest as the previous one."""
        state = self.meta()
        seq = int(state["index_seq"]) + 1
        name = f"edges-{seq}"
        self.read("refs").select("name", "path", "line", "confidence", "enclosing", "root_id").write.mode("overwrite").parquet(f"{self.path}/{name}")
        v = dict(state["versions"])
        if "edges" in v:
            v["edges_previous"] = v["edges"]
        v["edges"] = name
        self.save_meta(state | {"versions": v, "index_seq": seq, "indexed_at": f"unix:{int(time.time())}", "baseline_stale": False})

    def promote(self) -> None:
        """Make the live edges both generations."""
        self.snapshot()
        state = self.meta()
        state["versions"]["edges_previous"] = state["versions"]["edges"]
        self.save_meta(state)

    def snapshots(self) -> tuple[DataFrame | None, DataFrame | None]:
        v = self.meta()["versions"]
        return tuple(self.read("edges", v[k]) if k in v else None for k in ("edges", "edges_previous"))


def build(index: Index, walk: DataFrame, extract: Callable[[DataFrame], dict[str, DataFrame]], root: str = "", force: bool = False, scope: list[str] | None = None) -> dict:
    """Bring a root's relations up to date with a walk (root_id, path, language, mtime_ns, size, and
    uri or content). ``extract`` gives symbols, refs and violations of changed files. Nothing is
    written but the snapshot when nothing changed. ``scope`` names the paths of a scoped run,
    which marks the baseline stale."""
    files = index.read("files")
    listed = walk.select("root_id", "path")
    changed = dirty(walk, files, force)
    if scope is not None and len(scope) <= 64:
        changed = changed.where(F.col("path").isin(*scope))
    if "content" not in changed.columns:
        from graphloom.sources.walk import with_content

        changed = with_content(changed)
    hashed = changed.withColumn("hash", F.coalesce(F.sha2("content", 256), F.lit("parse-error")))
    known = files.select("root_id", "path", F.col("hash").alias("_h"))
    # A file that was touched but holds the same is not read again; only its time is kept.
    touched = hashed.limit(0) if force else hashed.join(known, ["root_id", "path"]).where("hash = _h").drop("_h").persist()
    todo = hashed.join(touched, ["root_id", "path"], "left_anti").persist()
    gone = deleted(listed, files, root)
    n_todo, n_gone, n_touched = todo.count(), gone.count(), touched.count()
    as_files = lambda rows: rows.select(*[F.col(f.name).cast(f.dataType) for f in s.FILES])
    if not n_todo and not n_gone:
        if n_touched:
            index.write({"files": replaced(files, as_files(touched), touched.select("root_id", "path"), root)})
        index.snapshot()
        return {"indexed": 0, "deleted": 0, "noop": True}
    parts = extract(todo)
    paths = todo.select("root_id", "path")
    new_files = as_files(todo.unionByName(touched))
    old = {n: index.read(n) for n in RELATIONS}
    parts["symbols"] = with_descriptions(parts["symbols"], old["symbols"])
    parts["files"] = new_files
    renewed = {n: paths for n in RELATIONS} | {"files": paths.union(touched.select("root_id", "path"))}
    out = {n: pruned(replaced(old[n], parts[n], renewed[n], root), listed, root) for n in RELATIONS}
    index.write(out)
    if scope is None:
        index.snapshot()
    else:
        index.save_meta(index.meta() | {"baseline_stale": True})
    todo.unpersist()
    touched.unpersist()
    return {"indexed": n_todo, "deleted": n_gone, "noop": False}


def relative(root: str, path: str) -> str | None:
    """``path`` below ``root``, or None outside it."""
    try:
        return str(PurePosixPath(path.replace("\\", "/")).relative_to(root.replace("\\", "/").rstrip("/") or "/"))
    except ValueError:
        return None


