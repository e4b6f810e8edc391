"""The side dataset of macro-expanded sources: path mapping, de-duplication, union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import exprs as e

SHADOW_DIRS = ("expanded", "target", "macro-expanded")
#: Folders that hold an expanded view and name no crate (fixed values).
VIEW_DIRS = ("expanded-view", "expanded_view", "real-expanded", "real_expanded", "expand-shadow", "expand_shadow", "expanded", "shadow")


def mapped_path(expanded: DataFrame, pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``mapped``: the source file that an expanded path stands for, or null.

    ``pairs`` (expanded, source, prefix): the longest fitting pair wins. Without one the path
    itself, then the path without shadow directories, counts if it is a file. Candidates are
    rows that meet pairs and files by equality: a prefix pair fits one of the path's own
    directories.
    """
    paths = expanded.select("path").distinct()
    clean = e.repo_path("path")
    parts = F.split(clean, "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    asked = paths.withColumn("_clean", clean).withColumn("_up", F.explode(ups))
    p = pairs.select(e.repo_path("expanded").alias("_up"), e.repo_path("source").alias("_source"), "prefix")
    fit = asked.join(p, "_up").where("prefix OR _up = _clean")
    target = F.when(F.col("prefix"), e.repo_path(F.concat("_source", F.lit("/"), F.substring(F.col("_clean"), F.length("_up") + 1, F.length("_clean"))))).otherwise(F.col("_source"))
    explicit = fit.groupBy("path").agg(F.max_by(target, F.struct(F.length("_up"), ~F.col("prefix"))).alias("_explicit"))
    bare = F.array_join(F.filter(parts, lambda x: ~x.isin(*SHADOW_DIRS)), "/")
    # Last, a crate's folder or file may stand for the crate below crates/.
    own = F.filter(parts, lambda x: ~F.lower(x).isin(*VIEW_DIRS, *SHADOW_DIRS))
    crate, rest = F.coalesce(F.get(own, F.lit(0)), F.lit("")), F.array_join(F.slice(own, 2, 1 << 20), "/")
    aligned = [F.concat(F.lit("crates/"), crate, F.lit(middle), rest) for middle in ("/", "/src/")]
    aligned.append(F.when(F.size(own) == 1, F.concat(F.lit("crates/"), F.regexp_replace(crate, r"\.rs$", ""), F.lit("/src/lib.rs"))))
    tries = paths.select("path", F.posexplode(F.array(clean, bare, *aligned)).alias("pos", "file")).join(files.select(F.col("path").alias("file")).distinct(), "file")
    found = tries.groupBy("path").agg(F.min_by("file", "pos").alias("_found"))
    known = paths.join(explicit, "path", "left").join(found, "path", "left").select("path", F.coalesce("_explicit", "_found").alias("mapped"))
    return expanded.join(known, "path", "left")


def discovered(expanded: DataFrame, given: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs (expanded, source, prefix): those given, one for each expanded file whose source is
    there, and one for each crate folder whose files lie in ``crates/<name>/src``.

    A given pair for the same path or folder stays as it is. ``expanded`` and ``files`` have a path.
    """
    found = mapped_path(expanded.select("path").distinct(), given, files).where("mapped IS NOT NULL").join(files.select(F.col("path").alias("mapped")).distinct(), "mapped")
    exact = found.select(F.col("path").alias("expanded"), F.col("mapped").alias("source"), F.lit(False).alias("prefix"))
    parts = F.filter(F.split(e.repo_path("path"), "/"), lambda x: ~F.lower(x).isin(*VIEW_DIRS))
    crates = found.where(F.col("mapped").rlike("^crates/[^/]+/src/") & (F.size(parts) > 1))
    crates = crates.groupBy(F.concat(F.get(parts, F.lit(0)), F.lit("/")).alias("expanded")).agg(F.min(F.regexp_extract("mapped", "^(crates/[^/]+/src/)", 1)).alias("source")).withColumn("prefix", F.lit(True))
    known = given.select(e.repo_path("expanded").alias("_e"), "prefix").distinct()
    fresh = exact.unionByName(crates).withColumn("_e", e.repo_path("expanded")).join(known, ["_e", "prefix"], "left_anti")
    return given.select("expanded", "source", "prefix").unionByName(fresh.select("expanded", "source", "prefix"))


def _marked(main: DataFrame, side: DataFrame) -> DataFrame:
    """``side`` (with ``mapped``) and whether ``main`` has its edge exactly or heuristically."""
    enc = F.coalesce("enclosing", F.lit(""))
    known = main.where("confidence IN ('exact', 'heuristic')").select("name", enc.alias("_enc"), F.col("path").alias("mapped"), (F.col("confidence") == "exact").alias("_x"))
    known = known.groupBy("name", "_enc", "mapped").agg(F.max("_x").alias("_exact"))
    return side.withColumn("_enc", enc).join(known, ["name", "_enc", "mapped"], "left")


def without_known(main: DataFrame, side: DataFrame) -> DataFrame:
    """Rows of the side dataset that ``main`` does not have. Unmapped rows always stay."""
    return _marked(main, side).where("_exact IS NULL").select(*side.columns)


def dedup_stats(main: DataFrame, side: DataFrame) -> DataFrame:
    """One row: merged_exact, merged_heuristic, kept, unmapped."""
    rows = _marked(main, side)
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    x = F.col("_exact")
    return rows.agg(n(x, "merged_exact"), n(x.isNotNull() & ~x, "merged_heuristic"), n(x.isNull() & F.col("mapped").isNotNull(), "kept"), n(F.col("mapped").isNull(), "unmapped"))


def union(main: DataFrame, side: DataFrame, exact_only: bool = False, dedup: bool = True) -> DataFrame:
    """Main rows and, unless only exact edges are asked for, those the side dataset adds."""
    rows = main.withColumn("origin", F.lit("source"))
    if exact_only:
        return rows
    kept = without_known(main, side) if dedup else side
    return rows.unionByName(kept.withColumn("origin", F.lit("macro_expanded")), allowMissingColumns=True)


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: a hash of all (root, path, size, time). Order and partitioning do not matter."""
    h = F.xxhash64("root_id", "path", "mtime_ns", "size").cast("decimal(20,0)")
    mixed = F.xxhash64("size", "mtime_ns", "path", "root_id").cast("decimal(20,0)")
    return files.agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), F.sum(h).cast("string"), F.sum(mixed).cast("string")), 256).alias("fingerprint"))


def usable(exists: bool, stale: bool, nested: bool, root_present: bool, sound: bool) -> tuple[bool, str]:
    """Whether a query may use the side dataset, and why not."""
    for bad, why in ((sound, "sound walks use sources only"), (not exists, "there is no expanded tree"), (not root_present, "its root is gone"), (nested, "its root lies inside the sources"), (stale, "the sources changed since it was built")):
        if bad:
            return False, why
    return True, "ok"
