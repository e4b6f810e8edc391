"""Helpers that several training-data operators use.

Nothing here keeps data on one machine: tables that cut lineage are written to the
folder named in ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The ASCII white space that separates words: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


_tables: dict[str, object] = {}


def own_table(name: str, make):
    """The worker's table of what the named operator remembers between tasks.

    A worker serves one operator after another; only the last one's table is kept.
    """
    if name not in _tables:
        _tables.clear()
        _tables[name] = make()
    return _tables[name]


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands tasks' Python workers batches of a bounded size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` says; only where that is unset in a local session, as in
    tests, a temporary folder is made and kept for the session. On a cluster without it nothing
    is shared, and that is an error.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.graphloom.sharedDir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.graphloom.sharedDir", known)
    return known.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that was written.

    It cuts lineage like a checkpoint, but keeps columns prunable and survives the loss of
    every executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def spent(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` made and no later step reads."""
    for table in tables:
        delete(table.sparkSession, table._written_at)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that owns it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, prefix: str) -> str:
    """``prefix``, led by as many underscores as it takes for no column of ``df`` to begin with it."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def row_rank(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int = 1024, bucket: Column | None = None) -> DataFrame:
    """Add ``out``: the row's 0-based, gapless rank among the rows with equal ``keys``.

    Ranks follow the hash bucket, then ``order``. With ``bucket``, an integer expression that
    does not fall along ``order``, they follow ``order`` itself.

    A window over ``keys`` alone would put a hot key's rows into one task. Here rows are dealt
    over ``buckets`` by a hash of the ``order`` columns, ranked inside (keys, bucket), and
    shifted by the number of rows in earlier buckets, which come from one pre-aggregated count.
    ``df`` must give the same rows when it is read twice. Rows equal in ``order`` share a
    bucket; their order among themselves is arbitrary. Null keys form a group of their own.
    """
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int") if bucket is None else bucket)
    counts = dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    on = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = dealt.withColumn("_r", F.row_number().over(inside) - 1).join(shift, on)
    return placed.withColumn(out, (F.col("_r") + F.col("_shift")).cast("long")).drop("_b", "_kb", "_r", "_shift", *[f"_k{i}" for i in range(len(keys))])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, buckets: int = 1024) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group.

    Like :func:`row_rank`, the order is that of (hash bucket, ``order``), so no group has to
    fit into one task. A row with a null key belongs to no group and is left out;
    null values add nothing.
    """
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy(*keys, "_b").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("_s", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(shift, [*keys, "_b"]).withColumn(out, (F.col("_s") + F.col("_shift")).cast("long")).drop("_b", "_s", "_shift")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of ``links``: (node, comp), comp being the least node reachable.

    Each round hooks every node to its least neighbour, jumps pointers twice and contracts the
    links; at least half of the linked nodes go away, so rounds grow with the logarithm of the
    longest chain. Rounds are written to the shared folder, never collected. Nodes that appear
    in no link are absent; loops and repeated links are harmless.
    """
    live = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    found = None
    while not live.isEmpty():
        before, known = live, found
        both = live.select(F.col("a").alias("node"), F.col("b").alias("to")).union(live.select(F.col("b"), F.col("a")))
        up = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("up"))
        first = up = written(up, "hooks")
        for _ in range(2):
            up = up.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.up").alias("up"))
        up = written(up, "hooks")
        if found is None:
            found = up.select("node", F.col("up").alias("comp"))
        else:
            found = found.alias("f").join(up.alias("u"), F.col("f.comp") == F.col("u.node"), "left").select("f.node", F.coalesce("u.up", "f.comp").alias("comp"))
        found = written(found, "found")
        one = live.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
        two = one.join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b").where("ua <> ub")
        live = written(two.select(F.greatest("ua", "ub").alias("a"), F.least("ua", "ub").alias("b")).distinct(), "links")
        spent(before, first, up, *([known] if known is not None else []))
    if found is None:
        return written(live.select(F.col("a").alias("node"), F.col("b").alias("comp")), "found")
    spent(live)
    return found
