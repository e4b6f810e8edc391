"""Session defaults and the writing of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "graphloom", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; the master comes from the environment."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the folder that all executors share.

    On a cluster that is ``spark.checkpoint.dir``; only where it is unset in a local session a
    temporary folder is used. A cluster without it shares nothing, and that is an error.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        known = context.getConf().get("spark.checkpoint.dir")
        if not known and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(known or tempfile.mkdtemp(prefix="graphloom-"))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the folder that :func:`cut` uses.

    Its columns are compressed and can be left unread, which a checkpoint's rows can not. Shuffle
    files that only this table needed are given up at once.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.graphloom.sharedDir", None)
    if not known:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.graphloom.sharedDir", known)
    path = f"{known.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    context._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
