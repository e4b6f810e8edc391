"""Watching a source tree with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import schema as s
from graphloom.functions import exprs as e
from graphloom.operators import sidecar
from graphloom.sources import walk

#: Above this number of changed paths, or for a changed directory, everything is indexed.
MOST_SCOPED = 64
EVENTS = T.StructType([T.StructField("root_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("ts", T.TimestampType())])


def sessions(events: DataFrame, by: str, ts: str, path: str, quiet: str) -> DataFrame:
    """Bursts of events: the set of their paths, once ``quiet`` passes without another event.

    The same expression runs on a table and on a stream; on a stream, put a watermark first.
    """
    # A cast would hide the watermark of a stream.
    time = F.col(ts) if dict(events.dtypes)[ts] == "timestamp" else F.col(ts).cast("timestamp")
    w = F.session_window(time, quiet)
    got = events.groupBy(by, w).agg(F.min(ts).alias("started"), F.count(F.lit(1)).alias("n"), F.collect_set(path).alias("paths"))
    return got.select(by, "started", "n", "paths")


def source_events(events: DataFrame) -> DataFrame:
    """Events on files of a known language, outside skipped directories."""
    inside = ~F.exists(F.split("path", "/"), lambda x: x.isin(*s.SKIPPED_DIRS))
    return events.where(e.language("path").isNotNull() & inside)


def scope_of(paths: list[str], directories: bool = False) -> list[str] | None:
    """The paths of a scoped run, or None for a full one."""
    return None if directories or len(paths) > MOST_SCOPED else sorted(set(paths))


def debounced(stream: DataFrame, quiet: str = "300 milliseconds", late: str = "5 seconds") -> DataFrame:
    """The streaming form of :func:`sessions` over source events."""
    return sessions(source_events(stream).withWatermark("ts", late), "root_id", "ts", "path", quiet)


def watch(spark: SparkSession, events_path: str, on_burst: Callable[[list[str] | None], None], checkpoint: str, every: str = "1 second"):
    """Call ``on_burst`` with each micro-batch's scope; a micro-batch is a quiet period's worth.

    A batch that is repeated after a failure gives the same paths again; indexing them again
    changes nothing.
    """

    def run(batch: DataFrame, _: int) -> None:
        # One more than the limit is enough to tell that the run is a full one.
        paths = [r["path"] for r in source_events(batch).select("path").distinct().limit(MOST_SCOPED + 1).collect()]
        if paths:
            on_burst(scope_of(paths))

    stream = spark.readStream.schema(EVENTS).json(events_path)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def poll(engine, tree: str, root_id: str = "", every: float = 2.0, rounds: int | None = None, on_build: Callable[[dict], None] | None = None) -> int:
    """Index ``tree`` whenever the fingerprint of its listing changes; how often that was.

    It looks every ``every`` seconds, ``rounds`` times or until it is stopped. A failed run is
    tried again at the next look.
    """
    last, built, looks = None, 0, 0
    while rounds is None or looks < rounds:
        if looks:
            time.sleep(max(0.05, every))
        looks += 1
        walked = walk.walk(engine.spark, tree, root_id).where("fate = 'source'")
        sign = sidecar.fingerprint(walked).first()[0]
        if sign != last:
            done = engine.build(tree, root_id)
            last, built = sign, built + 1
            if on_build is not None:
                on_build(done)
    return built
