"""Walking a source tree as a DataFrame."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.functions import exprs as e

#: Our own folder, which no walk enters.
OWN = ".graphloom"


def ignore_patterns(text: str, base: str = "") -> list[tuple[str, bool]]:
    """(regular expression on relative paths, is it an exception) of an ignore file's lines."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        line = line[back:]
        folder, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        parts = [".*" if p == "**" else fnmatch.translate(p)[4:-3].replace(".*", "[^/]*") if fnmatch.translate(p).startswith("(?s:") else re.escape(p) for p in line.split("/")]
        body = "/".join(parts).replace(".*/", "(?:.*/)?")
        head = re.escape(base.strip("/") + "/") if base.strip("/") else ""
        out.append((f"^{head}{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$", back))
    return out


def ignored(patterns: list[tuple[str, bool]], path="path"):
    """Whether the last pattern that fits a path excludes it."""
    out = F.lit(False)
    for pattern, back in patterns:
        out = F.when(e.col(path).rlike(pattern), F.lit(not back)).otherwise(out)
    return out


def list_tree(spark: SparkSession, root: str, root_id: str = "") -> DataFrame:
    """All files below ``root``: root_id, path, uri, mtime_ns, size.

    Names come from the file system's own listing, because Spark's readers leave out names that
    begin with a dot or an underscore. Only names are listed; contents are read by the tasks.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    rows, found = [], fs.listFiles(top, True)
    while found.hasNext():
        f = found.next()
        uri = f.getPath().toString()
        rows.append((root_id, uri[len(base) :], uri, f.getModificationTime() * 1_000_000, f.getLen()))
    return spark.createDataFrame(rows, "root_id string, path string, uri string, mtime_ns long, size long")


def qualified(spark: SparkSession, root: str) -> str:
    """The address of ``root`` in the file system that owns it, with a slash at its end."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/") + "/"


def with_content(files: DataFrame) -> DataFrame:
    """Add ``content``, read by the tasks from ``uri``; null where a file can not be read."""
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                got = []
                for uri in part.column(names.index("uri")).to_pylist():
                    try:
                        system, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                        with system.open_input_stream(path) as f:
                            got.append(f.read())
                    except OSError:
                        got.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], [*names, "content"])

    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes) + ", content binary"
    return files.mapInArrow(run, schema)


def classify(tree: DataFrame, patterns: list[tuple[str, bool]] = ()) -> DataFrame:
    """Add language and fate: source, minified, noise, oversized or other.

    Minified and oversized sources are not read, but they are kept in view: they count against
    the gate.
    """
    lang = e.language("path")
    noisy = F.exists(F.split("path", "/"), lambda x: x.isin(*s.SKIPPED_DIRS))
    fate = F.when(F.col("path").startswith(OWN) | ignored(list(patterns)) | lang.isNull(), F.lit("other")).when(F.col("path").contains(".min."), F.lit("minified")).when(noisy, F.lit("noise")).when(F.col("size") > s.MAX_FILE_BYTES, F.lit("oversized")).otherwise(F.lit("source"))
    return tree.withColumn("language", lang).withColumn("fate", fate)


def walk(spark: SparkSession, root: str, root_id: str = "", honour_ignores: bool = True) -> DataFrame:
    """The tree's files with language and fate; outer ignore files come first, so inner ones win."""
    tree = list_tree(spark, root, root_id)
    patterns: list[tuple[str, bool]] = []
    if honour_ignores:
        own = with_content(tree.where("path = '.gitignore' OR path LIKE '%/.gitignore'"))
        for r in sorted(own.select("path", "content").collect(), key=lambda r: r["path"].count("/")):
            patterns += ignore_patterns(bytes(r["content"] or b"").decode("utf-8", "replace"), r["path"][: -len(".gitignore")])
    return classify(tree, patterns)


def unread(walked: DataFrame) -> DataFrame:
    """Violations of sources that are not read: root_id, path, kind, line, snippet."""
    from graphloom.sources.ingest import parse_errors

    return parse_errors(walked.where(F.col("fate").isin("minified", "oversized")).select("root_id", "path", F.col("fate").alias("reason")))


def skipped(walked: DataFrame) -> DataFrame:
    return walked.where("fate <> 'other'").groupBy("fate").agg(F.count(F.lit(1)).alias("n"))
