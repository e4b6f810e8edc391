"""WARC archives with revisit resolution.

Headers (identifier and payload digest) are shuffled by digest; payloads are not. Of the
records with one digest the least identifier keeps its payload, the others become revisit
records that refer to it. Digests are counted before they are joined, so a payload that a
third of all records share costs one row a task. Archives are written and read by Spark, hence
on any file system that it knows, through its commit protocol.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import new_path, utf8, written

#: Payloads with fewer bytes are always written.
LEAST_BYTES = 100
#: Records of one archive file, which is one cell, compressed, where it is read.
RECORDS_PER_FILE = 512
#: Bytes of payloads that a reader hands on together.
BATCH_BYTES = 16 << 20
#: A record ends with two line ends; Spark's text writer adds them.
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """The records that revisit another: id, digest, refers_to.

    ``headers`` has id, digest and bytes; repeated rows do not matter. Records that tie on the
    least id are all originals. A record with a null id is an original only if every record
    with its digest has a null id.
    """
    many = headers.where(F.col("bytes") >= least)
    first = many.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    # Written, the smaller side is an input of its own, and Spark can split a hot digest's rows.
    first = written(first, "first")
    found = many.select("id", "digest").join(first, "digest").where(~F.col("id").eqNullSafe(F.col("refers_to")))
    return found.groupBy("id", "digest").agg(F.first("refers_to").alias("refers_to"))


def record_id(id: Column, digest: Column) -> Column:
    """A URN that depends on the record alone, so a task that runs again writes the same."""
    h = F.md5(F.concat_ws("|", F.coalesce(id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] * (a > 1) + [F.substring(h, a, n)])], F.lit(">"))


def header_lines(fields: list[tuple[str, Column]]) -> Column:
    """Header lines for the fields that are not null."""
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\r\n")), F.lit("")) for k, v in fields], F.lit("\r\n"))


def write(pages: DataFrame, path: str, date: str, id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES) -> None:
    """Write one WARC record per row of ``pages`` to ``path``.

    A null payload is empty. Identifiers and, in an URL, line ends and blanks are
    percent-encoded, so that no value can break a header; without an URL the target is a URN made of the id. Repeated rows
    are written as often as they occur.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha2(utf8(F.col("body")), 256)).withColumn("bytes", F.octet_length("body").cast("long"))
    revisits = resolve(rows.select("id", "digest", "bytes"), least).select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    rows = rows.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    revisit = F.col("r_digest").isNotNull()
    target = F.coalesce(F.nullif(F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20"), F.lit("")), F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none"))))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    fields = [
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", record_id(F.col("id"), F.col("digest"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to"), F.col("digest")))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        ("X-Row-ID", F.url_encode(F.col("id").cast("string"))),
        ("X-Refers-To-Row-ID", F.url_encode(F.col("refers_to").cast("string"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", length),
    ]
    record = F.concat(header_lines(fields), http, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    rows.select(record.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive, compressed or not: headers and block. Lengths delimit them.

    The archive is unpacked as it is read, so one record at a time is held.
    """
    stream = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
    number = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"record {number} is no WARC record")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, value = line.decode("utf-8").removesuffix("\r\n").split(": ", 1)
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != RECORD_END.encode():
            raise ValueError(f"record {number} does not end where it says")
        yield headers, block
        number += 1


def read(spark: SparkSession, path: str, id_type: str = "long", payloads: bool = True) -> DataFrame:
    """The records of the archives under ``path``, as they stand there.

    Returns id, url, record_type, record_id, refers_to_record, digest (bare hex), refers_to,
    http_bytes (what the HTTP header says), payload_bytes and computed (hex of the payload that
    is there; null for revisits) and, if asked, payload.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def frame(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * (10 + payloads)
            kinds = [pa.string()] * 7 + [pa.int64()] * 2 + [pa.string()] + [pa.binary()] * payloads
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for cell in batch.column(0):
                rows, held = [], 0
                for h, raw in parse(cell.as_buffer().to_pybytes()):
                    cut = raw.index(b"\r\n\r\n") + 4
                    said = next(int(x.split(b":")[1]) for x in raw[:cut].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    body = raw[cut:] if h["WARC-Type"] == "response" else None
                    row = (h.get("X-Row-ID"), h["WARC-Target-URI"], h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Refers-To"), h["WARC-Payload-Digest"].removeprefix("sha256:"), h.get("X-Refers-To-Row-ID"), said, None if body is None else len(body), None if body is None else hashlib.sha256(body).hexdigest())
                    rows.append((*row, body) if payloads else row)
                    held += len(raw) if payloads else 0
                    if held > BATCH_BYTES:
                        yield frame(rows)
                        rows, held = [], 0
                yield frame(rows)

    names = ["id", "url", "record_type", "record_id", "refers_to_record", "digest", "refers_to", "http_bytes", "payload_bytes", "computed"] + ["payload"] * payloads
    schema = ", ".join(f"{n} {'long' if n.endswith('bytes') else 'binary' if n == 'payload' else 'string'}" for n in names)
    got = files.mapInArrow(run, schema)
    own = lambda c: F.url_decode(c).cast(id_type)
    return got.withColumn("id", own("id")).withColumn("refers_to", own("refers_to"))


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` as deduplicated archives, read them back and resolve the revisits.

    Returns id, payload_bytes, payload_digest, record_type, refers_to and intact: whether the
    payload in the archive (for a revisit: that of the record it refers to) has the digest and
    length that its header states. The archives stay in the shared folder. Edge cases are
    those of :func:`write` and :func:`resolve`; other columns are not read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, date, id, url, payload)
    told = F.coalesce("payload_bytes", "http_bytes"), F.coalesce("computed", "digest")
    intact = F.coalesce((F.col("computed") == F.col("digest")) & (F.col("payload_bytes") == F.col("http_bytes")), F.lit(False))
    records = read(spark, path, dict(pages.dtypes)[id], payloads=False)
    records = written(records.select("id", told[0].alias("bytes"), told[1].alias("digest"), "record_type", "refers_to", "record_id", "refers_to_record", intact.alias("intact")), "records")
    revisits = records.where("record_type = 'revisit'")
    # A revisit finds its payload's record; only records that are referred to are looked up, and
    # written, so that Spark can split a hot one's revisits.
    wanted = revisits.select(F.col("refers_to_record").alias("record_id")).distinct()
    originals = records.where("record_type = 'response'").join(wanted, "record_id", "left_semi")
    originals = originals.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.first("bytes").alias("o_bytes"), F.first("digest").alias("o_digest"), F.min("intact").alias("o_intact"))
    found = revisits.join(written(originals, "originals"), "refers_to_record", "left")
    names = ["id", "bytes", "digest", "record_type", "refers_to", "intact"]
    same = F.coalesce((F.col("o_bytes") == F.col("bytes")) & (F.col("o_digest") == F.col("digest")) & F.col("o_intact"), F.lit(False))
    found = found.select("id", F.col("o_bytes").alias("bytes"), F.col("o_digest").alias("digest"), "record_type", "refers_to", same.alias("intact"))
    got = records.where("record_type <> 'revisit'").select(*names).union(found)
    return got.select(F.col("id").alias(id), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "intact")
