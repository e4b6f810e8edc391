import hashlib

from graphloom.llm.common import new_path
from graphloom.llm.warc import read, round_trip, write

SCHEMA = "page_id long, url string, html string, digest string"
LONG = "<p>é" + "x" * 200
PAGES = [
    (9, "http://a/ b\r\nX: y", LONG, "?"),
    (3, None, LONG, "?"),
    (3, "", LONG, "?"),
    (5, "u", LONG, "?"),
    (None, "u", LONG, "?"),
    (7, "u", "short", "?"),
    (8, "u", "short", "?"),
    (10, "u", None, "?"),
    (11, "u", "", "?"),
    (12, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" + "y" * 100 + "\r\n\r\n", "?"),
    (13, "u", "z" * 300000, "?"),
    (14, "u", "z" * 300000, "?"),
    (None, "u", "n" * 150, "?"),
    (None, "u", "n" * 150, "?"),
]


def brute(pages):
    out = []
    for i, _, html, _ in pages:
        raw = (html or "").encode()
        same = [p for p, _, h, _ in pages if (h or "").encode() == raw and p is not None]
        revisit = len(raw) >= 100 and same and i != min(same)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None, True))
    return sorted(out, key=repr)


def test_round_trip(spark):
    got = round_trip(spark.createDataFrame(PAGES, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(PAGES)


def test_payloads_and_ids(spark):
    path = new_path(spark, "t")
    write(spark.createDataFrame(PAGES, SCHEMA), path, "2001-02-03T04:05:06Z")
    rows = read(spark, path).collect()
    assert all("\r" not in r.url and " " not in r.url for r in rows)
    texts = sorted((h or "").encode() for _, _, h, _ in PAGES)
    have = {r.record_id: bytes(r.payload) for r in rows if r.record_type == "response"}
    assert sorted(bytes(r.payload) if r.payload is not None else have[r.refers_to_record] for r in rows) == texts


def test_empty(spark):
    assert round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_of_any_text(spark):
    ids = ["a\r\nX-Row-ID: b", " % +é", "", "x" * 300]
    pages = spark.createDataFrame([(i, "u", "t" * 120) for i in ids], "page_id string, url string, html string")
    got = {r.page_id: r.refers_to for r in round_trip(pages).collect()}
    assert got == {i: None if i == min(ids) else min(ids) for i in ids}
