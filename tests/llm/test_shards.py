import zlib
from collections import Counter, defaultdict

from graphloom.llm.shards import shard

SCHEMA = "doc_id long, text string, shard int, gid string"


def run(spark, texts, shards=40, ids=None):
    rows = [(ids[i] if ids else i, t, 99, "x") for i, t in enumerate(texts)]
    got = shard(spark.createDataFrame(rows, SCHEMA), shards).collect()
    assert len(got) == len(texts)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return got


def test_balance_and_links(spark):
    texts = [f"text {i}" for i in range(400)] + [f"pair {i // 2}" for i in range(200)] + ["hot"] * 300 + [None, "", None]
    got = run(spark, texts, 20)
    by = {r.doc_id: r for r in got}
    apart = sum(by[600 - 200 + 2 * k].shard != by[600 - 200 + 2 * k + 1].shard for k in range(100))
    assert apart <= 15  # random labels would part about 95
    assert len({by[i].shard for i in range(600, 900)}) <= 11
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (by[i].size, by[i].text_crc32, by[i].law, by[i].grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_edges(spark):
    run(spark, [], 40)
    run(spark, ["a"], 40)
    run(spark, ["same"] * 100, 7, ids=[None] * 100)
    run(spark, ["é" * 100000, None, "x"], 2, ids=[1, 1, 1])
    assert Counter(r.shard for r in run(spark, ["only"] * 45, 40)).most_common(1)[0][1] == 2
