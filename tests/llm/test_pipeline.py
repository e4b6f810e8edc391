from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_jaccard import sets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        before = {tuple(r) for r in kept.collect()}
        kept = stage(spark, kept, SF)
        rows = kept.collect()
        assert kept.columns == columns and {tuple(r) for r in rows} <= before
    # Of similar documents one stays: none of those kept is similar to another, and each that
    # went has a chain of similar documents to one that stayed.
    shingled = {r[0]: sets(r[1], 5) for r in before}
    near = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    ids = {r.doc_id for r in rows}
    reached, todo = set(ids), list(ids)
    while todo:
        a = todo.pop()
        for b in shingled.keys() - reached:
            if near(shingled[a], shingled[b]):
                reached.add(b)
                todo.append(b)
    assert reached == set(shingled)
    assert not any(near(shingled[a], shingled[b]) for a in ids for b in ids if a < b)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    placed = defaultdict(list)
    packed = corpus_pipeline.STAGES[3][1](spark, kept, SF).collect()
    for r in packed:
        placed[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in packed) == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows)
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_edges(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(None, text), (None, text), (None, None), (1, text + " end"), (1, text + " end"), (2, ""), (3, None), (4, "long " * 100_000), (5, "The cat sat on the mat, and then it went home."), (5, "Another calm text about the weather in the north.")]
    extra = "predicted int, score double, held_out boolean, _id long, _m long, _q_id string, component_id long, mark long, comp string, length long, rank long"
    docs = spark.createDataFrame([(i, t, 1, 0.5, True, 8, 9, "q", 3, 4, "c", 5, 6) for i, t in rows], f"doc_id long, text string, {extra}")
    for _, stage in corpus_pipeline.STAGES[:3]:
        for rows_in in (docs, docs.limit(0)):
            got = stage(spark, rows_in, SF)
            assert got.columns == docs.columns
            assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in rows_in.collect()}
    kept = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:5]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    # The near-copies without an id go for document 1, of whose equal rows one stays.
    assert kept == [(False, 1, "word0"), (False, 2, ""), (False, 3, ""), (False, 4, "long "), (False, 5, "Anoth"), (False, 5, "The c"), (True, 0, "")]
    assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, SF).collect()} == {None, 1, 2, 3, 4, 5}
    assert corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
