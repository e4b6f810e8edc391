import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm.packing import LibraryIds, pack, plan, sequences
from tests.llm.test_bpe import NEAR_SPECIALS

PATH = public_tokenizers.path("word_bpe_49k.json")


def fill(runs):
    bins = {}
    for length, _, n, first, offset in runs:
        for k in range(n):
            bins.setdefault(first + k, []).append((offset, length))
    return bins


def best_fit(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - length)
            else:
                rooms.append(capacity - length)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 25), max_size=12))
def test_plan(counts):
    runs = plan(counts, 40)
    ranks = {}
    for length, rank, n, _, _ in runs:
        ranks.setdefault(length, []).extend(range(rank, rank + n))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    bins = fill(runs)
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 40
    assert sorted(bins) == list(range(len(bins)))
    assert len(bins) == best_fit(counts, 40)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="abtheS 's\n1\x1c", max_size=60)), max_size=5))
def test_library_ids(texts):
    mine, t = LibraryIds(PATH), Tokenizer.from_file(PATH)
    texts = [*texts, "a<|endoftext|>b <|endoftext|> é'́ x"]
    for text, raw in zip(texts, mine.encode_batch(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(NEAR_SPECIALS, max_size=4))
def test_specials(texts):
    mine, t = LibraryIds(PATH), Tokenizer.from_file(PATH)
    for text, raw in zip(texts, mine.encode_batch(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_marks_after_every_character():
    mine, t = LibraryIds(PATH), Tokenizer.from_file(PATH)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(every), 20000):
        part = [f"a{c}?! {c}." for c in every[a : a + 20000]]
        want = t.encode_batch(part, add_special_tokens=False)
        odd = [p for p, raw, w in zip(part, mine.encode_batch(part), want, strict=True) if np.frombuffer(raw, "<u4").tolist() != w.ids]
        assert not odd, odd[:20]


def test_pack(spark):
    rng = random.Random(3)
    t = Tokenizer.from_file(PATH)
    texts = [None, "", "a " * 70] + [" ".join(rng.choices("the of and to cat dog".split(), k=rng.randint(0, 45))) for _ in range(60)] + ["same text"] * 20
    docs = spark.createDataFrame([(i if i != 5 else None, x, 9, 9) for i, x in enumerate(texts)], "doc_id long, text string, length int, piece int")
    got = pack(docs, PATH, 32).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    whole = {}
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        parts = sorted(by[i if i != 5 else None], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in parts] == [(a, len(ids[a : a + 32])) for a in range(0, len(ids), 32)]
        for r in parts:
            raw = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
            whole[(r.sequence_id, r.offset)] = ids[r.start : r.start + r.length]
    assert len(whole) == len(got)
    ends = {}
    for (s, o), ids in sorted(whole.items()):
        assert ends.get(s, 0) == o
        ends[s] = o + len(ids)
    assert max(ends.values()) <= 32
    counts = {}
    for r in got:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len(ends) == best_fit(counts, 32)
    made = sequences(docs, PATH, 32).collect()
    assert sum(len(r.ids) for r in made) == sum(map(len, whole.values())) and max(len(r.ids) for r in made) <= 32


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
