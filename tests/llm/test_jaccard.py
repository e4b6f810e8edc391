import random
import re

import numpy as np
import pytest

from graphloom.llm import jaccard

SCHEMA = "doc_id long, text string, n long, mark string"


def sets(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, percent):
    s = [sets(t, n) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        c = find(i)
        least[c] = d if least.get(c) is None else min(least[c], d) if d is not None else least[c]
    return sorted(((d, len(s[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(rng, groups, copies, words=80):
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=40)
    out = []
    for g in range(groups):
        base = rng.choices(vocab, k=rng.randint(3, words))
        if g % 3 == 0:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < 0.2:
                t.append(rng.choice(vocab))
            out.append(" ".join(t))
    return out


def check(spark, rows, n, percent):
    got = jaccard.join(spark.createDataFrame([(i, t, 1, "m") for i, t in rows], SCHEMA), n, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, n, percent)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_against_brute_force(spark, n, percent):
    rng = random.Random(n)
    texts = corpus(rng, 40, 6) + ["A a\tA", "a a a", "b", "B", None, "", " \n", "x y", "x  y"]
    ids = rng.sample(range(1000), len(texts))
    check(spark, list(zip(ids, texts, strict=True)), n, percent)


@pytest.mark.parametrize("crowded", [4, 0])
def test_large_groups_are_whole(spark, monkeypatch, crowded):
    monkeypatch.setattr(jaccard, "CROWDED", crowded)  # with 0, every bucket is split by signature
    monkeypatch.setattr(jaccard, "FEW", 2)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 8)
    rng = random.Random(1)
    chain = rng.choices([f"w{i}" for i in range(400)], k=120)
    texts = corpus(rng, 12, 12)
    for i in range(25):  # each a near copy of the one before, the ends far apart
        chain[(7 * i) % 120] = f"new{i}"
        texts.append(" ".join(chain))
    check(spark, list(enumerate(texts)), 3, 90)
    check(spark, list(enumerate(texts)), 5, 80)


def test_edges(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (3, "q r s"), (3, "q r s"), (3, "t u v"), (None, "q r s"), (None, None), (7, "w " * 30000)]
    check(spark, rows, 3, 90)
    check(spark, [], 3, 90)


def test_first_of_groups(spark):
    rows = [(4, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (9, "other words that stand alone here"), (5, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, k, "s") for k, (i, t) in enumerate(rows)], SCHEMA)
    got = jaccard.first_of_groups(docs).collect()
    assert sorted(r.doc_id for r in got) == [2, 5, 5, 6, 9]
    assert got[0].asDict().keys() == docs.first().asDict().keys()


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        for size in (10, 12, 19, 40, 150, 151, 600):
            for _ in range(40):
                # In every fourth set the hashes lie in a small part of the domain, so most pieces are empty.
                top = 1 << (63 if _ % 4 else 60)
                a = np.unique(rng.integers(0, top, size, dtype=np.uint64) * np.uint64(2))
                room = len(a) * (100 - percent) // (100 + percent)
                drop = rng.integers(0, room + 1)
                b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 1 << 63, room - drop, dtype=np.uint64) * np.uint64(2))))
                common = len(np.intersect1d(a, b))
                if 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
                    assert len(np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)))


def test_histograms_never_exclude_similar_sets():
    rng = np.random.default_rng(2)
    for size in (30, 900, 1100, 5000, 9000):
        for _ in range(10):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate((rng.permutation(a)[rng.integers(0, size // 2) :], rng.integers(0, 1 << 63, rng.integers(0, size // 2), dtype=np.uint64) * np.uint64(2))))
            x, y = (np.frombuffer(jaccard.histogram(v), np.uint8) for v in (a, b))
            assert jaccard.apart(x, y) <= len(np.setxor1d(a, b))
        c = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        far = jaccard.apart(np.frombuffer(jaccard.histogram(a), np.uint8), np.frombuffer(jaccard.histogram(c), np.uint8))
        assert not jaccard.within(np.array([far]), np.array([len(a)]), np.array([len(c)]), 80)[0]


def test_first_of_groups_tells_groups_from_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcd")
    # Unrelated texts without ids, one of them twice; two texts of one id; a near copy of that id.
    rows = [(None, a), (None, b), (None, b), (None, a.upper()), (3, c), (3, d), (3, d + " more"), (3, c), (None, d), (8, c)]
    docs = spark.createDataFrame([(i, t, k, "s") for k, (i, t) in enumerate(rows)], SCHEMA)
    got = sorted(((r.doc_id, sets(r.text, 5)) for r in jaccard.first_of_groups(docs).collect()), key=repr)
    ids = sorted((i for i, _ in got), key=repr)
    assert ids == [3, 3, None, None]
    assert {s for i, s in got if i is None} == {sets(a, 5), sets(b, 5)}
    assert sets(c, 5) in [s for i, s in got if i == 3]


def test_families_keep_all_pairs(spark):
    rng = random.Random(4)
    groups = {g: rng.sample(range(100, 130), 12) for g in range(20)}  # they overlap: one family
    groups |= {50 + g: list(range(1000 + 9 * g, 1010 + 9 * g)) for g in range(12)}  # a chain: its groups are cheaper
    groups[90] = [2000, 2001, 2002]  # one component
    comp = {k: k - k % 2 for ks in groups.values() for k in ks if k < 2000} | {2001: 2000, 2002: 2000}
    members = spark.createDataFrame([(g, k) for g, ks in groups.items() for k in ks], "g long, key long")
    comps = spark.createDataFrame([(k, c) for k, c in comp.items() if rng.random() < 0.9 or k != c], "node long, comp long")
    got = {}
    for g, k in jaccard.families(members, comps).collect():
        got.setdefault(g, []).append(k)

    def pairs(sets):
        return [(a, b) for ks in sets for a in ks for b in ks if a < b and comp.get(a, a) != comp.get(b, b)]

    before, after = pairs(groups.values()), pairs(got.values())
    assert set(before) <= set(after) and len(after) < len(before)
    assert sum(max(ks) < 1000 for ks in got.values()) == 1 and sum(1000 <= min(ks) < 2000 for ks in got.values()) == 12 and len(got) == 13
    assert len(pairs(ks for ks in got.values() if max(ks) < 1000)) == len(set(pairs(ks for ks in got.values() if max(ks) < 1000)))


def test_pairs_of_overlapping_groups_are_found_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 2)
    counts, write = [], jaccard.written

    def watched(df, name):
        table = write(df, name)
        if name == "found":
            counts.append((table.count(), table.select("a", "b").distinct().count()))
        return table

    monkeypatch.setattr(jaccard, "written", watched)
    rng = random.Random(5)
    base, texts = [f"w{i}" for i in range(400)], []
    for i in range(30):  # nearly similar to each other, with many signatures in common
        t = list(base)
        for at in rng.sample(range(400), 6):
            t[at] = f"new{i}"
        texts.append(" ".join(t))
    texts.append(" ".join([*texts[3].split(), "end"]))
    check(spark, list(enumerate(texts)), 5, 80)
    assert len(counts) > 2 and counts[-1][0] == counts[-1][1] > 0
