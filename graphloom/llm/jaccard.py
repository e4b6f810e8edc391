"""N-gram Jaccard join with PartEnum signatures.

Sets are compared inside bands of similar size. Within a band, two sets whose similarity
reaches the threshold differ in at most k elements. The feature domain (64-bit shingle
hashes) is cut into parts and each part into three; where the sets differ in one element of a
part at most, they agree on two of its three pieces. A signature is the content of two such
pieces; enumerating the three pairs of pieces of every part gives signatures of which similar
sets share at least one. Nothing else is guessed: candidates are checked on the sets.

A signature of two empty pieces says nothing, and unrelated sets share it. So there are t more
parts than needed: similar sets then agree in t + 1 parts. A set in which at most t parts have
such a signature drops these. In one of the t + 1 parts it has none, so the signature that it
shares there stays on both sides; if neither set drops any, nothing changes.

How the data move:

- Equal sets form one class (copies are counted, never paired), and only classes are joined.
- Signatures travel packed, some bytes each, to buckets of a bounded number of signatures. A
  bucket pairs the classes that share a signature if they are few; a larger group gives a star
  and is remembered. A bucket that common signatures make too large for a task is passed on as
  rows, whose signatures are counted before they meet.
- A histogram of a set's hashes (a byte for every few) bounds how much two sets can have in
  common; pairs that it excludes are dropped before any set is moved.
- Sets are moved for candidate pairs only: first each class with its best partner, then the
  pairs that are still in different components.
- Groups that were too large to pair are compared by their histograms, in blocks, wherever
  they still span several components. So no link between different texts is lost. Those that
  overlap are compared as one, so that a pair is looked at once and not in each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.bpe import slices
from graphloom.llm.common import components, own_table, row_rank, small_batches, spent, unused, written

#: Ratio between the ends of a size band.
BAND = 1.2
#: Parts beyond those needed, as a share of them; so many may have signatures of empty pieces.
SPARE = 0.1
#: Classes that share a signature and are paired at once; more make a large group.
FEW = 8
#: Members of a large group that a task compares with as many others.
GROUP_BLOCK = 2048
#: Signatures of a bucket, about.
BUCKET = 600_000
#: A bucket with so many times more is passed on.
CROWDED = 4
#: Tasks that share a signature's members where a bucket is split.
SALTS = 64
#: Pieces of the hash domain in a small set's histogram; a power of two.
BINS = 256
#: The same in a coarse histogram, which tells unrelated sets apart in fewer bytes.
COARSE = 16
#: Pairs of histograms that are compared in one step.
AT_ONCE = 8192
#: Rounds in which each component of a large group meets its nearest neighbour.
ROUNDS = 4
#: Words that a worker remembers; beyond it the table starts anew.
REMEMBERED = 200_000
#: Characters of text whose signatures are packed together.
TOGETHER = 6_000_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles.

    A-Z are lower-cased; words are what ASCII white space separates. With fewer words the whole
    sequence is one shingle; without words the set is empty.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    known = own_table("shingle words", Words)
    if len(known) > REMEMBERED:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    places = len(h) - n + 1
    out = h[:places].copy()
    for i in range(1, n):
        out = out * _A + h[i : i + places]
    return np.unique(mix(out))


def set_key(h: np.ndarray) -> int:
    """A signed 64-bit name of the whole set."""
    return int(xxhash.xxh3_64_intdigest(h.tobytes())) - (1 << 63)


def histogram(h: np.ndarray, least: int = BINS, each: int = 4) -> bytes:
    """How many hashes lie in each piece of the domain, 255 at most; about ``each`` a piece, in
    ``least`` pieces at least.

    The sum of two histograms' differences never exceeds the number of elements that the sets
    differ in, and of unrelated sets it is far more than similar sets may have.
    """
    bits = max(least.bit_length() - 1, (len(h) // each).bit_length())
    return np.minimum(np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def folded(x: np.ndarray, bins: int) -> np.ndarray:
    """The same set's histogram with fewer pieces."""
    return x if len(x) == bins else np.minimum(x.reshape(bins, -1).sum(1, dtype=np.int64), 255).astype(np.uint8)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """The least number of elements that sets with these histograms differ in."""
    bins = min(len(x), len(y))
    x, y = folded(x, bins), folded(y, bins)
    return int((np.maximum(x, y) - np.minimum(x, y)).sum(dtype=np.int64))


def bands(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(least size, greatest size, k) of the size bands up to ``largest``."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * BAND))
        out.append((low, high, 2 * high * (100 - percent) // (100 + percent)))
        low = high + 1
    return out


_bands: dict[int, list[tuple[int, int, int]]] = {}


def signatures(h: np.ndarray, percent: int) -> np.ndarray:
    """The set's signatures: in its own band, and in those above where a partner may lie."""
    size, out = len(h), []
    if percent not in _bands:
        _bands[percent] = bands(percent, 1 << 40)
    total = None
    for number, (low, high, k) in enumerate(_bands[percent]):
        if high < size:
            continue
        if low > size and 100 * size < percent * low:
            break
        if not k:
            continue  # only equal sets are similar, and they are one class
        if total is None:
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + _B), dtype=np.uint64)))
        parts = (k + 2) // 2
        spare = math.ceil(parts * SPARE)
        parts += spare
        edges = (np.arange(1, 3 * parts, dtype=np.float64) / (3 * parts) * 2.0**64).astype(np.uint64)
        at = np.concatenate(([0], np.searchsorted(h, edges), [size]))
        empty = (at[1:] == at[:-1]).reshape(parts, 3)
        pieces = (total[at[1:]] - total[at[:-1]]).reshape(parts, 3)
        name = mix(np.arange(3 * parts, dtype=np.uint64) + np.uint64(number << 40)).reshape(parts, 3)
        found = mix((pieces.sum(1, dtype=np.uint64)[:, None] - pieces) ^ name)
        blank = empty.sum(1)
        if np.count_nonzero(blank >= 2) <= spare:
            found = found[blank[:, None] - empty < 2]
        out.append(found.ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def described(docs: DataFrame, words: int, id: str, text: str) -> DataFrame:
    """One row per document: id, mark (hash of the text), n, key (null if empty), and two
    histograms, sketch and coarse."""
    rows = small_batches(docs).select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sketch, coarse = [], [], [], []
            for x in batch.column(2):
                h = shingles(x.as_py() or "", words)
                n.append(len(h))
                key.append(set_key(h) if len(h) else None)
                sketch.append(histogram(h) if len(h) else None)
                coarse.append(histogram(h, COARSE, 8) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(sketch, pa.binary()), pa.array(coarse, pa.binary())], ["id", "mark", "n", "key", "sketch", "coarse"])

    return rows.mapInArrow(run, f"id {kind}, mark long, n long, key long, sketch binary, coarse binary")


def packed(docs: DataFrame, words: int, percent: int, buckets: int, text: str) -> DataFrame:
    """Signatures by bucket: for each run of texts, 6 bytes a signature, 2 that say whose it is,
    and the keys. Copies in a run send theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), TOGETHER):
                found: dict[int, np.ndarray] = {}
                for x in batch.column(0).slice(a, b - a):
                    h = shingles(x.as_py() or "", words)
                    if len(h):
                        key = set_key(h)
                        if key not in found and len(s := signatures(h, percent)):
                            found[key] = s
                keys = np.array(list(found), np.int64)
                for c in range(0, len(keys), 60_000):
                    yield pack(keys[c : c + 60_000], list(found.values())[c : c + 60_000], buckets)

    return docs.select(F.col(text)).mapInArrow(run, "bucket long, sig binary, who binary, keys binary")


def pack(keys: np.ndarray, found: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    sig = np.concatenate(found)
    who = np.repeat(np.arange(len(keys)), [len(x) for x in found])
    bucket = (sig % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sig, who, bucket = (sig // np.uint64(buckets))[order], who[order], bucket[order]
    low = sig.view(np.uint8).reshape(-1, 8)[:, :6]
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    rows: list[list] = [[], [], [], []]
    for a, b in pairwise(edges):
        mine, at = np.unique(who[a:b], return_inverse=True)
        for column, value in zip(rows, (int(bucket[a]), low[a:b].tobytes(), at.astype(np.uint16).tobytes(), keys[mine].tobytes()), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *[pa.array(r, pa.binary()) for r in rows[1:]]], ["bucket", "sig", "who", "keys"])


def unpacked(sigs: pa.Array, who: pa.Array, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of packed rows, without their bucket, and whose they are."""
    sig, key = [], []
    for s, w, k in zip(sigs, who, keys, strict=True):
        raw = np.frombuffer(s.as_buffer(), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        sig.append(wide.view(np.int64).ravel())
        key.append(np.frombuffer(k.as_buffer(), np.int64)[np.frombuffer(w.as_buffer(), np.uint16)])
    return np.concatenate(sig), np.concatenate(key)


def split(rows: DataFrame) -> DataFrame:
    """What :func:`meet` gives, for signatures ``g`` of classes ``key`` that it passed on.

    Signatures are counted first, by an aggregate that combines before it moves rows; each member
    of a large group then learns its group from that count, salted over :data:`SALTS` tasks.
    """
    each = written(rows.distinct(), "signatures")
    count = each.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("first")).where("m > 1")
    count = written(count, "counts")
    few = each.join(count.where(F.col("m") <= FEW).select("g"), "g").groupBy("g").agg(F.sort_array(F.collect_list("key")).alias("all"))
    pairs = few.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a < b")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    large = count.where(F.col("m") > FEW).select("g", "first", salt.alias("salt"))
    members = each.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(large, ["g", "salt"])
    members = written(members.select("g", "first", "key"), "met")
    pairs = written(pairs.union(members.where("first <> key").select("first", "key")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")), "met")
    spent(each, count)
    return pairs.union(members.select("g", "key", F.lit(0).cast("long")))


def named(sig: np.ndarray, bucket: int) -> np.ndarray:
    """Signatures of a bucket, told apart from those of others."""
    return mix(sig.view(np.uint64) + mix(np.array([bucket + 1], np.uint64))).view(np.int64)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of one bucket that share signatures.

    Rows (a, b, w): a pair and how many signatures it shares here; or, with w = 0, a member b
    of the large group a. A crowded bucket gives each signature a and its class b, with w = -1.
    """
    bucket, sigs, keys, total, crowded = 0, [], [], 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column("bucket")[0].as_py()
        sig, key = unpacked(batch.column("sig"), batch.column("who"), batch.column("keys"))
        sigs.append(sig)
        keys.append(key)
        total += len(sig)
        crowded = crowded or total > CROWDED * BUCKET
        while crowded and sigs:
            g, b = named(sigs.pop(), bucket), keys.pop()
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(b), pa.array(np.full(len(g), -1))], ["a", "b", "w"])
    if not sigs:
        return
    sig, key = np.concatenate(sigs), np.concatenate(keys)
    del sigs, keys
    # Most signatures occur once and go at once.
    order = np.argsort(sig)
    same = sig[order[1:]] == sig[order[:-1]]
    order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    sig, key = sig[order], key[order]
    del order, same
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key = sig[fresh], key[fresh]
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((first, [len(sig)])))
    of = np.repeat(np.arange(len(first)), size)
    place = np.arange(len(sig)) - first[of] if len(sig) else of
    large = size[of] > FEW if len(sig) else np.zeros(0, bool)
    left, right = [], []
    for d in range(1, FEW):
        at = np.flatnonzero(~large & (place + d < size[of]))
        left.append(key[at])
        right.append(key[at + d])
    star = np.flatnonzero(large & (place > 0))
    left.append(key[first[of[star]]])
    right.append(key[star])
    a, b = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    edge = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    w = np.diff(np.concatenate((edge, [len(a)])))
    group = named(sig[large], bucket)
    out = (np.concatenate((a[edge], group)), np.concatenate((b[edge], key[large])), np.concatenate((w, np.zeros(len(group), np.int64))))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["a", "b", "w"])


def within(differ: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar if they differ in so many elements at least."""
    return ((100 + percent) * differ <= (100 - percent) * (nx + ny)) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))


def plausible(pairs: DataFrame, classes: DataFrame, percent: int, sketch: str) -> DataFrame:
    """The pairs (a, b, ...) that sizes and the histograms ``sketch`` do not exclude."""
    side = lambda c: classes.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col(sketch).alias(f"s_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = [apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            keep = within(np.array(differ, np.int64), batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays(batch.columns[4:], names).filter(pa.array(keep))

    return rows.select("s_a", "s_b", "n_a", "n_b", *names).mapInArrow(run, pairs.schema)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, id: str, text: str) -> DataFrame:
    """The pairs (a, b) of classes that are similar, by their whole sets."""
    pairs = written(pairs.select("a", "b"), "pairs")
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    chosen = written(classes.join(keys, "key", "left_semi").select("key", "least"), "chosen")
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    # A class without any id is found among the documents without one.
    texts = rows.join(chosen.select(F.col("least").alias("id")), "id", "left_semi").select("text").union(rows.where("id IS NULL").select("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 20):
                found = {set_key(h): h.tobytes() for h in (shingles(x.as_py() or "", words) for x in batch.column(0).slice(a, b - a)) if len(h)}
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], ["key", "elements"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((p, q))
                both.sort(kind="stable")  # two sorted runs: a merge
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    made = texts.mapInArrow(sets, "key long, elements binary").join(chosen.select("key"), "key", "left_semi").dropDuplicates(["key"])
    made = written(made, "sets")
    rows = pairs.join(made.select(F.col("key").alias("a"), F.col("elements").alias("x")), "a").join(made.select(F.col("key").alias("b"), F.col("elements").alias("y")), "b")
    out = written(rows.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "similar")
    spent(pairs, chosen, made)
    return out


def labelled(rows: DataFrame, comps: DataFrame, key: str, out: str) -> DataFrame:
    """Add the component of ``key``; a class in no link is its own."""
    known = comps.select(F.col("node").alias(key), F.col("comp").alias("_c"))
    return rows.join(known, key, "left").withColumn(out, F.coalesce("_c", key)).drop("_c")


def large_pairs(members: DataFrame, classes: DataFrame, comps: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Plausible pairs (g, a, b) in different components inside the large groups g.

    ``members`` (g, key). Groups within one component are done. Of the others, the members of the
    largest component are compared with the rest and the rest with each other, so a group that is
    nearly merged costs in proportion to its size. Each two blocks of members meet in one task, by
    their histograms. With ``nearest`` each component gives its nearest plausible pair only.
    """
    rows = written(labelled(members, comps, "key", "comp"), "members")
    mixed = rows.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("g")
    mixed = mixed.agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    mixed = mixed.select("g", "m", F.col("top.comp").alias("lead"), F.col("top.c").alias("leads"))
    mixed = written(rows.join(mixed, "g").withColumn("main", F.col("comp") == F.col("lead")), "mixed")
    # Only groups of several blocks need ranks.
    rows = mixed.where(F.col("m") <= GROUP_BLOCK).select("g", "key", "comp", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("last"))
    blocks = lambda n: F.floor((n + (GROUP_BLOCK - 1)) / GROUP_BLOCK)
    rest, main = blocks(F.col("m") - F.col("leads")), blocks(F.col("leads"))
    wide = row_rank(mixed.where(F.col("m") > GROUP_BLOCK), ["g", "main"], ["key"], "at")
    wide = wide.withColumn("block", F.floor(F.col("at") / GROUP_BLOCK) + F.when(F.col("main"), rest).otherwise(0))
    wide = wide.withColumn("last", rest - 1 + F.when(F.col("main"), 0).otherwise(main))
    rows = rows.unionByName(wide.select("g", "key", "comp", "block", "last"))
    rows = rows.join(classes.select("key", "n", "sketch"), "key")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    rows = rows.select("g", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "key", "comp", "n", "sketch")

    def run(table: pa.Table) -> pa.Table:
        key, comp, n, block = (table[c].to_numpy() for c in ("key", "comp", "n", "block"))
        full = [np.frombuffer(x, np.uint8) for x in table["sketch"].to_pylist()]
        sketch = np.stack([folded(x, min(map(len, full))) for x in full])
        first, last = table["p"][0].as_py(), table["q"][0].as_py()
        x, y = np.flatnonzero(block == first), np.flatnonzero(block == last)
        left, right, differ = [], [], []
        step = max(1, AT_ONCE // max(1, len(y)))
        for s in range(0, len(x), step):
            # Sizes and components first: histograms are compared only where they can matter.
            i = x[s : s + step, None]
            ok = (comp[i] != comp[y]) & (100 * np.minimum(n[i], n[y]) >= percent * np.maximum(n[i], n[y]))
            if first == last:
                ok &= y > i
            u, v = np.nonzero(ok)
            u, v = x[s + u], y[v]
            for c in range(0, len(u), AT_ONCE):
                p, q = u[c : c + AT_ONCE], v[c : c + AT_ONCE]
                d = (np.maximum(sketch[p], sketch[q]) - np.minimum(sketch[p], sketch[q])).sum(-1, dtype=np.int64)
                near = within(d, n[p], n[q], percent)
                p, q = p[near], q[near]
                d = np.array([apart(full[k], full[m]) for k, m in zip(p.tolist(), q.tolist(), strict=True)], np.int64)
                near = within(d, n[p], n[q], percent)
                left.append(p[near])
                right.append(q[near])
                differ.append(d[near])
        p, q, d = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (left, right, differ))
        if nearest and len(p):
            # The nearest pair of each component, from either side.
            side, pair, far = np.concatenate((comp[p], comp[q])), np.tile(np.arange(len(p)), 2), np.tile(d, 2)
            order = np.lexsort((pair, far, side))
            keep = np.unique(pair[order[np.concatenate(([True], side[order][1:] != side[order][:-1]))]])
            p, q = p[keep], q[keep]
        a, b = np.minimum(key[p], key[q]), np.maximum(key[p], key[q])
        return pa.table({"g": np.full(len(a), table["g"][0].as_py(), np.int64), "a": a, "b": b})

    return rows.groupBy("g", "p", "q").applyInArrow(run, "g long, a long, b long")


def compared(rows: DataFrame, by: list[str]) -> DataFrame:
    """The pairs that :func:`large_pairs` looks at in each group of ``rows`` (by, key, comp)."""
    sizes = rows.groupBy(*by, "comp").agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(F.max("c").alias("lead"), (F.sum("c") - F.max("c")).alias("rest"))
    return sizes.select(*by, F.expr("rest * lead + rest * (rest - 1) div 2").alias("cost"))


def families(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (g, key) of fewer large groups, in which all pairs of the groups ``members`` meet
    that lie in different components.

    Near copies share most of their signatures, so the same pair lies in hundreds of groups. Groups
    that overlap, directly or by others, form a family, and in it a pair lies once. A family takes
    the place of its groups where that gives no more pairs to look at; the others stay as they are.
    """
    rows = written(labelled(members, comps, "key", "comp"), "members")
    mixed = rows.groupBy("g").agg(F.min("key").alias("first"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    mixed = written(mixed.select("g", "first"), "mixed")
    family = components(rows.join(mixed, "g").select(F.col("first").alias("a"), F.col("key").alias("b")))
    family_of = mixed.join(family.select(F.col("node").alias("first"), F.col("comp").alias("f")), "first").select("g", "f")
    each = written(rows.join(family_of, "g").select("f", "g", "key", "comp"), "members")
    whole = written(each.select("f", "key", "comp").distinct(), "families")
    apiece = compared(each, ["f", "g"]).groupBy("f").agg(F.sum("cost").alias("apiece"))
    chosen = written(compared(whole, ["f"]).join(apiece, "f").where("cost <= apiece").select("f"), "chosen")
    out = whole.join(chosen, "f", "left_semi").select(F.col("f").alias("g"), "key").union(each.join(chosen, "f", "left_anti").select("g", "key"))
    out = written(out, "groups")
    spent(rows, mixed, family, each, whole, chosen)
    return out


def joined(similar: DataFrame, comps: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All similar pairs and their components, after ``new`` ones; the old tables are deleted."""
    grown = written(similar.union(new), "similar")
    spent(similar, new, comps)
    return grown, components(grown)


def join(docs: DataFrame, words: int = 3, percent: int = 90, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, mark (xxhash64 of the text), n_shingles, component_id.

    Two documents link when their sets' Jaccard similarity is ``percent`` or more; component_id
    is the least id reachable. Null and empty texts have no shingles, link with nothing and are
    their own component. Equal texts with one id are one document repeated. A null id never
    names a component that has another. Sets and shingles are told apart by 64-bit hashes.
    Other columns are not read; empty tables give empty results.
    """
    return grouped(docs, words, percent, id, text).drop("comp")


def grouped(docs: DataFrame, words: int, percent: int, id: str, text: str) -> DataFrame:
    """What :func:`join` gives, and comp: the name of the component itself, which unlike its least
    id no other component has; null without words."""
    rows = written(described(docs, words, id, text), "described")
    classes = written(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("coarse").alias("coarse")), "classes")
    elements = classes.agg(F.sum("n")).first()[0] or 0
    # Each set has signatures in about so many bands.
    spread = 1 + math.log(100 / percent) / math.log(BAND)
    expected = elements * 3 * (100 - percent) / (100 + percent) * BAND * (1 + SPARE) * spread
    buckets = max(8, int(expected / BUCKET) + 1)
    met = written(packed(docs, words, percent, buckets, text).groupBy("bucket").applyInArrow(meet, "a long, b long, w long"), "met")
    crowded = met.where("w < 0")
    if not crowded.isEmpty():
        whole = written(met.where("w >= 0").union(split(crowded.select(F.col("a").alias("g"), F.col("b").alias("key")))), "met")
        spent(met)
        met = whole
    pairs = met.where("w > 0").groupBy("a", "b").agg(F.sum("w").alias("w"))
    # Most pairs fall to the coarse histograms; the others meet the fine ones.
    rough = written(plausible(pairs, classes, percent, "coarse"), "plausible")
    pairs = written(plausible(rough, classes, percent, "sketch"), "plausible")
    spent(rough)

    # Each class with the partner that shares most with it.
    ends = pairs.select("a", "b", "w", F.col("a").alias("node")).union(pairs.select("a", "b", "w", F.col("b").alias("node")))
    best = written(ends.groupBy("node").agg(F.max(F.struct("w", "a", "b")).alias("top")).select("top.a", "top.b").distinct(), "best")
    similar = verified(best, docs, classes, words, percent, id, text)
    comps = components(similar)
    # Pairs that would still join components.
    rest = labelled(labelled(pairs.join(best, ["a", "b"], "left_anti"), comps, "a", "ca"), comps, "b", "cb").where("ca <> cb").select("a", "b")
    rest = written(rest, "rest")
    if not rest.isEmpty():
        similar, comps = joined(similar, comps, verified(rest, docs, classes, words, percent, id, text))
    tried = written(best.union(rest), "tried")
    spent(best, rest, pairs)
    members = written(met.where("w = 0").select(F.col("a").alias("g"), F.col("b").alias("key")), "groups")
    spent(met)
    # Few pairs merge most components; what they leave apart is then compared in full.
    nearest, turn = True, 0
    while not members.isEmpty():
        if turn == 1:  # the groups without a plausible pair, which chain the others, are gone
            fewer = families(members, comps)
            spent(members)
            members = fewer
        found = written(large_pairs(members, classes, comps, percent, nearest), "found")
        more = written(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "more")
        merged = False
        if not more.isEmpty():
            new = verified(more, docs, classes, words, percent, id, text)
            grown = written(tried.union(more), "tried")
            spent(tried)
            tried, merged = grown, not new.isEmpty()
            if merged:
                similar, comps = joined(similar, comps, new)
        # Components only grow: a group without a plausible pair now has none later.
        left = written(members.join(found.select("g").distinct(), "g", "left_semi"), "groups")
        spent(members, found, more)
        members = left
        if not nearest:
            break
        turn += 1
        nearest = (merged or turn == 1) and turn < ROUNDS
    spent(tried, members, similar)

    known = labelled(classes.select("key", "least"), comps, "key", "comp")
    lowest = written(known.groupBy("comp").agg(F.min("least").alias("component")), "lowest")
    named = written(known.join(lowest, "comp").select("key", "comp", "component"), "named")
    out = rows.join(named, "key", "left")
    return out.select(F.col("id").alias(id), "mark", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"), "comp")


def first_of_groups(docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of which none before is a near-duplicate: one of each component stays.

    It is the document with the least id, one without an id only where no other is; of rows that
    repeat its id and text, one. Components are told apart by their texts, never by their ids.
    Documents without words link with nothing and all stay. All columns of ``docs`` are kept.
    """
    got = grouped(docs, words, percent, id, text)
    lonely = got.where("n_shingles = 0").select(id, "mark").distinct()
    lead = got.where("n_shingles > 0").where(F.col(id).eqNullSafe(F.col("component_id"))).groupBy("comp").agg(F.min(F.struct(F.col(id), F.col("mark"))).alias("one")).select("one.*")
    q = unused(docs, "_q")
    stay = written(lead.select(F.col(id).alias(f"{q}_id"), F.col("mark").alias(f"{q}_mark"), F.lit(True).alias(f"{q}_once")).union(lonely.select(id, "mark", F.lit(False))), "stay")
    marked = docs.withColumn(f"{q}_own", F.xxhash64(F.col(text)))
    rows = marked.join(stay, F.col(id).eqNullSafe(F.col(f"{q}_id")) & (F.col(f"{q}_own") == F.col(f"{q}_mark")))
    again = F.row_number().over(Window.partitionBy(id, f"{q}_own").orderBy(F.lit(0)))
    return rows.withColumn(f"{q}_again", again).where(~F.col(f"{q}_once") | (F.col(f"{q}_again") == 1)).select(*docs.columns)
