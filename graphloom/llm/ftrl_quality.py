"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

A text's features are n-grams of its words and of its words' shapes (case, digits and the
marks around the word), hashed into one weight vector. Labels are learned from a bounded
sample; every text is scored where it is read, without a shuffle. The weights have a fixed
size, whatever the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.bpe import TOGETHER, slices
from graphloom.llm.common import own_table, small_batches

#: Weights: 2 ** BITS.
BITS = 18
#: Labelled rows that are learned from, at most. They are those with the least hash of the id.
TRAIN_ROWS = 4000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
#: Words that a worker remembers; beyond it the table starts anew.
REMEMBERED = 200_000
#: A text's feature values sum to this number, whatever its length.
MASS = 20.0
THRESHOLD = 0.3

_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def shape(word: str) -> str:
    """Case and kind of a word's characters, runs shortened, e.g. ``Xx``, ``X!`` or ``x*``."""
    out = ""
    for c in word[:40]:
        k = "x" if c.islower() else "X" if c.isupper() else "w" if c.isalpha() else "0" if c.isdigit() else c
        if not out.endswith(k):
            out += k
    return out[:8]


class Words(dict):
    """word -> number; the number's hash and shape hash are kept in arrays."""

    def __init__(self) -> None:
        self.hash = np.zeros(1024, np.uint32)
        self.form = np.zeros(1024, np.uint32)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.hash):
            self.hash, self.form = np.resize(self.hash, 2 * n), np.resize(self.form, 2 * n)
        self.hash[n] = zlib.crc32(word.lower().encode("utf-8", "replace"))
        self.form[n] = zlib.crc32(b"shape " + shape(word).encode("utf-8", "replace"))
        self[word] = n
        return n

    def of(self, text: str) -> np.ndarray:
        """The numbers of a text's words."""
        if len(self) > REMEMBERED:
            self.clear()
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Indices of the text's features, as often as they occur; one for an empty text."""
    known = own_table("quality words", Words)
    at = known.of(text)
    if not len(at):
        return np.zeros(1, np.int64)
    h, s = known.hash[at], known.form[at]
    again = (h[1:] == h[:-1]).astype(np.uint32)
    parts = [h, s, h[:-1] * _M1 + h[1:] * _M2 + np.uint32(1), s[:-1] * _M1 + s[1:] * _M2 + np.uint32(2), s[:-2] * _M1 + s[1:-1] * _M2 + s[2:] * _M3 + np.uint32(3), again * _M3 + np.uint32(4)]
    return ((np.concatenate(parts) * _M1) >> np.uint32(32 - bits)).astype(np.int64)


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and how often each occurs."""
    at, count = np.unique(x.astype(np.int32), return_counts=True)
    return at, count.astype(np.float32)


def train(sparse: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal updates, one text (features, counts) at a time."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(sparse)):
            at, count = sparse[i]
            x = count * (MASS / count.sum())
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= L1, 0.0, (np.sign(za) * L1 - za) / ((BETA + np.sqrt(na)) / ALPHA + L2))
            b = -zb / ((BETA + nb**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35))) - labels[i]
            gx = g * x
            step = (np.sqrt(na + gx * gx) - np.sqrt(na)) / ALPHA
            z[at], n[at] = za + gx - step * w, na + gx * gx
            step = ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA
            zb, nb = zb + g - step * b, nb + g * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32), float(-zb / ((BETA + nb**0.5) / ALPHA))


def held_out(id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``fold`` modulo ``folds``; null ids do not."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id.cast("string"), "UTF-8")), F.lit(folds)) == fold, F.lit(False))


def known_labels(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, id: str) -> DataFrame:
    """The labels (id, label) of ids that ``docs`` has and that are not held out; an id with several has a row each."""
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("id"), folds, fold))
    return known.join(docs.select(F.col(id).alias("id")), "id", "left_semi")


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, id: str, text: str) -> DataFrame:
    """At most ``rows`` labelled texts (text, label) that are not held out.

    Labels are chosen first, among those of ids that ``docs`` has, by the least hash of the id, so
    the side that is sent to the scan has at most ``rows`` rows and labels of other documents take
    no room. Of an id with several labels or texts, the least are taken.
    """
    known = known_labels(docs, labels, label, folds, fold, id)
    known = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return texts.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, rows: int = TRAIN_ROWS, id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, float]:
    """Train on the bounded sample. Features are made by the tasks; the driver updates.

    Without two classes to learn from the weights are zero and the bias favours keeping.
    """
    chosen = sample(docs, labels, label, folds, fold, rows, id, text).select("id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                got = [counted(features(t or "")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *[pa.array([x[k].tobytes() for x in got], pa.binary()) for k in (0, 1)]], ["id", "label", "x", "n"])

    got = chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, label int, x binary, n binary").toArrow().sort_by("id")
    y = got["label"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return np.zeros(1 << BITS, np.float32), 0.0
    views = [[np.frombuffer(v.as_buffer(), kind) for v in got[c]] for c, kind in (("x", np.int32), ("n", np.float32))]
    return train(list(zip(*views, strict=True)), y)


def score_texts(model: tuple[np.ndarray, float], texts: list[str | None]) -> list[float]:
    w, b = model
    out = []
    for t in texts:
        x = features(t or "")
        out.append(1 / (1 + float(np.exp(-np.clip(w[x].sum(dtype=np.float64) * MASS / len(x) + b, -35, 35)))))
    return out


def scored(docs: DataFrame, score: Callable[[list[str | None]], Sequence[float]], text: str, back: list[str], together: int = TOGETHER) -> DataFrame:
    """(doc, score): the columns ``back`` of each row as one struct, so that no name can clash,
    and the score of its text."""
    at = [docs.columns.index(c) for c in back]
    kept = T.StructType([docs.schema[i] for i in at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = columns[docs_text]
            for a, b in slices(texts, together):
                part = pa.StructArray.from_arrays([columns[i].slice(a, b - a) for i in at], kept.names)
                yield pa.RecordBatch.from_arrays([part, pa.array(score(texts.slice(a, b - a).to_pylist()), pa.float64())], ["doc", "score"])

    docs_text = docs.columns.index(text)
    schema = T.StructType([T.StructField("doc", kept), T.StructField("score", T.DoubleType())])
    return docs.select(F.struct("*").alias("doc")).mapInArrow(run, schema)


def report(docs: DataFrame, score: Callable[[list[str | None]], Sequence[float]], folds: int, fold: int, id: str, text: str, together: int = TOGETHER) -> DataFrame:
    """id, held_out, score and predicted of every row."""
    got = scored(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), score, "text", ["id"], together)
    return got.select(F.col("doc.id").alias(id), held_out(F.col("doc.id"), folds, fold).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def model_scores(docs: DataFrame, labels: DataFrame, folds: int, fold: int, rows: int, id: str, text: str, label: str) -> Callable[[list[str | None]], list[float]]:
    """What scores texts in the tasks, by a model learned from ``docs`` and ``labels``."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(small_batches(docs), labels, folds, fold, rows, id, text, label))
    return lambda texts: score_texts(sent.value, texts)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, rows: int = TRAIN_ROWS, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Score every whole text: id, held_out, score, predicted (1 if score >= 0.3).

    A null text counts as empty; empty texts share one feature and get its score. Null ids are
    scored and never learned from. Labels outside 0 and 1 are not learned, nor are labels of ids
    that ``docs`` lacks. Repeated rows are scored repeatedly. Other columns are not read.
    """
    return report(docs, model_scores(docs, labels, folds, fold, rows, id, text, label), folds, fold, id, text)


def accepted(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, rows: int = TRAIN_ROWS, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that :func:`classify` predicts 1 for, with all their columns, whatever
    these are called. Edge cases are those of classify."""
    return scored(docs, model_scores(docs, labels, folds, fold, rows, id, text, label), text, docs.columns).where(F.col("score") >= THRESHOLD).select("doc.*")
