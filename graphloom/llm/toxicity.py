"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of hashed rows for the word and for its first letters, so that
inflected forms of a known word are near it. Filters of several widths run over the whole
text, max pooling takes their strongest place, and a logistic layer gives the score. Training
is plain numpy on a bounded sample of labelled rows. Thresholds are calibrated for each
language, which is told from the text's own function words; scores are shifted so that every
language's threshold lies at 0.3. Texts are scored where they are read, without a shuffle;
the model has a fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import slices
from graphloom.llm.common import own_table, small_batches
from graphloom.llm.ftrl_quality import known_labels, report, scored

#: Rows of the embedding table: 2 ** BITS; row 0 stands for the space beyond a text.
BITS = 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Labelled rows of each class that are learned from, at most: those with the least hash.
TRAIN_ROWS = 2500
EPOCHS = 8
BATCH = 32
RATE = 0.05
THRESHOLD = 0.3
#: A language with fewer calibration texts of either class takes the common threshold.
LEAST_CALIBRATION = 8
REMEMBERED = 150_000
#: Characters of text whose words are held as vectors at a time.
TOGETHER = 2_000_000

#: Function words by which a text's language is told (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on be by this".split(),
    "fr": "le la les des du et que qui pour une dans sur est avec il elle".split(),
    "de": "der die das und ist nicht ein eine zu mit von den dem im auf sich".split(),
    "es": "el los las del que y por con para una se su al lo es no".split(),
}
LANGUAGES = [*FUNCTION_WORDS]
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


class Words(dict):
    """word -> number; the number's embedding rows and language marks are kept in arrays."""

    def __init__(self) -> None:
        self.rows = np.zeros((1024, 3), np.int32)
        self.marks = np.zeros((1024, len(LANGUAGES)), np.int8)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.rows):
            self.rows, self.marks = (np.concatenate((x, np.zeros_like(x))) for x in (self.rows, self.marks))
        w = _EDGE.sub("", word.lower()) or word.lower()
        keys = (w, "4 " + w[:4], "5 " + w[:5])
        self.rows[n] = [1 + zlib.crc32(k.encode("utf-8", "replace")) % ((1 << BITS) - 1) for k in keys]
        self.marks[n] = [w in FUNCTION_WORDS[x] for x in LANGUAGES]
        self[word] = n
        return n

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def text_rows(text: str) -> tuple[np.ndarray, int]:
    """Embedding rows of the words (n x 3) and the language: an index, or -1 if it is unclear."""
    known = own_table("toxicity words", Words)
    if len(known) > REMEMBERED:
        known.clear()
    at = known.of(text)
    marks = known.marks[at].sum(0, dtype=np.int64)
    best = int(marks.argmax())
    clear = len(at) and marks[best] and (marks == marks[best]).sum() == 1
    return known.rows[at], best if clear else -1


@dataclass
class Model:
    table: np.ndarray  # rows x DIM
    kernels: list[np.ndarray]  # for each width: width x DIM x FILTERS
    shift: np.ndarray  # widths x FILTERS
    out: np.ndarray  # widths * FILTERS
    bias: float
    limits: np.ndarray  # logits of the thresholds by language; the last is the common one


def join_texts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' rows in one array, each with the widest filter's space behind it; begin, end."""
    gap = np.zeros((max(WIDTHS), 3), np.int32)
    sizes = np.array([len(x) + len(gap) for x in texts])
    ends = np.cumsum(sizes)
    return np.concatenate([y for x in texts for y in (x, gap)]), ends - sizes, ends - len(gap) + 1


def convolve(m: Model, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """For each width the filters' values at every place; places beyond a text's end are out."""
    out = []
    beyond = np.concatenate([np.arange(a, b) for a, b in zip(end, [*begin[1:], len(x)], strict=True)])
    for k in m.kernels:
        places = len(x) - len(k) + 1
        y = np.full((len(x), FILTERS), -np.inf, np.float32)
        y[:places] = sum(x[j : j + places] @ k[j] for j in range(len(k)))
        y[beyond] = -np.inf
        out.append(y)
    return out


def logits(m: Model, texts: list[np.ndarray]) -> np.ndarray:
    rows, begin, end = join_texts(texts)
    x = m.table[rows[:, 0]] + m.table[rows[:, 1]] + m.table[rows[:, 2]]
    best = np.concatenate([np.maximum.reduceat(y, begin) for y in convolve(m, x, begin, end)], 1)
    return np.maximum(best + m.shift.ravel(), 0) @ m.out + m.bias


def start(texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> Model:
    """A model whose first dimension holds each row's smoothed log-odds; rows never seen are 0."""
    seen = np.zeros((2, 1 << BITS))
    for x, y in zip(texts, labels, strict=True):
        seen[int(y), np.unique(x)] += 1
    n = np.bincount(labels.astype(int), minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    known = seen.sum(0) > 0
    table = rng.normal(0, 0.02, (1 << BITS, DIM)).astype(np.float32)
    table[:, 0] += np.clip(odds, -3, 6) / 3 * np.minimum(1, seen.sum(0) / 10)
    table[~known] = 0
    table[0] = 0
    kernels = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for k in kernels:
        k[:, 0] = np.abs(k[:, 0]) + 0.5 / len(k)
    return Model(table, kernels, np.full((len(WIDTHS), FILTERS), -0.5, np.float32), np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), -1.0, np.zeros(len(LANGUAGES) + 1))


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Adagrad on the logistic loss; gradients reach only the places that max pooling took."""
    rng = np.random.default_rng(seed)
    m = start(texts, labels, rng)
    square = {"table": np.full_like(m.table, 1e-2), "kernels": [np.full_like(k, 1e-2) for k in m.kernels], "shift": np.full_like(m.shift, 1e-2), "out": np.full_like(m.out, 1e-2), "bias": 1e-2}
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            rows, begin, end = join_texts([texts[i] for i in pick])
            x = m.table[rows].sum(1)
            n = len(pick)
            places, best = [], []
            for y in convolve(m, x, begin, end):
                p = np.stack([b + y[b:e].argmax(0) for b, e in zip(begin, end, strict=True)])
                places.append(p)
                best.append(y[p, np.arange(FILTERS)])
            raw = np.concatenate(best, 1) + m.shift.ravel()
            h = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.bias, -30, 30)))
            dz = ((p - labels[pick]) / n).astype(np.float32)
            dh = dz[:, None] * m.out * (raw > 0)
            dx_at, dx = [], []
            for wi, k in enumerate(m.kernels):
                d = dh[:, wi * FILTERS : (wi + 1) * FILTERS]
                dk = np.empty_like(k)
                for j in range(len(k)):
                    at = places[wi] + j
                    dk[j] = np.einsum("nfd,nf->df", x[at], d)
                    dx_at.append(at.ravel())
                    dx.append((d[:, :, None] * k[j].T[None]).reshape(-1, DIM))
                square["kernels"][wi] += dk * dk
                k -= RATE * dk / np.sqrt(square["kernels"][wi])
            for name, g in (("shift", dh.sum(0).reshape(m.shift.shape)), ("out", dz @ h)):
                square[name] += g * g
                setattr(m, name, getattr(m, name) - RATE * g / np.sqrt(square[name]))
            square["bias"] += float(dz.sum()) ** 2
            m.bias -= RATE * float(dz.sum()) / square["bias"] ** 0.5
            touched, where = np.unique(rows[np.concatenate(dx_at)], return_inverse=True)
            g = np.zeros((len(touched), DIM), np.float32)
            np.add.at(g, where.reshape(-1), np.repeat(np.concatenate(dx), 3, axis=0))
            g[touched == 0] = 0
            square["table"][touched] += g * g
            m.table[touched] -= RATE * g / np.sqrt(square["table"][touched])
    return m


def best_limit(score: np.ndarray, label: np.ndarray) -> float:
    """The middle of the gap of scores that parts the classes with the fewest errors."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], label[order]
    # Errors when the first k texts are called clean.
    errors = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))
    inner = np.flatnonzero(errors == errors.min())
    edge = np.concatenate(([s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]))
    return float(edge[inner[len(inner) // 2]])


def calibrate(m: Model, texts: list[np.ndarray], languages: np.ndarray, labels: np.ndarray) -> None:
    """Set the model's limits by language from texts that it was not trained on."""
    if len(set(labels)) < 2:
        return
    s = np.concatenate([logits(m, texts[a : a + BATCH]) for a in range(0, len(texts), BATCH)])
    m.limits[:] = best_limit(s, labels)
    for k in range(len(LANGUAGES)):
        mine = languages == k
        if min(np.bincount(labels[mine].astype(int), minlength=2)) >= LEAST_CALIBRATION:
            m.limits[k] = best_limit(s[mine], labels[mine])


def fit(texts: list[np.ndarray], languages: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Train on four fifths of the sample, calibrate on the rest."""
    if len(set(labels)) < 2:
        m = start(texts or [np.zeros((0, 3), np.int32)], np.zeros(max(1, len(texts))), np.random.default_rng(0))
        m.out[:], m.bias = 0, -4.0
        return m
    rest = np.arange(len(texts)) % 5 == 0
    part = lambda keep: [x for x, k in zip(texts, keep, strict=True) if k]
    m = train(part(~rest), labels[~rest], epochs)
    calibrate(m, part(rest), languages[rest], labels[rest])
    return m


def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, rows: int = TRAIN_ROWS, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most ``rows`` labelled texts of each class that are not held out, of ids that
    ``docs`` has."""
    known = known_labels(docs, labels, label, folds, fold, id).groupBy("id").agg(F.max("label").alias("label"))
    least = lambda y: known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(rows)
    chosen = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(least(0).union(least(1))), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    chosen = chosen.select("id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), TOGETHER):
                part = batch.slice(a, b - a)
                got = [text_rows(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([k for _, k in got], pa.int32()), pa.array([x.tobytes() for x, _ in got], pa.binary())], ["id", "label", "language", "x"])

    got = chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, label int, language int, x binary").toArrow().sort_by("id")
    return fit([np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 3) for x in got["x"]], got["language"].to_numpy(), got["label"].to_numpy().astype(float))


def score_texts(m: Model, texts: list[str | None]) -> np.ndarray:
    got = [text_rows(t or "") for t in texts]
    z = logits(m, [x for x, _ in got]) - m.limits[[k for _, k in got]] + np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -35, 35)))


def model_scores(docs: DataFrame, labels: DataFrame, folds: int, fold: int, rows: int, id: str, text: str, label: str) -> Callable[[list[str | None]], np.ndarray]:
    """What scores texts in the tasks, by a model learned from ``docs`` and ``labels``."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(small_batches(docs), labels, folds, fold, rows, id, text, label))
    return lambda texts: score_texts(sent.value, texts)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, rows: int = TRAIN_ROWS, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Score every whole text: id, held_out, score, predicted (1 if score >= 0.3).

    A null text counts as empty; an empty text has no word and gets the score of one. Null ids
    are scored and never learned from. Labels outside 0 and 1 are not learned, nor are labels of
    ids that ``docs`` lacks. Repeated rows are scored repeatedly. Other columns are not read.
    """
    return report(docs, model_scores(docs, labels, folds, fold, rows, id, text, label), folds, fold, id, text, TOGETHER)


def clean(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, rows: int = TRAIN_ROWS, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that :func:`classify` predicts 0 for, with all their columns, whatever
    these are called. Edge cases are those of classify."""
    return scored(docs, model_scores(docs, labels, folds, fold, rows, id, text, label), text, docs.columns, TOGETHER).where(F.col("score") < THRESHOLD).select("doc.*")
