"""BPE encoding with a pair occurrence index, and decoding.

Encoding treats the new words of a batch together. Their symbols lie in one flat array; an
index maps each mergeable pair to all its positions. Active ranks are taken in ascending
order from a heap; a rank is applied to every position of its pair at once, and only the
lists of the pairs to the left and right of those positions change. Words are independent, so
the least rank of the whole batch is the least rank of each word that holds it.

Words that were met before come from a bounded table in the worker, so a task's memory does
not grow with its input. There is no shuffle: each text is encoded where it is read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import own_table, small_batches

#: Chunks that a worker remembers; beyond it the table starts anew.
REMEMBERED = 300_000
#: Characters of text that are treated together.
TOGETHER = 4_000_000

#: The tokenizer's pattern of pre-tokens (fixed value of its vocabulary file), and our line feeds.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
#: Control characters that str.split() takes for white space and the tokenizer does not.
ODD_BLANKS = "\x1c\x1d\x1e\x1f"
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
REAL_BLANKS = re.compile(f"[{''.join(map(chr, WHITE_SPACE))}]+")
WORD_END = "</w>"
#: The settings of vocabulary files that this module implements (fixed values of the format).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": PIECES.pattern.removesuffix(r"|\n")}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": WORD_END, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def checked(spec: dict) -> dict:
    """A vocabulary file's content, if its settings are those that are implemented here.

    They are NFC, lower case, splitting at white space and by :data:`PIECES`, byte letters and
    word ends; added tokens are taken from the raw text as they stand. Others raise ValueError.
    """
    wrong = [k for k, v in MODEL.items() if spec["model"].get(k) != v]
    wrong += ["normalizer"] * (spec["normalizer"] != NORMALIZER)
    wrong += ["pre_tokenizer"] * (spec["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]})
    wrong += [k for k in ("post_processor", "decoder") if spec.get(k) is not None]
    for t in spec["added_tokens"]:
        if any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) or not t["special"] or chunks_of(t["content"]) != [t["content"]]:
            wrong.append(t["content"])
    if wrong:
        raise ValueError(f"the vocabulary file has settings that are not supported: {wrong}")
    return spec


@functools.cache
def unsettled() -> re.Pattern:
    """Characters that Unicode 3.2 does not know.

    Whether they are letters, compose or have a lower case depends on the version of Unicode that
    a library was built with; for all others the versions in use agree.
    """
    new = [c for c in range(0x80, 0x110000) if unicodedata.ucd_3_2_0.category(chr(c)) == "Cn"]
    edges = [0, *(np.flatnonzero(np.diff(new) > 1) + 1).tolist(), len(new)]
    return re.compile("[" + "".join(f"{re.escape(chr(new[a]))}-{re.escape(chr(new[b - 1]))}" for a, b in pairwise(edges)) + "]")


def is_latin(text: str) -> bool:
    """Whether all characters lie below U+0100: such a text is in NFC and its lower case is plain."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def chunks_of(text: str) -> list[str]:
    """The runs of characters between white space."""
    if any(c in text for c in ODD_BLANKS):
        return [x for x in REAL_BLANKS.split(text) if x]
    return text.split()


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters, spare = [""] * 256, 256
    for b in plain:
        letters[b] = chr(b)
    for b in range(256):
        if not letters[b]:
            letters[b], spare = chr(spare), spare + 1
    return letters


class Vocabulary:
    """A byte-level BPE vocabulary with word ends, from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        ids: dict[str, int] = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = [ids[a] for a, _ in merges]
        self.right = [ids[b] for _, b in merges]
        self.made = [ids[a + b] for a, b in merges]
        pairs = (np.array(self.left, np.int64) << 32) | np.array(self.right, np.int64)
        self.pairs, self.pair_rank = np.unique(pairs, return_index=True)
        letters = byte_letters()
        self.byte = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.final = np.array([ids[c + WORD_END] for c in letters], np.int32)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.word = [""] * (1 + max([*ids.values(), *self.specials.values()]))
        for t, i in (ids | self.specials).items():
            self.word[i] = t
        self.number = [str(i) for i in range(len(self.word))]
        self.split_specials = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None


def apply_ranks(v: Vocabulary, sym: np.ndarray) -> np.ndarray:
    """Merge a flat array of symbols, in which negative values are walls, in place.

    The index holds, for each mergeable pair (named by its rank), arrays of its positions.
    The merged pair's first position gets the new symbol, its second -1.
    """
    end = len(sym)
    nxt, prv = np.arange(1, end + 1), np.arange(-1, end - 1)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(first: np.ndarray, second: np.ndarray, places: np.ndarray) -> None:
        """Index the pairs (first, second) at ``places`` that the vocabulary merges."""
        pairs = (first.astype(np.int64) << 32) | second
        at = np.searchsorted(v.pairs, pairs)
        at[at == len(v.pairs)] = 0
        known = (v.pairs[at] == pairs) & (first >= 0) & (second >= 0)
        ranks, places = v.pair_rank[at[known]], places[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, x in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts), strict=True):
            if r in index:
                index[r].append(x)
            else:
                index[r] = [x]
                heapq.heappush(active, r)

    add(sym[:-1], sym[1:], np.arange(end - 1))
    while active:
        rank = heapq.heappop(active)
        places = np.unique(np.concatenate(index.pop(rank)))
        a, b, new = v.left[rank], v.right[rank], v.made[rank]
        places = places[sym[places] == a]
        second = nxt[places]
        places, second = places[sym[second] == b], second[sym[second] == b]
        if a == b and len(places) > 1:  # overlapping pairs merge from the left
            free, taken = [], -1
            for p, q in zip(places.tolist(), second.tolist(), strict=True):
                if p != taken:
                    free.append(p)
                    taken = q
            places = np.array(free)
            second = nxt[places]
        if not len(places):
            continue
        after = nxt[second]
        sym[places], sym[second] = new, -1
        nxt[places], prv[after] = after, places
        before = prv[places]  # -1 is the last place, a wall
        add(np.concatenate((sym[before], sym[places])), np.concatenate((sym[places], sym[after])), np.concatenate((before, places)))
    return sym


class Encoder:
    """Encodes texts; remembers chunks that it has met."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.path = path
        self.library = None
        self.clear()

    def clear(self) -> None:
        """Forget all chunks. Special tokens keep their places, behind a blank, which no chunk has."""
        self.ids: dict[str, str] = {" " + x: str(i) for x, i in self.v.specials.items()}
        self.shown: dict[str, str] = {" " + x: x for x in self.v.specials}

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that are not remembered."""
        if len(self.ids) > REMEMBERED:
            self.clear()
        new = [c for c in chunks if c not in self.ids]
        if not new:
            return
        odd = [c for c in new if c[0] == " "]
        plain = [c for c in new if c[0] != " "] if odd else new
        new = plain + odd
        # Pieces end at a tab, chunks at a line feed; neither occurs in a chunk.
        raw = ("\t".join(PIECES.findall("\n".join(plain))).encode() + b"\t\n\t") if plain else b""
        raw = np.frombuffer(raw + b"".join(map(self.pieces_of, odd)), np.uint8)
        sym = self.v.inner[raw]
        tabs, feeds = np.flatnonzero(raw == 9), raw == 10
        sym[tabs - 1] = self.v.final[raw[tabs - 1]]
        sym[tabs], sym[feeds] = -2, -3
        sym = apply_ranks(self.v, sym)
        sym = sym[(sym >= 0) | feeds]
        flat, start = sym.tolist(), 0
        for c, end in zip(new, np.flatnonzero(sym == -3).tolist(), strict=True):
            got = flat[start:end]
            start = end + 1
            self.ids[c] = " ".join([self.v.number[i] for i in got])
            self.shown[c] = self.decode(got)

    def pieces_of(self, chunk: str) -> bytes:
        """The pieces of a chunk with unsettled characters, cut by the library's own tables."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk[1:]))
        return b"".join(bytes(map(self.v.byte.__getitem__, x)) + b"\t" for x, _ in cut) + b"\n\t"

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by blanks, as a tokenizer without a decoder gives them."""
        return " ".join([self.v.word[i] for i in ids])

    def parts(self, text: str) -> list[str]:
        """The chunks of a text, normalised. Special tokens, and raw chunks with unsettled
        characters, have a blank before them."""
        v = self.v
        if any(x in text for x in v.specials):
            out: list[str] = []
            for x in v.split_specials.split(text):
                if x in v.specials:
                    out.append(" " + x)
                elif x:
                    out += self._plain(x)
            return out
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if is_latin(text):
            return chunks_of(text.lower())
        # Lower case goes character by character, so a final sigma is like any other.
        low = lambda x: unicodedata.normalize("NFC", x).replace("Σ", "σ").lower()
        if (new := unsettled()).search(text):
            return [" " + c if new.search(c) else low(c) for c in chunks_of(text)]
        return chunks_of(low(text))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text the decimal ids joined by blanks, and the decoded text."""
        cut = [self.parts(t) for t in texts]
        self.learn(set().union(*cut))
        ids, shown = self.ids, self.shown
        for c in cut:
            yield " ".join([ids[x] for x in c]), " ".join([shown[x] for x in c])


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return own_table(f"encoder {path}", lambda: Encoder(path))


def slices(texts: pa.Array, most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have about ``most`` bytes together, at least one row each."""
    size = pyarrow.compute.fill_null(pyarrow.compute.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(size):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(size):
        yield start, len(size)


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ids (list of int) and decoded (the text that the ids give).

    A null text counts as empty and gives no ids. Null ids, repeated rows and columns of any
    other name are harmless: only ``id`` and ``text`` are read. Long texts are taken whole.
    """
    rows = small_batches(docs).select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                got = list(e.encode_batch([t or "" for t in part.column(1).to_pylist()]))
                ids = pa.array([list(map(int, x.split())) for x, _ in got], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([d for _, d in got], pa.string())], ["id", "ids", "decoded"])

    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id)


def encode_digests(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 and decoded_sha256.

    The digests of what :func:`encode` returns, taken where the ids are made, so that neither
    ids nor decoded texts leave the worker. Edge cases are those of :func:`encode`.
    """
    rows = small_batches(docs).select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, sha = encoder(path), hashlib.sha256
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                n, one, two = [], [], []
                for ids, decoded in e.encode_batch([t or "" for t in part.column(1).to_pylist()]):
                    n.append(ids.count(" ") + 1 if ids else 0)
                    one.append(sha(ids.encode()).hexdigest())
                    two.append(sha(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(one), pa.array(two)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id)
