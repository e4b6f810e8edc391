"""Best-fit packing, planned over the histogram of lengths.

Documents are cut into pieces of at most ``capacity`` tokens. The driver sees only how many
pieces have each length (at most ``capacity`` numbers, whatever the corpus) and runs best-fit
decreasing over those counts. The plan says, for a run of ranks within a length, which
sequences they go to and at which offset; pieces take their slots by rank within length.
Token ids are made once and only digests of them are moved.
"""

from __future__ import annotations

import bisect
import gc
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import WORD_END, checked, chunks_of, is_latin, slices
from graphloom.llm.common import own_table, row_rank, small_batches, written

CAPACITY = 4096
END_ID = 1
#: Chunks of one generation. A full table becomes the old one, from which chunks that occur
#: again are taken over; so a worker remembers twice as many at most.
REMEMBERED = 250_000
#: Marks that are split from the end of a word before it is looked up.
ALL_MARKS = ".,;:!?*$%&#|\"()"
MARKS = frozenset(ALL_MARKS)
#: Characters of text whose chunks are looked up together.
TOGETHER = 16 << 20
#: Chunks that are given to the library in one call.
AT_ONCE = 1000


class Closing(dict):
    """Whether marks after a character are tokens of their own: if it stays a letter when normalised."""

    def __missing__(self, c: str) -> bool:
        last = unicodedata.normalize("NFC", c).lower()[-1]
        # A few letters of old became marks; what both versions call a letter is one everywhere.
        self[c] = found = last.isalpha() and unicodedata.ucd_3_2_0.category(last)[0] == "L"
        return found


class LibraryIds:
    """Ids of texts by the tokenizers library, as little-endian 32-bit bytes.

    White space separates tokens, so a chunk between white space has the same ids wherever it
    stands; chunks that were met before come from a bounded table. A new chunk is looked up
    without its closing marks first: after a letter they are tokens of their own. Texts are
    lower-cased here where that is sure to be what the library does, and never where a special
    token would arise from it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.specials = [t["content"].lower() for t in checked(json.load(f))["added_tokens"]]
        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        words = self.t.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.closing = Closing()

    def _recall(self, chunks: set[str]) -> set[str]:
        """Those of the chunks that neither generation knows; the old one's are taken over."""
        new = chunks.difference(self.known)
        if self.old and new:
            again = new.intersection(self.old)
            self.known.update(zip(again, map(self.old.__getitem__, again), strict=True))
            new -= again
        return new

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.old, self.known = self.known, {}
        known, marks, closing = self.known, MARKS, self.closing
        need, marked = set(), []
        for c in self._recall(chunks):
            if c[-1] in marks:
                core = c.rstrip(ALL_MARKS)
                if core and closing[core[-1]]:
                    tail = c[len(core) :]
                    need.add(core)
                    need.add(tail)
                    marked.append((c, core, tail))
                    continue
            need.add(c)
        need = self._recall(need)
        words = {c for c in need if c.isalpha()}
        self._ask([*words], True)
        self._ask([*need.difference(words)], False)
        for c, core, tail in marked:
            known[c] = known[core] + known[tail]

    def _ask(self, chunks: list[str], single: bool) -> None:
        """Have the library encode chunks; ``single`` ones are words that end once."""
        for a in range(0, len(chunks), AT_ONCE):
            part = chunks[a : a + AT_ONCE]
            text = " ".join(part)
            if single:
                ids = np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                cuts = np.flatnonzero(self.ends[ids]) + 1
            if not single or len(cuts) != len(part):
                got = self.t.encode(text, add_special_tokens=False)
                ids = np.array(got.ids, "<u4")
                begins = np.fromiter((o[0] for o in got.offsets), np.int64, len(ids))
                cuts = np.searchsorted(begins, np.cumsum([len(c) + 1 for c in part]))
            raw, ends = ids.tobytes(), (4 * cuts).tolist()
            self.known.update(zip(part, [raw[x:y] for x, y in zip([0, *ends], ends, strict=False)], strict=True))

    def _chunks(self, text: str) -> list[str]:
        if is_latin(text):
            low = text.lower()
            if not any(x in low for x in self.specials):
                return chunks_of(low)
        return chunks_of(text)

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        cut = [self._chunks(t) for t in texts]
        self.learn(set().union(*cut))
        known = self.known
        for c in cut:
            yield b"".join(map(known.__getitem__, c))


def library_ids(path: str) -> LibraryIds:
    return own_table(f"library ids {path}", lambda: LibraryIds(path))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, ended by :data:`END_ID`, into pieces of at most ``capacity``.

    Returns id, piece, start, length, ids_crc32 and, if asked, ids. A null text counts as
    empty and gives one piece that holds only the end.
    """
    rows = small_batches(docs).select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]
    width, end = 4 * capacity, END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, crc = library_ids(path), zlib.crc32
        gc.disable()  # no cycles arise here, and the large tables are slow to search for some
        for batch in batches:
            for a, b in slices(batch.column(1), TOGETHER):
                part = batch.slice(a, b - a)
                row, piece, length, check, ids = [], [], [], [], []
                for i, raw in enumerate(e.encode_batch([t or "" for t in part.column(1).to_pylist()])):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), width)):
                        x = raw[at : at + width]
                        row.append(i)
                        piece.append(k)
                        length.append(len(x) // 4)
                        check.append(crc(x))
                        if with_ids:
                            ids.append(np.frombuffer(x, "<u4").astype(np.int32))
                n = pa.array(piece, pa.int32())
                out = [part.column(0).take(pa.array(row, pa.int64())), n, pa.array([k * capacity for k in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(check, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns runs (length, first rank, ranks, first sequence, offset): rank ``first + k`` of a
    length goes to sequence ``first sequence + k`` at ``offset``. Open sequences with the same
    room are kept as blocks of consecutive numbers, so work follows the number of different
    lengths and blocks, not the number of pieces.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # ascending
    blocks: dict[int, list[tuple[int, int]]] = {}
    made = 0

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in blocks:
                bisect.insort(rooms, room)
                blocks[room] = []
            blocks[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, each = capacity, capacity // length
                first, n = made, -(-left // each)
                made += n
            else:
                room = rooms[at]
                first, n = blocks[room].pop()
                if not blocks[room]:
                    del blocks[room]
                    rooms.pop(at)
                each = room // length
            use = min(n, left // each)
            if not use:  # fewer pieces are left than one sequence takes
                use, each = 1, left
            for j in range(each):
                runs.append((length, rank, use, first, capacity - room + j * length))
                rank += use
            left -= each * use
            keep(room - each * length, first, use)
            keep(room, first + use, n - use) if room < capacity else None
            if room == capacity and n > use:
                # The last new sequence takes what is left.
                rest = left
                for j in range(rest):
                    runs.append((length, rank, 1, first + use, j * length))
                    rank += 1
                left = 0
                keep(capacity - rest * length, first + use, 1)
    return runs


def place(cut: DataFrame, capacity: int = CAPACITY, id: str = "doc_id") -> DataFrame:
    """Give every piece its sequence_id and offset. ``cut`` must be a written table.

    The histogram is pre-aggregated by Spark and has at most ``capacity`` rows. Ranks within a
    length come from :func:`row_rank`, which deals a hot length over many tasks. The plan is
    sent to the tasks; it depends on the lengths that occur, not on how many pieces there are.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(((runs[:, 0] << 44) | runs[:, 1], runs[:, 1], runs[:, 3], runs[:, 4]))
    ranked = row_rank(cut, ["length"], [id, "piece", "ids_crc32"], "rank")
    names = [c for c in cut.columns if c != "length"]
    schema = ", ".join(f"`{c}` {t}" for c, t in cut.select(*names).dtypes) + ", length long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, sequences, offsets = sent.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            out = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(length), pa.array(sequences[at] + rank - firsts[at]), pa.array(offsets[at])], [*names, "length", "sequence_id", "offset"])

    return ranked.select(*names, "length", "rank").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are one piece of length 1. Null and repeated ids are allowed: pieces that are
    equal in everything take any of their slots. Only documents longer than ``capacity`` are
    cut. Other columns are not read. An empty table gives an empty result.
    """
    cut = written(pieces(docs, path, capacity, id, text), "pieces")
    return place(cut, capacity, id).select(id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed token sequences: sequence_id, ids. A sequence holds at most ``capacity`` ids."""
    cut = written(pieces(docs, path, capacity, id, text, with_ids=True), "pieces")
    parts = place(cut, capacity, id).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
