"""Packing documents into training sequences, shortest pack first over the length histogram (operator 7).

A document's ids, with the end id, are cut at multiples of the sequence length; the pieces are full, but for the last.
Only the histogram of piece lengths (at most one row per length) goes to the driver. There, lengths are placed longest
first: all pieces of a length go onto the shortest packs that have room, as many at once as there are packs of that
pattern; if none has room, the rest goes onto new packs, as many pieces into each as fit. What changes are counts of patterns, so the work does not depend on the
number of documents. Pieces then find their places by rank: the r-th piece of a length takes the r-th place for it.

Ranks are counted by length and salt, so a length that many documents share is numbered in many tasks.

Rows: a null or empty text is one piece with just the end id. Each row is a document of its own, also if it repeats or
has no id. Equal pieces may swap places between runs only if they agree in id, start, length and ids. Further columns are not
read. An empty table gives no rows. A text of any length is cut, never shortened.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.chunks import library_encoder
from tidewell.llm.common import freed, id_and_text, ranges, stored

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SALT_ROWS = 100_000  # rows that are numbered in one window, about


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, most: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = library_encoder(tokenizer)
    for batch in batches:
        ids, offsets = encoder.encode(batch.column(1))
        totals = np.diff(offsets) + 1
        ends = np.cumsum(totals)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, "<u4")
        flat[ends - 1] = end_id
        flat[ranges(ends - totals, totals - 1)] = ids
        counts = -(-totals // most)
        doc = np.repeat(np.arange(len(totals)), counts)
        start = ranges(np.zeros(len(totals), np.int64), counts) * most
        length = np.minimum(most, totals[doc] - start)
        at = (ends - totals)[doc] + start
        raw = flat.view(np.uint8)
        crcs = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        columns = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(totals[doc])]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            lists = [flat[a : a + n].astype(np.int32) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns.append(pa.array(lists, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def cut(docs: DataFrame, tokenizer: str, end_id: int, most: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``most`` ids; with_ids adds the ids themselves."""
    work = partial(_cut, tokenizer=tokenizer, end_id=end_id, most=most, with_ids=with_ids)
    return id_and_text(docs).mapInArrow(freed(work), PIECE + (", ids array<int>" if with_ids else ""))


def place_lengths(histogram: dict[int, int], most: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of each packing pattern."""
    packs: dict[int, list[list]] = {}  # by room: [count, pattern]; a pattern is (last length, pattern before) or None
    rooms: list[int] = []  # as a heap of negative numbers
    done: list[list] = []

    def keep(count: int, pattern: tuple, room: int) -> None:
        if room == 0:
            done.append([count, pattern])
        elif room in packs:
            packs[room].append([count, pattern])
        else:
            packs[room] = [[count, pattern]]
            heapq.heappush(rooms, -room)

    def opened(count: int, length: int) -> Iterator[tuple[int, tuple, int]]:
        """New packs for count pieces of a length, each but the last as full as they make it."""
        each = most // length
        for packs_of, pieces in ((count // each, each), (1, count % each)):
            if packs_of and pieces:
                pattern = None
                for _ in range(pieces):
                    pattern = (length, pattern)
                yield packs_of, pattern, most - pieces * length

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        changed = []  # packs that got this length stay aside until no pack without it has room
        while left:
            while rooms and not packs.get(-rooms[0]):
                packs.pop(-heapq.heappop(rooms), None)
            if not rooms or -rooms[0] < length:
                for item in changed:
                    keep(*item)
                changed = []
                if not rooms or -rooms[0] < length:
                    changed += opened(left, length)
                    left = 0
                continue
            room = -rooms[0]
            group = packs[room][-1]
            used = min(left, group[0])
            group[0] -= used
            if not group[0]:
                packs[room].pop()
            changed.append((used, (length, group[1]), room - length))
            left -= used
        for item in changed:
            keep(*item)
    for groups in packs.values():
        done += groups
    out = []
    for count, pattern in done:
        lengths = []
        while pattern is not None:
            lengths.append(pattern[0])
            pattern = pattern[1]
        out.append((count, lengths[::-1]))
    return out


class Places:
    """For each length its places in all packs, in order: (first rank, first sequence, offset)."""

    def __init__(self, patterns: list[tuple[int, list[int]]]):
        taken: dict[int, int] = {}
        rows, first = [], 0
        for count, lengths in patterns:
            offset = 0
            for length in lengths:
                rank = taken.get(length, 0)
                rows.append((length, rank, first, offset))
                taken[length] = rank + count
                offset += length
            first += count
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.lengths, self.ranks, self.sequences, self.offsets = (np.ascontiguousarray(x) for x in table.T)
        self.sizes = np.unique(self.lengths)
        self.firsts = np.append(np.searchsorted(self.lengths, self.sizes), len(rows))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for own in np.unique(length):
            i = np.searchsorted(self.sizes, own)
            a, b = self.firsts[i], self.firsts[i + 1]
            rows = np.flatnonzero(length == own)
            at = a + np.searchsorted(self.ranks[a:b], rank[rows], "right") - 1
            sequence[rows] = self.sequences[at] + rank[rows] - self.ranks[at]
            offset[rows] = self.offsets[at]
        return sequence, offset


def _placed(batches: Iterator[pa.RecordBatch], places: Places) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = {name: i for i, name in enumerate(batch.schema.names)}
        sequence, offset = places.find(batch.column(at["length"]).to_numpy(), batch.column(at["_rank"]).to_numpy())
        kept = [name for name in at if name != "_rank"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(at[name]) for name in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"]
        )


def _ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Adds _rank: 0, 1, ... among the pieces of a length."""
    salts = max(1, -(-total // SALT_ROWS)) * 8
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "_salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_first"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = salted.withColumn("_own", F.row_number().over(own) - 1)
    ranked = numbered.join(firsts, ["length", "_salt"]).withColumn("_rank", F.col("_first") + F.col("_own"))
    return ranked.select(*pieces.columns, "_rank")


def pack(docs: DataFrame, tokenizer: str, end_id: int, most: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id and offset of each piece.

    Pieces of a sequence stand one after another from offset 0; what is left of ``most`` is padding.
    """
    pieces = stored(cut(docs, tokenizer, end_id, most, with_ids))
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most one row per length
    places = Places(place_lengths(histogram, most))
    ranked = _ranked(pieces, sum(histogram.values()))
    schema = PIECE + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(freed(partial(_placed, places=places)), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and the pieces' lengths of each sequence, from the result of ``pack`` with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))  # at most one sequence's ids
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return whole.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.length").alias("lengths"))
