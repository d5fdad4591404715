"""Repeated passages by sparse suffix arrays (operator 9).

Suffixes are kept only at content-selected positions: of every ``min_words - PREFIX + 1`` neighbouring runs of PREFIX
words, the one with the smallest hash. Two equal passages of ``min_words`` words hold the same run at the same place,
so each has a kept suffix in the other's neighbourhood. Suffixes are sorted by their first PREFIX words, and neighbours
with equal ones are matches. A match is extended left and right by comparing the windows of ``min_words`` words that
hold it; a window that stands elsewhere too is part of a repeated passage, and the union of such windows is the passage
as far as it reaches. Comparing only neighbours beyond the prefix would miss passages whose left part is equal in one
place and right part in another one, so windows are compared by hash instead: all places of one are found, in any order.

The first place, by doc_id and then start, is kept; a word is removed if it is in a later place and in no first one, so
every repeated window stays somewhere.

Only one suffix per prefix and task, and one window per hash and task, is shuffled; what meets in a task is decided
there. A passage that a third of all documents hold therefore sends as many rows as there are tasks.

Words are runs of bytes other than ASCII white space, A-Z in lower case. Documents of equal text are one document for
all of this: later ones are removed whole if they have min_words words. Spans are code points, end exclusive.

Rows: null, empty and short texts have no spans. Rows that agree in id and text are one document. A null doc_id
comes last. Further columns are left alone. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, folded, freed, id_and_text, mixed, row_blocks, small_side, stored, text_buffers, unfolded, written
from tidewell.llm.words import MULTIPLIER, word_numbers

PREFIX = 20
MIN_WORDS = 50
BLOCK_BYTES = 1_000_000
NO_ID = 2**63 - 1


def run_numbers(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, from runs of powers of two."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, length = None, 0, words, 1
    with np.errstate(over="ignore"):
        while True:
            if size & length:
                piece = part[done : done + n]
                out = piece if out is None else mixed(out * MULTIPLIER + piece)
                done += length
            if 2 * length > size:
                return mixed(out + np.uint64(size))
            part = mixed(part[:-length] * MULTIPLIER + part[length:])
            length *= 2


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each ``width`` neighbours."""
    part, length = values, 1
    while 2 * length <= width:
        part = pick(part[:-length], part[length:])
        length *= 2
    rest = width - length
    return pick(part[: len(part) - rest], part[rest:]) if rest else part


def minimisers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the smallest of some ``width`` neighbours; all of them at a tie."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    least = _sliding(hashes, width, np.minimum)
    pad = np.zeros(width - 1, hashes.dtype)
    return np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == hashes)


def _texts(batch: pa.RecordBatch, at: int):
    """(row, word hashes, first bytes, last bytes, code points before each byte) of each text that has words."""
    data, rows = text_buffers(batch.column(at))
    for a, b in row_blocks(rows, BLOCK_BYTES):
        part = data[rows[a] : rows[b]]
        words, first, starts, ends = word_numbers(part, rows[a : b + 1] - rows[a])
        before = np.append(0, np.cumsum(part & 0xC0 != 0x80))
        for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if y > x:
                base = before[rows[a + i] - rows[a]]
                yield a + i, words[x:y], before[starts[x:y]] - base, before[ends[x:y]] - base


def _suffixes(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(unit, text) -> key, unit, position, sent, decided of the kept suffixes of one task."""
    seen: set[int] = set()
    keys, units, places = [], [], []
    for batch in batches:
        numbers = batch.column(0).to_pylist()
        for row, words, _, _ in _texts(batch, 1):
            if len(words) < min_words or numbers[row] in seen:
                continue
            seen.add(numbers[row])
            prefixes = run_numbers(words, PREFIX)
            at = minimisers(prefixes, min_words - PREFIX + 1)
            keys.append(prefixes[at].astype(np.int64))
            units.append(np.full(len(at), numbers[row], np.int64))
            places.append(at)
    if not keys:
        return
    key, unit, place = np.concatenate(keys), np.concatenate(units), np.concatenate(places)
    order = np.argsort(key, kind="stable")
    key, unit, place = key[order], unit[order], place[order]
    first = np.append(True, key[1:] != key[:-1])
    alone = first & np.append(first[1:], True)
    for a in range(0, len(key), 500_000):
        b = a + 500_000
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (key[a:b], unit[a:b], place[a:b].astype(np.int32), first[a:b], ~alone[a:b])],
            ["key", "unit", "place", "sent", "decided"],
        )


def _windows(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(unit, id, text, places) -> windows that hold a matched suffix, with how many of the task are equal."""
    seen: set[int] = set()
    found = []
    for batch in batches:
        units, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, words, starts, ends in _texts(batch, 2):
            if units[row] in seen:
                continue
            seen.add(units[row])
            hashes = run_numbers(words, min_words)
            holds = np.zeros(len(words) + 1, np.int32)
            for place in batch.column(3)[row].as_py():
                holds[max(0, place + PREFIX - min_words)] += 1
                holds[min(place, len(hashes) - 1) + 1] -= 1
            at = np.flatnonzero(np.cumsum(holds)[: len(hashes)] > 0)
            n = len(at)
            found.append((hashes[at].astype(np.int64), np.full(n, ids[row], np.int64), np.full(n, units[row], np.int64), starts[at], ends[at + min_words - 1]))
    if not found:
        return
    hashes, ids, units, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((starts, units, ids, hashes))
    hashes, ids, units, starts, ends = (x[order] for x in (hashes, ids, units, starts, ends))
    first = np.append(True, hashes[1:] != hashes[:-1]) if len(hashes) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(hashes)))
    holder = np.repeat(ids[at], counts)  # of the first place in this task
    counts = np.repeat(counts, counts)
    for a in range(0, len(hashes), 500_000):
        b = a + 500_000
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[a:b]) for x in (hashes, ids, units, starts.astype(np.int32), ends.astype(np.int32), counts, first, holder)],
            ["hash", "id", "unit", "start", "end", "n", "sent", "holder"],
        )


def _merged(starts: np.ndarray, ends: np.ndarray, holders: np.ndarray) -> list[tuple[int, int, int]]:
    """The union of intervals that overlap or touch, each with the holder of its first one."""
    order = np.argsort(starts, kind="stable")
    starts, ends, holders = starts[order], np.maximum.accumulate(ends[order]), holders[order]
    at = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    last = np.append(at[1:], len(starts)) - 1
    return list(zip(starts[at].tolist(), ends[last].tolist(), holders[at].tolist(), strict=True))


def _without(spans: list[tuple[int, int, int]], kept: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out, k = [], 0
    for start, end, holder in spans:
        while k < len(kept) and kept[k][1] <= start:
            k += 1
        i = k
        while i < len(kept) and kept[i][0] < end:
            if kept[i][0] > start:
                out.append((start, kept[i][0], holder))
            start = max(start, kept[i][1])
            i += 1
        if start < end:
            out.append((start, end, holder))
    return out


SPANS = "unit long, id long, spans array<struct<start:bigint,end:bigint,kept:boolean,holder:bigint>>"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kept", pa.bool_()), ("holder", pa.int64())]))
    for batch in batches:
        lists = []
        for marks in batch.column(2):
            rows = marks.values
            starts, ends, firsts, holders = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            kept = _merged(starts[firsts], ends[firsts], holders[firsts]) if firsts.any() else []
            later = _merged(starts[~firsts], ends[~firsts], holders[~firsts]) if (~firsts).any() else []
            spans = [(s, e, False, h) for s, e, h in _without(later, kept)] + [(s, e, True, None) for s, e, _ in kept]
            lists.append([dict(zip(("start", "end", "kept", "holder"), x, strict=True)) for x in sorted(spans, key=lambda x: x[:2])])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, kind)], ["unit", "id", "spans"])


def _unit():
    return F.xxhash64("text", F.length("text"))


def _whole_spans(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        start, end = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for row, words, starts, ends in _texts(batch, 1):
            if len(words) >= min_words:
                start[row], end[row] = starts[0], ends[-1]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(start), pa.array(end)], ["unit", "id", "start", "end"])


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """unit, id, spans [(start, end, kept, holder)] of each text and document that has a repeated passage.

    kept spans are first places; holder is a document that has the passage too. A document without an id has NO_ID.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs).where("text IS NOT NULL")
    rows = rows.select(_unit().alias("unit"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    schema = "key long, unit long, place int, sent boolean, decided boolean"
    suffixes, place = written(rows.select("unit", "text").mapInArrow(freed(partial(_suffixes, min_words=min_words)), schema), "suffixes")

    # Equal neighbours in the order of prefixes: a prefix that stands in two tasks, or twice in one.
    sent = suffixes.where("sent")
    met = sent.groupBy("key").agg(F.min(F.struct("unit", "place")).alias("a"), F.max(F.struct("unit", "place")).alias("b"))
    met = met.where("a <> b").select("key")
    matched = suffixes.where("decided").select("unit", "place").unionByName(
        suffixes.where("NOT decided").join(met, "key", "left_semi").select("unit", "place")
    )
    # Of equal texts the first document stands for all.
    first = rows.groupBy("unit").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    anchors = matched.groupBy("unit").agg(F.collect_set("place").alias("places")).join(first, "unit")  # places of one text
    anchors = stored(anchors.select("unit", "id", "places"))
    discard(spark, place)

    texts = rows.join(anchors, ["unit", "id"]).select("unit", "id", "text", "places")
    schema = "hash long, id long, unit long, start int, end int, n long, sent boolean, holder long"
    windows, place = written(texts.mapInArrow(freed(partial(_windows, min_words=min_words)), schema), "windows")
    sent = windows.where("sent").select("hash", "id", "unit", "start", "end", "n", "holder")
    best = sent.groupBy("hash").agg(F.sum("n").alias("total"), F.min(F.struct("id", "unit", "start")).alias("f")).where("total > 1")
    judged = sent.join(best, "hash").select(
        "unit", "id", "start", "end", (F.struct("id", "unit", "start") == F.col("f")).alias("kept"), F.col("f.id").alias("holder")
    )
    later = windows.where("NOT sent").select("unit", "id", "start", "end", F.lit(False).alias("kept"), "holder")
    marks = judged.unionByName(later).groupBy("unit", "id").agg(
        F.collect_list(F.struct("start", "end", "kept", "holder")).alias("marks")  # of one document
    )
    found = stored(marks.mapInArrow(freed(_spans), SPANS))
    discard(spark, place)

    copies = small_side(stored(first.where("id < last").select("unit", F.col("id").alias("first"))), 16)
    whole = rows.join(copies, "unit")
    spans = whole.select("unit", "text", "id").mapInArrow(freed(partial(_whole_spans, min_words=min_words)), "unit long, id long, start long, end long")
    spans = spans.where("end >= 0").join(copies, "unit").distinct()
    whole_span = F.struct("start", "end", (F.col("id") == F.col("first")).alias("kept"), F.when(F.col("id") != F.col("first"), F.col("first")).alias("holder"))
    all_of_copies = spans.select("unit", "id", "first", F.array(whole_span).alias("whole"))
    # A first copy is kept for its copies' sake, and still loses what stands in an earlier document.
    both = found.join(all_of_copies, ["unit", "id"], "full").select(
        "unit", "id", F.when(F.col("first") < F.col("id"), F.col("whole")).otherwise(F.coalesce("spans", "whole")).alias("spans")
    )
    return both


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per span: doc_id, start, end, kept (the first place), other_doc_id (one that has it too)."""
    spans = repeated_spans(docs, min_words).select("id", F.explode("spans").alias("s"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return spans.select(real("id").alias("doc_id"), "s.start", "s.end", "s.kept", real("s.holder").alias("other_doc_id"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        at, spans_at = names.index("text"), names.index("_spans")
        texts = batch.column(at).to_pylist()
        for i, spans in enumerate(batch.column(spans_at)):
            if spans.is_valid:
                parts, done = [], 0
                for s in spans.as_py():
                    if not s["kept"]:
                        gone = texts[i][s["start"] : s["end"]]
                        space = len(gone) - len(gone.lstrip(" \t\n\v\f\r"))  # behind a kept place: words stay apart
                        parts.append(texts[i][done : s["start"] + space])
                        done = s["end"]
                texts[i] = "".join([*parts, texts[i][done:]])
        columns = [pa.array(texts, batch.column(at).type) if n == "text" else batch.column(i) for i, n in enumerate(names) if n != "_spans"]
        yield pa.RecordBatch.from_arrays(columns, [n for n in names if n != "_spans"])


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without the later places of repeated passages; all rows and columns stay."""
    spans = stored(repeated_spans(docs, min_words).where(F.exists("spans", lambda s: ~s["kept"])))
    keyed = folded(docs).withColumn("_unit", _unit()).withColumn("_id", F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(NO_ID)))
    spans = spans.select(F.col("unit").alias("_unit"), F.col("id").alias("_id"), F.col("spans").alias("_spans"))
    joined = keyed.join(small_side(spans, 200), ["_unit", "_id"], "left").select("doc", "text", "_spans")
    return unfolded(joined.mapInArrow(freed(_cut), joined.drop("_spans").schema), docs)
