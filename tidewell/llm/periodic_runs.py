"""Periodic runs of words by a dictionary of basic factors (operator 12).

Words are runs of bytes other than ASCII white space, compared byte by byte. A run is a stretch of words with smallest
period q (words q apart are equal) and at least max(24, 3q) words that no neighbouring word extends keeping period q.

For each power of two L, equal factors of L words of a text have one name, made from the names of their two halves. A
factor's successor is the next place of its name. Successors at most twice half the length away, so at distance d with
L/2 < d <= L, overlap or touch, and neighbouring places with one distance form progressions of period d. Distance d is
then the smallest period of what they cover: a smaller one would divide it and bring the successor nearer. Each period
is proposed by exactly one L, which 3q words always have room for. A proposal is extended word by word to the left and
right, and equal ones are merged. Places whose factor stands only once in the text have no longer repeated factor, so
they leave before the next L.

A text is read whole and by itself, in memory that grows with its words; nothing is shuffled, so neither copies nor a
hot id put more rows into a task.

Rows: a null, empty or blank text has no words and no runs. A row that repeats is a row like any other. A null doc_id
changes nothing but that the id stays null. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import id_and_text, row_blocks, text_buffers

SHORTEST = 24
TIMES = 3
BLOCK_BYTES = 1_000_000


def _names(halves: np.ndarray, others: np.ndarray) -> np.ndarray:
    """One number for each different pair."""
    _, names = np.unique(halves * (int(others.max(initial=0)) + 1) + others, return_inverse=True)
    return names.astype(np.int64)


def _repeated(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of factors at ascending places: which have a name that is not unique, their places, and the distance to the successor."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    distance = np.zeros(len(at), np.int64)  # 0: no successor
    distance[order[:-1][same]] = (at[order[1:]] - at[order[:-1]])[same]
    more = np.zeros(len(at), bool)
    more[order[:-1][same]] = True
    more[order[1:][same]] = True
    return more, distance


def runs(words: np.ndarray, rows: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """Start, end and period of all runs in texts that lie one behind the other.

    ``words`` are numbers that no two texts share, ``rows`` the first word of each text (one more than texts). In order
    of start and period.
    """
    end_of = np.repeat(rows[1:], np.diff(rows))
    start_of = np.repeat(rows[:-1], np.diff(rows))
    at, names, length = np.arange(len(words)), words.astype(np.int64), 1
    found = []
    while len(at):
        more, distance = _repeated(names, at)
        near = np.flatnonzero((2 * distance > length) & (distance <= length))
        if len(near):
            place, d = at[near], distance[near]
            new = np.ones(len(near), bool)
            new[1:] = (np.diff(place) != 1) | (np.diff(d) != 0)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(near)) - 1
            found.append(np.stack([place[first], place[last] + length + d[first], d[first]]))
        # Names of factors twice as long: both halves have to be repeated ones of the same text.
        at, names = at[more], names[more]
        named = np.full(len(words) + 1, -1, np.int64)
        named[at] = names
        right = at + length
        room = right + length <= end_of[at]
        room[room] = named[right[room]] >= 0
        at, right = at[room], right[room]
        names = _names(named[at], named[right])
        length *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = np.concatenate(found, 1)
    moving = np.arange(len(start))
    while len(moving):  # extend to the left
        moving = moving[start[moving] > start_of[start[moving]]]
        moving = moving[words[start[moving] - 1] == words[start[moving] - 1 + period[moving]]]
        start[moving] -= 1
    moving = np.arange(len(start))
    while len(moving):  # and to the right
        moving = moving[end[moving] < end_of[start[moving]]]
        moving = moving[words[end[moving]] == words[end[moving] - period[moving]]]
        end[moving] += 1
    enough = end - start >= np.maximum(shortest, times * period)
    merged = np.unique(np.stack([start, period, end])[:, enough], axis=1)
    return merged[0], merged[2], merged[1]


def dropped(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each of n words lies in a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def cyclic_tail(n: int, crc: int) -> np.ndarray:
    """The places that the words of a text with this checksum are taken from: from some word on, a repeated cycle."""
    places = np.arange(n)
    g = crc // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places[a:] = a + (places[a:] - a) % p
    return places


def _numbered(words: list[bytes], first: int) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + first


FOUND = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed_sha256 string"


def _documents(batches: Iterator[pa.RecordBatch], rewritten: bool, shortest: int, times: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        raw, ids = data.tobytes(), batch.column(0).to_pylist()
        for first, last in row_blocks(offsets, BLOCK_BYTES):
            texts, numbers, used = [], [], 0
            for row in range(first, last):
                words = raw[offsets[row] : offsets[row + 1]].split()
                own = _numbered(words, used)
                if rewritten and words and ids[row] is not None:
                    crc = zlib.crc32(str(ids[row]).encode())
                    if crc % 10 == 0:
                        places = cyclic_tail(len(words), crc)
                        words, own = [words[i] for i in places.tolist()], own[places]
                used += len(words)
                texts.append(words)
                numbers.append(own)
            rows = np.cumsum([0, *map(len, texts)])
            start, end, period = runs(np.concatenate(numbers), rows, shortest, times)
            cut = np.searchsorted(start, rows)
            lists, digests = [], []
            for i, words in enumerate(texts):
                part = slice(cut[i], cut[i + 1])
                s, e, p = start[part] - rows[i], end[part] - rows[i], period[part]
                lists.append([{"start": a, "length": b - a, "period": c} for a, b, c in zip(s.tolist(), e.tolist(), p.tolist(), strict=True)])
                if len(s):
                    gone = dropped(len(words), s, e, p)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            columns = [batch.column(0).slice(first, last - first), pa.array(lists, kind), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed_sha256"])


def find_runs(docs: DataFrame, rewritten: bool = False, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start and period) and a digest of the words that stay.

    ``rewritten``: a tenth of the documents, chosen by a checksum of their id, first get a periodic tail (see
    cyclic_tail), which shows that planted runs are found.
    """
    rows = id_and_text(docs)
    return rows.mapInArrow(partial(_documents, rewritten=rewritten, shortest=shortest, times=times), FOUND)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["start", "length", "period", "exponent_milli"]
    for batch in batches:
        counts, best, digests = [], [], []
        for found in batch.column(1).to_pylist():
            counts.append(len(found))
            text = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in found)
            digests.append(hashlib.sha256(text.encode()).hexdigest())
            top = min(found, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)
            best.append((None,) * 4 if top is None else (top["start"], top["length"], top["period"], 1000 * top["length"] // top["period"]))
        columns = [pa.array([b[i] for b in best], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), *columns, pa.array(digests, pa.string()), batch.column(2)],
            ["doc_id", "n_runs", *names, "runs_sha256", "collapsed_sha256"],
        )


REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def report(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the one with most repetitions, and digests of the runs and of what stays."""
    return found.select("doc_id", "runs", "collapsed_sha256").mapInArrow(_report, REPORT)


def collapse(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """The documents with ``text`` reduced to the words that stay, joined by single spaces, where it holds a run.

    All rows and columns stay; texts without a run, and null ones, are left as they are.
    """

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            data, offsets = text_buffers(batch.column(at))
            raw, texts = data.tobytes(), batch.column(at).to_pylist()
            for first, last in row_blocks(offsets, BLOCK_BYTES):
                words = [raw[offsets[r] : offsets[r + 1]].split() for r in range(first, last)]
                rows = np.cumsum([0, *map(len, words)])
                numbers = [_numbered(w, int(rows[i])) for i, w in enumerate(words)]
                start, end, period = runs(np.concatenate(numbers), rows, shortest, times)
                gone = dropped(int(rows[-1]), start, end, period)
                for i in np.unique(np.searchsorted(rows, start, "right") - 1).tolist():
                    stays = ~gone[rows[i] : rows[i + 1]]
                    texts[first + i] = b" ".join(w for w, s in zip(words[i], stays.tolist(), strict=True) if s).decode()
            columns = [pa.array(texts, batch.column(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(reduced, docs.schema)
