"""Document fingerprints from improbable features (operator 3).

A feature is a window of WIDTH bytes. Its entropy, as a whole number up to 1000, has a rarity: how seldom windows of
that entropy are in the corpus, counted over all documents. Windows that are almost uniform or almost random are left
out. Of each WIDTH neighbouring features the leftmost rarest one gets a vote, and those with VOTES votes are selected.
Each selected feature sets HASHES bits of a Bloom filter of BITS bits; after FEATURES features the next filter of the
chain begins. Two filters are compared by the bits that both set, normalised between what chance gives and the most
there can be; the likeness of two chains is the mean over the shorter chain's filters of their best partner.

If no feature of a text gets enough votes, the one with most is selected. Rarity says little about texts of a few
windows, so below SHORT_BELOW bytes each window of SHORT_WIDTH bytes is a feature of a second chain, and from LONG_FROM
bytes on a text has the first one; texts of similar length share a kind of chain. A text from LONG_FROM on without usable windows, or
one shorter than SHORT_WIDTH, has itself as its only feature.

Rows: a null text is empty; an empty text has the fingerprint "", alike to empty ones only. The next document is the
one behind in descending doc_id order (nulls last, equal ids by a hash of the text), the first one after the last. Repeated rows are
documents of their own. Further columns are not read. An empty table gives no rows. Texts are used whole.

Documents are put in order by one range exchange. Each task holds its last document back; those, and the first one of
each task, are the only texts that meet again.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import id_and_text, mixed, row_blocks, text_buffers, written

WIDTH = 64
VOTES = 16
BITS = 2048
HASHES = 5
FEATURES = 160
LEVELS = 1000
USABLE = (100, 990)
CUTOFF = 0.3
SHORT_WIDTH, SHORT_BELOW, LONG_FROM = 8, 1024, 512
BLOCK_BYTES = 2_000_000

#: n * log2(n) of byte counts in a window, as whole numbers, so that sums are exact in any order.
TERMS = np.array([0, *(round(n * np.log2(n) * 2**16) for n in range(1, WIDTH + 1))], np.int64)
FACTORS = np.random.default_rng(41).integers(1, 2**64, WIDTH, np.uint64, endpoint=False) | np.uint64(1)
UNUSED = np.int64(1) << 30


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy level of the window that begins at each byte."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    earlier = np.zeros(len(data), np.uint8)  # equal bytes among the WIDTH - 1 before
    later = np.zeros(len(data), np.uint8)
    for d in range(1, WIDTH):
        equal = (data[d:] == data[:-d]).view(np.uint8)
        earlier[d:] += equal
        later[:-d] += equal
    # From one window to the next, the first byte leaves (it had `later` equals) and one enters (it meets `earlier`).
    leaves = TERMS[later[: n - 1]] - TERMS[later[: n - 1] + np.uint8(1)]
    enters = TERMS[earlier[WIDTH:] + np.uint8(1)] - TERMS[earlier[WIDTH:]]
    first = TERMS[np.bincount(data[:WIDTH], minlength=256)].sum()
    sums = np.empty(n, np.int64)
    sums[0] = first
    np.cumsum(leaves + enters, out=sums[1:])
    sums[1:] += first
    top = TERMS[WIDTH]
    return (top - sums) * LEVELS // top


def _sliding_least(values: np.ndarray) -> np.ndarray:
    length = 1
    while length < WIDTH:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    return values


def selected(data: np.ndarray, rows: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the selected features of many texts, and how many each text has."""
    n_rows = len(rows) - 1
    levels = entropies(data)
    if not len(levels):
        return np.zeros(0, np.int64), np.zeros(n_rows, np.int64)
    n = len(levels)
    sizes = np.diff(rows)
    owner = np.repeat(np.arange(n_rows), sizes)
    rank = ranks[levels]
    rank[owner[:n] != owner[WIDTH - 1 :]] = UNUSED  # windows across two texts
    keyed = rank << np.int64(32) | np.arange(n, dtype=np.int64)
    votes = np.zeros(n, np.int64)
    if n >= WIDTH:
        least = _sliding_least(keyed)
        inside = owner[: len(least)] == owner[2 * WIDTH - 2 : 2 * WIDTH - 2 + len(least)]
        least = least[inside & (least >> np.int64(32) < UNUSED)]
        votes += np.bincount(least & np.int64(0xFFFFFFFF), minlength=n)
    # Texts with few windows, or no feature with enough votes.
    chosen = votes >= VOTES
    counts = np.bincount(owner[:n][chosen], minlength=n_rows)
    for i in np.flatnonzero((counts == 0) & (sizes >= WIDTH)).tolist():
        own = slice(int(rows[i]), int(rows[i + 1]) - WIDTH + 1)
        if votes[own].any():
            chosen[rows[i] + int(np.argmax(votes[own]))] = True
        elif (rank[own] < UNUSED).any():
            chosen[rows[i] + int(np.argmin(keyed[own]))] = True
    at = np.flatnonzero(chosen)
    return at, np.bincount(owner[at], minlength=n_rows)


def _filters(features: np.ndarray) -> np.ndarray:
    """The Bloom filters (filters, BITS / 8) of features in order."""
    bits = np.zeros((-(-len(features) // FEATURES), BITS), bool)
    filters = np.arange(len(features)) // FEATURES
    for h in range(HASHES):
        bits[filters, (mixed(features + np.uint64(h * 7919)) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def _numbers(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out += (data[at + i].astype(np.uint64) + np.uint64(1)) * FACTORS[i]
    return out


def _whole(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.sha256(data.tobytes()).digest()[:8], np.uint64)


Chains = tuple[np.ndarray, np.ndarray]


def chains(texts: pa.Array, ranks: np.ndarray) -> Iterator[Chains]:
    """The chain of selected features and the chain of short windows of each text; a chain that it lacks has no filters."""
    none = np.zeros((0, BITS // 8), np.uint8)
    data, rows = text_buffers(texts)
    for a, b in row_blocks(rows, BLOCK_BYTES):
        part, own = data[rows[a] : rows[b]], rows[a : b + 1] - rows[a]
        at, counts = selected(part, own, ranks)
        numbers = _numbers(part, at, WIDTH)
        done = 0
        for i, count in enumerate(counts.tolist()):
            mine = numbers[done : done + count]
            done += count
            text = part[own[i] : own[i + 1]]
            long, short = none, none
            if len(text) >= LONG_FROM:
                long = _filters(mine if count else _whole(text))
            if 0 < len(text) < SHORT_BELOW:
                places = np.arange(len(text) - SHORT_WIDTH + 1)
                short = _filters(_numbers(text, places, SHORT_WIDTH) if len(places) else _whole(text))
            yield long, short


def text_of(chain: Chains) -> str:
    if not any(map(len, chain)):
        return ""
    return ".".join(base64.b64encode(zlib.compress(x.tobytes(), 6)).decode() if len(x) else "" for x in chain)


def chains_of(text: str) -> Chains:
    parts = [zlib.decompress(base64.b64decode(x)) if x else b"" for x in (text or ".").split(".")]
    return tuple(np.frombuffer(x, np.uint8).reshape(-1, BITS // 8) for x in parts)


def likeness(one: Chains, other: Chains) -> float:
    """From 0 to 1; by selected features if both texts have them."""
    if not any(map(len, one)) or not any(map(len, other)):
        return float(any(map(len, one)) == any(map(len, other)))
    for a, b in zip(one, other, strict=True):
        if len(a) and len(b):
            return _chain_likeness(a, b)
    return 0.0


def _chain_likeness(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    x, y = (np.unpackbits(z, axis=1).astype(np.float32) for z in (a, b))
    both, nx, ny = x @ y.T, x.sum(1)[:, None], y.sum(1)[None, :]
    most, chance = np.minimum(nx, ny), nx * ny / BITS
    least = chance + CUTOFF * (most - chance)
    scores = np.where(both >= most, 1.0, np.clip((both - least) / np.maximum(most - least, 1e-9), 0, 1))
    return float(scores.max(1).mean())


# -- rarity -----------------------------------------------------------------------------------------------------------
def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(LEVELS + 1, np.int64)
    for batch in batches:
        data, rows = text_buffers(batch.column(0))
        for a, b in row_blocks(rows, BLOCK_BYTES):
            levels = entropies(data[rows[a] : rows[b]])
            owner = np.repeat(np.arange(b - a), np.diff(rows[a : b + 1]))
            if len(levels):
                counts += np.bincount(levels[owner[: len(levels)] == owner[WIDTH - 1 :]], minlength=LEVELS + 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS + 1, dtype=np.int32)), pa.array(counts)], ["level", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy level, rarest first, from the windows of all documents; UNUSED outside USABLE."""
    counts = np.zeros(LEVELS + 1, np.int64)
    seen = id_and_text(docs).select("text").mapInArrow(_levels, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))
    for row in seen.collect():  # one row per level
        counts[row.level] = row.n
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(LEVELS + 1)
    ranks[: USABLE[0]] = UNUSED
    ranks[USABLE[1] + 1 :] = UNUSED
    return ranks


def _only(batches: Iterator[pa.RecordBatch], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [text_of(c) for c in chains(batch.column(1), ranks)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "fingerprint"])


def fingerprint(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id and fingerprint of each document."""
    ranks = rarity(docs) if ranks is None else ranks
    return id_and_text(docs).mapInArrow(partial(_only, ranks=ranks), "doc_id long, fingerprint string")


# -- edited copies ----------------------------------------------------------------------------------------------------
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
PASS = RESULT + ", part int, edge string, text string"


def _compared(ids: list, texts: list[str], following: list[str], ranks: np.ndarray, after: np.ndarray | None = None) -> list[list]:
    """Columns of RESULT for documents and the ones that follow them."""
    edited = []
    for text, other in zip(texts, following, strict=True):
        k = len(text) // 3
        edited.append(text[: len(text) - k] + other[:k])
    own = list(chains(pa.array(texts, pa.string()), ranks))
    changed = list(chains(pa.array(edited, pa.string()), ranks))
    chained = all(a is b for a, b in zip(texts[1:], following[:-1], strict=True))
    nexts = [*own[1:], *chains(pa.array(following[-1:], pa.string()), ranks)] if chained else list(chains(pa.array(following, pa.string()), ranks))
    return [
        ids,
        [len(t) for t in texts],
        [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        [text_of(c) for c in own],
        [text_of(c) for c in changed],
        [likeness(a, b) for a, b in zip(own, changed, strict=True)],
        [likeness(a, b) for a, b in zip(own, nexts, strict=True)],
    ]


TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the exchange that orders them."""
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [press(t.encode()) for t in batch.column(1).fill_null("").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.binary())], ["doc_id", "tie", "pressed"])


def _in_order(batches: Iterator[pa.RecordBatch], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents of one task in order: all but the last are compared; the first and the last go on as edges."""
    part = TaskContext.get().partitionId()
    unpress = zstandard.ZstdDecompressor().decompress
    held: list[tuple] = []

    def edge(kind: str, doc: tuple) -> pa.RecordBatch:
        columns = [pa.array([doc[0]], pa.int64()), *(pa.nulls(1, t) for t in TYPES[1:])]
        columns += [pa.array([part], pa.int32()), pa.array([kind]), pa.array([doc[1]], pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*NAMES, "part", "edge", "text"])

    first = True
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            texts = [unpress(t).decode() for t in batch.column(1)[at : at + 500].to_pylist()]
            docs = [*held, *zip(batch.column(0)[at : at + 500].to_pylist(), texts, strict=True)]
            if first:
                yield edge("first", docs[0])
                first = False
            held = docs[-1:]
            if len(docs) > 1:
                ids, bodies = (list(x) for x in zip(*docs, strict=True))
                columns = [pa.array(c, t) for c, t in zip(_compared(ids[:-1], bodies[:-1], bodies[1:], ranks), TYPES, strict=True)]
                n = len(ids) - 1
                columns += [pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*NAMES, "part", "edge", "text"])
    for doc in held:
        yield edge("last", doc)


def _edges(batches: Iterator[pa.RecordBatch], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            columns = _compared(*(batch.column(i).to_pylist() for i in range(3)), ranks)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of a copy whose last third the next document's beginning replaces.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (likeness of
    the document's fingerprint with the copy's and with the next document's).
    """
    ranks = rarity(docs)
    rows = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    pressed = rows.mapInArrow(_pressed, "doc_id long, tie long, pressed binary")
    ordered = pressed.repartitionByRange(F.col("doc_id").desc_nulls_last())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "tie").select("doc_id", "pressed")
    found, _ = written(ordered.mapInArrow(partial(_in_order, ranks=ranks), PASS), "fingerprints")
    edges = found.where("edge IS NOT NULL").select("part", "edge", "doc_id", "text")
    # Two rows per task: each task's last document meets the next task's first one.
    parts = edges.where("edge = 'first'").select("part")
    everything = Window.partitionBy(F.lit(0)).orderBy("part")
    whole = Window.partitionBy(F.lit(0))
    nexts = parts.select("part", F.coalesce(F.lead("part").over(everything), F.min("part").over(whole)).alias("next"))
    firsts = edges.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = edges.where("edge = 'last'").join(nexts, "part").join(firsts, "next").select("doc_id", "text", "following")
    rest = lasts.mapInArrow(partial(_edges, ranks=ranks), RESULT)
    return found.where("edge IS NULL").select(*NAMES).unionByName(rest)
