"""Hard negatives by Strassen multiplication of anchor and candidate tiles (operator 13).

Vectors become whole numbers, floor(scale * x). Anchors, a stated set given by a condition on the id, and candidates are
packed into tiles, and each anchor tile meets each candidate tile once per pass. A tile product is worked out by
Strassen's recursion: both tiles are padded with zeros to even halves, seven half-size products take the place of
eight, and all additions are exact 64-bit integer ones (they wrap around alike, so a score that fits in 64 bits is right
even where a sum in between is not). At the leaves numpy multiplies, in doubles where all sums stay below 2**53.

The first pass keeps the best rows of the anchor's label per anchor. Each of these positives opens a window of scores
for negatives; the second pass keeps the best rows of other labels per window. What a task keeps are heaps of bounded
size, and heaps of the same anchor or window are merged by taking the best of both, so a hot label, a large group of
copies or a lost executor changes no more than which task keeps a row.

Rows: a null id or label, or a vector that is null, empty or holds a null or non-finite component, takes no part.
Vectors of different lengths never meet. Equal scores go to the smaller id. Anchors of equal id, label and vector are
one anchor; rows of the anchor's id are never its candidates. A candidate row that repeats counts each time. An anchor
without a positive and a positive with an empty window give no rows, nor does an empty table. Further columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import stored

TILE_ROWS = 2048
ANCHOR_ROWS = 512
LEAF = 64  # a tile with a side below this is multiplied directly
LANES = 2  # lanes of candidate tiles for each shuffle partition
GROUP_TILES = 64  # anchor tiles that meet a candidate tile in one task
LEAST = np.iinfo(np.int64).min

TILE = "dim int, ids binary, labels binary, vectors binary, windows binary"
HITS = "anchor long, slot int, vec_id long, score long"


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and components floor(scale * x), all long, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite)
    v = F.transform(x, lambda v: F.floor(v * float(scale)).cast("long")).alias("v")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v)


def _even(a: np.ndarray) -> np.ndarray:
    """Padded with zeros to even sides."""
    return np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2))) if a.shape[0] % 2 or a.shape[1] % 2 else a


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, modulo 2**64."""
    m, n = a.shape[0], b.shape[1]
    if min(m, n, a.shape[1]) < leaf or a.shape[1] < 2:
        return _leaf(a, b)
    a, b = _even(a), _even(b)
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    with np.errstate(over="ignore"):
        p1 = strassen(a11 + a22, b11 + b22, leaf)
        p2 = strassen(a21 + a22, b11, leaf)
        p3 = strassen(a11, b12 - b22, leaf)
        p4 = strassen(a22, b21 - b11, leaf)
        p5 = strassen(a11 + a12, b22, leaf)
        p6 = strassen(a21 - a11, b11 + b12, leaf)
        p7 = strassen(a12 - a22, b21 + b22, leaf)
        out = np.empty((2 * i, 2 * j), np.int64)
        out[:i, :j] = p1 + p4 - p5 + p7
        out[:i, j:] = p3 + p5
        out[i:, :j] = p2 + p4
        out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def best_of_rows(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, id and score of the k best allowed columns of each row that reach its floor; ties to smaller ids."""
    allowed = allowed & (scores >= floor[:, None])
    alive = np.flatnonzero(allowed.any(1))
    part = np.where(allowed[alive], scores[alive], LEAST)
    if part.shape[1] > k:
        bar = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k]
        row, column = np.nonzero(allowed[alive] & (part >= bar[:, None]))
    else:
        row, column = np.nonzero(allowed[alive])
    score = part[row, column]
    order = np.lexsort((ids[column], ~score, row))  # ~score: descending
    row, column, score = row[order], column[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    return alive[row[keep]], ids[column[keep]], score[keep]


class Heaps:
    """The k best (score, smaller id) for each of n numbers; heaps of the same numbers merge by adding one to the other."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.at, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(n, LEAST)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(at):
            return
        at, ids, scores = (np.concatenate(x) for x in ((self.at, at), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, ~scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < self.k
        self.at, self.ids, self.scores = at[keep], ids[keep], scores[keep]
        full = rank == self.k - 1
        self.floor[at[full]] = scores[full]


def _pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Tiles of (id, label, vector, windows) by vector length, each of so many rows."""
    open_tiles: dict[int, list] = {}

    def tile(dim: int) -> pa.RecordBatch:
        parts = [np.concatenate(x) for x in zip(*open_tiles.pop(dim), strict=True)]
        columns = [pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)]
        return pa.RecordBatch.from_arrays(columns, ["dim", "ids", "labels", "vectors", "windows"])

    for batch in batches:
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        flat, offsets = batch.column(2).flatten().to_numpy(), batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
        windows = batch.column(3).flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, 0), np.int64)
        sizes = np.diff(offsets)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            vectors = flat[offsets[at][:, None] + np.arange(dim)]
            for first in range(0, len(at), rows):
                part = at[first : first + rows]
                open_tiles.setdefault(dim, []).append((ids[part], labels[part], vectors[first : first + rows], windows[part]))
                if sum(len(x[0]) for x in open_tiles[dim]) >= rows:
                    yield tile(dim)
    for dim in list(open_tiles):
        yield tile(dim)


def _tiles(rows: DataFrame, most: int) -> DataFrame:
    """Rows of (number, label, v, windows) in tiles; windows are lists of whole numbers of one length."""
    return rows.mapInArrow(partial(_pack, rows=most), TILE)


def _meet(batches: Iterator[pa.RecordBatch], k: int, slots: int, positives: bool, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Multiply pairs of tiles. For positives one heap per anchor, otherwise one per anchor and window of scores."""
    kept: dict[bytes, tuple[np.ndarray, Heaps]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            dim = row["dim"]
            # An anchor carries its number; its windows hold its id and then the scores of its positives.
            numbers, a_labels, a, info, ids, labels, c = (
                np.frombuffer(row[x], np.int64) for x in ("a_ids", "a_labels", "a_vectors", "a_windows", "ids", "labels", "vectors")
            )
            info = info.reshape(len(numbers), -1)
            name = dim.to_bytes(4, "little") + row["a_ids"]
            if name not in kept:
                kept[name] = numbers, Heaps(len(numbers) * slots, k)
            heaps = kept[name][1]
            scores = strassen(a.reshape(-1, dim), np.ascontiguousarray(c.reshape(-1, dim).T))
            same = a_labels[:, None] == labels[None, :]
            if positives:
                allowed = same & (info[:, :1] != ids[None, :])
                heaps.add(*best_of_rows(scores, allowed, ids, k, heaps.floor))
                continue
            other = ~same & (info[:, :1] != ids[None, :])
            for slot in range(slots):
                # low * positive <= 100 * negative <= high * positive, as bounds of the negative score; exact in Python.
                wanted = [p for p in info[:, 2 + slot].tolist()]
                known = info[:, 1] > slot
                least = np.array([max(-(-low * p // 100), LEAST) for p in wanted])
                most = np.array([min(high * p // 100, -LEAST - 1) for p in wanted])
                inside = other & known[:, None] & (scores >= least[:, None]) & (scores <= most[:, None])
                at, found, score = best_of_rows(scores, inside, ids, k, heaps.floor[slot::slots])
                heaps.add(at * slots + slot, found, score)
    for numbers, heaps in kept.values():
        columns = [pa.array(numbers[heaps.at // slots]), pa.array((heaps.at % slots).astype(np.int32)), pa.array(heaps.ids), pa.array(heaps.scores)]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "slot", "vec_id", "score"])


def _best(anchors: DataFrame, candidates: DataFrame, k: int, slots: int, positives: bool, low: int = 0, high: int = 0) -> DataFrame:
    """anchor (its number), slot, rank, vec_id, score over all pairs of tiles; heaps of all tasks merged.

    Candidate tiles are dealt to lanes, anchor tiles go to every lane; both in groups, so that no task holds all of either.
    """
    spark = candidates.sparkSession
    asked = stored(_tiles(anchors, ANCHOR_ROWS).toDF("a_dim", "a_ids", "a_labels", "a_vectors", "a_windows"))
    lanes = LANES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-asked.count() // GROUP_TILES))
    dealt = candidates.withColumn("lane", F.pmod(F.xxhash64("ids", "vectors"), F.lit(lanes)))
    dealt = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("a_ids"), F.lit(groups)).cast("int")).withColumn(
        "lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long")))
    )
    pairs = dealt.join(asked, ["lane", "group"]).where("dim = a_dim")
    pairs = pairs.select("dim", "a_ids", "a_labels", "a_vectors", "a_windows", "ids", "labels", "vectors")
    hits = pairs.mapInArrow(partial(_meet, k=k, slots=slots, positives=positives, low=low, high=high), HITS)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    embeddings: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, embedding, label).

    Negatives of a positive are the best rows of other labels with low/100 to high/100 of its score.
    """
    vectors = stored(whole_vectors(embeddings, scale))
    no_windows = F.array().cast("array<long>")
    tiles = stored(_tiles(vectors.select("vec_id", "label", "v", no_windows.alias("w")), TILE_ROWS))
    # Different anchors may share an id, so an anchor has a number of its own.
    anchors = stored(vectors.where(is_anchor).distinct().withColumn("anchor", F.monotonically_increasing_id()))
    asked = anchors.select("anchor", "label", "v", F.array("vec_id").alias("w"))
    found = stored(_best(asked, tiles, positives, 1, True).select("anchor", "rank", "vec_id", "score"))
    scores = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))  # at most `positives`
    filled = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get(F.col("p.score"), i), F.lit(0).cast("long")))
    windows = F.concat(F.array("vec_id", F.size("p").cast("long")), filled)
    asked = anchors.join(scores, "anchor").select("anchor", "label", "v", windows.alias("w"))
    negative = _best(asked, tiles, negatives, positives, False, low, high)
    positive = found.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    rows = negative.join(positive, ["anchor", "slot"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return rows.select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
