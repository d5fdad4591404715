"""Exact top-k inner product search by pivot-table elimination (operator 6).

Vectors become whole numbers, floor(scale * x). A few pivots are drawn far apart from a bounded sample, and each
vector's distance to every pivot is worked out once. By the triangle inequality the largest difference of two vectors'
pivot distances is a lower bound of their distance, which with their lengths gives an upper bound of their inner
product: (|q|^2 + |x|^2 - bound^2) / 2. A task takes candidates in the order of that bound and stops a query as soon as
its k-th score is above all bounds that are left, so the result is exact whatever the pivots are.

Vectors are packed into blocks, queries into blocks too, and each candidate block meets each query block once; a task
keeps k rows per query, which are merged by query. The queries are a stated set, given by a condition on the id.

Rows: a vector that is null, empty or holds a null or non-finite component takes no part, nor does one without an id.
Vectors of different lengths never meet. Equal scores go to the smaller id. A repeated row is a row like any other; a
query's own row and its repetitions (rows of the same id) are no candidates of it, and a repeated query row is
answered once. An empty table gives no rows. Scores must fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import stored

SAMPLE = 1024  # vectors from which pivots are drawn; their choice never changes the result
PIVOTS = 32
BLOCK_ROWS = 2048
QUERY_ROWS = 512
LANES = 2  # lanes of candidates for each shuffle partition
GROUP_BLOCKS = 64  # query blocks that meet a candidate block in one task
STEP = 128  # candidates that are evaluated between two looks at the bound

BLOCK = "dim int, ids binary, vectors binary, distances binary"
HITS = "query_id long, vec_id long, score long"


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id and components floor(scale * x) as long, for the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * float(scale)).cast("long")).alias("v"))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of a to rows of b."""
    return np.stack([((a - x) ** 2).sum(1) for x in b], 1) if len(b) else np.zeros((len(a), 0))


def draw_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """By vector length, pivots far from each other, out of the SAMPLE vectors with the smallest hash of their id."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").collect()
    out = {}
    for dim in sorted({len(r.v) for r in sample}):
        points = np.array([r.v for r in sample if len(r.v) == dim], np.float64)
        chosen = [0]
        gap = _squares(points, points[:1])[:, 0]
        while len(chosen) < min(pivots, len(points)) and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, _squares(points, points[chosen[-1:]])[:, 0])
        out[dim] = points[chosen]
    return out


def _pack(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], rows: int) -> Iterator[pa.RecordBatch]:
    open_blocks: dict[int, list] = {}

    def block(dim: int) -> pa.RecordBatch:
        ids, vectors = (np.concatenate(x) for x in zip(*open_blocks.pop(dim), strict=True))
        distances = np.sqrt(_squares(vectors.astype(np.float64), pivots.get(dim, np.zeros((0, dim)))))
        columns = [pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, distances))]
        return pa.RecordBatch.from_arrays(columns, ["dim", "ids", "vectors", "distances"])

    for batch in batches:
        ids, lists = batch.column(0).to_numpy(), batch.column(1)
        flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sizes = np.diff(offsets)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            vectors = flat[offsets[at][:, None] + np.arange(dim)]
            for first in range(0, len(at), rows):
                open_blocks.setdefault(dim, []).append((ids[at[first : first + rows]], vectors[first : first + rows]))
                if sum(len(x[0]) for x in open_blocks[dim]) >= rows:
                    yield block(dim)
    for dim in list(open_blocks):
        yield block(dim)


def pack(vectors: DataFrame, pivots: dict[int, np.ndarray], rows: int) -> DataFrame:
    return vectors.mapInArrow(partial(_pack, pivots=pivots, rows=rows), BLOCK)


class _Best:
    """The k best candidates so far of a block of queries, by score and then smaller id."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), np.iinfo(np.int64).min)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.filled = np.zeros((n, k), bool)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        k = self.scores.shape[1]
        matters = (allowed & (scores >= self.least(rows)[:, None])).any(1)
        rows, scores, ids, allowed = rows[matters], scores[matters], ids[matters], allowed[matters]
        scores = np.concatenate([self.scores[rows], scores], 1)
        ids = np.concatenate([self.ids[rows], ids], 1)
        filled = np.concatenate([self.filled[rows], allowed], 1)
        order = np.lexsort((ids, ~scores, ~filled), axis=1)[:, :k]  # ~scores: descending
        self.scores[rows] = np.take_along_axis(scores, order, 1)
        self.ids[rows] = np.take_along_axis(ids, order, 1)
        self.filled[rows] = np.take_along_axis(filled, order, 1)

    def least(self, rows: np.ndarray) -> np.ndarray:
        """The score that a further candidate has to reach; minus infinity while places are free."""
        return np.where(self.filled[rows, -1], self.scores[rows, -1].astype(np.float64), -np.inf)


def search_block(q_ids, q, q_far, c_ids, c, c_far, best: _Best) -> int:
    """Meet a block of candidates; the number of inner products that were worked out."""
    q_float, c_float = q.astype(np.float64), c.astype(np.float64)
    low = np.zeros((len(q), len(c)), np.float64)
    for p in range(q_far.shape[1]):
        np.maximum(low, np.abs(q_far[:, p, None] - c_far[None, :, p]), out=low)
    lengths = (q_float**2).sum(1)[:, None] + (c_float**2).sum(1)[None, :]
    # Rounding of roots and squares: a margin far above it, far below 1 for usual lengths.
    high = (lengths - low**2) / 2 + 1e-9 * lengths + 1e-3
    order = np.argsort(-high, axis=1)
    exact = max(np.abs(q_float).max(), 1) * max(np.abs(c_float).max(), 1) * q.shape[1] < 2**52
    active, done = np.arange(len(q)), 0
    for first in range(0, len(c), STEP):
        part = order[active, first : first + STEP]
        alive = high[active, part[:, 0]] >= best.least(active)
        active, part = active[alive], part[alive]
        if not len(active):
            break
        if exact:
            scores = np.matmul(c_float[part], q_float[active][:, :, None])[:, :, 0].astype(np.int64)
        else:
            scores = np.matmul(c[part], q[active][:, :, None])[:, :, 0]
        ids = c_ids[part]
        best.add(active, scores, ids, ids != q_ids[active][:, None])
        done += part.size
    return done


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    found: dict[bytes, tuple[np.ndarray, _Best]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            dim = row["dim"]
            arrays = [np.frombuffer(row[x], t) for x, t in (("q_ids", np.int64), ("q_vectors", np.int64), ("q_distances", float), ("ids", np.int64), ("vectors", np.int64), ("distances", float))]
            q_ids, c_ids = arrays[0], arrays[3]
            q, q_far = arrays[1].reshape(-1, dim), arrays[2].reshape(len(q_ids), -1)
            c, c_far = arrays[4].reshape(-1, dim), arrays[5].reshape(len(c_ids), -1)
            name = dim.to_bytes(4) + row["q_ids"]
            if name not in found:
                found[name] = q_ids, _Best(len(q_ids), k)
            search_block(q_ids, q, q_far, c_ids, c, c_far, found[name][1])
    for q_ids, best in found.values():
        at, place = np.nonzero(best.filled)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q_ids[at]), pa.array(best.ids[at, place]), pa.array(best.scores[at, place])], ["query_id", "vec_id", "score"]
        )


def top_k(embeddings: DataFrame, is_query: Column, k: int, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query row of (vec_id, embedding)."""
    spark = embeddings.sparkSession
    vectors = whole_vectors(embeddings, scale)
    table = draw_pivots(vectors, pivots)
    blocks = stored(pack(vectors, table, BLOCK_ROWS))
    wanted = vectors.where(is_query).distinct()
    queries = stored(pack(wanted, table, QUERY_ROWS).toDF("q_dim", "q_ids", "q_vectors", "q_distances"))
    # Candidates are dealt to lanes, queries go to every lane; both in groups, so that no task has to hold all of either.
    lanes = LANES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-queries.count() // GROUP_BLOCKS))
    dealt = blocks.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = queries.withColumn("group", F.pmod(F.xxhash64("q_ids"), F.lit(groups)).cast("int")).withColumn(
        "lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long")))
    )
    pairs = dealt.join(asked, ["lane", "group"]).where("dim = q_dim")
    pairs = pairs.select("dim", "q_ids", "q_vectors", "q_distances", "ids", "vectors", "distances")
    hits = pairs.mapInArrow(partial(_search, k=k), HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
