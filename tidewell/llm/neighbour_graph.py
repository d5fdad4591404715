"""Near duplicates of embeddings by NN-descent (operator 11).

Rows of one label are compared by cosine in double precision; those at or above the threshold are linked.

- Equal vectors of a label are one node with a number of copies. A node carries a small code, its direction in 8-bit
  whole numbers, and how far the code is tilted from it, so that angles of codes bound real ones.
- First lists: random hyperplanes deal nodes to small cells, and the nodes of a cell propose each other.
- NN-descent: the nodes that have w in their list or stand in w's list meet at w (neighbours of neighbours). Pairs with
  a fresh entry are compared, and each list keeps its nearest. Cells and hubs of more than GROUP nodes are split by a hash.
- A list that is full of linked nodes is saturated. Where many near copies lie together, nodes within half the threshold
  angle of one leader form a core: they are all linked with each other for certain, so their links are counted by size
  and no pair is written. The leader stays in the graph for its core. Other saturated lists are enlarged to twice their
  size. Then the descent goes on, until no list is saturated.
- What may link to a core lies near its leader; it is compared with the core in tiles, which give counts per node.
  Other links are the list entries, compared again with the vectors themselves.
- Audit: the links of AUDIT nodes (those with the smallest hashes) are counted against all nodes. If less than ENOUGH
  of them were found, lists and cells are enlarged and the descent goes on, PASSES times at most; the recall is logged.

No link below the threshold is made. Only the audited nodes' vectors and counts of parts go to the driver.

Rows: a null id or label, and a vector that is null, empty, zero or holds a null or non-finite component, links with
nothing. Vectors of different lengths never link. Each row is a vector of its own, also if it repeats; rows of one id
and vector are linked with each other. A row without an id has no component and is kept. Nodes are told apart by a
64-bit hash of label and vector. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import small_side, stored
from tidewell.llm.components import components

LIST = 8  # first size of a neighbour list
GROUP = 48  # nodes that meet in one group, at most about twice as many
CELL = 24  # nodes of a cell, about
TABLES = 6  # ways to deal nodes to cells, in each pass
ROUNDS = 4
SETTLED = 0.05  # share of fresh entries below which a descent ends
AUDIT = 2048
ENOUGH = 0.99
PASSES = 3
TILE = 256
SLACK = 1e-9  # far above the rounding of cosines

NODE = "node long, part long, code binary, tilt double"
PAIR = "u long, v long, sim float"
LISTS = ["u", "v", "sim", "fresh", "cap", "floor"]
COUNT = "node long, n long, other long"

log = logging.getLogger(__name__)


def _with_node(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, x and node of every row; a row that links with nothing has no node."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(x, lambda v: v + F.lit(0.0)).alias("x"), finite.alias("finite")
    )
    may_link = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("finite")
    return rows.select("vec_id", "label", "x", F.when(may_link, F.xxhash64("label", "x")).alias("node"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; large and small components are scaled first."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of a list column, the rows that have it and their values as a matrix."""
    sizes = np.diff(lists.offsets.to_numpy())
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield at, _matrix(lists.take(pa.array(at)), dim)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, x in _by_length(batch.column(2)):
            unit = _units(x)
            code = np.rint(unit * (127 / np.abs(unit).max(1, keepdims=True)))
            cosine = (unit * code).sum(1) / np.sqrt((code**2).sum(1))
            tilt = np.arccos(np.clip(cosine, -1, 1)) + SLACK
            rows = pa.array([r.tobytes() for r in code.astype(np.int8)], pa.binary())
            picked = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(picked), batch.column(1).take(picked), rows, pa.array(tilt)], ["node", "part", "code", "tilt"]
            )


def _codes(column: pa.Array, at: np.ndarray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.int8).reshape(-1, dim)


def _cells(batches: Iterator[pa.RecordBatch], bits: dict[int, int], salt: int, tables: int) -> Iterator[pa.RecordBatch]:
    """The cell of each node in each table; ``bits`` by part, 0 if not listed."""
    for batch in batches:
        sizes = np.array([len(c) for c in batch.column(2).to_pylist()], np.int64)
        parts = batch.column(1).to_numpy()
        depth = np.array([bits.get(p, 0) for p in parts.tolist()], np.int64)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            code = _codes(batch.column(2), at, dim).astype(np.float32)
            for t in range(tables):
                planes = np.random.default_rng([salt, t, dim]).normal(size=(dim, 40)).astype(np.float32)
                sides = (code @ planes > 0) & (np.arange(40) < depth[at][:, None])
                cell = sides @ (1 << np.arange(40, dtype=np.int64))
                picked = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(picked), batch.column(1).take(picked), pa.array(np.full(len(at), t, np.int32)), pa.array(cell)],
                    ["node", "part", "t", "cell"],
                )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the members (node, code, fresh, floor, cap) of each group; the pairs that may enter a list."""
    for batch in batches:
        groups = batch.column(0)
        sizes, members = np.diff(groups.offsets.to_numpy()), groups.flatten()
        begins = groups.offsets.to_numpy()[:-1] - groups.offsets[0].as_py()
        node, fresh, floor, cap = (members.field(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
        raw = members.field(1).to_pylist()
        dims = np.array([len(raw[b]) for b in begins.tolist()], np.int64)
        order = np.lexsort((sizes, dims))
        first = 0
        while first < len(order):
            # Groups of one vector length and like sizes are compared at once.
            last = first + 1
            while last < len(order) and dims[order[last]] == dims[order[first]] and (last - first + 1) * sizes[order[last]] ** 2 < 400_000:
                last += 1
            chosen = order[first:last]
            first = last
            width, dim = int(sizes[chosen].max()), int(dims[chosen[0]])
            place = begins[chosen][:, None] + np.arange(width)
            real = np.arange(width) < sizes[chosen][:, None]
            place = np.where(real, place, begins[chosen][:, None])
            code = np.frombuffer(b"".join(raw[i] for i in place.ravel().tolist()), np.int8).reshape(*place.shape, dim).astype(np.float32)
            code /= np.sqrt((code**2).sum(2, keepdims=True))
            sim = code @ code.transpose(0, 2, 1)
            ids, new, low, most = node[place], fresh[place], floor[place], int(cap[place].max())
            good = real[:, :, None] & real[:, None, :] & (ids[:, :, None] != ids[:, None, :])
            good &= (new[:, :, None] | new[:, None, :]) & (sim > low[:, :, None])
            sim = np.where(good, sim, -2)
            if width > most:  # only the nearest of a group can enter a list
                nearest = np.argpartition(-sim, most - 1, axis=2)[:, :, :most]
                sim = np.take_along_axis(sim, nearest, 2)
                others = np.take_along_axis(np.broadcast_to(ids[:, None, :], good.shape), nearest, 2)
            else:
                others = np.broadcast_to(ids[:, None, :], good.shape)
            g, i, j = np.nonzero(sim > -2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[g, i]), pa.array(others[g, i, j]), pa.array(sim[g, i, j])], ["u", "v", "sim"])


def _split(rows: DataFrame, key: list[str], salt: int) -> DataFrame:
    """Rows with a ``chunk``, so that no (key, chunk) has many more than GROUP rows; the counts are combined first."""
    large = stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP))
    split = rows.join(small_side(large, 40), key, "left")
    chunks = F.coalesce(F.ceil(F.col("_n") / GROUP), F.lit(1))
    return split.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(salt)), chunks)).drop("_n")


def _proposals(grouped: DataFrame, nodes: DataFrame, lists: DataFrame, key: list[str]) -> DataFrame:
    """Pairs out of groups (key, chunk, node, fresh), compared by code."""
    limits = lists.groupBy("u").agg(F.first("floor").alias("floor"), F.first("cap").alias("cap")).withColumnRenamed("u", "node")
    carried = nodes.select("node", "code").join(limits, "node", "left")
    member = F.struct(
        "node", "code", "fresh", F.coalesce("floor", F.lit(-1.0)).cast("float").alias("floor"), F.coalesce("cap", F.lit(LIST)).cast("int").alias("cap")
    )
    groups = grouped.join(carried, "node").groupBy(*key, "chunk").agg(F.collect_list(member).alias("m"))  # about GROUP at most
    return groups.where((F.size("m") > 1) & F.exists("m", lambda m: m["fresh"])).select("m").mapInArrow(_compare, PAIR)


def _update(lists: DataFrame, proposed: DataFrame, least: int) -> DataFrame:
    """Lists with the nearest of what they held and what is proposed; what is new in them is fresh."""
    held = lists.select("u", "v", "sim", F.lit(False).alias("fresh"), "cap")
    new = proposed.select("u", "v", "sim", F.lit(True).alias("fresh"), F.lit(least).alias("cap"))
    merged = held.unionByName(new).repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"), F.max("cap").alias("cap"))
    own = Window.partitionBy("u")
    ranked = merged.withColumn("cap", F.max("cap").over(own)).withColumn("_r", F.row_number().over(own.orderBy(F.desc("sim"), "v")))
    kept = ranked.where(F.col("_r") <= F.col("cap"))
    floor = F.when(F.count(F.lit(1)).over(own) >= F.col("cap"), F.min("sim").over(own)).otherwise(F.lit(-1.0)).cast("float")
    return stored(kept.withColumn("floor", floor).select(*LISTS))


def _descend(nodes: DataFrame, lists: DataFrame, salt: int, tables: int, least: int) -> DataFrame:
    """Cells, then rounds of neighbours of neighbours."""
    counts = nodes.groupBy("part").count().where(F.col("count") > CELL).collect()  # parts with more than a cell
    bits = {r["part"]: min(40, math.ceil(math.log2(r["count"] / CELL))) for r in counts}
    cells = nodes.select("node", "part", "code").mapInArrow(partial(_cells, bits=bits, salt=salt, tables=tables), "node long, part long, t int, cell long")
    cells = _split(cells.withColumn("fresh", F.lit(True)), ["part", "t", "cell"], salt)
    lists = _update(lists, _proposals(cells, nodes, lists, ["part", "t", "cell"]), least)
    for round_ in range(ROUNDS):
        total, fresh = lists.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
        if fresh <= SETTLED * total:
            break
        edges = lists.select(F.col("u").alias("w"), F.col("v").alias("node"), "fresh").unionByName(
            lists.select(F.col("v").alias("w"), F.col("u").alias("node"), "fresh")
        )
        back = lists.where("fresh").select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")
        met = _proposals(_split(edges, ["w"], salt + round_), nodes, lists, ["w"])
        lists = _update(lists, met.unionByName(back), least)
    return lists


def _cosine_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, x in _by_length(batch.column(2)):
            picked = pa.array(at)
            cosine = (_units(x) * _units(_matrix(batch.column(3).take(picked), x.shape[1]))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(cosine)], ["u", "v", "cosine"])


def _cosines(pairs: DataFrame, classes: DataFrame, few_v: bool = False) -> DataFrame:
    """u, v, cosine of the vectors themselves; ``few_v``: v are few nodes."""
    x = classes.select(F.col("node").alias("u"), F.col("x").alias("a"))
    y = classes.select(F.col("node").alias("v"), F.col("x").alias("b"))
    if few_v:
        wanted = pairs.select("v").distinct()
        y = stored(y.join(wanted, "v", "left_semi"))
        width = y.agg(F.max(F.size("b"))).first()[0] or 1
        y = small_side(y, 8 * width + 16)
    return pairs.join(x, "u").join(y, "v").select("u", "v", "a", "b").mapInArrow(_cosine_column, "u long, v long, cosine double")


def _without(lists: DataFrame, gone: DataFrame) -> DataFrame:
    """List entries of and to nodes that are not in ``gone`` (node)."""
    for end in ("u", "v"):
        lists = lists.join(small_side(gone.select(F.col("node").alias(end)), 8), end, "left_anti")
    return lists.select(*LISTS)


def _count_tile(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between the core tile and the other tile of a row, as copies per node; other: the core that a node touches."""
    for batch in batches:
        nodes, counts, others = [], [], []
        for row in batch.to_pylist():
            a, b = row["core"], row["near"]
            linked = _units(np.array([m["x"] for m in a])) @ _units(np.array([m["x"] for m in b])).T >= threshold
            for members, per in ((a, linked @ np.array([m["copies"] for m in b])), (b, np.array([m["copies"] for m in a]) @ linked)):
                for m, n in zip(members, per.tolist(), strict=True):
                    if n:
                        nodes.append(m["node"])
                        counts.append(n)
                        others.append(row["leader"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nodes, counts, others)], ["node", "n", "other"])


def _tiles(rows: DataFrame, name: str) -> DataFrame:
    """(leader, members of at most about TILE nodes)."""
    sizes = small_side(stored(rows.groupBy("leader").agg(F.count(F.lit(1)).alias("_n"))), 16)
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / TILE))
    return rows.join(sizes, "leader").groupBy("leader", chunk.alias("chunk")).agg(F.collect_list(F.struct("node", "copies", "x")).alias(name)).drop("chunk")


def _core_links(cores: DataFrame, lists: DataFrame, classes: DataFrame, angle: float, tilt: float, threshold: float) -> DataFrame:
    """node, n, other: links between cores and what lies near their leaders, per node and tile."""
    leaders = stored(cores.select(F.col("leader").alias("node")).distinct())
    both = lists.select("u", "v", "sim").unionByName(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))
    met = both.where(F.col("sim") >= math.cos(min(math.pi, 2 * angle + 2 * tilt))).select("u", "v").distinct()
    met = met.join(small_side(leaders.select(F.col("node").alias("u")), 8), "u", "left_semi").select(F.col("u").alias("leader"), F.col("v").alias("node"))
    # A core that lies near another one comes with all its members, from the smaller leader only.
    member = cores.unionByName(leaders.select("node", F.col("node").alias("leader")))
    of = member.select("node", F.col("leader").alias("other_leader"))
    plain = met.join(of, "node", "left_anti")
    whole = met.where("leader < node").join(of.select(F.col("node").alias("m"), F.col("other_leader").alias("node")), "node").select("leader", F.col("m").alias("node"))
    x = classes.select("node", "copies", "x")
    near = _tiles(plain.unionByName(whole).join(x, "node"), "near")
    touched = near.select("leader").distinct()
    core = _tiles(member.join(touched, "leader", "left_semi").join(x, "node"), "core")
    return core.join(near, "leader").select("leader", "core", "near").mapInArrow(partial(_count_tile, threshold=threshold), COUNT)


def _true_links(batches: Iterator[pa.RecordBatch], sample: list[tuple], threshold: float) -> Iterator[pa.RecordBatch]:
    by_part: dict[int, list] = {}
    for node, part, x in sample:
        by_part.setdefault(part, []).append((node, x))
    fixed = {p: (np.array([n for n, _ in s]), _units(np.array([x for _, x in s]))) for p, s in by_part.items()}
    for batch in batches:
        parts, copies = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for at, x in _by_length(batch.column(3)):
            unit = _units(x)
            for p in np.unique(parts[at]).tolist():
                if p in fixed:
                    own = parts[at] == p
                    n = (unit[own] @ fixed[p][1].T >= threshold).T @ copies[at][own]
                    yield pa.RecordBatch.from_arrays([pa.array(fixed[p][0]), pa.array(n), pa.array(n)], ["node", "n", "other"])


def _recall(classes: DataFrame, links: DataFrame, threshold: float) -> float:
    """The share of the audited nodes' links that were found."""
    sample = classes.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(AUDIT).select("node", "part", "x").collect()
    if not sample:
        return 1.0
    count = partial(_true_links, sample=[(r.node, r.part, r.x) for r in sample], threshold=threshold)
    true = classes.select("node", "part", "copies", "x").mapInArrow(count, COUNT).groupBy("node").agg((F.sum("n") - 1).alias("true"))
    found, all_ = true.join(links, "node", "left").agg(F.sum(F.least(F.coalesce("n_links", F.lit(0)), "true")), F.sum("true")).first()
    return found / all_ if all_ else 1.0


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable by links), kept (vec_id = component_id), one row per row."""
    spark = embeddings.sparkSession
    angle = math.acos(threshold)
    rows = _with_node(embeddings).where(F.col("node").isNotNull())
    # Copies are counted before the shuffle.
    classes = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"), F.first("label").alias("label"), F.first("x").alias("x")
    )
    classes = stored(classes.select("node", F.xxhash64("label", F.size("x")).alias("part"), "copies", "first_id", "x"))
    nodes = stored(classes.select("node", "part", "x").mapInArrow(_encode, NODE))
    tilt = nodes.agg(F.max("tilt")).first()[0] or 0.0
    near = math.cos(min(math.pi, angle + 2 * tilt))
    wide = math.cos(min(math.pi, 2 * angle + 2 * tilt))
    lists = spark.createDataFrame([], "u long, v long, sim float, fresh boolean, cap int, floor float")
    cores = spark.createDataFrame([], "node long, leader long")
    tables, least, salt = TABLES, LIST, 0
    for pass_ in range(PASSES):
        while True:
            lists = _descend(nodes, lists, salt, tables, least)
            salt += 100
            leaders = stored(cores.select(F.col("leader").alias("node")).distinct())
            leading = small_side(leaders.select(F.col("node").alias("u")), 8)
            plain = lists.join(leading, "u", "left_anti")
            saturated = plain.where(F.col("floor") >= near)
            wider = lists.join(leading, "u", "left_semi").where(F.col("floor") >= wide)
            full = stored(saturated.unionByName(wider).select("u").distinct())
            if full.isEmpty():
                break
            tight = saturated.where(F.col("sim") >= math.cos(angle / 2)).select("u", "v")
            tight = tight.join(small_side(leaders.select(F.col("node").alias("v")), 8), "v", "left_anti")
            groups = components(tight.select("u", "v")).where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
            inside = _cosines(groups, classes, few_v=True).where(F.col("cosine") >= math.cos(angle / 2) + SLACK)
            new = stored(inside.select(F.col("u").alias("node"), F.col("v").alias("leader")))
            if not new.isEmpty():
                cores = stored(cores.unionByName(new))
                nodes = stored(nodes.join(new.select("node"), "node", "left_anti"))
                # Whoever listed a member now lists its leader.
                moved = lists.join(new.select(F.col("node").alias("v"), "leader"), "v").where("u <> leader")
                moved = moved.join(new.select(F.col("node").alias("u")), "u", "left_anti").select("u", F.col("leader").alias("v")).distinct()
                moved = _cosines(moved, classes, few_v=True).select("u", "v", F.col("cosine").cast("float").alias("sim"))
                back = moved.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")
                lists = _update(_without(lists, new), moved.unionByName(back), least)
            grown = small_side(full.withColumn("_full", F.lit(True)), 9)
            lists = lists.join(grown, "u", "left").withColumn("cap", F.when(F.col("_full"), F.col("cap") * 2).otherwise(F.col("cap")))
            lists = stored(lists.withColumn("floor", F.when(F.col("_full"), F.lit(-1.0)).otherwise(F.col("floor")).cast("float")).select(*LISTS))
        links, edges = _links(classes, lists, cores, leaders, angle, tilt, near, threshold)
        recall = _recall(classes, links, threshold)
        log.info("recall of the audited links after pass %d: %.4f", pass_ + 1, recall)
        if recall >= ENOUGH:
            break
        tables, least = 2 * tables, 2 * least
    return _report(embeddings, classes, links, edges)


def _links(classes, lists, cores, leaders, angle, tilt, near, threshold) -> tuple[DataFrame, DataFrame]:
    """node, n_links of the nodes that have links, and edges (u, v) that connect what is linked."""
    led = leaders.select(F.col("node").alias("u"))
    listed = lists.where(F.col("sim") >= near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    listed = listed.join(small_side(led, 8), "u", "left_anti").join(small_side(led.withColumnRenamed("u", "v"), 8), "v", "left_anti")
    exact = stored(_cosines(listed.select("u", "v"), classes).where(F.col("cosine") >= threshold).select("u", "v"))
    copies = classes.select("node", "copies")
    ways = exact.select("u", "v").unionByName(exact.select(F.col("v").alias("u"), F.col("u").alias("v")))
    single = ways.join(copies.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), F.col("copies").alias("n"))
    touching = stored(_core_links(cores, lists, classes, angle, tilt, threshold))
    member = cores.unionByName(leaders.select("node", F.col("node").alias("leader")))
    sizes = member.join(copies, "node").groupBy("leader").agg(F.sum("copies").alias("all"))
    own = member.join(small_side(stored(sizes), 16), "leader").select("node", (F.col("all") - 1).alias("n"))
    alone = copies.where("copies > 1").join(member, "node", "left_anti").select("node", (F.col("copies") - 1).alias("n"))
    parts = single.unionByName(touching.select("node", "n")).unionByName(own).unionByName(alone)
    links = stored(parts.groupBy("node").agg(F.sum("n").alias("n_links")).where("n_links > 0"))
    edges = exact.unionByName(touching.select(F.col("node").alias("u"), F.col("other").alias("v")))
    edges = edges.unionByName(cores.select(F.col("node").alias("u"), F.col("leader").alias("v")))
    return links, edges


def _report(embeddings: DataFrame, classes: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    reach = components(edges)
    first = reach.join(classes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("_least"))
    linked = links.join(reach.join(first, "component").select("node", "_least"), "node", "left")
    linked = linked.join(classes.select("node", "first_id"), "node").select("node", "n_links", F.coalesce("_least", "first_id").alias("_least"))
    found = _with_node(embeddings).select("vec_id", "node").join(small_side(stored(linked), 32), "node", "left")
    component = F.coalesce("_least", "vec_id")
    return found.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
