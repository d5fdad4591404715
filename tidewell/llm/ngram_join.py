"""Set similarity join of word shingles by PartEnum signatures (operator 5).

A document's set holds its distinct shingles of ``size`` words; one with fewer words has its whole sequence as its only
shingle, one without words the empty set, which links with nothing. Two sets link if their intersection is at least
``percent`` hundredths of their union.

Equal sets are one class from the start. For different ones: set sizes are cut into bands so that linked sets lie in
the same band or in neighbouring ones, and a set takes part in its own band and the next. In a band, linked sets
differ in at most k elements. The element domain is partitioned by a hash into more than k parts, so at least one part
is the same in both: each part with elements, together with its number, is a signature. Only a set with no more than k
parts that have elements could agree in empty parts alone; both sets of such a pair are of this kind, and those are
partitioned anew by other hashes, and at last take empty parts as signatures too. So no link is lost.

Sets that share a signature are candidates, and then:

1. an element that no other candidate has cannot be in an intersection; a candidate with too many such elements links
   with nothing and leaves;
2. in each group of one signature, all are compared with a hub only: the member with the most shared signatures that
   was no hub yet. Links join classes to components, and groups inside one component are finished. This is done
   HUB_ROUNDS times, whatever the size;
3. what is left are members of one group in different components; these pairs are compared once each. Alike sets
   share many signatures, so a pair is proposed by the smallest one only: members carry their EARLY smallest signatures,
   and a group leaves out pairs that share one of these below its own. Members also carry how many of their elements
   fall into each of BINS bins of a hash: the smaller counts add up to at least the intersection, and a pair that could
   not link even with as much in common leaves. Groups of more than TILE members are cut into tiles that meet in pairs.

Comparisons are exact on 64-bit hashes of shingles. Copies are never paired, and groups are never collected: hubs are
maxima, combined before the shuffle, and sets travel once per hub.

Rows: null texts are empty. Repeated rows are equal sets. A null doc_id never is a component's id unless all of the
component are null. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, freed, id_and_text, mixed, row_blocks, stored, text_buffers, tight, written
from tidewell.llm.components import components
from tidewell.llm.words import MULTIPLIER, shingle_numbers, word_numbers

BLOCK_BYTES = 1_000_000
SPARE_PARTS = 2  # parts beyond k + 1, and one more for each SPARE_SHARE, so that few sets have too many empty ones
SPARE_SHARE = 24
SCHEMES = 6
SHORT = np.uint64(2**32 - 1)  # the part of an element by which holders are counted
HUB_ROUNDS = 3
EARLY = 8  # signatures that members of a group carry, to tell whether a smaller group has proposed a pair
BINS = 128
TILE = 400  # members of one signature that meet others in one task

SETS = "doc_id long, _row long, n_shingles long, class long"


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted set of each text's shingles."""
    data, rows = text_buffers(texts)
    for a, b in row_blocks(rows, BLOCK_BYTES):
        words, first, _, _ = word_numbers(data[rows[a] : rows[b]], rows[a : b + 1] - rows[a])
        shingles = shingle_numbers(words, size)
        for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if y - x >= size:
                yield np.unique(shingles[x : y - size + 1])
            else:
                yield shingle_numbers(words[x:y], y - x) if y > x else np.zeros(0, np.uint64)


def set_number(elements: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mixed(np.array([np.bitwise_xor.reduce(mixed(elements)) + mixed(elements ^ MULTIPLIER).sum() + np.uint64(len(elements))]))[0].astype(np.int64))


def bands(largest: int, percent: int) -> np.ndarray:
    """First size of each band; a set of band i links with sets of the bands i - 1, i and i + 1 only."""
    firsts = [1]
    while firsts[-1] <= largest:
        firsts.append(max(firsts[-1] + 1, firsts[-1] * 100 // percent + 1))
    return np.array([*firsts, max(firsts[-1] + 1, firsts[-1] * 100 // percent + 1), 2**62], np.int64)


def signatures(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """The PartEnum signatures of each set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out: list[list[np.ndarray]] = [[] for _ in sets]
    if not sizes.sum():
        return [np.zeros(0, np.uint64) for _ in sets]
    firsts = bands(int(sizes.max()), percent)
    own = np.searchsorted(firsts, sizes, "right") - 1
    for step in (0, 1):
        work = np.flatnonzero(sizes > 0)
        for scheme in range(SCHEMES):
            band = own[work] + step
            upper = firsts[band + 1] - 1
            k = (2 * upper * (100 - percent)) // (100 + percent)
            parts = k + 1 + np.where(k > 0, SPARE_PARTS + k // SPARE_SHARE, 0)
            offsets = np.cumsum(parts) - parts
            elements = np.concatenate([sets[i] for i in work])
            row = np.repeat(np.arange(len(work)), sizes[work])
            with np.errstate(over="ignore"):
                seed = mixed((band * 64 + scheme).astype(np.uint64))
                hashed = mixed(elements + seed[row])
                part = offsets[row] + ((hashed >> np.uint64(20)) % parts[row].astype(np.uint64)).astype(np.int64)
                sums = np.zeros(int(parts.sum()), np.uint64)
                np.add.at(sums, part, mixed(hashed))
                filled = np.zeros(len(sums), bool)
                filled[part] = True
                number = np.arange(len(sums)) - np.repeat(offsets, parts)
                keys = mixed(sums + number.astype(np.uint64) * MULTIPLIER + np.repeat(seed, parts))
            counts = np.add.reduceat(filled, offsets, dtype=np.int64)
            few = counts <= k
            last = scheme == SCHEMES - 1
            for i, a, n, poor in zip(work.tolist(), offsets.tolist(), parts.tolist(), few.tolist(), strict=True):
                out[i].append(keys[a : a + n] if last and poor else keys[a : a + n][filled[a : a + n]])
            work = work[few]
            if not len(work):
                break
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def _classes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The size of each row's set, and its class."""
    for batch in batches:
        sets = [(len(s), set_number(s)) for s in shingle_sets(batch.column(2), size)]
        counts, classes = (pa.array([x[i] for x in sets], pa.int64()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], counts, classes], ["doc_id", "_row", "n_shingles", "class"])


def _sign(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(key, class) for each signature of each set, once per class and task."""
    seen: set[int] = set()  # classes of this task whose signatures are out already
    new: list[np.ndarray] = []
    classes: list[int] = []

    def flush() -> pa.RecordBatch:
        keys = signatures(new, percent)
        owners = np.repeat(np.array(classes, np.int64), [len(k) for k in keys])
        new.clear()
        classes.clear()
        flat = np.concatenate(keys).astype(np.int64) if keys else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(owners)], ["key", "class"])

    elements_held = 0
    for batch in batches:
        for elements in shingle_sets(batch.column(0), size):
            number = set_number(elements)
            if len(elements) and number not in seen:
                seen.add(number)
                new.append(elements)
                classes.append(number)
                elements_held += len(elements)
                if elements_held > 10**6 or len(new) >= 1000:
                    yield flush()
                    elements_held = 0
    yield flush()


def _shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, class) in order, those whose key at least two classes have; each once.

    Only the last row is carried from batch to batch, with whether it is out already.
    """
    carried = np.zeros((2, 0), np.int64)
    is_out = False
    for batch in batches:
        rows = np.concatenate([carried, np.stack([batch.column(i).to_numpy() for i in (0, 1)])], 1)
        if not rows.shape[1]:
            continue
        rows = rows[:, np.append(True, (rows[:, 1:] != rows[:, :-1]).any(0))]
        same = np.zeros(rows.shape[1], bool)
        same[1:] |= rows[0, 1:] == rows[0, :-1]
        last = bool(same[-1])
        same[:-1] |= rows[0, 1:] == rows[0, :-1]
        out = same.copy()
        if is_out:
            out[0] = False
            last |= rows.shape[1] == 1
        carried, is_out = rows[:, -1:], last
        yield pa.RecordBatch.from_arrays([pa.array(rows[0, out]), pa.array(rows[1, out])], ["key", "class"])


def _elements(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sets of classes, and how many elements agree with another one of their set in their short key."""
    for batch in batches:
        sets = list(shingle_sets(batch.column(1), size))
        right = pa.array([set_number(s) == c for s, c in zip(sets, batch.column(0).to_pylist(), strict=True)], pa.bool_())
        lists = pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))
        hidden = pa.array([len(s) - len(np.unique(s & SHORT)) for s in sets], pa.int64())
        counts = [np.bincount((mixed(s) >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS) for s in sets]
        bins = pa.array([c.astype(np.uint8).tobytes() if c.max() < 255 else None for c in counts], pa.binary())  # null: too many
        yield pa.RecordBatch.from_arrays([x.filter(right) for x in (batch.column(0), lists, hidden, bins)], ["class", "elements", "hidden", "bins"])


def _could_link(bins: list[bytes | None], sizes: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs may link, by an upper bound of their intersections."""
    known = np.array([b is not None for b in bins])
    counts = np.frombuffer(b"".join(b or bytes(BINS) for b in bins), np.uint8).reshape(-1, BINS)
    out = np.ones(len(i), bool)
    for a in range(0, len(i), 20_000):
        x, y = i[a : a + 20_000], j[a : a + 20_000]
        both = np.minimum(counts[x], counts[y]).sum(1, dtype=np.int64)
        out[a : a + 20_000] = (100 * both >= percent * (sizes[x] + sizes[y] - both)) | ~known[x] | ~known[y]
    return out


def _propose(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of each tile (key, crossing, members) that may link, in different components, unless a smaller early key has them."""
    for batch in batches:
        out = []
        keys, crossings = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        lists = batch.column(2)
        begins, sizes = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py(), np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        classes, components_, second = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        early = flat.field(3)
        elements, bins = flat.field(4).to_numpy(zero_copy_only=False), flat.field(5).to_pylist()
        early_begins, early_sizes, early_keys = early.offsets.to_numpy()[:-1] - early.offsets[0].as_py(), np.diff(early.offsets.to_numpy()), early.flatten().to_numpy()
        for key, crossing, a, n in zip(keys.tolist(), crossings.tolist(), begins.tolist(), sizes.tolist(), strict=True):
            own = slice(a, a + n)
            u, c = classes[own], components_[own]
            wanted = (u[:, None] < u[None, :]) & (c[:, None] != c[None, :])
            if crossing:
                wanted |= wanted.T
                wanted &= ~second[own][:, None] & second[own][None, :]
            if not wanted.any():
                continue
            owner = np.repeat(np.arange(n), early_sizes[own])
            smaller = early_keys[early_begins[a] : early_begins[a] + len(owner)]
            below = smaller < key
            found, column, times = np.unique(smaller[below], return_inverse=True, return_counts=True)
            again = times > 1
            if again.any():
                place = np.cumsum(again) - 1
                has = np.zeros((n, int(again.sum())), np.float32)
                kept = again[column]
                has[owner[below][kept], place[column[kept]]] = 1
                wanted &= has @ has.T == 0
            i, j = np.nonzero(wanted)
            may = _could_link(bins[own], elements[own], i, j, percent)
            i, j = i[may], j[may]
            out.append(np.stack([np.minimum(u[i], u[j]), np.maximum(u[i], u[j])]))
        pairs = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])


def group_pairs(state: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: pairs of classes with a common key and different components that may link, out of rows (key, class, component).

    sets has the number of elements and the bins of each class.
    """
    early = state.groupBy("class").agg(F.slice(F.sort_array(F.collect_list("key")), F.lit(1), F.lit(EARLY)).alias("early"))  # signatures of one set
    sizes = state.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1")
    about = sets.select("class", F.size("elements").cast("long").alias("n"), "bins")
    rows = state.select("key", "class", "component").join(early.join(about, "class"), "class").join(sizes, "key", "left")
    rows = rows.withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    # A tile meets itself and each other one: as the first of a pair if its number is smaller.
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("own")).alias("a"), F.greatest(t, F.col("own")).alias("b")))
    met = rows.withColumn("t", F.explode(others))
    member = F.struct("class", "component", (F.col("own") == F.col("t.b")).alias("second"), "early", "n", "bins")
    tiles = met.groupBy("key", "t.a", "t.b").agg(F.collect_list(member).alias("members"))  # two tiles at most
    return tiles.where(F.size("members") > 1).select("key", (F.col("a") != F.col("b")).alias("crossing"), "members").mapInArrow(
        freed(partial(_propose, percent=percent)), "u long, v long"
    )


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "class")


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v, left, right = batch.columns
        ok = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
            both = len(np.intersect1d(a, b, assume_unique=True))
            ok[i] = 100 * both >= percent * (len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays([u, v, pa.array(ok)], ["u", "v", "linked"])


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v, linked of pairs of classes."""
    left = sets.select(F.col("class").alias("u"), F.col("elements").alias("left"))
    right = sets.select(F.col("class").alias("v"), F.col("elements").alias("right"))
    both = pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "left", "right")
    return both.mapInArrow(freed(partial(_compare, percent=percent)), "u long, v long, linked boolean")


def class_links(placed: DataFrame, groups: DataFrame, groups_place: str, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """u, v: links between classes of different sets, enough to connect every component.

    placed has the class of each row, groups (stored at groups_place) the classes that share a signature.
    """
    spark = docs.sparkSession
    members = groups.select("class").distinct()
    one = placed.groupBy("class").agg(F.min("_row").alias("_row")).join(members, "class")
    texts = docs.join(one, "_row").select("class", "text")
    sets = texts.mapInArrow(freed(partial(_elements, size=size)), "class long, elements array<bigint>, hidden long, bins binary")
    sets, sets_place = written(sets.dropDuplicates(["class"]), "candidate-sets")  # a repeated row is there more than once

    # 1. Elements that nobody else has. Two elements with one short key are counted once, so those of one set are added.
    spread = sets.select(F.explode("elements").alias("e"), "class").select(F.col("e").bitwiseAND(F.lit(int(SHORT))).alias("key"), "class")
    shared = _by_key(spread).mapInArrow(freed(_shared_runs), "key long, class long").groupBy("class").agg(F.count("*").alias("shared"))
    alive = sets.select("class", "hidden", F.size("elements").alias("n")).join(shared, "class")
    alive = alive.where(100 * (F.col("shared") + F.col("hidden")) >= percent * F.col("n"))
    alive = tight(stored(alive.select("class")))
    all_sets_place = sets_place
    sets, sets_place = written(sets.join(alive, "class", "left_semi"), "alive-sets")
    discard(spark, all_sets_place)
    groups = groups.join(alive, "class", "left_semi")
    degrees = groups.groupBy("class").agg(F.count("*").alias("degree"))
    groups = tight(stored(groups.join(degrees, "class")))
    discard(spark, groups_place)

    label = alive.select("class", F.col("class").alias("component"))
    done = spark.createDataFrame([], "u long, v long")
    used = alive.limit(0)
    for turn in range(HUB_ROUNDS + 1):
        # Groups whose members are in several components yet, and how many pairs they would make.
        state = groups.join(label, "class")
        split = state.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
        state = tight(stored(state.join(split, "key", "left_semi")))
        if state.isEmpty():
            break
        hub_turn = turn < HUB_ROUNDS
        if hub_turn:
            free = state.join(used, "class", "left_anti")
            hubs = free.groupBy("key").agg(F.max(F.struct("degree", "class", "component")).alias("h"))
            pairs = state.join(hubs, "key").where((F.col("component") != F.col("h.component")) & (F.col("class") != F.col("h.class")))
            pairs = pairs.select(F.least("class", "h.class").alias("u"), F.greatest("class", "h.class").alias("v"))
            used = tight(stored(used.unionByName(hubs.select("h.class")).distinct()))
        else:
            pairs = group_pairs(state, sets, percent)
        pairs = tight(stored(pairs.distinct().join(done, ["u", "v"], "left_anti")))
        judged = tight(stored(compared(pairs, sets, percent)))
        done = done.unionByName(judged.select("u", "v"))
        # New links join components; only these are a graph to be solved.
        ends = [label.select(F.col("class").alias(x), F.col("component").alias(f"{x}c")) for x in "uv"]
        joins = judged.where("linked").join(ends[0], "u").join(ends[1], "v").select(F.col("uc").alias("u"), F.col("vc").alias("v"))
        found = components(joins).withColumnRenamed("component", "joined")
        label = label.join(found, F.col("component") == F.col("node"), "left")
        label = tight(stored(label.select("class", F.coalesce("joined", "component").alias("component"))))
        if not hub_turn:
            break
    discard(spark, sets_place)
    return label.where("class <> component").select(F.col("class").alias("u"), F.col("component").alias("v"))


def with_row(docs: DataFrame) -> DataFrame:
    """Adds _row, a number for the row's id and text; equal rows have the same."""
    return docs.withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def _placed(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, _row, n_shingles and c (the component) of each row with words; doc_id and n_shingles of the others."""
    rows = with_row(id_and_text(docs)).select("doc_id", "_row", "text")
    # The signatures are the bulk: they are only shuffled, never stored, so texts are read once for them and once for classes.
    keys = rows.select("text").mapInArrow(freed(partial(_sign, size=size, percent=percent)), "key long, class long")
    groups, groups_place = written(_by_key(keys).mapInArrow(freed(_shared_runs), "key long, class long"), "signature-groups")
    sets, sets_place = written(rows.mapInArrow(freed(partial(_classes, size=size)), SETS), "classes")
    links = class_links(sets, groups, groups_place, rows.select("_row", "text"), size, percent)
    empty = sets.where("n_shingles = 0").select("doc_id", "n_shingles")
    placed = sets.where("n_shingles > 0").join(links, F.col("class") == F.col("u"), "left")
    placed = stored(placed.select("doc_id", "_row", "n_shingles", F.coalesce("v", "class").alias("c")))
    empty = stored(empty)
    discard(docs.sparkSession, sets_place)
    return placed, empty


def row_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, _row (see ``with_row``) and component of each row that has words."""
    return _placed(docs, size, percent)[0].select("doc_id", "_row", F.col("c").alias("component"))


def similarity_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each row."""
    placed, empty = _placed(docs, size, percent)
    empty = empty.withColumn("component_id", F.col("doc_id"))
    first = placed.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return placed.join(first, "c").select("doc_id", "n_shingles", "component_id").unionByName(empty)
