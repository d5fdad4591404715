"""Token ids of a corpus as raw binary shards with a minimal perfect hash index (operator 1).

A set of shards is a folder:

- ``shard-00007.bin``: nothing but the ids of the shard's documents one after another, little-endian, 2 bytes each if
  the vocabulary allows it and else 4, so that a trainer can map it into memory;
- ``shard-00007.idx``: the index of the shard, built by repeated hashing: each level is a bit array in which a key owns
  its bit if no other key of that level hit it, keys that met go on to the next level. The number of bits set before a
  key's own bit is its slot, without gaps. A slot holds a 32-bit fingerprint of its key, the offset of its first id in
  the shard and the number of ids;
- ``manifest``: a small Parquet table with, by shard, its file, number of documents and ids, first id in the whole
  corpus, and width.

A key is (doc_id, occurrence): repeated rows are all kept, numbered from 0. A null doc_id is a key like any other and
comes first. Null and empty texts have only the end id. An empty table gives no shard and an empty manifest.

Shards are ranges of doc_id, each written by one task under a temporary name and then renamed, so a task that runs
twice leaves one file with the same bytes. Only one row per shard goes to the driver.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.chunks import library_encoder
from tidewell.llm.common import id_and_text, mixed, ranges

MAGIC = b"TWSHARD1"
GAMMA = 2.0  # bits of a level for each key that is left
LEVELS = 64
BUFFER_IDS = 4_000_000

KEYS = "shard int, doc_id long, occurrence long"
FOUND = "doc_id long, occurrence long, start long, n_tokens long, ids_crc32 long"


# -- index ------------------------------------------------------------------------------------------------------------
def key_hash(doc_ids: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        base = mixed(doc_ids.astype(np.int64).view(np.uint64))
        extra = occurrence.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + null.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return base ^ extra


def _spot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mixed(keys ^ np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(bits)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(~keys) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: a list of bit arrays."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        before = 0
        for bits in levels:
            counts = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(before + counts - bits)
            before += int(counts[-1])
        self.size = before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            bits = max(64, int(GAMMA * len(left)))
            spots = _spot(left, len(levels), bits)
            alone = np.bincount(spots, minlength=bits) == 1
            levels.append(alone)
            left = left[~alone[spots]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that certainly are not in the set."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            spots = _spot(keys[left], level, len(bits))
            hit = bits[spots]
            out[left[hit]] = self.ranks[level][spots[hit]]
            left = left[~hit]
        return out


def index_bytes(keys: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    index = PerfectHash.build(keys)
    slots = index.slots(keys)
    prints, starts, sizes = np.empty(len(keys), "<u4"), np.empty(len(keys), "<u8"), np.empty(len(keys), "<u4")
    prints[slots], starts[slots], sizes[slots] = fingerprints(keys), offsets, lengths
    head = struct.pack("<8sIIQ", MAGIC, width, len(index.levels), len(keys))
    sizes_of_levels = np.array([len(x) for x in index.levels], "<u8").tobytes()
    return b"".join([head, sizes_of_levels, *(np.packbits(x).tobytes() for x in index.levels), prints.tobytes(), starts.tobytes(), sizes.tobytes()])


class Shard:
    """One shard, opened for keyed reads."""

    def __init__(self, folder: str, name: str):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.payload = self.store.open_input_file(posixpath.join(root, f"{name}.bin"))
        with self.store.open_input_file(posixpath.join(root, f"{name}.idx")) as f:
            raw = f.read()
        magic, self.width, n_levels, n = struct.unpack_from("<8sIIQ", raw)
        if magic != MAGIC:
            raise ValueError(f"{name}.idx is no index of token shards")
        at = struct.calcsize("<8sIIQ")
        bits = np.frombuffer(raw, "<u8", n_levels, at)
        at += 8 * n_levels
        levels = []
        for size in bits.tolist():
            used = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, used, at), count=size).astype(bool))
            at += used
        self.hash = PerfectHash(levels)
        self.prints = np.frombuffer(raw, "<u4", n, at)
        self.starts = np.frombuffer(raw, "<u8", n, at + 4 * n)
        self.sizes = np.frombuffer(raw, "<u4", n, at + 12 * n)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and number of ids of each key; both are -1 for a key that is not here."""
        slots = self.hash.slots(keys)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == fingerprints(keys[known])
        starts, sizes = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        starts[known], sizes[known] = self.starts[slots[known]], self.sizes[slots[known]]
        return starts, sizes

    def ids(self, start: int, size: int) -> np.ndarray:
        self.payload.seek(start * self.width)
        return np.frombuffer(self.payload.read(size * self.width), f"<u{self.width}")


# -- writing ----------------------------------------------------------------------------------------------------------
def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    encoder = library_encoder(tokenizer)
    shard = TaskContext.get().partitionId()
    store, root = fs.FileSystem.from_uri(folder)
    name, mark = f"shard-{shard:05d}", uuid.uuid4().hex
    out, docs, nulls, sizes = None, [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        if out is None:
            out = store.open_output_stream(posixpath.join(root, f"{name}.{mark}.bin"))
        ids, offsets = encoder.encode(batch.column(1))
        lengths = np.diff(offsets) + 1
        ends = np.cumsum(lengths)
        all_ids = np.empty(int(ends[-1]), f"<u{width}")
        all_ids[ends - 1] = end_id
        all_ids[ranges(ends - lengths, lengths - 1)] = ids
        out.write(all_ids.tobytes())
        docs.append(np.asarray(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.int64))
        nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
        sizes.append(lengths)
    if out is None:
        return
    out.close()
    docs, nulls, sizes = np.concatenate(docs), np.concatenate(nulls), np.concatenate(sizes)
    same = np.append(False, (docs[1:] == docs[:-1]) & (nulls[1:] == nulls[:-1]))
    place = np.arange(len(docs))
    occurrence = place - np.maximum.accumulate(np.where(same, 0, place))
    raw = index_bytes(key_hash(docs, nulls, occurrence), np.cumsum(sizes) - sizes, sizes, width)
    with store.open_output_stream(posixpath.join(root, f"{name}.{mark}.idx")) as f:
        f.write(raw)
    for kind in ("bin", "idx"):
        store.move(posixpath.join(root, f"{name}.{mark}.{kind}"), posixpath.join(root, f"{name}.{kind}"))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(docs), shard, np.int32)), pa.array(docs, mask=nulls), pa.array(occurrence), pa.array(sizes)],
        ["shard", "doc_id", "occurrence", "n_tokens"],
    )


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode documents (doc_id, text) into shards below ``folder`` in ascending doc_id order (equal ids by text).

    Returns the written keys: shard, doc_id, occurrence, n_tokens.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        model = json.load(f)
    largest = max([end_id, *model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])])
    width = 2 if largest < 2**16 else 4
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    write = partial(_write_shard, folder=folder, tokenizer=tokenizer, end_id=end_id, width=width)
    ranged = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    keys = ranged.mapInArrow(write, KEYS + ", n_tokens long")
    keys.write.parquet(f"{folder}/keys")
    keys = spark.read.schema(KEYS + ", n_tokens long").parquet(f"{folder}/keys")
    totals = keys.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).orderBy("shard")
    rows, before = [], 0
    for r in totals.collect():  # one row per shard
        rows.append((r.shard, f"shard-{r.shard:05d}", r.n_docs, r.n_tokens, before, width))
        before += r.n_tokens
    schema = "shard int, name string, n_docs long, n_tokens long, first_id long, width int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/manifest")
    return keys


# -- reading ----------------------------------------------------------------------------------------------------------
def _read_keys(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    shard, name = None, None
    for batch in batches:
        names = batch.column(0).to_numpy(zero_copy_only=False)
        first_ids = batch.column(1).to_numpy()
        doc_ids, occurrence = batch.column(2), batch.column(3).to_numpy()
        keys = key_hash(doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False), occurrence)
        starts, sizes = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        crcs = np.zeros(len(names), np.int64)
        for own in dict.fromkeys(names.tolist()):
            if own != name:
                shard, name = Shard(folder, own), own
            rows = np.flatnonzero(names == own)
            starts[rows], sizes[rows] = shard.find(keys[rows])
            rows = rows[sizes[rows] >= 0]
            rows = rows[np.argsort(starts[rows], kind="stable")]
            for part in _runs(rows, starts, sizes):
                first = int(starts[part[0]])
                ids = shard.ids(first, int(starts[part[-1]] + sizes[part[-1]]) - first).astype("<u4")
                for i, s, n in zip(part.tolist(), (starts[part] - first).tolist(), sizes[part].tolist(), strict=True):
                    crcs[i] = zlib.crc32(ids[s : s + n])
        lost = sizes < 0
        yield pa.RecordBatch.from_arrays(
            [doc_ids, batch.column(3), pa.array(first_ids + starts, mask=lost), pa.array(sizes, mask=lost), pa.array(crcs, mask=lost)],
            ["doc_id", "occurrence", "start", "n_tokens", "ids_crc32"],
        )


def _runs(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in order of their place, split where one read would grow beyond the buffer."""
    first = 0
    while first < len(rows):
        last = first + 1
        while last < len(rows) and starts[rows[last]] + sizes[rows[last]] - starts[rows[first]] <= BUFFER_IDS:
            last += 1
        yield rows[first:last]
        first = last


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Look up keys (shard, doc_id, occurrence) through the index and read their ids from the payload files.

    Returns doc_id, occurrence, start (ids of all documents before it), n_tokens, ids_crc32; nulls for a key that no
    index knows.
    """
    shards = manifest(spark, folder).select("shard", "name", "first_id")  # one row per shard
    wanted = keys.select("shard", "doc_id", "occurrence").join(F.broadcast(shards), "shard")
    wanted = wanted.select("name", "first_id", "doc_id", "occurrence")
    return wanted.mapInArrow(partial(_read_keys, folder=folder), FOUND)
