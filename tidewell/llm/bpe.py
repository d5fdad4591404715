"""Byte pair encoding and decoding with a pair occurrence index (operator 2).

All words that a block of texts needs lie one after another in one symbol array. An index maps each adjacent pair that
the vocabulary can merge to all its positions. The active ranks are applied in ascending order, each at all its
positions at once; a merge changes only the pairs to its left and right, which go to the lists of their own ranks.
Because a pair can only appear after the merges that make its parts, a word gets the same merges as if it were encoded
alone.

Rows: a null text is empty; an empty text has no ids and decodes to "". Repeated rows give repeated results, further
columns are not read, an empty table gives no rows. Texts of any length are encoded whole.

A vocabulary file is read once per Python worker; it must be on every machine, like any installed package.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewell.llm.chunks import ChunkEncoder
from tidewell.llm.common import id_and_text

#: How byte-level vocabularies of this family split a text when the file names no pattern (fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it is printable in Latin-1, else the next one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file of the kind BPE says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError("only plain byte-level BPE vocabularies can be read")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {**model["vocab"], **self.added}
        self.size = max(self.ids.values()) + 1
        steps = json.dumps(spec["normalizer"])
        self.compose, self.fold_case = '"NFC"' in steps, '"Lowercase"' in steps
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"] if splits else BYTE_LEVEL_PATTERN)
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = [self.ids[c] for c in letters]
        self.last = [self.ids[c + suffix] for c in letters]
        self.base = self.size + 1  # pairs are numbers in this base; `size` itself separates words
        self.ranks: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.ranks.setdefault(left * self.base + right, len(self.merges))
            self.merges.append((left, right, whole))
        self.byte_decoder = spec["decoder"] is not None
        values = {c: bytes([b]) for b, c in enumerate(letters)}
        tokens = [b""] * self.size
        for token, i in self.ids.items():
            plain = token.encode()
            tokens[i] = b"".join(values[c] for c in token) if self.byte_decoder and token not in self.added else plain
        self.tokens = tokens

    def decode(self, ids: np.ndarray) -> str:
        """Special tokens stay. Without a decoder in the file, tokens are joined by spaces."""
        glue = b"" if self.byte_decoder else b" "
        return glue.join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def merged(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """The ids of each word: every pair's positions by rank, ranks applied in ascending order."""
    base, gap, rank_of, merges = vocabulary.base, vocabulary.size, vocabulary.ranks.get, vocabulary.merges
    inner, last = vocabulary.inner, vocabulary.last
    symbols = [gap]
    firsts = []
    for word in words:
        firsts.append(len(symbols))
        symbols += map(inner.__getitem__, word[:-1])
        symbols.append(last[word[-1]])
        symbols.append(gap)
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))

    index: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)):
        rank = rank_of(a * base + b)
        if rank is not None:
            if rank in index:
                index[rank].append(i)
            else:
                index[rank] = [i]
    active = list(index)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        left, right, whole = merges[rank]
        positions = index.pop(rank)
        positions.sort()
        for i in positions:
            j = after[i]
            if symbols[i] != left or symbols[j] != right:
                continue  # an earlier merge took one of the two
            symbols[i], symbols[j] = whole, -1
            k = after[i] = after[j]
            before[k] = i
            h = before[i]
            for at, pair in ((h, symbols[h] * base + whole), (i, whole * base + symbols[k])):
                new = rank_of(pair)
                if new is not None:
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        heapq.heappush(active, new)
    out = []
    for i in firsts:
        ids = []
        while symbols[i] != gap:
            ids.append(symbols[i])
            i = after[i]
        out.append(ids)
    return out


class PairIndexWords:
    """Ids of strings; distinct words of one call are merged together."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def _words(self, text: str) -> list[str]:
        if self.vocabulary.compose and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.vocabulary.fold_case:
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return self.vocabulary.pattern.findall(text)

    def __call__(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        added = self.vocabulary.added
        plan, seen = [], {}
        for string in strings:
            parts: list[str | int] = []
            for piece in self.added.split(string) if self.added and self.added.search(string) else (string,):
                if piece in added:
                    parts.append(added[piece])
                elif piece:
                    parts += self._words(piece)
            plan.append(parts)
            for part in parts:
                if isinstance(part, str):
                    seen.setdefault(part, len(seen))
        done = merged([w.encode() for w in seen], self.vocabulary)
        flat, lengths = [], np.empty(len(strings), np.int64)
        for n, parts in enumerate(plan):
            size = len(flat)
            for part in parts:
                if isinstance(part, str):
                    flat += done[seen[part]]
                else:
                    flat.append(part)
            lengths[n] = len(flat) - size
        return np.array(flat, np.uint32), lengths


_encoders: dict[str, tuple[ChunkEncoder, Vocabulary]] = {}


def encoder(path: str) -> tuple[ChunkEncoder, Vocabulary]:
    if path not in _encoders:
        words = PairIndexWords(path)
        vocabulary = words.vocabulary
        _encoders[path] = ChunkEncoder(words, list(vocabulary.added), vocabulary.fold_case), vocabulary
    return _encoders[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode, _ = encoder(path)
    for batch in batches:
        ids, offsets = encode.encode(batch.column(1))
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every document (doc_id, text)."""
    return id_and_text(docs).mapInArrow(partial(_encode, path=path), "doc_id long, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    _, vocabulary = encoder(path)
    for batch in batches:
        texts = []
        for ids in batch.column(1):
            texts.append(None if ids.values is None else vocabulary.decode(ids.values.to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); null ids give a null text."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, path=path), "doc_id long, text string")


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode, vocabulary = encoder(path)
    for batch in batches:
        ids, offsets = encode.encode(batch.column(1))
        coded, decoded = [], []
        for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = ids[first:last]
            coded.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
            decoded.append(hashlib.sha256(vocabulary.decode(own).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets)), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every document in one pass and keep digests of both instead of the ids and the text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return id_and_text(docs).mapInArrow(partial(_digest, path=path), schema)
