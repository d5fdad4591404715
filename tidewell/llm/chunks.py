"""Token ids of many texts, each distinct chunk of text encoded once.

Both vocabularies split a text by a pattern before they merge pairs, so ids never depend on what stands across a split.
Texts are cut only where such a split is certain, for every pattern of this kind:

- before white space that follows something else;
- between ASCII letters, digits or Latin-1 letters on one side and other visible ASCII on the other, apart from
  apostrophes, which may start a contraction.

Chunks are found and hashed with array operations, and only chunks that the worker has not met yet are encoded. What
is kept is bounded by ``limit``; beyond it the store starts anew. Texts that hold a special token's string are handed
to the encoder whole. Two chunks share a hash of 64 bits with a chance of about 2**-57.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from tidewell.llm.common import ranges, row_blocks, text_buffers

BLOCK_BYTES = 4_000_000
LONGEST = 64  # bytes of a chunk that is kept; longer ones are encoded each time

WORD, MARK, SPACE, APOSTROPHE, OTHER, OPAQUE = range(6)


def _classes() -> np.ndarray:
    kinds = np.full(256, OPAQUE, np.uint8)
    kinds[0x21:0x7F] = MARK
    for first, last in (("0", "9"), ("A", "Z"), ("a", "z")):
        kinds[ord(first) : ord(last) + 1] = WORD
    kinds[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = SPACE
    kinds[0x27] = APOSTROPHE
    kinds[0xC3:0xF5] = OTHER  # leads of characters that are no white space
    kinds[[0xE1, 0xE2, 0xE3]] = OPAQUE  # some of theirs are
    return kinds


KINDS = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
FACTORS = np.random.default_rng(20240131).integers(1, 2**64, LONGEST, np.uint64, endpoint=False) | np.uint64(1)


def _starts(data: np.ndarray, rows: np.ndarray, fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes (in lower case if asked for) and the first byte of each chunk."""
    kinds = KINDS[data]
    if len(data) and data.max() >= 0x80:
        latin = np.flatnonzero(data[:-1] == 0xC3)
        second = data[latin + 1]
        kinds[latin], kinds[latin + 1] = WORD, WORD
        signs = latin[(second == 0x97) | (second == 0xB7)]  # these two are no letters
        kinds[signs], kinds[signs + 1] = OPAQUE, OPAQUE
        latin_second = np.zeros(len(data), bool)
        latin_second[latin + 1] = True
        rest = (data & 0xC0 == 0x80) & ~latin_second
        if rest.any():
            for _ in range(3):
                at = np.flatnonzero(rest[1:]) + 1
                kinds[at] = kinds[at - 1]
        if fold_case:
            data = LOWER[data]
            upper = latin[(second < 0x9F) & (second != 0x97)] + 1
            data[upper] += 0x20
    elif fold_case:
        data = LOWER[data]
    before, here = kinds[:-1], kinds[1:]
    cut = (here == SPACE) & (before != SPACE) & (before != OPAQUE)
    cut |= ((before == WORD) & (here == MARK)) | ((before == MARK) & (here == WORD))
    first = np.zeros(len(data), bool)
    first[1:] = cut
    first[rows[:-1][rows[:-1] < rows[1:]]] = True
    return data, np.flatnonzero(first)


class ChunkEncoder:
    """encode(texts) -> ids (uint32) and offsets by text.

    encode_words gives the ids of each of many strings; special holds strings that have ids of their own.
    """

    def __init__(
        self,
        encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
        special: list[str],
        fold_case: bool,
        limit: int = 3_000_000,
    ):
        self.encode_words, self.special, self.fold_case, self.limit = encode_words, special, fold_case, limit
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int32)
        self.bounds = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.used = 0

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Append the ids of new chunks to the pool; their slots."""
        if self.used + len(ids) > len(self.pool):
            grown = np.empty(max(2 * len(self.pool), self.used + len(ids), 1 << 16), np.uint32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(ids)] = ids
        first = len(self.bounds) - 1
        self.bounds = np.concatenate([self.bounds, self.used + np.cumsum(lengths)])
        self.used += len(ids)
        return np.arange(first, first + len(lengths), dtype=np.int32)

    def _block(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, starts = _starts(data, rows, self.fold_case)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(rows) - 1, np.int64)
        if len(self.hashes) > self.limit:
            self._forget()
        ends = np.append(starts[1:], len(data))
        sizes = ends - starts
        place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, sizes)
        with np.errstate(over="ignore"):
            terms = (data.astype(np.uint64) + np.uint64(1)) * FACTORS[np.minimum(place, LONGEST - 1)]
            hashes = np.add.reduceat(terms, starts)
        del terms, place
        long = np.flatnonzero(sizes > LONGEST)
        for i in long:
            hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
        distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        slots = np.empty(len(distinct), np.int32)
        slots[known] = self.slots[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)]
            ids, lengths = self.encode_words(words)
            slots[new] = self._add(ids, lengths)
            short = new[sizes[one[new]] <= LONGEST]
            order = np.searchsorted(self.hashes, distinct[short])
            self.hashes = np.insert(self.hashes, order, distinct[short])
            self.slots = np.insert(self.slots, order, slots[short])
        slot = slots[which]
        lengths = self.bounds[slot + 1] - self.bounds[slot]
        ids = self.pool[ranges(self.bounds[slot], lengths)]
        ends_by_chunk = np.append(0, np.cumsum(lengths))
        by_row = np.diff(ends_by_chunk[np.searchsorted(starts, rows)])
        if len(long):
            self._drop_unkept(new, sizes[one[new]] <= LONGEST)
        return ids, by_row

    def _drop_unkept(self, new: np.ndarray, kept: np.ndarray) -> None:
        """Long chunks were only needed for this block; if they fill the pool, start anew."""
        if self.used > 16 * self.limit:
            self._forget()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        whole = np.zeros(len(texts), bool)
        for word in self.special:
            whole |= pc.fill_null(pc.match_substring(texts, word), False).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", pc.fill_null(texts, "")) if whole.any() else texts
        data, rows = text_buffers(plain)
        ids, lengths = [], []
        for first, last in row_blocks(rows, BLOCK_BYTES):
            got, by_row = self._block(data[rows[first] : rows[last]], rows[first : last + 1] - rows[first])
            ids.append(got)
            lengths.append(by_row)
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        if whole.any():
            at = np.flatnonzero(whole)
            more, sizes = self.encode_words(texts.take(pa.array(at)).to_pylist())
            ends = np.append(0, np.cumsum(sizes))
            where = np.append(0, np.cumsum(lengths))[at]
            lengths[at] = sizes
            pieces, done = [], 0
            for i, w in enumerate(where):
                pieces += [ids[done:w], more[ends[i] : ends[i + 1]]]
                done = w
            ids = np.concatenate([*pieces, ids[done:]])
        return ids, np.append(0, np.cumsum(lengths))


class LibraryWords:
    """Ids of strings from the tokenizers library, without special tokens added, truncation or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], np.empty(len(words), np.int64)
        for first in range(0, len(words), 20_000):
            part = [x.ids for x in self.tokenizer.encode_batch_fast(words[first : first + 20_000], add_special_tokens=False)]
            lengths[first : first + len(part)] = [len(x) for x in part]
            ids.append(np.fromiter((i for x in part for i in x), np.uint32))
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), lengths

    def special(self) -> list[str]:
        return [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]


def _folds_case(path: str) -> bool:
    import json

    with open(path, encoding="utf-8") as f:
        return "Lowercase" in json.dumps(json.load(f)["normalizer"])


_encoders: dict[str, ChunkEncoder] = {}


def library_encoder(path: str) -> ChunkEncoder:
    """One encoder for each vocabulary file and Python worker; workers are used for many tasks."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        words = LibraryWords(path)
        _encoders[path] = ChunkEncoder(words, words.special(), _folds_case(path))
    return _encoders[path]
