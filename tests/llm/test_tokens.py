"""Operators 1, 2 and 7 against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from brute import sha
from tidewell.llm import bpe, chunks, packing, queries, token_shards
from tidewell.session import run_dir

ALPHABET = [*"ab cd  eE'tsT.,!\n\t 12<|>-_", "é", "É", "×", "ß", "́", " ", "　", "я", "中", "İ", "Σ", "\x1c", "\x00", "😀"]
ALPHABET += ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "  ", "word"]


def texts():
    rng = random.Random(11)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return [*made, None, "", "a" * 300, " " * 200, "é" * 90, "long word " * 3000]


@pytest.mark.parametrize("path", [queries.WORD_BPE, queries.BYTE_BPE])
@pytest.mark.parametrize("kind", ["library", "pair index"])
def test_ids_and_decoding(path, kind):
    library = Tokenizer.from_file(path)
    encoder = chunks.library_encoder(path) if kind == "library" else bpe.encoder(path)[0]
    vocabulary = bpe.encoder(path)[1]
    for _ in range(2):  # the second time from what is kept
        ids, offsets = encoder.encode(pa.array(texts()))
        for i, text in enumerate(texts()):
            own = ids[offsets[i] : offsets[i + 1]]
            assert own.tolist() == library.encode(text or "", add_special_tokens=False).ids
            assert vocabulary.decode(own) == library.decode(own.tolist(), skip_special_tokens=False)


def test_store_of_chunks_starts_anew():
    small = chunks.ChunkEncoder(chunks.LibraryWords(queries.WORD_BPE), [], True, limit=3)
    library = Tokenizer.from_file(queries.WORD_BPE)
    for text in ("a b c d e f", "g h", "a b z", "x" * 100):
        assert small.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_perfect_hash():
    keys = token_shards.key_hash(np.arange(5000), np.zeros(5000, bool), np.zeros(5000, np.int64))
    index = token_shards.PerfectHash.build(keys)
    assert sorted(index.slots(keys)) == list(range(5000))
    with pytest.raises(ValueError):
        token_shards.PerfectHash.build(np.zeros(2, np.uint64))


def expected(docs, path):
    library = Tokenizer.from_file(path)
    return [(d, library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in docs]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards(spark, documents, sf_dir):
    start, want = 0, []
    for doc, ids in expected(sorted(documents.select("doc_id", "text").collect()), queries.WORD_BPE):
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, queries.op1_token_shards(spark, sf_dir).collect())) == want


def test_shards_of_odd_rows(spark, odd, none):
    folder = run_dir(spark, "odd-shards")
    keys = token_shards.write_shards(odd, folder, queries.WORD_BPE, 1)
    found = token_shards.read_documents(spark, folder, keys).collect()
    assert Counter(x.n_tokens for x in found) == Counter(len(i) for _, i in expected(odd.select("doc_id", "text").collect(), queries.WORD_BPE))
    by_start = sorted(found, key=lambda x: x.start)
    assert by_start[0].doc_id is None and [x.occurrence for x in by_start if x.doc_id == 1] == [0, 1]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(by_start, by_start[1:]))
    lost = spark.createDataFrame([(0, 99, 0)], "shard int, doc_id long, occurrence long")
    assert token_shards.read_documents(spark, folder, lost).first().n_tokens is None
    folder = run_dir(spark, "no-shards")
    assert token_shards.read_documents(spark, folder, token_shards.write_shards(none, folder, queries.WORD_BPE, 1)).count() == 0


def test_round_trip(spark, documents, odd, none, sf_dir):
    library = Tokenizer.from_file(queries.WORD_BPE)
    for docs, found in ((documents, queries.op2_bpe_round_trip(spark, sf_dir)), (odd, bpe.digest_documents(odd, queries.WORD_BPE))):
        want = []
        for doc, text in docs.select("doc_id", "text").collect():
            ids = library.encode(text or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want.append((doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded)))
        assert Counter(map(tuple, found.collect())) == Counter(want)
    encoded = bpe.encode_documents(odd, queries.WORD_BPE)
    assert bpe.decode_documents(encoded, queries.WORD_BPE).count() == odd.count()
    assert bpe.digest_documents(none, queries.WORD_BPE).count() == 0


def test_patterns_hold_the_histogram():
    rng = random.Random(3)
    for _ in range(100):
        most = rng.choice([4, 16, 64])
        histogram = {rng.randint(1, most): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        placed = Counter()
        for count, lengths in packing.place_lengths(histogram, most):
            assert count > 0 and sum(lengths) <= most
            for length in lengths:
                placed[length] += count
        assert placed == histogram


def test_hot_lengths_share_packs():
    many = dict.fromkeys(range(20, 2049), 40)
    cases = [
        ({300: 100_000}, 16_667),  # six fit into each
        ({2048: 5000, 300: 30_000, 120: 100}, 10_000),
        (many | {60: 40_000}, 42_200),
        (many | {1: 40_000}, 41_000),
        ({1: 50_000, 700: 100_000}, 50_000),
    ]
    for histogram, enough in cases:
        placed, packs = Counter(), 0
        for count, lengths in packing.place_lengths(histogram, 2048):
            assert sum(lengths) <= 2048
            packs += count
            for length in lengths:
                placed[length] += count
        assert placed == histogram and packs <= enough


def test_packing_of_copies_and_empty_texts(spark):
    docs = [(i, None if i % 3 == 0 else "one two three four five six" if i % 3 == 1 else "word " * (i % 40)) for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert check_packing(packing.pack(frame, queries.BYTE_BPE, 1, 64).collect(), docs, 64) < 0.05


def check_packing(packed, docs, most):
    ids = expected(docs, queries.BYTE_BPE)
    assert Counter((x.doc_id, x.doc_tokens, x.length, x.start, x.ids_crc32) for x in packed) == Counter(
        (doc, len(i), len(i[a : a + most]), a, crc(i[a : a + most])) for doc, i in ids for a in range(0, len(i), most)
    )
    places = {}
    for x in packed:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= most
    return 1 - sum(len(i) for _, i in ids) / (len(places) * most) if places else 0


def test_packing(spark, documents, odd, none, sf_dir):
    assert check_packing(queries.op7_packing(spark, sf_dir).collect(), documents.select("doc_id", "text").collect(), 2048) < 0.02
    packed = packing.pack(odd, queries.BYTE_BPE, 1, 64, with_ids=True)
    check_packing(packed.collect(), odd.select("doc_id", "text").collect(), 64)
    assert sum(len(x.ids) for x in packing.sequences(packed).collect()) == sum(x.length for x in packed.collect())
    assert packing.pack(none, queries.BYTE_BPE, 1, 64).count() == 0
