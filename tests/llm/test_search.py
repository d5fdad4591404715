"""Operators 3, 4 and 6."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewell.llm import exact_topk, fingerprints, language_id, queries


def test_entropy_of_windows():
    data = np.random.default_rng(0).integers(97, 105, 400).astype(np.uint8)
    terms = fingerprints.TERMS
    want = [(terms[64] - sum(terms[n] for n in Counter(data[i : i + 64].tolist()).values())) * 1000 // terms[64] for i in range(337)]
    assert fingerprints.entropies(data).tolist() == want


def check_edits(found, docs):
    docs = sorted(docs, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    want = []
    for i, (doc, text) in enumerate(docs):
        text, other = text or "", docs[(i + 1) % len(docs)][1] or ""
        k = len(text) // 3
        want.append((doc, len(text), hashlib.sha256((text[: len(text) - k] + other[:k]).encode()).hexdigest()))
    assert Counter((x.doc_id, x.n_chars, x.edited_sha256) for x in found) == Counter(want)
    assert all(0 <= v <= 1 for x in found for v in (x.near_edited, x.near_next))


def test_fingerprints(spark, documents, odd, none, sf_dir):
    found = queries.op3_fingerprints(spark, sf_dir).collect()
    rows = documents.select("doc_id", "text").collect()
    check_edits(found, rows)
    by_text, by_print = {}, {x.doc_id: x.fingerprint for x in found}
    for doc, text in rows:
        assert by_text.setdefault(text, by_print[doc]) == by_print[doc]
    near = sum(x.near_edited for x in found) / len(found)
    assert near > 0.4 and sum(x.near_edited > x.near_next for x in found) > 0.95 * len(found)
    check_edits(fingerprints.compare_with_edits(odd).collect(), odd.select("doc_id", "text").collect())
    assert fingerprints.compare_with_edits(none).count() == 0
    ranks = fingerprints.rarity(documents)
    text = next(t for _, t in rows if len(t) > 3000)
    chains = list(fingerprints.chains(pa.array([text, text, ""]), ranks))
    assert fingerprints.likeness(chains[0], chains[1]) == 1 and fingerprints.likeness(chains[0], chains[2]) == 0
    back = fingerprints.chains_of(fingerprints.text_of(chains[0]))
    assert all((a == b).all() for a, b in zip(back, chains[0]))


def test_languages(spark, documents, odd, none, sf_dir):
    found = queries.op4_language_id(spark, sf_dir).collect()
    truth = dict(documents.select("doc_id", "lang").collect())
    assert len(found) == len(truth)
    held = [x for x in found if x.held_out]
    assert {x.doc_id for x in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.9 * len(held)
    got = {x.doc_id: x for x in language_id.identify(odd).collect()}
    assert {d for d, x in got.items() if x.lang_pred == "und"} == {2, 3, 4, 7} and got[2].score == 0
    assert language_id.identify(none).count() == 0
    unlabelled = language_id.predict(odd.select("doc_id", "text"), language_id.train(odd.where("lang = 'xx'")))
    assert {x.lang_pred for x in unlabelled.collect()} == {"und"}


def test_labels_of_held_out_documents_are_not_learned(spark):
    ids = range(200)
    rows = [(i, "aaa bbb aaa" if i % 2 else "ccc ddd ccc", "odd" if i % 2 else "even") for i in ids]
    wrong = [(i, t, "wrong" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    found = language_id.identify(spark.createDataFrame(wrong, "doc_id long, text string, lang string")).collect()
    assert all(x.lang_pred == ("odd" if x.doc_id % 2 else "even") for x in found)


def brute_top(rows, is_query, k):
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in usable if is_query(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(50)]
    rows += [(10, None), (20, []), (30, [1.0, None, 1.0, 1.0]), (40, [1.0, float("nan"), 0.0, 0.0]), (50, [float("inf")] * 4), (None, [1.0] * 4)]
    rows += [(600, [1.0, 2.0]), (601, [3.0, 4.0]), (602, [5.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, lane int, group string").repartition(3)
    found = exact_topk.top_k(frame, F.col("vec_id") % 10 == 0, 5).collect()
    assert sorted(map(tuple, found)) == brute_top(rows, lambda i: i % 10 == 0, 5)
    assert exact_topk.top_k(frame.limit(0), F.col("vec_id") % 10 == 0, 5).count() == 0


def test_bounds_spare_work():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (20, 8))
    vectors = (np.repeat(centres, 100, 0) + rng.integers(-20, 20, (2000, 8))).astype(np.int64)
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True) * 3000).astype(np.int64)
    far = np.sqrt(exact_topk._squares(vectors.astype(float), vectors[::100].astype(float)))
    best = exact_topk._Best(10, 5)
    ids = np.arange(2000)
    done = exact_topk.search_block(ids[:10], vectors[:10], far[:10], ids, vectors, far, best)
    scores = vectors[:10] @ vectors.T
    scores[np.arange(10), np.arange(10)] = -(10**15)
    assert done < 0.5 * 10 * 2000
    assert (best.scores == -np.sort(-scores, axis=1)[:, :5]).all()
