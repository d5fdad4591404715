"""Operators 11, 12 and 13."""

import hashlib
import zlib
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import hard_negatives, neighbour_graph, periodic_runs, queries


def vectors(seed):
    """Single vectors, pairs, groups of near copies around the threshold, a large tight group, copies, odd rows."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=12) for _ in range(300)]
    for spread, size in ((0.02, 2), (0.1, 5), (0.25, 12), (0.45, 60), (0.06, 150), (0.3, 40)):
        centre = rng.normal(size=12)
        out += [centre / np.linalg.norm(centre) + spread * rng.normal(size=12) / np.sqrt(12) for _ in range(size)]
    out += [out[-1]] * 40 + [out[0]] * 3 + [2 * out[1], 1e200 * out[1]]
    ids = rng.permutation(len(out)).tolist()
    rows = [(i, v.tolist(), 5 if j % 9 else 6) for j, (i, v) in enumerate(zip(ids, out, strict=True))]
    rows += [(2000, rows[0][1], None), (2001, None, 5), (2002, [], 5), (2003, [0.0] * 12, 5), (2004, [float("nan")] * 12, 5)]
    rows += [(2005, [None] * 12, 5), (2006, [1.0, 2.0], 5), (2007, [2.0, 4.0], 5), (None, rows[0][1], 5), rows[3], rows[3]]
    return rows


def linked(rows, threshold):
    """vec_id, links, component of each row, by comparing all pairs."""
    use = [
        i is not None and label is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, label in rows
    ]
    units = [np.array(v) / np.max(np.abs(v)) if u else None for (_, v, _), u in zip(rows, use, strict=True)]
    units = [None if x is None else x / np.linalg.norm(x) for x in units]
    near = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if use[a] and use[b] and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                near[a].append(b)
                near[b].append(a)
    out = []
    for a, (i, _, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            new = [b for b in near[todo.pop()] if b not in seen]
            seen.update(new)
            todo += new
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((i, len(near[a]), least, i == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_all_pairs(spark, seed):
    rows = vectors(seed)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, node int, u string")
    found = sorted(map(tuple, neighbour_graph.near_duplicates(frame.repartition(3)).collect()), key=str)
    want = linked(rows, 0.93)
    links = sum(w[1] for w in want)
    assert len(found) == len(want) and all(f[1] <= w[1] for f, w in zip(found, want, strict=True))
    assert sum(f[1] for f in found) >= 0.99 * links > 20_000
    assert sum(f == w for f, w in zip(found, want, strict=True)) >= 0.99 * len(want)


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert neighbour_graph.near_duplicates(none).count() == 0
    one = spark.createDataFrame([(4, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert list(map(tuple, neighbour_graph.near_duplicates(one).collect())) == [(4, 0, 4, True)]


def test_cores_are_counted_not_paired(spark):
    """A tight group of n vectors makes a core: its links are in the counts, and the edges stay a multiple of n."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.05 * rng.normal(size=16)).tolist(), 1) for i in range(400)] + [(400 + i, rng.normal(size=16).tolist(), 1) for i in range(400)]
    found = {r.vec_id: r for r in neighbour_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(found[i].n_links == 399 and found[i].component_id == 0 for i in range(400))


def brute_runs(words, shortest=24, times=3):
    """(start, length, period) by trying every period at every place."""
    seen = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(shortest, times * p):
                seen.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in seen.items())


def brute_report(doc, text):
    words = brute.WORD.findall(text or "")
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return doc, len(found), *best, digest("".join("%d,%d,%d\n" % r for r in found)), digest(kept)


def columns(found):
    return sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in found), key=str)


def test_runs_of_documents(spark, documents, odd, none, sf_dir):
    small = [(d, t) for d, t in documents.select("doc_id", "text").collect() if len(t or "") < 12_000]
    want = {d: brute_report(d, t) for d, t in small}
    found = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    assert len(found) == documents.count()
    assert columns(found[d] for d in want) == sorted(want.values(), key=str)
    assert sum(r.n_runs > 0 for r in found.values()) > 5
    whole = {r.doc_id: r for r in periodic_runs.report(periodic_runs.find_runs(odd, rewritten=True)).collect()}
    assert (whole[5].n_runs, whole[5].length, whole[5].period) == (1, 30_000, 1)
    short = odd.where("doc_id <> 5 OR doc_id IS NULL")
    got = periodic_runs.report(periodic_runs.find_runs(short, rewritten=True)).collect()
    assert columns(got) == sorted((brute_report(r.doc_id, r.text) for r in short.collect()), key=str)
    assert periodic_runs.find_runs(none).count() == 0


def test_runs_of_many_words():
    rng = np.random.default_rng(0)
    for _ in range(300):
        texts = []
        for _ in range(int(rng.integers(1, 5))):
            n = int(rng.integers(1, 80))
            words = rng.integers(0, int(rng.integers(1, 4)) + 1, n)
            a, p = int(rng.integers(0, n)), int(rng.integers(1, 12))
            at = np.arange(n)
            at[a:] = a + (at[a:] - a) % p
            texts.append(words[at])
        rows = np.cumsum([0, *map(len, texts)])
        start, end, period = periodic_runs.runs(np.concatenate([t + 10 * i for i, t in enumerate(texts)]), rows, 6)
        want = sorted((s + rows[i], p, s + n + rows[i]) for i, t in enumerate(texts) for s, n, p in brute_runs(t.tolist(), 6))
        assert list(zip(start.tolist(), period.tolist(), end.tolist(), strict=True)) == [tuple(map(int, w)) for w in want]


def test_collapse_keeps_rows_and_columns(odd):
    out = periodic_runs.collapse(odd)
    assert out.columns == odd.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[5] == "word" and texts[2] is None and texts[4] == " \n\t " and out.count() == odd.count()


def brute_negatives(rows, positives=5, negatives=3):
    use = [(i, label, tuple(int(np.floor(256 * x)) for x in v)) for i, v, label in rows
           if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in {u for u in use if u[0] % 50 == 0}:
        scored = [(-sum(x * y for x, y in zip(a[2], c[2], strict=True)), c[0], c[1] == a[1]) for c in use if c[0] != a[0] and len(c[2]) == len(a[2])]
        for s, i, _ in sorted(x for x in scored if x[2])[:positives]:
            window = sorted(x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives]
            out += [(a[0], i, r + 1, j, -s, -n) for r, (n, j, _) in enumerate(window)]
    return sorted(out)


def test_hard_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) / 3 + 0.3).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    rows += [(400 + i, [0.5] * 6, i % 2) for i in range(60)] + [(50, [0.25] * 6, 1), (50, [0.25] * 6, 1), (7, [0.5] * 6, 2)]
    rows += [(100, None, 1), (150, [], 1), (200, [None] * 6, 1), (250, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (300, [1.0] * 6, None)]
    rows += [(600, [1.0, 2.0], 1), (601, [3.0, 4.0], 1), (602, [1.0, 2.0], 2), (650, [-1.0, 0.0], 1), (651, [3.0, 0.0], 1), (700, [1.0], 9)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, lane int, slot string")
    found = hard_negatives.mine(frame.repartition(3), F.col("vec_id") % 50 == 0)
    want = brute_negatives(rows)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 50
    assert hard_negatives.mine(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_strassen():
    rng = np.random.default_rng(0)
    for most in (300, 2**62):
        for _ in range(40):
            m, k, n = rng.integers(1, 90, 3)
            a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
            assert (hard_negatives.strassen(a, b, 8) == a @ b).all()
    heaps = hard_negatives.Heaps(2, 3)
    scores = np.array([[5, 9, 9, 1], [2, 2, 2, 2]])
    for half in (slice(0, 2), slice(2, 4)):
        heaps.add(*hard_negatives.best_of_rows(scores[:, half], np.ones((2, 2), bool), np.array([8, 7, 3, 4])[half], 3, heaps.floor))
    assert list(zip(heaps.at, heaps.ids, heaps.scores, strict=True)) == [(0, 3, 9), (0, 7, 9), (0, 8, 5), (1, 3, 2), (1, 4, 2), (1, 7, 2)]
