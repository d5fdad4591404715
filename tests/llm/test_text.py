"""Operators 5, 8, 9 and 10, and the pipeline."""

import os
import random
from collections import Counter, defaultdict

import brute
import compare
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import chat, components, ngram_join, pii, queries, suffix_dedup
from tidewell.llm.common import freed
from tidewell.session import BATCH_BYTES


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4)


def rows(df, *columns):
    return sorted(tuple(x) for x in df.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, duck, sf_dir, name):
    columns, found = compare.spark_rows(queries.QUERIES[name](spark, sf_dir))
    assert (columns, found) == compare.sql_rows(duck, queries.ORACLES[name])


def near_copies():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 15, 30, 60, 200]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append(" ".join(words))
    docs += ["", None, "  \n", "A b", "a B"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, size, percent):
    docs = near_copies()
    found = ngram_join.similarity_components(frame(spark, docs), size, percent)
    assert rows(found, "doc_id", "n_shingles", "component_id") == brute.components(docs, size, percent)


def test_pairs_of_groups_are_proposed_once_and_whole(spark, monkeypatch):
    """Every pair with a common key and different components, from one group only where the common keys are early; tiles too."""
    rng = random.Random(8)
    rows = [(key, c, c // 3) for c in range(60) for key in rng.sample(range(100), 12)] + [(500, c, c // 3) for c in range(60)]
    held = defaultdict(set)
    for key, c, _ in rows:
        held[key].add(c)
    want = {(a, b) for cs in held.values() for a in cs for b in cs if a < b and a // 3 != b // 3}
    frame = spark.createDataFrame(rows, "key long, class long, component long").repartition(4)
    sets = {c: set(rng.sample(range(1000), 40)) if c % 2 else set(range(c, c + 40)) for c in range(60)}
    about = [(c, sorted(s), bytes([1] * ngram_join.BINS) if c % 5 else None) for c, s in sets.items()]  # nothing is ruled out
    about = spark.createDataFrame(about, "class long, elements array<bigint>, bins binary")
    for tile, early in ((400, 100), (7, 100), (7, 2)):
        monkeypatch.setattr(ngram_join, "TILE", tile)
        monkeypatch.setattr(ngram_join, "EARLY", early)
        found = [tuple(x) for x in ngram_join.group_pairs(frame, about, 85).collect()]
        assert set(found) == want and (early == 2 or len(found) == len(want))


def test_bins_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    sets = []
    for size in (3, 40, 300, 5_000):
        base = rng.integers(0, 2**63, size, np.uint64)
        for share in (0, 0.02, 0.05, 0.08, 0.1, 0.2, 0.5):
            other = base.copy()
            other[: int(share * size)] = rng.integers(0, 2**63, int(share * size), np.uint64)
            sets.append(np.unique(other))
    bins = [np.bincount((ngram_join.mixed(s) >> np.uint64(40)).astype(np.int64) % ngram_join.BINS, minlength=ngram_join.BINS) for s in sets]
    raw = [b.astype(np.uint8).tobytes() if b.max() < 255 else None for b in bins]
    i, j = np.triu_indices(len(sets), 1)
    may = ngram_join._could_link(raw, np.array([len(s) for s in sets]), i, j, 85)
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    linked = 100 * both >= 85 * (np.array([len(sets[a]) + len(sets[b]) for a, b in zip(i, j, strict=True)]) - both)
    assert may[linked].all() and may.sum() < 2 * linked.sum()


def test_ngram_join_of_documents(spark, documents, sf_dir):
    found = queries.op5_ngram_jaccard(spark, sf_dir)
    docs = [tuple(x) for x in documents.select("doc_id", "text").collect()]
    assert rows(found, "doc_id", "n_shingles", "component_id") == brute.components(docs, 4, 85)


def test_ngram_join_of_odd_rows(odd, none):
    found = Counter(tuple(x) for x in ngram_join.similarity_components(odd).select("doc_id", "n_shingles", "component_id").collect())
    assert found[(1, 3, 1)] == 2 and found[(None, 3, 1)] == 1 and found[(3, 0, 3)] == found[(2, 0, 2)] == found[(4, 0, 4)] == 1
    assert found[(5, 1, 5)] == found[(6, 1, 6)] == 1 and sum(found.values()) == 10
    assert ngram_join.similarity_components(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200 + i, 100) for i in range(40)] + [(7, 7), (5, 4)]
    found = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys([100, *range(200, 240)], 100)}


def conversations(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_chat(spark):
    texts = ["plain", "", None, "<|im_end|>\n", "<\\|im_end|>", "<\\\\|im_end|>x<s>", "[INST][/INST]", "<|im_start|>user\nhi<|im_end|>\n", "<<SYS>", "a\\b", "<", "é\n\n", "x" * 100_000]
    rng = random.Random(1)
    made = ["".join(rng.choice(["<", "|", "\\", "im_end", "im_start", "|>", "[", "INST]", "s>", "/", "\n", "é"]) for _ in range(12)) for _ in range(200)]
    data = [(c, t, ["user", "assistant", "system", "a\nb\\s", "<|im_end|>", None][(c + t) % 6], x) for c, part in enumerate((texts, made)) for t, x in enumerate(part)]
    data += [(7, None, "assistant", "late"), (7, 1, "assistant", "same"), (7, 1, "assistant", "same"), (None, 1, "user", "x"), (None, 1, "user", "x")]
    found = chat.format_conversations(conversations(spark, data))
    out = found.select("*", chat.parse(F.col("formatted")).alias("parsed")).collect()
    by = defaultdict(list)
    for c, t, role, text in data:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert sorted(str(x.conv_id) for x in out) == ["0", "1", "7", "None", "None"]
    for x in out:
        turns = [t[2:] for t in sorted(by[x.conv_id])][: 1 if x.conv_id is None else None]
        assert x.round_trip and [(p.role, p.text) for p in x.parsed] == turns
        assert "".join(s.text for s in x.segments) == x.formatted
        assert [x.formatted[s.start : s.end] for s in x.loss_spans] == [s.text for s in x.segments if s.loss]
    digest = {x.conv_id: x for x in chat.digests(found).collect()}
    assert digest[7].loss_sha256 == brute.sha("latesamesame") and digest[7].n_turns == 3
    assert chat.format_conversations(conversations(spark, data).limit(0)).count() == 0


def check_repeats(df, docs, n=50):
    want, words = brute.repeats(docs, n)
    got = defaultdict(lambda: (set(), set()))
    for x in suffix_dedup.report(df, n).collect():
        got[x.doc_id][x.kept].update(i for i, w in enumerate(words[x.doc_id]) if x.start <= w[1] and w[2] <= x.end)
    for doc, (removed, first) in want.items():
        assert got[doc][0] == removed and first <= got[doc][1]
    return want


def test_repeats(spark, documents):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)] + [f"é{i}" for i in range(50)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [some(n) for n in (50, 51, 60, 80, 49, 200)]
    docs = []
    for _ in range(150):
        words = some(rng.randint(0, 120))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.choice(passages)
            k = rng.randint(0, len(words))
            words[k:k] = p[rng.randint(0, len(p) // 4) : len(p) - rng.randint(0, len(p) // 4)]
        docs.append(" ".join(words) + rng.choice(["", " ", "\n"]))
    docs += [docs[3], docs[7], docs[7], "And " * 200, "", "x " * 60 + "y " * 60, "And " * 200, None]
    docs = list(enumerate(docs))
    df = frame(spark, docs)
    want = check_repeats(df, docs)
    kept = {x.doc_id: x.text for x in suffix_dedup.remove_repeats(df).collect()}
    assert len(kept) == len(docs)
    for doc, text in docs:
        found = brute.WORD.findall(text or "")
        assert brute.WORD.findall(kept[doc] or "") == [w for i, w in enumerate(found) if i not in want[doc][0]]
    check_repeats(documents, [tuple(x) for x in documents.select("doc_id", "text").collect()])


def test_repeats_of_odd_rows(odd, none):
    assert suffix_dedup.remove_repeats(odd).count() == odd.count()
    assert suffix_dedup.report(none).count() == 0 and suffix_dedup.remove_repeats(none).count() == 0


def test_personal_data(spark, documents, sf_dir):
    found = {x.doc_id: x for x in queries.op10_personal_data(spark, sf_dir).collect()}
    for doc, text in documents.select("doc_id", "text").collect():
        base = brute.personal(text)
        assert found[doc].base_sha256 == brute.sha(brute.spans_text(base))
        assert set(brute.spans_text(base).split(",")) <= set(found[doc].spans.split(","))


def test_personal_data_in_made_texts(spark, odd, none):
    rng = random.Random(3)
    parts = [*"ab.@-+ 1234567890() _%é😀", "1.2.3.4 ", "4111111111111111", "4111 1111 1111 1111", " +1 (988) 555-2485 ", "x@y.co ", "255.", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += [None, "", "a" * 100_000, "1" * 50_000, "1." * 50_000, "a@" + "b." * 30_000, "a@b.c " * 1500, "+1 " * 3000]
    found = {x.doc_id: x for x in pii.report(pii.find(frame(spark, list(enumerate(texts))))).collect()}
    assert all(found[i].base_sha256 == brute.sha(brute.spans_text(brute.personal(t))) for i, t in enumerate(texts))
    assert pii.report(pii.find(odd)).count() == odd.count() and pii.redact(odd).columns == odd.columns
    unchanged = [c for c in odd.columns if c != "text"]
    assert Counter(pii.redact(odd).select(unchanged).collect()) == Counter(odd.select(unchanged).collect())
    assert pii.report(pii.find(none)).count() == 0


def test_addresses_with_zero_octets(spark):
    values = ["10.0.0.1", "127.0.0.1", "0.0.0.0", "000.1.1.1", "00.00.00.00", "1.2.3.0255", "0256.1.1.1", "1.2.3.256", "192.168.1.10", "300.0.0.1"]
    docs = [(i, f"from {v}, or so") for i, v in enumerate(values)] + [(90, "0" * 4_000 + ".0.0.1"), (91, "0" * 4_000 + "999.0.0.1")]
    found = {x.doc_id: x for x in pii.report(pii.find(frame(spark, docs))).collect()}
    redacted = {x.doc_id: x.text for x in pii.redact(frame(spark, docs)).collect()}
    for i, text in docs:
        base = brute.personal(text)
        assert found[i].base_sha256 == brute.sha(brute.spans_text(base)) and found[i].n_ip == len(base)
        assert ("[IP]" in redacted[i]) == bool(base)
    assert redacted[0] == redacted[1] == redacted[2] == redacted[3] == "from [IP], or so"


def test_contexts_discover_other_forms(spark):
    docs = []
    for i in range(60):
        mail = f"u{i}@mail{i}.com" if i % 5 else f"u{i}(at)mail{i}"
        docs.append((i, f"the cat 12 sat of it please reach me at {mail}, or so. the 1999 of it {i} end"))
    found = {x.doc_id: x for x in pii.report(pii.find(frame(spark, docs))).collect()}
    for i, text in docs:
        start = text.index("me at ") + 6
        assert found[i].spans == f"email:{start}:{text.index(',')}" and found[i].n_email == (i % 5 > 0)
    redacted = {x.doc_id: x.text for x in pii.redact(frame(spark, docs)).collect()}
    assert redacted[5] == "the cat 12 sat of it please reach me at [EMAIL], or so. the 1999 of it 5 end"


def test_contexts_across_lines_and_other_mentions(spark):
    """The two words before a mention count whatever white space follows them, also behind another mention, and at any length."""
    long = "w" * 300
    docs = [(i, f"please reach me at u{i}@mail{i}.com, or so") for i in range(12)]
    docs += [(20 + i, f"copies {long} {long} v{i}@mail{i}.com end") for i in range(12)]
    docs += [(40 + i, f"and c{i}@far.org me at w{i}@mail{i}.com end") for i in range(3)]
    hidden = ["reach me at\nz8(at)mail8", "reach me at\t z8(at)mail8 x", "a@b.org c@d.org me at z8(at)mail8", f"on {long}\n{long}\tz8(at)mail8"]
    docs += [(100 + i, t) for i, t in enumerate(hidden)]
    docs += [(110, "at z8(at)mail8"), (111, "me atz z8(at)mail8"), (112, "xme.at z8(at)mail8")]
    found = pii.find(frame(spark, docs)).where("size(discovered) > 0").select("doc.doc_id", "discovered.value").collect()
    assert {(x.doc_id, *x.value) for x in found} == {(100 + i, "z8(at)mail8") for i in range(4)}


def test_places_are_counted_before_the_join(spark):
    docs = frame(spark, [(1, "one two one two three")])
    plan = pii._places(docs, docs.selectExpr("xxhash64('one', 'two') AS context"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate") and "LeftSemi" not in plan


def test_rare_contexts_beside_many_seeds(spark):
    """Contexts of 5 to 50 instances count the same beside 60,000 other seeds and copies of one row."""
    docs = []
    for size, word in ((4, "four"), (5, "five"), (20, "twenty"), (50, "fifty")):
        docs += [(len(docs) + i, f"note {word} under: s{size}n{i}@mail.org, or so") for i in range(size)]
        docs.append((len(docs), f"note {word} under: s{size}(at)mail9, or so"))
    others = spark.range(40_000).selectExpr("1000 + id AS doc_id", "concat('x', id, ' y', id, ' z', id, '@far.org') AS text")
    copies = spark.range(20_000).selectExpr("100000 + id AS doc_id", "'same old row a@b.org' AS text")
    found = pii.find(frame(spark, docs).unionByName(others).unionByName(copies)).where("size(discovered) > 0")
    values = {m.value for x in found.collect() for m in x.discovered}
    # Four seeds and the other form are five instances.
    assert values == {f"s{size}(at)mail9" for size in (4, 5, 20, 50)}


def test_language_stage_rejects_by_score(spark, documents):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = ["".join(rng.choice(letters + "    ") for _ in range(n)) for n in (200, 700, 3000, 20_000)]
    noise += ["".join(rng.choice(letters + letters.upper() + "0123456789+/") for _ in range(n)) for n in (400, 4000)]
    clean = [(x.doc_id, x.text, x.lang) for x in documents.collect() if any(c.isalpha() for c in x.text or "")]
    longer = [(10_000 + d, t, None) for d, t, _ in clean if len(t) > 500]  # the same, without their labels
    rows = clean + longer + [(20_000 + i, t, None) for i, t in enumerate(noise)] + [(30_000, "123 !!", None), (30_001, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    out = corpus_pipeline.identify_language(spark, frame, "")
    assert {x.doc_id for x in out.collect()} == {x[0] for x in clean + longer}
    unlabelled = corpus_pipeline.identify_language(spark, frame.withColumn("lang", F.lit(None).cast("string")), "")
    assert {x.doc_id for x in unlabelled.collect()} == {x[0] for x in rows if x[0] < 30_000}


def test_near_duplicates_by_row(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(100))
    near = lambda k: text(k) + " more"
    docs = [
        (3, text("a")), (7, near("a")), (7, text("b")),  # 7 is also the id of another text
        (1, text("c")), (3, near("c")),  # 3 stays in the first group and goes from this one
        (8, text("d")), (8, near("d")),  # near copies of one id
        (None, text("e")), (None, text("e")), (None, near("e")),  # no id in the group
        (None, text("f")), (9, near("f")), (9, near("f")),
        (None, None), (None, ""), (None, ""),
    ]
    out = [tuple(x) for x in corpus_pipeline.drop_near_duplicates(spark, frame(spark, docs), "").collect()]
    left = Counter((d, (t or "")[:1]) for d, t in out)
    assert left == {(3, "a"): 1, (7, "b"): 1, (1, "c"): 1, (8, "d"): 1, (None, "e"): 1, (9, "f"): 1, (None, ""): 3}


def test_pipeline_stages(spark, documents, odd, none, sf_dir):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == documents.columns
        before, out = {x.doc_id: x for x in docs.collect()}, {x.doc_id: x for x in after.collect()}
        if name == "language_id":
            assert set(before) - set(out) == {d for d, x in before.items() if not any(c.isalpha() for c in x.text or "")}
        elif name == "ngram_jaccard":
            groups = brute.components([(d, x.text) for d, x in before.items()], 5, 80)
            assert set(out) == {d for d, n, c in groups if not n or d == c}
        else:
            assert set(out) == set(before) and all(x.n_chars == len(x.text) for x in out.values())
        if name == "personal_data":
            assert not any(brute.personal(x.text) for x in out.values())
        docs = after.sparkSession.createDataFrame(after.collect(), after.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == len(out)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        extra = [c for c in odd.columns if c not in ("text", "n_chars")]
        values = {tuple(x) for x in odd.select(extra).collect()}
        assert {tuple(x) for x in stage(spark, odd, sf_dir).select(extra).collect()} <= values, name
    for start in (odd, none):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert (docs.count() > 0) == (start is odd)


def test_pipeline_hands_long_texts_to_python_in_small_batches(spark):
    def sizes_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"), F.lit("en").alias("lang"))
    for _, stage in [x for x in corpus_pipeline.STAGES if x[0] != "personal_data"]:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs.limit(5), "")
        sizes = [x.size for x in docs.mapInArrow(sizes_of, "size long").collect()]
        assert sum(sizes) > 30_000_000 and max(sizes) <= BATCH_BYTES + 11_000  # a batch ends behind the row that reaches it


def _resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def test_batch_functions_give_memory_back_at_the_end_of_a_task():
    kept = []

    def work(batches):
        held = [np.ones(12_000) for _ in range(3000)]  # 288 MB in pieces that the allocator keeps
        kept.append(np.ones(12_000))  # at the end of the heap
        yield from batches
        del held

    before = _resident()
    assert list(freed(work)(iter([]))) == [] and len(kept) == 1
    assert _resident() - before < 50_000_000


def test_places_of_contexts_are_joined_before_they_are_counted(spark):
    contexts = spark.range(1).select(F.xxhash64(F.lit("a"), F.lit("b")).alias("context"))
    found = pii._places(frame(spark, [(1, "a b a b c")]), contexts)
    assert [x.places for x in found.collect()] == [2]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join")
