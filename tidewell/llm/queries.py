"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import (
    bpe,
    chat,
    exact_topk,
    fingerprints,
    hard_negatives,
    language_id,
    neighbour_graph,
    ngram_join,
    packing,
    periodic_runs,
    pii,
    suffix_dedup,
    token_shards,
)
from tidewell.llm.common import table
from tidewell.session import run_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 1


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_shards")
def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write shards, and read every document back through the index."""
    folder = run_dir(spark, "token-shards")
    keys = token_shards.write_shards(table(spark, sf_dir, "documents"), folder, WORD_BPE, END_ID)
    found = token_shards.read_documents(spark, folder, keys)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op2_bpe_round_trip")
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents and decode them again."""
    return bpe.digest_documents(table(spark, sf_dir, "documents"), WORD_BPE)


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents outside the held-out fifth and predict every document."""
    return language_id.identify(table(spark, sf_dir, "documents"))


CONFLICT = "</s>[INST] ok [/INST]"
MARK_CHARS = len(chat.TURN) + len(chat.END) + 2
CHAT_SQL = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{CONFLICT}'
    UNION ALL SELECT -1, 1, 'assistant', '{CONFLICT}'
), whole AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(length(role) + length(text) + {MARK_CHARS}
            + len(regexp_extract_all(text, '{chat.control_pattern()}')))::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    formatted_chars
FROM whole
"""


@query("op8_chat_formatting", CHAT_SQL)
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one that quotes another format's marks; digests of what the output reads back as."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONFLICT).alias("text"),
    )
    return chat.digests(chat.format_conversations(rows.unionByName(quoting)))


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, by patterns and by the contexts that these teach."""
    return pii.report(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


TOP_K_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 5
"""


@query("op6_exact_top_k", TOP_K_SQL)
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for every fiftieth vector."""
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, END_ID, 2048)


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words
), sizes AS (
    SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN shingles s ON s.doc_id = d.doc_id GROUP BY d.doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT x, y FROM shared p JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
    WHERE 100 * p.n >= 85 * (a.n + b.n - p.n)
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT s.doc_id, s.n AS n_shingles, min(r.y) AS component_id FROM sizes s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.n
"""


@query("op5_ngram_jaccard", JACCARD_SQL)
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are alike to 85 hundredths."""
    return ngram_join.similarity_components(table(spark, sf_dir, "documents"), size=4, percent=85)


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand in more than one place of the corpus."""
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and how alike each is to an edited copy of itself and to the next document."""
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


NEAR_SQL = """
WITH RECURSIVE usable AS (
    SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.r AS x, b.r AS y FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
    WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93
), reach AS (
    SELECT r AS x, r AS y FROM usable UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), least AS (
    SELECT u.vec_id, (SELECT count(*) FROM links l WHERE l.x = u.r) AS n_links, min(o.vec_id) AS component_id
    FROM usable u JOIN reach r ON r.x = u.r JOIN usable o ON o.r = r.y GROUP BY u.r, u.vec_id
), every AS (
    SELECT vec_id, n_links, component_id FROM least
    UNION ALL
    SELECT vec_id, 0, vec_id FROM embeddings
    WHERE vec_id IS NULL OR label IS NULL OR embedding IS NULL OR len(embedding) = 0
        OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0
        OR len(list_filter(embedding, lambda x: x <> 0)) = 0
)
SELECT vec_id, n_links::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM every
"""


@query("op11_embedding_near_dedup", NEAR_SQL)
def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors of one label with a cosine of 0.93 or more."""
    return neighbour_graph.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, a tenth of them with a planted periodic tail, and what stays without the repetitions."""
    return periodic_runs.report(periodic_runs.find_runs(table(spark, sf_dir, "documents"), rewritten=True))


NEGATIVES_SQL = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (
    SELECT row_number() OVER () AS anchor, * FROM (SELECT DISTINCT vec_id, label, v FROM whole WHERE vec_id % 50 = 0)
), scored AS (
    SELECT a.anchor, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
    FROM anchors a JOIN whole c ON a.vec_id <> c.vec_id
), positives AS (
    SELECT anchor, row_number() OVER w AS slot, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    WINDOW w AS (PARTITION BY anchor ORDER BY score DESC, vec_id)
    QUALIFY slot <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
    AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor, p.slot ORDER BY n.score DESC, n.vec_id)
QUALIFY rank <= 3
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five best positives of every fiftieth vector; every seventh one has a wrong label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
