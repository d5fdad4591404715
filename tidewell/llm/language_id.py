"""Language identification by hyperdimensional profiles (operator 4).

Each letter has a random vector of +1 and -1, drawn from its code point. An n-gram is bound by multiplying its letters'
vectors, each rotated by its place. A text's vector is the sum of its n-grams' vectors, a language's prototype the sum
over its training texts, and a text gets the language whose prototype has the largest cosine with its vector. Letters
are lower-cased; every run of other characters, and each end of a text, is one gap symbol with a vector of its own.

Training sums are made per task and language first, so what is shuffled and sent to the driver is (languages x
dimensions) numbers, whatever the corpus. All labelled rows given take part.

Rows: a text that is null or has no letter is ``und`` with score 0, and so is everything if no text was labelled. Equal
cosines go to the language that sorts first. Repeated rows and rows with null ids are treated like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewell.llm.common import folded, freed, row_blocks, text_buffers, unfolded

DIMENSIONS = 1024
N = 3
GAP = 0
UNKNOWN = "und"
BLOCK_BYTES = 2_000_000
DENSE = 4_000_000
LABELLED_ROWS = 20  # fewer labelled texts of a size give no least score
SCORE_SHARE = 0.5  # of the lowest score of a labelled text, which has taken part in its own prototype


@cache
def _folding() -> np.ndarray:
    """For each code point its lower-case letter, or the gap."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def letter_vector(symbol: int) -> np.ndarray:
    return np.random.default_rng([symbol, DIMENSIONS]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


class _Letters:
    """Rotated vectors of the letters met so far."""

    def __init__(self):
        self.known: dict[int, np.ndarray] = {}

    def stack(self, symbols: np.ndarray) -> np.ndarray:
        """(N, letters, dimensions): each letter's vector at each place of an n-gram."""
        for s in symbols.tolist():
            if s not in self.known:
                v = letter_vector(s)
                self.known[s] = np.stack([np.roll(v, N - 1 - place) for place in range(N)]).astype(np.int8)
        return np.stack([self.known[s] for s in symbols.tolist()], axis=1)


_letters = _Letters()


def _numbered(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and the number of each value among them; by counting where the range is small."""
    if below > DENSE:
        return np.unique(values, return_inverse=True)
    present = np.zeros(below, bool)
    present[values] = True
    distinct = np.flatnonzero(present)
    number = np.zeros(below, np.int32)
    number[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, number[values]


def _grams(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram codes of all rows, their offsets by row, and the letters that the codes count in."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    firsts = np.append(0, np.cumsum(data & 0xC0 != 0x80))[rows]  # code points before each row
    folded = _folding()[points]
    n_rows = len(rows) - 1
    # A gap before each row, and one after the last; runs of gaps shrink to one.
    symbols = np.insert(folded, firsts, GAP)
    starts = firsts + np.arange(n_rows + 1)
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != GAP) | (symbols[:-1] != GAP)
    keep[starts] = True
    doubled = np.flatnonzero(keep[:-1] & keep[1:] & (symbols[:-1] == GAP) & (symbols[1:] == GAP))
    ends_twice = doubled[~np.isin(doubled, starts)]
    keep[ends_twice] = False  # the gap that ends a row is the next row's first
    before = np.append(0, np.cumsum(keep))
    symbols, starts = symbols[keep], before[starts]
    letters, index = _numbered(symbols, 0x110000)
    base = len(letters)
    index = index.astype(np.int64)
    codes = np.zeros(max(len(index) - N + 1, 0), np.int64)
    for place in range(N):
        codes = codes * base + index[place : place + len(codes)]
    # N-grams that start in a row and end at most with the gap after it.
    sizes = np.maximum(np.diff(starts) + 1 - (N - 1), 0)
    return codes, np.stack([starts[:-1], sizes]), letters


def _vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The bound vectors of n-gram codes."""
    stack = _letters.stack(letters)
    out = None
    for place in reversed(range(N)):
        codes, letter = np.divmod(codes, len(letters))
        out = stack[place][letter] if out is None else out * stack[place][letter]
    return out.astype(np.float32)


def document_vectors(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, vector) of each text that has a letter."""
    data, rows = text_buffers(texts)
    for first, last in row_blocks(rows, BLOCK_BYTES):
        part = data[rows[first] : rows[last]]
        codes, (starts, sizes), letters = _grams(part, rows[first : last + 1] - rows[first])
        if len(letters) < 2 and GAP in letters:
            continue
        distinct, which = _numbered(codes, len(letters) ** N)
        table = _vectors(distinct, letters)
        for i, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            if size > 0:
                used, counts = np.unique(which[start : start + size], return_counts=True)
                yield first + i, counts.astype(np.float32) @ table[used]


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_numpy(zero_copy_only=False)
        for lang in dict.fromkeys(langs):
            data, rows = text_buffers(batch.column(1).filter(pa.array(langs == lang)))
            for first, last in row_blocks(rows, BLOCK_BYTES):
                codes, (starts, sizes), letters = _grams(data[rows[first] : rows[last]], rows[first : last + 1] - rows[first])
                own = np.zeros(len(codes) + 1, np.int32)  # codes across two rows are left out
                np.add.at(own, starts[sizes > 0], 1)
                np.add.at(own, (starts + sizes)[sizes > 0], -1)
                distinct, counts = np.unique(codes[np.cumsum(own[:-1]) > 0], return_counts=True)
                total = sums.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
                for at in range(0, len(distinct), 20_000):
                    total += np.rint(counts[at : at + 20_000].astype(np.float64) @ _vectors(distinct[at : at + 20_000], letters)).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
        ["lang", "bundle"],
    )


def train(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes (unit vectors) by language from all rows of (text, lang) that have both."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInArrow(freed(_bundles), "lang string, bundle array<bigint>")
    sums = parts.select("lang", F.posexplode("bundle").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    whole = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("bundle"))
    out = {}
    for row in whole.orderBy("lang").collect():  # one row per language
        vector = np.array([x.value for x in row.bundle], np.float64)
        if vector.any():
            out[row.lang] = vector / np.linalg.norm(vector)
    return out


def _predict(batches: Iterator[pa.RecordBatch], prototypes: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    langs = sorted(prototypes)
    matrix = np.stack([prototypes[x] for x in langs]) if langs else np.zeros((0, DIMENSIONS))
    for batch in batches:
        best, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
        for i, vector in document_vectors(batch.column(1)) if langs else ():
            size = np.linalg.norm(vector)
            cosines = matrix @ vector / size if size else np.zeros(len(langs))
            top = int(np.argmax(cosines))
            best[i], score[i] = langs[top], min(max(float(cosines[top]), 0.0), 1.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(score)], ["key", "lang_pred", "score"])


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score of every row; only the text is looked at."""
    rows = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(freed(partial(_predict, prototypes=prototypes)), f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def _with_language(batches: Iterator[pa.RecordBatch], prototypes: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        found = next(_predict(iter([pa.RecordBatch.from_arrays([text, text], ["key", "text"])]), prototypes))
        yield pa.RecordBatch.from_arrays([*batch.columns, *found.columns[1:]], [*batch.schema.names, "_lang", "_score"])


def with_language(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """The documents with their language and its score as two more columns, _lang and _score."""
    schema = StructType([*docs.schema.fields, StructField("_lang", StringType()), StructField("_score", DoubleType())])
    return docs.mapInArrow(freed(partial(_with_language, prototypes=prototypes)), schema)


def _letters_of(text: Column) -> Column:
    return F.length(F.regexp_replace(text.cast("string"), r"\P{L}+", ""))


def _size(text: Column) -> Column:
    """The number of letters as a power of two, rounded down."""
    return F.floor(F.log2(F.greatest(_letters_of(text), F.lit(1)))).cast("int")


def least_scores(labelled: DataFrame, prototypes: dict[str, np.ndarray]) -> dict[int, float]:
    """By size (power of two of letters) SCORE_SHARE of the lowest score of labelled texts of that size or more.

    Sizes below the shortest labelled text, and those with fewer than LABELLED_ROWS such texts, have no entry.
    """
    rows = with_language(labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text"), prototypes)
    rows = rows.where(F.col("_lang") != UNKNOWN).groupBy(_size(F.col("text")).alias("size"))
    found = rows.agg(F.min("_score").alias("score"), F.count("*").alias("n")).orderBy(F.desc("size")).collect()  # one row per size
    out, least, n = {}, 1.0, 0
    for i, row in enumerate(found):
        least, n = min(least, row.score), n + row.n
        shorter = found[i + 1].size if i + 1 < len(found) else row.size - 1
        if n >= LABELLED_ROWS:
            out.update(dict.fromkeys(range(shorter + 1, row.size + 1), SCORE_SHARE * least))
    return out


def recognised(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told, by prototypes and least scores of their own labelled rows.

    Without any prototype these are all documents with a letter.
    """
    prototypes = train(docs)
    if not prototypes:
        return docs.where(F.coalesce(_letters_of(F.col("text")) > 0, F.lit(False)))
    least = least_scores(docs, prototypes)
    rows = with_language(folded(docs), prototypes).where(F.col("_lang") != UNKNOWN)
    if least:
        size = F.least(_size(F.col("text")), F.lit(max(least)))  # longer than all labelled ones: as the longest
        bar = F.create_map(*(F.lit(x) for item in least.items() for x in item))[size]
        rows = rows.where(F.col("_score") >= F.coalesce(bar, F.lit(0.0)))
    return unfolded(rows, docs)


def held_out(doc_id):
    """A fifth of the documents, by id, that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the labelled documents that are not held out and predict all: doc_id, held_out, lang_pred, score."""
    prototypes = train(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), prototypes)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
