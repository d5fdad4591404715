"""Personal data by patterns and by bootstrapped contexts (operator 10), in DataFrame functions only.

Seeds are what fixed patterns find: e-mail addresses, IPv4 addresses, payment card numbers and phone numbers.
Candidates are other tokens with a digit or an at sign, outside the seeds. The two words before a mention, in lower
case, are its lexical pattern. Patterns and instances (the mentions' values) form a graph, which is scored in rounds:

- the confidence of a pattern for a kind is the sum of its instances' confidence in that kind, divided by all places
  of the corpus where those two words stand, whatever follows;
- the confidence of an instance is that of any of its patterns being right, 1 - product(1 - confidence); seeds have 1.

Only patterns with at least ``min_support`` different instances are scored, however large the corpus; chance company
stays out because its two words stand in many places without a mention. After the last round, candidates behind a
pattern of at least ``min_confidence`` are mentions of its kind.

Counts cover all documents, and only graph nodes are joined and grouped, pre-aggregated by pattern and instance, so a
frequent pattern is spread over its instances.

Rows: a null text is empty; each row is a document of its own, repeated or not, and null ids are kept. Spans are code
points, end exclusive. Words are what white space separates, also across lines and behind other mentions. Ties cannot arise: mentions of one kind do not overlap, and a candidate that two kinds claim
goes to the more confident one, then to the kind listed first. Further columns are left alone. An empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import folded, small_side, stored, unfolded

#: The seed patterns (fixed values). Quantifiers are possessive, and a run is entered at its start or where the last
#: match ended, which finds the same matches without trying every start of a long run.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: A text without this cannot match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
HIDDEN = "￼"  # stands for each character of a seed while candidates are looked for
#: A token with a digit or an at sign that no seed touches, and groups of digits behind it.
CANDIDATE = rf"(?<!\S)[^\s{HIDDEN}0-9@]*+[0-9@][^\s{HIDDEN}]*+(?!{HIDDEN})(?:\x20[(+]?[0-9][0-9().-]*+(?!\S))*+"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"

MENTION = "array<struct<kind:string,start:bigint,end:bigint,value:string,context:bigint>>"
BLOCK = 256


# -- single texts -----------------------------------------------------------------------------------------------------
def _appended(values: Column, first: Column) -> Column:
    """first, first + values[0], ... without the last sum."""
    sums = F.aggregate(values, F.array(first), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))
    return F.slice(sums, F.lit(1), F.size(values))


def _offsets(lengths: Column) -> Column:
    """Sums of all earlier lengths, by blocks, so that the cost stays near linear."""
    zero = F.lit(0).cast("long")
    last = F.floor((F.size(lengths) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    firsts = _appended(F.transform(blocks, lambda x: F.aggregate(x, zero, lambda a, v: a + v)), zero)
    return F.flatten(F.zip_with(blocks, firsts, _appended))


#: The last two words of a text that ends in white space; the first one is whole. Words are entered at their start only.
LAST_WORDS = r"(?<!\S)(\S++)\s++(\S++)\s++$"
LAST_WORDS_INSIDE = r"(?<=\s)(\S++)\s++(\S++)\s++$"


def context_words(before: Column, whole: Column) -> Column:
    """A number for the two words in front of a mention; null without white space right before it or without two words.

    ``before`` is the text before it, or (if not ``whole``) its last part, whose first word may be cut.
    """
    low = F.lower(before)

    def number(pattern: str) -> Column:
        first, second = (F.regexp_extract(low, pattern, i) for i in (1, 2))
        return F.when(first != "", F.xxhash64(first, second))

    return F.when(whole, number(LAST_WORDS)).otherwise(number(LAST_WORDS_INSIDE))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, minus nine beyond nine; the sum has to end in 0."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def is_valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return value.rlike(IPV4)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda m: is_valid(kind, m["value"])


def _covered(kind: str):
    """A piece and the match behind it, hidden if it is valid."""

    def join(piece: Column, value: Column) -> Column:
        hidden = F.when(is_valid(kind, value), F.repeat(F.lit(HIDDEN), F.length(value))).otherwise(value)
        return F.concat(piece, F.coalesce(hidden, F.lit("")))

    return join


def _mentions(kind: str, pieces: Column, values: Column) -> Column:
    """What stands at each match: its span, value and context. pieces are the texts between matches.

    The context is read from the three pieces before a match and the two matches between them.
    """
    pieces = F.slice(pieces, F.lit(1), F.size(values))
    lengths = F.zip_with(pieces, values, lambda p, v: (F.length(p) + F.length(v)).cast("long"))
    joined = F.zip_with(values, pieces, lambda v, p: F.concat(p, v))

    def lead(i: Column) -> Column:
        earlier = F.array_join(F.slice(joined, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), "")
        return F.struct(F.concat(earlier, F.get(pieces, i)).alias("before"), (i <= 2).alias("whole"))

    leads = F.transform(F.sequence(F.lit(0), F.size(values) - 1), lead)
    parts = F.arrays_zip(pieces.alias("piece"), values.alias("value"), _offsets(lengths).alias("at"), leads.alias("lead"))

    def mention(x: Column) -> Column:
        start = x["at"] + F.length(x["piece"])
        return F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["value"])).alias("end"),
            x["value"].alias("value"), context_words(x["lead"]["before"], x["lead"]["whole"]).alias("context"),
        )

    return F.when(F.size(values) > 0, F.transform(parts, mention)).otherwise(F.array().cast(MENTION))


def _found(rows: DataFrame, kind: str, text: str, pattern: str, possible: Column) -> DataFrame:
    """Adds <kind>_values and <kind>_pieces."""
    none = F.array().cast("array<string>")
    rows = rows.withColumn(f"{kind}_values", F.when(possible, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    return rows.withColumn(f"{kind}_pieces", F.when(F.size(f"{kind}_values") > 0, F.split(F.col(text), pattern, -1)).otherwise(none))


def mentions(docs: DataFrame) -> DataFrame:
    """Adds to documents (text, further columns): base, the seeds by kind and start, and candidates."""
    rows = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    any_digit = F.col("_text").rlike("[0-9@]")
    rows = rows.withColumn("_possible", any_digit)
    for kind, pattern in PATTERNS.items():
        possible = F.col("_possible") & F.contains(F.col("_text"), F.lit(NEEDS[kind]))
        rows = _found(rows, kind, "_text", pattern, possible)
        all_of_kind = _mentions(kind, F.col(f"{kind}_pieces"), F.col(f"{kind}_values"))
        rows = rows.withColumn(f"_{kind}", F.filter(all_of_kind, _checked(kind)))
        rows = rows.drop(f"{kind}_values", f"{kind}_pieces")
    # Hide the seeds in a copy of the text of the same length, one kind after the other.
    rows = rows.withColumn("_hidden", F.when(F.col("_possible"), F.col("_text")).otherwise(F.lit("")))
    for kind, pattern in PATTERNS.items():
        rows = _found(rows, "hide", "_hidden", pattern, F.size(f"_{kind}") > 0)
        hidden = F.array_join(F.zip_with("hide_pieces", "hide_values", _covered(kind)), "")
        rows = rows.withColumn("_hidden", F.when(F.size("hide_values") > 0, hidden).otherwise(F.col("_hidden")))
    rows = _found(rows, "candidate", "_hidden", CANDIDATE, F.col("_possible"))
    rows = rows.withColumn("candidates", _trimmed(_mentions("candidate", F.col("candidate_pieces"), F.col("candidate_values"))))
    rows = rows.withColumn("base", F.concat(*(f"_{kind}" for kind in KINDS)))
    unused = [f"{x}_{y}" for x in ("hide", "candidate") for y in ("values", "pieces")]
    return rows.drop("_text", "_possible", "_hidden", *unused, *(f"_{kind}" for kind in KINDS))


def _trimmed(candidates: Column) -> Column:
    """Without punctuation at the end; only candidates that have a context matter."""

    def trim(m: Column) -> Column:
        value = F.regexp_replace(m["value"], r"[.,;:!?)\]}\"'>]+$", "")
        return F.struct(
            m["kind"].alias("kind"), m["start"].alias("start"), (m["start"] + F.length(value)).alias("end"),
            value.alias("value"), m["context"].alias("context"),
        )

    return F.filter(F.transform(candidates, trim), lambda m: m["context"].isNotNull() & m["value"].rlike("[0-9@]"))


# -- bootstrapping ----------------------------------------------------------------------------------------------------
def _places(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """How often the two words of each context stand in the corpus: context, places."""
    words = F.split(F.lower(F.trim(F.col("text").cast("string"))), r"\s+", -1)
    texts = docs.where("text IS NOT NULL").select(words.alias("words")).where(F.size("words") > 1)
    n = F.size("words") - 1
    pairs = texts.select(F.inline(F.arrays_zip(F.slice("words", F.lit(1), n).alias("a"), F.slice("words", F.lit(2), n).alias("b"))))
    # Joined before they are counted: else each task holds and shuffles all pairs of words of the corpus, for few contexts.
    met = pairs.select(F.xxhash64("a", "b").alias("context")).join(small_side(contexts.select("context"), 8), "context")
    return met.groupBy("context").agg(F.count("*").alias("places"))


def learn_patterns(found: DataFrame, docs: DataFrame, min_support: int = 5, min_confidence: float = 0.6, rounds: int = 3) -> DataFrame:
    """context, kind, confidence of the high-confidence patterns; at most one kind for each context.

    found is a stored result of ``mentions``, docs the documents that it comes from.
    """
    edge = found.select(F.explode(F.concat("base", "candidates")).alias("m")).select(
        F.col("m.context").alias("context"), F.col("m.value").alias("value"), F.col("m.kind").alias("kind")
    )
    edges = edge.where("context IS NOT NULL").groupBy("context", "value", "kind").agg(F.count("*").alias("n"))
    supported = edges.groupBy("context").agg(F.count_distinct("value").alias("instances")).where(F.col("instances") >= min_support)
    # Contexts that no seed has can only matter through instances that have others; those stay in the graph.
    supported = stored(supported.select("context"))
    edges = stored(edges.join(supported, "context", "left_semi"))
    places = stored(_places(docs, supported))
    known = edges.where(F.col("kind") != "candidate").select("value", "kind").distinct().withColumn("confidence", F.lit(1.0))
    fresh = edges.where(F.col("kind") == "candidate").select("context", "value", "n")
    graph = edges.select("context", "value", F.col("kind").alias("seen_as"), "n")
    patterns = None
    for _ in range(rounds):
        # A seed mention counts for its own kind only, a candidate mention for what its value is believed to be.
        weights = graph.join(known, "value").where((F.col("seen_as") == F.col("kind")) | (F.col("seen_as") == "candidate"))
        weights = weights.groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("confidence")).alias("weight"))
        patterns = weights.join(places, "context").select(
            "context", "kind", F.least(F.lit(1.0), F.col("weight") / F.col("places")).alias("confidence")
        )
        patterns = stored(patterns)
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        believed = fresh.join(patterns, "context").groupBy("value", "kind").agg((1 - doubt).alias("confidence"))
        known = stored(
            known.where(F.col("confidence") == 1.0).unionByName(believed.where(F.col("confidence") >= min_confidence))
            .groupBy("value", "kind").agg(F.max("confidence").alias("confidence"))
        )
    rank = F.create_map(*(x for i, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(-i))))
    best = F.max(F.struct("confidence", rank[F.col("kind")].alias("order"), "kind")).alias("best")
    kept = patterns.where(F.col("confidence") >= min_confidence).groupBy("context").agg(best)
    return kept.select("context", F.col("best.kind").alias("kind"), F.col("best.confidence").alias("confidence"))


def find(docs: DataFrame, min_support: int = 5, min_confidence: float = 0.6, rounds: int = 3, with_text: bool = False) -> DataFrame:
    """doc (a struct of the other columns), text if asked, base and discovered: mentions (kind, start, end, value)."""
    rows = folded(docs)
    found = mentions(rows).withColumn("_row", F.monotonically_increasing_id())
    found = found if with_text else found.drop("text")
    found = stored(found)  # the row numbers are fixed from here on
    patterns = learn_patterns(found, rows, min_support, min_confidence, rounds)
    fresh = found.select("_row", F.explode("candidates").alias("m")).select("_row", "m", F.col("m.context").alias("context"))
    fresh = fresh.join(patterns.withColumnRenamed("kind", "_kind"), "context").select(
        "_row", F.struct(F.col("_kind").alias("kind"), "m.start", "m.end", "m.value").alias("m")
    )
    fresh = fresh.groupBy("_row").agg(F.collect_list("m").alias("discovered"))  # of one document each
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    out = found.join(fresh, "_row", "left")
    short = F.transform("base", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    texts = ["text"] if with_text else []
    return out.select("doc", *texts, short.alias("base"), F.coalesce("discovered", none).alias("discovered"))


def _joined(spans: Column) -> Column:
    """kind:start:end, by kind as listed and then start."""
    rank = F.create_map(*(x for i, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(i))))
    keyed = F.transform(spans, lambda m: F.struct(rank[m["kind"]].alias("r"), m["start"].alias("s"), m["end"].alias("e"), m["kind"].alias("k")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda m: F.concat_ws(":", m["k"], m["s"], m["e"])), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts of seeds by kind, their digest, and all spans."""
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long")
    return found.select(
        F.col("doc.doc_id").cast("long").alias("doc_id"),
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "discovered")).alias("spans"),
    )


def redact(docs: DataFrame, min_support: int = 5, min_confidence: float = 0.6, rounds: int = 3) -> DataFrame:
    """The documents with each mention replaced by its kind in brackets; mentions that overlap become one."""
    found = find(docs, min_support, min_confidence, rounds, with_text=True)
    original = F.col("text")
    spans = F.array_sort(F.transform(F.concat("base", "discovered"), lambda m: F.struct(m["start"].alias("s"), m["end"].alias("e"), m["kind"].alias("k"))))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, m: Column) -> Column:
        gap = F.substring(original, acc["at"].cast("int") + 1, (m["s"] - acc["at"]).cast("int"))
        added = F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(m["k"]), F.lit("]"))))
        return F.struct(
            F.when(m["s"] >= acc["at"], added).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], m["e"]).alias("at")
        )

    done = F.aggregate(spans, empty, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(original, acc["at"].cast("int") + 1, F.lit(2**31 - 1))))
    text = F.when(F.size(spans) > 0, done).otherwise(original)
    return unfolded(found.withColumn("text", text), docs)
