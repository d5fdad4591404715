"""Text expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters trimmed from both ends of names, levels and ids.
WHITESPACE = " \t\n\x0b\x0c\r\x85\xa0"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def present(c: Column) -> Column:
    """Not null and not the empty string."""
    return c.isNotNull() & (c != F.lit(""))


def normal(c: Column) -> Column:
    """Trimmed lower-case text; null reads as empty."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def contains_pattern(q: str) -> str:
    """%q% for ILIKE; % and _ typed by the user stay wildcards.

    A backslash takes its meaning from the next character, as in Postgres: before %, _ or a backslash it makes that
    one literal, before any other it is dropped. One at the end of q makes the closing % literal.
    """
    out, rest = [], iter(f"%{q}%")
    for c in rest:
        following = next(rest, "") if c == "\\" else ""
        out.append(c + following if not following or following in "%_\\" else following)
    return "".join(out)


def like_pattern(q: str) -> str:
    return contains_pattern(q.strip())


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed a single time, however often `use` reads it.

    Common parts below a CASE branch are not shared by the code generator.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _dashed(hex32: Column) -> Column:
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(hex32, start, size) for start, size in cuts])


def name_uuid(name: Column) -> Column:
    """UUID version 5 of a name in the all-zero namespace."""

    def spell(digest: Column) -> Column:
        variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
        return F.concat(
            F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
            F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
            F.substring(digest, 21, 12),
        )

    return once(F.sha1(F.concat(F.unhex(F.lit("0" * 32)), F.encode(name, "UTF-8"))), spell)


# The dashed form of a UUID in lower case, and the other accepted spellings.
UUID_FORM = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
URN_PREFIX, URN_LENGTH, BRACED_LENGTH, PLAIN_LENGTH = "urn:uuid:", 45, 38, 32


def uuid_form(raw: Column) -> Column:
    """The dashed lower-case form of a well-formed UUID, else null.

    The length picks the spelling, so that each row meets one regular expression only.
    """

    def undecorated(low: Column) -> Column:
        size = F.length(low)
        return (
            F.when(size == 36, low)
            .when((size == URN_LENGTH) & low.startswith(URN_PREFIX), F.substring(low, 10, 36))
            .when((size == BRACED_LENGTH) & low.startswith("{") & low.endswith("}"), F.substring(low, 2, 36))
            .when(size == PLAIN_LENGTH, _dashed(low))
        )

    form = once(F.lower(raw), undecorated)
    return once(form, lambda f: F.when(f.rlike(UUID_FORM), f))


def canonical_uuid(raw: Column, form: Column, missing: Column) -> Column:
    """The id of a row from the id a client sent and its `uuid_form`: `missing` if none was sent,
    and a name UUID for other text, so that a retry of the same payload keeps the same id."""
    return F.when(raw.isNull() | (raw == ""), missing).when(form.isNotNull(), form).otherwise(name_uuid(raw))


# Fixed value: the characters of a search word.
WORD_CHARACTER = r"[\p{L}\p{N}]"


def has_word(low: Column, word: str) -> Column:
    """Whether lower-case text holds `word` as a whole word.

    The substring test is cheap and drops most rows before the regular expression runs.
    """
    return low.contains(word) & low.rlike(f"(?<!{WORD_CHARACTER}){word}(?!{WORD_CHARACTER})")
