"""Chat formatting with a grammar round trip (operator 8), in DataFrame functions only.

A conversation becomes its turns one after another, each as ``<|im_start|>role``, a line end, the text and
``<|im_end|>`` with a line end. The parser is the inverse and deterministic: a turn ends at the first end mark, its role
at the first line end, and no control string may stand inside a role or text. Each turn is rendered as it is, parsed
again and compared with its source. Where they differ, it is rendered with escapes, which the parser takes off: a
backslash goes behind the first character of each control string, in front of backslashes that stand there already. In
roles, backslashes and line ends are written ``\\s`` and ``\\n`` besides. The whole conversation is then parsed and
compared once more; ``round_trip`` says whether all turns came back.

The loss mask is given twice: as segments (text, under the mask or not) whose texts make up the output, and as spans of
code points. Only texts of assistant turns are under it.

Rows: a null text or role is empty. Turns are ordered by turn, then role and text, nulls first; repeated rows are turns of their
own. Rows without a conv_id are conversations of one turn each, so that they never meet in one group. Further columns
are not read, an empty table gives no rows. A conversation is one value of the result, so it has to fit in a row; only
the turns of one conversation ever come together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template and of other common chat formats (fixed values).
TURN, END = "<|im_start|>", "<|im_end|>"
CONTROL = [TURN, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LEARNED_ROLE = "assistant"


def _rests(control: list[str], first: str) -> str:
    return "|".join(re.escape(c[1:]) for c in control if c[0] == first)


def control_pattern(control: list[str] = CONTROL) -> str:
    """Control strings as they are or escaped."""
    return "|".join(rf"{re.escape(c)}\\*(?:{_rests(control, c)})" for c in dict.fromkeys(c[0] for c in control))


def _behind_first(control: list[str], taken: str) -> str:
    return "|".join(rf"(?<={re.escape(c)}){taken}(?=\\*(?:{_rests(control, c)}))" for c in dict.fromkeys(c[0] for c in control))


def escaped(text: Column, control: list[str] = CONTROL) -> Column:
    return F.regexp_replace(text, _behind_first(control, ""), r"\\")


def unescaped(text: Column, control: list[str] = CONTROL) -> Column:
    return F.regexp_replace(text, _behind_first(control, r"\\"), "")


def _line(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def _unline(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def parse_turn(piece: Column, control: list[str] = CONTROL) -> Column:
    """Role and text of a turn without its end mark; null if it is none or holds a bare control string."""
    body = F.substring(piece, len(TURN) + 1, 2**31 - 1)
    role = F.substring_index(body, "\n", 1)
    bare = "|".join(map(re.escape, control))
    text = F.substring(body, F.length(role) + 2, F.lit(2**31 - 1))
    found = F.struct(_unline(unescaped(role, control)).alias("role"), unescaped(text, control).alias("text"))
    return F.when(piece.startswith(TURN) & F.contains(body, F.lit("\n")) & ~body.rlike(bare), found)


def parse(formatted: Column, control: list[str] = CONTROL) -> Column:
    """The turns of a formatted conversation; a null among them where the grammar is broken."""
    pieces = F.split(formatted, re.escape(END) + "\n", -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: parse_turn(p, control))


def format_conversations(conversations: DataFrame, control: list[str] = CONTROL, learned: str = LEARNED_ROLE) -> DataFrame:
    """conv_id, formatted, segments [(text, loss)], loss_spans [(start, end)], round_trip, escaped_turns."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    plain = F.concat(F.lit(TURN), "role", F.lit("\n"), "text")
    back = parse_turn(plain, control)
    rows = rows.withColumn("same", F.coalesce((back["role"] == F.col("role")) & (back["text"] == F.col("text")), F.lit(False)))
    rows = rows.select(
        "conv_id", "turn", "role", "text", "same",
        F.when(F.col("same"), F.col("role")).otherwise(escaped(_line(F.col("role")), control)).alias("shown_role"),
        F.when(F.col("same"), F.col("text")).otherwise(escaped(F.col("text"), control)).alias("shown"),
    )
    # Rows without an id have a key of their own each; the others share one constant here.
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    order = Window.partitionBy("conv_id", "alone").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.length("shown_role") + len(TURN) + 1
    size = (head + F.length("shown") + len(END) + 1).cast("long")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)) + head)
    turns = F.sort_array(F.collect_list(F.struct("n", "role", "text", "shown_role", "shown", "at", "same")))
    whole = rows.groupBy("conv_id", "alone").agg(turns.alias("turns"))
    is_learned = lambda t: t["role"] == learned
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(TURN), t["shown_role"], F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
                F.struct(t["shown"].alias("text"), is_learned(t).alias("loss")),
                F.struct(F.lit(f"{END}\n").alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    spans = F.transform(
        F.filter("turns", is_learned), lambda t: F.struct(t["at"].alias("start"), (t["at"] + F.length(t["shown"])).alias("end"))
    )
    whole = whole.select(
        "conv_id", "turns", segments.alias("segments"), spans.alias("loss_spans"),
        F.array_join(F.transform("turns", lambda t: _rendered(t["shown_role"], t["shown"])), "").alias("formatted"),
    )
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return whole.select(
        "conv_id", "formatted", "segments", "loss_spans",
        (parse(F.col("formatted"), control) == source).alias("round_trip"),
        F.size(F.filter("turns", lambda t: ~t["same"])).alias("escaped_turns"),
    )


def digests(formatted: DataFrame, control: list[str] = CONTROL) -> DataFrame:
    """What the output says when it is read back: turns by the parser, loss text by the mask."""
    turns = parse(F.col("formatted"), control)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.filter("segments", lambda s: s["loss"])
    loss = F.array_join(F.transform(masked, lambda s: unescaped(s["text"], control)), "")
    read = formatted.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
