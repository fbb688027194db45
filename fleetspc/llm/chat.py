"""Chat formatting by Spark expressions.

The turns of a conversation are collected as structs, sorted, merged where the same role speaks
again, and concatenated. The template, with control strings in brackets:

    <s>role[INST]text[NEXT]text[/INST]<s>assistant[ANS]text</s>

[NEXT] stands between merged turns, so that every turn can be read back. A control string inside
a role or text gets a `~` after its bracket, one more than it had, and loses it on reading. The
loss mask is a list of spans of the formatted text that cover the assistant's texts and no more.

NULL text and role are empty. Turns of equal number are ordered by role, then text; NULL numbers
come first. A repeated row is a turn of its own. A conversation without rows is not there; NULL
conv_id is a conversation like any other. Further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"

_SQUARE = r"\[(~*(?:INST\]|/INST\]|ANS\]|NEXT\]))"
_ANGLE = r"<(~*(?:s>|/s>))"
_SQUARE_ESCAPED = r"\[~(~*(?:INST\]|/INST\]|ANS\]|NEXT\]))"
_ANGLE_ESCAPED = r"<~(~*(?:s>|/s>))"
_BLOCK = r"(?s)<s>(.*?)(\[ANS\]|\[INST\])(.*?)(?:</s>|\[/INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _SQUARE, "[~$1"), _ANGLE, "<~$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _SQUARE_ESCAPED, "[$1"), _ANGLE_ESCAPED, "<$1")


def _run_starts(turns: Column) -> Column:
    """Numbers, from 1, of the turns whose role differs from that of the turn before."""
    return F.filter(
        F.sequence(F.lit(1), F.size(turns)),
        lambda i: (i == 1) | (F.get(turns, i - 2)["role"] != F.get(turns, i - 1)["role"]),
    )


def _merged(turns: Column, starts: Column) -> Column:
    """Runs of adjacent turns of one role, as structs (role, parts)."""

    def run(start: Column, k: Column) -> Column:
        following = F.coalesce(F.get(starts, k + 1), F.size(turns) + 1)
        parts = F.transform(F.slice(turns, start, following - start), lambda t: t["text"])
        return F.struct(F.get(turns, start - 1)["role"].alias("role"), parts.alias("parts"))

    return F.transform(starts, run)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): spans are structs (start, end), code points, end exclusive."""
    row = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    collected = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("_turns"))
    runs = collected.withColumn("_starts", _run_starts(F.col("_turns")))
    runs = runs.withColumn("_runs", _merged(F.col("_turns"), F.col("_starts")))

    def pieces(r: Column) -> Column:
        """Strings of one run and whether they are under the mask."""
        speaks = r["role"] == ASSISTANT
        head = F.concat(F.lit("<s>"), escape(r["role"]), F.when(speaks, "[ANS]").otherwise("[INST]"))
        parts = F.transform(
            r["parts"],
            lambda text, i: F.struct(
                F.when(i == 0, head).otherwise(F.lit("[NEXT]")).alias("before"),
                escape(text).alias("text"), speaks.alias("loss"),
            ),
        )
        tail = F.struct(
            F.when(speaks, "</s>").otherwise("[/INST]").alias("before"), F.lit("").alias("text"), F.lit(False).alias("loss")
        )
        return F.concat(parts, F.array(tail))

    laid = runs.select("conv_id", F.flatten(F.transform("_runs", pieces)).alias("_pieces"))

    def advance(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["before"])
        end = start + F.length(piece["text"])
        span = F.struct(start.alias("start"), end.alias("end"))
        spans = F.when(piece["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["before"], p["text"])), "")
    return laid.select("conv_id", text.alias("formatted"), F.aggregate("_pieces", start, advance)["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, structs (role, text) in order."""
    blocks = F.arrays_zip(
        F.regexp_extract_all(formatted, F.lit(_BLOCK), 1).alias("role"),
        F.regexp_extract_all(formatted, F.lit(_BLOCK), 3).alias("body"),
    )
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(b["body"], r"\[NEXT\]", -1),
                lambda text: F.struct(unescape(b["role"]).alias("role"), unescape(text).alias("text")),
            ),
        )
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, without anything between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )
