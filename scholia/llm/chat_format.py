"""Conversations as one training text each, with a loss mask, and back again: Spark expressions only.

The turns of a conversation are collected as structs and sorted; runs of turns of one role become one block, whose
texts a separator parts; blocks are concatenated. Marks inside texts and roles are escaped by one more backslash
between '<' and '|', which read_back() takes out again, so that every conversation can be read from its text.

  <|im_start|>role\ntext<|im_sep|>text of the next turn of that role<|im_end|>\n
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import let

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """text without '<|': '<', any backslashes, '|' get one more backslash."""
    return F.regexp_replace(text, F.lit(r"<(\\*)\|"), F.lit(r"<\\$1|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<\\(\\*)\|"), F.lit("<$1|"))


def role_line(role: Column) -> Column:
    """A role as one line: line feeds are written \\n, backslashes are doubled."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def role_of_line(line: Column) -> Column:
    pieces = F.split(unescaped(line), r"\\\\")
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _blocks(turns: Column) -> Column:
    """Runs of adjacent turns of one role: (role, texts), in order. Linear: a run is a slice between two starts."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(turns, i - 2)["role"] != F.get(turns, i - 1)["role"]))

    def block(starts: Column) -> Column:
        run = lambda s, k: F.slice(turns, s, F.coalesce(F.get(starts, k + 1), n + 1) - s)
        return F.transform(starts, lambda s, k: F.struct(F.get(turns, s - 1)["role"].alias("role"), F.transform(run(s, k), lambda t: t["text"]).alias("texts")))

    return let(starts, block)


def _segments(block: Column, learnt: tuple[str, ...]) -> Column:
    """A block as pieces (text, loss): its header, its texts with separators between, its end."""
    loss = block["role"].isin(*learnt)
    piece = lambda t, on: F.struct(t.alias("text"), on.alias("loss"))
    texts = F.transform(block["texts"], lambda t, k: F.array(
        piece(F.when(k > 0, F.lit(SEPARATOR)).otherwise(F.lit("")), F.lit(False)), piece(escaped(t), loss)))
    return F.concat(
        F.array(piece(F.concat(F.lit(START), role_line(block["role"]), F.lit("\n")), F.lit(False))),
        F.flatten(texts),
        F.array(piece(F.lit(END + "\n"), F.lit(False))),
    )


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, segments): for each conversation its text, and the same text in pieces with the loss mask
    (loss is true for what a model learns to say: the texts of the roles in `learnt`).

    Turns go by turn, then role, then text, nulls first; repeated rows stay. A null text or role is empty. No id says
    that rows with a null conv_id belong together: each is a conversation of its own, with a null id. An empty table
    has no conversations; other columns are not looked at. A conversation is one row here, so it must fit in one.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("t"))
    known = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    every = known.union(rows.filter("conv_id IS NULL").select("conv_id", F.array("t")))
    blocks = every.select("conv_id", _blocks(F.col("turns")).alias("blocks"))
    pieces = blocks.select("conv_id", F.flatten(F.transform("blocks", lambda b: _segments(b, learnt))).alias("segments"))
    return pieces.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds, in order."""

    def turns(block: Column) -> Column:
        def body(b: Column) -> Column:
            line = F.substring_index(b, "\n", 1)
            texts = F.split(F.substr(b, F.length(line) + 2), r"<\|im_sep\|>")
            return let(role_of_line(line), lambda role: F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text"))))

        return let(F.substring_index(block, END, 1), body)

    blocks = F.split(formatted, r"<\|im_start\|>")
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), turns))


def learnt_text(segments: Column) -> Column:
    """All text under the loss mask, escapes undone, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
