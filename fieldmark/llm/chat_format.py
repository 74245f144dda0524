"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted (by turn, then role, then text, as they are given;
nulls first, null role and text being empty). Adjacent turns of one role are merged into one block: the blocks' starts are
the places where the role changes, and a block has the array of its turns' texts. The blocks' pieces are concatenated:

    <|im_start|>role NEWLINE text [<|im_sep|>text ...] <|im_end|>NEWLINE

Escaping: in roles and texts "&" becomes "&amp;" and "<|" becomes "&lt;|", so no control string can occur inside;
a role's line breaks become "&#10;". read_turns() undoes both.

The loss mask is kept by segment: segments is an array of (text, loss) whose texts concatenate to formatted; loss is
true for the texts of assistant turns alone.

Defined cases: null text or role is empty; null turn sorts first; null conversation ids are one conversation;
repeated rows stay as turns of their own; an empty table gives none. Other columns of the input are left out, whatever
their names. Texts and conversations are of any length that fits in a row, which one conversation's result is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv, formatted, segments."""
    given = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = df.select(F.col(conv).alias("conv"), given.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    starts = F.filter(F.transform("turns", lambda t, i: F.when((i > 0) & (t["role"] == F.get("turns", i - 1)["role"]), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    turns = turns.select("conv", "turns", starts.alias("starts"))

    def block(start: Column, k: Column) -> Column:
        upto = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        role_ = F.get("turns", start)["role"]
        texts = F.transform(F.slice("turns", start + 1, upto - start), lambda t: escape(t["text"]))
        return F.struct(F.replace(escape(role_), F.lit("\n"), F.lit("&#10;")).alias("role"), (role_ == LOSS_ROLE).alias("loss"), texts.alias("texts"))

    def piece(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    def pieces(b: Column) -> Column:
        head = F.array(piece(F.concat(F.lit(START), b["role"], F.lit("\n")), F.lit(False)))
        body = F.flatten(F.transform(b["texts"], lambda x, i: F.array(piece(F.when(i == 0, F.lit("")).otherwise(F.lit(SEP)), F.lit(False)), piece(x, b["loss"]))))
        return F.concat(head, body, F.array(piece(F.lit(END + "\n"), F.lit(False))))

    blocks = turns.select("conv", F.transform("starts", block).alias("blocks"))
    done = blocks.select(F.col("conv").alias(conv), F.filter(F.flatten(F.transform("blocks", pieces)), lambda s: s["text"] != "").alias("segments"))
    return done.select(conv, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """array of (role, text): the turns as they were, read from the formatted string."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turns(block: Column) -> Column:
        role = F.replace(F.substring_index(block, "\n", 1), F.lit("&#10;"), F.lit("\n"))
        body = F.regexp_replace(block, r"(?s)^[^\n]*\n|<\|im_end\|>\n$", "")
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
