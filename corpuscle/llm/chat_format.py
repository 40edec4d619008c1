"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A conversation is rendered turn by turn as ``<|turn|>role<|text|>text<|end|>``. Control strings of this and of other common
templates that occur inside a role or a text are broken by a backslash, and backslashes are doubled, so that ``unescape``
gives the text back exactly and no text can open or close a turn. Every assistant turn then becomes an example of its
own: all preceding turns and its opening are context, and only its text is trainable. What follows the last assistant turn
makes one last, untrainable row, so the output holds every turn.

Every example carries its whole context as text, whatever its length, so the output grows with the square of a
conversation's turns, as the expansion does by its nature. Contexts are cut one row at a time and never kept together.

Rows are ordered by turn, equal turns by role and text; a null turn comes first, null role and text are empty, a null
conv_id is a conversation of its own. Repeated rows are repeated turns. Tables without rows give no rows.

Scale: one shuffle by conv_id, which expansion and digests keep. A digest over a conversation needs its turns in one place, so one row holds one
conversation's text; that bounds a conversation, not the number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Openings of control strings of this template and of common public ones.
CONTROL = r"\\|<(?=\||/?s>|</?SYS>>|/?(?:start|end)_of_turn>|/?think>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, examples (array of start and end of each trainable text) of rows of conv_id, turn, role, text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    opening = F.concat(F.lit(TURN), escape(role), F.lit(TEXT))
    body = escape(text)
    rows = turns.select(
        "conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("at"), opening.alias("o"), body.alias("b"),
    ).select("conv_id", F.struct("at", "o", "b").alias("r"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, r: Column) -> Column:
        start = acc["at"] + F.length(r["o"])
        end = start + F.length(r["b"])
        here = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(r["at"]["role"] == "assistant", F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

    return whole.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: F.concat(r["o"], r["b"], F.lit(END))), "").alias("formatted"),
        F.aggregate("rows", zero, step, lambda acc: acc["spans"]).alias("spans"),
    )


def expand(rendered: DataFrame) -> DataFrame:
    """One row an example: conv_id, example, context, target, trainable, last. The rest after the last reply is not trainable."""
    size = F.length("formatted")
    last = F.when(F.size("spans") > 0, F.element_at("spans", -1)["end"] + len(END)).otherwise(F.lit(0))
    replies = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("trainable"), (s["end"] + len(END) == size).alias("last")))
    rest = F.array(F.struct(last.alias("start"), size.alias("end"), F.lit(False).alias("trainable"), F.lit(True).alias("last")))
    pieces = F.concat(replies, F.when(last < size, rest).otherwise(F.array().cast("array<struct<start:int,end:int,trainable:boolean,last:boolean>>")))
    text = lambda start, end: F.substring(F.col("formatted"), start + 1, end - start)
    return rendered.select("conv_id", "formatted", F.posexplode(pieces).alias("example", "p")).select(
        "conv_id", "example", text(F.lit(0), F.col("p.start")).alias("context"), text(F.col("p.start"), F.col("p.end")).alias("target"), "p.trainable", "p.last"
    )


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a rendering."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: F.length(p) > 0)

    def one(p: Column) -> Column:
        cut = F.split(p, r"<\|text\|>|<\|end\|>", 3)
        return F.struct(unescape(F.get(cut, F.lit(0))).alias("role"), unescape(F.get(cut, F.lit(1))).alias("text"))

    return F.transform(parts, one)


def digests(turns: DataFrame) -> DataFrame:
    """What the examples say when read back, a row for each conversation. formatted_chars counts the characters of all examples and of the rest once."""
    closed = F.when(F.col("trainable"), F.lit(END)).otherwise(F.lit(""))
    shown = F.concat(F.when(F.col("trainable"), F.col("context")).otherwise(F.lit("")), "target", closed)
    said = F.when(F.col("last"), F.concat("context", "target", closed))  # the last example holds all turns
    reply = F.when(F.col("trainable"), F.struct("example", F.col("target")))
    read = expand(render(turns)).select("conv_id", said.alias("said"), reply.alias("reply"), F.length(shown).alias("chars"))
    whole = read.groupBy("conv_id").agg(F.first("said", ignorenulls=True).alias("said"), F.sort_array(F.collect_list("reply")).alias("replies"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("replies", lambda x: unescape(x["target"])), "")
    parsed = whole.select("conv_id", parse(F.col("said")).alias("t"), loss.alias("loss"), "formatted_chars", F.size("replies").cast("bigint").alias("n_examples"))
    return parsed.select(
        "conv_id",
        F.size("t").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
