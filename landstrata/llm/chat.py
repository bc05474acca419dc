"""Chat formatting with column expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one role become one block, and blocks are
concatenated:  ``<s>[ROLE]role[/ROLE]text[TURN]text</s>``.  A backslash escapes: texts and roles double their own
backslashes, and a control string inside them gets one after its first character, so no control string survives in a
text and ``unescape`` restores the text exactly.

Defined cases: a null text or role counts as empty; turns with equal number are ordered by role, then text, and each
stays; a null turn number sorts first; rows with a null conversation id form one conversation; other columns are
ignored; no rows give no rows. A conversation has to fit into one row, as its formatted text does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of this template, then those of common other ones, which are escaped too.
CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[TURN]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
            "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def escape(text: Column) -> Column:
    """The text without control strings; ``unescape`` undoes it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROLS:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    ``loss_spans`` holds (start, length) in code points of every text of the role ``learn`` inside ``formatted``.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                 F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def starts_block(t: Column, i: Column) -> Column:
        return (i == 0) | (t["role"] != F.get(F.col("turns"), i - 1)["role"])

    starts = F.filter(
        F.transform("turns", lambda t, i: F.when(starts_block(t, i), i)), lambda i: i.isNotNull())
    blocks = F.transform(
        F.col("starts"),
        lambda s, k: F.struct(
            F.get(F.col("turns"), s)["role"].alias("role"),
            F.transform(
                F.slice(F.col("turns"), s + 1, F.coalesce(F.get(F.col("starts"), k + 1), F.size("turns")) - s),
                lambda t: escape(t["text"])).alias("texts")),
    )
    heads = F.transform("blocks", lambda b: F.concat(F.lit("<s>[ROLE]"), escape(b["role"]), F.lit("[/ROLE]")))
    bodies = F.transform("blocks", lambda b: F.array_join(b["texts"], "[TURN]"))
    formatted = F.array_join(
        F.transform("heads", lambda h, i: F.concat(h, F.get(F.col("bodies"), i), F.lit("</s>"))), "")

    # the end of each text within its block, then the place of each block, by running sums
    def spans_of(block: Column, at: Column) -> Column:
        return F.aggregate(
            block["texts"],
            F.struct(at.alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x) + F.lit(len("[TURN]"))).alias("at"),
                F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"),
                                                        F.length(x).cast("bigint").alias("length")))).alias("spans")),
            lambda acc: acc["spans"])

    loss = F.aggregate(
        F.sequence(F.lit(0), F.size("blocks") - 1),
        F.struct(F.lit(0).cast("bigint").alias("at"),
                 F.array().cast("array<array<struct<start:bigint,length:bigint>>>").alias("spans")),
        lambda acc, i: F.struct(
            (acc["at"] + F.length(F.get(F.col("heads"), i)) + F.length(F.get(F.col("bodies"), i))
             + F.lit(len("</s>"))).alias("at"),
            F.when(F.get(F.col("blocks"), i)["role"] == F.lit(learn), F.concat(acc["spans"], F.array(
                spans_of(F.get(F.col("blocks"), i), acc["at"] + F.length(F.get(F.col("heads"), i))))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: F.flatten(acc["spans"]))
    return (
        sorted_turns.withColumn("starts", starts).withColumn("blocks", blocks)
        .withColumn("heads", heads).withColumn("bodies", bodies)
        .select("conv_id", formatted.alias("formatted"), loss.alias("loss_spans"))
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.split(formatted, "</s>", -1)
    blocks = F.slice(parts, 1, F.size(parts) - 1)

    def turns_of(block: Column) -> Column:
        halves = F.split(block, r"\[/ROLE\]", 2)
        return F.transform(
            F.split(F.get(halves, F.lit(1)), r"\[TURN\]", -1),
            lambda x: F.struct(unescape(F.substr(F.get(halves, F.lit(0)), F.lit(len("<s>[ROLE]") + 1))).alias("role"),
                               unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order and with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
