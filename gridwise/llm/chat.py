"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, runs of one role become one block, and the blocks
are concatenated. A block is ``<|role|>`` text ``<|end|>``; the texts of merged turns are separated by ``<|and|>``.
In roles and texts ``&`` becomes ``&amp;`` and ``<`` becomes ``&lt;``, in roles ``>`` becomes ``&gt;`` too, so no text can
hold a mark of this template and no role can end its own, and the turns can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END, AND = "<|end|>", "<|and|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv, formatted, loss_spans) per conversation.

    loss_spans: (start, end) in code points of formatted for each text of loss_role, in order. Turns go by turn, null
    first, and ties by role and then text, so that repeated turns keep a fixed order; each row stays a turn. A null
    text or role is empty. Rows with a null conversation form one conversation. Other columns are dropped. An empty
    table gives none. What is collected is one conversation, which a formatted text has to hold anyway.
    """
    said = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Where a text starts: what all turns up to it take, the marks before them with them.
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    before = F.lag("role").over(order)
    head = F.length(escape_role(F.col("role"))) + 4
    said = said.withColumn("ahead", F.when(before.isNull(), head).when(before != F.col("role"), head + len(END)).otherwise(len(AND)))
    size = F.length(escape(F.col("text")))
    end = F.sum(F.col("ahead") + size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    turn = F.struct("turn", "role", "text", (F.col("end") - size).alias("start"), "end")
    turns = said.withColumn("end", end).select("conv", turn.alias("t")).groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # The first turn of each run, and one past the last turn as the end of the last run.
    starts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    runs = F.transform(
        F.arrays_zip(F.col("starts").alias("a"), F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns") + 1)).alias("b")),
        lambda r: F.struct(F.element_at("turns", r["a"])["role"].alias("role"), F.transform(F.slice("turns", r["a"], r["b"] - r["a"]), lambda t: escape(t["text"])).alias("texts")),
    )
    block = lambda r: F.concat(F.lit("<|"), escape_role(r["role"]), F.lit("|>"), F.array_join(r["texts"], AND), F.lit(END))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return turns.withColumn("starts", starts).select(F.col("conv").alias(conv_col), F.array_join(F.transform(runs, block), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) from a formatted conversation, one per turn before merging."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, F.locate("|>", b) + 2), r"<\|and\|>", -1),
                lambda t: F.struct(unescape(F.replace(F.substr(b, F.lit(3), F.locate("|>", b) - 3), F.lit("&gt;"), F.lit(">"))).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def under_mask(formatted: Column, spans: Column) -> Column:
    """The text that the spans mark, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
