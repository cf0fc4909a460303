"""Preference pairs as training text: one shared prompt, two completions with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def rendered(role: Column, text: Column) -> Column:
    """A turn as text; nulls count as empty."""
    return F.concat(_header(role), F.coalesce(text, F.lit("")), F.lit(f"{END}\n"))


def _header(role: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.coalesce(role, F.lit("")), F.lit("\n"))


def _completion(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: rendered(t.role, t.text)), "")


def _spans(turns: Column) -> Column:
    """Character spans of a completion that carry loss: trained turns with their end mark."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(s: Column, t: Column) -> Column:
        size = F.length(rendered(t.role, t.text))
        head = F.length(_header(t.role))
        span = F.struct((s.at + head).alias("start"), (s.at + size - 1).alias("end"))
        kept = F.when(t.role == TRAINED, F.concat(s.spans, F.array(span))).otherwise(s.spans)
        return F.struct((s.at + size).alias("at"), kept.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s.spans)


def format_pairs(turns: DataFrame) -> DataFrame:
    """Turns (pair_id, side 'chosen' or 'rejected', turn, role, text) to one row per pair.

    ``prompt`` renders the longest common prefix of turns (same role and text, nulls equal) once; ``chosen``
    and ``rejected`` render what follows; ``*_spans`` are the character spans that carry loss. Turns
    stand in the order of their numbers, ties by role and text. A pair with one side only has an empty
    prompt and the other completion empty; two equal sides have two empty completions. Rows with
    a null pair id or another side are passed over. A conversation is one row, as a document is.
    """
    item = F.struct("turn", "role", "text")
    sides = turns.filter(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).groupBy("pair_id")
    whole = sides.agg(
        *(F.array_sort(F.collect_list(F.when(F.col("side") == s, item))).alias(s) for s in ("chosen", "rejected"))
    )
    same = F.zip_with(
        "chosen", "rejected", lambda a, b: F.coalesce(a.role.eqNullSafe(b.role) & a.text.eqNullSafe(b.text), F.lit(False))
        & a.isNotNull() & b.isNotNull()
    )
    # the first place that differs, from 1; none: both are as long as the shorter
    first = F.array_position(F.concat(same, F.array(F.lit(False))), False).cast("int")
    cut = whole.withColumn("shared", first - 1)
    rest = {s: F.slice(F.col(s), F.col("shared") + 1, F.size(s)) for s in ("chosen", "rejected")}
    return cut.select(
        "pair_id",
        F.col("shared").alias("prompt_turns"),
        _completion(F.slice("chosen", F.lit(1), F.col("shared"))).alias("prompt"),
        *(_completion(rest[s]).alias(s) for s in rest),
        *(_spans(rest[s]).alias(f"{s}_spans") for s in rest),
    )


def echo_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs for ``format_pairs`` out of single conversations.

    Chosen is the conversation up to its last assistant turn; rejected is the same, but that turn only echoes the
    text before it. Conversations without a turn before the last assistant turn give no pair. Rows with
    a null conv_id or turn are passed over.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").dropna(subset=["conv_id", "turn"])
    own = Window.partitionBy("conv_id")
    order = own.orderBy("turn", "role", "text")
    placed = rows.withColumns(
        {"at": F.row_number().over(order), "echo": F.lag("text").over(order), "line": F.lag("turn").over(order)}
    )
    last = F.max(F.when(F.col("role") == TRAINED, F.col("at"))).over(own)
    upto = placed.withColumn("last", last).filter((F.col("last") > 1) & (F.col("at") <= F.col("last")))
    reply = F.when(F.col("at") == F.col("last"), F.col("echo")).otherwise(F.col("text"))
    both = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")),
        F.struct(F.lit("rejected").alias("side"), reply.alias("text")),
    )
    return upto.select(F.col("conv_id").alias("pair_id"), F.col("at").alias("turn"), "role", F.explode(both).alias("s")).select(
        "pair_id", "s.side", "turn", "role", "s.text"
    )
