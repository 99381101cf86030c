"""Chat formatting by cumulative-snapshot collapse.

Chat logs often hold the same conversation several times, each time a few turns longer. Every turn
gets the hash of the prefix that ends with it; a conversation whose whole hash is a proper prefix of
another one is removed by an anti-join, and only the maximal ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlledger.llm.common import hashes

#: A conversation is cut at these turn numbers, so that a giant one is spread over tasks.
SLICE_TURNS = 1024
PART_TURNS = 256


def prefixes(turns: DataFrame) -> DataFrame:
    """For each turn, the length and hash of its prefix: conv_id, turn, n, h1, h2.

    A turn counts as (turn number, role, text); the prefix hash is the XOR of the hashes of its
    turns, so slices of one conversation are hashed apart and then combined.
    """
    h1, h2 = hashes(F.col("turn"), F.col("role"), F.col("text"))
    each = (
        turns.select("conv_id", "turn", h1.alias("h1"), h2.alias("h2"))
        .distinct()  # a repeated row counts once
        .withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE_TURNS), F.lit(-1)))
    )
    totals = each.groupBy("conv_id", "slice").agg(
        F.count("*").alias("n0"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2")
    )
    before = (
        Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = totals.select(
        F.col("conv_id").alias("c"),
        F.col("slice").alias("s"),
        *[
            F.coalesce(f(name).over(before), F.lit(0)).alias(name)
            for f, name in ((F.sum, "n0"), (F.bit_xor, "x1"), (F.bit_xor, "x2"))
        ],
    )
    within = (
        Window.partitionBy("conv_id", "slice")
        .orderBy("turn", "h1", "h2")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = each.select(
        "conv_id",
        "slice",
        "turn",
        F.count("*").over(within).alias("n"),
        F.bit_xor("h1").over(within).alias("h1"),
        F.bit_xor("h2").over(within).alias("h2"),
    )
    return running.join(
        starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("s"))
    ).select(
        "conv_id",
        "turn",
        (F.col("n") + F.col("n0")).alias("n"),
        F.col("h1").bitwiseXOR(F.col("x1")).alias("h1"),
        F.col("h2").bitwiseXOR(F.col("x2")).alias("h2"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """The conversations that are no proper prefix of another: conv_id, n_turns, n_copies.

    Of equal conversations the one with the smallest conv_id stays; n_copies counts them.
    """
    steps = prefixes(turns)
    finals = steps.groupBy("conv_id").agg(F.max(F.struct("n", "h1", "h2")).alias("f"))
    whole = finals.groupBy("f.n", "f.h1", "f.h2").agg(
        F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("first"),
        F.count("*").alias("n_copies"),
    )
    ends = finals.select(F.col("conv_id").alias("c"), F.col("f.n").alias("length"))
    proper = (
        steps.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("n") < F.col("length")))
        .select("n", "h1", "h2")
        .distinct()
    )
    return whole.join(proper, ["n", "h1", "h2"], "left_anti").select(
        F.col("first.conv_id").alias("conv_id"), F.col("n").alias("n_turns"), "n_copies"
    )


def turn_text() -> Column:
    """One turn in the chat template; a null role or text is empty."""
    return F.concat(
        F.lit("<|"),
        F.coalesce(F.col("role"), F.lit("")),
        F.lit("|>\n"),
        F.coalesce(F.col("text"), F.lit("")),
        F.lit("<|end|>\n"),
    )


def format_chats(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Render the maximal conversations: conv_id, n_turns, n_copies, part, rendered.

    Args:
        conversations: conv_id, turn, role, text; other columns are ignored.
        part_turns: turns in one output row. A longer conversation takes several rows, in the order
            of ``part``, so no row grows without bound.

    Turns are ordered by turn number (null first), then by rendered text. Repeated rows count once.
    Rows with a null conv_id form one conversation. A null role or text renders empty but differs
    from an empty one when conversations are compared. An empty table gives an empty result.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    kept = maximal(turns)
    shown = (
        turns.withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE_TURNS), F.lit(-1)))
        .join(
            kept.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))
        )
        .drop("c")
        .dropDuplicates(["conv_id", "turn", "role", "text"])
        .withColumn("line", turn_text())
    )
    counts = shown.groupBy("conv_id", "slice").agg(F.count("*").alias("n"))
    before = (
        Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select(
        F.col("conv_id").alias("c"),
        F.col("slice").alias("s"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy("turn", "line"))
    placed = shown.withColumn("place", place - 1).join(
        starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("s"))
    )
    at = F.col("start") + F.col("place")
    return (
        placed.select(
            "conv_id",
            "n_turns",
            "n_copies",
            F.floor(at / part_turns).alias("part"),
            F.struct(at.alias("at"), "line").alias("piece"),
        )
        .groupBy("conv_id", "n_turns", "n_copies", "part")
        .agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
        .select(
            "conv_id",
            "n_turns",
            "n_copies",
            "part",
            F.array_join(F.transform("pieces", lambda p: p["line"]), "").alias("rendered"),
        )
    )
