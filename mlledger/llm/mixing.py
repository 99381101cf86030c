"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Among all document rates whose words meet the targets and
that stay at or below ``most`` copies, the one nearest to taking every document once (in relative
entropy) is ``min(most, exp(lambda_source * size / mean size))``. The multipliers solve the convex
dual by Newton steps; each step is one aggregation over the (source, size, count) cells of the
corpus. Rates are then rounded into copies, from the largest documents to the smallest, with the
error carried on, so that a source ends within about half of its smallest document of its target.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlledger.llm.common import fresh_name, hashes, numbered, stored

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """source, number, source_size, target: shares by weight, with the excess over ``most`` times
    a source's size dealt to the others. Sources in code point order, null last, repeat the weights.
    The windows run over one row for each source."""
    everything = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", "number")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    level = (F.col("all") - F.col("full_before")) / F.col("weight_onward")
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("number", F.row_number().over(order) - 1)
        .withColumn("weight", listed[F.col("number") % len(weights)])
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(everything) * float(share))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_onward", F.sum("weight").over(onward))
        .withColumn("full", F.col("cap") <= F.col("weight") * level)
        .withColumn("full_caps", F.sum(F.when(F.col("full"), F.col("cap"))).over(everything))
        .withColumn("free", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything))
        .select(
            "source",
            F.col("number").cast("int").alias("number"),
            "source_size",
            F.when(F.col("full"), F.col("cap"))
            .otherwise(
                (F.col("all") - F.coalesce("full_caps", F.lit(0.0))) * F.col("weight") / F.col("free")
            )
            .alias("target"),
        )
    )


def tilt(most: float) -> Column:
    """The rate of a cell: exp(lambda * x), at most ``most``."""
    return F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("x"), F.lit(60.0))))


def solve(cells: DataFrame, most: float, tolerance: float, steps: int) -> DataFrame:
    """number, lam for each source with 0 < target < most * source_size.

    Safeguarded Newton: a step that leaves the bracket of its source is replaced by halving it.
    The driver sees one number a step, the largest relative error.
    """
    lam = stored(
        cells.groupBy("number").agg(
            F.lit(0.0).alias("lam"),
            (F.lit(0.0) + F.least(F.lit(0.0), F.log(F.first("target") / F.first("source_size"))))
            .alias("low_log"),
            F.min("x").alias("least"),
            F.first("target").alias("target"),
        )
        .select(
            "number",
            "lam",
            (F.col("low_log") / F.col("least")).alias("low"),
            (F.lit(float(np.log(most))) / F.col("least")).alias("high"),
            "target",
        ),
        "mix-lambda",
    )
    words = F.col("n") * F.col("size")
    for _ in range(steps):
        rated = cells.drop("target").join(lam, "number").withColumn("rate", tilt(most))
        moments = rated.groupBy("number", "lam", "low", "high", "target").agg(
            F.sum(words * F.col("rate")).alias("got"),
            F.sum(F.when(F.col("rate") < most, words * F.col("x") * F.col("rate"))).alias("slope"),
        )
        over = F.col("got") > F.col("target")
        newton = F.try_divide(F.col("target") - F.col("got"), F.col("slope")) + F.col("lam")
        lam = stored(
            moments.withColumn("low", F.when(over, F.col("low")).otherwise(F.col("lam")))
            .withColumn("high", F.when(over, F.col("lam")).otherwise(F.col("high")))
            .withColumn("error", F.abs(F.col("got") / F.col("target") - 1))
            .withColumn(
                "next",
                F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(
                    (F.col("low") + F.col("high")) / 2
                ),
            )
            .select(
                "number",
                F.when(F.col("error") <= tolerance, F.col("lam"))
                .otherwise(F.col("next"))
                .alias("lam"),
                "low",
                "high",
                "target",
                "error",
            ),
            "mix-lambda",
        )
        worst = lam.agg(F.max("error")).first()[0]
        lam = lam.drop("error")
        if worst is None or worst <= tolerance:
            break
    return lam.select("number", "lam")


def round_cells(cells: pd.DataFrame, most: int) -> pd.DataFrame:
    """Whole copies for the cells of one source, largest documents first, carrying the error."""
    cells = cells.sort_values("size", ascending=False)
    carried, copies = 0.0, []
    for size, n, rate in zip(cells["size"], cells["n"], cells["rate"], strict=True):
        wanted = n * rate
        whole = int(min(most * n, max(0, np.floor(wanted + carried / size + 0.5))))
        carried += (wanted - whole) * size
        copies.append(whole)
    return cells[["number", "size", "n", "rate"]].assign(copies=copies)


def mix(
    documents: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    tolerance: float = 1e-3,
    steps: int = 40,
) -> DataFrame:
    """How often the mix takes each document.

    Returns doc_id, source, size (words), source_size, target (words of its source), rate (the
    tilted rate), copies, taken (words taken, repeats counted).

    Args:
        documents: doc_id, text, source; other columns are ignored.
        weights: weights of the sources in code point order, null last, repeated as needed.
        share: words of the mix over words of the corpus.
        most: most copies of a document.
        tolerance: relative error at which the Newton steps stop; rounding makes up for it.
        steps: most Newton steps.

    A null text has no words; a document without words is taken once, as no words. A null source is
    a source of its own. Repeated rows are documents of their own. An empty table gives an empty
    result. Equal inputs give equal outputs, whatever their partitioning. One task rounds a source,
    over one row for each distinct size in it, never over its documents.
    """
    sizes = stored(
        documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes"
    )
    targets = stored(source_targets(sizes, weights, share, most), "mix-targets")
    same = sizes["source"].eqNullSafe(targets["source"])
    slim = stored(
        sizes.join(targets, same).select(
            "doc_id", sizes["source"], "size", "number", "source_size", "target"
        ),
        "mix-documents",
    )
    cells = stored(
        slim.filter("size > 0")
        .groupBy("number", "size")
        .agg(
            F.count("*").alias("n"),
            F.first("source_size").alias("source_size"),
            F.first("target").alias("target"),
        )
        .withColumn(
            "mean",
            F.col("source_size") / F.sum("n").over(Window.partitionBy("number")),
        )
        .withColumn("x", F.col("size") / F.col("mean"))
        .drop("mean"),
        "mix-cells",
    )
    free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(most))
    lam = solve(cells.filter(free), most, tolerance, steps)
    rated = cells.join(lam, "number", "left").select(
        "number",
        "size",
        "n",
        F.when(free, tilt(most))
        .when(F.col("target") > 0, F.lit(float(most)))
        .otherwise(0.0)
        .alias("rate"),
    )
    rounded = rated.groupBy("number").applyInPandas(
        lambda cell: round_cells(cell, most),
        "number int, size long, n long, rate double, copies long",
    )
    copies = F.floor(F.col("copies") / F.col("n")) + F.when(
        F.col("place") < F.col("copies") % F.col("n"), 1
    ).otherwise(0)
    place = fresh_name(slim, "place")
    return (
        numbered(slim, ["number", "size"], ["doc_id"], place)
        .join(rounded, ["number", "size"], "left")
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            F.coalesce("rate", F.lit(1.0)).alias("rate"),
            F.coalesce(copies, F.lit(1)).cast("int").alias("copies"),
        )
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


#: Copies of one row that are dealt as one run.
RUN = 4096


def mixed_documents(documents: DataFrame, **settings: object) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns.

    A document without words stays as it is. Rows with equal doc_id, source and text stand for each
    other: their copies come from the first of them in the order of the other columns. The mix is
    decided on hashes; texts move once, to meet the number of their copies.
    """
    columns = documents.columns
    a, b, times, start = (fresh_name(documents, c) for c in ("_k1", "_k2", "_times", "_start"))
    k1, k2 = hashes(F.col("doc_id"), F.col("source"), F.col("text"))
    keyed = documents.withColumns({a: k1, b: k2})
    mixed = mix(keyed.select(F.struct(a, b).alias("doc_id"), "source", "text"), **settings)
    taken = stored(
        mixed.groupBy(F.col(f"doc_id.{a}").alias(a), F.col(f"doc_id.{b}").alias(b)).agg(
            F.count("*").alias("n"), F.sum("copies").alias(times)
        ),
        "mix-taken",
    )
    rows, most = taken.agg(F.max("n"), F.max(times)).first()
    if (rows or 0) > 1:
        order = Window.partitionBy(a, b).orderBy(*[c for c in columns if c != "text"])
        keyed = keyed.withColumn(start, F.row_number().over(order)).filter(F.col(start) == 1)
    runs = F.explode(F.sequence(F.lit(0), F.col(times) - 1, F.lit(RUN)))
    dealt = (
        keyed.drop(start)
        .join(taken.drop("n").filter(F.col(times) > 0), [a, b])
        .withColumn(start, runs)
    )
    if (most or 0) > RUN:
        many = F.col(times) > RUN
        dealt = dealt.filter(~many).union(dealt.filter(many).repartition(start, a, b))
    until = F.least(F.col(times), F.col(start) + RUN) - 1
    return dealt.withColumn(start, F.explode(F.sequence(start, until))).select(*columns)
