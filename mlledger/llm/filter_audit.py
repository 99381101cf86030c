"""Filter interaction audit: what each of five filters removes, in every order of application.

A left-semi join on hash, exact text and a smaller doc_id marks copies; the marks are united with the
failures that a text shows by itself, and the combinations of failures are counted for each part.
All orders are then read off these counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlledger.llm.common import hashes, stored

FILTERS = "ABCDE"
BITS = {letter: 1 << i for i, letter in enumerate(FILTERS)}
SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 100, 80, 10
SIGNS = "[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Copies of one text beyond this number are dealt to several tasks.
SLICE_ROWS = 4096
#: Most hashes of such texts, which are broadcast; the slices grow with the table beyond it.
MOST_HOT = 100_000


def own_failures(text: Column) -> Column:
    """The failures A to D of a text, as bits."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n,
        "C": 100 * upper > MAX_UPPER_PERCENT * F.length(text),
        "D": text.rlike(SIGNS),
    }
    bits = F.lit(0)
    for letter, failed in fails.items():
        bits = bits + F.when(failed, BITS[letter]).otherwise(0)
    return bits


def with_hashes(documents: DataFrame) -> DataFrame:
    """doc_id, part, text (null as empty), h1, h2 (of the text)."""
    docs = documents.select(
        "doc_id",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    h1, h2 = hashes(F.col("text"))
    return docs.select("*", h1.alias("h1"), h2.alias("h2"))


def later_copies(documents: DataFrame, facts: DataFrame, slice_rows: int) -> DataFrame:
    """doc_id, part, h1, h2 of the rows whose text some row with a smaller doc_id has.

    Only texts whose hash comes with several ids move. The side to look in has one row a text, and a
    text with many copies is repeated for each slice of its copies, so none meets in one task.
    """
    slice_rows = max(slice_rows, facts.count() // MOST_HOT)
    repeated = stored(
        facts.groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
        .filter("first < last")
        .select("h1", "h2", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices")),
        "audit-repeated",
    )
    hot = F.broadcast(repeated.filter("slices > 1"))  # at most MOST_HOT rows

    def sliced(df: DataFrame) -> DataFrame:
        slice_no = F.pmod(F.xxhash64("doc_id"), F.coalesce("slices", F.lit(1)))
        return df.join(hot, ["h1", "h2"], "left").withColumn("slice", slice_no).drop("slices")

    every_slice = repeated.select(
        "h1", "h2", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    )
    copies = stored(
        sliced(with_hashes(documents)).join(every_slice, ["h1", "h2", "slice"], "left_semi"),
        "audit-copies",
    )
    firsts = (
        copies.groupBy("h1", "h2", "text")
        .agg(F.min("doc_id").alias("first"))
        .join(every_slice, ["h1", "h2"])
        .select("h1", "h2", "slice", "text", "first")
    )
    a, b = copies.alias("a"), firsts.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("h1", "h2", "slice", "text")]
    return a.join(b, [*same, F.col("b.first") < F.col("a.doc_id")], "left_semi").select(
        "doc_id", "part", "h1", "h2"
    )


def failure_counts(
    documents: DataFrame, labels: DataFrame, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """part, bits, good, toxic, n: how many documents of a part fail exactly these filters."""
    hashed = with_hashes(documents)
    facts = stored(
        hashed.select("doc_id", "part", "h1", "h2", own_failures(F.col("text")).alias("bits")),
        "audit-facts",
    )
    marks = later_copies(documents, facts, slice_rows)
    key = ["doc_id", "part", "h1", "h2"]
    per_document = (
        facts.select(*key, "bits", F.lit(1).alias("n"))
        .union(marks.select(*key, F.lit(BITS["E"]), F.lit(0)))
        .groupBy(*key)
        .agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    )
    # Rows without an id meet no label; they are spread, not sent to the task of the null key.
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    spread = F.when(F.col("doc_id").isNull(), F.col("h1")).otherwise(0)
    labelled = per_document.withColumn("spread", spread).join(
        known.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left"
    )
    return labelled.groupBy(
        "part",
        "bits",
        F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
    ).agg(F.sum("n").alias("n"))


def audit_filters(
    documents: DataFrame, labels: DataFrame, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """One row per part, filter_order (all 120) and step (1 to 5), zeros included.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley count the documents of
    the part as they are when the filters are applied in that order; shapley sums the removed ones of
    the step's filter over all orders.

    Args:
        documents: doc_id, text, lang; other columns are ignored.
        labels: doc_id, quality, toxic; a document is good (toxic) if any of its labels says 1.
        slice_rows: copies of one text that one task looks up.

    A null text is empty, a null lang is the part of the empty string. A row without an id neither
    is nor makes a later copy, and has no label. Repeated rows each count; equal ids are no copies of
    each other. A long text is split inside its row. An empty table gives an empty result.
    """
    counts = failure_counts(documents, labels, slice_rows)
    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    )
    own, earlier = F.lit(0), F.lit(0)
    for letter, bit in BITS.items():
        place = F.locate(letter, F.col("filter_order"))
        own = own + F.when(place == F.col("step"), bit).otherwise(0)
        earlier = earlier + F.when(place < F.col("step"), bit).otherwise(0)
    fails = F.col("bits").bitwiseAND(F.col("own")) != 0
    gone = F.col("bits").bitwiseAND(F.col("earlier")) != 0

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    audited = (
        steps.withColumn("own", own)
        .withColumn("earlier", earlier)
        .groupBy("part", "filter_order", "step")
        .agg(
            F.substring(F.max("filter_order"), F.max("step"), F.lit(1)).alias("letter"),
            count(~fails & ~gone).alias("kept"),
            count(fails & ~gone).alias("removed"),
            count(fails & gone).alias("redundant"),
            count(F.col("bits") == F.col("own")).alias("unique_fails"),
            count(fails & ~gone & (F.col("good") == 1)).alias("good_lost"),
            count(fails & ~gone & (F.col("toxic") == 1)).alias("toxic_lost"),
        )
    )
    of_filter = Window.partitionBy("part", "letter")  # 120 rows
    return audited.withColumn("shapley", F.sum("removed").over(of_filter)).drop("letter")
