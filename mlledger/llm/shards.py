"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that stays together. Groups are taken from the largest to
the smallest, and each goes to the least-loaded shard through a heap. Groups of (nearly) equal size
are interchangeable, so the heap works on a histogram of sizes whose length is bounded, and the
table only looks up which stretch of its size class a group lies in.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlledger.llm.common import hashes, numbered, stored

#: Leading bits of a group's size that make its class: at most 1024 classes for each power of two.
CLASS_BITS = 11


def size_class(weight: str) -> Column:
    """The weight with all but its leading bits cleared; exact below 2 ** CLASS_BITS."""
    drop = f"cast(greatest(0, length(bin({weight})) - {CLASS_BITS}) as int)"
    return F.expr(f"shiftleft(shiftright({weight}, {drop}), {drop})")


def assign(n: int, weight: float, heap: list[tuple[float, int]]) -> list[int]:
    """How many of n groups of one weight each shard gets when each goes to the least loaded."""
    shards = len(heap)
    got = [0] * shards
    while n > 0:
        if n >= shards and max(heap)[0] - heap[0][0] < weight:
            rounds = n // shards
            heap[:] = [(load + rounds * weight, s) for load, s in heap]
            heapq.heapify(heap)
            got = [x + rounds for x in got]
            n -= rounds * shards
            continue
        load, s = heapq.heappop(heap)
        step = min(n, max(1, int((heap[0][0] - load) / weight))) if heap else n
        heapq.heappush(heap, (load + step * weight, s))
        got[s] += step
        n -= step
    return got


def schedule(classes: pd.DataFrame, shards: int) -> pd.DataFrame:
    """For each class, the numbers at which its groups pass from one shard to the next."""
    heap = [(0.0, s) for s in range(shards)]
    stops = []
    classes = classes.sort_values("cls", ascending=False)
    for n, total in zip(classes["n"], classes["total"], strict=True):
        got = assign(int(n), total / n, heap)
        stops.append(list(pd.Series(got).cumsum()))
    return pd.DataFrame({"cls": classes["cls"].to_numpy(), "stops": stops})


def shard_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """Deal documents into shards of near equal bytes, equal texts together.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (gapless from 0 in a shard).

    Args:
        documents: doc_id, text; other columns are ignored.
        shards: number of shards.

    A null text has no bytes, its crc is 0, and null texts form a group of their own. Repeated rows
    take a slot each. A group larger than a fair share fills one shard, as it may not be split.
    An empty table gives an empty result. The histogram that one task schedules has one row for
    each size class, at most 2 ** (CLASS_BITS - 1) for each power of two.
    """
    h1, h2 = hashes(F.col("text"))
    base = stored(
        documents.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
            h1.alias("h1"),
            h2.alias("h2"),
        ),
        "shard-documents",
    )
    groups = stored(
        base.groupBy("h1", "h2")
        .agg(F.sum("size").alias("weight"))
        .withColumn("cls", size_class("weight")),
        "shard-groups",
    )
    classes = groups.groupBy("cls").agg(
        F.count("*").alias("n"), F.sum("weight").cast("double").alias("total")
    )

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if rows:
            yield schedule(pd.concat(rows), shards)

    quotas = classes.coalesce(1).mapInPandas(plan, "cls long, stops array<long>")
    placed = (
        numbered(groups, ["cls"], ["h1", "h2"], "number")
        .join(quotas, "cls")
        .select(
            "h1",
            "h2",
            F.size(F.filter("stops", lambda x: x <= F.col("number"))).cast("int").alias("shard"),
        )
    )
    dealt = stored(
        base.join(placed, ["h1", "h2"]).select("doc_id", "size", "text_crc32", "shard"),
        "shard-dealt",
    )
    return numbered(dealt, ["shard"], ["doc_id", "size", "text_crc32"], "slot")
