"""Approximate nearest neighbours with shifted space-filling curves.

Vectors are projected to a few dimensions, once for each of several curves, shifted, and ordered by
their place on a Hilbert curve. Every curve is cut by rank into key ranges of equal rows; a query
looks through its own range and the neighbouring ones on every curve, and what these windows find
is merged and reranked by the exact measure.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlledger.llm.common import hashes, stored

#: Rows of a curve's order that are numbered in one task.
SLICE_ROWS = 131072


def usable(embedding: str) -> Column:
    """Whether a vector takes part: all components finite, not all zero."""
    return (
        F.col(embedding).isNotNull()
        & F.forall(
            embedding,
            lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
        )
        & F.exists(embedding, lambda x: x != 0)
    )


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of integer coordinates on the Hilbert curve of its cube.

    Walks the levels from the coarsest; each level undoes the turn and the reflection of the
    subcube that it enters, the transpose form of the curve.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i, axis in enumerate(axes):
            upper = (axis & bit) != 0
            swap = np.where(upper, 0, (axes[0] ^ axis) & below)
            axes[0] = np.where(upper, axes[0] ^ below, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1, (1 << level) - 1, 0)
    key = np.zeros(len(cells), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> level) & 1)
    return key


def curve_key(unit: np.ndarray, curve: int, dims: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Project unit vectors with the curve's own orthonormal directions, shift, and order.

    Returns the places on the curve, and those inside a cell by as many bits again, which tell the
    rows of one cell apart.
    """
    width = unit.shape[1]
    rng = np.random.default_rng([curve, width])
    directions = np.linalg.qr(rng.standard_normal((width, min(dims, width))))[0]
    shift = rng.uniform(-0.08, 0.08, directions.shape[1])
    place = unit @ directions * math.sqrt(width) / 6 + 0.5 + shift  # six deviations fill the cube
    cells = (np.clip(place, 0, 1 - 1e-9) * (1 << 2 * bits)).astype(np.int64)
    return hilbert_keys(cells >> bits, bits), hilbert_keys(cells & ((1 << bits) - 1), bits)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def rank_group(
    candidates: pd.DataFrame, queries: pd.DataFrame, k: int, at_once: int = 512
) -> pd.DataFrame:
    """The candidates nearest to each query of one window, down to the kth + 1 distinct id: an id
    that asks leaves itself out later, and k are left."""
    found = []
    if len(candidates) and len(queries):
        points, ids = matrix(candidates["v"]), candidates["ids"].tolist()
        lengths = np.sqrt((points * points).sum(axis=1))
        asked_by = list(zip(queries["q1"], queries["q2"], strict=True))
        wanted = matrix(queries["q"])
        for start in range(0, len(wanted), at_once):
            scores = (wanted[start : start + at_once] @ points.T) / lengths
            for asked, own, row in zip(wanted[start:], asked_by[start:], scores, strict=False):
                take, best = k + 1, []
                while True:  # a second time only if an id has several vectors
                    take = min(take, len(row))
                    floor = row[np.argpartition(-row, take - 1)[take - 1]]
                    near = np.flatnonzero(row >= floor - 1e-9 * max(1.0, abs(floor)))
                    # the same sums for a pair wherever it is found, so equal vectors tie
                    exact = (points[near] * asked).sum(axis=1) / (
                        lengths[near] * math.sqrt((asked * asked).sum())
                    )
                    best = sorted((-s, i) for s, at in zip(exact, near, strict=True) for i in ids[at])
                    if take == len(row) or len({i for _, i in best}) > k:
                        break
                    take *= 2
                seen: set = set()
                for negative, i in best:
                    if i not in seen and len(seen) > k:
                        break
                    seen.add(i)
                    found.append((*own, i, -negative))
    return pd.DataFrame(found, columns=["q1", "q2", "vec_id", "score"])


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    curves: int = 24,
    dims: int = 7,
    bits: int = 8,
    window: float = 0.06,
    range_rows: int = 4096,
    block_rows: int = 8192,
) -> DataFrame:
    """The k largest cosines found for each query: query_id, rank (from 1), vec_id, score.

    Args:
        vectors: vec_id, v (array of numbers); other columns are ignored.
        is_query: which rows are queries. Candidates are all rows but those of the query's own id.
        k: results for each query.
        curves, dims, bits: number of Hilbert curves, their dimensions and bits for each.
        window: share of a curve that a query looks through, its own range and the neighbours.
        range_rows: most rows in a key range; larger tables are cut into more ranges.
        block_rows: most queries that meet a key range in one task. They are cut in the order of
            the curve, and a key range is copied for each block that reads it.

    Ties go to the smaller vec_id. Null, zero or non-finite vectors and rows with a null vec_id take
    no part; vectors of different lengths don't meet. Copies of one vector are one point, which is
    placed and searched once, with its k + 1 smallest ids: more can't be in any result, as those are
    as near. Points that share a key are ordered by their place in the cell and then by a hash of
    their own for each curve, so a cluster of any size spreads over ranges. An empty table or no
    query gives an empty result.
    """
    h1, h2 = hashes(F.col("v"))
    point = ["dim", "h1", "h2"]
    rows = stored(
        vectors.filter(F.col("vec_id").isNotNull() & usable("v"))
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("v").cast("array<double>").alias("v"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        )
        .withColumns({"dim": F.size("v"), "h1": h1, "h2": h2}),
        "hilbert-vectors",
    )
    smallest = (
        rows.select(*point, "vec_id")
        .distinct()
        .withColumn("copy", F.row_number().over(Window.partitionBy(*point).orderBy("vec_id")))
        .filter(F.col("copy") <= k + 1)
        .groupBy(*point)
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )

    @F.pandas_udf("array<long>")
    def keys_of(batch: pd.Series) -> pd.Series:
        out: list = [None] * len(batch)
        widths = batch.map(len).to_numpy()
        for width in set(widths):
            at = np.flatnonzero(widths == width)
            points = matrix(batch.iloc[at])
            points /= np.sqrt((points * points).sum(axis=1, keepdims=True))
            pairs = [curve_key(points, c, dims, bits) for c in range(curves)]
            keys = np.stack([key for key, _ in pairs] + [inner for _, inner in pairs], axis=1)
            for i, key in zip(at, keys, strict=True):
                out[i] = key
        return pd.Series(out)

    points = stored(
        rows.groupBy(*point)
        .agg(F.min_by("v", "vec_id").alias("v"), F.bool_or("asks").alias("asks"))
        .join(smallest, point)
        .withColumn("keys", keys_of("v")),
        "hilbert-points",
    )
    n = points.count()
    reach = max(1, math.ceil((n * window / range_rows - 1) / 2))  # neighbours on either side
    ranges = max(1, math.floor((2 * reach + 1) / window))

    # a point's place on each curve: slices of the order are numbered apart and shifted
    order = ["key", "inner", "tie", "h1", "h2"]
    sliced = stored(
        points.select(*point, "asks", "keys", F.posexplode(F.slice("keys", 1, curves)).alias("curve", "key"))
        .withColumn("inner", F.element_at("keys", F.col("curve") + curves + 1))
        .withColumn("tie", F.xxhash64("curve", "h1", "h2"))
        .drop("keys")
        .repartitionByRange(max(1, math.ceil(n * curves / SLICE_ROWS)), "dim", "curve", *order)
        .withColumn("slice", F.spark_partition_id()),
        "hilbert-slices",
    )
    cell = Window.partitionBy("dim", "curve")
    before = cell.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy("dim", "curve", "slice")
        .agg(F.count("*").alias("rows"), F.count_if("asks").alias("asking"))
        .select(
            *["dim", "curve", "slice"],
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"),
            F.coalesce(F.sum("asking").over(before), F.lit(0)).alias("asking_start"),
            F.sum("rows").over(cell).alias("total"),
        )
    )
    inside = Window.partitionBy("dim", "curve", "slice").orderBy(*order)
    placed = stored(
        sliced.withColumn("no", F.row_number().over(inside) - 1)
        .withColumn(
            "asked",
            F.count_if("asks").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1,
        )
        .join(starts, ["dim", "curve", "slice"])
        # a short curve has fewer ranges, so that none is smaller than a result
        .withColumn("ranges", F.greatest(F.lit(1), F.least(F.lit(ranges), F.expr(f"total div {k + 1}"))))
        .select(
            *[*point, "curve", "asks", "ranges"],
            F.expr("int((start + no) * ranges div total)").alias("range"),
            F.expr(f"int((asking_start + asked) div {block_rows})").alias("block"),
        ),
        "hilbert-places",
    )
    near = F.sequence(
        F.greatest(F.col("range") - reach, F.lit(0)),
        F.least(F.col("range") + reach, (F.col("ranges") - 1).cast("int")),
    )
    asking = placed.filter("asks").withColumn("range", F.explode(near))
    read = asking.select("dim", "curve", "range", "block").distinct()
    candidates = (
        placed.drop("asks", "block", "ranges")
        .join(read, ["dim", "curve", "range"])
        .join(points.select(*point, "ids", "v"), point)
        .select("dim", "curve", "range", "block", "ids", "v")
    )
    queries = asking.join(points.select(*point, "v"), point).select(
        F.col("dim").alias("q_dim"),
        F.col("curve").alias("q_curve"),
        F.col("range").alias("q_range"),
        F.col("block").alias("q_block"),
        F.col("h1").alias("q1"),
        F.col("h2").alias("q2"),
        F.col("v").alias("q"),
    )
    found = (
        candidates.groupBy("dim", "curve", "range", "block")
        .cogroup(queries.groupBy("q_dim", "q_curve", "q_range", "q_block"))
        .applyInPandas(
            lambda left, right: rank_group(left, right, k),
            "q1 long, q2 long, vec_id long, score double",
        )
    )
    # the best of each point, down to k + 1 distinct ids, go to all ids that ask with it
    best_first = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    again = Window.partitionBy("q1", "q2", "vec_id").orderBy(F.desc("score"))
    best = (
        found.distinct()
        .withColumn("again", F.row_number().over(again))
        .withColumn(
            "ids",
            F.count_if(F.col("again") == 1).over(
                best_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .filter(F.col("ids") <= k + 1)
        .select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), "vec_id", "score")
    )
    askers = rows.filter("asks").select("h1", "h2", F.col("vec_id").alias("query_id"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        askers.join(best, ["h1", "h2"])
        .filter(F.col("query_id") != F.col("vec_id"))
        .select("query_id", "vec_id", "score")
        .distinct()
        .withColumn("rank", F.row_number().over(by_score))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
