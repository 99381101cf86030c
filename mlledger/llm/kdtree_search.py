"""Exact top-k search with a KD-tree for each shard.

Candidates are dealt into shards of bounded size. A task builds a tree over a shard (median splits,
tight bounding boxes) and walks it best-first for each query, by the largest score that a box can
hold, until no box can beat the query's kth best. A first pass over one shard for each query gives
kth scores that are handed to the pass over all others, where they cut most walks short.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlledger.llm.common import stored

LEAF = 128
FOUND = "query_id long, vec_id long, score long"


def whole_numbers(embedding: str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null for a vector that takes no part."""
    finite = F.forall(
        embedding,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    return F.when(
        finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * float(scale)))
    )


@dataclass
class Node:
    rows: slice
    first_id: int
    children: tuple[int, int] | None


class Tree:
    """Rows in tree order, so that each node is a slice of them.

    ``whole`` holds the components as Python integers where their products may not fit a double; then
    scores are taken from it, and the boxes' bounds, which are doubles, are widened by their error.
    """

    def __init__(
        self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, whole: np.ndarray | None = None
    ) -> None:
        self.ids, self.points, self.leaf = ids.copy(), points.copy(), leaf
        self.whole = None if whole is None else whole.copy()
        self.nodes: list[Node] = []
        low, high = [], []
        self._grow(0, len(ids), low, high)
        self.low, self.high = np.array(low), np.array(high)

    def _grow(self, start: int, end: int, low: list, high: list) -> int:
        points, ids = self.points[start:end], self.ids[start:end]
        number = len(self.nodes)
        node = Node(slice(start, end), int(ids.min()), None)
        self.nodes.append(node)
        low.append(points.min(axis=0))
        high.append(points.max(axis=0))
        spread = high[-1] - low[-1]
        if end - start > self.leaf and spread.size and spread.max() > 0:
            middle = (end - start) // 2
            order = np.argpartition(points[:, spread.argmax()], middle)
            self.points[start:end], self.ids[start:end] = points[order], ids[order]
            if self.whole is not None:
                self.whole[start:end] = self.whole[start:end][order]
            node.children = (
                self._grow(start, start + middle, low, high),
                self._grow(start + middle, end, low, high),
            )
        return number

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each query can have with a point of each box."""
        most = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        if self.whole is None:
            return most
        reach = np.abs(queries) @ np.maximum(np.abs(self.high), np.abs(self.low)).T
        return most + reach * (4 * (queries.shape[1] + 2) * np.finfo(float).eps)

    def search(
        self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, kth: tuple[float, int]
    ) -> list[tuple[float, int]]:
        """The (score, id) of the k best, of those at or before ``kth`` in the order of results."""
        best: list[tuple[float, int]] = []
        worst = (-kth[0], kth[1])  # as a sort key: larger scores first, then smaller ids
        queue = [(-bounds[0], self.nodes[0].first_id, 0)]
        while queue:
            negative, first_id, number = heapq.heappop(queue)
            if (negative, first_id) > worst:
                if negative > worst[0]:
                    break  # so is every box that is left
                continue
            node = self.nodes[number]
            if node.children:
                for child in node.children:
                    heapq.heappush(queue, (-bounds[child], self.nodes[child].first_id, child))
                continue
            points = self.points if self.whole is None else self.whole
            scores, ids = points[node.rows] @ query, self.ids[node.rows]
            near = (scores >= -worst[0]) & (ids != own)
            best += zip(-scores[near], ids[near], strict=True)
            best = heapq.nsmallest(k, best)
            if len(best) == k:
                worst = min(worst, best[-1])
        return [(-negative, i) for negative, i in best if (negative, i) <= worst]


def search_group(
    candidates: pd.DataFrame, queries: pd.DataFrame, k: int
) -> Iterator[tuple[int, int, int]]:
    if candidates.empty or queries.empty:
        return
    ids, points = candidates["vec_id"].to_numpy(), np.array(candidates["v"].tolist(), dtype=np.int64)
    asked = np.array(queries["q"].tolist(), dtype=np.int64)
    wanted = asked.astype(np.float64)
    size = [float(np.abs(x.astype(np.float64)).max(initial=0.0)) for x in (points, asked)]
    # Sums of products below 2^53 are exact in doubles.
    exact = max(points.shape[1], 1) * size[0] * size[1] < 2**53 and max(size) < 2**53
    tree = Tree(ids, points.astype(np.float64), whole=None if exact else points.astype(object))
    bounds = tree.bounds(wanted)
    scores = queries["kth"].fillna(-np.inf).to_numpy(dtype=np.float64)
    if not exact:
        scores, asked = np.nextafter(scores, -np.inf), asked.astype(object)
    last = queries["kth_id"].fillna(np.iinfo(np.int64).max).astype("int64").to_numpy()
    for row, own in enumerate(queries["query_id"].to_numpy()):
        query = wanted[row] if exact else asked[row]
        kth = (float(scores[row]), int(last[row]))
        for score, i in tree.search(own, query, bounds[row], k, kth):
            yield own, i, int(score)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    shard_rows: int = 8192,
    block_rows: int = 4096,
) -> DataFrame:
    """The k largest inner products of each query: query_id, rank (from 1), vec_id, score.

    Args:
        vectors: vec_id, v (array of whole numbers); other columns are ignored.
        is_query: which rows are queries. Candidates are all rows but those of the query's own id.
        k: results for each query, fewer if there are no more candidates.
        shard_rows, block_rows: candidates in a tree and queries searched at once. Each tree meets
            each block of queries, so candidates are copied once for each block.

    Ties go to the smaller vec_id. Rows with a null vec_id or vector take no part, and vectors of
    different lengths don't meet. Of rows that repeat a vec_id, each is a candidate. Products are
    exact while they stay below 2 ** 53. An empty table or no query gives an empty result.
    """
    rows = stored(
        vectors.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select(
            "vec_id", "v", F.size("v").alias("dim"), is_query.alias("asks")
        ),
        "kdtree-vectors",
    )
    n, n_queries = rows.agg(
        F.count("*"), F.count(F.when(F.col("asks"), 1))
    ).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_queries / block_rows))
    spread = F.xxhash64("vec_id")
    candidates = rows.select(
        "dim",
        F.pmod(spread, F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "vec_id",
        "v",
    )
    queries = (
        rows.filter("asks")
        .select(
            F.col("dim").alias("q_dim"),
            F.pmod(spread, F.lit(shards)).cast("int").alias("home"),
            F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int").alias("q_block"),
            F.col("vec_id").alias("query_id"),
            F.col("v").alias("q"),
        )
        .dropDuplicates(["query_id", "q_dim", "q"])
    )

    def searched(asked: DataFrame) -> DataFrame:
        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = list(search_group(left, right, k))
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

        return (
            candidates.groupBy("dim", "shard", "block")
            .cogroup(asked.groupBy("q_dim", "q_shard", "q_block"))
            .applyInPandas(run, FOUND)
        )

    first = stored(
        searched(
            queries.select(
                *["q_dim", F.col("home").alias("q_shard"), "q_block", "query_id", "q"],
                F.lit(None).cast("double").alias("kth"),
                F.lit(None).cast("long").alias("kth_id"),
            )
        ),
        "kdtree-first",
    )
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = (
        first.withColumn("rank", F.row_number().over(by_score))
        .filter(F.col("rank") == k)
        .select("query_id", F.col("score").cast("double").alias("kth"), F.col("vec_id").alias("kth_id"))
    )
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
    rest = searched(
        queries.join(kth, "query_id", "left").select(
            *["q_dim", F.explode(others).alias("q_shard"), "q_block", "query_id", "q"],
            *["kth", "kth_id"],
        )
    )
    return (
        first.unionByName(rest)
        .withColumn("rank", F.row_number().over(by_score))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
