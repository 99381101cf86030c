"""Regression trees grown from histograms: binning, growth, and the model as arrays.

Feature values become bin numbers once. A step of growth is one aggregation of targets by (node, feature,
bin) over the rows of all nodes that may be split next; the driver gets these histograms, whose size
follows from leaves, features and bins alone, and picks the splits. Targets are whole numbers of a
fixed scale, so a sum is exact and a fit is the same however the rows are laid out.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlledger.functions.hashing import BUCKETS, hash_bucket
from mlledger.schemas import ROW_ID

#: Rows that bin edges are taken from, chosen by a hash of the key.
EDGE_ROWS = 200_000
#: Bits behind the point of a fixed target, fewer where the sum of all rows needs the room.
MOST_BITS = 32
#: A split must gain more than this, which is what rounding may leave of a gain of nothing.
LEAST_GAIN = 1e-10
NODES = "tree int, node int, feature_no int, threshold double, left int, value double, gain double, rows long"


@dataclass
class Tree:
    """Arrays over nodes, the root first. Rows whose feature is below the threshold go to ``left``,
    the others to the node behind it; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray
    depth: int


@dataclass
class TreeModel:
    """A sum of trees over named features, ``base`` included. It predicts, saves and is cut."""

    features: list[str]
    base: float
    trees: list[Tree]
    weight: float = 1.0

    def first(self, n: int) -> TreeModel:
        return TreeModel(self.features, self.base, self.trees[:n], self.weight)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """NODES, a row for each node of each tree."""
        parts = {name: [] for name in ("tree", "node", "feature_no", "threshold", "left", "value", "gain", "rows")}
        for t, tree in enumerate(self.trees):
            n = len(tree.feature)
            arrays = (
                np.full(n, t), np.arange(n), tree.feature, tree.threshold, tree.left, tree.value, tree.gain, tree.rows,
            )
            for name, values in zip(parts, arrays, strict=True):
                parts[name].append(values)
        if not self.trees:
            return spark.createDataFrame([], NODES)
        table = pa.table({k: np.concatenate(v) for k, v in parts.items()})
        kinds = [c.split() for c in NODES.split(", ")]
        df = spark.createDataFrame(table)
        return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in kinds])

    def save(self, spark: SparkSession, path: str) -> None:
        """<path>/nodes, the node table, then <path>/about, without which there is no model."""
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        about = {"features": self.features, "base": self.base, "weight": self.weight}
        text = spark.createDataFrame([(json.dumps(about),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        about = json.loads(spark.read.text(f"{path}/about").first().value)
        nodes = spark.read.schema(NODES).parquet(f"{path}/nodes").toArrow().to_pandas()
        trees = []
        for _, rows in nodes.sort_values(["tree", "node"]).groupby("tree"):
            a = {c: rows[c].to_numpy() for c in rows.columns}
            no_cut = np.full(len(rows), -1)
            trees.append(
                Tree(
                    a["feature_no"], a["threshold"], no_cut, a["left"], a["value"], a["gain"], a["rows"],
                    tree_depth(a["feature_no"], a["left"]),
                )
            )
        return cls(about["features"], about["base"], trees, about["weight"])

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``; features are taken by name."""
        return df.withColumn("prediction", self.prediction())

    def prediction(self) -> Column:
        """Batches of rows walk all trees at once, in numpy; nothing depends on how rows are batched."""
        base, weight, trees = self.base, self.weight, self.trees
        if not trees:
            return F.lit(base)
        starts = np.cumsum([0, *[len(t.feature) for t in trees]])
        roots = starts[:-1]
        feature = np.concatenate([t.feature for t in trees])
        threshold = np.concatenate([t.threshold for t in trees])
        left = np.concatenate([t.left + s for t, s in zip(trees, roots, strict=True)])
        value = np.concatenate([t.value for t in trees])
        depth = max(t.depth for t in trees)

        @F.pandas_udf("double")
        def predict(columns: pd.DataFrame) -> pd.Series:
            x = columns.to_numpy(dtype=float)
            out = np.full(len(x), 0.0)
            step = max(1, (1 << 21) // len(roots))  # rows at a time
            for at in range(0, len(x), step):
                part = x[at : at + step]
                row = np.arange(len(part))[:, None]
                node = np.broadcast_to(roots, (len(part), len(roots)))
                for _ in range(depth):
                    f = feature[node]
                    right = part[row, np.maximum(f, 0)] >= threshold[node]
                    node = np.where(f < 0, node, left[node] + right)
                total = np.full(len(part), base / weight)
                for t in range(len(roots)):
                    total += value[node[:, t]]
                out[at : at + step] = total * weight
            return pd.Series(out)

        return predict(F.struct(*[F.col(c).cast("double").alias(c) for c in self.features]))


def tree_depth(feature: np.ndarray, left: np.ndarray) -> int:
    depth = np.zeros(len(feature), int)
    for node in range(len(feature)):  # children come behind their parent
        if feature[node] >= 0:
            depth[[left[node], left[node] + 1]] = depth[node] + 1
    return int(depth.max())


# --- binning ------------------------------------------------------------------------------------


def bin_edges(
    rows: DataFrame, features: Sequence[str], max_bin: int, seed: int, n: int, key: str = ROW_ID, edge_rows: int = EDGE_ROWS
) -> list[np.ndarray]:
    """Ascending thresholds of each feature, at most ``max_bin`` - 1, from at most about ``edge_rows`` rows.

    All distinct values get a bin where there are few enough of them, else bins hold about equally
    many rows. A threshold lies halfway between neighbouring values.
    """
    if n > edge_rows:
        share = max(1, math.ceil(BUCKETS * edge_rows / n))
        rows = rows.filter(hash_bucket(key, seed, "edges") < share)
    sample = rows.select(*[F.col(c).cast("double") for c in features]).toArrow()
    edges = []
    for c in features:
        values, counts = np.unique(sample[c].to_numpy(), return_counts=True)
        if len(values) > max_bin:
            upto = np.cumsum(counts)
            wanted = np.arange(1, max_bin) * upto[-1] / max_bin
            at = np.unique(np.searchsorted(upto, wanted))
            at = at[at < len(values) - 1]
        else:
            at = np.arange(len(values) - 1)
        edges.append((values[at] + values[at + 1]) / 2)
    return edges


def with_bins(df: DataFrame, features: Sequence[str], edges: list[np.ndarray], out: str = "bins") -> DataFrame:
    """Adds the bin number of each feature: how many of its thresholds its value reaches."""
    cut = [(c, e) for c, e in zip(features, edges, strict=True) if len(e)]
    names = {c: f"_bin_{c}" for c, _ in cut}
    if cut:
        df = Bucketizer(
            splitsArray=[[-math.inf, *e.tolist(), math.inf] for _, e in cut],
            inputCols=[c for c, _ in cut],
            outputCols=[names[c] for c, _ in cut],
            handleInvalid="error",
        ).transform(df)
    numbers = [F.col(names[c]).cast("int") if c in names else F.lit(0) for c in features]
    return df.withColumn(out, F.array(*numbers)).drop(*names.values())


def fixed_bits(n: int, most: float, margin: int = 4) -> int:
    """Bits behind the point such that n targets of up to ``most`` (times ``margin``) fit a long."""
    return min(MOST_BITS, math.floor(62 - math.log2(max(n, 1) * margin * max(most, 2.0**-20))))


def fixed(value: Column, bits: int) -> Column:
    """The nearest whole number of 2^-bits."""
    return F.floor(value * float(2**bits) + 0.5).cast("long")


# --- growth -------------------------------------------------------------------------------------


@dataclass
class Limits:
    leaves: int
    depth: int  # -1: follows from the leaves
    min_rows: int
    min_gain: float


@dataclass
class _Node:
    tree: int
    depth: int
    total: int
    rows: int
    split: tuple | None = None  # gain, feature, cut, total and rows of the left side
    left: int = -1


def array_literal(values: Sequence, kind: str) -> str:
    """SQL of an array; its values are data of the plan, not code that is compiled for each step."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"


def walked(rows: DataFrame, feature: Sequence, cut: Sequence, left: Sequence, depth: int) -> DataFrame:
    """``node`` of each row after ``depth`` steps down by its bins; -1 and leaves stay where they are.

    A loop inside one expression, as Spark would write a chain of columns out in each filter on it.
    """
    if not depth:
        return rows
    f, c, s = (array_literal(a, "int") for a in (feature, cut, left))
    step = f"if(n < 0 or {f}[n] < 0, n, {s}[n] + if(bins[{f}[n]] <= {c}[n], 0, 1))"
    loop = f"aggregate(sequence(1, {depth}), node, (n, i) -> {step})"
    return rows.withColumn("node", F.expr(loop))


def with_tree(rows: DataFrame, tree: Tree) -> DataFrame:
    """``node`` = the leaf of a finished tree, and ``step`` = what the tree adds to each row."""
    arrays = (tree.feature.tolist(), tree.cut.tolist(), tree.left.tolist())
    rows = walked(rows.withColumn("node", F.lit(0)), *arrays, tree.depth)
    values = array_literal([repr(float(v)) for v in tree.value], "double")
    return rows.withColumn("step", F.expr(f"{values}[node]"))


@dataclass
class Growth:
    """Trees that grow at the same time; the first nodes are their roots."""

    edges: list[np.ndarray]
    limits: Limits
    bits: int
    allowed: np.ndarray  # tree x feature
    nodes: list[_Node] = field(default_factory=list)

    def routed(self, rows: DataFrame, depth: int) -> DataFrame:
        """``node`` of each row moved on from its root through all splits made so far."""
        feature = [n.split[1] if n.left >= 0 else -1 for n in self.nodes]
        cut = [n.split[2] if n.left >= 0 else -1 for n in self.nodes]
        return walked(rows, feature, cut, [n.left for n in self.nodes], depth)

    def histograms(self, rows: DataFrame, open_nodes: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
        """Target sums and row counts of the open nodes by (node, feature, bin), and the sum of
        ``loss`` over rows of node -1.

        rows: node (root, or -1), bins, value (long), weight, and loss.
        """
        depth = max(self.nodes[i].depth for i in open_nodes)
        is_open = [0] * len(self.nodes)
        for i in open_nodes:
            is_open[i] = 1
        here = f"if(node < 0, true, {array_literal(is_open, 'int')}[greatest(node, 0)] = 1)"
        cells = (
            self.routed(rows, depth)
            .filter(here)
            .selectExpr("node", "value", "weight", "loss", "posexplode(bins) AS (feature, bin)")
            .filter("node >= 0 OR feature = 0")
        )
        table = (
            cells.groupBy("node", "feature", F.expr("if(node < 0, 0, bin) AS bin"))
            .agg(
                F.sum(F.col("value") * F.col("weight")).alias("total"),
                F.sum("weight").alias("rows"),
                F.sum("loss").alias("loss"),
            )
            .toArrow()
        )
        got = {c: table[c].to_numpy() for c in table.column_names}
        outside = got["node"] < 0
        loss = float(np.nansum(got["loss"][outside])) if outside.any() else math.nan
        slot = np.full(len(self.nodes), -1)
        slot[open_nodes] = np.arange(len(open_nodes))
        shape = (len(open_nodes), len(self.edges), max(len(e) for e in self.edges) + 1)
        totals, counts = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        place = tuple(got[c][~outside] for c in ("node", "feature", "bin"))
        place = (slot[place[0]], *place[1:])
        totals[place] = got["total"][~outside]
        counts[place] = got["rows"][~outside]
        return totals, counts, loss

    def evaluate(self, rows: DataFrame, open_nodes: list[int]) -> float:
        """Find the best split of each open node; equal gains go to the first feature and cut."""
        totals, counts, loss = self.histograms(rows, open_nodes)
        for i, total, count in zip(open_nodes, totals, counts, strict=True):
            node = self.nodes[i]
            node.total, node.rows = int(total[0].sum()), int(count[0].sum())
            if node.rows < 2 * self.limits.min_rows:
                continue
            left, below = total.cumsum(axis=1)[:, :-1], count.cumsum(axis=1)[:, :-1]
            right, above = node.total - left, node.rows - below
            fits = (below >= self.limits.min_rows) & (above >= self.limits.min_rows)
            fits &= self.allowed[node.tree][:, None]
            if not fits.any():
                continue
            g, n = float(node.total), node.rows
            gl, gr = left.astype(float), right.astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gl * gl / below + gr * gr / above - g * g / n
            gain = np.where(fits, gain, -np.inf)
            feature, cut = np.unravel_index(gain.argmax(), gain.shape)
            best = float(gain[feature, cut]) / 4.0**self.bits
            if best > self.limits.min_gain + LEAST_GAIN:
                node.split = best, int(feature), int(cut), int(left[feature, cut]), int(below[feature, cut])
        return loss

    def chosen(self, root: int) -> list[int]:
        """Nodes to split, best gain first, as far as their gains are known."""
        heap, picks = [], []

        def offer(i: int) -> None:
            if self.nodes[i].split:
                heapq.heappush(heap, (-self.nodes[i].split[0], i))

        offer(root)
        while heap and len(picks) < self.limits.leaves - 1:
            _, i = heapq.heappop(heap)
            picks.append(i)
            if self.nodes[i].left >= 0:
                offer(self.nodes[i].left)
                offer(self.nodes[i].left + 1)
        return picks

    def split(self, i: int) -> list[int]:
        """Make the two children of a node; returns those that may be split in turn."""
        node = self.nodes[i]
        _, _, _, total, rows = node.split
        node.left = len(self.nodes)
        self.nodes.append(_Node(node.tree, node.depth + 1, total, rows))
        self.nodes.append(_Node(node.tree, node.depth + 1, node.total - total, node.rows - rows))
        deep = 0 <= self.limits.depth <= node.depth + 1
        return [
            c for c in (node.left, node.left + 1)
            if not deep and self.nodes[c].rows >= 2 * self.limits.min_rows
        ]

    def grow(self, rows: DataFrame, trees: int) -> float:
        """Best-first growth: one job for each level of the deepest tree. Returns the loss that the
        first job met in rows of node -1."""
        self.nodes = [_Node(t, 0, 0, 0) for t in range(trees)]
        loss = self.evaluate(rows, list(range(trees)))
        rows = rows.filter("node >= 0").withColumn("loss", F.lit(None).cast("double"))
        while True:
            open_nodes = []
            for root in range(trees):
                picks = self.chosen(root)
                last = picks[-1] if len(picks) == self.limits.leaves - 1 else -1
                for i in picks:
                    if self.nodes[i].left < 0:
                        children = self.split(i)
                        # What lies below the last split can't come before it.
                        open_nodes += children if i != last else []
            if not open_nodes:
                return loss
            self.evaluate(rows, open_nodes)

    def tree(self, root: int, rate: float = 1.0) -> Tree:
        """The chosen part of a tree as arrays; a node's value is its mean target times ``rate``."""
        picks = set(self.chosen(root))
        order, at = [root], 0
        left = []
        while at < len(order):
            i = order[at]
            left.append(len(order) if i in picks else -1)
            if i in picks:
                order += [self.nodes[i].left, self.nodes[i].left + 1]
            at += 1
        inner = [i in picks for i in order]
        splits = [self.nodes[i].split if p else (0.0, -1, -1) for i, p in zip(order, inner, strict=True)]
        feature = np.array([s[1] for s in splits])
        left = np.array(left)
        scale = float(2**self.bits)
        return Tree(
            feature,
            np.array([float(self.edges[s[1]][s[2]]) if s[1] >= 0 else 0.0 for s in splits]),
            np.array([s[2] for s in splits]),
            left,
            np.array([rate * (self.nodes[i].total / max(self.nodes[i].rows, 1)) / scale for i in order]),
            np.array([float(s[0]) for s in splits]),
            np.array([self.nodes[i].rows for i in order]),
            tree_depth(feature, left),
        )
