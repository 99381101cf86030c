"""Boosted and bagged regression trees on the histogram engine of `trees`."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlledger.functions.hashing import BUCKETS, hash_bucket
from mlledger.operators import trees
from mlledger.operators.trees import Growth, Limits, TreeModel
from mlledger.schemas import FEATURES, ROW_ID, SEED, TARGET
from mlledger.session import fresh_folder

#: Rounds after which predictions are stored and the lineage ends.
BLOCK = 25


@dataclass
class Boosted:
    """model is cut at the best round; losses has the held-out RMSE after each round that was fitted."""

    model: TreeModel
    best_iteration: int
    losses: list[float] = field(default_factory=list)


def best_round(losses: list[float], patience: int) -> int:
    """1-based round with the lowest loss, looking `patience` rounds past the best so far."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def chosen_features(features: list[str], share: float, seed: int, tree: int) -> list[bool]:
    """Which features a tree may use: at least one, those with the smallest hashes."""
    wanted = max(1, round(share * len(features)))
    digest = {c: hashlib.md5(f"{seed}:features-{tree}:{c}".encode()).hexdigest() for c in features}
    chosen = sorted(features, key=digest.__getitem__)[:wanted]
    return [c in chosen for c in features]


def in_bag(params: dict, seed: int, done: int, key: str) -> Column:
    """Which rows the next tree learns from; drawn anew every `bagging_freq` rounds."""
    share = float(params["bagging_fraction"])
    if share >= 1:
        return F.lit(True)
    draw = done // max(1, int(params["bagging_freq"]))
    return hash_bucket(key, seed, f"bag-{draw}") < round(share * BUCKETS)


@dataclass
class Progress:
    """Finished blocks of a fit below a shared folder: rows with predictions, then `fit`, which says
    that the block is whole. A fit that finds blocks of the same settings goes on from the last."""

    folder: str
    settings: str

    def save(self, state: DataFrame, model: TreeModel, losses: list[float]) -> DataFrame:
        spark, done = state.sparkSession, len(model.trees)
        path = f"{self.folder}/block-{done:06}"
        state.write.mode("overwrite").parquet(f"{path}/rows")
        model.save(spark, f"{path}/model")
        cuts = [t.cut.tolist() for t in model.trees]
        document = {"done": done, "settings": self.settings, "losses": losses, "cuts": cuts}
        text = spark.createDataFrame([(json.dumps(document),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/fit")
        return spark.read.schema(state.schema).parquet(f"{path}/rows")

    def last(self, empty: DataFrame) -> tuple[DataFrame, TreeModel, list[float]] | None:
        spark = empty.sparkSession
        try:
            found = spark.read.text(f"{self.folder}/block-*/fit").collect()  # one for each block
        except AnalysisException:
            return None
        documents = [json.loads(r.value) for r in found]
        mine = [d for d in documents if d["settings"] == self.settings]
        if not mine:
            return None
        last = max(mine, key=lambda d: d["done"])
        path = f"{self.folder}/block-{last['done']:06}"
        model = TreeModel.load(spark, f"{path}/model")
        for tree, cut in zip(model.trees, last["cuts"], strict=True):
            tree.cut = np.array(cut)
        return spark.read.schema(empty.schema).parquet(f"{path}/rows"), model, last["losses"]


def boost(
    data: DataFrame,
    params: dict,
    seed: int = SEED,
    rounds: int = 2000,
    patience: int = 50,
    folder: str | None = None,
    block: int = BLOCK,
    features: list[str] = FEATURES,
    key: str = ROW_ID,
    after_block: Callable[[int], None] | None = None,
) -> Boosted:
    """Leaf-wise gradient boosting of squared error, stopped `patience` rounds past the best one.

    data has the features, the target, the key and `split` (train, valid; other rows are left out).
    Each round goes on from the prediction that the one before left with the rows; nothing is
    fitted twice. Every `block` rounds the rows are stored below `folder` (by default a new folder of
    the session's shared one); a second call with the same folder and settings goes on from the last
    whole block. The result depends on the rows and settings alone, not on their layout.

    Without validation rows all rounds are kept. An empty training part is an error, and so are nulls
    or NaNs in a feature.
    """
    rows = data.filter(F.col("split").isin("train", "valid"))
    is_valid = F.col("split") == "valid"
    target = F.when(~is_valid, F.col(TARGET))
    n, held_out, low, high = rows.agg(
        F.count_if(~is_valid), F.count_if(is_valid), F.min(target), F.max(target)
    ).first()
    if not n:
        raise ValueError("no rows to train on")
    bits = trees.fixed_bits(n, max(abs(low), abs(high)))
    train = rows.filter(~is_valid)
    edges = trees.bin_edges(train, features, int(params["max_bin"]), seed, n, key)
    limits = Limits(
        int(params["num_leaves"]),
        int(params["max_depth"]),
        int(params["min_data_in_leaf"]),
        float(params["min_gain_to_split"]),
    )
    state = trees.with_bins(rows, features, edges).select(
        key, "split", "bins", F.col(TARGET).cast("double").alias("y"), F.lit(0.0).alias("prediction")
    )
    settings = json.dumps([params, seed, features, n, held_out, low, high], sort_keys=True)
    progress = Progress(folder or fresh_folder(data.sparkSession, "boosting"), settings)
    if found := progress.last(state):
        state, model, losses = found
    else:
        total = train.agg(F.sum(trees.fixed(F.col(TARGET), bits))).first()[0]
        model, losses = TreeModel(list(features), total / n / 2.0**bits, []), []
        state = state.withColumn("prediction", F.lit(model.base))

    before = None
    while True:
        done = len(model.trees)
        state = state.persist()
        error = F.col("y") - F.col("prediction")
        learns = ~is_valid & in_bag(params, seed, done, key)
        step = state.filter(learns | is_valid).select(
            "bins",
            F.when(is_valid, -1).otherwise(0).alias("node"),
            trees.fixed(error, bits).alias("value"),
            F.lit(1).alias("weight"),
            F.when(is_valid, error * error).alias("loss"),
        )
        allowed = chosen_features(features, float(params["feature_fraction"]), seed, done)
        growth = Growth(edges, limits, bits, np.array([allowed]))
        # The first job of a round also sees how well the rounds before it predict.
        loss = growth.grow(step, 1) if done < rounds else step.agg(F.sum("loss")).first()[0]
        if before is not None:
            before.unpersist()
        if done and held_out:
            losses.append(math.sqrt(loss / held_out))
        best = best_round(losses, patience) if losses else done
        if done == rounds or (losses and best + patience <= done):
            state.unpersist()
            return Boosted(model.first(best), best, losses)
        tree = growth.tree(0, float(params["learning_rate"]))
        model.trees.append(tree)
        before = state
        added = F.col("prediction") + F.col("step")
        state = trees.with_tree(state, tree).withColumn("prediction", added).drop("node", "step")
        if len(model.trees) % block == 0:
            state = progress.save(state, model, losses)
            if after_block:
                after_block(len(model.trees))


def poisson_weights(key: str, seed: int, n_trees: int) -> Column:
    """How often each of `n_trees` bootstrap samples draws a row: Poisson(1), from a hash of the row's key
    and the tree, so that every engine draws the same. One digest serves four trees."""
    ends, upto = [], 0.0
    for k in range(8):
        upto += math.exp(-1) / math.factorial(k)
        ends.append(math.floor(upto * 2**32))

    def weight(tree: Column) -> Column:
        name = F.concat_ws(
            ":", F.lit(f"{seed}:bootstrap"), F.floor(tree / 4).cast("string"), F.col(key).cast("string")
        )
        eight = F.substring(F.md5(name), 8 * (tree % 4) + 1, F.lit(8))
        u = F.conv(eight, 16, 10).cast("long")
        drawn = F.lit(0)
        for end in ends:
            drawn = drawn + (u >= end).cast("int")
        return drawn

    return F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), weight)


def bagged_forest(
    data: DataFrame,
    n_trees: int = 100,
    seed: int = SEED,
    max_depth: int = 5,
    max_bin: int = 32,
    min_rows: int = 1,
    features: list[str] = FEATURES,
    key: str = ROW_ID,
) -> TreeModel:
    """Mean of regression trees, each grown on its own bootstrap sample of the training rows.

    All trees grow at the same time, one job for each level. Every feature may be used at every split.
    An empty training part is an error.
    """
    train = data.filter(F.col("split") == "train")
    n, low, high = train.agg(F.count("*"), F.min(TARGET), F.max(TARGET)).first()
    if not n:
        raise ValueError("no rows to train on")
    # A bootstrap sample may be larger than the table, but hardly four times.
    bits = trees.fixed_bits(n, max(abs(low), abs(high)))
    edges = trees.bin_edges(train, features, max_bin, seed, n, key)
    rows = (
        trees.with_bins(train, features, edges)
        .select(
            "bins",
            trees.fixed(F.col(TARGET), bits).alias("value"),
            poisson_weights(key, seed, n_trees).alias("weights"),
            F.lit(None).cast("double").alias("loss"),
        )
        .persist()
    )
    growth = Growth(
        edges,
        Limits(2**max_depth, max_depth, min_rows, 0.0),
        bits,
        np.ones((n_trees, len(features)), bool),
    )
    drawn = rows.selectExpr("bins", "value", "loss", "posexplode(weights) AS (node, weight)")
    try:
        growth.grow(drawn.filter("weight > 0"), n_trees)
    finally:
        rows.unpersist()
    grown = [growth.tree(root) for root in range(n_trees)]
    return TreeModel(list(features), 0.0, grown, 1.0 / n_trees)
