"""Training, evaluation, explanation and scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlledger.operators import boosting
from mlledger.operators.boosting import Boosted, best_round  # noqa: F401
from mlledger.operators.params import DEFAULT_PATIENCE, DEFAULT_ROUNDS, DEFAULTS
from mlledger.operators.trees import TreeModel
from mlledger.schemas import FEATURES, SEED, TARGET, fixed_table

BASELINE_TREES, BASELINE_DEPTH = 100, 5
BASELINE_LIMIT = 10.0


def train(
    data: DataFrame,
    seed: int = SEED,
    rounds: int = DEFAULT_ROUNDS,
    patience: int = DEFAULT_PATIENCE,
    overrides: dict | None = None,
    folder: str | None = None,
) -> Boosted:
    """Boosted trees, cut at the best round on the validation rows.

    data has the gold columns and `split`. A second call with the same `folder` goes on from the last
    block of rounds that the first one finished. An override that the learner doesn't know is an error.
    """
    if unknown := set(overrides or {}) - set(DEFAULTS):
        raise ValueError(f"the learner has no parameters {sorted(unknown)}")
    return boosting.boost(data, {**DEFAULTS, **(overrides or {})}, seed, rounds, patience, folder)


def train_baseline(
    data: DataFrame, seed: int = SEED, trees: int = BASELINE_TREES, depth: int = BASELINE_DEPTH
) -> TreeModel:
    """Bagged forest on the same split, as a rough sanity check of the pipeline."""
    return boosting.bagged_forest(data, trees, seed, depth)


def regression_metrics(
    scored: DataFrame, label: str = TARGET, prediction: str = "prediction", prefix: str = ""
) -> DataFrame:
    """RMSE, MAE and R² in one aggregate over the scored rows."""
    error = F.col(label) - F.col(prediction)
    squared = F.sum(error * error)
    spread = F.var_pop(label) * F.count(label)
    return scored.agg(
        F.sqrt(squared / F.count(label)).alias(f"{prefix}rmse"),
        F.avg(F.abs(error)).alias(f"{prefix}mae"),
        (1 - squared / F.nullif(spread, F.lit(0.0))).alias(f"{prefix}r2"),
    )


def baseline_is_sane(metrics: dict) -> bool:
    """Whether the model's RMSE is within a factor of ten of the baseline's, both ways."""
    ratio = metrics["rmse"] / metrics["baseline_rmse"]
    return 1 / BASELINE_LIMIT < ratio < BASELINE_LIMIT


def feature_importance(nodes: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """feature, gain, split from the node table of a model: the loss that its splits take away, and
    their number. Features no tree uses get zeros."""
    inner = nodes.filter("feature_no >= 0")
    used = inner.groupBy("feature_no").agg(
        F.sum("gain").alias("gain"), F.count("*").alias("split")
    )
    names = fixed_table(nodes.sparkSession, ["feature_no", "feature"], list(enumerate(features)))
    return (
        names.join(used, "feature_no", "left")
        .fillna(0, ["gain", "split"])
        .select("feature", "gain", "split")
    )


def missing_features(columns: list[str], features: list[str] = FEATURES) -> list[str]:
    return [c for c in features if c not in columns]


def score(model: TreeModel, df: DataFrame) -> DataFrame:
    """Add `prediction`. Features are taken by name, so their order in the input is free."""
    missing = missing_features(df.columns)
    if missing:
        raise ValueError(f"missing features: {missing}")
    return model.transform(df)


def payload_instances(requests: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Explode {"instances": [{...}]} bodies: request_no, request_id, position, error, features.

    A body that is no such object, an empty list, or an instance without a feature gives a row
    with `error`. request_no tells apart requests that share an id.
    """
    fields = ", ".join(f"{c}: string" for c in features)
    parsed = F.from_json("body", f"instances array<struct<{fields}>>")
    ids = ["request_no", "request_id"]
    numbered = requests.withColumn("request_no", F.monotonically_increasing_id())
    rows = numbered.select(*ids, parsed["instances"].alias("instances")).select(
        *ids, F.posexplode_outer("instances").alias("position", "instance")
    )
    texts = [F.col("instance")[c].alias(c) for c in features]
    numbers = [F.col(c).try_cast("double").alias(c) for c in features]
    lacking = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in features])
    flat = rows.select(
        *ids, "position", F.col("position").isNull().alias("empty"), *texts
    ).select(*ids, "position", "empty", lacking.alias("lacking"), *numbers)
    no_number = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in features])
    error = (
        F.when(F.col("empty"), "no instances")
        .when(F.col("lacking") != "", F.concat(F.lit("missing features: "), "lacking"))
        .when(no_number, "feature is no number")
    )
    return flat.select(*ids, "position", error.alias("error"), *features)


def score_payloads(model: TreeModel, requests: DataFrame) -> DataFrame:
    """request_no, request_id, position, prediction, error: every instance's answer as a row.

    Unusable instances pass through the model with zeros, so the payloads are read and parsed
    once; their prediction is then removed.
    """
    scored = score(model, payload_instances(requests).fillna(0.0, FEATURES))
    prediction = F.when(F.col("error").isNull(), F.col("prediction"))
    return scored.select(
        "request_no", "request_id", "position", prediction.alias("prediction"), "error"
    )


def payload_answers(scored: DataFrame) -> DataFrame:
    """request_id, predictions, error: one answer per request, no longer than its body was.

    One bad instance fails its whole request, as one answer covers all of its instances.
    """
    pair = F.struct("position", "prediction")
    answers = scored.groupBy("request_no", "request_id").agg(
        F.array_sort(F.collect_list(pair)).alias("pairs"), F.min("error").alias("error")
    )
    predictions = F.when(F.col("error").isNull(), F.col("pairs.prediction"))
    return answers.select("request_id", predictions.alias("predictions"), "error")


def prediction_parity(scored: DataFrame, by: Column | str, tolerance: float = 1e-6) -> DataFrame:
    """Whether scoring runs agree per instance: distinct predictions and their spread."""
    spread = F.max("prediction") - F.min("prediction")
    return scored.groupBy(by).agg(
        F.count("*").alias("scored"),
        F.count_distinct("prediction").alias("distinct_predictions"),
        spread.alias("spread"),
        (spread < tolerance).alias("within_tolerance"),
    )
