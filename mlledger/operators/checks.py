"""Contract checks over recorded runs. Each returns the offending rows, or a labelled table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlledger.operators.ledger import golden_rows
from mlledger.schemas import FAILURE_CLASSES, RUN_DOMAINS, platform_dim

TOLERANCE = 1e-6
REVISION_SHAPE = "^[0-9a-f]{40}$"


def bad_revisions(runs: DataFrame) -> DataFrame:
    """Runs whose code revision is missing or not a 40-digit hash."""
    good = F.coalesce(F.col("code_revision").rlike(REVISION_SHAPE), F.lit(False))
    return runs.filter(~good).select("run_id", "platform", "code_revision")


def domain_violations(runs: DataFrame) -> DataFrame:
    """(run_id, column_name, value) of every text outside its domain, nulls included."""
    domains = {**RUN_DOMAINS, "failure_class": FAILURE_CLASSES}
    cells = F.array(
        *[
            F.when(
                ~F.coalesce(F.col(name).isin(values), F.lit(False)),
                F.struct(F.lit(name).alias("column_name"), F.col(name).alias("value")),
            )
            for name, values in domains.items()
        ]
    )
    broken = reduce(
        lambda a, b: a | b,
        [~F.coalesce(F.col(n).isin(v), F.lit(False)) for n, v in domains.items()],
    )
    return (
        runs.filter(broken)
        .select("run_id", F.explode(cells).alias("cell"))
        .filter(F.col("cell").isNotNull())
        .select("run_id", "cell.column_name", "cell.value")
    )


def parity_deviation(runs: DataFrame, baseline_rmse: float) -> DataFrame:
    """Distance of each platform's golden RMSE from the baseline, and whether it is in tolerance."""
    gap = F.abs(F.col("rmse") - F.lit(baseline_rmse))
    return golden_rows(runs).select(
        "platform",
        "rmse",
        gap.alias("deviation"),
        (gap < TOLERANCE).alias("within_tolerance"),
    )


def parity_spread(runs: DataFrame) -> DataFrame:
    """Spread of the golden RMSE over the platforms."""
    spread = F.max("rmse") - F.min("rmse")
    return golden_rows(runs).agg(
        F.count("*").alias("platforms"),
        spread.alias("spread"),
        (spread < TOLERANCE).alias("within_tolerance"),
    )


def platform_coverage(runs: DataFrame) -> DataFrame:
    """Expected against recorded platforms: `both`, `missing` or `extra`."""
    expected = platform_dim(runs.sparkSession).select("platform", F.lit(1).alias("_expected"))
    recorded = runs.select("platform").distinct().withColumn("_recorded", F.lit(1))
    label = (
        F.when(F.col("_recorded").isNull(), "missing")
        .when(F.col("_expected").isNull(), "extra")
        .otherwise("both")
    )
    joined = expected.join(recorded, "platform", "full_outer")
    return joined.select("platform", label.alias("coverage"))


def unknown_revisions(runs: DataFrame, known: DataFrame, exempt: DataFrame) -> DataFrame:
    """Recorded revisions that do not resolve and are not on the list of named exceptions.

    Runs are reduced to their distinct revisions first, so a revision shared by very many runs
    is one row in the joins. All inputs have a column code_revision.
    """
    recorded = runs.groupBy("code_revision").agg(F.count("*").alias("runs"))
    return recorded.join(known, "code_revision", "left_anti").join(
        exempt, "code_revision", "left_anti"
    )


def training_trees(runs: DataFrame, trees: DataFrame) -> DataFrame:
    """(revisions, trees, single_tree): whether all resolvable runs share one training tree."""
    recorded = runs.select("code_revision").distinct()
    resolved = recorded.join(trees, "code_revision")
    return resolved.agg(
        F.count("*").alias("revisions"),
        F.count_distinct("tree_hash").alias("trees"),
        (F.count_distinct("tree_hash") <= 1).alias("single_tree"),
    )
