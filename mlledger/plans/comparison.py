"""The comparison reports over the run and infrastructure ledgers.

Every report takes a population (see `population`) and returns unsorted rows; `ordered` sorts
where a report is shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mlledger.functions.jsontext import (
    array_size,
    canonical_stage,
    has_key,
    is_teardown,
    text_of,
)
from mlledger.operators.exact import number_within
from mlledger.operators.ledger import per_platform
from mlledger.schemas import PLATFORMS, STAGES, platform_dim
from mlledger.session import durable

# Fixed value: end of the first measured campaign (UTC).
CAMPAIGN_END = "2026-08-01 15:00:00"

_SECONDS = "decimal(18,6)"


def population(ledger: DataFrame, cutoff: str = CAMPAIGN_END) -> DataFrame:
    """Rows created before the cutoff, a UTC time. A plain range filter, so it reaches the scan."""
    kind = dict(ledger.dtypes)["created_at"]
    end = f"{cutoff}+00:00" if kind == "timestamp" else cutoff
    return ledger.filter(F.col("created_at") < F.lit(end).cast(kind))


def register_populations(
    runs: DataFrame, infra: DataFrame, cutoff: str = CAMPAIGN_END
) -> None:
    """The populations as temp views for SQL users."""
    population(runs, cutoff).createOrReplaceTempView("baseline_runs")
    population(infra, cutoff).createOrReplaceTempView("baseline_infra_events")


def without_teardown(runs: DataFrame) -> DataFrame:
    return runs.filter(~is_teardown("params"))


def _measured(runs: DataFrame) -> DataFrame:
    return runs.filter(
        (F.col("stage") == "train") & (F.col("status") == "success") & has_key("metrics", "rmse")
    ).withColumn("rmse", text_of("metrics", "rmse"))


def metric_parity(runs: DataFrame) -> DataFrame:
    """Whether all platforms report the same RMSE. Not grouped by revision on purpose.

    Revisions are counted here and listed as rows by `parity_revisions`, since their number
    grows with the ledger; the platform list has five entries at most. The runs are reduced to
    their distinct combinations first, as several distinct counts multiply their input.
    """
    number = F.col("rmse").try_cast("double")
    values = _measured(runs).select("platform", "rmse", "code_revision").distinct()
    return values.agg(
        F.count_distinct("platform").alias("platforms"),
        F.count_distinct("rmse").alias("distinct_rmse"),
        F.min("rmse").alias("rmse_min"),
        F.max("rmse").alias("rmse_max"),
        F.array_join(F.array_sort(F.collect_set("platform")), ",").alias("platform_list"),
        F.count_distinct("code_revision").alias("code_revisions"),
        (F.max(number) - F.min(number)).alias("spread"),
    )


def parity_revisions(runs: DataFrame) -> DataFrame:
    """The distinct code revisions behind metric_parity."""
    return _measured(runs).select("code_revision").distinct()


def numbered_tries(runs: DataFrame) -> DataFrame:
    """Try number per (platform, stage) in time order, teardown rows left out."""
    kept = without_teardown(runs).select("run_id", "platform", "stage", "status", "created_at")
    return number_within(kept, ["platform", "stage"], ["created_at", "run_id"], "try_number")


def friction(runs: DataFrame) -> DataFrame:
    """Tries until the first success and failures per (platform, stage); null: never worked.

    The try number of the first success is the number of rows up to it, so two partial
    aggregates give it and no task sorts a whole (platform, stage), however large. Whatever
    platforms and stages there are count; the first successes are one row each, and Spark
    broadcasts them if their measured size allows.
    """
    kept = without_teardown(runs).select("platform", "stage", "status", "created_at", "run_id")
    moment = F.struct("created_at", "run_id")
    first = (
        kept.filter(F.col("status") == "success")
        .groupBy("platform", "stage")
        .agg(F.min(moment).alias("first_success"))
    )
    joined = kept.join(first, ["platform", "stage"], "left")
    reached = F.count_if(moment <= F.col("first_success"))
    return joined.groupBy("platform", "stage").agg(
        F.when(reached > 0, reached).alias("attempts_until_success"),
        F.count_if(F.col("status") == "failure").alias("recorded_failures"),
    )


def friction_by_window(runs: DataFrame) -> DataFrame:
    """The same report from numbered tries; used to check `friction`."""
    return (
        numbered_tries(runs)
        .groupBy("platform", "stage")
        .agg(
            F.min(F.when(F.col("status") == "success", F.col("try_number"))).alias(
                "attempts_until_success"
            ),
            F.count_if(F.col("status") == "failure").alias("recorded_failures"),
        )
    )


def failure_mix(runs: DataFrame) -> DataFrame:
    failed = without_teardown(runs).filter(F.col("status") == "failure")
    return failed.groupBy("platform", "stage", "failure_class").agg(
        F.count("*").alias("failures")
    )


def stage_durations(runs: DataFrame) -> DataFrame:
    """Successes, their mean duration, and the longest duration per platform and stage.

    Durations are summed as decimals, so the mean is the same whatever the partitioning.
    """
    seconds = F.col("duration_seconds").cast(_SECONDS)
    worked = F.col("status") == "success"
    return (
        runs.withColumn("stage", canonical_stage("stage", "params"))
        .groupBy("platform", "tier", "stage")
        .agg(
            F.count_if(worked).alias("success_runs"),
            F.round(F.avg(F.when(worked, seconds)), 1).cast("double").alias("avg_seconds"),
            F.round(F.max(seconds), 1).cast("double").alias("max_seconds"),
        )
    )


def teardown_quality(infra: DataFrame) -> DataFrame:
    """Every destroy with the number of findings it recorded."""
    return infra.filter(F.col("action") == "destroy").select(
        "platform",
        "created_at",
        "status",
        "duration_seconds",
        array_size("residual_resources", "findings").alias("finding_count"),
        "residual_resources",
    )


def write_paths(runs: DataFrame) -> DataFrame:
    return without_teardown(runs).groupBy("platform", "tier", "write_path").agg(
        F.count("*").alias("runs")
    )


def infra_friction(infra: DataFrame) -> DataFrame:
    """Tries and failures of infrastructure operations; never added to run friction."""
    return infra.groupBy("platform", "action").agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("status") == "failure").alias("failures"),
    )


def register_reports(
    runs: DataFrame, infra: DataFrame, cutoff: str = CAMPAIGN_END
) -> list[str]:
    """Every report of a campaign as a temp view of its name, for SQL users."""
    campaign, operations = population(runs, cutoff), population(infra, cutoff)
    reports = {
        "metric_parity": metric_parity(campaign),
        "parity_revisions": parity_revisions(campaign),
        "friction": friction(campaign),
        "failure_mix": failure_mix(campaign),
        "stage_durations": stage_durations(campaign),
        "teardown_quality": teardown_quality(operations),
        "write_paths": write_paths(campaign),
        "infra_friction": infra_friction(operations),
    }
    for name, report in reports.items():
        report.createOrReplaceTempView(name)
    return list(reports)


# Sort order in which each report is shown: column and whether it ascends.
REPORT_ORDER = {
    "friction": [("platform", True), ("stage", True)],
    "failure_mix": [("platform", True), ("stage", True), ("failures", False)],
    "stage_durations": [("stage", True), ("platform", True)],
    "teardown_quality": [("platform", True), ("created_at", False)],
    "write_paths": [("platform", True), ("write_path", True)],
}


def ordered(report: DataFrame, name: str) -> DataFrame:
    keys = REPORT_ORDER[name]
    return report.orderBy(*[c for c, _ in keys], ascending=[up for _, up in keys])


def ranked(report: DataFrame, name: str) -> DataFrame:
    """The report with `row_no`, its place in report order from 1, for readers that keep no order.
    Rows that the report leaves in no order follow its other columns. One task numbers them, as a
    reader is shown them one by one."""
    keys = [F.col(c).asc() if up else F.col(c).desc() for c, up in REPORT_ORDER[name]]
    rest = sorted(set(report.columns) - {c for c, _ in REPORT_ORDER[name]})
    return report.withColumn("row_no", F.row_number().over(Window.orderBy(*keys, *rest)))


def _run_cells(runs: DataFrame) -> DataFrame:
    """Run counts and seconds per combination of the fixed domains: one scan, few rows.

    Several axes read them, so they are computed once.
    """
    return durable(
        runs.groupBy(
            "platform",
            canonical_stage("stage", "params").alias("stage"),
            is_teardown("params").alias("torn_down"),
            "status",
            "failure_class",
            "write_path",
        ).agg(
            F.count("*").alias("n"),
            F.sum(F.col("duration_seconds").cast(_SECONDS)).alias("seconds"),
        )
    )


def selection_matrix(runs: DataFrame, infra: DataFrame) -> DataFrame:
    """Axes by platforms; every input is a few aggregated rows per platform."""
    cells = _run_cells(runs)
    live = cells.filter(~F.col("torn_down"))
    fixes = friction(runs).groupBy("platform").agg(
        F.sum(F.greatest(F.col("attempts_until_success") - 1, F.lit(0))).alias("fixes")
    )
    failures = (
        live.filter(F.col("status") == "failure")
        .groupBy("platform", "failure_class")
        .agg(F.sum("n").alias("n"))
        .groupBy("platform")
        .agg(F.array_sort(F.collect_list(F.concat_ws(" ", "failure_class", "n"))).alias("mix"))
    )
    paths = live.groupBy("platform").agg(F.array_sort(F.collect_set("write_path")).alias("paths"))
    trained = cells.filter((F.col("stage") == "train") & (F.col("status") == "success"))
    train = trained.groupBy("platform").agg(
        F.round(F.sum("seconds") / F.sum("n"), 1).cast("double").alias("train_seconds")
    )
    found = array_size("residual_resources", "findings")
    destroyed = F.col("action") == "destroy"
    ops = infra.groupBy("platform").agg(
        F.count_if(F.col("action") == "apply").alias("applies"),
        F.count_if(destroyed).alias("destroys"),
        F.max(F.when(destroyed, found)).alias("findings"),
    )
    wide = platform_dim(runs.sparkSession)
    for part in [fixes, failures, paths, train, ops]:
        wide = per_platform(wide, part)
    axes = {
        "tier": F.concat_ws(" / ", "tier", "unification_unit"),
        "fixes until success": F.col("fixes"),
        "failure classes": F.array_join("mix", " / "),
        "write path": F.array_join("paths", " / "),
        "train seconds": F.col("train_seconds"),
        "apply tries": F.col("applies"),
        "destroy tries": F.col("destroys"),
        "most findings": F.col("findings"),
    }
    entries = [
        F.struct(F.lit(name).alias("axis"), value.cast("string").alias("value"))
        for name, value in axes.items()
    ]
    return (
        wide.select("platform", F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.axis")
        .pivot("platform", PLATFORMS)
        .agg(F.first("e.value"))
    )


def phase_scorecard(runs: DataFrame, infra: DataFrame) -> DataFrame:
    """The seven measurable conditions of a finished phase per platform, also without any row."""
    worked = F.col("status") == "success"

    def stage_done(stage: str):
        return F.bool_or(worked & (canonical_stage("stage", "params") == stage))

    by_run = runs.groupBy("platform").agg(
        stage_done("train").alias("c2_trained"),
        F.bool_or(
            worked & (F.col("stage") == "train") & has_key("metrics", "rmse")
            & F.col("write_path").isNotNull()
        ).alias("c3_metrics_delivered"),
        stage_done("register").alias("c4_registered"),
        stage_done("predict").alias("c5_predicted"),
    )
    done = F.col("status") == "success"
    by_event = infra.groupBy("platform").agg(
        F.bool_or(done & (F.col("action") == "apply")).alias("c1_applied"),
        F.bool_or(done & (F.col("action") == "destroy")).alias("c6_destroyed"),
        F.bool_or(
            (F.col("action") == "destroy") & has_key("residual_resources", "findings")
        ).alias("c7_residuals_recorded"),
    )
    names = [
        "c1_applied",
        "c2_trained",
        "c3_metrics_delivered",
        "c4_registered",
        "c5_predicted",
        "c6_destroyed",
        "c7_residuals_recorded",
    ]
    dim = platform_dim(runs.sparkSession).select("platform")
    joined = per_platform(per_platform(dim, by_run), by_event)
    return joined.select(
        "platform", *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in names]
    )
