"""Building, joining and reading the run ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlledger.functions.classify import error_excerpt, exit_failure_class, exit_status
from mlledger.functions.jsontext import has_key, or_empty_object, text_of
from mlledger.operators.exact import first_per_key
from mlledger.schemas import PLATFORM_ROWS, PLATFORMS, RUN_SCHEMA, STAGES, fixed_table

# Params keys that hand a value to the next stage; earlier model keys win.
ARTIFACT_KEY = "model_artifact_uri"
MODEL_KEYS = ["model_resource_name", "model_version", "model_package_arn"]


def with_platform(df: DataFrame) -> DataFrame:
    """Add tier and unification_unit.

    The dimension has five fixed rows, so the lookup is an expression in the projection: no
    join, nothing to broadcast, and pruned where it is unused. An unknown platform keeps its row
    with nulls, which the domain checks report.
    """
    tiers = F.create_map(*[F.lit(v) for p, tier, _ in PLATFORM_ROWS for v in (p, tier)])
    units = F.create_map(*[F.lit(v) for p, _, unit in PLATFORM_ROWS for v in (p, unit)])
    return df.withColumns(
        {"tier": tiers[F.col("platform")], "unification_unit": units[F.col("platform")]}
    )


def per_platform(dim: DataFrame, report: DataFrame) -> DataFrame:
    """Attach a report with one row per platform to the platforms; clean platforms keep a row.

    A platform of the report that the dimension lacks keeps its row, too.
    """
    return dim.join(report, "platform", "full_outer")


def stamp_created(df: DataFrame) -> DataFrame:
    """created_at is set when the row enters the ledger, unless it came with one."""
    if "created_at" not in df.columns:
        return df.withColumn("created_at", F.current_timestamp())
    return df.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))


def as_runs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RUN_SCHEMA.fields])


def absent_rows(
    incoming: DataFrame, existing: DataFrame, key: str, order: list[Column] | None = None
) -> DataFrame:
    """Incoming rows whose key the table does not hold yet, one per key.

    Only the key column of the table is read. It is first reduced to the keys that are offered
    again: where these are few, Spark broadcasts them by their measured size, and a small batch
    doesn't shuffle the table.
    """
    others = [F.col(c) for c in sorted(incoming.columns) if c != key]
    unique = first_per_key(incoming, [key], order or others)
    offered = incoming.select(key).distinct()
    held = existing.select(key).join(offered, key, "left_semi")
    return unique.join(held, key, "left_anti")


def load_counts(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(fetched, inserted, skipped, total) of an insert-if-absent, as one row."""
    offered = incoming.groupBy(key).agg(F.count("*").alias("offered"))
    held = existing.select(key).withColumn("held", F.lit(1))
    return (
        offered.join(held, key, "full_outer")
        .agg(
            F.coalesce(F.sum("offered"), F.lit(0)).alias("fetched"),
            F.count_if(F.col("held").isNull()).alias("inserted"),
            F.count("*").alias("total"),
        )
        .withColumn("skipped", F.col("fetched") - F.col("inserted"))
    )


def union_paths(direct: DataFrame, collected: DataFrame, key: str = "run_id") -> DataFrame:
    """Both delivery paths as one ledger; a run that arrived directly wins over its copies.

    The direct ledger holds a run once, so its rows stay where they are: only its keys are
    shuffled, against the collected rows.
    """
    late = absent_rows(collected, direct, key, [F.col("created_at"), F.col("attempt")])
    return direct.withColumn("write_path", F.lit("direct")).unionByName(
        late.withColumn("write_path", F.lit("collected"))
    )


def reconcile_ownership(job_log: DataFrame, adapter_log: DataFrame) -> DataFrame:
    """The job writes train successes and its own failures; the adapter writes the rest.

    A train success in the adapter log only says that the job was handed over. The job log holds
    a run once, so only its keys are shuffled.
    """
    handed_over = F.coalesce(
        (F.col("stage") == "train") & (F.col("status") == "success"), F.lit(False)
    )
    order = [F.col("created_at"), F.col("attempt")]
    rest = absent_rows(adapter_log.filter(~handed_over), job_log, "run_id", order)
    return job_log.unionByName(rest)


def next_attempts(runs: DataFrame) -> DataFrame:
    """The attempt number the next run of each (platform, stage) gets; 1 where none ran yet.

    All pairs of the fixed domains have a row, and so has any other pair that occurs.
    """
    held = runs.groupBy("platform", "stage").agg(F.count("*").alias("runs"))
    pairs = fixed_table(
        runs.sparkSession, ["platform", "stage"], [(p, s) for p in PLATFORMS for s in STAGES]
    )
    return pairs.join(held, ["platform", "stage"], "full_outer").select(
        "platform", "stage", (F.coalesce("runs", F.lit(0)) + 1).alias("next_attempt")
    )


def runs_from_jobs(jobs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Ledger rows from job outcomes; what the manifest says wins over the arguments.

    jobs: platform, output_dir, run_id, exit_code, attempt, duration_seconds, error_text,
    code_revision. A row without any run id keeps `problem` and stays out of the ledger.
    """
    wanted = ["run_id", "code_revision", "metrics", "params"]
    written = manifests.select(
        "output_dir", *[F.col(c).alias(f"manifest_{c}") for c in wanted]
    )
    joined = with_platform(jobs.join(written, "output_dir", "left"))

    def non_empty(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    run_id = F.coalesce(non_empty("manifest_run_id"), non_empty("run_id"))
    revision = F.coalesce(non_empty("manifest_code_revision"), non_empty("code_revision"))
    status = exit_status("exit_code")
    return joined.select(
        run_id.alias("run_id"),
        "platform",
        "tier",
        "unification_unit",
        F.lit("train").alias("stage"),
        status.alias("status"),
        F.coalesce("attempt", F.lit(1)).alias("attempt"),
        "duration_seconds",
        exit_failure_class("exit_code").alias("failure_class"),
        error_excerpt(F.col("error_text"), status).alias("error_excerpt"),
        revision.alias("code_revision"),
        F.lit("direct").alias("write_path"),
        or_empty_object("manifest_metrics").alias("metrics"),
        or_empty_object("manifest_params").alias("params"),
        F.when(run_id.isNull(), "run_id")
        .when(revision.isNull(), "code_revision")
        .alias("problem"),
    )


def merge_params(
    runs: DataFrame, patches: DataFrame, reached: Column | None = None
) -> DataFrame:
    """Shallow JSON merge of patches into params; the patch wins, and no row is added.

    patches: run_id, patch (JSON object text), patch_no. Several patches of one run are first
    reduced to the last value per key, so a run with very many patches is combined map-side.
    Params that are no JSON object stay as they are (`merge_outcomes` names such runs). `reached`
    says which runs patches apply to; by default all.
    """
    given = F.from_json("params", "map<string,variant>")
    merged = F.map_concat(
        F.map_filter(
            given,
            lambda k, v: ~F.coalesce(F.map_contains_key("patch_map", k), F.lit(False)),
        ),
        F.col("patch_map"),
    )
    applies = F.col("patch_map").isNotNull() & given.isNotNull()
    if reached is not None:
        applies = applies & F.coalesce(reached, F.lit(False))
    patched = F.when(applies, F.to_json(merged)).otherwise(F.col("params"))
    return (
        runs.withColumn("params", or_empty_object("params"))
        .join(last_patches(patches), "run_id", "left")
        .withColumn("params", patched)
        .drop("patch_map")
    )


def last_patches(patches: DataFrame) -> DataFrame:
    """(run_id, patch_map): the last value per run and key. Keys are few, so the map is small."""
    entries = patches.select(
        "run_id",
        "patch_no",
        F.explode(F.from_json("patch", "map<string,variant>")).alias("key", "value"),
    ).withColumn("value", F.to_json("value"))
    # Of two patches with one number the larger text wins, so the result is always the same.
    newest = F.max(F.struct("patch_no", "value"))["value"]
    last = entries.groupBy("run_id", "key").agg(newest.alias("value"))
    pair = F.struct("key", F.parse_json("value").alias("value"))
    return last.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(pair)).alias("patch_map")
    )


def merge_outcomes(runs: DataFrame, patches: DataFrame) -> DataFrame:
    """What a hand-over merge did per run: merged, absent, skipped_collected, or unreadable.

    A collected row reaches the ledger later than its patch, so it is never merged; params that are
    no JSON object are unreadable and stay. Runs that hand over nothing are left out.
    """
    asked = (
        patches.filter(F.size(F.json_object_keys("patch")) > 0).select("run_id").distinct()
    )
    outcome = (
        F.when(F.col("write_path").isNull(), "absent")
        .when(F.col("write_path") == "collected", "skipped_collected")
        .when(F.from_json("params", "map<string,variant>").isNull(), "unreadable")
        .otherwise("merged")
    )
    held = runs.select("run_id", "write_path", or_empty_object("params").alias("params"))
    return asked.join(held, "run_id", "left").select(
        "run_id", outcome.alias("outcome")
    )


def handoff_merge(runs: DataFrame, patches: DataFrame) -> DataFrame:
    """merge_params right after training, which only reaches directly delivered rows."""
    return merge_params(runs, patches, F.col("write_path") == "direct")


def first_success(runs: DataFrame) -> DataFrame:
    """The earliest successful train run with an RMSE per platform."""
    hits = runs.filter(
        (F.col("stage") == "train") & (F.col("status") == "success") & has_key("metrics", "rmse")
    )
    return first_per_key(hits, ["platform"], [F.col("created_at"), F.col("run_id")])


def golden_rows(runs: DataFrame) -> DataFrame:
    """first_success with its metrics as numbers: the rows of a golden snapshot."""
    metric = [text_of("metrics", m).try_cast("double").alias(m) for m in ["rmse", "mae", "r2"]]
    return first_success(runs).select("platform", "tier", "code_revision", "write_path", *metric)


def latest_carrying(runs: DataFrame, stage: str, keys: list[str]) -> DataFrame:
    """Per platform and key: the newest success of the stage whose params hold the key.

    Returns platform, key, key_no, run_id, code_revision, value, created_at; a newest row whose
    value is null or empty drops out and is not replaced by an older one.
    """
    hits = runs.filter((F.col("stage") == stage) & (F.col("status") == "success"))
    options = F.array(
        *[
            F.when(
                has_key("params", key),
                F.struct(
                    F.lit(no).alias("key_no"),
                    F.lit(key).alias("key"),
                    text_of("params", key).alias("value"),
                ),
            )
            for no, key in enumerate(keys)
        ]
    )
    rows = hits.select(
        "platform", "run_id", "code_revision", "created_at", F.explode(options).alias("o")
    ).filter(F.col("o").isNotNull())
    flat = rows.select("platform", "run_id", "code_revision", "created_at", "o.*")
    newest = first_per_key(
        flat, ["platform", "key_no"], [F.col("created_at").desc(), F.col("run_id").desc()]
    )
    return newest.filter(F.col("value") != "")


def latest_artifact(runs: DataFrame) -> DataFrame:
    """Where a resumed registration finds the model of each platform."""
    return latest_carrying(runs, "train", [ARTIFACT_KEY])


def latest_model_ref(runs: DataFrame) -> DataFrame:
    """The model reference a resumed deployment uses: the first key in priority with a value."""
    points = latest_carrying(runs, "register", MODEL_KEYS)
    return first_per_key(points, ["platform"], [F.col("key_no")])


def latest_version(versions: DataFrame, *by: str) -> DataFrame:
    """Highest integer version; entries that are no integer do not count."""
    newest = F.max(F.col("version").try_cast("long")).alias("latest_version")
    return versions.groupBy(*by).agg(newest).filter(F.col("latest_version").isNotNull())


def revision_verdicts(points: DataFrame, trees: DataFrame, current_revision: str) -> DataFrame:
    """Whether each resume point was made by the training code of the current revision.

    trees: code_revision, tree_hash. An unknown hash on either side gives `unknown`, never a match.
    """
    current_tree = (
        trees.filter(F.col("code_revision") == current_revision).agg(F.max("tree_hash")).scalar()
    )
    recorded = trees.withColumnRenamed("tree_hash", "recorded_tree")
    joined = points.join(recorded, "code_revision", "left").withColumn(
        "current_tree", current_tree
    )
    verdict = (
        F.when(F.col("code_revision") == current_revision, "same_revision")
        .when(F.col("current_tree").isNull() | F.col("recorded_tree").isNull(), "unknown")
        .when(F.col("current_tree") == F.col("recorded_tree"), "same_tree")
        .otherwise("different")
    )
    return joined.withColumn("verdict", verdict)
