"""One query per operator, over the stand-in inputs. Each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlledger.functions.classify import (
    error_excerpt,
    exit_failure_class,
    exit_status,
    missing_in_sdk,
    missing_object,
    parent_absent,
    with_failure_class,
)
from mlledger.functions.jsontext import array_size, text_of
from mlledger.operators import boosting, checks, costs, exact, ledger, modeling, params, prep, residual
from mlledger.operators.trees import TreeModel
from mlledger.plans import comparison, mirror
from mlledger.plans.training import TrainingConfig, run_training
from mlledger.schemas import FEATURES, ROW_ID, RUN_LINE_SCHEMA, TARGET
from mlledger.session import durable, fresh_folder
from mlledger.sinks import files
from mlledger.sinks import tables as sinks
from mlledger.sources import artifacts, ledger_files, tables
from mlledger.sources.exports import read_inventory, read_transcripts, resource_count
from mlledger.streaming import collect
from workload import standins as s

#: A fit of a few rounds and leaves, which SQL can follow step by step.
SMALL_FIT = {"learning_rate": 0.3, "num_leaves": 4, "feature_fraction": 1.0, "bagging_freq": 2}
SMALL_ROUNDS = 3
#: A fit that soon gets no better.
EAGER_FIT = SMALL_FIT | {"learning_rate": 0.9, "num_leaves": 6, "min_data_in_leaf": 5}
EAGER_ROUNDS, EAGER_PATIENCE = 14, 3
SMALL_FOREST = {"n_trees": 3, "max_depth": 2}
WHOLE = {"today": "2002-01-01", "days": 3000}
WEEK = {"today": "2000-06-15", "days": 7}


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def campaign_runs(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.population(s.runs(spark, sf), s.CUTOFF)


def campaign_infra(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.population(s.infra(spark, sf), s.CUTOFF)


# comparison reports


def friction(spark, sf):
    return comparison.friction(campaign_runs(spark, sf))


def report_order(spark, sf):
    """Every row of three reports with its place in report order."""
    runs, infra = campaign_runs(spark, sf), campaign_infra(spark, sf)
    failures = comparison.ranked(comparison.failure_mix(runs), "failure_mix")
    paths = comparison.ranked(comparison.write_paths(runs), "write_paths")
    teardown = comparison.ranked(comparison.teardown_quality(infra), "teardown_quality")
    columns = ["platform", "row_no"]
    return (
        failures.select(F.lit("failure_mix").alias("report"), *columns, F.concat_ws("/", "stage", "failure_class").alias("what"))
        .unionByName(paths.select(F.lit("write_paths").alias("report"), *columns, F.col("write_path").alias("what")))
        .unionByName(
            teardown.select(F.lit("teardown_quality").alias("report"), *columns, stamp("created_at").alias("what"))
        )
    )


def friction_by_window(spark, sf):
    return comparison.friction_by_window(campaign_runs(spark, sf))


def try_numbers(spark, sf):
    numbered = comparison.numbered_tries(campaign_runs(spark, sf))
    return numbered.select("run_id", "platform", "stage", "try_number")


def failure_mix(spark, sf):
    return comparison.failure_mix(campaign_runs(spark, sf))


def stage_durations(spark, sf):
    return comparison.stage_durations(campaign_runs(spark, sf))


def write_paths(spark, sf):
    return comparison.write_paths(campaign_runs(spark, sf))


def teardown_quality(spark, sf):
    return comparison.teardown_quality(campaign_infra(spark, sf)).select(
        "platform",
        stamp("created_at").alias("created_at"),
        "status",
        "duration_seconds",
        "finding_count",
        F.coalesce("residual_resources", F.lit("")).alias("residual_resources"),
    )


def metric_parity(spark, sf):
    report = comparison.metric_parity(campaign_runs(spark, sf))
    return report.withColumn("spread", F.round("spread", 9))


def parity_revisions(spark, sf):
    return comparison.parity_revisions(campaign_runs(spark, sf))


def infra_friction(spark, sf):
    return comparison.infra_friction(campaign_infra(spark, sf))


def selection_matrix(spark, sf):
    return comparison.selection_matrix(campaign_runs(spark, sf), campaign_infra(spark, sf))


def phase_scorecard(spark, sf):
    return comparison.phase_scorecard(campaign_runs(spark, sf), campaign_infra(spark, sf))


# preparation


def summary_stats(spark, sf):
    report = prep.target_summary(s.housing(spark, sf))
    return report.select("rows", *[F.round(c, 5).alias(c) for c in ["mean", "min", "max", "std"]])


def page(spark, sf):
    return tables.page(s.housing(spark, sf), 50, 100).select(ROW_ID, "population", TARGET)


def page_after(spark, sf):
    """Three pages, each asked for with the last key of the one before."""
    h = s.housing(spark, sf).select(ROW_ID, "population", TARGET)
    pages, last = [], None
    for number in range(1, 4):
        found = tables.page_after(h, 50, last)
        last = found.agg(F.max(ROW_ID)).first()[0]
        pages.append(found.withColumn("page", F.lit(number)))
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


def dataset_scan(spark, sf):
    """The training table written as Parquet and read with its schema."""
    h = s.housing(spark, sf)
    path = fresh_folder(spark, "dataset.parquet")
    h.write.parquet(path)
    read = tables.read_dataset(spark, path, h.schema)
    return read.groupBy("ave_occup").agg(
        F.count("*").alias("n"), F.sum("population").cast("long").alias("population")
    )


def lookup(spark, sf):
    ids = s.table(spark, sf, "lineitem").filter(F.col("l_quantity") == 50).select("l_orderkey")
    return tables.lookup(s.housing(spark, sf), ids).select(ROW_ID, "population")


def sample_instance(spark, sf):
    return tables.sample_instance(s.housing(spark, sf))


def normalized_columns(spark, sf):
    shouted = s.housing(spark, sf)
    shouted = shouted.toDF(*[f" {c.upper()} " for c in shouted.columns])
    clean = prep.bronze(shouted, check_unique=False)
    return clean.groupBy("ave_occup").agg(
        F.count("*").alias("n"), F.sum("population").cast("long").alias("population")
    )


def source_columns(spark, sf):
    names = {v: k for k, v in tables.SOURCE_COLUMNS.items()}
    source = s.housing(spark, sf).withColumnsRenamed({**names, ROW_ID: "index"})
    renamed = tables.from_source_names(source, "index")
    return renamed.groupBy("house_age").agg(
        F.count("*").alias("n"), F.max(ROW_ID).alias("last_row")
    )


def dup_keys(spark, sf):
    return prep.duplicate_keys(s.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


def contract_violations(spark, sf):
    return prep.contract_violations(s.housing_with_gaps(spark, sf))


def gold_schema(spark, sf):
    return prep.feature_schema(s.housing(spark, sf))


def split_rows(spark, sf):
    return prep.split(s.housing(spark, sf)).select(ROW_ID, "split")


def split_counts(spark, sf):
    return prep.split(s.housing(spark, sf)).groupBy("split").agg(F.count("*").alias("n"))


def exact_split(spark, sf):
    return exact.exact_split(s.housing(spark, sf).select(ROW_ID))


def fingerprint(spark, sf):
    h = s.housing_with_gaps(spark, sf)
    names = [ROW_ID, "population", "ave_rooms", "house_age"]
    whole = [F.col(c).cast("long").cast("string") for c in names]
    price = F.round(F.col(TARGET) * 1_000_000).cast("long").cast("string")
    return prep.portable_fingerprint(h, [*whole, price])


def export_fingerprint(spark, sf):
    """Write the hand-over data set and compare its fingerprint with the source's."""
    h = s.housing_with_gaps(spark, sf)
    written = sinks.export_dataset(h, fresh_folder(spark, "export"))
    source = prep.fingerprint(h, h.columns)
    equal = written.join(source, ["rows", "hash_xor", "hash_sum"]).select("rows")
    return equal.withColumn("equal_content", F.lit(1))


def export_checksums(spark, sf):
    """Read the sidecar of an export, and the files once more: how many rows the files with an equal
    sum hold, and how many files differ or lack one."""
    path = fresh_folder(spark, "export")
    sinks.export_dataset(s.housing(spark, sf).repartition(4, ROW_ID), path)
    sidecar = spark.read.text(f"{path}.sha256").select(
        F.substring("value", 1, 64).alias("stated"), F.substr("value", F.lit(67)).alias("name")
    )
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    now = artifacts.file_checksums(spark, path).select(name, "sha256").filter("name LIKE '%.parquet'")
    compared = now.join(sidecar, "name", "full_outer")
    equal = F.coalesce(F.col("sha256") == F.col("stated"), F.lit(False))
    rows = spark.read.parquet(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"))
    held = rows.groupBy("name").agg(F.count("*").alias("rows"))
    return compared.join(held, "name", "left").agg(
        F.sum(F.when(equal, F.col("rows"))).alias("rows_in_equal_files"),
        F.count_if(~equal).alias("other_files"),
    )


# classification


def classify_failures(spark, sf):
    docs = with_failure_class(s.table(spark, sf, "documents"), "text")
    return docs.select("doc_id", "failure_class")


def missing_predicates(spark, sf):
    docs = s.table(spark, sf, "documents")
    flags = {
        "object_missing": missing_object("text"),
        "parent_gone": parent_absent("text"),
        "sdk_missing": missing_in_sdk("text"),
    }
    return docs.select("doc_id", *[c.cast("int").alias(n) for n, c in flags.items()])


def exit_codes(spark, sf):
    """Some jobs report no exit code, and every error text is longer than an excerpt."""
    codes = F.array(*[F.lit(c).cast("int") for c in [0, 1, 2, 137, None]])
    runs = s.runs(spark, sf).withColumn("exit_code", F.element_at(codes, F.col("k") % 5 + 1))
    code = F.col("exit_code")
    status = exit_status(code)
    text = F.repeat(F.concat("stage", F.lit("/"), "run_id", F.lit(" ")), 200)
    return runs.select(
        "run_id",
        status.alias("status"),
        exit_failure_class(code).alias("failure_class"),
        F.coalesce(error_excerpt(text, status), F.lit("")).alias("error_excerpt"),
    )


def platform_units(spark, sf):
    bare = s.runs(spark, sf).drop("tier", "unification_unit")
    return ledger.with_platform(bare).select("run_id", "tier", "unification_unit")


# ledger


def job_runs(spark, sf):
    e = s.runs(spark, sf)
    number = F.substring("run_id", 5, 12)
    folder = F.concat(F.lit("out/"), number)
    jobs = e.select(
        "platform",
        folder.alias("output_dir"),
        F.when(F.col("k") != 4, F.col("run_id")).alias("run_id"),
        s.pick(F.col("k") % 4, ["0", "1", "2", "137"]).cast("int").alias("exit_code"),
        "attempt",
        "duration_seconds",
        F.lit("the job ended").alias("error_text"),
        "code_revision",
    )
    good = F.concat(
        F.lit('{"run_id": "job-'), number, F.lit('", "metrics": {"rmse": '),
        F.col("k").cast("string"), F.lit('.5}, "params": {"num_leaves": 31}}'),
    )
    value = (
        F.when(F.col("k") % 5 == 0, "")
        .when(F.col("k") % 5 == 1, '{"run_id": "x')
        .when(F.col("k") % 5 == 2, "[1]")
        .otherwise(good)
    )
    manifests = ledger_files.parse_manifests(
        e.select(folder.alias("output_dir"), value.alias("value"))
    )
    empty = F.lit("")
    return ledger.runs_from_jobs(jobs, manifests).select(
        F.coalesce("run_id", empty).alias("run_id"),
        "unification_unit",
        "status",
        "attempt",
        "failure_class",
        F.coalesce("error_excerpt", empty).alias("error_excerpt"),
        "code_revision",
        F.coalesce(text_of("metrics", "rmse"), empty).alias("rmse"),
        F.coalesce(text_of("params", "num_leaves"), empty).alias("num_leaves"),
        F.coalesce("problem", empty).alias("problem"),
    )


def ledger_union(spark, sf):
    runs = s.runs(spark, sf)
    direct = runs.filter(F.col("write_path") == "direct")
    late = runs.withColumn("attempt", F.col("attempt") + 10)
    return ledger.union_paths(direct, late).select("run_id", "write_path", "attempt")


def ownership(spark, sf):
    runs = s.runs(spark, sf)
    job = runs.filter((F.col("stage") == "train") & (F.col("tier") == "A"))
    kept = ledger.reconcile_ownership(
        job.withColumn("origin", F.lit("job")), runs.withColumn("origin", F.lit("adapter"))
    )
    return kept.select("run_id", "stage", "status", "origin")


def insert_absent(spark, sf):
    runs = s.runs(spark, sf).select("run_id", "attempt", "created_at")
    again = runs.withColumn("attempt", F.col("attempt") + 1)
    held = comparison.population(runs, s.CUTOFF)
    rows = ledger.absent_rows(runs.unionByName(again), held, "run_id", [F.col("attempt")])
    return rows.select("run_id", "attempt")


def load_counts(spark, sf):
    lines = s.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias(ROW_ID))
    held = s.table(spark, sf, "orders").filter(F.col("o_totalprice") < 250_000)
    return ledger.load_counts(lines, held.select(F.col("o_orderkey").alias(ROW_ID)), ROW_ID)


def _delivered_costs(spark, sf):
    """A table of daily costs, of which the later ones are delivered again with other amounts."""
    daily = (
        s.line_amounts(spark, sf)
        .groupBy(F.to_date("time").alias("usage_date"), "service")
        .agg(F.sum("amount").cast("decimal(18,6)").alias("amount_usd"))
        .withColumn("platform", F.lit("vertex"))
    )
    path = fresh_folder(spark, "costs")
    sinks.append_costs(daily, path, 1)
    late = daily.filter(F.col("usage_date") >= F.lit("2000-01-01").cast("date"))
    fixed = late.withColumn("amount_usd", F.col("amount_usd") + 1)
    sinks.append_costs(fixed, path, 2)
    return path


def _stored_costs(rows):
    return rows.select(
        "platform",
        F.col("usage_date").cast("string").alias("usage_date"),
        "service",
        F.col("amount_usd").cast("double").alias("amount_usd"),
    )


def cost_upsert(spark, sf):
    return _stored_costs(sinks.current_costs(spark.read.parquet(_delivered_costs(spark, sf))))


def cost_compacted(spark, sf):
    """The stored rows after the changed months were resolved in place, with how many these were."""
    path = _delivered_costs(spark, sf)
    months = sinks.compact_costs(spark, path)
    schema = sinks.TABLES["cost_snapshots"][0]
    return _stored_costs(spark.read.schema(schema).parquet(path)).withColumn("months", F.lit(months))


def _patches(spark, sf):
    runs = s.runs(spark, sf).select("run_id", "stage", "k")
    first = runs.filter(F.col("stage").isin("train", "register")).select(
        "run_id",
        F.concat(
            F.lit('{"note": "patched", "rank": '), F.col("k").cast("string"), F.lit("}")
        ).alias("patch"),
        F.lit(1).alias("patch_no"),
    )
    second = runs.filter(F.col("stage") == "train").select(
        "run_id", F.lit('{"note": "twice"}').alias("patch"), F.lit(2).alias("patch_no")
    )
    stray = runs.filter(F.col("stage") == "teardown").select(
        F.concat(F.lit("gone-"), "run_id").alias("run_id"),
        F.lit('{"note": "stray"}').alias("patch"),
        F.lit(1).alias("patch_no"),
    )
    void = runs.filter(F.col("stage") == "predict").select(
        "run_id", F.lit("{}").alias("patch"), F.lit(1).alias("patch_no")
    )
    return first.unionByName(second).unionByName(stray).unionByName(void)


def merge_params(spark, sf):
    """Patches are stored in two deliveries, and the ledger is read with them. The first comes while
    the ledger holds the runs before the cutoff only, so it changes none of the others."""
    path = fresh_folder(spark, "patches")
    runs = s.runs(spark, sf)
    for number, held in ((1, comparison.population(runs, s.CUTOFF)), (2, runs)):
        given = _patches(spark, sf).filter(F.col("patch_no") == number)
        sinks.append_patches(given, held, path, number)
    merged = sinks.patched_runs(runs, path)
    keys = ["note", "rank", "num_leaves", "action"]
    texts = [F.coalesce(text_of("params", k), F.lit("")).alias(k) for k in keys]
    return merged.select("run_id", *texts)


def handoff_merge(spark, sf):
    merged = ledger.handoff_merge(s.runs(spark, sf), _patches(spark, sf))
    note = F.coalesce(text_of("params", "note"), F.lit("")).alias("note")
    return merged.groupBy("write_path", "stage", note).agg(F.count("*").alias("n"))


def merge_outcomes(spark, sf):
    return ledger.merge_outcomes(s.runs(spark, sf), _patches(spark, sf))


def next_attempt(spark, sf):
    return ledger.next_attempts(s.runs(spark, sf))


def _collected_view(df: DataFrame) -> DataFrame:
    return df.select(
        "run_id",
        "platform",
        "stage",
        "status",
        "write_path",
        "attempt",
        F.coalesce(text_of("metrics", "mae"), F.lit("")).alias("mae"),
        F.coalesce(text_of("params", "note"), F.lit("")).alias("note"),
        F.col("created_at").isNotNull().cast("int").alias("stamped"),
    )


def _written_lines(spark, sf):
    """Fallback files of all runs; the runs of one tier are delivered twice."""
    folder = fresh_folder(spark, "lines")
    runs = ledger.as_runs(s.runs(spark, sf))
    sinks.append_lines(runs, f"{folder}/first")
    sinks.append_lines(runs.filter(F.col("tier") == "B"), f"{folder}/again/b")
    return folder


def collect_jsonl(spark, sf):
    target = fresh_folder(spark, "ledger")
    lines = ledger_files.read_lines(spark, _written_lines(spark, sf))
    collect.collect_batch(spark, lines, target, fresh_folder(spark, "rejects"))
    return _collected_view(sinks.read_runs(spark, target))


def collect_rejects(spark, sf):
    """Files in which some lines are broken or off the domains; what the collect refused, and how
    many lines it took."""
    folder, target = fresh_folder(spark, "lines"), fresh_folder(spark, "ledger")
    k = F.col("k")
    names = [f.name for f in RUN_LINE_SCHEMA.fields if f.name not in ("metrics", "params")]
    bent = s.runs(spark, sf).withColumn(
        "platform", F.when(k == 3, "vertx").otherwise(F.col("platform"))
    )
    text = F.to_json(F.struct(*names))
    broken = F.when(k == 7, F.concat(F.lit("{broken "), "run_id")).otherwise(text)
    bent.select(broken.alias("value")).write.text(f"{folder}/ml_runs.jsonl")
    lines = ledger_files.read_lines(spark, folder, "{ml_runs.jsonl,part-*}")
    counts = collect.collect_batch(spark, lines, target, fresh := fresh_folder(spark, "rejects"))
    refused = spark.read.schema("run_id string, problem string, line string").json(fresh)
    return refused.select(
        F.coalesce("run_id", F.regexp_extract("line", "run-[0-9]+", 0)).alias("run_id"),
        "problem",
        F.lit(counts.inserted).alias("inserted"),
        F.lit(counts.rejected).alias("rejected"),
    )


def rejected_lines(spark, sf):
    k = F.col("k")
    lines = s.runs(spark, sf).withColumns(
        {
            "platform": F.when(k == 3, "vertx").otherwise(F.col("platform")),
            "stage": F.when(k == 4, None).otherwise(F.col("stage")),
            "failure_class": F.when(k == 5, "odd").when(k == 6, "").otherwise(
                F.col("failure_class")
            ),
            "_corrupt_record": F.when(k == 7, "{broken").otherwise(None).cast("string"),
        }
    )
    names = [f.name for f in RUN_LINE_SCHEMA.fields]
    bad = ledger_files.rejected_lines(lines.select(*names, "_corrupt_record"))
    return bad.select("run_id", "problem")


def first_success(spark, sf):
    return ledger.first_success(s.runs(spark, sf)).select("platform", "run_id", "code_revision")


def golden_snapshot(spark, sf):
    """Write the golden document and read it back."""
    path = fresh_folder(spark, "golden")
    sinks.write_golden(s.runs(spark, sf), "2024-01-31", "run ledger", path)
    return ledger_files.read_golden(spark, path).withColumn("rmse", F.coalesce("rmse", F.lit(-1.0)))


def latest_artifact(spark, sf):
    return ledger.latest_artifact(s.runs(spark, sf)).select("platform", "run_id", "value")


def latest_model_ref(spark, sf):
    return ledger.latest_model_ref(s.runs(spark, sf)).select("platform", "key", "run_id", "value")


def latest_version(spark, sf):
    versions = s.runs(spark, sf).withColumn("version", text_of("params", "model_version"))
    return ledger.latest_version(versions, "platform")


def revision_compat(spark, sf):
    points = ledger.latest_artifact(s.runs(spark, sf))
    verdicts = ledger.revision_verdicts(points, s.trees(spark, sf), _revision_text(1))
    return verdicts.select("platform", "run_id", "verdict")


def _revision_text(index: int) -> str:
    import hashlib

    digest = hashlib.md5(f"rev{index}".encode()).hexdigest()
    return digest + digest[:8]


def coverage(spark, sf):
    renamed = s.runs(spark, sf).withColumn(
        "platform",
        F.when(F.col("platform") == "azureml", "other").otherwise(F.col("platform")),
    )
    return checks.platform_coverage(renamed)


def unknown_revisions(spark, sf):
    exempt = s.runs(spark, sf).select("code_revision").distinct()
    exempt = exempt.filter(F.col("code_revision") == _revision_text(6))
    return checks.unknown_revisions(
        s.runs(spark, sf), s.trees(spark, sf).select("code_revision"), exempt
    )


def training_trees(spark, sf):
    report = checks.training_trees(s.runs(spark, sf), s.trees(spark, sf))
    return report.withColumn("single_tree", F.col("single_tree").cast("int"))


def parity_deviation(spark, sf):
    report = checks.parity_deviation(s.runs(spark, sf), float(s.BASELINE_RMSE))
    return report.filter(F.col("rmse").isNotNull()).select(
        "platform", "rmse", F.round("deviation", 9).alias("deviation"),
        F.col("within_tolerance").cast("int").alias("within_tolerance"),
    )


def parity_spread(spark, sf):
    report = checks.parity_spread(s.runs(spark, sf))
    return report.select(
        "platforms", F.round("spread", 9).alias("spread"),
        F.col("within_tolerance").cast("int").alias("within_tolerance"),
    )


def _bent_runs(spark, sf):
    k = F.col("k")
    return s.runs(spark, sf).withColumns(
        {
            "tier": F.when(k == 5, "C").otherwise(F.col("tier")),
            "write_path": F.when(k == 6, "").otherwise(F.col("write_path")),
            "status": F.when(k == 6, "maybe").otherwise(F.col("status")),
            "code_revision": F.when(k == 9, F.upper("code_revision"))
            .when(k == 10, "")
            .otherwise(F.col("code_revision")),
        }
    )


def domain_violations(spark, sf):
    return checks.domain_violations(_bent_runs(spark, sf))


def bad_revisions(spark, sf):
    return checks.bad_revisions(_bent_runs(spark, sf))


# residuals


def _checked(spark, sf):
    return residual.judged(s.inventory(spark, sf), s.stored_objects(spark, sf), s.LAB)


def residual_findings(spark, sf):
    found = residual.findings(_checked(spark, sf))
    return found.withColumn("note", F.coalesce("note", F.lit("")))


def residual_items(spark, sf):
    return residual.items(_checked(spark, sf))


def inventory_files(spark, sf):
    """The listings as files of the inventory schema, read again."""
    path = fresh_folder(spark, "inventory-files")
    s.inventory(spark, sf).drop("p_size").write.json(path)
    checked = residual.judged(read_inventory(spark, path), s.stored_objects(spark, sf), s.LAB)
    return residual.items(checked)


def item_pages(spark, sf):
    pages = residual.item_pages(residual.items(_checked(spark, sf)), 20)
    return pages.withColumn("items", F.array_join("items", ","))


def residual_report(spark, sf):
    checked = durable(_checked(spark, sf))
    pages = residual.item_pages(residual.items(checked), 40)
    return residual.report_lines(residual.findings(checked), pages)


def residual_summary(spark, sf):
    """Three platforms were listed; nothing is said about the others."""
    listed = ["vertex", "azureml", "snowflake"]
    rows = s.inventory(spark, sf).filter(F.col("platform").isin(listed))
    checked = residual.judged(rows, s.stored_objects(spark, sf), s.LAB)
    report = residual.summary(residual.findings(checked, listed), listed)
    return report.withColumn("blocking", F.col("blocking").cast("int"))


def infra_event_rows(spark, sf):
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = residual.infra_events(residual.findings(_checked(spark, sf)), "check-1", at)
    return rows.select(
        "event_id",
        "platform",
        "action",
        "status",
        array_size("residual_resources", "findings").alias("findings"),
    )


def infra_event_items(spark, sf):
    """A recorded check, read back: its items by the events they belong to."""
    checked, root = durable(_checked(spark, sf)), fresh_folder(spark, "checks")
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    pages = residual.item_pages(residual.items(checked), 40)
    events = residual.infra_events(residual.findings(checked), "check-1", at)
    sinks.record_check(events, residual.event_items(pages, "check-1"), "check-1", root)
    rows = spark.read.parquet(f"{root}/infra_event_items")
    known = spark.read.parquet(f"{root}/infra_events").select("event_id")
    return rows.join(known, "event_id", "left_semi").select(
        "event_id", "platform", "kind", F.explode("items").alias("item")
    )


def orphans(spark, sf):
    observed = s.inventory(spark, sf)
    declared = observed.filter(F.col("p_size") > 25)
    return residual.orphans(observed, declared).select("platform", "kind", "name")


def nonempty_containers(spark, sf):
    buckets = s.inventory(spark, sf).filter(F.col("kind").isin("gcs_object", "s3_object"))
    held = residual.nonempty_containers(buckets, s.stored_objects(spark, sf))
    return held.select("platform", "name")


def parent_children(spark, sf):
    rows = s.inventory(spark, sf)
    parents = rows.select("platform", F.col("parent").alias("name"))
    return residual.children_of(parents, rows, s.LAB)


# costs


def _cost_view(df: DataFrame) -> DataFrame:
    return df.select(
        "platform",
        F.col("usage_date").cast("string").alias("usage_date"),
        "service",
        F.col("amount_usd").cast("double").alias("amount_usd"),
        "unit",
    )


def _usage_export(spark, sf):
    return s.line_amounts(spark, sf).select(
        F.col("time").cast("date").alias("usage_date"),
        F.col("service").alias("sku_name"),
        F.col("quantity").alias("usage_quantity"),
    )


def _meter_export(spark, sf):
    return s.line_amounts(spark, sf).select(
        F.col("time").cast("timestamp").alias("start_time"),
        F.col("service").alias("warehouse_name"),
        F.col("quantity").alias("credits_used"),
    )


def _billing_export(spark, sf):
    return s.line_amounts(spark, sf).select(
        F.col("time").cast("timestamp").alias("usage_start_time"),
        F.struct(F.col("service").alias("description")).alias("service"),
        F.col("amount").alias("cost"),
    )


def cost_nested(spark, sf):
    return _cost_view(costs.nested_costs(s.nested_export(spark, sf), **WHOLE))


def cost_usage(spark, sf):
    return _cost_view(costs.usage_costs(_usage_export(spark, sf), **WHOLE))


def cost_week(spark, sf):
    return _cost_view(costs.usage_costs(_usage_export(spark, sf), **WEEK))


def cost_credits(spark, sf):
    rows = costs.credit_costs(_meter_export(spark, sf), price_usd="3.0015", **WHOLE)
    return _cost_view(rows)


def cost_billing(spark, sf):
    return _cost_view(costs.billing_costs(_billing_export(spark, sf), **WHOLE))


def cost_flat(spark, sf):
    return _cost_view(costs.flat_costs(_flat_export(spark, sf), **WHOLE))


def _flat_export(spark, sf):
    return s.line_amounts(spark, sf).groupBy(
        F.to_date("time").cast("string").alias("usage_date"), "service"
    ).agg(F.sum("amount").alias("cost"))


def cost_all_files(spark, sf):
    """Good files of all five formats, one of them as Parquet, collected at once. The nested one is a
    single document, as its source hands it over."""
    periods = F.flatten(F.collect_list("ResultsByTime")).alias("ResultsByTime")
    formats = {
        "sagemaker": s.nested_export(spark, sf).agg(periods), "databricks": _usage_export(spark, sf),
        "snowflake": _meter_export(spark, sf), "vertex": _billing_export(spark, sf),
        "azureml": _flat_export(spark, sf),
    }
    paths = {p: fresh_folder(spark, f"export-{p}") for p in formats}
    paths["vertex"] += ".parquet"
    for platform, export in formats.items():
        if platform == "vertex":
            stored = [F.col("usage_start_time").cast("timestamp"), "service", F.col("cost").cast("double")]
            export.select(*stored).write.parquet(paths[platform])
        else:
            export.write.json(paths[platform])
    rows, problems = costs.collect_costs(spark, paths, price_usd="3.0015", **WHOLE)
    return _cost_view(rows).withColumn("problems", F.lit(len(problems)))


def _export_files(spark, sf):
    """Exports as files: two that are good, and one with a line that is no JSON."""
    paths = {p: fresh_folder(spark, f"export-{p}") for p in ("databricks", "snowflake", "vertex")}
    _usage_export(spark, sf).write.json(paths["databricks"])
    _meter_export(spark, sf).write.json(paths["snowflake"])
    text = F.to_json(F.struct("usage_start_time", "service", "cost"))
    broken = F.when(F.dayofyear("usage_start_time") == 1, "{broken").otherwise(text)
    _billing_export(spark, sf).select(broken).write.text(paths["vertex"])
    return paths


def cost_files(spark, sf):
    rows, _ = costs.collect_costs(spark, _export_files(spark, sf), price_usd="3.0015", **WHOLE)
    return _cost_view(rows)


def cost_problems(spark, sf):
    """Platforms without costs: those that have no export, and the one that can't be read."""
    rows, problems = costs.collect_costs(spark, _export_files(spark, sf), **WHOLE)
    missing = costs.unavailable_sources(rows, problems)
    return missing.select(
        "platform", (F.col("reason") != "no cost export").cast("int").alias("unreadable")
    )


def cost_unavailable(spark, sf):
    empty_week = {"today": "1990-01-01", "days": 7}
    rows = costs.all_costs(
        {
            "databricks": costs.usage_costs(_usage_export(spark, sf), **WHOLE),
            "vertex": costs.billing_costs(_billing_export(spark, sf), **empty_week),
        }
    )
    return costs.unavailable_sources(rows, {"azureml": "export could not be read"})


# parameters, mirror, artifacts


def param_types(spark, sf):
    maps = s.runs(spark, sf).select(F.from_json("params", "map<string,string>").alias("params"))
    typed = params.typed_params(maps)
    return typed.groupBy("key", "type").agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")
    )


def param_merge(spark, sf):
    maps = s.runs(spark, sf).select(
        "run_id",
        F.map_concat(
            F.from_json("params", "map<string,string>"),
            F.create_map(F.lit("seed"), F.col("k").cast("string")),
        ).alias("given"),
    )
    defaults = F.create_map(
        *[F.lit(x) for k, v in params.DEFAULTS.items() for x in (k, str(v))]
    )
    split = maps.select(
        "run_id",
        params.runner_params("given").alias("runner"),
        params.merged_params(defaults, params.override_params("given")).alias("learner"),
    )
    return split.select(
        "run_id",
        F.col("runner")["seed"].alias("seed"),
        F.col("learner")["learning_rate"].alias("learning_rate"),
        F.col("learner")["num_leaves"].alias("num_leaves"),
        F.col("learner")["bagging_fraction"].alias("bagging_fraction"),
        F.map_contains_key("learner", "seed").cast("int").alias("seed_leaks"),
    )


def tracking_mirror(spark, sf):
    rows = mirror.tracker_entries(s.runs(spark, sf))
    return rows.select(
        "run_name",
        "state",
        "kind",
        "key",
        F.coalesce("num_value", F.lit(-1.0)).alias("num_value"),
        F.coalesce("str_value", F.lit("")).alias("str_value"),
    )


def artifact_listing(spark, sf):
    size = F.col("p_size")
    number = F.col("p_partkey").cast("string")
    uri = (
        F.when(size == 10, F.concat(F.lit("other://models/"), number))
        .when(size == 20, F.concat(F.lit("lab:///"), number))
        .when(size == 30, F.concat(F.lit("lab://models/"), number, F.lit("/")))
        .otherwise(F.concat(F.lit("lab://models/"), number, F.lit("/"), F.col("p_type")))
    )
    listed = artifacts.list_objects(s.table(spark, sf, "part").select(uri.alias("uri")), "lab")
    texts = ["bucket", "key", "file_name", "problem"]
    return listed.select("uri", *[F.coalesce(c, F.lit("")).alias(c) for c in texts])


def _log_line(k: Column) -> Column:
    """What a run of infrastructure says at its end, by the number of its resources."""
    n = k.cast("string")
    return (
        F.when(k % 4 == 0, F.concat(
            F.lit("x\nApply complete! Resources: "), n, F.lit(" added, 1 changed, 2 destroyed.")))
        .when(k % 4 == 1, F.concat(
            F.lit("Destroy complete! Resources: "), n, F.lit(" destroyed.")))
        .when(k % 4 == 2, F.concat(
            F.lit("Apply complete! Resources: 0 added, 0 changed, "), n, F.lit(" destroyed.")))
        .otherwise("Error: quota exceeded")
    )


def transcript_counts(spark, sf):
    logs = s.infra(spark, sf).select(
        "event_id", "action", _log_line(F.col("resource_count")).alias("output")
    )
    number = resource_count(F.col("output"), F.col("action"))
    return logs.select("event_id", F.coalesce(number, F.lit(-1)).alias("resources"))


def transcript_files(spark, sf):
    """Logs of all events of a platform and action, one after the other, as <platform>/<action>.log; the
    first closing line counts. A log without one has no number. Ranges of the events are sorted and
    written by tasks of their own, so a log is a folder of parts in order."""
    folder = fresh_folder(spark, "logs")
    events = s.infra(spark, sf).withColumn("quiet", F.col("platform") == "azureml")
    text = F.when(F.col("quiet"), "Error: quota exceeded").otherwise(_log_line(F.col("resource_count")))
    said = events.select("platform", "action", "created_at", "event_id", text.alias("value"))
    place = ["platform", "action", "created_at", "event_id"]
    in_order = said.repartitionByRange(*place).sortWithinPartitions(*place)
    in_order.drop("created_at", "event_id").write.partitionBy("platform", "action").text(folder)
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    home = F.regexp_replace("path", "/[^/]*$", "")
    for row in parts.select(home.alias("path")).distinct().collect():  # one for each platform and action
        home, platform, action = row.path.rsplit("/", 2)
        env = platform.removeprefix("platform=")
        files.make_folder(spark, f"{home}/{env}")
        files.move(spark, row.path, f"{home}/{env}/{action.removeprefix('action=')}.log")
    logs = read_transcripts(spark, folder)
    return logs.select("env", "action", F.coalesce("resource_count", F.lit(-1)).alias("resources"))


def linear_scored(spark, sf):
    return s.housing(spark, sf).withColumn("prediction", 2.5 + 0.5 * F.col("med_inc"))


def linear_eval_metrics(spark, sf):
    report = modeling.regression_metrics(linear_scored(spark, sf))
    return report.select(*[F.round(c, 6).alias(c) for c in ["rmse", "mae", "r2"]])


def prediction_parity(spark, sf):
    """Two scorings with one model: as the table is, and with its columns turned and its rows dealt
    anew. Those of one kind drift."""
    data, fitted = _small_fit(spark, sf)
    turned = data.select(*reversed(data.columns)).repartition(5, "population")
    one, two = (
        modeling.score(fitted.model, df).select(ROW_ID, "ave_rooms", "prediction") for df in (data, turned)
    )
    drift = F.when(F.col("ave_rooms") == 12, 0.25).otherwise(0.0)
    two = two.withColumn("prediction", F.col("prediction") + drift)
    report = modeling.prediction_parity(one.unionByName(two), ROW_ID)
    return report.withColumns(
        {
            "spread": F.round("spread", 6),
            "within_tolerance": F.col("within_tolerance").cast("int"),
        }
    )


def payload_instances(spark, sf):
    rows = modeling.payload_instances(s.requests(spark, sf))
    return rows.select(
        "request_id",
        F.coalesce("position", F.lit(-1)).alias("position"),
        F.coalesce("error", F.lit("")).alias("error"),
        *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in FEATURES],
    )


def _split_coarse(spark, sf):
    return prep.split(prep.gold(prep.silver(prep.bronze(s.coarse_housing(spark, sf)))))


_FITTED: dict[tuple[str, str], boosting.Boosted] = {}


def _small_fit(spark, sf):
    """The split table and a model, which is fitted once in a session and used by several queries."""
    data, place = _split_coarse(spark, sf), (spark.sparkContext.applicationId, sf)
    if place not in _FITTED:
        _FITTED[place] = modeling.train(
            data, rounds=SMALL_ROUNDS, patience=SMALL_ROUNDS, overrides=SMALL_FIT
        )
    return data, _FITTED[place]


def train_eval(spark, sf):
    data, fitted = _small_fit(spark, sf)
    scored = modeling.score(fitted.model, data.filter(F.col("split") == "test"))
    report = modeling.regression_metrics(scored)
    return report.select(
        *[F.round(c, 6).alias(c) for c in ["rmse", "mae", "r2"]],
        F.lit(fitted.best_iteration).alias("best_iteration"),
    )


def early_stop(spark, sf):
    """Boost until the held-out rows get no better: the held-out RMSE after each round up to the stop,
    which of them is the best, and whether a saved model, cut there, predicts the same."""
    data = _split_coarse(spark, sf)
    fitted = modeling.train(
        data, rounds=EAGER_ROUNDS, patience=EAGER_PATIENCE, overrides=EAGER_FIT
    )
    path = fresh_folder(spark, "model")
    fitted.model.save(spark, path)
    test = data.filter(F.col("split") == "test")
    ways = [
        modeling.score(m, test).select(ROW_ID, "prediction")
        for m in (fitted.model, TreeModel.load(spark, path))
    ]
    saved = modeling.prediction_parity(ways[0].unionByName(ways[1]), ROW_ID).agg(
        F.count("*").alias("test_rows"),
        F.count_if(F.col("spread") > 0).alias("changed_by_saving"),
    ).first()
    losses = spark.createDataFrame(
        list(enumerate(fitted.losses, 1)), "round int, held_out_rmse double"
    )
    return losses.select(
        "round",
        F.round("held_out_rmse", 6).alias("held_out_rmse"),
        (F.col("round") == fitted.best_iteration).cast("int").alias("best"),
        *[F.lit(saved[c]).alias(c) for c in ("test_rows", "changed_by_saving")],
    )


def training_job(spark, sf):
    """The whole job with baseline and artifacts: what its manifest says, and its importance file."""
    output = fresh_folder(spark, "job")
    config = TrainingConfig(
        output_dir=output,
        code_revision=_revision_text(1),
        run_id="job-1",
        params={k: str(v) for k, v in EAGER_FIT.items()}
        | {"num_boost_round": str(EAGER_ROUNDS), "early_stopping_rounds": str(EAGER_PATIENCE)},
        with_baseline=True,
        baseline_trees=SMALL_FOREST["n_trees"],
        baseline_depth=SMALL_FOREST["max_depth"],
    )
    run_training(s.coarse_housing(spark, sf), config)
    names = ["rmse", "mae", "r2", "baseline_rmse", "baseline_mae", "baseline_r2"]
    metrics = [F.round(text_of("metrics", m).cast("double"), 6).alias(m) for m in names]
    best = text_of("metrics", "best_iteration").cast("int").alias("best_iteration")
    return ledger_files.read_manifests(spark, output).select(
        "run_id", "code_revision", *metrics, best
    )


def baseline_eval(spark, sf):
    data = _split_coarse(spark, sf)
    forest = boosting.bagged_forest(data, **SMALL_FOREST)
    scored = modeling.score(forest, data.filter(F.col("split") == "test"))
    report = modeling.regression_metrics(scored, prefix="baseline_")
    return report.select(*[F.round(c, 6).alias(c) for c in report.columns])


def bootstrap_weights(spark, sf):
    """How often each tree of the forest draws each row."""
    drawn = boosting.poisson_weights(ROW_ID, 42, 5)
    rows = s.housing(spark, sf).select(ROW_ID, F.posexplode(drawn).alias("tree", "weight"))
    return rows.groupBy("tree", "weight").agg(
        F.count("*").alias("rows"), F.sum(ROW_ID).alias("keys")
    )


def feature_importance(spark, sf):
    _, fitted = _small_fit(spark, sf)
    report = modeling.feature_importance(fitted.model.nodes(spark))
    return report.withColumn("gain", F.round("gain", 4))


def score_payloads(spark, sf):
    _, fitted = _small_fit(spark, sf)
    answers = modeling.payload_answers(
        modeling.score_payloads(fitted.model, s.requests(spark, sf, s.coarse_housing))
    )
    return answers.select(
        "request_id",
        F.coalesce(F.size("predictions"), F.lit(0)).alias("answers"),
        F.coalesce(F.round(F.element_at("predictions", 1), 6), F.lit(-1.0)).alias("first"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


# streams


def stream_collect(spark, sf):
    source, target = _written_lines(spark, sf), fresh_folder(spark, "ledger")
    started = collect.collect_stream(
        spark, source, target, fresh_folder(spark, "offsets"), fresh_folder(spark, "rejects")
    )
    started.awaitTermination()
    return _collected_view(sinks.read_runs(spark, target))


def stream_counters(spark, sf):
    """Counted while collecting, file by file; half of the runs are delivered twice."""
    source, counts = _written_lines(spark, sf), fresh_folder(spark, "counts")
    started = collect.collect_stream(
        spark, source, fresh_folder(spark, "ledger"), fresh_folder(spark, "offsets"),
        fresh_folder(spark, "rejects"), files_per_batch=6, counts=counts,
    )
    started.awaitTermination()
    return collect.current_counters(spark, counts)


QUERIES = [
    friction, friction_by_window, try_numbers, failure_mix, stage_durations, write_paths,
    teardown_quality, metric_parity, parity_revisions, infra_friction, selection_matrix,
    phase_scorecard, report_order, summary_stats, page, page_after, dataset_scan, lookup, sample_instance, normalized_columns,
    source_columns, dup_keys, contract_violations, gold_schema, split_rows, split_counts,
    exact_split, fingerprint, export_fingerprint, export_checksums, classify_failures, missing_predicates,
    exit_codes, platform_units, job_runs, ledger_union, ownership, insert_absent, load_counts,
    cost_upsert, cost_compacted, merge_params, handoff_merge, merge_outcomes, next_attempt, collect_jsonl,
    collect_rejects, rejected_lines, first_success, golden_snapshot, latest_artifact, latest_model_ref,
    latest_version, revision_compat, coverage, unknown_revisions, training_trees,
    parity_deviation, parity_spread, domain_violations, bad_revisions, residual_findings,
    residual_items, inventory_files, item_pages, residual_report, residual_summary, infra_event_rows,
    infra_event_items, orphans,
    nonempty_containers, parent_children, cost_nested, cost_usage, cost_week, cost_credits,
    cost_billing, cost_flat, cost_files, cost_all_files, cost_problems, cost_unavailable, param_types, param_merge, tracking_mirror,
    artifact_listing, transcript_counts, transcript_files, linear_eval_metrics, prediction_parity,
    payload_instances, train_eval, early_stop, training_job, baseline_eval, bootstrap_weights, feature_importance, score_payloads,
    stream_collect, stream_counters,
]
