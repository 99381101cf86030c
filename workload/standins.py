"""Ledger, training, inventory and billing inputs derived from the given tables.

Every function reads whole tables and only projects; `workload/oracles.py` states the same
projections in SQL. The two ledgers and the inventory are written once per session and data set
to the shared folder, so that queries scan them as the stored tables they stand for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlledger.functions.classify import with_failure_class
from mlledger.operators.ledger import with_platform
from mlledger.schemas import FEATURES, ROW_ID, TARGET
from mlledger.session import fresh_folder

CUTOFF = "2024-01-25 00:00:00"
BASELINE_RMSE = "0.4368075"
LAB = "red"
ERRORS = [
    "AccessDenied: role may not pass",
    "ResourceExhausted: quota exceeded for jobs",
    "ConnectionError: connection timeout",
    "ModuleNotFoundError: no module named trainer",
    "RuntimeError: manifest unknown for image",
    "ValueError: column med_inc missing from schema",
    "RuntimeError: something unexpected",
    "PermissionError: 403 forbidden",
]
MODEL_KEY = {
    "vertex": "model_resource_name",
    "sagemaker": "model_package_arn",
    "azureml": "model_resource_name",
    "databricks": "model_version",
    "snowflake": "model_version",
}
PLATFORM_ORDER = ["vertex", "sagemaker", "azureml", "databricks", "snowflake"]
KINDS = {
    "vertex": [
        "vertex_endpoint",
        "gcs_object",
        "artifact_registry",
        "registered_model",
        "experiment_run",
        "unchecked",
    ],
    "sagemaker": [
        "sagemaker_endpoint",
        "sagemaker_endpoint_config",
        "sagemaker_model",
        "model_package_group",
        "ecr_repository",
        "s3_object",
    ],
    "azureml": [
        "online_endpoint",
        "key_vault_soft_deleted",
        "registered_model",
        "online_endpoint",
        "key_vault_soft_deleted",
        "registered_model",
    ],
    "databricks": [
        "serving_endpoint",
        "uc_registered_model",
        "uc_volume",
        "serving_endpoint",
        "uc_registered_model",
        "uc_volume",
    ],
    "snowflake": [
        "warehouse_running",
        "schema_object",
        "stage_file",
        "warehouse_running",
        "schema_object",
        "stage_file",
    ],
}
TYPES = ["STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_STORED: dict[tuple[str, str, str], str] = {}


def stored(
    spark: SparkSession,
    sf: str,
    name: str,
    build: Callable[[SparkSession, str], DataFrame],
    *partition_by: str,
) -> DataFrame:
    """The derived table from the shared folder, derived on first use."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = fresh_folder(spark, name)
        build(spark, sf).write.partitionBy(*partition_by).parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """The run ledger, laid out by platform."""
    return stored(spark, sf, "ml_runs", derive_runs, "platform")


def infra(spark: SparkSession, sf: str) -> DataFrame:
    """The infrastructure ledger, laid out by platform."""
    return stored(spark, sf, "infra_events", derive_infra, "platform")


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Resource listings of all platforms."""
    return stored(spark, sf, "inventory", derive_inventory)


def pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        table(spark, sf, "events")
        .withColumn("k", k)
        .withColumn("platform", pick(F.col("user_id") % 5, PLATFORM_ORDER))
    )


def run_key(column: str) -> Column:
    return F.concat(F.lit("run-"), F.lpad(F.col(column).cast("string"), 12, "0"))


def revision(index: Column) -> Column:
    digest = F.md5(F.concat(F.lit("rev"), index.cast("string")))
    return F.concat(digest, F.substring(digest, 1, 8))


def derive_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The run ledger from `events`: one run per event."""
    e = _events(spark, sf)
    k = F.col("k")
    stage = (
        F.when(F.col("event_type") == "view", "train")
        .when(F.col("event_type") == "click", "register")
        .when(F.col("event_type") == "signup", "deploy")
        .when(F.col("event_type") == "purchase", "predict")
        .when(k < 50, "deploy")
        .otherwise("teardown")
    )
    failed = F.col("value") < 10
    rmse = F.concat(F.lit("0.4368"), F.lpad(k.cast("string"), 2, "0"), F.lit("5"))
    quality = F.lit(', "mae": 0.284, "r2": 0.854}')
    metrics = (
        F.when(failed | (F.col("event_type") != "view"), F.lit("{}"))
        .when(k == 0, F.lit('{"mae": 0.284, "r2": 0.854}'))
        .when(k == 1, F.concat(F.lit('{"rmse": null'), quality))
        .otherwise(F.concat(F.lit('{"rmse": '), rmse, quality))
    )
    key = pick(F.col("user_id") % 5, [MODEL_KEY[p] for p in PLATFORM_ORDER])
    params = (
        F.when(
            F.col("event_type") == "view",
            F.concat(
                F.lit('{"model_artifact_uri": "lab://models/'),
                F.col("event_id").cast("string"),
                F.lit('", "learning_rate": "0.05", "num_leaves": "'),
                k.cast("string"),
                F.lit('", "note": "plain", "deterministic": "true"}'),
            ),
        )
        .when(
            F.col("event_type") == "click",
            F.concat(F.lit('{"'), key, F.lit('": "'), k.cast("string"), F.lit('"}')),
        )
        .when(F.col("event_type") == "error", F.lit('{"action": "teardown"}'))
        .when(F.col("event_type") == "purchase", F.lit('{"rows": 1, "warm": true}'))
        .otherwise(F.lit("{}"))
    )
    base = e.select(
        run_key("event_id").alias("run_id"),
        "platform",
        stage.alias("stage"),
        F.when(failed, "failure").otherwise("success").alias("status"),
        (k % 3 + 1).alias("attempt"),
        F.col("value").alias("duration_seconds"),
        F.when(failed, pick(k % 8, ERRORS)).alias("error_excerpt"),
        revision(k % 7).alias("code_revision"),
        F.when(F.col("user_id") % 5 < 3, "direct").otherwise("collected").alias("write_path"),
        metrics.alias("metrics"),
        params.alias("params"),
        F.col("ts").alias("created_at"),
        "k",
    )
    classified = with_failure_class(base, "error_excerpt").withColumn(
        "failure_class",
        F.when(F.col("status") == "failure", F.col("failure_class")).otherwise("none"),
    )
    return with_platform(classified)


def derive_infra(spark: SparkSession, sf: str) -> DataFrame:
    """infra_events from `events`."""
    e = _events(spark, sf)
    k = F.col("k")
    residual = (
        F.when(k % 4 == 0, F.lit(None).cast("string"))
        .when(k % 4 == 1, F.lit("{}"))
        .when(k % 4 == 2, F.lit('{"findings": []}'))
        .otherwise(
            F.concat(
                F.lit('{"findings": ['),
                F.array_join(
                    F.transform(F.sequence(F.lit(1), k % 5 + 1), lambda i: i.cast("string")), ", "
                ),
                F.lit("]}"),
            )
        )
    )
    return e.select(
        run_key("event_id").alias("event_id"),
        "platform",
        F.when(F.col("event_type").isin("view", "click"), "apply")
        .otherwise("destroy")
        .alias("action"),
        F.col("value").alias("duration_seconds"),
        k.alias("resource_count"),
        residual.alias("residual_resources"),
        F.when(F.col("value") < 10, "failure").otherwise("success").alias("status"),
        F.col("ts").alias("created_at"),
    )


def housing(spark: SparkSession, sf: str) -> DataFrame:
    """The training table from `orders`, one row per order."""
    o = table(spark, sf, "orders")
    med_inc = F.col("o_custkey") % 1000 / 100
    columns = {
        "med_inc": med_inc,
        "house_age": F.year("o_orderdate"),
        "ave_rooms": F.month("o_orderdate"),
        "ave_bedrms": F.dayofmonth("o_orderdate"),
        "population": F.col("o_custkey"),
        "ave_occup": F.substring("o_orderpriority", 1, 1),
        "latitude": F.dayofyear("o_orderdate"),
        "longitude": F.ascii("o_orderstatus"),
        TARGET: F.col("o_totalprice") / 100000 + med_inc / 2,
    }
    return o.select(
        F.col("o_orderkey").alias(ROW_ID),
        *[c.cast("double").alias(n) for n, c in columns.items()],
    )


def housing_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The same table with nulls and NaNs where the source repeats a value."""
    nan = F.lit(float("nan"))
    return (
        housing(spark, sf)
        .withColumn("ave_rooms", F.when(F.col("ave_rooms") != 2, F.col("ave_rooms")))
        .withColumn("latitude", F.when(F.col("latitude") == 60, nan).otherwise(F.col("latitude")))
        .withColumn(TARGET, F.when(F.col("ave_occup") == 5, None).otherwise(F.col(TARGET)))
        .drop("longitude")
    )


def coarse_housing(spark: SparkSession, sf: str) -> DataFrame:
    """The same table with few values in each feature, so that the best split has a closed form."""
    return housing(spark, sf).withColumns(
        {
            "med_inc": F.floor("med_inc").cast("double"),
            "population": F.col("population") % 20,
            "latitude": F.floor(F.col("latitude") / 30).cast("double"),
        }
    )


def trees(spark: SparkSession, sf: str) -> DataFrame:
    """Revision → training tree from the revisions in `events`; two of seven are unknown."""
    found = _events(spark, sf).select((F.col("k") % 7).alias("r")).distinct()
    known = found.filter(F.col("r") < 5)
    tree = F.concat(F.lit("tree-"), F.when(F.col("r") < 3, "one").otherwise("two"))
    return known.select(revision(F.col("r")).alias("code_revision"), tree.alias("tree_hash"))


def derive_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Resource listings from `part`."""
    p = table(spark, sf, "part")
    platform = pick(F.col("p_partkey") % 5, PLATFORM_ORDER)
    kind = F.lit(None).cast("string")
    for name, kinds in KINDS.items():
        mapped = pick(F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("p_type")) - 1,
                      kinds)
        kind = F.when(F.col("platform") == name, mapped).otherwise(kind)
    failed = (F.col("p_type") == "PROMO") & (F.col("p_size") <= 10)
    gone = (F.col("p_type") == "MEDIUM") & (F.col("p_size") <= 10)
    error = (
        F.when(failed & (F.col("platform") == "vertex"), "PermissionDenied: 403 on list")
        .when(failed & (F.col("platform") == "azureml"), "(ResourceGroupNotFound) gone")
        .when(gone & (F.col("platform") == "databricks"), "Catalog does not exist")
        .when(gone & (F.col("platform") == "sagemaker"), "Endpoint not found")
    )
    name = F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), "p_partkey")
    return (
        p.withColumn("platform", platform)
        .withColumn("kind", kind)
        .select(
            "platform",
            "kind",
            name.alias("name"),
            F.when(F.col("platform") == "snowflake", F.lower("p_brand")).alias("database_name"),
            F.when(F.col("p_size") % 2 == 0, "STARTED").otherwise("SUSPENDED").alias("state"),
            F.upper("p_name").alias("parent"),
            error.alias("error_text"),
            F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string")).alias("version"),
            F.when(F.col("p_size") % 4 == 0, F.upper("p_type"))
            .when(F.col("p_size") % 4 == 1, F.upper("p_name"))
            .when(F.col("p_size") % 4 == 2, "")
            .alias("display_name"),
            "p_size",
        )
    )


def stored_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects in containers: returned large lines of `lineitem`, by the name of their part."""
    lines = table(spark, sf, "lineitem").filter(
        (F.col("l_quantity") >= 40) & (F.col("l_returnflag") == "R")
    )
    parts = table(spark, sf, "part")
    name = F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), "p_partkey")
    wanted = lines.select(F.col("l_partkey").alias("p_partkey")).distinct()
    return parts.join(wanted, "p_partkey", "left_semi").select(
        pick(F.col("p_partkey") % 5, PLATFORM_ORDER).alias("platform"), name.alias("name")
    )


def line_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Billing lines from `lineitem`: day, service, signed amount and quantity."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    margin = F.col("l_discount").cast("decimal(6,2)") - F.lit("0.05").cast("decimal(6,2)")
    return table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("time"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("service"),
        (price * margin).alias("amount"),
        F.col("l_quantity").alias("quantity"),
    )


def nested_export(spark: SparkSession, sf: str) -> DataFrame:
    """The nested billing document: one period per day, one group per service (a handful)."""
    daily = (
        line_amounts(spark, sf)
        .groupBy(F.to_date("time").alias("day"), "service")
        .agg(F.sum("amount").cast("string").alias("amount"))
    )
    group = F.struct(
        F.array("service").alias("Keys"),
        F.struct(F.struct(F.col("amount").alias("Amount")).alias("UnblendedCost")).alias(
            "Metrics"
        ),
    )
    period = F.struct(
        F.col("day").cast("string").alias("Start"),
        F.date_add("day", 1).cast("string").alias("End"),
    )
    return (
        daily.groupBy("day")
        .agg(F.collect_list(group).alias("Groups"))
        .select(F.array(F.struct(period.alias("TimePeriod"), "Groups")).alias("ResultsByTime"))
    )


def requests(
    spark: SparkSession,
    sf: str,
    source: Callable[[SparkSession, str], DataFrame] = housing,
) -> DataFrame:
    """Scoring payloads: one request per row of the training table, with it twice.

    Orders of a 31st lack a feature, those of a 1st send no instance, and the keys come in
    another order than in training.
    """
    h = source(spark, sf)
    names = [*reversed(FEATURES)]
    broken = F.col("ave_bedrms") == 31
    members = [
        F.when(broken & F.lit(c == "latitude"), None).otherwise(F.col(c)).alias(c) for c in names
    ]
    body = h.select(
        F.concat_ws("-", F.col("population").cast("long"), F.col("ave_rooms").cast("long"),
                    F.col(ROW_ID)).alias("request_id"),
        F.to_json(F.struct(*members)).alias("one"),
        F.col("ave_bedrms").alias("day"),
    )
    text = F.when(F.col("day") == 1, F.lit('{"instances":[]}')).otherwise(
        F.concat(F.lit('{"instances":['), "one", F.lit(","), "one", F.lit("]}"))
    )
    return body.select("request_id", text.alias("body"))
