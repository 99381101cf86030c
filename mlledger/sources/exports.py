"""Exports of other systems: billing, resource inventories and infrastructure logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlledger.schemas import INVENTORY_SCHEMA

NESTED_COST_SCHEMA = """
ResultsByTime ARRAY<STRUCT<
    TimePeriod: STRUCT<Start: STRING, End: STRING>,
    Groups: ARRAY<STRUCT<
        Keys: ARRAY<STRING>,
        Metrics: STRUCT<UnblendedCost: STRUCT<Amount: STRING>>>>>>
"""
USAGE_SCHEMA = "usage_date DATE, sku_name STRING, usage_quantity DOUBLE"
METER_SCHEMA = "start_time TIMESTAMP, warehouse_name STRING, credits_used DOUBLE"
BILLING_SCHEMA = "usage_start_time TIMESTAMP, service STRUCT<description: STRING>, cost DOUBLE"
FLAT_COST_SCHEMA = "usage_date STRING, service STRING, cost DOUBLE"

COST_EXPORTS = {
    "sagemaker": NESTED_COST_SCHEMA,
    "databricks": USAGE_SCHEMA,
    "snowflake": METER_SCHEMA,
    "vertex": BILLING_SCHEMA,
    "azureml": FLAT_COST_SCHEMA,
}

# Fixed value: how the last line of an infrastructure run begins.
_DONE = r"(?:Apply|Destroy) complete! Resources: [^\n]*?"
_CLOSING = _DONE + r"\b\d+ destroyed"


def read_cost_export(spark: SparkSession, platform: str, path: str) -> DataFrame:
    """The billing export of one platform, JSON or Parquet, with its fixed schema.

    A malformed row ends the read with an error: costs that can't be read are not zero. A nested
    export is one document a file.
    """
    schema = COST_EXPORTS[platform]
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    multi_line = "true" if platform == "sagemaker" else "false"
    reader = spark.read.schema(schema).option("multiLine", multi_line)
    return reader.option("mode", "FAILFAST").json(path)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Resource listings of all platforms in one schema; a malformed row is an error."""
    return spark.read.schema(INVENTORY_SCHEMA).option("mode", "FAILFAST").json(path)


def resource_count(output: Column, action: Column) -> Column:
    """Resources an infrastructure run made or removed; null if the log does not say.

    A saved destroy plan is run by `apply` and reports `0 added`, so for a destroy only the
    last number counts.
    """
    added, destroyed = (
        F.regexp_extract(output, _DONE + rf"\b(\d+) {word}", 1) for word in ("added", "destroyed")
    )
    number = F.when((action == "destroy") | (added == ""), destroyed).otherwise(added)
    return F.when(number != "", number).try_cast("int")


# A log is a file or, as Spark writes a long text, a folder of parts whose names are in order.
_LOG_FILES = "{*.log,part-*.txt}"
_LOG_PATH = r"\.log(/part-[^/]*\.txt)?$"


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Logs kept as <env>/<action>.log: env, action, and the resource count that the first closing line
    of the log states (null if there is none), one row per log.

    A log is one file, or a folder of part-*.txt that follow one another by name. Logs are scanned by
    lines, so a long one is split over tasks and none is held whole. A line's place is that of its part
    in the log and of its block in the part, then its place in the block.
    """
    path = F.col("_metadata.file_path")
    log = F.regexp_replace(path, _LOG_PATH, ".log")
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _LOG_FILES)
        .text(folder)
        .select(
            path.alias("path"),
            log.alias("file"),
            F.regexp_extract(path, _LOG_PATH, 1).alias("part"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            "value",
        )
    )
    closing = F.min(F.struct("part", "block", "line", "value"))["value"]
    stated = (
        lines.filter(F.col("path").rlike(_LOG_PATH) & F.col("value").rlike(_CLOSING))
        .groupBy("file")
        .agg(closing.alias("output"))
    )
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _LOG_FILES)
        .load(folder)
        .filter(path.rlike(_LOG_PATH))
        .select(log.alias("file"))  # no content is read
        .distinct()
    )
    env = F.element_at(F.split("file", "/"), -2)
    action = F.regexp_extract("file", r"([^/]+)\.log$", 1)
    return files.join(stated, "file", "left").select(
        env.alias("env"),
        action.alias("action"),
        resource_count(F.col("output"), action).alias("resource_count"),
    )
