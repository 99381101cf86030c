"""Table schemas, value domains and the platform dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column contract of the training table.
FEATURES = [
    "med_inc",
    "house_age",
    "ave_rooms",
    "ave_bedrms",
    "population",
    "ave_occup",
    "latitude",
    "longitude",
]
TARGET = "med_house_val"
ROW_ID = "row_id"
SEED = 42

# Names of the same columns in the original data set.
SOURCE_COLUMNS = {
    "MedInc": "med_inc",
    "HouseAge": "house_age",
    "AveRooms": "ave_rooms",
    "AveBedrms": "ave_bedrms",
    "Population": "population",
    "AveOccup": "ave_occup",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "MedHouseVal": "med_house_val",
}

# Domains of the ledger's text columns.
PLATFORMS = ["vertex", "sagemaker", "azureml", "databricks", "snowflake"]
TIERS = ["A", "B"]
UNITS = ["container", "package"]
STAGES = ["train", "register", "deploy", "predict", "teardown"]
STATUSES = ["success", "failure"]
FAILURE_CLASSES = ["iam", "quota", "container", "package", "network", "sdk", "data", "none"]
WRITE_PATHS = ["direct", "collected"]
ACTIONS = ["apply", "destroy"]

# Tier and unit follow from the platform.
PLATFORM_ROWS = [
    ("vertex", "A", "container"),
    ("sagemaker", "A", "container"),
    ("azureml", "A", "container"),
    ("databricks", "B", "package"),
    ("snowflake", "B", "package"),
]

HOUSING_SCHEMA = T.StructType(
    [T.StructField(ROW_ID, T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in [*FEATURES, TARGET]]
)

HOUSING_TABLE_SCHEMA = T.StructType(
    HOUSING_SCHEMA.fields
    + [
        T.StructField("source", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("tier", T.StringType()),
        T.StructField("unification_unit", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("failure_class", T.StringType()),
        T.StructField("error_excerpt", T.StringType()),
        T.StructField("code_revision", T.StringType()),
        T.StructField("write_path", T.StringType()),
        T.StructField("metrics", T.StringType()),
        T.StructField("params", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# A fallback line carries no created_at: the ledger stamps it on insert.
RUN_LINE_SCHEMA = T.StructType([f for f in RUN_SCHEMA.fields if f.name != "created_at"])

INFRA_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("resource_count", T.IntegerType()),
        T.StructField("residual_resources", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# batch_no orders the deliveries of one (platform, usage_date, service).
COST_SCHEMA = T.StructType(
    [
        T.StructField("platform", T.StringType()),
        T.StructField("usage_date", T.DateType()),
        T.StructField("service", T.StringType()),
        T.StructField("amount_usd", T.DecimalType(18, 6)),
        T.StructField("batch_no", T.LongType()),
    ]
)

INVENTORY_SCHEMA = T.StructType(
    [
        T.StructField("platform", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("database_name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("error_text", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("display_name", T.StringType()),
    ]
)

RUN_DOMAINS = {
    "platform": PLATFORMS,
    "tier": TIERS,
    "unification_unit": UNITS,
    "stage": STAGES,
    "status": STATUSES,
    "write_path": WRITE_PATHS,
}


def fixed_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A few fixed rows as an inline SQL table, whose size the optimizer knows."""

    def literal(value: object) -> str:
        if value is None:
            return "NULL"
        return f"'{value}'" if isinstance(value, str) else str(value)

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS fixed({', '.join(columns)})")


def platform_dim(spark: SparkSession) -> DataFrame:
    """platform → tier, unification_unit. Five fixed rows, so always safe to broadcast."""
    return fixed_table(spark, ["platform", "tier", "unification_unit"], PLATFORM_ROWS)


def uuid_shaped(column: Column | str) -> Column:
    """Whether a text id has the shape of a UUID."""
    col = F.col(column) if isinstance(column, str) else column
    return col.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
