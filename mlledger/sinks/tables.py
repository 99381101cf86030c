"""Writes: exports, append-only ledger tables, fallback lines and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from mlledger.operators.exact import first_per_key
from mlledger.operators.ledger import absent_rows, golden_rows, merge_params
from mlledger.operators.prep import DataContractError, fingerprint
from mlledger.schemas import (
    COST_SCHEMA,
    HOUSING_TABLE_SCHEMA,
    INFRA_SCHEMA,
    ROW_ID,
    RUN_SCHEMA,
)
from mlledger.session import durable
from mlledger.sinks.files import exists, folder_is_whole, remove, write_file
from mlledger.sources.artifacts import file_checksums

#: Partition column of a ledger, a hash of its key, and how many values it has. A batch of few keys
#: reads only the folders of their hashes.
KEY_BUCKET = "key_bucket"
KEY_BUCKETS = 256
BUCKETED = T.StructField(KEY_BUCKET, T.IntegerType())
#: Partition column of the costs, so that a late delivery touches few folders.
BY_MONTH = T.StructField("usage_month", T.StringType())
COST_KEYS = ["platform", "usage_date", "service"]


def key_bucket(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


TABLES: dict[str, tuple[StructType, tuple[str, ...]]] = {
    "ml_runs": (StructType([*RUN_SCHEMA.fields, BUCKETED]), (KEY_BUCKET,)),
    "infra_events": (StructType([*INFRA_SCHEMA.fields, BUCKETED]), (KEY_BUCKET,)),
    "cost_snapshots": (StructType([*COST_SCHEMA.fields, BY_MONTH]), ("platform", "usage_month")),
    "housing": (HOUSING_TABLE_SCHEMA, ()),
}


#: Rows in an exported file, which keeps it far below the 2 GB that a checksum can take.
EXPORT_FILE_ROWS = 10_000_000


def create_table(
    spark: SparkSession, path: str, schema: StructType, partition_by: tuple[str, ...] = ()
) -> None:
    """An empty table folder; an existing one is left as it is."""
    empty = spark.createDataFrame([], schema)
    empty.write.mode("ignore").partitionBy(*partition_by).parquet(path)


def create_tables(spark: SparkSession, root: str) -> None:
    for name, (schema, partition_by) in TABLES.items():
        create_table(spark, f"{root}/{name}", schema, partition_by)


def register_tables(spark: SparkSession, root: str, database: str = "default") -> None:
    """The same folders as catalog tables, for SQL users."""
    for name, (schema, partition_by) in TABLES.items():
        layout = f"PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema.toDDL()}) "
            f"USING parquet {layout} LOCATION '{root}/{name}'"
        )
        if partition_by:
            spark.sql(f"MSCK REPAIR TABLE {database}.{name}")


def drop_tables(spark: SparkSession, database: str = "default") -> None:
    """Forget the catalog entries; the folders stay."""
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def ledger_part(spark: SparkSession, path: str, schema: StructType, incoming: DataFrame, key: str) -> DataFrame:
    """The folders of a bucketed ledger that may hold a key of `incoming`; the list of their numbers is
    never longer than KEY_BUCKETS, whatever the size of either table."""
    touched = incoming.select(key_bucket(key).alias("b")).distinct().collect()
    existing = spark.read.schema(schema).parquet(path)
    return existing.filter(F.col(KEY_BUCKET).isin([r.b for r in touched]))


def append_absent(
    incoming: DataFrame,
    path: str,
    key: str,
    schema: StructType,
    order: list[Column] | None = None,
    partition_by: tuple[str, ...] = (),
) -> int:
    """Append the rows whose key the table lacks; returns how many.

    Running it again after a lost job adds only what is still missing. A table partitioned by
    KEY_BUCKET is read only where its hashes are those of incoming keys; such an `incoming` is
    evaluated twice, so it should be a stored table if it is costly. Two writers that append the same
    key at once both succeed; `first_rows` reads the earlier row.
    """
    spark = incoming.sparkSession
    seen = Observation()
    if KEY_BUCKET in partition_by:
        existing = ledger_part(spark, path, schema, incoming, key)
        incoming = incoming.withColumn(KEY_BUCKET, key_bucket(key))
    else:
        existing = spark.read.schema(schema).parquet(path)
    rows = absent_rows(incoming, existing, key, order).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    )
    counted = rows.hint("rebalance", *partition_by).observe(seen, F.count(F.lit(1)).alias("inserted"))
    counted.write.mode("append").partitionBy(*partition_by).parquet(path)
    return seen.get["inserted"]


def first_rows(ledger: DataFrame, key: str) -> DataFrame:
    """A ledger as its readers should see it: of rows that share a key the first by created_at, then
    by the other columns. Only two writers at the same time leave such rows."""
    columns = [c for c in ledger.columns if c not in (key, KEY_BUCKET)]
    order = ["created_at", *sorted(c for c in columns if c != "created_at")]
    return first_per_key(ledger, [key], [F.col(c) for c in order]).drop(KEY_BUCKET)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return first_rows(spark.read.schema(TABLES["ml_runs"][0]).parquet(path), "run_id")


def load_housing(incoming: DataFrame, path: str, source: str) -> dict[str, int]:
    """Bulk load that skips known row ids; a table that is still empty afterwards is an error."""
    spark = incoming.sparkSession
    create_table(spark, path, HOUSING_TABLE_SCHEMA)
    stamped = incoming.withColumn("source", F.lit(source)).withColumn(
        "ingested_at", F.current_timestamp()
    )
    offered = Observation()
    counted = stamped.observe(offered, F.count(F.lit(1)).alias("rows"))
    others = [F.col(c) for c in sorted(incoming.columns) if c != ROW_ID]
    inserted = append_absent(counted, path, ROW_ID, HOUSING_TABLE_SCHEMA, others)
    total = spark.read.schema(HOUSING_TABLE_SCHEMA).parquet(path).count()
    if total == 0:
        raise DataContractError("the table is empty after the load")
    fetched = offered.get["rows"]
    return {
        "fetched": fetched,
        "inserted": inserted,
        "skipped": fetched - inserted,
        "total": total,
    }


def export_dataset(df: DataFrame, path: str) -> DataFrame:
    """Write the hand-over data set with its checksums beside it; zero rows are refused.

    <path>.sha256 holds sha256 and name per file, <path>.fingerprint the layout-independent
    content fingerprint.
    """
    if df.isEmpty():
        raise DataContractError("nothing to export")
    df.write.mode("errorifexists").option("maxRecordsPerFile", EXPORT_FILE_ROWS).parquet(path)
    spark = df.sparkSession
    written = spark.read.parquet(path)
    name = F.element_at(F.split("path", "/"), -1)
    sums = file_checksums(spark, path).filter(name.endswith(".parquet"))
    sums.select(F.concat_ws("  ", "sha256", name)).write.text(f"{path}.sha256")
    mark = fingerprint(written, written.columns)
    mark.write.json(f"{path}.fingerprint")
    return spark.read.schema(mark.schema).json(f"{path}.fingerprint")


def append_lines(runs: DataFrame, folder: str) -> None:
    """Fallback lines: always `collected`, without created_at, metrics and params as objects."""
    lines = runs.drop("created_at").withColumns(
        {
            "write_path": F.lit("collected"),
            "metrics": F.parse_json("metrics"),
            "params": F.parse_json("params"),
        }
    )
    lines.write.mode("append").json(folder)


def append_costs(costs: DataFrame, path: str, batch_no: int) -> None:
    """Deliver one batch of cost rows. Earlier rows stay; reading takes the last batch per key.

    Appending keeps a lost job harmless: repeating the batch repeats equal rows.
    """
    schema, layout = TABLES["cost_snapshots"]
    rows = costs.withColumns(
        {"batch_no": F.lit(batch_no), "usage_month": F.date_format("usage_date", "yyyy-MM")}
    )
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    rows.select(*typed).write.mode("append").partitionBy(*layout).parquet(path)


PATCH_SCHEMA = "run_id string, patch string, patch_no int"


def append_patches(patches: DataFrame, ledger: DataFrame, path: str, patch_no: int) -> DataFrame:
    """Give params patches (run_id, patch) to the runs that the ledger holds now, under a number.

    Only patches that reach a run are stored, so a run that arrives later stays as it comes, as with
    an update in place. The ledger's rows stay; reading applies the patches. A number is given once:
    if its folder is whole, nothing happens and what it reached stays; a delivery that failed midway is
    made anew. Returns the stored patches.
    """
    spark = patches.sparkSession
    folder = f"{path}/patch_no={patch_no}"
    if not folder_is_whole(spark, folder):
        reached = patches.select("run_id", "patch").join(
            ledger.select("run_id").distinct(), "run_id", "left_semi"
        )
        reached.write.mode("overwrite").parquet(folder)
    return spark.read.schema(PATCH_SCHEMA).parquet(path).filter(F.col("patch_no") == patch_no)


def patched_runs(runs: DataFrame, path: str) -> DataFrame:
    """The ledger with all stored patches applied; `compact` makes it a table of its own."""
    return merge_params(runs, runs.sparkSession.read.schema(PATCH_SCHEMA).parquet(path))


def record_check(events: DataFrame, items: DataFrame, check_id: str, root: str) -> int:
    """Record one residual check: its events in <root>/infra_events, and all of its items, whatever
    their number, in <root>/infra_event_items. Returns how many events are new; recording the same
    check again adds none and writes the same items."""
    spark = events.sparkSession
    items.write.mode("overwrite").parquet(f"{root}/infra_event_items/check_id={check_id}")
    schema, partition_by = TABLES["infra_events"]
    create_table(spark, f"{root}/infra_events", schema, partition_by)
    return append_absent(
        events, f"{root}/infra_events", "event_id", schema, partition_by=partition_by
    )


def current_costs(costs: DataFrame) -> DataFrame:
    """Last delivery wins per (platform, usage_date, service)."""
    return first_per_key(costs, COST_KEYS, [F.col("batch_no").desc(), F.col("amount_usd")])


def compact_costs(spark: SparkSession, path: str) -> int:
    """Resolve the cost table in place where a later delivery changed it; returns how many folders.

    Only folders (platform, month) in which a key has several rows are read whole and written again;
    all other files stay as they are. The resolved rows are written aside first, and a pointer to
    them stands until the folders are replaced: if the job dies in between, the next call ends
    its work. No delivery may be appended meanwhile.
    """
    schema, layout = TABLES["cost_snapshots"]
    pointer, aside = f"{path}/_replacing", f"{path}/_resolved"
    columns = [f.name for f in schema.fields]

    def replace() -> None:
        rows = spark.read.schema(schema).parquet(aside).select(*columns)
        writer = rows.hint("rebalance", *layout).write.mode("overwrite").partitionBy(*layout)
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)
        remove(spark, pointer)
        remove(spark, aside)

    if exists(spark, pointer):
        replace()
    costs = spark.read.schema(schema).parquet(path)
    changed = (
        costs.groupBy(*COST_KEYS, "usage_month").count().filter("count > 1").select(*layout).distinct()
    )
    folders = durable(changed)
    if not (number := folders.count()):
        return 0
    same = [costs[c].eqNullSafe(folders[c]) for c in layout]
    resolved = current_costs(costs.join(folders, same, "left_semi"))
    resolved.select(*columns).write.mode("overwrite").partitionBy(*layout).parquet(aside)
    write_file(spark, pointer, aside)
    replace()
    return number


def compact(df: DataFrame, target: str, *partition_by: str) -> None:
    """Write a resolved table to a new folder in even files, also where one value is very common."""
    even = df.hint("rebalance", *partition_by) if partition_by else df.hint("rebalance")
    writer = even.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)


def golden_document(runs: DataFrame, captured_at: str, source: str) -> DataFrame:
    """The golden snapshot as one JSON text. It holds one row per platform, so five at most."""
    row = F.struct(*golden_rows(runs).columns)
    doc = F.struct(
        F.lit(captured_at).alias("captured_at"),
        F.lit(source).alias("source"),
        F.array_sort(F.collect_list(row)).alias("runs"),
    )
    return golden_rows(runs).agg(F.to_json(doc).alias("value"))


def write_golden(runs: DataFrame, captured_at: str, source: str, path: str) -> None:
    golden_document(runs, captured_at, source).write.mode("overwrite").text(path)
