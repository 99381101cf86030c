"""Fallback lines as a stream: ingest into the ledger, and running counters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mlledger.operators.exact import first_per_key
from mlledger.operators.ledger import absent_rows, stamp_created
from mlledger.session import fresh_folder
from mlledger.sinks.files import folder_is_whole, remove
from mlledger.sinks.tables import (
    TABLES,
    append_absent,
    create_table,
    ledger_part,
)
from mlledger.sources.ledger_files import decode_lines, refused_lines, stream_lines

SCHEMA, PARTITIONS = TABLES["ml_runs"]
INCREMENT = "platform string, stage string, runs long, failures long"


class Collected(NamedTuple):
    inserted: int
    skipped: int
    rejected: int


def _arrival_order(runs: DataFrame) -> list[Column]:
    """Of several lines of one run the first in this order is taken, whatever their files."""
    first = [c for c in ["attempt", "status", "metrics", "params"] if c in runs.columns]
    rest = sorted(set(runs.columns) - {*first, "run_id", "created_at"})
    return [F.col(c) for c in [*first, *rest]]


def ingest(lines: DataFrame, ledger: str, work: str, rejects: str, counts: str | None = None) -> Collected:
    """One delivery of lines: good ones into the ledger, refused ones to `rejects`, and how many runs
    and failures were new per (platform, stage) to `counts`.

    The lines are decoded once, into `work`, with the new runs beside them; all else is read from
    there. If a delivery is repeated with the same folders after it failed anywhere, it goes on from
    there: what was new stays new although the ledger may hold it by now, so counts are neither lost
    nor doubled, and refused lines are written over.
    """
    spark = lines.sparkSession
    if not folder_is_whole(spark, f"{work}/lines"):
        decode_lines(lines).write.mode("overwrite").parquet(f"{work}/lines")
    decoded = spark.read.parquet(f"{work}/lines")
    good = stamp_created(
        decoded.filter(F.col("problem").isNull()).drop("problem", "_corrupt_record")
    ).withColumn("write_path", F.lit("collected"))
    if not folder_is_whole(spark, f"{work}/new"):
        held = ledger_part(spark, ledger, SCHEMA, good, "run_id")
        new = absent_rows(good, held, "run_id", _arrival_order(good))
        new.write.mode("overwrite").parquet(f"{work}/new")
    new = spark.read.parquet(f"{work}/new")
    append_absent(new, ledger, "run_id", SCHEMA, _arrival_order(new), PARTITIONS)
    refused_lines(decoded).write.mode("overwrite").json(rejects)
    if counts is not None:
        increments(new).coalesce(1).write.mode("overwrite").parquet(counts)
    total, rejected = decoded.agg(F.count("*"), F.count("problem")).first()
    inserted = new.count()
    return Collected(inserted, total - rejected - inserted, rejected)


def collect_stream(
    spark: SparkSession,
    folder: str,
    ledger: str,
    checkpoint: str,
    rejects: str,
    files_per_batch: int | None = None,
    counts: str | None = None,
) -> StreamingQuery:
    """Ingest new fallback files into the ledger and stop when none is left.

    Lines that can't be decoded are kept below `rejects` with the reason. With `counts`, every batch
    also writes what it added per (platform, stage) to <counts>/batch=<n>; `current_counters` adds
    them up. The stream has no state: which runs are new is asked of the ledger.

    A batch appends only run ids the ledger lacks, so a batch repeated after a failure, a file
    delivered twice, or a second start adds nothing.
    """
    create_table(spark, ledger, SCHEMA, PARTITIONS)

    def deliver(batch: DataFrame, batch_no: int) -> None:
        ingest(
            batch,
            ledger,
            f"{checkpoint}/deliveries/{batch_no}",
            f"{rejects}/batch={batch_no}",
            f"{counts}/batch={batch_no}" if counts else None,
        )
        # The one before is committed by now, so it won't be repeated.
        remove(spark, f"{checkpoint}/deliveries/{batch_no - 1}")

    return (
        stream_lines(spark, folder, files_per_batch)
        .writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def collect_batch(
    spark: SparkSession, lines: DataFrame, ledger: str, rejects: str, delivery: str = "1"
) -> Collected:
    """The same ingest for lines that were read as a batch. Refused lines go to <rejects>/batch=<delivery>,
    so none is lost, and a delivery that is repeated under its name keeps them once."""
    create_table(spark, ledger, SCHEMA, PARTITIONS)
    work = fresh_folder(spark, "delivery")
    return ingest(lines, ledger, work, f"{rejects}/batch={delivery}")


def counter_stream(
    spark: SparkSession,
    folder: str,
    target: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    ledger: str | None = None,
) -> StreamingQuery:
    """Count new fallback files into <target>/batch=<n>; by default with a ledger of the stream's own."""
    own = ledger or f"{checkpoint}/runs"
    rejects = f"{checkpoint}/rejects"
    return collect_stream(spark, folder, own, checkpoint, rejects, files_per_batch, target)


def counters(lines: DataFrame) -> DataFrame:
    """The counters of a batch of lines: a run counts once, as the first of its lines in arrival order."""
    good = decode_lines(lines).filter(F.col("problem").isNull())
    once = first_per_key(good, ["run_id"], _arrival_order(good))
    return increments(once).withColumn("next_attempt", F.col("runs") + 1)


def increments(runs: DataFrame) -> DataFrame:
    """Runs and failures per (platform, stage)."""
    return runs.groupBy("platform", "stage").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "failure").alias("failures")
    )


def current_counters(spark: SparkSession, counts: str) -> DataFrame:
    """Runs, failures and next attempt per (platform, stage) over all delivered batches."""
    added = spark.read.schema(INCREMENT).option("recursiveFileLookup", "true").parquet(counts)
    return (
        added.groupBy("platform", "stage")
        .agg(F.sum("runs").alias("runs"), F.sum("failures").alias("failures"))
        .withColumn("next_attempt", F.col("runs") + 1)
    )
