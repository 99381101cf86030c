"""Small helpers that several operators of this package share."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mlledger.session import fresh_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there, and a lost
    executor costs no recomputation."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that a Python task is given at once.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session hands rows to Python in batches of BATCH_BYTES, or of a single row, from
    now on. By Spark's default 64 MB of texts may meet in a batch, which the JVM, Arrow and pandas
    then hold several times over for each core. A session that has a limit of its own keeps it."""
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(limit, None) is None:
        conf.set(limit, str(BATCH_BYTES))
    return df


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def hashes(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes, together an identity of 128 bits. A null differs from an
    empty text."""
    parts = [p for c in columns for p in (c.isNull(), c)]
    return F.xxhash64(F.lit(11), *parts), F.xxhash64(F.lit(29), *parts)


def numbered(
    df: DataFrame, cell: Sequence[str], order: Sequence[str], name: str, slice_rows: int = 16384
) -> DataFrame:
    """``df`` with a gapless number from 0 inside each cell.

    A cell may hold any share of the rows: it is cut into hash slices of about ``slice_rows`` rows,
    which are numbered apart and shifted by the rows of the slices before them. The order is that
    of (hash slice, ``order``), so it depends on the rows alone. Cells must not be null; ``df``
    should be a stored table, as it is read three times.
    """
    slices = max(1, math.ceil(df.count() / slice_rows))
    part, start = fresh_name(df, "_slice"), fresh_name(df, "_start")
    cut = df.withColumn(part, F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(slices)))
    before = Window.partitionBy(*cell).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*cell, part)
        .agg(F.count("*").alias(start))
        .withColumn(start, F.coalesce(F.sum(start).over(before), F.lit(0)))
    )
    inside = Window.partitionBy(*cell, part).orderBy(*order)
    return (
        cut.withColumn(name, F.row_number().over(inside).cast("long") - 1)
        .join(starts, [*cell, part])
        .withColumn(name, F.col(name) + F.col(start))
        .drop(part, start)
    )
