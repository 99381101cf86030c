"""Reads of the training table: whole, by page, by id, and from a source with other names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mlledger.schemas import FEATURES, ROW_ID, SOURCE_COLUMNS, TARGET


def read_dataset(
    spark: SparkSession, path: str, schema: StructType | None = None, single_file: bool = False
) -> DataFrame:
    """A Parquet file or folder; single_file keeps the one-file rule of a hand-over folder."""
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path)
    if single_file:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        files = listed.select("path").limit(2).count()
        if not files:
            raise FileNotFoundError(f"no Parquet file under {path}")
        if files > 1:
            raise ValueError(f"expected one Parquet file under {path}, found more")
    return df


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: dict[str, str],
) -> DataFrame:
    """The same table in a database, read in parallel ranges of row_id."""
    return spark.read.jdbc(
        url,
        table,
        column=ROW_ID,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties,
    ).select(ROW_ID, *FEATURES, TARGET)


def page(df: DataFrame, limit: int, offset: int = 0, key: str = ROW_ID) -> DataFrame:
    """One page in key order. Spark keeps limit + offset rows per task, so for deep pages use
    `page_after`."""
    return df.orderBy(key).offset(offset).limit(limit)


def page_after(df: DataFrame, limit: int, last: int | None, key: str = ROW_ID) -> DataFrame:
    """The page that follows the key `last` (null: the first page). The filter reaches the scan,
    and a task keeps no more than `limit` rows, however deep the page is."""
    rest = df if last is None else df.filter(F.col(key) > last)
    return rest.orderBy(key).limit(limit)


def lookup(df: DataFrame, ids: DataFrame | Iterable[int], key: str = ROW_ID) -> DataFrame:
    """Rows with the given ids.

    A plain list becomes an IN filter that reaches the scan; a DataFrame of ids is made
    distinct before its shuffle, so a repeated id costs one row, and then semi-joined.
    """
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
        return df.join(wanted, key, "left_semi")
    return df.filter(F.col(key).isin(list(ids)))


def sample_instance(df: DataFrame) -> DataFrame:
    """The first row by key with its features as doubles: the payload of a one-row request."""
    features = [F.col(c).cast("double").alias(c) for c in FEATURES]
    return df.orderBy(ROW_ID).limit(1).select(*features)


def from_source_names(df: DataFrame, row_id: str) -> DataFrame:
    """Rename and cast a source table. row_id is a column of the data, never generated."""
    renamed = [F.col(a).cast("double").alias(b) for a, b in SOURCE_COLUMNS.items()]
    return df.select(F.col(row_id).cast("long").alias(ROW_ID), *renamed)
