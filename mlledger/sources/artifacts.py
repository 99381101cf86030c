"""Artifact listings and file checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ArtifactUriError(ValueError):
    pass


def uri_parts(uri: Column, scheme: str) -> Column:
    """STRUCT<bucket, prefix, problem> of scheme://bucket/prefix."""
    marker = f"{scheme}://"
    rest = F.substr(uri, F.lit(len(marker) + 1))
    bucket = F.split_part(rest, F.lit("/"), F.lit(1))
    prefix = F.regexp_replace(F.regexp_replace(rest, "^[^/]*", ""), "^/+|/+$", "")
    problem = F.when(~uri.startswith(marker), F.lit("scheme")).when(bucket == "", F.lit("bucket"))
    good = problem.isNull()
    return F.struct(
        F.when(good, bucket).alias("bucket"),
        F.when(good, prefix).alias("prefix"),
        problem.alias("problem"),
    )


def file_name(key: Column) -> Column:
    """Last path segment; empty for a directory marker."""
    return F.element_at(F.split(key, "/"), -1)


def list_objects(objects: DataFrame, scheme: str, uri: str = "uri") -> DataFrame:
    """Downloadable objects of a listing: parts of the URI and the file name, markers left out."""
    parts = uri_parts(F.col(uri), scheme)
    return (
        objects.withColumn("_parts", parts)
        .withColumn("file_name", file_name(F.col(uri)))
        .filter(F.col("_parts.problem").isNotNull() | (F.col("file_name") != ""))
        .select(
            *objects.columns,
            F.col("_parts.bucket").alias("bucket"),
            F.col("_parts.prefix").alias("key"),
            F.when(F.col("_parts.problem").isNull(), F.col("file_name")).alias("file_name"),
            F.col("_parts.problem").alias("problem"),
        )
    )


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder of any file system Spark can read; an empty folder is an error.

    Only path and length are selected, so no file content is read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length")
    )
    if files.isEmpty():
        raise ArtifactUriError(f"no files below {folder}")
    return files.withColumn("file_name", file_name(F.col("path")))


def file_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """sha256 per file. One task holds one file at a time, up to Spark's 2 GB for a binary value."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length", F.sha2("content", 256).alias("sha256"))
    )
