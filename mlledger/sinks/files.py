"""Small files and folders in any file system that Spark can write."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file."""
    system, target = file_system(spark, path)
    out = system.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    write_file(spark, path, json.dumps(document))


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename within one file system; what stood at the target goes."""
    system, new = file_system(spark, target)
    system.delete(new, True)
    if not system.rename(file_system(spark, source)[1], new):
        raise OSError(f"cannot move {source} to {target}")


def make_folder(spark: SparkSession, path: str) -> None:
    system, target = file_system(spark, path)
    system.mkdirs(target)


def remove(spark: SparkSession, path: str) -> None:
    """A file or folder; one that isn't there is fine."""
    system, target = file_system(spark, path)
    system.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, target = file_system(spark, path)
    return system.exists(target)


def folder_is_whole(spark: SparkSession, folder: str) -> bool:
    """Whether a Spark job has finished writing the folder."""
    return exists(spark, f"{folder}/_SUCCESS")
