"""Ledger rows that arrive as files: fallback lines, run manifests and golden snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.readwriter import DataFrameReader

from mlledger.functions.jsontext import or_empty_object
from mlledger.schemas import FAILURE_CLASSES, RUN_DOMAINS, RUN_LINE_SCHEMA

# Fixed value: name of the fallback file; Spark's own appends are called part-*.json.
LINE_FILES = "{ml_runs.jsonl,part-*.json}"
# Fixed value: a manifest is a file run.json, or a folder of that name as Spark writes it.
MANIFEST_FILES = "{run.json,part-*.txt}"
_MANIFEST_PATH = r"/run\.json(/part-[^/]*)?$"

_CORRUPT = T.StructField("_corrupt_record", T.StringType())


def _line_reader(reader: DataFrameReader | DataStreamReader, names: str = LINE_FILES):
    schema = T.StructType([*RUN_LINE_SCHEMA.fields, _CORRUPT])
    return (
        reader.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", names)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
    )


def read_lines(spark: SparkSession, folder: str, names: str = LINE_FILES) -> DataFrame:
    """Every fallback line below a folder; a folder without any fallback file is an error.

    names: glob of the file names.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if files.option("pathGlobFilter", names).load(folder).select("path").isEmpty():
        raise FileNotFoundError(f"no {names} below {folder}")
    return with_line_defaults(_line_reader(spark.read, names).json(folder))


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The same lines as a stream of new files."""
    reader = _line_reader(spark.readStream)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_line_defaults(reader.json(folder))


def with_line_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "attempt": F.coalesce("attempt", F.lit(1)),
            "metrics": or_empty_object("metrics"),
            "params": or_empty_object("params"),
        }
    )


def _line_problem() -> Column:
    """Name of the first field that cannot be decoded, or null."""
    checks = [F.when(F.col("_corrupt_record").isNotNull(), F.lit("json"))]
    for name in ["run_id", "code_revision"]:
        checks.append(F.when(F.col(name).isNull(), F.lit(name)))
    for name, values in RUN_DOMAINS.items():
        bad = ~F.coalesce(F.col(name).isin(values), F.lit(False))
        checks.append(F.when(bad, F.lit(name)))
    failure = F.col("failure_class")
    checks.append(
        F.when(
            failure.isNotNull() & (failure != "") & ~failure.isin(FAILURE_CLASSES),
            F.lit("failure_class"),
        )
    )
    return F.coalesce(*checks)


def decode_lines(lines: DataFrame) -> DataFrame:
    """Add `problem`: null for a good line, else the field that breaks the contract."""
    empty_to_null = F.when(F.col("failure_class") != "", F.col("failure_class"))
    return lines.withColumn("problem", _line_problem()).withColumn("failure_class", empty_to_null)


def good_lines(lines: DataFrame) -> DataFrame:
    return decode_lines(lines).filter(F.col("problem").isNull()).drop("problem", "_corrupt_record")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The lines a collect must not lose: what they said and why they were refused."""
    return refused_lines(decode_lines(lines))


def refused_lines(decoded: DataFrame) -> DataFrame:
    """The same for lines that are decoded already."""
    known = [f.name for f in RUN_LINE_SCHEMA.fields]
    raw = F.coalesce("_corrupt_record", F.to_json(F.struct(*known)))
    return decoded.filter(F.col("problem").isNotNull()).select("run_id", "problem", raw.alias("line"))


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per run.json below a folder; broken or non-object files give an empty manifest."""
    path = F.col("_metadata.file_path")
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", MANIFEST_FILES)
        .text(folder, wholetext=True)
        .filter(path.rlike(_MANIFEST_PATH))
        .select(F.regexp_replace(path, _MANIFEST_PATH, "").alias("output_dir"), "value")
    )
    return parse_manifests(files)


def parse_manifests(files: DataFrame) -> DataFrame:
    """(output_dir, value) → (output_dir, manifest columns)."""
    is_object = F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT")
    text = F.when(is_object, F.col("value")).otherwise(F.lit("{}"))
    keys = ["run_id", "code_revision", "model", "dataset", "metrics", "params", "artifact_uri"]
    picked = [F.get_json_object("manifest", f"$.{k}").alias(k) for k in keys]
    return files.withColumn("manifest", text).select("output_dir", *picked)


GOLDEN_SCHEMA = T.StructType(
    [
        T.StructField("captured_at", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField(
            "runs",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("platform", T.StringType()),
                        T.StructField("tier", T.StringType()),
                        T.StructField("code_revision", T.StringType()),
                        T.StructField("write_path", T.StringType()),
                        T.StructField("rmse", T.DoubleType()),
                        T.StructField("mae", T.DoubleType()),
                        T.StructField("r2", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a golden-run snapshot document."""
    doc = spark.read.schema(GOLDEN_SCHEMA).option("multiLine", "true").json(path)
    return doc.select(F.explode("runs").alias("run")).select("run.*")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
