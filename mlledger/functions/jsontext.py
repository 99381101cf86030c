"""Expressions over JSON kept as text: metrics, params and residual resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(json: Column | str, key: str) -> Column:
    return F.get_json_object(_col(json), f"$.{key}")


def has_key(json: Column | str, key: str) -> Column:
    """Key test that also holds where the value is JSON null."""
    return F.coalesce(F.array_contains(F.json_object_keys(_col(json)), key), F.lit(False))


def or_empty_object(json: Column | str) -> Column:
    return F.coalesce(_col(json), F.lit("{}"))


def array_size(json: Column | str, key: str) -> Column:
    """Length of the array under a key, and 0 where there is none."""
    return F.coalesce(F.json_array_length(text_of(json, key)), F.lit(0))


def is_teardown(params: Column | str) -> Column:
    return text_of(params, "action").eqNullSafe("teardown")


def canonical_stage(stage: Column | str, params: Column | str) -> Column:
    """Older rows wrote a teardown as a deploy with params.action."""
    return F.when(is_teardown(params), F.lit("teardown")).otherwise(_col(stage))


def with_literal_type(df: DataFrame, variant: Column | str, out: str = "type") -> DataFrame:
    """Add int, float, bool, null, text, or nested for a parsed JSON value; null if unparsed.

    The schema text is a column of its own, so that each value is inspected once.
    """
    kind = F.col("_kind")
    name = (
        F.when(kind == "BIGINT", "int")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "float")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "VOID", "null")
        .when(kind == "STRING", "text")
        .when(kind.isNotNull(), "nested")
    )
    typed = df.withColumn("_kind", F.schema_of_variant(_col(variant)))
    return typed.withColumn(out, name).drop("_kind")
