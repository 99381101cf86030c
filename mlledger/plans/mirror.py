"""Runs of one platform as flat parameters and metrics for an experiment tracker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlledger.functions.jsontext import or_empty_object, with_literal_type

# What the tracker accepts and how it names states.
NAME_CHARS = 128
STATES = {"success": "COMPLETE", "failure": "FAILED"}
RUN_COLUMNS = [
    "platform",
    "stage",
    "attempt",
    "write_path",
    "code_revision",
    "failure_class",
]


def run_name() -> Column:
    name = F.lower(F.concat_ws("-", "stage", "run_id"))
    return F.substring(name, 1, NAME_CHARS)


_ENTRY = "struct<kind: string, key: string, value: variant>"


def _members(kind: str, json: str) -> Column:
    """The members of a JSON object as entries."""
    pairs = F.map_entries(F.from_json(or_empty_object(json), "map<string,variant>"))
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.lit(kind).alias("kind"), p["key"].alias("key"), p["value"].alias("value")
        ),
    )


def _own(kind: str, column: str, json: str) -> Column:
    """A column of the run as an entry; null if it is null or the JSON has such a member."""
    keys = F.json_object_keys(or_empty_object(json))
    shadowed = F.coalesce(F.array_contains(keys, column), F.lit(False))
    entry = F.struct(
        F.lit(kind).alias("kind"),
        F.lit(column).alias("key"),
        F.col(column).cast("variant").alias("value"),
    )
    return F.when(F.col(column).isNotNull() & ~shadowed, entry)


def tracker_entries(runs: DataFrame, platform: str = "vertex") -> DataFrame:
    """run_name, state, kind (param, metric), key, num_value, str_value, in one scan.

    The run's own columns are params too, and the duration a metric; a params or metrics member
    of the same name wins over them. Numbers stay numbers, everything else becomes text.
    """
    state = F.when(F.col("status") == "success", STATES["success"]).otherwise(STATES["failure"])
    own = [_own("param", c, "params") for c in RUN_COLUMNS]
    own.append(_own("metric", "duration_seconds", "metrics"))
    entries = F.concat(
        F.array_compact(F.array(*own)).cast(f"array<{_ENTRY}>"),
        _members("param", "params").cast(f"array<{_ENTRY}>"),
        _members("metric", "metrics").cast(f"array<{_ENTRY}>"),
    )
    exploded = (
        runs.filter(F.col("platform") == platform)
        .select(run_name().alias("run_name"), state.alias("state"), F.explode(entries).alias("e"))
        .select("run_name", "state", "e.*")
    )
    typed = with_literal_type(exploded, "value")
    number = F.col("type").isin("int", "float")
    words = F.col("value").cast("string")
    text = (
        F.when(F.col("type") == "bool", F.initcap(words))
        .when(F.col("type") == "null", "None")
        .when(F.col("type") == "text", words)
        .otherwise(F.to_json("value"))
    )
    return typed.select(
        "run_name",
        "state",
        "kind",
        "key",
        F.when(number, words.cast("double")).alias("num_value"),
        F.when(~number, text).alias("str_value"),
    )
