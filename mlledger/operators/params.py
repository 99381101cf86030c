"""Training parameters that arrive as text."""

from __future__ import annotations

import contextlib
import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlledger.functions.jsontext import with_literal_type

# Parameters of the runner, which the learner does not get.
RUNNER_KEYS = ["seed", "num_boost_round", "early_stopping_rounds"]
# Defaults of the learner and the runner. A depth of -1 follows from the leaves.
DEFAULTS = {
    "learning_rate": 0.05,
    "num_leaves": 63,
    "feature_fraction": 0.9,
    "bagging_fraction": 0.9,
    "bagging_freq": 5,
    "min_data_in_leaf": 20,
    "max_bin": 255,
    "max_depth": -1,
    "min_gain_to_split": 0.0,
}
DEFAULT_ROUNDS = 2000
DEFAULT_PATIENCE = 50
# JSON in its strict form has no such numbers, but parameter texts do.
_EXTRA_NUMBERS = ["NaN", "Infinity", "-Infinity"]


def typed_params(params: DataFrame, column: str = "params") -> DataFrame:
    """Explode a map<string,string> of parameters into key, type, value.

    A text that is a JSON literal gets that literal's type and value; any other text stays text.
    """
    others = [c for c in params.columns if c != column]
    flat = params.select(*others, F.explode(column).alias("key", "text"))
    parsed = with_literal_type(flat.withColumn("parsed", F.try_parse_json("text")), "parsed")
    kind = F.when(F.col("text").isin(_EXTRA_NUMBERS), "float").otherwise(
        F.coalesce("type", F.lit("text"))
    )
    value = F.when(F.col("type") == "text", F.col("parsed").cast("string")).otherwise(
        F.col("text")
    )
    return parsed.select(*others, "key", kind.alias("type"), value.alias("value"))


def runner_params(params: Column | str) -> Column:
    return F.map_filter(params, lambda k, v: k.isin(RUNNER_KEYS))


def override_params(params: Column | str) -> Column:
    return F.map_filter(params, lambda k, v: ~k.isin(RUNNER_KEYS))


def merged_params(defaults: Column, overrides: Column) -> Column:
    """Shallow merge in which the override wins, without a session setting for duplicate keys."""
    kept = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(overrides, k))
    return F.map_concat(kept, overrides)


def literal(text: Any) -> Any:
    """The value that a parameter text stands for, by the rule of `typed_params`: that of a JSON
    literal (with the extra numbers), else the text itself. Other values are taken as they are."""
    if not isinstance(text, str):
        return text
    with contextlib.suppress(ValueError):
        return json.loads(text)
    return text


@dataclass(frozen=True)
class Settings:
    """What a training job was asked for: the runner's own values, and checked learner settings."""

    seed: int
    rounds: int
    patience: int
    learner: dict[str, Any]
    given: dict[str, Any]

    @classmethod
    def of(cls, texts: dict[str, Any], seed: int) -> Settings:
        """A setting that the learner doesn't know is an error, as it would change nothing."""
        given = {name: literal(text) for name, text in texts.items()}
        runner = {"seed": seed, "num_boost_round": DEFAULT_ROUNDS}
        runner["early_stopping_rounds"] = DEFAULT_PATIENCE
        learner = dict(DEFAULTS)
        for name, value in given.items():
            if name in runner:
                runner[name] = int(value)
            elif name in DEFAULTS:
                learner[name] = value
            else:
                raise ValueError(f"the learner has no parameter {name}")
        return cls(*(runner[name] for name in RUNNER_KEYS), learner, given)
