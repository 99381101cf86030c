"""Column expressions that turn error texts and exit codes into ledger values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that decide the failure class, first class wins.
FAILURE_WORDS = {
    "iam": ["permission", "denied", "forbidden", "unauthorized", "accessdenied", "403"],
    "quota": ["quota", "limit exceeded", "resourceexhausted", "throttl", "429"],
    "network": ["network", "timeout", "unreachable", "connection", "dns", "egress"],
    "package": ["modulenotfound", "importerror", "no matching distribution", "wheel"],
    "container": ["image", "manifest unknown", "pull", "exec format", "oom"],
    "data": ["column", "schema", "dtype", "empty", "null", "contract"],
}
UNKNOWN_FAILURE = "sdk"

# Three separate word lists for "the thing is gone". They differ on purpose.
MISSING_OBJECT_WORDS = ["does not exist", "not found", "no such", "resource_does_not_exist"]
PARENT_ABSENT_WORDS = ["resourcegroupnotfound", "parentresourcenotfound"]
MISSING_SDK_WORDS = [
    "not found",
    "notfound",
    "does not exist",
    "resource_does_not_exist",
    "validationexception",
    "resourcenotfound",
    "404",
]

EXCERPT_CHARS = 2000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_any(lowered: Column | str, words: list[str]) -> Column:
    """Whether an already lower-cased text contains one of the words."""
    text = _col(lowered)
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def failure_class_of(lowered: Column | str) -> Column:
    """Failure class of an already lower-cased error text; never null."""
    text = F.coalesce(_col(lowered), F.lit(""))
    hits = [F.when(contains_any(text, words), F.lit(n)) for n, words in FAILURE_WORDS.items()]
    return F.coalesce(*hits, F.lit(UNKNOWN_FAILURE))


def with_failure_class(df: DataFrame, text: str, out: str = "failure_class") -> DataFrame:
    """Add the failure class of an error text, lower-casing each text once."""
    lowered = df.withColumn("_lowered", F.lower(text))
    return lowered.withColumn(out, failure_class_of("_lowered")).drop("_lowered")


def missing_object(text: Column | str) -> Column:
    return contains_any(F.lower(_col(text)), MISSING_OBJECT_WORDS)


def parent_absent(text: Column | str) -> Column:
    return contains_any(F.lower(_col(text)), PARENT_ABSENT_WORDS)


def missing_in_sdk(text: Column | str) -> Column:
    return contains_any(F.lower(_col(text)), MISSING_SDK_WORDS)


def error_text(error_type: Column | str, message: Column | str) -> Column:
    return F.concat_ws(": ", _col(error_type), F.coalesce(_col(message), F.lit("")))


def error_excerpt(text: Column | str, status: Column | str) -> Column:
    """The first characters of the error, and null on success."""
    return F.when(_col(status) == "failure", F.substring(_col(text), 1, EXCERPT_CHARS))


def exit_status(exit_code: Column | str) -> Column:
    """A job that reports no exit code ended normally."""
    code = F.coalesce(_col(exit_code), F.lit(0))
    return F.when(code == 0, F.lit("success")).otherwise(F.lit("failure"))


def exit_failure_class(exit_code: Column | str) -> Column:
    """Exit codes: 0 worked, 1 training failed, 2 bad input, the rest died with the container."""
    code = F.coalesce(_col(exit_code), F.lit(0))
    return (
        F.when(code == 0, F.lit("none"))
        .when(code == 1, F.lit("sdk"))
        .when(code == 2, F.lit("data"))
        .otherwise(F.lit("container"))
    )


def in_lab(prefix: str, *names: Column | str) -> Column:
    """Whether any of the names contains the lab's prefix, whatever the case."""
    wanted = prefix.lower()
    hits = [F.coalesce(F.lower(_col(n)).contains(wanted), F.lit(False)) for n in names]
    return reduce(lambda a, b: a | b, hits)
