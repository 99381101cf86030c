from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mlledger.functions import classify
from mlledger.schemas import uuid_shaped
from mlledger.sources.exports import resource_count


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("message", "expected"),
    [
        ("AccessDenied: no right to pass the role", "iam"),
        ("ResourceExhausted: quota exceeded", "quota"),
        ("ConnectionError: connection timeout", "network"),
        ("ModuleNotFoundError: no module named x", "package"),
        ("manifest unknown: image not found", "container"),
        ("column med_inc missing from schema", "data"),
        ("THROTTLING", "quota"),
        ("denied by network policy", "iam"),
        ("something unexpected", "sdk"),
        ("", "sdk"),
        (None, "sdk"),
    ],
)
def test_failure_class(spark, message, expected):
    df = spark.createDataFrame([(message,)], "text string")
    assert classify.with_failure_class(df, "text").first().failure_class == expected


def test_missing_word_lists_stay_apart(spark):
    gone = F.lit("Object does not exist")
    assert value(spark, classify.missing_object(gone))
    assert value(spark, classify.missing_in_sdk(gone))
    assert not value(spark, classify.parent_absent(gone))
    group = F.lit("(ResourceGroupNotFound) the group is gone")
    assert value(spark, classify.parent_absent(group))
    assert not value(spark, classify.missing_object(group))
    code = F.lit("HTTP 404")
    assert value(spark, classify.missing_in_sdk(code))
    assert not value(spark, classify.missing_object(code))
    denied = F.lit("permission denied")
    for predicate in (classify.missing_object, classify.missing_in_sdk, classify.parent_absent):
        assert not value(spark, predicate(denied))


@pytest.mark.parametrize(
    ("code", "status", "kind"),
    [(0, "success", "none"), (1, "failure", "sdk"), (2, "failure", "data"),
     (137, "failure", "container")],
)
def test_exit_codes(spark, code, status, kind):
    assert value(spark, classify.exit_status(F.lit(code))) == status
    assert value(spark, classify.exit_failure_class(F.lit(code))) == kind


def test_excerpt_is_bounded_and_null_on_success(spark):
    long = classify.error_text(F.lit("E"), F.lit("x" * 3000))
    assert len(value(spark, classify.error_excerpt(long, F.lit("failure")))) == 2000
    assert value(spark, classify.error_excerpt(long, F.lit("success"))) is None


def test_lab_names_ignore_case_and_look_at_the_database(spark):
    assert value(spark, classify.in_lab("abc", F.lit("X_ABC_1")))
    assert value(spark, classify.in_lab("abc", F.lit("code"), F.lit("ABC_DEV")))
    assert not value(spark, classify.in_lab("abc", F.lit("other"), F.lit(None).cast("string")))


@pytest.mark.parametrize(
    ("output", "action", "expected"),
    [
        ("ok\nApply complete! Resources: 12 added, 0 changed, 0 destroyed.", "apply", 12),
        ("Destroy complete! Resources: 12 destroyed.", "destroy", 12),
        ("Apply complete! Resources: 0 added, 0 changed, 2 destroyed.", "destroy", 2),
        ("Destroy complete! Resources: 3 destroyed.", "apply", 3),
        ("Error: quota exceeded", "apply", None),
    ],
)
def test_resource_count(spark, output, action, expected):
    assert value(spark, resource_count(F.lit(output), F.lit(action))) == expected


def test_uuid_shape(spark):
    assert value(spark, uuid_shaped(F.lit("11111111-1111-1111-1111-111111111111")))
    assert not value(spark, uuid_shaped(F.lit("run-1")))
