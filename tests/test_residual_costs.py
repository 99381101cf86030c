from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from mlledger.functions.jsontext import array_size
from mlledger.operators import costs, residual
from mlledger.schemas import INVENTORY_SCHEMA, PLATFORMS
from mlledger.sources.exports import COST_EXPORTS, read_inventory, read_transcripts
from tests.conftest import as_dicts
from workload import queries

LAB = "lab1"


def inventory(spark, *rows):
    names = [f.name for f in INVENTORY_SCHEMA.fields]
    return spark.createDataFrame(
        [tuple(r.get(n) for n in names) for r in rows], INVENTORY_SCHEMA
    )


def objects(spark, *rows):
    return spark.createDataFrame(list(rows), "platform string, name string")


def found(spark, rows, held=()):
    checked = residual.judged(inventory(spark, *rows), objects(spark, *held), LAB)
    return {
        (r.platform, r.kind): r
        for r in residual.findings(checked).collect()
        if r.kind != "fail_safe"
    }


def row(platform, kind, name=None, **more):
    return {"platform": platform, "kind": kind, "name": name, **more}


def test_own_endpoint_fails_and_foreign_ones_do_not_count(spark):
    rows = [
        row("vertex", "vertex_endpoint", "x-lab1-a"),
        row("vertex", "vertex_endpoint", "other"),
        row("sagemaker", "sagemaker_endpoint", "other"),
        row("vertex", "not_checked", "lab1"),
    ]
    result = found(spark, rows)
    assert list(result) == [("vertex", "vertex_endpoint")]
    only = result["vertex", "vertex_endpoint"]
    assert (only.severity, only.item_count, only.note) == ("FAIL", 1, None)


def test_empty_bucket_is_no_residue(spark):
    rows = [row("vertex", "gcs_object", "lab1-full"), row("vertex", "gcs_object", "lab1-empty"),
            row("sagemaker", "s3_object", "lab1-empty")]
    held = [("vertex", "lab1-full"), ("vertex", "lab1-full"), ("vertex", "foreign")]
    result = found(spark, rows, held)
    assert [(k, r.item_count, r.severity) for k, r in result.items()] == [
        (("vertex", "gcs_object"), 1, "WARN")
    ]
    checked = residual.judged(inventory(spark, *rows), objects(spark, *held), LAB)
    assert residual.items(checked).first().item == "gs://lab1-full"


def test_unreadable_listing_is_an_error_not_silence(spark):
    rows = [
        row("vertex", "vertex_endpoint", error_text="PermissionDenied: 403"),
        row("azureml", "online_endpoint", error_text="(ResourceGroupNotFound) gone"),
        row("azureml", "registered_model", error_text="(ParentResourceNotFound) gone"),
        row("databricks", "uc_volume", error_text="Catalog does not exist"),
        row("databricks", "serving_endpoint", error_text="Catalog does not exist"),
    ]
    result = found(spark, rows)
    assert set(result) == {("vertex", "vertex_endpoint"), ("databricks", "serving_endpoint")}
    broken = result["vertex", "vertex_endpoint"]
    assert (broken.severity, broken.item_count) == ("ERROR", 0)
    assert broken.note == "PermissionDenied: 403"


def test_state_database_name_and_upper_case(spark):
    rows = [
        row("snowflake", "warehouse_running", "LAB1_WH", state="STARTED"),
        row("snowflake", "warehouse_running", "LAB1_WH2", state="SUSPENDED"),
        row("snowflake", "stage_file", "CODE", database_name="LAB1_DEV"),
        row("snowflake", "stage_file", "BLOBS", database_name="OTHER"),
    ]
    result = found(spark, rows)
    assert result["snowflake", "warehouse_running"].item_count == 1
    assert result["snowflake", "stage_file"].item_count == 1


def test_experiment_runs_follow_the_name_of_their_experiment(spark):
    rows = [
        row("vertex", "experiment_run", "run-1", parent="lab1-exp"),
        row("vertex", "experiment_run", "lab1-run", parent="other"),
    ]
    checked = residual.judged(inventory(spark, *rows), objects(spark), LAB)
    assert [r.item for r in residual.items(checked).collect()] == ["lab1-exp/run-1"]


def test_versions_and_displayed_names(spark):
    rows = [
        row("vertex", "registered_model", "7", display_name="lab1-m", version="1"),
        row("vertex", "registered_model", "7", display_name="lab1-m", version="2"),
        row("vertex", "registered_model", "lab1-x", display_name="other", version="1"),
        row("vertex", "vertex_endpoint", "projects/1/9", display_name="lab1-e"),
        row("vertex", "vertex_endpoint", "projects/lab1/8", display_name=""),
    ]
    checked = residual.judged(inventory(spark, *rows), objects(spark), LAB)
    assert {r.item for r in residual.items(checked).collect()} == {
        "lab1-m:1", "lab1-m:2", "projects/1/9", "projects/lab1/8",
    }


def test_unnamed_kinds_count_without_the_prefix(spark):
    rows = [row("azureml", "key_vault_soft_deleted", "kv"), row("databricks", "uc_volume", "v")]
    result = found(spark, rows)
    assert result["azureml", "key_vault_soft_deleted"].severity == "FAIL"
    assert result["databricks", "uc_volume"].severity == "WARN"


def events(spark, rows, checked=PLATFORMS):
    judged = residual.judged(inventory(spark, *rows), objects(spark), LAB)
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return residual.infra_events(residual.findings(judged, checked), "c1", at, checked)


def test_clean_platform_still_gets_a_row(spark):
    recorded = events(spark, [row("vertex", "vertex_endpoint", "lab1")])
    rows = {r.platform: r for r in recorded.collect()}
    assert len(rows) == 5
    assert rows["vertex"].status == "failure" and rows["azureml"].status == "success"
    assert json.loads(rows["azureml"].residual_resources) == {"findings": []}
    entry = json.loads(rows["vertex"].residual_resources)["findings"][0]
    assert (entry["item_count"], entry["severity"]) == (1, "FAIL")
    sizes = recorded.select("platform", array_size("residual_resources", "findings").alias("n"))
    assert {r.platform: r.n for r in sizes.collect()}["snowflake"] == 1
    again = events(spark, [row("vertex", "vertex_endpoint", "lab1")])
    assert {r.event_id for r in again.collect()} == {r.event_id for r in rows.values()}


def test_unchecked_platforms_are_not_called_clean(spark):
    rows = [row("vertex", "vertex_endpoint", "lab1")]
    assert {r.platform for r in events(spark, rows, ["vertex"]).collect()} == {"vertex"}
    judged = residual.judged(inventory(spark, *rows), objects(spark), LAB)
    checked = ["vertex", "azureml"]
    report = residual.summary(residual.findings(judged, checked), checked).collect()
    assert {r.platform: r.findings for r in report} == {"vertex": 1, "azureml": 0}


def test_error_blocks_but_does_not_fail_the_event(spark):
    checked = residual.judged(
        inventory(spark, row("vertex", "vertex_endpoint", error_text="boom")), objects(spark), LAB
    )
    rows = {r.platform: r for r in residual.summary(residual.findings(checked)).collect()}
    assert (rows["vertex"].status, rows["vertex"].blocking) == ("success", True)
    assert (rows["snowflake"].findings, rows["snowflake"].blocking) == (1, False)


@pytest.mark.parametrize("many", [95, 400])
def test_all_items_are_kept_whatever_their_number(spark, many):
    rows = [row("azureml", "online_endpoint", f"e{i}") for i in range(many)]
    rows += [row("azureml", "registered_model", "m")] * 2
    checked = residual.judged(inventory(spark, *rows), objects(spark), LAB)
    items = residual.items(checked)
    paged = as_dicts(residual.item_pages(items, 10))
    long = [i for p in paged if p["kind"] == "online_endpoint" for i in p["items"]]
    assert sorted(long) == sorted(f"e{i}" for i in range(many))
    assert max(len(p["items"]) for p in paged) < 30
    pages = residual.item_pages(items, 10)
    report = residual.report_lines(residual.findings(checked), pages).collect()
    lines = {r.kind: r.line for r in report}
    assert lines["registered_model"] == "[WARN] azureml/registered_model: m:? (2 times)"
    assert lines["fail_safe"].startswith("[WARN] snowflake/fail_safe: 7 days  # ")
    listed = [r.line.split(": ")[1].split(", ") for r in report if r.kind == "online_endpoint"]
    assert sorted(sum(listed, [])) == sorted(long)
    event = {r.event_id for r in residual.event_items(pages, "c1").collect()}
    assert event <= {r.event_id for r in events(spark, rows).collect()}


def test_orphans(spark):
    seen = inventory(spark, row("vertex", "k", "a"), row("vertex", "k", "b"))
    known = inventory(spark, row("vertex", "k", "a"), row("azureml", "k", "b"))
    assert [r.name for r in residual.orphans(seen, known).collect()] == ["b"]


def test_inventory_and_transcript_files(spark, tmp_path):
    (tmp_path / "inv.json").write_text(json.dumps(row("vertex", "k", "a")) + "\n")
    assert read_inventory(spark, str(tmp_path / "inv.json")).first().name == "a"
    (tmp_path / "logs" / "gcp").mkdir(parents=True)
    done = "a\nApply complete! Resources: 4 added, 0 changed, 0 destroyed.\n"
    (tmp_path / "logs" / "gcp" / "apply.log").write_text(done)
    (tmp_path / "logs" / "gcp" / "destroy.log").write_text("Error\n")
    logs = read_transcripts(spark, str(tmp_path / "logs"))
    counts = {(r.env, r.action): r.resource_count for r in logs.collect()}
    assert counts == {("gcp", "apply"): 4, ("gcp", "destroy"): None}


def test_a_log_may_be_a_folder_of_parts_in_order(spark, tmp_path):
    log = tmp_path / "logs" / "gcp" / "destroy.log"
    log.mkdir(parents=True)
    done = "Destroy complete! Resources: {} destroyed.\n"
    for i, text in enumerate(["a\n", "b\n" + done.format(7), done.format(9)]):
        (log / f"part-0000{i}-u.c000.txt").write_text(text)
    (tmp_path / "logs" / "gcp" / "part-00000-u.c000.txt").write_text(done.format(1))  # no log
    logs = read_transcripts(spark, str(tmp_path / "logs"))
    assert [tuple(r) for r in logs.collect()] == [("gcp", "destroy", 7)]


def test_transcripts_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    events = spark.range(4000).select(
        F.col("id").alias("event_id"),
        (F.col("id") * 5).alias("user_id"),
        F.when(F.col("id") < 100, "error").otherwise("view").alias("event_type"),
        F.lit(20.0).alias("value"),
        F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id")).alias("ts"),
        F.concat(F.lit('{"k": '), F.col("id") % 97 * 4 + 1, F.lit("}")).alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(queries, "fresh_folder", lambda spark, name: str(tmp_path / name))
    adaptive = "spark.sql.adaptive.enabled"
    before = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")  # else small parts are joined up
    try:
        logs = queries.transcript_files(spark, str(tmp_path))
    finally:
        spark.conf.set(adaptive, before)
    # the latest of the ids has the earliest time
    assert sorted(map(tuple, logs.collect())) == [
        ("vertex", "apply", 3999 % 97 * 4 + 1), ("vertex", "destroy", 99 % 97 * 4 + 1)
    ]
    parts = list((tmp_path / "logs" / "vertex" / "apply.log").glob("part-*.txt"))
    assert len(parts) > 2
    assert sum(len(p.read_text().splitlines()) for p in parts) == 3900


def write_exports(folder):
    nested = {
        "ResultsByTime": [
            {
                "TimePeriod": {"Start": "2026-01-02", "End": "2026-01-03"},
                "Groups": [
                    {"Keys": [k], "Metrics": {"UnblendedCost": {"Amount": a}}}
                    for k, a in [("A", "1.23456789"), ("B", "0"), ("C", "-1")]
                ],
            }
        ]
    }
    lines = {
        "sagemaker": [nested],
        "databricks": [
            {"usage_date": d, "sku_name": "J", "usage_quantity": q}
            for d, q in [("2026-01-02", 1.5), ("2026-01-02", 2.0), ("2026-01-08", 9.0)]
        ],
        "snowflake": [
            {"start_time": "2026-01-02T23:00:00Z", "warehouse_name": "W", "credits_used": 1.5}
        ],
        "vertex": [
            {"usage_start_time": f"2026-01-02T0{h}:00:00Z", "service": {"description": "S"},
             "cost": 0.25} for h in (1, 2)
        ],
    }
    paths = {}
    for platform, rows in lines.items():
        path = folder / f"{platform}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        paths[platform] = str(path)
    return {**paths, "azureml": str(folder / "absent.json")}


def test_cost_exports(spark, tmp_path):
    paths = write_exports(tmp_path)
    assert set(paths) == set(COST_EXPORTS)
    rows, problems = costs.collect_costs(spark, paths, "2026-01-08", 7, price_usd="3.0")
    got = {(r.platform, r.service): (str(r.usage_date), float(r.amount_usd), r.unit)
           for r in rows.collect()}
    day = "2026-01-02"
    assert got == {
        ("sagemaker", "A"): (day, 1.234568, "usd"),
        ("databricks", "dbu:J"): (day, 3.5, "dbu"),
        ("snowflake", "warehouse:W"): (day, 4.5, "usd"),
        ("vertex", "S"): (day, 0.5, "usd"),
    }
    assert list(problems) == ["azureml"]
    missing = {r.platform: r.reason for r in costs.unavailable_sources(rows, problems).collect()}
    assert list(missing) == ["azureml"] and missing["azureml"] == problems["azureml"]


def test_malformed_export_does_not_stop_the_others(spark, tmp_path):
    paths = write_exports(tmp_path)
    bad = tmp_path / "sagemaker.json"
    bad.write_text(bad.read_text().replace("1.23456789", "not a number"))
    rows, problems = costs.collect_costs(spark, paths, "2026-01-08", 7, price_usd="3.0")
    assert set(problems) == {"azureml", "sagemaker"}
    assert {r.platform for r in rows.collect()} == {"databricks", "snowflake", "vertex"}
    nothing = {"azureml": str(tmp_path / "absent.json")}
    assert costs.collect_costs(spark, nothing, "2026-01-08", 7, price_usd="3.0")[0] is None


def test_broken_lines_of_an_export_are_a_problem(spark, tmp_path):
    paths = write_exports(tmp_path)
    for platform, bad in (("databricks", "{oops"), ("snowflake", '{"credits_used": "abc"}')):
        with open(paths[platform], "a") as lines:
            lines.write("\n" + bad)
    rows, problems = costs.collect_costs(spark, paths, "2026-01-08", 7, price_usd="3.0")
    assert set(problems) == {"azureml", "databricks", "snowflake"}
    assert {r.platform for r in rows.collect()} == {"sagemaker", "vertex"}


def test_window_is_half_open(spark):
    days = [("2025-12-31",), ("2026-01-01",), ("2026-01-07",), ("2026-01-08",)]
    df = spark.createDataFrame(days, "d string").select(F.col("d").cast("date").alias("d"))
    kept = df.filter(costs.trailing_window(F.col("d"), "2026-01-08", 7)).collect()
    assert [str(r.d) for r in kept] == ["2026-01-01", "2026-01-07"]
