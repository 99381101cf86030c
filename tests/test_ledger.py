from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from mlledger.operators import checks, ledger
from mlledger.plans import comparison
from mlledger.schemas import HOUSING_SCHEMA, RUN_SCHEMA
from mlledger.sinks import tables as sinks
from mlledger.sinks.files import write_file
from mlledger.sources import ledger_files
from mlledger.streaming import collect
from tests.conftest import as_dicts


def test_insert_is_idempotent(spark, make_runs, tmp_path):
    path = str(tmp_path / "runs")
    sinks.create_table(spark, path, RUN_SCHEMA)
    batch = make_runs({"run_id": "a"}, {"run_id": "b"}, {"run_id": "a", "attempt": 9})
    order = [F.col("attempt")]
    assert sinks.append_absent(batch, path, "run_id", RUN_SCHEMA, order) == 2
    assert sinks.append_absent(batch, path, "run_id", RUN_SCHEMA, order) == 0
    more = make_runs({"run_id": "b"}, {"run_id": "c"})
    assert sinks.append_absent(more, path, "run_id", RUN_SCHEMA, order) == 1
    stored = {r.run_id: r.attempt for r in spark.read.parquet(path).collect()}
    assert stored == {"a": 1, "b": 1, "c": 1}


def test_bulk_load_counts_and_refuses_an_empty_table(spark, sample, tmp_path):
    path = str(tmp_path / "housing")
    with pytest.raises(ValueError, match="empty"):
        sinks.load_housing(spark.createDataFrame([], HOUSING_SCHEMA), path, "test")
    first = sinks.load_housing(sample.limit(150), path, "test")
    assert first == {"fetched": 150, "inserted": 150, "skipped": 0, "total": 150}
    again = sinks.load_housing(sample, path, "test")
    assert again["inserted"] + again["skipped"] == 200 and again["total"] == 200
    assert sinks.load_housing(sample, path, "test")["inserted"] == 0


def test_export_writes_checksums_and_refuses_zero_rows(spark, sample, tmp_path):
    path = str(tmp_path / "data.parquet")
    mark = sinks.export_dataset(sample.coalesce(1), path).first()
    assert mark.rows == 200
    line = spark.read.text(f"{path}.sha256").first().value
    assert len(line.split("  ")[0]) == 64
    with pytest.raises(ValueError, match="nothing"):
        sinks.export_dataset(sample.limit(0), str(tmp_path / "none"))


def test_lines_round_trip(spark, make_runs, tmp_path):
    runs = make_runs({"run_id": "a", "metrics": '{"rmse": 0.5}', "params": '{"n": {"x": 1}}'})
    sinks.append_lines(runs, str(tmp_path / "deep" / "er"))
    texts = [f.read_text() for f in (tmp_path / "deep" / "er").glob("part-*.json")]
    record = json.loads("".join(texts))
    assert record["write_path"] == "collected" and record["metrics"] == {"rmse": 0.5}
    assert "created_at" not in record
    back = ledger_files.good_lines(ledger_files.read_lines(spark, str(tmp_path))).first()
    assert json.loads(back.params) == {"n": {"x": 1}}


def line(**fields):
    base = {
        "run_id": "r",
        "platform": "vertex",
        "tier": "A",
        "unification_unit": "container",
        "stage": "train",
        "status": "success",
        "code_revision": "a" * 40,
        "write_path": "collected",
    }
    return json.dumps({**base, **fields})


def write_fallback(folder, *lines):
    folder.mkdir(parents=True)
    (folder / "ml_runs.jsonl").write_text("\n".join(lines) + "\n")


def test_fallback_lines_get_defaults_and_blank_lines_are_skipped(spark, tmp_path):
    write_fallback(tmp_path / "x" / "y", line(), "", "  ", line(run_id="s", metrics=None))
    (tmp_path / "x" / "run.json").write_text("{}")
    rows = as_dicts(ledger_files.good_lines(ledger_files.read_lines(spark, str(tmp_path))))
    assert {r["run_id"] for r in rows} == {"r", "s"}
    assert all(r["attempt"] == 1 and r["metrics"] == "{}" and r["params"] == "{}" for r in rows)


def test_bad_lines_are_kept_with_their_reason(spark, tmp_path):
    write_fallback(
        tmp_path / "x", line(), line(run_id="p", platform="mars"), "{oops", line(stage=None)
    )
    lines = ledger_files.read_lines(spark, str(tmp_path)).persist()
    problems = sorted(r.problem for r in ledger_files.rejected_lines(lines).collect())
    assert problems == ["json", "platform", "stage"]


def test_batch_collect_says_what_became_of_every_line(spark, tmp_path):
    write_fallback(
        tmp_path / "x", line(run_id="1"), line(run_id="1"), line(run_id="p", platform="mars"), "{oops"
    )
    lines = ledger_files.read_lines(spark, str(tmp_path / "x"))
    target, rejects = str(tmp_path / "ledger"), str(tmp_path / "rejects")
    assert collect.collect_batch(spark, lines, target, rejects) == (1, 1, 2)
    assert collect.collect_batch(spark, lines, target, rejects) == (0, 2, 2)
    assert {r.problem for r in spark.read.json(rejects).collect()} == {"json", "platform"}


def test_counters_count_a_run_once(spark, tmp_path):
    write_fallback(tmp_path / "a", line(run_id="1"), line(run_id="2"))
    write_fallback(tmp_path / "b", line(run_id="2"), line(run_id="1"))
    row = collect.counters(ledger_files.read_lines(spark, str(tmp_path))).first()
    assert (row.runs, row.next_attempt) == (2, 3)


def test_params_that_are_no_object_stay(spark, make_runs):
    runs = make_runs(
        {"run_id": "1", "params": "[1]"}, {"run_id": "2", "params": "{bad"}, {"run_id": "3"}
    )
    patches = spark.createDataFrame(
        [(r, '{"a": 1}', 1) for r in "123"] + [("3", '{"a": 2}', 1)],
        "run_id string, patch string, patch_no int",
    )
    merged = {r.run_id: r.params for r in ledger.merge_params(runs, patches).collect()}
    assert merged == {"1": "[1]", "2": "{bad", "3": '{"a":2}'}
    outcomes = {r.run_id: r.outcome for r in ledger.merge_outcomes(runs, patches).collect()}
    assert outcomes == {"1": "unreadable", "2": "unreadable", "3": "merged"}


def test_rows_without_stage_or_status_keep_their_owner(spark, make_runs):
    rows = make_runs({"run_id": "1", "stage": None}, {"run_id": "2", "status": None})
    kept = ledger.reconcile_ownership(rows.limit(0), rows)
    assert kept.count() == 2


def test_first_attempt_of_every_pair(make_runs):
    rows = ledger.next_attempts(make_runs({"run_id": "1"}, {"run_id": "2", "stage": "odd"})).collect()
    got = {(r.platform, r.stage): r.next_attempt for r in rows}
    assert len(got) == 26
    assert got["vertex", "train"] == 2 and got["vertex", "odd"] == 2
    assert got["azureml", "deploy"] == 1


def test_small_batch_shuffles_no_whole_ledger(spark, tmp_path):
    held = spark.range(200_000).select(F.col("id").cast("string").alias("run_id"), "id")
    held.write.parquet(str(tmp_path / "held"))
    held = spark.read.parquet(str(tmp_path / "held"))
    new = spark.createDataFrame([("5", 1), ("x", 2)], "run_id string, id long")
    absent = ledger.absent_rows(new, held, "run_id")
    assert [r.run_id for r in absent.collect()] == ["x"]
    plan = absent._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    semi = [p for p in plan.splitlines() if "LeftSemi" in p]
    assert semi and all("BroadcastHashJoin" in p for p in semi)


def test_friction_of_unlisted_platforms(make_runs):
    runs = make_runs(
        {"run_id": "1", "platform": "other", "status": "failure", "created_at": "2026-01-01 00:00:00"},
        {"run_id": "2", "platform": "other", "created_at": "2026-01-01 00:00:01"},
        {"run_id": "3", "stage": "tune"},
    )
    ways = [comparison.friction(runs), comparison.friction_by_window(runs)]
    one, two = [
        {(r.platform, r.stage): (r.attempts_until_success, r.recorded_failures) for r in w.collect()}
        for w in ways
    ]
    assert one == two == {("other", "train"): (2, 1), ("vertex", "tune"): (1, 0)}


def test_folder_without_fallback_files_is_an_error(spark, tmp_path):
    (tmp_path / "x").mkdir()
    with pytest.raises(FileNotFoundError):
        ledger_files.read_lines(spark, str(tmp_path))


def test_stream_collect_again_adds_nothing(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "ledger")
    write_fallback(source / "a", line(run_id="1"), line(run_id="2"))
    write_fallback(source / "b", line(run_id="2"), line(run_id="3"), "{oops")

    def run():
        query = collect.collect_stream(
            spark, str(source), target, str(tmp_path / "offsets"), str(tmp_path / "rejects"), 1
        )
        query.awaitTermination()
        return sorted(r.run_id for r in spark.read.parquet(target).collect())

    assert run() == ["1", "2", "3"]
    assert run() == ["1", "2", "3"]
    write_fallback(source / "c", line(run_id="4"), line(run_id="1"))
    assert run() == ["1", "2", "3", "4"]
    rejected = spark.read.json(str(tmp_path / "rejects"))
    assert rejected.filter("problem = 'json'").count() == 1
    # A new checkpoint replays all files; the ledger already has their runs.
    replay = collect.collect_stream(
        spark, str(source), target, str(tmp_path / "offsets2"), str(tmp_path / "rejects2")
    )
    replay.awaitTermination()
    assert spark.read.parquet(target).count() == 4
    assert {r.write_path for r in spark.read.parquet(target).collect()} == {"collected"}


def test_stream_counters_match_a_batch(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "counters")
    write_fallback(source / "a", line(run_id="1"), line(run_id="2", status="failure"))
    write_fallback(source / "b", line(run_id="3"), line(run_id="4", stage="deploy"))
    query = collect.counter_stream(spark, str(source), target, str(tmp_path / "offsets"), 1)
    query.awaitTermination()
    batch = collect.counters(ledger_files.read_lines(spark, str(source)))
    streamed = collect.current_counters(spark, target).select(*batch.columns)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_a_batch_reads_only_the_folders_of_its_keys(spark, make_runs, tmp_path):
    path, (schema, layout) = str(tmp_path / "runs"), sinks.TABLES["ml_runs"]
    sinks.create_table(spark, path, schema, layout)
    many = make_runs({"run_id": "a"}).drop("run_id").join(
        spark.range(2000).select(F.col("id").cast("string").alias("run_id"))
    )
    assert sinks.append_absent(many, path, "run_id", schema, None, layout) == 2000
    few = many.filter("run_id < '1002'").withColumn("attempt", F.lit(7))
    part = sinks.ledger_part(spark, path, schema, few, "run_id")
    files = part.select("_metadata.file_path").distinct().count()
    assert 0 < files <= few.count() < sinks.KEY_BUCKETS / 10
    assert "PartitionFilters: [key_bucket" in part._jdf.queryExecution().executedPlan().toString()
    new = few.unionByName(few.withColumn("run_id", F.concat(F.lit("new-"), "run_id")))
    assert sinks.append_absent(new, path, "run_id", schema, None, layout) == few.count()
    assert sinks.read_runs(spark, path).filter("attempt = 7").count() == few.count()


def test_two_writers_at_once_leave_one_run(spark, make_runs, tmp_path):
    path, (schema, layout) = str(tmp_path / "runs"), sinks.TABLES["ml_runs"]
    sinks.create_table(spark, path, schema, layout)
    ours = make_runs({"run_id": "a", "attempt": 1}, {"run_id": "b"})
    theirs = make_runs({"run_id": "a", "attempt": 2, "created_at": "2026-08-01 09:00:00"})
    # Both looked into the ledger before the other wrote.
    rows = [ledger.absent_rows(w, sinks.ledger_part(spark, path, schema, w, "run_id"), "run_id") for w in (ours, theirs)]
    kept = [spark.createDataFrame(r.collect(), r.schema) for r in rows]
    assert [r.count() for r in kept] == [2, 1]
    for r in kept:
        bucketed = r.withColumn(sinks.KEY_BUCKET, sinks.key_bucket("run_id"))
        bucketed.write.mode("append").partitionBy(*layout).parquet(path)
    assert {(r.run_id, r.attempt) for r in sinks.read_runs(spark, path).collect()} == {("a", 2), ("b", 1)}


def test_a_patch_reaches_only_runs_that_were_there(spark, make_runs, tmp_path):
    path = str(tmp_path / "patches")
    early = make_runs({"run_id": "a", "params": '{"x": 1}'})
    late = early.unionByName(make_runs({"run_id": "b", "params": '{"x": 1}', "write_path": "collected"}))
    patches = spark.createDataFrame([("a", '{"x": 2}'), ("b", '{"x": 2}')], "run_id string, patch string")
    assert [r.run_id for r in sinks.append_patches(patches, early, path, 1).collect()] == ["a"]
    # Delivering the number again, when the other run has come, changes nothing.
    assert [r.run_id for r in sinks.append_patches(patches, late, path, 1).collect()] == ["a"]
    read = {r.run_id: json.loads(r.params)["x"] for r in sinks.patched_runs(late, path).collect()}
    assert read == {"a": 2, "b": 1}
    sinks.append_patches(patches, late, path, 2)
    read = {r.run_id: json.loads(r.params)["x"] for r in sinks.patched_runs(late, path).collect()}
    assert read == {"a": 2, "b": 2}


@pytest.mark.parametrize("where", ["append_absent", "refused_lines", "increments"])
def test_a_delivery_that_failed_counts_once(spark, tmp_path, monkeypatch, where):
    write_fallback(tmp_path / "in", line(run_id="1"), line(run_id="2", status="failure"), line(run_id="1"), "{oops")
    lines = ledger_files.read_lines(spark, str(tmp_path / "in"))
    folders = [str(tmp_path / n) for n in ("ledger", "work", "rejects", "counts")]
    sinks.create_table(spark, folders[0], collect.SCHEMA, collect.PARTITIONS)
    with monkeypatch.context() as patched:
        patched.setattr(collect, where, lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            collect.ingest(lines, *folders)
    assert collect.ingest(lines, *folders) == (2, 1, 1)
    assert collect.ingest(lines, *folders) == (2, 1, 1)
    row = collect.current_counters(spark, folders[3]).first()
    assert (row.runs, row.failures, row.next_attempt) == (2, 1, 3)
    assert sinks.read_runs(spark, folders[0]).count() == 2
    assert spark.read.json(folders[2]).count() == 1


def test_stream_counters_keep_no_state(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "counts")
    write_fallback(source / "a", line(run_id="1"), line(run_id="2"))

    def run():
        query = collect.counter_stream(spark, str(source), target, str(tmp_path / "offsets"), 1)
        query.awaitTermination()
        return collect.current_counters(spark, target).first().runs

    assert run() == 2
    write_fallback(source / "b", line(run_id="2"), line(run_id="3", status="failure"))
    assert run() == 3
    assert not (tmp_path / "offsets" / "state").exists()


def cost_rows(spark, *rows):
    df = spark.createDataFrame(list(rows), "platform string, usage_date string, service string, amount_usd double")
    return df.withColumn("usage_date", F.col("usage_date").cast("date"))


def test_compaction_touches_only_changed_months(spark, tmp_path, monkeypatch):
    path, folder = str(tmp_path / "costs"), tmp_path / "costs"
    sinks.append_costs(
        cost_rows(
            spark, ("vertex", "2026-01-02", "a", 1.0), ("vertex", "2026-01-03", "a", 2.0),
            ("vertex", "2026-02-02", "a", 3.0), ("azureml", "2026-01-02", "a", 4.0), (None, None, "a", 5.0),
        ), path, 1,
    )
    late = cost_rows(spark, ("vertex", "2026-01-02", "a", 9.0), (None, None, "a", 6.0))
    sinks.append_costs(late, path, 2)
    wanted = {("vertex", 9.0), ("vertex", 2.0), ("vertex", 3.0), ("azureml", 4.0), (None, 6.0)}
    untouched = {p.name for p in folder.glob("platform=*/usage_month=*/*.parquet")} - {
        p.name for p in folder.glob("platform=vertex/usage_month=2026-01/*.parquet")
    } - {p.name for p in folder.glob("platform=__HIVE*/*/*.parquet")}
    assert len(untouched) == 2
    schema = sinks.TABLES["cost_snapshots"][0]

    def stored():
        return sorted(
            ((r.platform, float(r.amount_usd)) for r in spark.read.schema(schema).parquet(path).collect()), key=repr
        )

    with monkeypatch.context() as patched:
        # It dies when the resolved rows stand aside, before any folder is replaced.
        patched.setattr(sinks, "write_file", lambda *a: (write_file(*a), 1 / 0))
        with pytest.raises(ZeroDivisionError):
            sinks.compact_costs(spark, path)
    assert len(stored()) == 7
    assert sinks.compact_costs(spark, path) == 0  # the interrupted one has been ended
    assert stored() == sorted(wanted, key=repr)
    assert untouched <= {p.name for p in folder.glob("platform=*/usage_month=*/*.parquet")}
    assert not list(folder.glob("_re*"))
    sinks.append_costs(late, path, 3)
    assert sinks.compact_costs(spark, path) == 2
    assert stored() == sorted(wanted, key=repr)


def test_manifests_absent_broken_and_good(spark, tmp_path):
    good = {"run_id": "m", "code_revision": "b" * 40, "metrics": {"rmse": 0.4}, "params": {}}
    for name, text in {"a": json.dumps(good), "b": "{broken", "c": "[1]"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(text)
    manifests = ledger_files.read_manifests(spark, str(tmp_path))
    found = {r.output_dir.rsplit("/", 1)[1]: r for r in manifests.collect()}
    assert found["a"].run_id == "m" and json.loads(found["a"].metrics) == {"rmse": 0.4}
    assert found["b"].run_id is None and found["c"].run_id is None


def test_job_outcomes_become_runs(spark):
    jobs = spark.createDataFrame(
        [
            ("vertex", "d1", None, 0, 2, 1.5, None, "c" * 40),
            ("databricks", "d2", "given", 137, None, None, "killed", "c" * 40),
            ("vertex", "d3", None, 1, None, None, "boom", "c" * 40),
        ],
        "platform string, output_dir string, run_id string, exit_code int, attempt int, "
        "duration_seconds double, error_text string, code_revision string",
    )
    files = spark.createDataFrame(
        [("d1", '{"run_id": "m", "code_revision": "rev", "params": {"a": 1}}')],
        "output_dir string, value string",
    )
    rows = {
        r.error_excerpt: r
        for r in ledger.runs_from_jobs(jobs, ledger_files.parse_manifests(files)).collect()
    }
    ok, killed, lost = rows[None], rows["killed"], rows["boom"]
    assert (ok.run_id, ok.code_revision, ok.attempt, ok.failure_class) == ("m", "rev", 2, "none")
    assert (killed.run_id, killed.failure_class, killed.tier) == ("given", "container", "B")
    assert killed.attempt == 1 and killed.problem is None
    assert lost.problem == "run_id"


def test_direct_row_wins_over_its_collected_copy(make_runs):
    direct = make_runs({"run_id": "a", "attempt": 1})
    late = make_runs({"run_id": "a", "attempt": 2}, {"run_id": "b"})
    rows = {r.run_id: r for r in ledger.union_paths(direct, late).collect()}
    assert (rows["a"].write_path, rows["a"].attempt) == ("direct", 1)
    assert rows["b"].write_path == "collected"


def test_adapter_success_of_a_job_is_not_a_run(make_runs):
    job = make_runs({"run_id": "a"})
    adapter = make_runs(
        {"run_id": "a"},
        {"run_id": "b"},
        {"run_id": "c", "status": "failure"},
        {"run_id": "d", "stage": "deploy"},
    )
    kept = ledger.reconcile_ownership(job, adapter)
    assert sorted(r.run_id for r in kept.collect()) == ["a", "c", "d"]


def test_merge_params_updates_and_never_inserts(spark, make_runs):
    runs = make_runs(
        {"run_id": "a", "params": '{"x": 1, "deep": {"k": [1, 2]}, "y": "old"}'},
        {"run_id": "b", "params": None},
        {"run_id": "c", "params": '{"x": 1}', "write_path": "collected"},
    )
    patches = spark.createDataFrame(
        [
            ("a", '{"y": "mid", "z": null}', 1),
            ("a", '{"y": "new"}', 2),
            ("b", '{"q": true}', 1),
            ("c", '{"x": 2}', 1),
            ("gone", '{"x": 1}', 1),
            ("a", "{}", 3),
        ],
        "run_id string, patch string, patch_no int",
    )
    merged = {r.run_id: json.loads(r.params) for r in ledger.merge_params(runs, patches).collect()}
    assert merged["a"] == {"x": 1, "deep": {"k": [1, 2]}, "y": "new", "z": None}
    assert merged["b"] == {"q": True} and merged["c"] == {"x": 2} and len(merged) == 3
    direct = {r.run_id: json.loads(r.params) for r in ledger.handoff_merge(runs, patches).collect()}
    assert direct["c"] == {"x": 1} and direct["b"] == {"q": True}
    outcomes = {r.run_id: r.outcome for r in ledger.merge_outcomes(runs, patches).collect()}
    assert outcomes == {
        "a": "merged", "b": "merged", "c": "skipped_collected", "gone": "absent",
    }


def test_last_cost_delivery_wins(spark, tmp_path):
    path = str(tmp_path / "costs")
    schema = "platform string, usage_date string, service string, amount_usd double"
    one = [("vertex", "2026-01-01", "s", 1.0), ("vertex", "2026-01-02", "s", 5.0)]
    sinks.append_costs(spark.createDataFrame(one, schema), path, 1)
    sinks.append_costs(spark.createDataFrame([(*one[0][:3], 2.0)], schema), path, 2)
    stored = spark.read.parquet(path)
    rows = sinks.current_costs(stored).collect()
    current = {str(r.usage_date): float(r.amount_usd) for r in rows}
    assert current == {"2026-01-01": 2.0, "2026-01-02": 5.0}
    sinks.compact(sinks.current_costs(stored), str(tmp_path / "compact"), "platform")
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 2


def test_resume_points(spark, make_runs):
    key = "model_artifact_uri"
    runs = make_runs(
        {"run_id": "1", "params": json.dumps({key: "old"}), "created_at": "2026-01-01 00:00:00"},
        {"run_id": "2", "params": json.dumps({key: "new"}), "created_at": "2026-01-02 00:00:00"},
        {"run_id": "3", "params": "{}", "created_at": "2026-01-03 00:00:00"},
        {"run_id": "4", "params": json.dumps({key: "bad"}), "status": "failure",
         "created_at": "2026-01-04 00:00:00"},
    )
    point = ledger.latest_artifact(runs).first()
    assert (point.run_id, point.value) == ("2", "new")


def test_model_reference_prefers_the_earlier_key(make_runs):
    base = {"stage": "register"}
    runs = make_runs(
        {**base, "run_id": "1", "params": '{"model_version": 3}', "created_at": "2026-01-05"},
        {**base, "run_id": "2", "params": '{"model_resource_name": "m"}',
         "created_at": "2026-01-01"},
        {**base, "run_id": "3", "platform": "snowflake",
         "params": '{"model_resource_name": null, "model_version": "7"}'},
    )
    refs = {r.platform: r for r in ledger.latest_model_ref(runs).collect()}
    assert (refs["vertex"].run_id, refs["vertex"].value) == ("2", "m")
    assert (refs["snowflake"].key, refs["snowflake"].value) == ("model_version", "7")


def test_latest_version_skips_what_is_no_number(spark):
    df = spark.createDataFrame([("m", "9"), ("m", "10"), ("m", "x"), ("n", None)],
                               "model string, version string")
    rows = [tuple(r) for r in ledger.latest_version(df, "model").collect()]
    assert rows == [("m", 10)]


def test_revision_verdicts(spark):
    points = spark.createDataFrame([(r,) for r in ("now", "twin", "other", "lost")],
                                   "code_revision string")
    trees = spark.createDataFrame(
        [("now", "t"), ("twin", "t"), ("other", "u")], "code_revision string, tree_hash string"
    )

    def verdicts(known, current):
        rows = ledger.revision_verdicts(points, known, current).collect()
        return {r.code_revision: r.verdict for r in rows}

    assert verdicts(trees, "now") == {
        "now": "same_revision", "twin": "same_tree", "other": "different", "lost": "unknown",
    }
    nothing = trees.limit(0)
    assert set(verdicts(nothing, "now").values()) == {"same_revision", "unknown"}


def test_friction_forms_agree_and_never_succeeded_is_null(make_runs):
    at = "2026-01-01 00:00:0"
    runs = make_runs(
        {"run_id": "1", "stage": "deploy", "params": '{"action": "teardown"}',
         "created_at": at + "0"},
        {"run_id": "2", "stage": "deploy", "status": "failure", "created_at": at + "1"},
        {"run_id": "3", "stage": "deploy", "created_at": at + "2"},
        {"run_id": "4", "stage": "deploy", "status": "failure", "created_at": at + "2"},
        {"run_id": "5", "stage": "train", "status": "failure", "created_at": at + "3"},
    )
    quick = {r.stage: tuple(r)[2:] for r in comparison.friction(runs).collect()}
    window = {r.stage: tuple(r)[2:] for r in comparison.friction_by_window(runs).collect()}
    assert quick == window == {"deploy": (2, 2), "train": (None, 1)}


def test_duration_rounding_is_half_up_on_decimals(make_runs):
    runs = make_runs({"run_id": "1", "duration_seconds": 2.25})
    row = comparison.stage_durations(runs).first()
    assert (row.avg_seconds, row.max_seconds) == (2.3, 2.3)


def test_parity_counts_a_null_metric_as_a_platform(make_runs):
    runs = make_runs(
        {"run_id": "1", "metrics": '{"rmse": 0.5}'},
        {"run_id": "2", "platform": "azureml", "metrics": '{"rmse": null}'},
        {"run_id": "3", "platform": "snowflake", "metrics": '{"mae": 1}'},
    )
    row = comparison.metric_parity(runs).first()
    assert (row.platforms, row.distinct_rmse) == (2, 1)
    assert row.platform_list == "azureml,vertex"


def test_population_and_views(spark, make_runs):
    runs = make_runs(
        {"run_id": "1", "created_at": "2026-08-01 14:59:59"},
        {"run_id": "2", "created_at": "2026-08-01 15:00:00"},
    )
    assert [r.run_id for r in comparison.population(runs).collect()] == ["1"]
    infra = spark.createDataFrame([("e", "2026-08-02 00:00:00")], "event_id string, t string")
    infra = infra.select("event_id", F.col("t").cast("timestamp").alias("created_at"))
    comparison.register_populations(runs, infra)
    assert spark.sql("SELECT count(*) AS n FROM baseline_runs").first().n == 1
    assert spark.sql("SELECT count(*) AS n FROM baseline_infra_events").first().n == 0


def test_population_cutoff_is_utc_in_any_session_zone(spark, make_runs):
    runs = make_runs({"run_id": "1", "created_at": "2026-08-01 14:59:59"},
                     {"run_id": "2", "created_at": "2026-08-01 15:00:01"}).persist()
    assert runs.count() == 2
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert [r.run_id for r in comparison.population(runs).collect()] == ["1"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        runs.unpersist()


def test_reports_as_views_and_in_shown_order(spark, make_runs):
    from tests.conftest import SF
    from workload import standins

    runs, infra = standins.runs(spark, SF), standins.infra(spark, SF)
    names = comparison.register_reports(runs, infra, standins.CUTOFF)
    assert all(spark.table(n).count() > 0 for n in names)
    for name, keys in comparison.REPORT_ORDER.items():
        shown = comparison.ordered(spark.table(name), name).select(keys[0][0]).collect()
        assert [r[0] for r in shown] == sorted(r[0] for r in shown)


# Golden results of the five platforms.
GOLDEN = {"rmse": 0.4368055090296257, "mae": 0.2840129606543999, "r2": 0.8543973248910732}


def golden_runs(make_runs, **change):
    rows = []
    for platform, tier in [("vertex", "A"), ("sagemaker", "A"), ("azureml", "A"),
                           ("databricks", "B"), ("snowflake", "B")]:
        metrics = {**GOLDEN, **change} if platform == "azureml" else GOLDEN
        rows.append(
            {"run_id": platform, "platform": platform, "tier": tier,
             "metrics": json.dumps(metrics)}
        )
    return make_runs(*rows)


def test_golden_rows_are_in_tolerance(spark, make_runs, tmp_path):
    runs = golden_runs(make_runs)
    spread = checks.parity_spread(runs).first()
    assert (spread.platforms, spread.spread, spread.within_tolerance) == (5, 0.0, True)
    deviation = checks.parity_deviation(runs, GOLDEN["rmse"])
    assert deviation.filter("not within_tolerance").count() == 0
    assert {r.coverage for r in checks.platform_coverage(runs).collect()} == {"both"}
    sinks.write_golden(runs, "2026-08-01", "test", str(tmp_path / "g.json"))
    back = ledger_files.read_golden(spark, str(tmp_path / "g.json"))
    assert back.count() == 5 and back.agg(F.min("rmse")).first()[0] == GOLDEN["rmse"]


def test_a_drifting_platform_is_found(make_runs):
    runs = golden_runs(make_runs, rmse=GOLDEN["rmse"] + 2e-6)
    assert not checks.parity_spread(runs).first().within_tolerance
    bad = checks.parity_deviation(runs, GOLDEN["rmse"]).filter("not within_tolerance")
    assert [r.platform for r in bad.collect()] == ["azureml"]


def test_catalog_tables_and_views_for_sql_users(spark, make_runs, tmp_path):
    root = str(tmp_path / "tables")
    sinks.create_tables(spark, root)
    spark.sql("CREATE DATABASE IF NOT EXISTS lab_test")
    sinks.register_tables(spark, root, "lab_test")
    new = make_runs({"run_id": "a"}, {"run_id": "b", "platform": "azureml"})
    order = [F.col("attempt")]
    path = f"{root}/ml_runs"
    schema, layout = sinks.TABLES["ml_runs"]
    assert sinks.append_absent(new, path, "run_id", schema, order, layout) == 2
    assert sinks.append_absent(new, path, "run_id", schema, order, layout) == 0
    sinks.register_tables(spark, root, "lab_test")
    spark.sql("MSCK REPAIR TABLE lab_test.ml_runs")
    assert spark.table("lab_test.ml_runs").count() == 2
    assert spark.table("lab_test.ml_runs").filter("platform = 'azureml'").first().run_id == "b"
    sinks.drop_tables(spark, "lab_test")
    assert spark.read.parquet(path).count() == 2
