from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mlledger.operators import boosting, modeling, params, prep, trees
from mlledger.plans import mirror
from mlledger.plans import training
from mlledger.plans.training import TrainingConfig, run_training
from mlledger.schemas import FEATURES, ROW_ID, TARGET
from mlledger.sources import artifacts
from mlledger.sources.ledger_files import read_manifests

QUICK = {"num_boost_round": "5", "early_stopping_rounds": 3, "num_leaves": "7",
         "min_data_in_leaf": 5, "learning_rate": "0.3"}


@pytest.fixture(scope="module")
def trained(sample, tmp_path_factory):
    config = TrainingConfig(
        output_dir=str(tmp_path_factory.mktemp("job")),
        code_revision="a" * 40,
        params=QUICK,
        with_baseline=True,
        baseline_trees=10,
        baseline_depth=3,
    )
    return config, run_training(sample, config)


def test_model_learns_and_is_sane_against_the_baseline(trained):
    metrics = trained[1].metrics
    assert metrics["r2"] > 0.5
    assert 1 <= metrics["best_iteration"] <= 5
    assert modeling.baseline_is_sane(metrics)


def test_artifacts_hold_the_same_values(spark, trained):
    config, result = trained
    manifests = read_manifests(spark, config.output_dir).collect()
    assert [m.run_id for m in manifests] == [result.run_id]
    assert json.loads(manifests[0].metrics) == result.metrics
    text = spark.read.text(f"{config.output_dir}/run.json").first().value
    document = json.loads(text)
    assert document["run_id"] == result.run_id and document["metrics"] == result.metrics
    assert document["params"] == params.Settings.of(QUICK, 42).given
    assert (Path(config.output_dir) / "run.json").is_file()
    assert document["feature_schema"]["columns"] == FEATURES
    table = spark.read.csv(f"{config.output_dir}/feature_importance.csv", header=True)
    rows = table.collect()
    assert len(rows) == len(FEATURES)
    assert max(rows, key=lambda r: float(r.gain)).feature == "med_inc"


def test_saved_model_is_cut_at_the_best_round_and_predicts_the_same(spark, trained):
    config, result = trained
    loaded = trees.TreeModel.load(spark, f"{config.output_dir}/model")
    assert len(loaded.trees) == result.metrics["best_iteration"]
    one = result.scored.select(ROW_ID, *FEATURES, "prediction").withColumnRenamed("prediction", "p")
    gap = modeling.score(loaded, one).agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0]
    assert gap == 0.0


def small(**more):
    return {**params.DEFAULTS, "num_leaves": 7, "min_data_in_leaf": 5, "learning_rate": 0.3, **more}


def model_rows(spark, model):
    return sorted(map(tuple, model.nodes(spark).collect()))


def test_layout_of_the_input_does_not_change_the_model(spark, sample):
    data = prep.split(prep.gold(sample))
    one = boosting.boost(data, small(), rounds=2, patience=4)
    two = boosting.boost(data.repartition(7).orderBy(F.rand(5)), small(), rounds=2, patience=4)
    assert model_rows(spark, one.model) == model_rows(spark, two.model)
    assert one.losses == pytest.approx(two.losses)
    forests = [boosting.bagged_forest(d, n_trees=3) for d in (data, data.repartition(5))]
    assert model_rows(spark, forests[0]) == model_rows(spark, forests[1])


def grown(x, y, leaves, least):
    """Best-first growth by trying every cut of every leaf: (gains in order, mean of each row)."""
    groups, gains = [list(range(len(y)))], []
    while len(groups) < leaves:
        best = None
        for g, rows in enumerate(groups):
            for f in range(len(x[0])):
                values = sorted({x[i][f] for i in rows})
                for low in values[:-1]:
                    a = [i for i in rows if x[i][f] <= low]
                    b = [i for i in rows if x[i][f] > low]
                    if min(len(a), len(b)) < least:
                        continue
                    gain = sum(sum(y[i] for i in p) ** 2 / len(p) for p in (a, b))
                    gain -= sum(y[i] for i in rows) ** 2 / len(rows)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, g, a, b
        if best is None:
            break
        gains.append(best[0])
        groups[best[1] : best[1] + 1] = best[2:]
    mean = {i: sum(y[j] for j in rows) / len(rows) for rows in groups for i in rows}
    return gains, [mean[i] for i in range(len(y))]


@pytest.mark.parametrize("leaves,least", [(2, 20), (6, 5), (31, 3)])
def test_a_round_grows_best_first(sample, leaves, least):
    data = prep.split(prep.gold(sample))
    plain = small(num_leaves=leaves, min_data_in_leaf=least, learning_rate=1.0, feature_fraction=1.0, bagging_fraction=1.0)
    fitted = boosting.boost(data, plain, rounds=1, patience=1)
    rows = data.filter("split = 'train'").orderBy(ROW_ID).collect()
    x, y = [[r[c] for c in FEATURES] for r in rows], [r[TARGET] for r in rows]
    base = sum(y) / len(y)
    gains, means = grown(x, [v - base for v in y], leaves, least)
    tree = fitted.model.trees[0]
    assert sorted(g for g in tree.gain if g) == pytest.approx(sorted(gains), rel=1e-6)
    scored = modeling.score(fitted.model, data.filter("split = 'train'")).orderBy(ROW_ID).collect()
    assert [r.prediction for r in scored] == pytest.approx([base + m for m in means], abs=1e-6)


def test_many_values_share_bins(spark, sample):
    rows = sample.unionByName(sample.withColumn("med_inc", F.col("med_inc") + 0.001))
    edges = trees.bin_edges(rows, ["med_inc", "row_id"], 16, 42, 400)
    assert [len(e) for e in edges] == [15, 15]
    flat = sample.withColumn("med_inc", F.lit(1.0))
    binned = trees.with_bins(flat, ["med_inc", "latitude"], trees.bin_edges(flat, ["med_inc", "latitude"], 8, 42, 200))
    counts = binned.groupBy(F.col("bins")[0], F.col("bins")[1].alias("b")).count().collect()
    assert sorted((r[0], r.b, r["count"]) for r in counts) == [(0, b, 25) for b in range(8)]
    few = trees.bin_edges(sample, ["med_inc"], 255, 42, 200, edge_rows=50)
    assert 10 < len(few[0]) < 120


def test_a_second_start_goes_on_from_the_last_block(spark, sample, tmp_path):
    data, folder = prep.split(prep.gold(sample)), str(tmp_path / "blocks")
    whole = boosting.boost(data, small(num_leaves=3), rounds=7, patience=7)

    def stop(done):
        if done == 4:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        boosting.boost(data, small(num_leaves=3), rounds=7, patience=7, folder=folder, block=2, after_block=stop)
    seen = []
    again = boosting.boost(
        data, small(num_leaves=3), rounds=7, patience=7, folder=folder, block=2, after_block=seen.append
    )
    assert seen == [6]
    assert model_rows(spark, again.model) == model_rows(spark, whole.model)
    assert again.losses == pytest.approx(whole.losses)
    # Other settings don't go on from there.
    other = boosting.boost(data, small(num_leaves=2), rounds=2, patience=2, folder=folder)
    assert len(other.losses) == 2


def test_a_job_that_dies_leaves_no_readable_run(spark, sample, tmp_path, monkeypatch):
    config = TrainingConfig(str(tmp_path / "job"), "a" * 40, run_id="r-1", params={**QUICK, "num_boost_round": 1, "num_leaves": 3})
    run_training(sample, config)
    assert read_manifests(spark, config.output_dir).count() == 1
    with monkeypatch.context() as patched:
        real = training.write_document

        def broken(session, path, document):
            if path.endswith("run.json"):
                raise OSError("lost")
            real(session, path, document)

        patched.setattr(training, "write_document", broken)
        with pytest.raises(OSError, match="lost"):
            run_training(sample, config)
    assert read_manifests(spark, config.output_dir).count() == 0
    run_training(sample, config)
    assert [r.run_id for r in read_manifests(spark, config.output_dir).collect()] == ["r-1"]
    assert not list(Path(config.output_dir).glob("_*"))


def test_bad_training_parts(sample):
    data = prep.split(prep.gold(sample))
    with pytest.raises(ValueError, match="no rows"):
        boosting.boost(data.filter("split = 'valid'"), small())
    with pytest.raises(ValueError, match="no rows"):
        boosting.bagged_forest(data.limit(0))
    unseen = boosting.boost(data.filter("split = 'train'"), small(), rounds=2)
    assert (unseen.best_iteration, unseen.losses) == (2, [])
    level = boosting.boost(data.withColumn(TARGET, F.lit(3.0)), small(), rounds=3, patience=2)
    assert [len(t.feature) for t in level.model.trees] == [1]
    assert modeling.score(level.model, data).agg(F.min("prediction"), F.max("prediction")).first() == (3.0, 3.0)


def test_best_round_uses_patience():
    assert modeling.best_round([5, 4, 3, 3.5, 3.6, 1], patience=2) == 3
    assert modeling.best_round([5, 4, 3, 3.5, 3.6, 1], patience=5) == 6
    assert modeling.best_round([1.0], patience=1) == 1


def test_metrics_against_a_hand_count(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)], [TARGET, "prediction"])
    row = modeling.regression_metrics(df, prefix="baseline_").first()
    assert row.baseline_rmse == pytest.approx((5 / 3) ** 0.5)
    assert row.baseline_mae == pytest.approx(1.0)
    assert row.baseline_r2 == pytest.approx(1 - 5 / 8)
    flat = df.withColumn(TARGET, F.lit(1.0))
    assert modeling.regression_metrics(flat).first().r2 is None


def test_scoring_ignores_column_order_and_names_what_is_missing(sample, trained):
    model = trained[1].model
    turned = sample.select(*reversed(sample.columns))
    a = {r[ROW_ID]: r.prediction for r in modeling.score(model, sample).collect()}
    b = {r[ROW_ID]: r.prediction for r in modeling.score(model, turned).collect()}
    assert a == b
    with pytest.raises(ValueError, match="latitude"):
        modeling.score(model, sample.drop("latitude"))


def test_payloads(spark, sample, trained):
    model = trained[1].model
    rows = sample.orderBy(ROW_ID).limit(2).select(*FEATURES).collect()
    one, two = [r.asDict() for r in rows]
    turned = dict(reversed(one.items()))
    lacking = {k: v for k, v in one.items() if k != "latitude"}
    bodies = {
        "good": {"instances": [one, two]},
        "turned": {"instances": [turned]},
        "lacking": {"instances": [one, lacking]},
        "empty": {"instances": []},
        "word": {"instances": [{**one, "latitude": "north"}]},
        "none": {"rows": 1},
    }
    data = [(k, json.dumps(v)) for k, v in bodies.items()] + [("broken", "{")]
    requests = spark.createDataFrame(data, "request_id string, body string")
    answers = {
        r.request_id: r
        for r in modeling.payload_answers(modeling.score_payloads(model, requests)).collect()
    }
    assert len(answers["good"].predictions) == 2
    assert answers["turned"].predictions == answers["good"].predictions[:1]
    assert answers["lacking"].error == "missing features: latitude"
    assert answers["lacking"].predictions is None
    assert {answers[k].error for k in ("empty", "none", "broken")} == {"no instances"}
    assert answers["word"].error == "feature is no number"


def test_params_become_typed(spark):
    given = {"a": "0.05", "b": "500", "c": "true", "d": "abc", "e": "null", "f": '"q"',
             "g": "", "h": "[1]", "i": "NaN", "j": "1e-7"}
    df = spark.createDataFrame([(given,)], "params map<string,string>")
    rows = {r.key: (r.type, r.value) for r in params.typed_params(df).collect()}
    assert {k: t for k, (t, _) in rows.items()} == {
        "a": "float", "b": "int", "c": "bool", "d": "text", "e": "null", "f": "text",
        "g": "text", "h": "nested", "i": "float", "j": "float",
    }
    assert rows["f"][1] == "q" and rows["g"][1] == ""
    texts = ["0.05", "500", "true", "abc", 3]
    assert [params.literal(t) for t in texts] == [0.05, 500, True, "abc", 3]


def test_settings_refuse_what_the_learner_lacks():
    asked = params.Settings.of({"seed": "7", "num_leaves": "31", "max_depth": 2}, 42)
    assert (asked.seed, asked.rounds, asked.patience) == (7, 2000, 50)
    assert (asked.learner["num_leaves"], asked.learner["max_depth"]) == (31, 2)
    with pytest.raises(ValueError, match="lambda_l2"):
        params.Settings.of({"lambda_l2": 5}, 42)


def test_a_cut_model_equals_a_shorter_fit(spark, sample):
    data = prep.split(prep.gold(sample))
    long, short = (boosting.boost(data, small(num_leaves=4), rounds=n, patience=9).model for n in (5, 3))
    assert model_rows(spark, long.first(3)) == model_rows(spark, short.first(3))


def test_gain_counts_the_splits_of_a_feature(spark):
    rows = [(0, 0, 0, 0.5, 1, 0.0, 500.0, 9), (0, 1, -1, 0.0, -1, 1.0, 0.0, 4), (1, 0, 1, 2.0, 1, 0.0, 62.5, 9),
            (1, 1, 0, 2.0, 3, 0.0, 100.0, 5)]
    table = modeling.feature_importance(spark.createDataFrame(rows, trees.NODES), ["a", "b", "c"])
    assert {r.feature: (r.gain, r.split) for r in table.collect()} == {
        "a": (600.0, 2), "b": (62.5, 1), "c": (0.0, 0),
    }


def test_mirror_flattens_types_and_skips_other_platforms(spark, make_runs):
    runs = make_runs(
        {"run_id": "RUN-1", "status": "failure", "failure_class": "iam",
         "params": '{"flag": true, "none": null, "n": 3, "t": "x", "deep": {"a": 1}}',
         "metrics": '{"rmse": 0.5}', "duration_seconds": 2.0},
        {"run_id": "2", "platform": "azureml"},
    )
    rows = mirror.tracker_entries(runs).collect()
    assert {r.run_name for r in rows} == {"train-run-1"} and {r.state for r in rows} == {"FAILED"}
    cells = {(r.kind, r.key): r.str_value if r.num_value is None else r.num_value for r in rows}
    assert cells == {
        ("param", "platform"): "vertex", ("param", "stage"): "train", ("param", "attempt"): 1.0,
        ("param", "write_path"): "direct", ("param", "code_revision"): "a" * 40,
        ("param", "failure_class"): "iam", ("param", "flag"): "True", ("param", "none"): "None",
        ("param", "n"): 3.0, ("param", "t"): "x", ("param", "deep"): '{"a":1}',
        ("metric", "duration_seconds"): 2.0, ("metric", "rmse"): 0.5,
    }
    long = mirror.tracker_entries(make_runs({"run_id": "X" * 200})).first().run_name
    assert len(long) == 128 and long == long.lower()


def test_artifact_uris(spark):
    uris = ["lab://b/p/a.txt", "lab://b/p/", "lab:///x", "other://b/a", "lab://b/a.txt"]
    df = spark.createDataFrame([(u,) for u in uris], "uri string")
    rows = {r.uri: r for r in artifacts.list_objects(df, "lab").collect()}
    assert set(rows) == set(uris) - {"lab://b/p/"}
    assert (rows[uris[0]].bucket, rows[uris[0]].key) == ("b", "p/a.txt")
    assert rows[uris[0]].file_name == "a.txt" and rows[uris[4]].key == "a.txt"
    assert (rows[uris[2]].problem, rows[uris[3]].problem) == ("bucket", "scheme")


def test_folder_listing_and_checksums(spark, tmp_path):
    import hashlib

    with pytest.raises(artifacts.ArtifactUriError):
        (tmp_path / "none").mkdir()
        artifacts.list_folder(spark, str(tmp_path / "none"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"abc")
    assert artifacts.list_folder(spark, str(tmp_path / "d")).first().file_name == "a.bin"
    row = artifacts.file_checksums(spark, str(tmp_path / "d")).first()
    assert (row.sha256, row.length) == (hashlib.sha256(b"abc").hexdigest(), 3)
