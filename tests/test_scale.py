"""Hot keys: one key holds a third of all rows and no task may hold all of them."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from mlledger import session
from mlledger.operators import exact, ledger, residual
from mlledger.plans import comparison

ROWS = 30_000


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A run ledger where one (platform, stage) and one revision hold over a third of all rows."""
    hot = F.col("id") % 3 == 0
    return spark.range(ROWS).select(
        F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("run_id"),
        F.when(hot, "vertex").otherwise("azureml").alias("platform"),
        F.when(hot, "train").otherwise(F.when(F.col("id") % 2 == 0, "deploy").otherwise("train"))
        .alias("stage"),
        F.when(F.col("id") < 9_000, "failure").otherwise("success").alias("status"),
        F.when(hot, "a").otherwise(F.col("id").cast("string")).alias("code_revision"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 100)).alias("created_at"),
        F.lit("{}").alias("params"),
    )


def test_numbering_spreads_a_hot_group_over_slices(spark, skewed):
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = comparison.numbered_tries(skewed)
    hot = numbered.filter("platform = 'vertex' AND stage = 'train'")
    assert hot.agg(F.max("try_number"), F.count_distinct("try_number")).first()[:] == (
        ROWS // 3,
        ROWS // 3,
    )
    ranged = skewed.repartitionByRange(slices, "platform", "stage", "created_at", "run_id")
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * ROWS / slices


def test_friction_needs_no_window(skewed):
    report = comparison.friction(skewed)
    assert "Window" not in plan_of(report)
    window = comparison.friction_by_window(skewed)
    assert sorted(map(tuple, report.collect())) == sorted(map(tuple, window.collect()))


def test_copies_of_one_run_shrink_before_the_shuffle(skewed):
    copies = skewed.withColumn(
        "run_id", F.when(F.col("code_revision") == "a", "hot").otherwise(F.col("run_id"))
    )
    held = skewed.filter("run_id < 'r00001000'")
    fresh = ledger.absent_rows(copies, held, "run_id", [F.col("created_at")])
    plan = plan_of(fresh)
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange")
    assert fresh.count() == fresh.select("run_id").distinct().count()
    assert fresh.filter("run_id = 'hot'").count() == 1


def test_objects_of_one_bucket_are_reduced_before_the_join(spark):
    objects = spark.range(ROWS).select(
        F.lit("vertex").alias("platform"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("name"),
    )
    rows = [("vertex", "hot"), ("vertex", "x")]
    buckets = spark.createDataFrame(rows, "platform string, name string")
    held = residual.nonempty_containers(buckets, objects)
    assert "HashAggregate" in plan_of(held)
    assert [r.name for r in held.collect()] == ["hot"]


def test_exact_cut_equals_a_sort(spark):
    df = spark.range(5_000).withColumnRenamed("id", "row_id")
    digest = F.md5(F.col("row_id").cast("string"))
    ordered = sorted((r.h, r.row_id) for r in df.withColumn("h", digest).collect())
    for size in (1, 777, 5_000):
        cut = exact.smallest_cut(df, digest, size, boundary_rows=3)
        assert (cut.digest, cut.key) == ordered[size - 1]


def test_population_filter_reaches_the_scan(spark, skewed, tmp_path):
    skewed.write.parquet(str(tmp_path / "runs"))
    stored = spark.read.parquet(str(tmp_path / "runs"))
    runs = stored.withColumns({"tier": F.lit("A"), "write_path": F.lit("direct")})
    plan = plan_of(comparison.write_paths(comparison.population(runs)))
    assert "LessThan(created_at" in plan
    assert "code_revision" not in plan.split("ReadSchema:")[1]


def fake(master, conf=None, directory=None):
    state = {"dir": directory}
    sc = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: state["dir"],
        setCheckpointDir=lambda d: state.update(dir=d),
    )
    return SimpleNamespace(
        sparkContext=sc, conf=SimpleNamespace(get=lambda key, default=None: conf or default)
    )


def test_shared_folder_comes_from_the_session():
    assert session.shared_root(fake("yarn", "hdfs:/shared/")) == "hdfs:/shared"
    assert session.shared_root(fake("yarn", None, "hdfs:/set")) == "hdfs:/set"
    with pytest.raises(RuntimeError):
        session.shared_root(fake("yarn"))
    local = fake("local[2]")
    assert session.shared_root(local) == session.shared_root(local)
