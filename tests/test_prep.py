from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mlledger.operators import exact, prep
from mlledger.operators.prep import DataContractError
from mlledger.schemas import FEATURES, ROW_ID, TARGET
from mlledger.sources import tables


def test_column_names_are_stripped_and_lowered(sample):
    shouted = sample.toDF(*[f" {c.upper()}" for c in sample.columns])
    assert prep.bronze(shouted).columns == [ROW_ID, *FEATURES, TARGET]


def test_colliding_names_are_an_error(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], [ROW_ID, "MED_INC", "med_inc "])
    with pytest.raises(DataContractError, match="med_inc"):
        prep.normalize_columns(df)


def test_contract_order_whatever_the_input_order(sample):
    turned = sample.select(*reversed(sample.columns))
    assert prep.bronze(turned).columns == [ROW_ID, *FEATURES, TARGET]


def test_row_id_is_required_and_unique(sample):
    with pytest.raises(DataContractError, match="row_id"):
        prep.bronze(sample.drop(ROW_ID))
    with pytest.raises(DataContractError, match="not unique"):
        prep.bronze(sample.unionByName(sample.limit(1)))


def test_target_is_optional_in_bronze(sample):
    assert TARGET not in prep.bronze(sample.drop(TARGET)).columns


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        (lambda d: d.limit(0), "features empty"),
        (lambda d: d.drop(TARGET), "target empty"),
        (lambda d: d.withColumn("latitude", F.lit(float("nan"))), "feature is null: latitude"),
        (lambda d: d.withColumn("latitude", F.lit(None).cast("double")), "feature is null"),
        (lambda d: d.withColumn(TARGET, F.lit(None).cast("double")), "target is null"),
        (lambda d: d.drop("longitude"), "column missing: longitude"),
    ],
)
def test_silver_names_the_first_broken_rule(sample, change, rule):
    with pytest.raises(DataContractError, match=rule):
        prep.silver(change(sample))


def test_silver_passes_good_rows(sample):
    assert prep.silver(sample).count() == 200


def test_nulls_come_before_missing_columns(sample):
    broken = sample.drop("longitude").withColumn("latitude", F.lit(None).cast("double"))
    rules = [r.rule_no for r in prep.contract_violations(broken).orderBy("rule_no").collect()]
    assert rules == [4, 6]


def split_of(df):
    return {r[ROW_ID]: r.split for r in df.collect()}


@pytest.mark.parametrize("maker", [prep.split, exact.exact_split])
def test_split_ignores_order_and_partitioning(sample, maker):
    shuffled = sample.orderBy(F.rand(3)).repartition(5)
    assert split_of(maker(sample)) == split_of(maker(shuffled))


@pytest.mark.parametrize("maker", [prep.split, exact.exact_split])
def test_split_depends_on_the_seed(sample, maker):
    assert split_of(maker(sample, seed=1)) != split_of(maker(sample, seed=2))


@pytest.mark.parametrize("boundary", [1, 10, 100_000])
def test_exact_split_sizes_and_members(sample, boundary):
    parts = split_of(exact.exact_split(sample, boundary_rows=boundary))
    sizes = {s: list(parts.values()).count(s) for s in ("train", "valid", "test")}
    assert sizes == {"test": 40, "valid": 32, "train": 128}
    assert parts == split_of(exact.exact_split(sample))


def test_exact_split_of_odd_sizes(spark):
    for n in (1, 2, 3, 11):
        parts = split_of(exact.exact_split(spark.range(n).withColumnRenamed("id", ROW_ID)))
        test = -(-n // 5)
        valid = -(-(n - test) // 5)
        counted = [list(parts.values()).count(s) for s in ("test", "valid", "train")]
        assert counted == [test, valid, n - test - valid]


def test_exact_cut_refuses_copies_of_one_key(spark):
    same = spark.range(100).select((F.col("id") % 2).alias(ROW_ID))
    for boundary in (1, 10, 1000):
        with pytest.raises(ValueError, match="occurs 50 times"):
            exact.exact_split(same, boundary_rows=boundary)


def test_fingerprint_sees_nulls_and_separators_move(spark):
    def prints(rows):
        df = spark.createDataFrame(rows, "a string, b string, c string")
        texts = [F.col(c) for c in df.columns]
        return prep.fingerprint(df, df.columns).first(), prep.portable_fingerprint(df, texts).first()

    rows = [("1", None, "x"), (None, "1", "x"), ("1|x", "", None), ("1", "x", None), ("1", "", "x")]
    for i in (0, 1):
        assert len({prints([r])[i] for r in rows}) == len(rows)
    assert prints(rows) == prints(rows[::-1])


def test_numbering_equals_a_window_with_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}" if i % 2 else None, i % 11, i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, t int, id int")
    numbered = exact.number_within(df, ["g"], ["t", "id"], "n")
    expected = df.selectExpr("*", "row_number() over (partition by g order by t, id) n")
    assert {tuple(r) for r in numbered.collect()} == {tuple(r) for r in expected.collect()}
    assert numbered.count() == 600


def test_first_per_key_limits_rows_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id div 5000 as k", "id")
    first = exact.first_per_key(df, ["k"], [F.col("id").desc()])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    assert first.first().id == 999


def test_fingerprint_ignores_layout_but_sees_content(sample):
    def mark(df):
        return prep.fingerprint(df, sample.columns).first()

    assert mark(sample) == mark(sample.repartition(7).orderBy(F.rand(1)))
    assert mark(sample) != mark(sample.withColumn("latitude", F.col("latitude") + 1))
    assert mark(sample) != mark(sample.unionByName(sample.limit(2)))


def test_page_and_lookup(sample, spark):
    ids = [r[ROW_ID] for r in tables.page(sample, 3, 10).collect()]
    assert ids == [10, 11, 12]
    assert tables.lookup(sample, []).count() == 0
    assert {r[ROW_ID] for r in tables.lookup(sample, [5, 5, 900]).collect()} == {5}
    wanted = spark.createDataFrame([(5,), (5,), (6,)], "x long")
    assert tables.lookup(sample, wanted).count() == 2


def test_strict_single_file_read(sample, spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    sample.coalesce(1).write.parquet(one)
    sample.repartition(2).write.parquet(two)
    assert tables.read_dataset(spark, one, single_file=True).count() == 200
    assert tables.read_dataset(spark, two).count() == 200
    with pytest.raises(ValueError, match="one Parquet file"):
        tables.read_dataset(spark, two, single_file=True)
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        tables.read_dataset(spark, str(tmp_path / "none"), sample.schema, single_file=True)


def test_source_names_keep_the_given_row_id(spark):
    names = [*tables.SOURCE_COLUMNS]
    df = spark.createDataFrame([(9, *[float(i) for i in range(9)])], ["index", *names])
    row = tables.from_source_names(df, "index").first()
    assert row[ROW_ID] == 9 and row[TARGET] == 8.0
