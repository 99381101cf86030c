"""Exact ranks over whole tables without a global sort in one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlledger.functions.hashing import salted_md5
from mlledger.operators.prep import TEST_SHARE, VALID_SHARE
from mlledger.schemas import ROW_ID, SEED
from mlledger.session import durable

_DIGITS_PER_STEP = 3
_HASH_DIGITS = 32


@dataclass(frozen=True)
class Cut:
    """The last (hash, key) pair that is still inside the cut; None for an empty cut."""

    digest: str | None
    key: int | None

    def holds(self, digest: Column, key: Column) -> Column:
        if self.digest is None:
            return F.lit(False)
        inside = (digest < self.digest) | ((digest == self.digest) & (key <= self.key))
        return inside


def smallest_cut(
    df: DataFrame,
    digest: Column,
    size: int | None = None,
    share: float | None = None,
    key: str = ROW_ID,
    boundary_rows: int = 100_000,
) -> Cut:
    """The last of the `size` smallest (digest, key) pairs, or of a share of them, rounded up.

    A first scan counts rows per hash prefix (at most 4,096 groups, summed map-side) and so shows
    which prefix holds the wanted rank; a second one keeps the rows of that prefix, about one in
    4,096. What is left to do, going three hex digits deeper until few rows remain to sort, reads
    only those. `boundary_rows` says how few, and has no influence on the result. If the pair at the
    cut occurs more than once, the cut would have to go through equal rows, which is an error.
    """
    rows = df.select(digest.alias("h"), F.col(key).alias("k"))
    prefix, wanted, inside = "", F.lit(size), None
    if share is not None:
        wanted = F.ceil(F.lit(share) * F.sum("n").over(Window.partitionBy()))
    while len(prefix) < _HASH_DIGITS and (inside is None or inside > boundary_rows):
        width = min(len(prefix) + _DIGITS_PER_STEP, _HASH_DIGITS)
        counts = rows.groupBy(F.substring("h", 1, width).alias("p")).agg(F.count("*").alias("n"))
        # The windows run over the at most 4,096 counts.
        row = (
            counts.withColumns({"upto": F.sum("n").over(Window.orderBy("p")), "wanted": wanted})
            .filter((F.col("upto") >= F.col("wanted")) & (F.col("wanted") > 0))
            .orderBy("p")
            .first()
        )
        if row is None:
            if size:
                raise ValueError(f"cut of {size} rows is larger than the table")
            return Cut(None, None)
        remaining = row.wanted - (row.upto - row.n)
        prefix, inside, wanted = row.p, row.n, F.lit(remaining)
        within = rows.filter(F.col("h").startswith(prefix))
        rows = durable(within) if width == _DIGITS_PER_STEP else within
    pairs = rows.groupBy("h", "k").agg(F.count("*").alias("copies"))
    # Few pairs are left, or one hash that many of them share.
    running = F.sum("copies").over(Window.orderBy("h", "k"))
    last = (
        pairs.withColumn("upto", running)
        .filter(F.col("upto") >= remaining)
        .orderBy("upto")
        .first()
    )
    if last.copies > 1:
        raise ValueError(f"{key} {last.k} occurs {last.copies} times at the cut")
    return Cut(last.h, last.k)


def exact_split(
    df: DataFrame,
    seed: int = SEED,
    test_share: float = TEST_SHARE,
    valid_share: float = VALID_SHARE,
    key: str = ROW_ID,
    boundary_rows: int = 100_000,
) -> DataFrame:
    """`split` with exact sizes: 20 % of all rows, then 20 % of the rest, both rounded up.

    Two cut values come back to the driver; the split itself is a row-local comparison.
    """
    test_hash, valid_hash = salted_md5(key, seed, "test"), salted_md5(key, seed, "valid")

    def cut(rows: DataFrame, digest: Column, share: float) -> Column:
        found = smallest_cut(rows, digest, share=share, key=key, boundary_rows=boundary_rows)
        return found.holds(digest, F.col(key))

    in_test = cut(df, test_hash, test_share)
    in_valid = cut(df.filter(~in_test), valid_hash, valid_share)
    return df.withColumn(
        "split", F.when(in_test, "test").when(in_valid, "valid").otherwise("train")
    )


def number_within(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """row_number per group where one group may be a third of the table.

    A window by group would sort each group in one task. Here one range shuffle by group and order
    spreads a large group over many sorted slices, and a row's place in its slice is its number but
    for a shift. The shifts have one row for each group that a slice meets, which is at most as many
    as slices and groups together; where that is few, Spark broadcasts them by their size and the
    rows move no second time. The slices
    are checkpointed because their bounds are sampled and both branches must see the same ones.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The low 33 bits of the id count the rows of a partition, in their sorted order.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = durable(
        df.repartitionByRange(slices, *group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumns({"_slice": F.spark_partition_id(), "_place": place})
    )
    earlier = (
        Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = ranged.groupBy(*group, "_slice").agg(
        F.count("*").alias("_rows"), F.min("_place").alias("_first")
    )
    shifts = sizes.select(
        *[F.col(g).alias(f"_of_{g}") for g in group],
        F.col("_slice").alias("_of_slice"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = F.col("_slice") == F.col("_of_slice")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return (
        ranged.join(shifts, same)
        .withColumn(out, F.col("_place") + F.col("_shift") + 1)
        .select(*df.columns, out)
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key.

    Spark turns `row_number() <= 1` into a limit before the shuffle, so a key with very many
    copies sends one row per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")
