"""Bronze, silver and gold preparation of the training table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlledger.functions.hashing import BUCKETS, hash_bucket
from mlledger.schemas import FEATURES, ROW_ID, SEED, TARGET

TEST_SHARE = 0.2
VALID_SHARE = 0.2


class DataContractError(ValueError):
    pass


def normalize_columns(df: DataFrame) -> DataFrame:
    """Strip and lower-case the column names; two names that become one are an error."""
    names = [c.strip().lower() for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise DataContractError(f"column names collide after normalising: {clashes}")
    return df.toDF(*names)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number of copies."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def bronze(df: DataFrame, check_unique: bool = True) -> DataFrame:
    """row_id, then the contract's features in contract order, then the target if there is one."""
    named = normalize_columns(df)
    if ROW_ID not in named.columns:
        raise DataContractError("column row_id is required")
    if check_unique and not duplicate_keys(named, ROW_ID).isEmpty():
        raise DataContractError("row_id is not unique")
    kept = [c for c in [*FEATURES, TARGET] if c in named.columns]
    return named.select(ROW_ID, *kept)


def is_missing(df: DataFrame, name: str) -> Column:
    col = F.col(name)
    floating = dict(df.dtypes)[name] in ("double", "float")
    return col.isNull() | F.isnan(col) if floating else col.isNull()


def contract_violations(
    df: DataFrame, features: list[str] = FEATURES, target: str = TARGET
) -> DataFrame:
    """All broken silver rules as rows (rule_no, rule, column_name, bad_rows), from one scan.

    A data frame has one length for all of its columns, so the rule about unequal lengths of
    features and target cannot be broken.
    """
    present = [c for c in features if c in df.columns]
    checked = present + ([target] if target in df.columns else [])
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"bad_{c}") for c in checked],
    )
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def rule(number: int, name: str, column: str, bad: Column) -> Column:
        return F.struct(
            F.lit(number).alias("rule_no"),
            F.lit(name).alias("rule"),
            F.lit(column).alias("column_name"),
            bad.alias("bad_rows"),
        )

    empty = F.when(F.col("rows") == 0, one).otherwise(zero)
    no_features = empty if present else one
    no_target = empty if target in df.columns else one
    rules = [rule(1, "features empty", "", no_features), rule(2, "target empty", target, no_target)]
    rules += [rule(4, "feature is null", c, F.col(f"bad_{c}")) for c in present]
    if target in df.columns:
        rules.append(rule(5, "target is null", target, F.col(f"bad_{target}")))
    rules += [rule(6, "column missing", c, one) for c in features if c not in df.columns]
    return (
        counts.select(F.explode(F.array(*rules)).alias("r"))
        .select("r.*")
        .filter(F.col("bad_rows") > 0)
    )


def silver(df: DataFrame) -> DataFrame:
    """The same rows, or an error that names the first broken rule."""
    first = contract_violations(df).orderBy("rule_no", "column_name").first()
    if first is not None:
        raise DataContractError(f"{first.rule}: {first.column_name} ({first.bad_rows} rows)")
    return df


def gold(df: DataFrame) -> DataFrame:
    """Model-ready columns. The features are numeric already, so they pass unchanged."""
    return df.select(ROW_ID, *FEATURES, TARGET)


def feature_schema(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """(ordinal, column_name, dtype, filled_rows) of the gold features, in one scan."""
    types = dict(df.dtypes)
    filled = df.agg(*[F.count_if(~is_missing(df, c)).alias(c) for c in features])
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(c).alias("column_name"),
            F.lit(types[c]).alias("dtype"),
            F.col(c).alias("filled_rows"),
        )
        for i, c in enumerate(features)
    ]
    return filled.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def target_summary(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"),
        F.avg(target).alias("mean"),
        F.min(target).alias("min"),
        F.max(target).alias("max"),
        F.stddev_pop(target).alias("std"),
    )


def split(
    df: DataFrame,
    seed: int = SEED,
    test_share: float = TEST_SHARE,
    valid_share: float = VALID_SHARE,
    key: str = ROW_ID,
) -> DataFrame:
    """Add `split` from hashes of the key alone: no shuffle, and no dependence on row order.

    The second cut uses its own salt, so validation is a share of what the test cut left.
    """
    in_test = hash_bucket(key, seed, "test") < round(test_share * BUCKETS)
    in_valid = hash_bucket(key, seed, "valid") < round(valid_share * BUCKETS)
    return df.withColumn(
        "split", F.when(in_test, "test").when(in_valid, "valid").otherwise("train")
    )


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Content fingerprint that ignores row order, file layout and partitioning.

    The xor cancels pairs of equal rows, the sum does not; both are partial aggregates. A hash
    passes over nulls, so each column goes in with a null flag that keeps them in their place.
    """
    row_hash = F.xxhash64(*[part for c in columns for part in (F.col(c).isNull(), F.col(c))])
    return df.select(row_hash.alias("h")).agg(
        F.count("*").alias("rows"),
        F.bit_xor("h").alias("hash_xor"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
    )


def portable_fingerprint(df: DataFrame, texts: list[Column]) -> DataFrame:
    """The same idea over md5 of given texts, for a check by another engine.

    Each text stands behind its length, and a null is a dash, so neither nulls nor separators in a
    text can move unseen.
    """
    marked = [
        F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]
    digest = F.md5(F.concat(*marked))
    head = F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(head).cast("string").alias("hash_sum"))
