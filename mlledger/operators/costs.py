"""Billing exports to cost rows: platform, usage_date, service, amount_usd, unit."""

from __future__ import annotations

from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlledger.schemas import platform_dim
from mlledger.session import durable
from mlledger.sources.exports import read_cost_export
from mlledger.sources.ledger_files import union_all

# Fixed value: price of one credit unless a contract says otherwise.
CREDIT_PRICE_USD = "2.0"
_AMOUNT = "decimal(18,6)"


def trailing_window(day: Column, today: str, days: int) -> Column:
    """[today - days, today): the last `days` full days. `today` is a parameter, not the clock."""
    end = F.lit(today).cast("date")
    return (day >= F.date_sub(end, days)) & (day < end)


def _window_start(time: Column, today: str, days: int) -> Column:
    """The same window on a timestamp column, as a comparison the scan can push down."""
    end = F.lit(today).cast("date")
    return (time >= F.date_sub(end, days).cast("timestamp")) & (time < end.cast("timestamp"))


def _rows(df: DataFrame, platform: str, service: Column, amount: Column, unit: str) -> DataFrame:
    return df.select(
        F.lit(platform).alias("platform"),
        F.col("usage_date").cast("date").alias("usage_date"),
        service.alias("service"),
        amount.cast(_AMOUNT).alias("amount_usd"),
        F.lit(unit).alias("unit"),
    )


def nested_costs(export: DataFrame, today: str, days: int) -> DataFrame:
    """Daily groups in nested JSON; amounts come as text and only positive ones count."""
    periods = export.select(F.explode("ResultsByTime").alias("p"))
    groups = periods.select(
        F.col("p.TimePeriod.Start").cast("date").alias("usage_date"),
        F.explode("p.Groups").alias("g"),
    ).filter(trailing_window(F.col("usage_date"), today, days))
    priced = groups.select(
        "usage_date",
        F.element_at("g.Keys", 1).alias("service"),
        F.col("g.Metrics.UnblendedCost.Amount").cast("decimal(28,10)").alias("amount"),
    ).filter(F.col("amount") > 0)
    return _rows(priced, "sagemaker", F.col("service"), F.round("amount", 6), "usd")


def usage_costs(export: DataFrame, today: str, days: int) -> DataFrame:
    """Usage quantities. The price depends on the contract, so the amount stays a quantity."""
    used = export.filter(trailing_window(F.col("usage_date"), today, days))
    total = F.sum(F.col("usage_quantity").cast("decimal(28,10)")).alias("quantity")
    daily = used.groupBy("usage_date", "sku_name").agg(total)
    service = F.concat(F.lit("dbu:"), F.col("sku_name"))
    return _rows(daily, "databricks", service, F.col("quantity"), "dbu")


def credit_costs(
    export: DataFrame, today: str, days: int, price_usd: str = CREDIT_PRICE_USD
) -> DataFrame:
    """Metered credits times their price."""
    used = export.filter(_window_start(F.col("start_time"), today, days))
    daily = used.groupBy(
        F.to_date("start_time").alias("usage_date"), "warehouse_name"
    ).agg(F.sum(F.col("credits_used").cast("decimal(28,10)")).alias("credits"))
    amount = F.round(F.col("credits") * F.lit(price_usd).cast("decimal(9,4)"), 6)
    service = F.concat(F.lit("warehouse:"), F.col("warehouse_name"))
    return _rows(daily, "snowflake", service, amount, "usd")


def billing_costs(export: DataFrame, today: str, days: int) -> DataFrame:
    """Billing export rows with the service name in a struct."""
    used = export.filter(_window_start(F.col("usage_start_time"), today, days))
    daily = used.groupBy(
        F.to_date("usage_start_time").alias("usage_date"),
        F.col("service.description").alias("service"),
    ).agg(F.sum(F.col("cost").cast("decimal(28,10)")).alias("cost"))
    return _rows(daily, "vertex", F.col("service"), F.round("cost", 6), "usd")


def flat_costs(export: DataFrame, today: str, days: int) -> DataFrame:
    """Rows that are costs already."""
    dated = export.withColumn("usage_date", F.col("usage_date").cast("date"))
    used = dated.filter(trailing_window(F.col("usage_date"), today, days))
    return _rows(used, "azureml", F.col("service"), F.col("cost"), "usd")


def all_costs(sources: dict[str, DataFrame]) -> DataFrame:
    """Cost rows of all sources that could be read."""
    return union_all(list(sources.values()))


def unavailable_sources(costs: DataFrame, problems: dict[str, str]) -> DataFrame:
    """Platforms without any cost row, with the reason. "No data" is not zero cost.

    problems: platform → why its export could not be read.
    """
    found = costs.select("platform").distinct()
    reason = F.lit("no cost export")
    for platform, text in problems.items():
        reason = F.when(F.col("platform") == platform, F.lit(text)).otherwise(reason)
    return (
        platform_dim(costs.sparkSession)
        .select("platform")
        .join(found, "platform", "left_anti")
        .withColumn("reason", reason)
    )


def collect_costs(
    spark: SparkSession,
    paths: dict[str, str],
    today: str,
    days: int = 7,
    price_usd: str = CREDIT_PRICE_USD,
) -> tuple[DataFrame | None, dict[str, str]]:
    """Cost rows of the exports that work; a missing or malformed one does not stop the others.

    Each source is computed inside its own try, as Spark meets a bad value only when it runs; the
    daily rows are few, so they are kept as checkpoints. Returns the rows (None if no source
    worked) and platform → problem.
    """
    makers = {
        "vertex": billing_costs,
        "sagemaker": nested_costs,
        "azureml": flat_costs,
        "databricks": usage_costs,
        "snowflake": partial(credit_costs, price_usd=price_usd),
    }
    rows: dict[str, DataFrame] = {}
    problems: dict[str, str] = {}
    for platform, path in paths.items():
        try:
            export = read_cost_export(spark, platform, path)
            rows[platform] = durable(makers[platform](export, today=today, days=days))
        except PySparkException as e:
            problems[platform] = f"{type(e).__name__}: {e}".splitlines()[0]
        except Py4JJavaError as e:  # what a checkpoint raises for a bad row
            problems[platform] = str(e.java_exception.getMessage()).splitlines()[0]
    return (all_costs(rows) if rows else None), problems
