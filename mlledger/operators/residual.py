"""What is left after a teardown, from inventory listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlledger.functions.classify import in_lab, missing_object, parent_absent
from mlledger.operators.ledger import per_platform
from mlledger.schemas import INFRA_SCHEMA, PLATFORMS, fixed_table, platform_dim

# What is checked per platform. Columns: platform, kind, severity, whether only
# names with the lab's prefix count, the state that counts (null: any), and the URI scheme of a
# container that counts only if it holds an object (null: not a container).
RULES = [
    ("vertex", "vertex_endpoint", "FAIL", True, None, None),
    ("vertex", "gcs_object", "WARN", True, None, "gs"),
    ("vertex", "artifact_registry", "WARN", True, None, None),
    ("vertex", "registered_model", "WARN", True, None, None),
    ("vertex", "experiment_run", "WARN", True, None, None),
    ("sagemaker", "sagemaker_endpoint", "FAIL", True, None, None),
    ("sagemaker", "sagemaker_endpoint_config", "WARN", True, None, None),
    ("sagemaker", "sagemaker_model", "WARN", True, None, None),
    ("sagemaker", "model_package_group", "WARN", True, None, None),
    ("sagemaker", "ecr_repository", "WARN", True, None, None),
    ("sagemaker", "s3_object", "WARN", True, None, "s3"),
    ("azureml", "online_endpoint", "FAIL", False, None, None),
    ("azureml", "key_vault_soft_deleted", "FAIL", False, None, None),
    ("azureml", "registered_model", "WARN", False, None, None),
    ("databricks", "serving_endpoint", "FAIL", True, None, None),
    ("databricks", "uc_registered_model", "WARN", True, None, None),
    ("databricks", "uc_volume", "WARN", False, None, None),
    ("snowflake", "warehouse_running", "FAIL", True, "STARTED", None),
    ("snowflake", "schema_object", "WARN", True, None, None),
    ("snowflake", "stage_file", "WARN", True, None, None),
]
FAIL_SAFE = ("snowflake", "fail_safe", "WARN", 1, "fail-safe cannot be switched off")
FAIL_SAFE_ITEM = "7 days"

PAGE_ROWS = 1_000
_FINDING = ["platform", "kind", "severity", "item_count", "note"]


def rules(spark: SparkSession) -> DataFrame:
    """The rule table: twenty fixed rows, so always safe to broadcast."""
    columns = ["platform", "kind", "severity", "named", "wanted_state", "scheme"]
    return fixed_table(spark, columns, RULES)


def nonempty_containers(containers: DataFrame, objects: DataFrame) -> DataFrame:
    """Containers that hold at least one object.

    Objects are reduced to their distinct container before the join, so a container with very
    many objects is one row there. Both inputs have platform and name (of the container).
    """
    held = objects.select("platform", "name").distinct()
    return containers.join(held, ["platform", "name"], "left_semi")


def children_of(parents: DataFrame, children: DataFrame, prefix: str) -> DataFrame:
    """Children of the lab's parents as parent/child; AQE splits a parent with many children."""
    ours = parents.filter(in_lab(prefix, "name")).select(
        "platform", F.col("name").alias("parent")
    )
    return children.join(ours.distinct(), ["platform", "parent"]).select(
        "platform", "kind", F.concat_ws("/", "parent", "name").alias("item")
    )


def orphans(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Resources that exist but that no declaration knows."""
    keys = ["platform", "kind", "name"]
    return observed.join(declared.select(*keys).distinct(), keys, "left_anti")


def judged(inventory: DataFrame, objects: DataFrame, prefix: str) -> DataFrame:
    """Inventory rows under their rule, with `item` (null: does not count) and `problem`.

    A registered model is an item for each version. It and an endpoint count by the name that is
    displayed, where the listing has one.

    A failed listing is a row with error_text. If the parent is gone there is nothing below it,
    so `problem` is then empty; any other error is kept as text. Rows with neither are left out,
    which leaves a small table; a job that needs findings and items keeps it with `durable`.
    """
    ruled = inventory.join(F.broadcast(rules(inventory.sparkSession)), ["platform", "kind"])
    held = objects.select("platform", "name").distinct().withColumn("_held", F.lit(True))
    plain = ruled.filter(F.col("scheme").isNull()).withColumn("_held", F.lit(True))
    containers = ruled.filter(F.col("scheme").isNotNull()).join(held, ["platform", "name"], "left")
    rows = plain.unionByName(containers)

    expanded = F.col("kind") == "experiment_run"
    versioned = F.col("kind") == "registered_model"
    shown = F.coalesce(F.when(F.col("display_name") != "", F.col("display_name")), "name")
    owner = (
        F.when(expanded, F.col("parent"))
        .when(versioned | (F.col("kind") == "vertex_endpoint"), shown)
        .otherwise(F.col("name"))
    )
    counts = (
        F.col("error_text").isNull()
        & F.coalesce(F.col("_held"), F.lit(False))
        & (~F.col("named") | in_lab(prefix, owner, "database_name"))
        & (F.col("wanted_state").isNull() | F.col("state").eqNullSafe(F.col("wanted_state")))
    )
    text = (
        F.when(expanded, F.concat_ws("/", "parent", "name"))
        .when(versioned, F.concat(shown, F.lit(":"), F.coalesce("version", F.lit("?"))))
        .when(F.col("scheme").isNotNull(), F.concat("scheme", F.lit("://"), "name"))
        .otherwise(F.col("name"))
    )
    gone = parent_absent("error_text") | (
        (F.col("kind") == "uc_volume") & missing_object("error_text")
    )
    problem = F.when(gone, "").otherwise(F.col("error_text"))
    return rows.select(
        "platform",
        "kind",
        "severity",
        F.when(counts, text).alias("item"),
        F.when(F.col("error_text").isNotNull(), problem).alias("problem"),
    ).filter(F.col("item").isNotNull() | F.col("problem").isNotNull())


def _verdicts(checked: DataFrame) -> DataFrame:
    """platform, kind, severity, items, problem: one row per rule at most, so twenty.

    The problem text is first a grouping key, which keeps the pass over all rows a hash
    aggregate; only its few results are then reduced to one text per kind.
    """
    keys = ["platform", "kind", "severity"]
    tallies = checked.groupBy(*keys, "problem").agg(F.count("item").alias("items"))
    return tallies.groupBy(*keys).agg(
        F.sum("items").alias("items"), F.max("problem").alias("problem")
    )


def _checked_dim(df: DataFrame, checked: list[str]) -> DataFrame:
    dim = platform_dim(df.sparkSession).select("platform")
    return dim.filter(F.col("platform").isin(checked))


def findings(checked: DataFrame, platforms: list[str] = PLATFORMS) -> DataFrame:
    """platform, kind, severity, item_count, note; kinds without residue give no row.

    platforms: those that were listed. Nothing is said about the others.

    A failed listing voids the items of its kind and becomes an ERROR finding, unless its parent
    is gone. The fixed fail-safe row is there if its platform was checked.
    """
    broken = F.coalesce(F.col("problem") != "", F.lit(False))
    left = F.col("problem").isNull() & (F.col("items") > 0)
    found = (
        _verdicts(checked)
        .filter(broken | left)
        .select(
            "platform",
            "kind",
            F.when(broken, "ERROR").otherwise(F.col("severity")).alias("severity"),
            F.when(broken, 0).otherwise(F.col("items")).alias("item_count"),
            F.when(broken, F.col("problem")).alias("note"),
        )
    )
    fixed = fixed_table(checked.sparkSession, _FINDING, [FAIL_SAFE])
    every = found.unionByName(fixed.withColumn("item_count", F.col("item_count").cast("long")))
    return every.filter(F.col("platform").isin(platforms))


def items(checked: DataFrame) -> DataFrame:
    """platform, kind, severity, item, copies: every leftover as a row of its own.

    This is the unbounded part of a finding, so it stays in rows; findings carry its size.
    """
    keys = ["platform", "kind", "severity"]
    counted = (
        checked.filter(F.col("item").isNotNull())
        .groupBy(*keys, "item")
        .agg(F.count("*").alias("copies"))
    )
    failed = checked.filter(F.col("problem").isNotNull()).select(*keys).distinct()
    # At most one row per rule, and there are twenty rules.
    return counted.join(F.broadcast(failed), keys, "left_anti")


def item_pages(item_rows: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Items as sorted arrays of about page_rows entries: platform, kind, page, items.

    An item that occurs more than once says how often.
    The page of an item is a hash modulo the number of pages of its kind, so no array grows
    with the inventory.
    """
    sizes = item_rows.groupBy("platform", "kind").agg(
        F.ceil(F.count("*") / page_rows).cast("long").alias("pages")
    )
    head = F.conv(F.substring(F.md5("item"), 1, 8), 16, 10).cast("long")
    # At most one row per rule, and there are twenty rules.
    shown = F.when(
        F.col("copies") > 1, F.concat("item", F.lit(" ("), "copies", F.lit(" times)"))
    ).otherwise(F.col("item"))
    paged = item_rows.join(F.broadcast(sizes), ["platform", "kind"]).withColumn(
        "page", head % F.col("pages")
    )
    return paged.groupBy("platform", "kind", "page").agg(
        F.array_sort(F.collect_list(shown)).alias("items")
    )


def summary(all_findings: DataFrame, checked: list[str] = PLATFORMS) -> DataFrame:
    """One row per checked platform, also for a clean one: counts, status and the blocking flag.

    `status` fails on FAIL only; `blocking` also on ERROR. A platform that was not checked has no
    row, as nothing is known about it.
    """
    tallies = all_findings.groupBy("platform").agg(
        F.count("*").alias("findings"),
        F.count_if(F.col("severity") == "FAIL").alias("fails"),
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARN").alias("warnings"),
    )
    counts = ["findings", "fails", "errors", "warnings"]
    joined = per_platform(_checked_dim(all_findings, checked), tallies).fillna(0, counts)
    return joined.select(
        "platform",
        *counts,
        F.when(F.col("fails") > 0, "failure").otherwise("success").alias("status"),
        ((F.col("fails") > 0) | (F.col("errors") > 0)).alias("blocking"),
    )


def report_lines(all_findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Text lines of a report: platform, kind, page, line.

    pages: item_pages of the same check. A finding has one line for each page of its items, or one
    with a dash if it has none.
    """
    shown = pages.withColumnRenamed("items", "listed")
    note = F.when(F.col("note").isNotNull(), F.concat(F.lit("  # "), "note")).otherwise("")
    fixed = F.when(F.col("kind") == FAIL_SAFE[1], F.lit(FAIL_SAFE_ITEM))
    listed = F.coalesce(F.array_join("listed", ", "), fixed, F.lit("-"))
    return all_findings.join(shown, ["platform", "kind"], "left").select(
        "platform",
        "kind",
        F.coalesce("page", F.lit(0)).alias("page"),
        F.concat(F.format_string("[%s] %s/%s: ", "severity", "platform", "kind"), listed, note).alias(
            "line"
        ),
    )


def check_event_id(check_id: str) -> Column:
    """The id of a platform's event in a check, so recording the same check twice adds nothing."""
    digest = F.md5(F.concat(F.lit(f"{check_id}:"), "platform"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts])


def infra_events(
    all_findings: DataFrame, check_id: str, checked_at: Column, checked: list[str] = PLATFORMS
) -> DataFrame:
    """infra_events rows of one check, one per checked platform even where nothing was found.

    A finding carries its number of items; the items themselves are rows of `event_items` with the
    same event_id. The array has one entry per rule at most.
    """
    entry = F.struct("platform", "kind", "severity", "item_count", "note")
    grouped = all_findings.groupBy("platform").agg(
        F.array_sort(F.collect_list(entry)).alias("findings"),
        F.bool_or(F.col("severity") == "FAIL").alias("failed"),
    )
    kinds = all_findings.select(entry.alias("e")).schema["e"].dataType
    empty = F.array().cast(f"array<{kinds.simpleString()}>")
    body = F.struct(F.coalesce("findings", empty).alias("findings"))
    status = F.when(F.coalesce("failed", F.lit(False)), "failure").otherwise("success")
    event = per_platform(_checked_dim(all_findings, checked), grouped).select(
        check_event_id(check_id).alias("event_id"),
        "platform",
        F.lit("destroy").alias("action"),
        F.lit(None).alias("duration_seconds"),
        F.lit(None).alias("resource_count"),
        F.to_json(body).alias("residual_resources"),
        status.alias("status"),
        checked_at.alias("created_at"),
    )
    return event.select(*[F.col(f.name).cast(f.dataType) for f in INFRA_SCHEMA.fields])


def event_items(pages: DataFrame, check_id: str) -> DataFrame:
    """All items of a check, whatever their number: event_id, platform, kind, page, items."""
    return pages.select(
        check_event_id(check_id).alias("event_id"), "platform", "kind", "page", "items"
    )
