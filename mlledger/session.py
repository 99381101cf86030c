"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cpus: str = "8", app: str = "mlledger", folder: str | None = None
) -> SparkSession:
    """A local session for tests and the bench; a cluster job brings its own.

    folder: where checkpoints and intermediate tables go; by default a temporary one.
    """
    root = folder or tempfile.mkdtemp(prefix="mlledger-")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", root)
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in spark.checkpoint.dir.

    Only a session whose tasks run in the driver's own process gets a temporary folder if it has
    none; a cluster may name no folder of a single machine.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="mlledger-"))
    return sc.getCheckpointDir()


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call returns."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows outlive lost executors and are computed once."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints, also those of iterative training, go to the shared folder."""
    root = shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
