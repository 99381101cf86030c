from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from mlledger.schemas import FEATURES, ROW_ID, RUN_SCHEMA, TARGET  # noqa: E402
from mlledger.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sample(spark):
    """200 rows whose target a model can learn."""
    import numpy as np

    rng = np.random.default_rng(7)
    features = rng.standard_normal((200, len(FEATURES)))
    target = 2 * features[:, 0] + rng.normal(0, 0.1, 200)
    rows = [
        (i, *[float(v) for v in features[i]], float(target[i])) for i in range(len(features))
    ]
    return spark.createDataFrame(rows, [ROW_ID, *FEATURES, TARGET]).persist()


_DEFAULTS = {
    "run_id": "r1",
    "platform": "vertex",
    "tier": "A",
    "unification_unit": "container",
    "stage": "train",
    "status": "success",
    "attempt": 1,
    "duration_seconds": 1.0,
    "failure_class": "none",
    "error_excerpt": None,
    "code_revision": "a" * 40,
    "write_path": "direct",
    "metrics": "{}",
    "params": "{}",
    "created_at": "2026-08-01 10:00:00",
}


@pytest.fixture(scope="session")
def make_runs(spark):
    """Ledger rows from partial dicts; created_at is text."""

    def build(*rows: dict):
        schema = ", ".join(
            f"{f.name} {'string' if f.name == 'created_at' else f.dataType.simpleString()}"
            for f in RUN_SCHEMA.fields
        )
        full = [tuple({**_DEFAULTS, **r}[f.name] for f in RUN_SCHEMA.fields) for r in rows]
        df = spark.createDataFrame(full, schema)
        return df.withColumn("created_at", df["created_at"].cast("timestamp"))

    return build


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
