import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from seriesweave import schema  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        # Compiling takes longer than running on a handful of rows.
        .config("spark.sql.codegen.wholeStage", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


def _rows(fields, rows):
    """Dicts with only the interesting fields to complete tuples."""
    return [tuple(r.get(f) for f in fields) for r in rows]


@pytest.fixture(scope="session")
def states(spark):
    """states((series, ts, state[, attrs]), ...) as a canonical frame; row ids in given order."""

    def make(*rows):
        data = [
            {"series_id": r[0], "ts": None if r[1] is None else float(r[1]), "state": r[2], "row_id": i, "attrs": r[3] if len(r) > 3 else None}
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(_rows(schema.STATES.fieldNames(), data), schema.STATES)

    return make


@pytest.fixture(scope="session")
def statistics(spark):
    """statistics([dict(series_id, start_ts, ...)], table) as a canonical frame."""

    def make(rows, table="statistics"):
        data = []
        for i, r in enumerate(rows):
            row = {"table": table, "interval_s": schema.INTERVALS[table], "row_id": i, "series_id": "sensor.old", **r}
            data.append({k: float(v) if isinstance(v, int) and k not in ("interval_s", "row_id") else v for k, v in row.items()})
        return spark.createDataFrame(_rows(schema.STATISTICS.fieldNames(), data), schema.STATISTICS)

    return make


@pytest.fixture(scope="session")
def pairs(spark):
    def make(kind="total_increasing", zero=False, old="sensor.old", new="sensor.new"):
        return spark.createDataFrame([(old, new, kind, zero)], schema.REPLACEMENTS)

    return make
