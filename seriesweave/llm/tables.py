"""Reading the tables, and cutting lineage in the folder all machines share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 16 << 20


def size_in_bytes(text: str) -> int:
    """A size as Spark's settings write it: `64m`, `1g`, `262144b`; bytes without a unit."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << (10 * " kmgtp".index(unit or " "))


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Hand texts to Python at most `most` bytes at a time, so that a task's memory does not grow with their length.

    A session that asks for less is left as it is.
    """
    if not 0 < size_in_bytes(spark.conf.get(BATCH)) <= most:
        spark.conf.set(BATCH, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.conf.get("spark.master", "").startswith("local["):
        folder = _of_local_session(spark.conf.get("spark.app.id", ""))
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder.rstrip("/")


@functools.cache
def _of_local_session(app: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="seriesweave-")


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder below the shared one that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table in the shared folder: its later readers do not run its plan again."""
    place = new_dir(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
