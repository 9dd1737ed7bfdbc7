import pytest

from seriesweave.llm import tables


@pytest.mark.parametrize("text, size", [("64m", 64 << 20), ("1g", 1 << 30), ("262144b", 262144), ("17", 17), ("8MB", 8 << 20), (" 4k ", 4096)])
def test_sizes_as_spark_writes_them(text, size):
    assert tables.size_in_bytes(text) == size


@pytest.mark.parametrize("before, after", [("64m", str(tables.BATCH_BYTES)), ("8m", "8m"), ("1gb", str(tables.BATCH_BYTES))])
def test_batches_are_lowered_only(spark, before, after):
    spark.conf.set(tables.BATCH, before)
    try:
        tables.small_batches(spark)
        assert spark.conf.get(tables.BATCH) == after
    finally:
        spark.conf.unset(tables.BATCH)
