import math
from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from seriesweave.functions import numbers, predicates, text, times, variants


def one(spark, value, expr, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expr(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "value, leading, whole",
    [
        ("12", 12.0, 12.0),
        (" 12.5 ", 12.5, 12.5),
        ("12abc", 12.0, None),
        ("5\t", 5.0, 5.0),
        ("\r\n 1e2\x0b", 100.0, 100.0),
        ("abc", 0.0, None),
        ("-3e2x", -300.0, None),
        ("1e3", 1000.0, 1000.0),
        (".5", 0.5, 0.5),
        ("5.", 5.0, 5.0),
        ("5d", 5.0, None),
        ("5f", 5.0, None),
        ("0x1p3", 0.0, None),
        ("1_000", 1.0, 1000.0),
        ("inf", 0.0, math.inf),
        ("-Infinity", 0.0, -math.inf),
        ("on", 0.0, None),
        ("", 0.0, None),
    ],
)
def test_numbers_in_texts(spark, value, leading, whole):
    assert one(spark, value, numbers.leading_number) == leading
    assert one(spark, value, numbers.whole_number) == whole


def test_nan_is_a_whole_number_only(spark):
    assert math.isnan(one(spark, "nan", numbers.whole_number))
    assert one(spark, "nan", numbers.leading_number) == 0.0


@pytest.mark.parametrize(
    "value, expected",
    [(None, True), ("", True), ("  ", True), ("unavailable", True), (" Unknown ", True), ("1", False), ("\tunknown", False)],
)
def test_unavailable(spark, value, expected):
    assert one(spark, value, predicates.state_unavailable) is expected


@pytest.mark.parametrize("ts, expected", [(3599.9, 0), (3600.0, 3600), (-1.0, 0), (-3600.0, -3600), (-3601.0, -3600)])
def test_bucket_truncates(spark, ts, expected):
    assert one(spark, ts, lambda x: numbers.bucket(x, 3600), "double") == expected


@pytest.mark.parametrize("delta, expected", [(3600, None), (5400, None), (5401, 1), (7200, 1), (9000, 1), (12600, 3), (16200, 3)])
def test_missing_rows_round_half_to_even(spark, delta, expected):
    assert one(spark, float(delta), lambda x: numbers.missing_rows(F.lit(0.0), x, F.lit(3600)), "double") == expected


def test_falls_needs_a_tenth_and_no_nan(spark):
    def fell(cur, prev, mode):
        return one(spark, float(cur), lambda x: numbers.falls(x, F.lit(float(prev)), F.lit(mode)), "double")

    assert fell(8.9, 10, "total_increasing") and not fell(9.1, 10, "total_increasing")
    assert fell(9.1, 10, "any") and not fell(10, 10, "any")
    assert not fell(5, "nan", "any") and not fell("nan", 5, "any")


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2025-01-02T00:00:00+00:00", 1735776000.0),
        ("2025-01-02T00:00:00Z", 1735776000.0),
        ("20250102T000000Z", 1735776000.0),
        ("2025-01-02 02:00:00.5+02:00", 1735776000.5),
        ("2025-01-02 00:00:00", 1735776000.0),
        ("bogus", None),
    ],
)
def test_text_epoch(spark, value, expected):
    assert one(spark, value, times.text_epoch) == expected


def test_times_of_reset_marks(spark):
    assert one(spark, "2025-01-02T00:00:00+05:00", times.reset_epoch) == 1735776000.0
    assert one(spark, "bogus", times.reset_epoch) is None
    assert one(spark, "2025-01-02T05:00:00+05:00", times.reset_instant) == 1735776000.0
    assert one(spark, "2025-01-02T00:00:00", times.reset_instant) is None
    assert one(spark, "5", times.reset_instant) is None


def test_utc_text_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, "2025-01-02 00:00:00", times.text_epoch_utc) == 1735776000.0
        assert one(spark, "2025-01-02T00:00:00.9Z", times.text_epoch_utc) == 1735776000.0
        assert one(spark, "2025-01-02 00:00:00", times.text_epoch) == 1735776000.0 + 5 * 3600
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "x, expected",
    [(1.0, "1.0"), (12345678.9, "12345678.9"), (1e7, "10000000.0"), (1e15, "1000000000000000.0"), (1e16, "1.0E16"), (0.001, "0.001"), (0.00012, "0.00012"), (-2.5e9, "-2500000000.0")],
)
def test_number_text(spark, x, expected):
    assert one(spark, x, text.number_text, "double") == expected


@pytest.mark.parametrize(
    "old, new, expected",
    [(1.0, 1.5, "1.0 -> 1.5 (+0.5)"), (2.0, None, "2.0 -> (none)"), (None, 3.0, "(none) -> 3.0"), (5.0, 2.0, "5.0 -> 2.0 (-3)"), (1.0, 1.0000001, "1.0 -> 1.0000001 (+0)")],
)
def test_change_text(spark, old, new, expected):
    df = spark.createDataFrame([(old, new)], "o double, n double")
    cell = text.change_text(text.number_text(F.col("o")), text.number_text(F.col("n")), F.col("n") - F.col("o"))
    assert df.select(cell).first()[0] == expected


@pytest.mark.parametrize(
    "json, expected",
    [
        ('{"capabilities":{"state_class":"total"},"state_class":"measurement"}', "total"),
        ('{"capabilities":{"state_class":""},"state_class":"measurement"}', "measurement"),
        ('{"capabilities":[],"state_class":5,"original_state_class":"total_increasing"}', "total_increasing"),
        ('{"capabilities":null}', None),
    ],
)
def test_state_class(spark, json, expected):
    assert one(spark, json, lambda x: variants.state_class(F.parse_json(x))) == expected


@pytest.mark.parametrize("json, depth", [("1", 0), ("{}", 1), ('{"a":{"b":[1]}}', 3), ('{"a":"}}{{[["}', 1), ('{"a":"\\"{"}', 1)])
def test_nesting(spark, json, depth):
    assert one(spark, json, variants.nesting) == depth


def test_large_decimals_are_compared_with_their_places(spark):
    pairs = [("9007199254740993.25", "9007199254740993.40", False), ("9007199254740993.50", "9007199254740993.5", True),
             ("9007199254740993.0", "9007199254740993", True), ("9007199254740993", "9007199254740992", False), ("1e16", "10000000000000000", True), ("0.10", "0.1", True)]
    rows = spark.createDataFrame(pairs, "a string, b string, same boolean").selectExpr("same", "parse_json(a) a", "parse_json(b) b")
    key = lambda c: variants.compare_key(F.col(c), F.schema_of_variant(c))
    assert all(r.same == r.found for r in rows.select("same", key("a").eqNullSafe(key("b")).alias("found")).collect())


@pytest.mark.parametrize("session", ["UTC", "Asia/Tokyo"])
def test_local_times_of_named_zones(spark, session):
    """Against zoneinfo, over a year with both changes of the clocks, whatever the session's zone is."""
    texts = [f"2024-{month:02d}-{day:02d}T{hour:02d}:30:00" for month, day in ((1, 5), (3, 10), (3, 31), (7, 1), (10, 27), (11, 3)) for hour in (0, 1, 4, 13)]
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        for zone in ("America/New_York", "Europe/Berlin", "Asia/Kolkata", "UTC"):
            rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", times.text_epoch(F.col("x"), zone).alias("y")).collect()
            assert all(r.y == datetime.fromisoformat(r.x).replace(tzinfo=ZoneInfo(zone)).timestamp() for r in rows)
        assert one(spark, "2024-01-05T12:00:00+02:00", lambda c: times.text_epoch(c, "America/New_York")) == 1704448800.0
        assert one(spark, "2024-01-05 12:00:00.25", lambda c: times.text_epoch(c, "UTC")) == 1704456000.25
        assert one(spark, "not a time", lambda c: times.text_epoch(c, "UTC")) is None
        local = one(spark, "2024-01-05T12:00:00", times.text_epoch)
        assert local == datetime(2024, 1, 5, 12, tzinfo=ZoneInfo(session)).timestamp()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
