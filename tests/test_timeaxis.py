import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronowatt.functions import geo, timeaxis as T

ANCHORS = [  # local label, UTC
    ("2024-01-15 12:00:00", "2024-01-15 11:00:00"),
    ("2024-07-15 12:00:00", "2024-07-15 10:00:00"),
    ("2024-07-16 01:00:00", "2024-07-15 23:00:00"),
    ("2024-03-31 03:00:00", "2024-03-31 01:00:00"),
]


def labels(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))


def one(df, col):
    return [r[0] for r in df.select(col.cast("string")).collect()]


def test_anchors_in_any_session_zone(spark, session_zone):
    for local, utc in ANCHORS:
        assert one(labels(spark, utc), T.utc_to_local("t")) == [local]
        assert one(labels(spark, local), T.local_to_utc("t")) == [utc]


def test_fold_and_gap_in_any_session_zone(spark, session_zone):
    fold = labels(spark, "2024-10-27 02:00:00")
    assert one(fold, T.local_to_utc("t")) == ["2024-10-27 01:00:00"]
    assert one(fold, T.local_to_utc("t", fold="earlier")) == ["2024-10-27 00:00:00"]
    gap = labels(spark, "2024-03-31 02:00:00", "2024-03-31 01:00:00", "2024-10-27 02:00:00")
    assert [r[0] for r in gap.select(T.is_phantom("t")).collect()] == [True, False, False]
    assert [r[0] for r in gap.select(T.is_ambiguous("t")).collect()] == [False, False, True]


def test_indexes_round_trip_before_1970(spark, session_zone):
    df = labels(spark, "1969-12-31 23:30:00", "2024-05-06 07:08:09")
    assert [r[0] for r in df.select(T.hour_index("t")).collect()][0] == -1
    assert one(df, T.from_hour_index(T.hour_index("t"))) == ["1969-12-31 23:00:00", "2024-05-06 07:00:00"]
    assert one(df, T.from_minute_index(T.minute_index("t"))) == ["1969-12-31 23:30:00", "2024-05-06 07:08:00"]
    assert one(df, T.floor_hour("t")) == ["1969-12-31 23:00:00", "2024-05-06 07:00:00"]
    assert one(df, T.floor_minutes("t", 15)) == ["1969-12-31 23:30:00", "2024-05-06 07:00:00"]


def test_hours_crossed_counts_boundaries(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:59:00' a, timestamp_ntz'2024-01-01 01:01:00' b")
    assert df.select(T.hours_crossed("a", "b")).first()[0] == 1


def test_clock_change_sundays(spark):
    df = spark.createDataFrame([(y,) for y in range(2020, 2025)], "y int")
    for month in (3, 10):
        for y, d in df.select("y", T.last_sunday("y", month)).collect():
            assert d.weekday() == 6 and d.month == month and (d + dt.timedelta(days=7)).month != month


def test_zoned_instant_is_session_independent(spark, session_zone):
    df = spark.createDataFrame([("2024-07-01T00:30:00+02:00",)], "s string").select(F.col("s").cast("timestamp").alias("t"))
    assert one(df, T.instant_to_utc("t")) == ["2024-06-30 22:30:00"]


def test_unknown_fold_is_refused():
    with pytest.raises(ValueError):
        T.local_to_utc(F.lit(None), fold="both")


def test_haversine_and_noon(spark):
    paris, rome = (48.8566, 2.3522), (41.9028, 12.4964)
    km = spark.range(1).select(geo.haversine_km(*[F.lit(x) for x in (*paris, *rome)])).first()[0]
    assert km == pytest.approx(1105.7, abs=1.5)
    noon = spark.sql("select date'2024-02-11' d").select(geo.solar_noon_utc_hours(F.col("d"), 0.0)).first()[0]
    assert noon == pytest.approx(12 + 14.2 / 60, abs=0.02)


def test_winter_vintage(spark):
    df = spark.createDataFrame([(2023, 12), (2024, 1), (2024, 2)], "y int, m int")
    assert [r[0] for r in df.select(T.winter_vintage("y", "m")).collect()] == [2023, 2023, 2023]


def test_freshness_bounds(spark):
    df = spark.createDataFrame([(12.0,), (12.1,), (24.0,), (24.1,)], "a double")
    assert [r[0] for r in df.select(T.freshness(F.col("a"))).collect()] == ["fresh", "warn", "warn", "stale"]


def test_age_and_offset_across_a_clock_change(spark, session_zone):
    df = labels(spark, "2024-03-31 01:30:00", "2024-01-01 00:00:00")
    ages = [r[0] for r in df.select(T.as_of_age_hours("t", "2024-07-01 00:00:00")).collect()]
    assert ages == pytest.approx([2206.5, 4368.0])
    grid = spark.range(24).select(T.plus_hours(F.lit("2024-03-31").cast("timestamp_ntz"), F.col("id")).alias("t"))
    assert [r[0] for r in grid.select(T.utc_offset_hours("t")).collect()] == [1.0] + [2.0] * 23
