import pytest
from pyspark.sql import functions as F

from chronowatt.operators import coverage, quality
from chronowatt.operators.quality import Guard, GuardError


def test_guards_in_one_pass(spark):
    df = spark.createDataFrame([(1, 2.0), (2, -1.0), (3, None)], "id int, v double")
    guards = [Guard("negative", F.col("v") < 0), Guard("missing", F.col("v").isNull())]
    assert quality.guard_counts(df, guards).first().asDict() == {"n_rows": 3, "negative": 1, "missing": 1}
    with pytest.raises(GuardError, match="negative"):
        quality.check_rows(df, guards, "t")
    assert quality.check_rows(df.filter("v > 0"), guards, "t") == 1
    with pytest.raises(GuardError, match="no row"):
        quality.check_rows(df.filter("false"), guards, "t")


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, t int")
    assert [tuple(r) for r in quality.duplicates(df, ["k", "t"]).collect()] == [("a", 1, 2)]
    assert quality.duplicates(df.distinct(), ["k", "t"]).isEmpty()


def test_part_above_whole_is_judged_by_group(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 5.0, 1.0), ("b", 1.0, 2.0)], "g string, w double, p double")
    assert [r.g for r in quality.part_above_whole(df, ["g"], "w", "p").collect()] == ["b"]


def test_incomplete_year(spark):
    whole = [(2020, m) for m in range(1, 13)]
    df = spark.createDataFrame(whole + [(2021, m) for m in range(1, 4)], "y int, m int")
    assert [tuple(r) for r in quality.incomplete_years(df, "y", "m").collect()] == [(2021, 3)]


def test_grid_regularity(spark):
    df = spark.createDataFrame([(h,) for h in (5, 6, 8)], "h bigint")
    row = quality.grid_regularity(df, F.col("h")).first()
    assert (row.n_hours, row.n_expected, row.regular) == (3, 4, False)


def test_hollow_days_by_series_and_place(spark):
    rows = [("a", f"2024-01-0{d}", h) for d in (1, 2, 3) for h in range(24) if not (d == 2 and h < 5) and not (d == 3 and h > 20)]
    rows += [("b", "2024-01-02", h) for h in range(23)]  # 23 hours are enough
    df = spark.createDataFrame(rows, "k string, d string, h int")
    got = sorted((r.k, r.d, r.n_hours, r.at_edge) for r in quality.hollow_days(df, ["k"], "d", "h").collect())
    assert got == [("a", "2024-01-02", 19, False), ("a", "2024-01-03", 21, True)]


def test_trim_edges(spark):
    df = spark.createDataFrame([(d,) for d in (1, 1, 2, 3, 4)], "d int")
    assert sorted(r.d for r in quality.trim_edge_days(df, "d").collect()) == [2, 3]


def test_code_guard(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "code string")
    assert {r.code for r in quality.unknown_codes(df, "code", ["x"]).collect()} == {"y", None}
    mapping = spark.createDataFrame([("x", "X")], "code string, category string")
    mapped, unmapped = quality.map_codes(df.filter("code is not null"), mapping, "code", "category")
    assert {r.code: r.category for r in mapped.collect()} == {"x": "X", "y": None}
    assert [r.code for r in unmapped.collect()] == ["y"]


def test_misaligned_and_missing(spark):
    both = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3)], "k string, y int")
    got = {(r.y, r.side) for r in quality.misaligned(both, "y", F.col("k") == "a", F.col("k") == "b").collect()}
    assert got == {(1, "left_only"), (3, "right_only")}
    a = spark.createDataFrame([(1,), (2,)], "y int")
    b = spark.createDataFrame([(2,), (2,), (3,), (3,)], "y int")
    assert [r.y for r in quality.missing_expected(a, b, ["y"]).collect()] == [1]
    assert [r.y for r in quality.orphans(b, a, ["y"]).collect()] == [3, 3]
    assert tuple(quality.orphan_counts(a, b, ["y"]).first()) == (1, 2)


def test_table_difference_sets_and_bags(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,)], "x int")
    assert quality.table_difference(a, b).isEmpty()
    assert [tuple(r) for r in quality.table_difference(a, b, multiset=True).collect()] == [(1, "left")]


def test_changed_fields(spark):
    d = spark.createDataFrame([("a", 1, None), ("b", 1, "u")], "id string, x int, u string")
    r = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("c", 1, "w")], "id string, x int, u string")
    got = {x.id: (x.presence, x.changed) for x in quality.changed_fields(d, r, ["id"], ["x", "u"]).collect()}
    assert got == {"b": ("both", ["x", "u"]), "c": ("recorded_only", ["x", "u"])}


def test_claims(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "y int, v double")
    statements = {"low": F.max("v") < 5, "single": F.count("*") == 1}
    assert {r["name"]: r.ok for r in quality.claims(df, statements).collect()} == {"low": True, "single": False}
    with pytest.raises(GuardError, match="single"):
        quality.check_claims(df, statements, "figure")
    quality.check_claims(df, {"low": F.max("v") < 5}, "figure")
    with pytest.raises(GuardError):
        quality.check_claims(df.filter("false"), {"low": F.max("v") < 5}, "figure")  # NULL is not true


# ---- coverage: a sound window has no anomaly, and each removal has its own -----------------------------

O3 = ["S1", "S2", "S3", "S4", "S5", "S6"]
NO2 = ["S1", "S2", "S3", "S4", "S5"]
YEARS = range(2020, 2026)


def coverage_tables(spark, drop_series=lambda p, s, y: False, drop_daily=lambda s, y, d: False, drop_cross=()):
    opened = {"S6": 2024}
    series = [(p, s, y) for p, st in (("O3", O3), ("NO2", NO2)) for s in st for y in YEARS if y >= opened.get(s, 0) and not drop_series(p, s, y)]
    daily = [(s, y) for s in O3 for y in YEARS if y >= opened.get(s, 0) for d in range(92) if not drop_daily(s, y, d)]
    expected = [(p, s, opened.get(s, 2020), 2025) for p, st in (("O3", O3), ("NO2", NO2)) for s in st]
    frames = (
        spark.createDataFrame(daily, "station string, year int"),
        spark.createDataFrame(series, "pollutant string, station string, year int"),
        spark.createDataFrame([(y,) for y in YEARS if y not in drop_cross], "year int"),
        spark.createDataFrame([(y,) for y in YEARS], "year int"),
        spark.createDataFrame(expected, "pollutant string, station string, first_year int, last_year int"),
    )
    return sorted(tuple(r) for r in coverage.audit_air(*frames).collect())


def test_sound_coverage(spark):
    assert coverage_tables(spark) == []


def test_series_absent_for_one_pollutant(spark):
    assert coverage_tables(spark, drop_series=lambda p, s, y: (p, s) == ("NO2", "S5")) == [("absent", "NO2/S5", "")]


def test_last_year_lost(spark):
    got = coverage_tables(spark, drop_series=lambda p, s, y: (p, s, y) == ("O3", "S6", 2025))
    assert got == [("early_stop", "O3/S6", "2024")]


def test_interruption_and_late_start(spark):
    got = coverage_tables(spark, drop_series=lambda p, s, y: p == "O3" and (s, y) in (("S1", 2022), ("S2", 2020)))
    assert ("interrupted", "O3/S1", "1") in got and ("late_start", "O3/S2", "2021") in got
    assert ("floor_O3", "2022", "4") in got


def test_daily_table_loses_a_station_year(spark):
    got = coverage_tables(spark, drop_daily=lambda s, y, d: (s, y) == ("S6", 2025))
    assert got == [("daily_early_stop", "S6", "2024")]


def test_thin_summer_and_crossing(spark):
    got = coverage_tables(spark, drop_daily=lambda s, y, d: (s, y) == ("S3", 2023) and d < 40, drop_cross=(2021,))
    assert got == [("crossing_empty_year", "2021", "0"), ("days_floor", "2023/S3", "52")]


def test_empty_year(spark):
    got = coverage_tables(spark, drop_daily=lambda s, y, d: y == 2025)
    assert ("empty_year", "2025", "0") in got and ("station_floor", "2025", "0") in got


def test_absence_is_not_divergence(spark):
    declared = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "k string, v string")
    observed = spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "y")], "k string, v string")
    got = {r.k: r.status for r in coverage.attribute_conflicts(declared, observed, "k", "v").collect()}
    assert got == {"a": "same", "b": "conflict", "c": "not_observed", "d": "not_declared"}


def test_version_opened_inside_the_window(spark):
    ref = spark.sql("select * from values ('a', date'2019-05-01'), ('b', date'2022-05-01') t(code, opened)")
    first, last = (F.lit(d).cast("date") for d in ("2020-06-01", "2025-08-31"))
    assert [r.code for r in coverage.versions_opened_inside(ref, "opened", first, last).collect()] == ["b"]


def test_unexpected_series_is_audited(spark):
    observed = spark.createDataFrame([("a", 2020), ("a", 2021), ("b", 2020), ("b", 2022)], "s string, y bigint")
    expected = spark.createDataFrame([("a", 2020, 2021)], "s string, first bigint, last bigint")
    found = coverage.continuity(observed, expected, ["s"], "y", "first", "last")
    assert sorted(tuple(r) for r in found.collect()) == [("interrupted", "b", "1"), ("not_expected", "b", "")]
