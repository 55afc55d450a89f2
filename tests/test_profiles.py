import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronowatt.operators import joins, profiles, season, shares
from chronowatt.functions import numeric as N


def profile(spark, values, key="a"):
    return spark.createDataFrame([(key, h, float(v)) for h, v in enumerate(values)], "k string, h int, v double")


def test_plateau_and_contiguity(spark):
    row = profiles.plateau(profile(spark, [1, 9.8, 10, 9.7, 2]), ["k"], "h", "v", 0.97).first()
    assert (row.first_hour, row.last_hour, row.n_hours, row.contiguous) == (1, 3, 3, True)
    row = profiles.plateau(profile(spark, [10, 1, 10]), ["k"], "h", "v", 0.95).first()
    assert (row.n_hours, row.contiguous) == (2, False)


def test_peak_takes_the_earliest_tie(spark):
    p = profile(spark, [1, 7, 7, 1])
    assert profiles.peak(p, ["k"], "h", "v").first().peak_hour == 1
    assert profiles.trough(p, ["k"], "h", "v").first().trough_hour == 0


def test_half_height_mid(spark):
    row = profiles.half_height_mid(profile(spark, [0, 0, 4, 8, 4, 0]), ["k"], "h", "v").first()
    assert (row.rise, row.fall, row.mid) == (2.0, 4.0, 3.0)
    row = profiles.half_height_mid(profile(spark, [0, 3, 8, 6, 1]), ["k"], "h", "v").first()
    assert row.rise == pytest.approx(1.2) and row.fall == pytest.approx(3.4)
    assert profiles.half_height_mid(profile(spark, [8, 8, 8]), ["k"], "h", "v").first().mid is None


def test_lag_is_found_and_refined(spark):
    x = [math.sin(2 * math.pi * t / 24) + 0.1 * math.cos(t) for t in range(400)]
    a = spark.createDataFrame([(t, x[t]) for t in range(400)], "t bigint, a double")
    b = spark.createDataFrame([(t + 2, x[t]) for t in range(400)], "t bigint, b double")
    c = profiles.lag_correlations(a, b, "t", "a", "b")
    best = profiles.lag_optimum(c).first()
    assert best.best_lag == 2 and best.best_correlation == pytest.approx(1)
    assert abs(best.refined_lag - 2) < 0.2
    few = profiles.lag_correlations(a.limit(100), b.limit(100), "t", "a", "b")
    assert all(r.correlation is None for r in few.collect())


def test_lag_optimum_at_the_edge_is_not_refined(spark):
    c = spark.createDataFrame([(l, float(l)) for l in (-1, 0, 1)], "lag bigint, correlation double")
    assert profiles.lag_optimum(c).first().refined_lag == 1.0


def test_top_k_mean_and_winters(spark):
    days = [(2023, 12, 1, 5.0), (2023, 12, 2, 7.0), (2024, 1, 1, 7.0), (2024, 2, 1, 1.0), (2024, 12, 1, 9.0)]
    df = spark.createDataFrame(days, "y int, m int, d int, v double")
    assert {r.y: r.top_mean for r in season.top_k_mean(df, ["y"], "v", 2, ["m", "d"]).collect()} == {2023: 6.0, 2024: 8.0}
    order = df.withColumn("o", F.col("y") * 10000 + F.col("m") * 100 + F.col("d"))
    got = {r.winter: (r.n, r.maximum, r.month_of_max, r.complete) for r in season.winters(order, "y", "m", "v", 3, "o").collect()}
    assert got == {2023: (4, 7.0, 12, True), 2024: (1, 9.0, 12, False)}
    year = spark.createDataFrame(days + [(2024, 7, 1, 8.0), (2025, 7, 1, 20.0)], "y int, m int, d int, v double")
    gaps = season.summer_less_previous_winter(year, "y", "m", "v", 3).collect()
    assert [(r.y, r.gap) for r in gaps] == [(2024, 1.0)]  # an incomplete winter is not compared


def test_monotony(spark):
    up = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0)], "y int, v double")
    assert season.strictly_increasing(up, "y", "v").first().increasing is False
    assert season.strictly_increasing(up.filter("y < 3"), "y", "v").first().increasing is True


def test_strict_thresholds(spark):
    df = spark.createDataFrame([("a", 120.0), ("a", 120.1), ("a", 90.0)], "k string, v double")
    row = shares.exceedance(df, ["k"], "v", 120).first()
    assert (row.n_days, row.n_above) == (3, 1)
    assert shares.hours_above(df, ["k"], F.col("v"), {"n": 120}).first().n == 1


def test_counting_rules(spark):
    """Influence, season, validity and the strict level, as in the published counts."""
    rows = [
        ("Fond", "2020-06-01", True, 121.0), ("Fond", "2020-05-31", True, 300.0), ("Fond", "2022-08-31", True, 120.0),
        ("Fond", "2022-09-01", True, 300.0), ("Fond", "2020-07-01", False, 300.0), ("Trafic", "2020-07-02", True, 300.0),
        ("Fond", "2022-07-01", True, 80.0),
    ]
    df = spark.createDataFrame(rows, "influence string, d string, valide boolean, v double").withColumn("d", F.col("d").cast("date"))
    kept = df.filter(F.col("valide") & (F.col("influence") == "Fond") & F.month("d").isin(*season.AIR_SUMMER))
    row = shares.exceedance(kept.withColumn("y", F.year("d")), ["influence"], "v", 120, "y").first()
    assert (row.n_above, row.n_days, row.years) == (1, 3, "2020,2022")


def test_displayed_percent(spark):
    df = spark.createDataFrame([(9.2, 199.7), (47.96, 1085.88)], "p double, w double")
    assert [r[0] for r in df.select(N.displayed_percent("p", "w")).collect()] == [5, 4]


def test_ratio_of_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "p double, w double")
    assert df.select(N.percent("p", "w"), N.ratio("p", "w")).first() == (None, None)


def test_bands(spark):
    df = spark.createDataFrame([(24.9,), (25.0,), (34.9,), (35.0,)], "t double")
    band = shares.bands(F.col("t"), [(25, "low"), (30, "mid"), (35, "high")], "top")
    assert [r[0] for r in df.select(band).collect()] == ["low", "mid", "high", "top"]


def km(a, b):
    la, lo, lb, lp = map(np.radians, (a[1], a[2], b[1], b[2]))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2
    return 2 * 6371 * np.arcsin(np.sqrt(min(1, h)))


def places(spark, name, rows):
    return spark.createDataFrame(rows, f"{name} int, lat double, lon double")


@pytest.mark.parametrize("leaf", [1, 4, 1_000])
def test_nearest_k_equals_brute_force(spark, leaf):
    rng = random.Random(5)
    pts = [(i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(40)] + [(99, 0.0, 179.9), (98, 90.0, 0.0)]
    # a dense town beside the open country
    pts += [(200 + i, 48 + rng.uniform(-0.1, 0.1), 2 + rng.uniform(-0.1, 0.1)) for i in range(20)]
    tgt = [(100 + i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(30)] + [(999, 0.0, -179.9)]
    tgt += [(300 + i, 48 + rng.gauss(0, 0.01), 2 + rng.gauss(0, 0.01)) for i in range(60)]
    got = {}
    for r in joins.nearest_k(places(spark, "p", pts), places(spark, "t", tgt), "p", "t", 3, leaf).collect():
        got.setdefault(r.p, {})[r["rank"]] = r.t
    for a in pts:
        best = [b[0] for b in sorted(tgt, key=lambda b: km(a, b))[:3]]
        assert [got[a[0]][i] for i in (1, 2, 3)] == best


def test_nearest_k_with_too_few_targets_ties_and_no_position(spark):
    pts = [(1, 10.0, 10.0), (2, None, 10.0)]
    tgt = [(7, 10.0, 10.0), (5, 10.0, 10.0), (6, None, None)]
    got = joins.nearest_k(places(spark, "p", pts), places(spark, "t", tgt), "p", "t", 3).collect()
    assert sorted((r.p, r.t, r["rank"]) for r in got) == [(1, 5, 1), (1, 7, 2)]
    one = joins.nearest_k(places(spark, "p", pts), places(spark, "t", tgt), "p", "t", 1).collect()
    assert [(r.p, r.t) for r in one] == [(1, 5)]
    assert joins.nearest_k(places(spark, "p", pts), places(spark, "t", tgt).limit(0), "p", "t", 1).count() == 0


def test_pairs_grow_with_the_points_inside_one_degree(spark):
    rng = random.Random(8)
    per_point = []
    for n in (200, 3_200):
        pts, tgt = ([(i, 45 + rng.random(), 5 + rng.random()) for i in range(n)] for _ in range(2))
        pairs = joins.candidates(places(spark, "p", pts), places(spark, "t", tgt), "p", "t", 2)
        per_point.append(pairs.count() / n)
    assert max(per_point) < 120 and per_point[1] < 2 * per_point[0]


def test_reconcile(spark):
    a = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 5.0)], "k string, t int, v double")
    b = spark.createDataFrame([("s", 1, 1.5), ("s", 3, 9.0)], "k string, t int, v double")
    row = joins.reconcile(a, b, ["k", "t"], "v").first()
    assert (row.n, row.max_gap) == (1, 0.5)


def test_broadcast_only_after_counting(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(joins.broadcast_if_small(spark.range(10), limit=10))
    assert not hinted(joins.broadcast_if_small(spark.range(11), limit=10))
    wide = spark.createDataFrame([("x" * 5_000,)], "s string")
    assert hinted(joins.broadcast_if_small(wide, size=6_000)) and not hinted(joins.broadcast_if_small(wide, size=4_000))
