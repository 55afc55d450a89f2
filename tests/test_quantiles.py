import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronowatt.operators import quantiles
from chronowatt.operators.quantiles import exact_quantiles, small_group_quantiles

PROBS = {"lo": 0.0, "q1": 0.25, "med": 0.5, "q9": 0.9, "hi": 1.0}


def data(spark, n, distinct, seed):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("ab"), float(rng.randrange(distinct)) / 7) for _ in range(n)]
    return spark.createDataFrame(rows + [("a", None)], "g string, x double")


@pytest.mark.parametrize("n,distinct,bins", [(500, 5, 8), (3000, 2000, 16), (40, 1000, 128), (2000, 3, 128)])
def test_exact_whatever_the_bins(spark, n, distinct, bins):
    df = data(spark, n, distinct, n)
    by_group = {}
    for g, x in df.filter("x is not null").collect():
        by_group.setdefault(g, []).append(x)
    for accuracy, limit in ((10, 4), (10_000, 50), (10_000, 10**6)):
        got = {r.g: r for r in exact_quantiles(df, ["g"], "x", PROBS, bins=bins, accuracy=accuracy, limit=limit).collect()}
        assert set(got) == set(by_group)
        for g, values in by_group.items():
            assert got[g].n == len(values)
            for name, p in PROBS.items():
                assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_agrees_with_builtin(spark):
    df = data(spark, 1000, 400, 9).filter(F.col("x").isNotNull())
    a = {r.g: r.med for r in exact_quantiles(df, ["g"], "x", {"med": 0.5}).collect()}
    b = {r.g: r.med for r in small_group_quantiles(df, ["g"], "x", {"med": 0.5}).collect()}
    assert a == pytest.approx(b)


def test_one_value(spark):
    df = spark.createDataFrame([("a", 3.0)], "g string, x double")
    row = exact_quantiles(df, ["g"], "x", {"m": 0.3}).first()
    assert (row.n, row.m) == (1, 3.0)


def test_bins_are_bounded_whatever_the_group(spark, monkeypatch):
    """A group of 20,000 distinct values with a few huge ones: no bin that is put in order holds more than the limit."""
    df = spark.range(20_000).select(F.lit("hot").alias("g"), F.pow("id", F.lit(3.0)).alias("x"))
    df = df.unionByName(spark.range(30).select(F.lit("cold").alias("g"), F.col("id").cast("double").alias("x")))
    rounds = []
    real = quantiles.cut_lineage

    def kept(d):
        rounds.append(real(d))
        return rounds[-1]

    monkeypatch.setattr(quantiles, "cut_lineage", kept)
    got = {r.g: r for r in exact_quantiles(df, ["g"], "x", PROBS, bins=16, limit=100).collect()}
    assert got["hot"].med == pytest.approx(np.quantile(np.arange(20_000.0) ** 3, 0.5), rel=1e-12) and got["cold"].med == 14.5
    assert 2 <= len(rounds) <= 4
    assert max(r["count"] for r in rounds[-1].groupBy("g", "__bin").count().collect()) <= 100
    # after the first round only the bins with wanted ranks are left
    assert rounds[0].filter("g = 'hot'").count() < 20_000 * 6 / 16 * 1.2


def test_extreme_values_and_empty_groups(spark):
    values = [-1e308, 1e308, 0.0, -0.5, 5e-324, 3.0, 3.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "g string, x double")
    (row,) = exact_quantiles(df, ["g"], "x", {"m": 0.5, "lo": 0.0, "hi": 1.0}, bins=2, limit=1).collect()
    assert (row.n, row.m, row.lo, row.hi) == (7, 5e-324, -1e308, 1e308)
    assert exact_quantiles(df.limit(0), ["g"], "x", {"m": 0.5}).count() == 0
