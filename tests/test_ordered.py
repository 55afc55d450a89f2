import random

from pyspark.sql import Window, functions as F

from chronowatt.operators import ordered


def stream(spark, n=400, seed=1):
    """One key owns most rows; ties in time are told apart by id."""
    rng = random.Random(seed)
    rows = [
        ("hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", rng.randrange(120), i, rng.choice([None, "a", "b"]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "k string, t int, id int, v string")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_lag_equals_plain_window(spark):
    df = stream(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    expected = df.withColumn("p", F.lag(F.struct("v", "t")).over(w))
    for width in (1, 7, 1000):
        got = ordered.lag_of(df, ["k"], ["t", "id"], F.floor(F.col("t") / width), ["v", "t"], "p")
        assert rows(got, "id", "p") == rows(expected, "id", "p")


def test_lead_equals_plain_window(spark):
    df = stream(spark, seed=2)
    w = Window.partitionBy("k").orderBy("t", "id")
    expected = df.withColumn("p", F.lead(F.struct("v", "t")).over(w))
    got = ordered.lead_of(df, ["k"], ["t", "id"], F.floor(F.col("t") / 5), ["v", "t"], "p")
    assert rows(got, "id", "p") == rows(expected, "id", "p")


def test_carry_last_ignores_nulls_across_buckets(spark):
    df = stream(spark, seed=3)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.withColumn("p", F.last("v", ignorenulls=True).over(w))
    got = ordered.carry_last(df, ["k"], ["t", "id"], F.floor(F.col("t") / 3), F.col("v"), "p")
    assert rows(got, "id", "p") == rows(expected, "id", "p")


def test_runs_equal_islands(spark):
    df = stream(spark, seed=4).fillna("z", ["v"])
    got = ordered.runs(df, ["k"], ["t", "id"], F.floor(F.col("t") / 4), F.col("prev.v") == F.col("v"), ["v"])
    sizes = sorted(r["count"] for r in got.groupBy("k", "run_start").count().collect())
    by_key = {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.t, r.id)):
        by_key.setdefault(r.k, []).append(r.v)
    brute = []
    for values in by_key.values():
        length = 0
        for i, v in enumerate(values):
            length = length + 1 if i and values[i - 1] == v else 1
            if i + 1 == len(values) or values[i + 1] != v:
                brute.append(length)
    assert sizes == sorted(brute)


def test_asof_join_equals_brute_force(spark):
    facts = stream(spark, seed=5).groupBy("k", "t").agg(F.max("id").alias("id"))
    probes = stream(spark, seed=6).select("k", "t", F.col("id").alias("probe"))
    got = ordered.asof_join(probes, facts, ["k"], "t", "t", lambda t: F.floor(t / 6), ["id", "t"])
    by_key = {}
    for r in facts.collect():
        by_key.setdefault(r.k, []).append((r.t, r.id))
    result = {r.probe: (r.found.id if r.found else None) for r in got.collect()}
    assert len(result) == 400
    for p in probes.collect():
        before = [f for f in by_key.get(p.k, []) if f[0] <= p.t]
        assert result[p.probe] == (max(before)[1] if before else None)


def test_hot_key_is_spread(spark):
    """No window over raw rows is partitioned by the key alone."""
    df = stream(spark)
    got = ordered.lag_of(df, ["k"], ["t", "id"], F.floor(F.col("t") / 5), ["v"], "p")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "__near" in line]
    assert windows and all("__bucket" in line for line in windows)


def test_bucket_width_follows_the_busiest_hour(spark):
    rows = [("hot", f"2026-01-01 00:{m:02d}:00") for m in range(60)] * 10 + [("cold", "2026-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert ordered.bucket_seconds(df, ["k"], "t", target_rows=600) == 3600
    assert ordered.bucket_seconds(df, ["k"], "t", target_rows=1800) == 3 * 3600
    assert ordered.bucket_seconds(df, ["k"], "t", target_rows=10) == 60
    assert ordered.bucket_seconds(df.filter("false"), ["k"], "t", target_rows=10) == 36000


def brute_sizes(df):
    """(key, value, size) of every run in the order of time."""
    by_key = {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.t, r.id)):
        by_key.setdefault(r.k, []).append((r.v, r.id))
    out = []
    for k, values in by_key.items():
        for i, (v, weight) in enumerate(values):
            if i and values[i - 1][0] == v:
                out[-1][2] += 1
                out[-1][3] += weight
            else:
                out.append([k, v, 1, weight])
    return out


def test_run_sizes_equal_islands_for_any_bucket(spark):
    df = stream(spark, seed=4).fillna("z", ["v"])
    found = brute_sizes(df)
    want = {}
    for k, v, size, weight in found:
        n, total = want.get((k, v, size), (0, 0))
        want[k, v, size] = n + 1, total + weight
    for width in (1, 2, 4, 30, 1000):
        got = ordered.run_sizes(
            df, ["k"], ["t", "id"], F.floor(F.col("t") / width), F.col("prev.v") == F.col("v"), ["v"], {"value": F.col("v")},
            sums={"ids": F.col("id")},
        )
        assert {(r.k, r.value, r.size): (r.n, r.ids) for r in got.collect()} == want, width


def test_run_sizes_with_gaps_and_weights(spark):
    """A run also ends where time is interrupted; the size is a sum."""
    rng = random.Random(9)
    times = sorted(rng.sample(range(300), 200))
    rows_ = [("a", t, rng.choice([0, 0, 1])) for t in times]
    df = spark.createDataFrame(rows_, "k string, t int, v int")
    same = (F.col("prev.v") == F.col("v")) & (F.col("prev.t") == F.col("t") - 1)
    want, last = [], None
    for _, t, v in rows_:
        if last == (t - 1, v):
            want[-1][1] += 10
        else:
            want.append([v, 10])
        last = (t, v)
    got = ordered.run_sizes(df, ["k"], ["t"], F.floor(F.col("t") / 16), same, ["v", "t"], {"v": F.col("v")}, size=F.lit(10))
    assert sorted((r.v, r.size) for r in got.collect() for _ in range(r.n)) == sorted(map(tuple, want))


def test_run_sizes_take_two_shuffles(spark):
    df = stream(spark, seed=4)
    got = ordered.run_sizes(df, ["k"], ["t"], F.floor(F.col("t") / 4), F.col("prev.v").eqNullSafe(F.col("v")), ["v"], {"v": F.col("v")})
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Join" not in plan
    assert ordered.run_sizes(df.limit(0), ["k"], ["t"], F.col("t"), F.col("prev.v") == F.col("v"), ["v"], {"v": F.col("v")}).count() == 0


def test_around_equals_plain_windows(spark):
    df = stream(spark, seed=12)
    w = Window.partitionBy("k").orderBy("t", "id")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "id", F.lag(F.struct("v", "t")).over(w).alias("prev"), F.lead(F.struct("v", "t")).over(w).alias("next"),
        F.last("v", ignorenulls=True).over(so_far).alias("known"), F.last(F.when(F.col("id") % 7 == 0, F.col("id")), ignorenulls=True).over(so_far).alias("seventh"),
    )
    for width in (1, 6, 1000):
        got = ordered.around(
            df, ["k"], ["t", "id"], F.floor(F.col("t") / width), ["v", "t"], {"known": F.col("v"), "seventh": F.when(F.col("id") % 7 == 0, F.col("id"))}
        )
        assert got.columns == [*df.columns, "prev", "next", "known", "seventh"]
        assert rows(got, "id", "prev", "next", "known", "seventh") == rows(want, "id", "prev", "next", "known", "seventh"), width
    assert ordered.around(df.limit(0), ["k"], ["t"], F.col("t"), ["v"]).count() == 0


def test_around_shuffles_rows_once(spark):
    df = stream(spark, seed=12)
    got = ordered.around(df, ["k"], ["t", "id"], F.floor(F.col("t") / 5), ["v"], {"known": F.col("v")})
    got.collect()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    raw = [line for line in plan.splitlines() if "Window [" in line and "__near" in line]
    assert raw and all("__bucket" in line for line in raw)
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # rows by (key, bucket), ends by (key, bucket) as partial aggregates, ends by key and back
    assert final.count("Exchange hashpartitioning") - final.count("ReusedExchange") <= 4


def test_numbered_counts_over_all_ranges(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("x"), F.lit("z").alias("other")).repartition(7)
    got = ordered.numbered(df, ["x"], "no")
    assert got.columns == ["x", "other", "no"]
    assert sorted((r.x, r.no) for r in got.collect()) == [(x, x + 1) for x in range(5_000)]
    assert ordered.numbered(df.limit(0), ["x"]).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("__part" in line for line in plan.splitlines() if "Window [" in line)
