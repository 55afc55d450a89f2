"""The feed: any order of snapshot files gives the table of the batch form; nothing late is lost."""

import itertools
from datetime import date

import pytest
from pyspark.sql import functions as F

from chronowatt.streaming import snapshots as S

SCHEMA = "series string, ts timestamp, value double, taken timestamp"
START = 1_700_000_000 // 86_400 * 86_400


def snapshot(spark, first, last, taken, offset=0.0):
    """Quarter-hours of two series between two steps of the feed, as read at day ``taken``."""
    return spark.range(first, last).select(
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("series"),
        F.timestamp_seconds(F.lit(START) + F.col("id") * 900).alias("ts"),
        (F.col("id") % 17 + offset).cast("double").alias("value"),
        F.timestamp_seconds(F.lit(START + taken * 86_400)).alias("taken"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def feed(spark, path):
    return S.Feed(spark, str(path / "feed"), SCHEMA, ["series"], "ts", "taken")


def snapshots(spark):
    # 3 days each; the second revises half of the first, the third gives the first values back, the last is a backfill
    return [
        snapshot(spark, 0, 288, 3), snapshot(spark, 96, 384, 4, 0.5), snapshot(spark, 192, 480, 5), snapshot(spark, -96 * 40, -96 * 39, 6),
    ]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (1, 3, 0, 2)])
def test_any_order_of_files_gives_the_batch_table(spark, tmp_path, order):
    f, source, checkpoint = feed(spark, tmp_path), str(tmp_path / "in"), str(tmp_path / "chk")
    every = snapshots(spark)
    for i in order:
        every[i].coalesce(1).write.mode("append").parquet(source)
        f.ingest(source, checkpoint)
    got = f.current()
    want = S.newest(spark.read.parquet(source), ["series"], "ts", "taken")
    assert got.columns == ["series", "ts", "value", "taken"]
    assert rows(got) == rows(want) and got.count() == 2 * (480 + 96)
    assert rows(f.hourly("value")) == rows(S.hourly_means(want, ["series"], "ts", "value"))


def test_all_files_in_one_run(spark, tmp_path):
    f, source = feed(spark, tmp_path), str(tmp_path / "in")
    for s in snapshots(spark):
        s.coalesce(1).write.mode("append").parquet(source)
    f.ingest(source, str(tmp_path / "chk"), files_per_batch=1)
    assert rows(f.current()) == rows(S.newest(spark.read.parquet(source), ["series"], "ts", "taken"))
    assert len(f._folders("log")) == 4
    f.ingest(source, str(tmp_path / "chk"))  # nothing new
    assert len(f._folders("log")) == 4


def test_late_rows_are_listed_with_their_reason(spark, tmp_path):
    f, every = feed(spark, tmp_path), snapshots(spark)
    f.merge(every[1], 0)
    assert f.late().count() == 0
    f.merge(every[0], 1)  # older: 192 steps are superseded, 96 are new
    assert f.late().groupBy("reason").count().collect() == [("superseded", 384)]
    f.merge(every[3], 2)
    assert dict(map(tuple, f.late().groupBy("reason").count().collect())) == {"superseded": 384, "backfilled": 192}
    f.merge(every[1], 3)  # a repeated snapshot is no news
    assert f.late().count() == 576 and f.log().count() == 2 * (288 + 96 + 96)


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    f, every = feed(spark, tmp_path), snapshots(spark)
    f.merge(every[0], 0)
    f.merge(every[1], 1)
    before = rows(f.current()), rows(f.log()), rows(f.late())
    f.merge(every[1], 1)
    assert (rows(f.current()), rows(f.log()), rows(f.late())) == before


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_compaction_changes_nothing(spark, tmp_path, order):
    f, every = feed(spark, tmp_path), snapshots(spark)
    for number, i in enumerate(order):
        f.merge(every[i], number)
        f.compact()
    f.merge(every[3], 3)
    f.compact()
    everything = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    assert rows(f.current()) == rows(S.newest(everything, ["series"], "ts", "taken"))
    assert f._folders("base") == [2] and f._folders("log") == [3]


def test_odd_rows(spark, tmp_path):
    f = feed(spark, tmp_path)
    odd = spark.createDataFrame(
        [("a", None, 1.0, 1), (None, 5, 2.0, 1), (None, 5, 3.0, 2), ("a", 5, None, 2), ("a", 5, 4.0, 1), ("b", 5, 1.0, 1), ("b", 5, 2.0, 1)],
        "series string, t int, value double, d int",
    ).select("series", F.timestamp_seconds("t").alias("ts"), "value", F.timestamp_seconds("d").alias("taken"))
    f.merge(odd, 0)
    f.merge(odd.limit(0), 1)
    assert sorted(((r.series, r.value) for r in f.current().collect()), key=str) == [("a", None), ("b", 2.0), (None, 3.0)]
    assert [r.reason for r in f.late().collect()] == ["no instant"]
    f.merge(odd.filter("series is null and value = 2"), 2)
    assert {r.reason for r in f.late().collect()} == {"no instant", "superseded"}
    assert feed(spark, tmp_path / "none").current().count() == 0


def test_a_span_of_days_reads_only_its_folders(spark, tmp_path):
    f = feed(spark, tmp_path)
    f.merge(snapshot(spark, 0, 96 * 5, 9), 0)
    days = sorted(r.ts for r in f.current().select(F.to_date("ts").alias("ts")).distinct().collect())
    got = f.current(days[1], days[2])
    assert got.count() == 2 * 96 * 2
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in scan
    assert f.current(date(1990, 1, 1), date(1990, 1, 2)).count() == 0
