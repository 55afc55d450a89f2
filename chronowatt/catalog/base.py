"""Base views shared by the queries, in both engines: hourly series, daily parts, orders, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import timeaxis as T
from ..functions.numeric import cents

# The study window of the stand-in feed ends here.
AS_OF = "2024-01-31 12:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hourly(spark: SparkSession, sf: str, per_type: bool = True) -> DataFrame:
    """series, hi (hour index), v (mean), n: hourly mean of the events, per type or over all."""
    series = F.col("event_type") if per_type else F.lit("all")
    return (
        table(spark, sf, "events")
        .select(series.alias("series"), T.hour_index("ts").alias("hi"), cents("value").alias("c"))
        # stated here once: joins infer the same filter on some branches only, which would keep
        # Spark from reusing one shuffle for all of them
        .filter(F.col("series").isNotNull() & F.col("hi").isNotNull())
        .groupBy("series", "hi")
        .agg(F.sum("c").alias("c"), F.count("*").alias("n"))
        # the hour is not NULL here; saying so spares the joins on what derives from it a NULL check,
        # which Spark would push down to every raw row together with the zone conversion in it
        .select(
            "series", F.coalesce("hi", F.lit(0)).alias("hi"), (F.col("c").cast("double") / (100 * F.col("n"))).alias("v"), "n"
        )
    )


H = """H AS (SELECT event_type AS series, date_trunc('hour', ts) AS h,
  CAST(sum(CAST(round(value*100) AS BIGINT)) AS DOUBLE)/(100*count(*)) AS v, count(*) AS n
  FROM events GROUP BY 1, 2)"""
H0 = """H0 AS (SELECT 'all' AS series, date_trunc('hour', ts) AS h,
  CAST(sum(CAST(round(value*100) AS BIGINT)) AS DOUBLE)/(100*count(*)) AS v, count(*) AS n
  FROM events GROUP BY 1, 2)"""


def hourly_local(spark: SparkSession, sf: str, per_type: bool = True) -> DataFrame:
    """Adds h (UTC), loc (Paris), d (local day), hr (local hour)."""
    h = hourly(spark, sf, per_type).withColumn("h", T.from_hour_index("hi"))
    loc = h.withColumn("loc", T.utc_to_local("h"))
    return loc.withColumn("d", known_day("loc")).withColumn("hr", F.hour("loc").cast("bigint"))


def known_day(ts: str):
    """Date of a timestamp that is not NULL, in a form Spark knows not to be NULL either (a plain cast
    to date never is): see the note on the hour in :func:`hourly`."""
    return F.coalesce(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date"))


def _local_sql(src: str) -> str:
    return f"""HL AS (SELECT *, CAST(loc AS DATE) AS d, extract('hour' FROM loc) AS hr
  FROM (SELECT *, timezone('Europe/Paris', timezone('UTC', h)) AS loc FROM {src}))"""


HL = H + ",\n" + _local_sql("H")
HL0 = H0 + ",\n" + _local_sql("H0")


def quarter_hours(spark: SparkSession, sf: str, per_type: bool = False) -> DataFrame:
    """series, b (15-minute step index), c (cents), n."""
    series = F.col("event_type") if per_type else F.lit("all")
    return (
        table(spark, sf, "events")
        .select(series.alias("series"), F.floor(T.minute_index("ts") / 15).cast("bigint").alias("b"), cents("value").alias("c"))
        .filter(F.col("series").isNotNull() & F.col("b").isNotNull())
        .groupBy("series", "b")
        .agg(F.sum("c").alias("c"), F.count("*").alias("n"))
    )


def _b15(series: str) -> str:
    return f"""B15 AS (SELECT {series} AS series, CAST(floor(epoch(ts)/900) AS BIGINT) AS b,
  CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS c, count(*) AS n FROM events GROUP BY 1, 2)"""


B15 = _b15("'all'")
B15_TYPE = _b15("event_type")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """orders with y, m, d and the price in cents (p)."""
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.year("o_orderdate").cast("bigint").alias("y"),
        F.month("o_orderdate").cast("bigint").alias("m"),
        F.col("o_orderdate").cast("date").alias("d"),
        cents("o_totalprice").alias("p"),
    )


O = """O AS (SELECT o_orderkey, o_custkey, o_orderstatus, extract('year' FROM o_orderdate) AS y,
  extract('month' FROM o_orderdate) AS m, CAST(o_orderdate AS DATE) AS d,
  CAST(round(o_totalprice*100) AS BIGINT) AS p FROM orders)"""


def order_days(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order day: y, m, d, v (total)."""
    return (
        orders(spark, sf)
        .groupBy("y", "m", "d")
        .agg((F.sum("p").cast("double") / 100.0).alias("v"), F.count("*").alias("n"))
    )


OD = O + """,
OD AS (SELECT y, m, d, CAST(sum(p) AS DOUBLE)/100.0 AS v, count(*) AS n FROM O GROUP BY 1, 2, 3)"""

PARTS = ("af", "ao", "nf", "no", "rf", "ro")


def _parts(spark: SparkSession, sf: str, key, alias: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        key.alias(alias),
        F.lower(F.concat("l_returnflag", "l_linestatus")).alias("part"),
        cents("l_extendedprice").alias("c"),
    )
    return li.groupBy(alias).agg(
        *[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("c"))), F.lit(0)).alias(p) for p in PARTS],
        F.sum("c").alias("tot"),
        F.count("*").alias("n"),
    )


def part_days(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as a load curve: one row per ship day, cents by return flag and status, total."""
    return _parts(spark, sf, F.col("l_shipdate").cast("date"), "day")


def part_years(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf, F.year("l_shipdate").cast("bigint"), "y")


def _parts_sql(name: str, key: str, alias: str) -> str:
    cols = ", ".join(
        f"CAST(coalesce(sum(CAST(round(l_extendedprice*100) AS BIGINT)) FILTER "
        f"(WHERE lower(l_returnflag||l_linestatus) = '{p}'), 0) AS BIGINT) AS {p}"
        for p in PARTS
    )
    return (
        f"{name} AS (SELECT {key} AS {alias}, {cols}, "
        f"CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS tot, count(*) AS n "
        f"FROM lineitem GROUP BY 1)"
    )


PD = _parts_sql("PD", "CAST(l_shipdate AS DATE)", "day")
PY = _parts_sql("PY", "extract('year' FROM l_shipdate)", "y")


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Event stream read as observations of a source: user = source, type = hash."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("source_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("observed_at"),
        F.col("event_type").alias("sha256"),
        cents("value").alias("size"),
    )


VS = """VS AS (SELECT user_id AS source_id, event_id AS seq, ts AS observed_at, event_type AS sha256,
  CAST(round(value*100) AS BIGINT) AS size FROM events),
CH AS (SELECT * FROM (SELECT *, lag(sha256) OVER (PARTITION BY source_id ORDER BY observed_at, seq) AS before FROM VS)
  WHERE before IS NULL OR before <> sha256),
IV AS (SELECT source_id, seq, sha256, size, observed_at AS first_observed_at,
  lead(observed_at) OVER (PARTITION BY source_id ORDER BY observed_at, seq) AS superseded_at FROM CH)"""


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`chronowatt.functions.numeric.stable`."""
    return f"round({expr} + {10.0 ** -(digits + 3):.{digits + 3}f}, {digits})"


def ts_sql(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


def day_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"
