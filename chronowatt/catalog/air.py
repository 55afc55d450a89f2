"""Air-quality queries: 8-hour statistic, exceedances, diurnal cycles, pairing with another series."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from . import query
from .base import H, HL, HL0, day_sql, hourly, hourly_local, r, ts_sql
from ..functions import timeaxis as T
from ..functions.numeric import ratio, stable
from ..operators import joins, profiles, quality, series, shares

LEVEL = 60.0  # stands for the quality objective (strictly above)
ALERT = 95.0  # stands for the hourly information level (at or above)

# All hours of the local days from the first to the last of a series.
GRID = """DY AS (SELECT series, min(d) AS lo, max(d) AS hi FROM HL GROUP BY 1),
GR AS (SELECT series, u AS h FROM (SELECT series, lo, hi,
    unnest(generate_series(CAST(lo AS TIMESTAMP) - INTERVAL 1 DAY, CAST(hi AS TIMESTAMP) + INTERVAL 2 DAY, INTERVAL 1 HOUR)) AS u FROM DY)
  WHERE CAST(timezone('Europe/Paris', timezone('UTC', u)) AS DATE) BETWEEN lo AND hi)"""
# Each measure counts in the eight hours from its own on.
ROLL = GRID + """,
CB AS (SELECT series, h + later * INTERVAL 1 HOUR AS h, v FROM HL, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS later) WHERE v IS NOT NULL),
SM AS (SELECT series, h, avg(v) AS mean, count(*) AS n FROM CB GROUP BY 1, 2),
RL AS (SELECT series, h, mean, coalesce(n, 0) AS n, CAST(timezone('Europe/Paris', timezone('UTC', h)) AS DATE) AS d,
  extract('hour' FROM timezone('Europe/Paris', timezone('UTC', h))) AS hr FROM GR LEFT JOIN SM USING (series, h))"""
MDA = ROLL + f""",
MV AS (SELECT *, row_number() OVER (PARTITION BY series, d ORDER BY {r('mean')} DESC, hr) AS rk FROM RL WHERE n >= 6),
MD AS (SELECT series, d, max({r('mean')}) AS max_mean, max(CASE WHEN rk = 1 THEN hr END) AS hour_of_max,
  count(*) AS n_means, count(*) >= 18 AS valid FROM MV GROUP BY 1, 2)"""


def rolling(spark, sf, per_type=True):
    measures = hourly_local(spark, sf, per_type)
    bounds = series.local_day_bounds(measures, ["series"], "d", "v")
    out = series.rolling_hours(measures, bounds, ["series"], "hi", "v")
    return out.withColumn("mean", stable("mean"))


def daily_max(spark, sf, per_type=True):
    return series.daily_max_of_rolling(rolling(spark, sf, per_type), ["series"])


@query(f"WITH {HL},\n{ROLL} SELECT series, {ts_sql('h')} AS h, {r('mean')} AS mean, n FROM RL")
def rolling_8h_mean(spark, sf):
    return rolling(spark, sf).select("series", T.as_text(T.from_hour_index("hour")).alias("h"), "mean", "n")


def _daily_rows(df):
    return df.select(
        "series", T.day_text("day").alias("day"), "max_mean", F.col("hour_of_max").cast("bigint").alias("hour_of_max"),
        "n_means", "valid",
    )


_MDA_OUT = f"SELECT series, {day_sql('d')} AS day, max_mean, hour_of_max, n_means, valid FROM MD"


@query(f"WITH {HL},\n{MDA} {_MDA_OUT}")
def daily_max_8h(spark, sf):
    return _daily_rows(daily_max(spark, sf))


@query(f"WITH {HL0.replace('HL AS', 'HL AS')},\n{MDA} {_MDA_OUT}")
def daily_max_8h_all(spark, sf):
    return _daily_rows(daily_max(spark, sf, per_type=False))


@query(f"""WITH {HL},\n{GRID} SELECT series, {day_sql("timezone('Europe/Paris', timezone('UTC', h))")} AS day,
count(*) AS n_hours FROM GR GROUP BY 1, 2""")
def hour_grid(spark, sf):
    bounds = series.local_day_bounds(hourly_local(spark, sf), ["series"], "d", "v")
    grid = series.hour_grid(bounds, ["series"])
    day = T.day_text(T.utc_to_local(T.from_hour_index("hour")))
    return grid.groupBy("series", day.alias("day")).agg(F.count("*").alias("n_hours"))


def valid_days(spark, sf):
    return daily_max(spark, sf).filter("valid")


@query(f"""WITH {HL},\n{MDA} SELECT count(DISTINCT CASE WHEN max_mean > {LEVEL} THEN d END) AS days_above,
count(DISTINCT d) AS days_measured, count(*) FILTER (WHERE max_mean > {LEVEL}) AS pairs_above,
count(*) AS pairs_measured FROM MD WHERE valid""")
def distinct_days_vs_pairs(spark, sf):
    above = F.col("max_mean") > LEVEL
    return valid_days(spark, sf).agg(
        F.count_distinct(F.when(above, F.col("day"))).alias("days_above"),
        F.count_distinct("day").alias("days_measured"),
        F.count_if(above).alias("pairs_above"),
        F.count("*").alias("pairs_measured"),
    )


@query(f"""WITH {HL},\n{MDA} SELECT series, count(*) AS n_days, count(*) FILTER (WHERE max_mean > {LEVEL}) AS n_above,
{r(f'100.0*count(*) FILTER (WHERE max_mean > {LEVEL})/count(*)')} AS rate FROM MD WHERE valid GROUP BY 1""")
def exceedance_rate(spark, sf):
    return shares.exceedance(valid_days(spark, sf), ["series"], "max_mean", LEVEL).withColumn("rate", stable("rate"))


@query(f"""WITH {HL},\n{MDA}, X AS (SELECT series, 100.0*count(*) FILTER (WHERE max_mean > {LEVEL})/count(*) AS rate
  FROM MD WHERE valid GROUP BY 1)
SELECT (SELECT count(*) FROM X) AS n_series, {r('t.rate')} AS rate,
  1 + (SELECT count(*) FROM X o WHERE o.rate > t.rate) AS rank_from_top,
  (SELECT count(*) FROM X o WHERE o.rate < t.rate) AS n_ahead_of FROM X t WHERE series = 'purchase'""")
def rank_of_class(spark, sf):
    rates = shares.exceedance(valid_days(spark, sf), ["series"], "max_mean", LEVEL)
    # one row per series by now, so a window over all of them is small
    own = F.max(F.when(F.col("series") == "purchase", F.col("rate"))).over(Window.partitionBy())
    ranked = rates.select("rate", own.alias("own")).agg(
        F.count("*").alias("n_series"),
        stable(F.max("own")).alias("rate"),
        (F.count_if(F.col("rate") > F.col("own")) + 1).alias("rank_from_top"),
        F.count_if(F.col("rate") < F.col("own")).alias("n_ahead_of"),
    )
    return ranked.filter(F.col("rate").isNotNull())  # no rank for a class without a measured day


@query("""SELECT o_orderstatus AS status, string_agg(DISTINCT CAST(y AS VARCHAR), ',' ORDER BY CAST(y AS VARCHAR)) AS years
FROM (SELECT o_orderstatus, extract('year' FROM o_orderdate) AS y FROM orders) GROUP BY 1""")
def years_present(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderstatus", F.year("o_orderdate").alias("y"))
    return (
        o.distinct()
        .groupBy(F.col("o_orderstatus").alias("status"))
        .agg(F.array_join(F.array_sort(F.collect_set("y")), ",").alias("years"))
    )


@query(f"""WITH {HL},\n{MDA}, HM AS (SELECT series, d, max(v) AS top FROM HL GROUP BY 1, 2)
SELECT MD.series, count(*) AS n_days, count(*) FILTER (WHERE max_mean > {LEVEL}) AS n_exceed,
count(*) FILTER (WHERE top >= {ALERT}) AS n_alert,
count(*) FILTER (WHERE max_mean > {LEVEL} AND top < {ALERT}) AS n_exceed_without_alert
FROM MD JOIN HM USING (series, d) WHERE valid GROUP BY 1""")
def exceed_without_alert(spark, sf):
    top = hourly_local(spark, sf).groupBy("series", F.col("d").alias("day")).agg(F.max("v").alias("top"))
    exceed, alert = F.col("max_mean") > LEVEL, F.col("top") >= ALERT
    return (
        valid_days(spark, sf)
        .join(top, ["series", "day"])
        .groupBy("series")
        .agg(
            F.count("*").alias("n_days"),
            F.count_if(exceed).alias("n_exceed"),
            F.count_if(alert).alias("n_alert"),
            F.count_if(exceed & ~alert).alias("n_exceed_without_alert"),
        )
    )


@query(f"""WITH {HL},\n{MDA}, C AS (SELECT CASE WHEN series IN ('purchase','signup') THEN 'study' ELSE 'others' END AS class, * FROM MD WHERE valid)
SELECT class, count(*) AS n_days, {r('avg(max_mean)')} AS mean_max,
{r(f'100.0*count(*) FILTER (WHERE max_mean > {LEVEL})/nullif(count(*),0)')} AS rate FROM C GROUP BY 1""")
def class_contrast(spark, sf):
    cls = F.when(F.col("series").isin("purchase", "signup"), "study").otherwise("others")
    return (
        valid_days(spark, sf)
        .groupBy(cls.alias("class"))
        .agg(
            F.count("*").alias("n_days"),
            stable(F.avg("max_mean")).alias("mean_max"),
            stable(ratio(100.0 * F.count_if(F.col("max_mean") > LEVEL), F.count("*"))).alias("rate"),
        )
    )


PAIRS = [("purchase", "view"), ("signup", "click"), ("error", "view")]
_PAIRS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)


@query(f"""WITH {HL},\n{MDA}, P(series, paired) AS (VALUES {_PAIRS_SQL}),
TD AS (SELECT series AS paired, d, max(v) AS v_max, min(v) AS v_min, avg(v) AS v_avg, count(*) AS n_hours FROM HL GROUP BY 1, 2)
SELECT MD.series, TD.paired, {day_sql('MD.d')} AS day, max_mean, {r('v_max')} AS v_max, {r('v_min')} AS v_min,
{r('v_avg')} AS v_avg, n_hours FROM MD JOIN P USING (series) JOIN TD ON TD.paired = P.paired AND TD.d = MD.d WHERE valid""")
def paired_series_daily(spark, sf):
    pairing = F.broadcast(spark.createDataFrame(PAIRS, "series string, paired string"))  # a constant list
    daily = hourly_local(spark, sf).groupBy(F.col("series").alias("paired"), F.col("d").alias("day")).agg(
        stable(F.max("v")).alias("v_max"),
        stable(F.min("v")).alias("v_min"),
        stable(F.avg("v")).alias("v_avg"),
        F.count("*").alias("n_hours"),
    )
    return (
        valid_days(spark, sf)
        .join(pairing, "series")
        .join(daily, ["paired", "day"])
        .select("series", "paired", T.day_text("day").alias("day"), "max_mean", "v_max", "v_min", "v_avg", "n_hours")
    )


@query("""WITH B AS (SELECT CASE WHEN o_totalprice < 100000 THEN 'below 100k' WHEN o_totalprice < 250000 THEN '100k to 250k'
  WHEN o_totalprice < 400000 THEN '250k to 400k' ELSE '400k and above' END AS band, o_totalprice FROM orders)
SELECT band, min(o_totalprice) AS band_min, round(avg(o_totalprice) + 0.00001, 2) AS mean_price, count(*) AS n,
row_number() OVER (ORDER BY min(o_totalprice)) AS place FROM B GROUP BY 1""")
def banding(spark, sf):
    band = shares.bands(
        F.col("o_totalprice"),
        [(100000, "below 100k"), (250000, "100k to 250k"), (400000, "250k to 400k")],
        "400k and above",
    )
    return (
        spark.read.parquet(f"{sf}/orders.parquet")
        .groupBy(band.alias("band"))
        .agg(
            F.min("o_totalprice").alias("band_min"),
            stable(F.avg("o_totalprice"), 2).alias("mean_price"),
            F.count("*").alias("n"),
        )
        .withColumn("place", F.row_number().over(Window.orderBy("band_min")).cast("bigint"))
    )


def hour_means(spark, sf):
    """Mean of the hourly series by local hour: 24 rows per series."""
    return hourly_local(spark, sf).groupBy("series", "hr").agg(stable(F.avg("v")).alias("v"))


HM = HL + f",\nHM AS (SELECT series, hr, {r('avg(v)')} AS v FROM HL GROUP BY 1, 2)"


@query(f"""WITH {HM} SELECT series, hr, v, {r('100.0*v/max(v) OVER (PARTITION BY series)')} AS pct_of_peak FROM HM""")
def profile_relative_to_peak(spark, sf):
    rel = profiles.relative_to_peak(hour_means(spark, sf), ["series"], "v")
    return rel.select("series", "hr", "v", stable("pct_of_peak").alias("pct_of_peak"))


@query(f"""WITH {HM}, R AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY v DESC, hr) AS hi_rk,
  row_number() OVER (PARTITION BY series ORDER BY v, hr) AS lo_rk FROM HM)
SELECT series, max(CASE WHEN hi_rk = 1 THEN hr END) AS peak_hour, max(v) AS peak_value,
max(CASE WHEN lo_rk = 1 THEN hr END) AS trough_hour, min(v) AS trough_value FROM R GROUP BY 1""")
def peak_hour_by_series(spark, sf):
    means = hour_means(spark, sf)
    return profiles.peak(means, ["series"], "hr", "v").join(
        profiles.trough(means, ["series"], "hr", "v"), "series"
    )


@query(f"""WITH {HM}, T AS (SELECT *, max(v) OVER (PARTITION BY series) AS top FROM HM)
SELECT series, min(hr) AS first_hour, max(hr) AS last_hour, count(*) AS n_hours,
max(hr) - min(hr) + 1 = count(DISTINCT hr) AS contiguous FROM T WHERE v >= 0.95 * top GROUP BY 1""")
def plateau_hours(spark, sf):
    return profiles.plateau(hour_means(spark, sf), ["series"], "hr", "v", 0.95)


@query(f"""WITH {HM}, W AS (SELECT *, max(v) OVER (PARTITION BY series)/2.0 AS half,
  lead(v) OVER (PARTITION BY series ORDER BY hr) AS nxt, lag(v) OVER (PARTITION BY series ORDER BY hr) AS prv
  FROM (SELECT series, hr, CASE WHEN hr BETWEEN 6 AND 18 THEN v ELSE v/4 END AS v FROM HM)),
U AS (SELECT series, min(hr) AS hr FROM W WHERE v < half AND half <= nxt GROUP BY 1),
D AS (SELECT series, max(hr) AS hr FROM W WHERE v < half AND half <= prv GROUP BY 1),
UX AS (SELECT W.series, W.hr + (half - v)/(nxt - v) AS x FROM W JOIN U USING (series, hr)),
DX AS (SELECT W.series, W.hr - (half - v)/(prv - v) AS x FROM W JOIN D USING (series, hr))
SELECT S.series, {r('UX.x')} AS rise, {r('DX.x')} AS fall, {r('(UX.x + DX.x)/2.0')} AS mid
FROM (SELECT DISTINCT series FROM HM) S LEFT JOIN UX USING (series) LEFT JOIN DX USING (series)""")
def profile_half_height_mid(spark, sf):
    day_shaped = hour_means(spark, sf).withColumn(
        "v", F.when(F.col("hr").between(6, 18), F.col("v")).otherwise(F.col("v") / 4)
    )
    out = profiles.half_height_mid(day_shaped, ["series"], "hr", "v")
    return out.select("series", *[stable(c).alias(c) for c in ("rise", "fall", "mid")])


LAGS = f"""WITH {H}, A AS (SELECT h, v FROM H WHERE series = 'purchase'), B AS (SELECT h, v FROM H WHERE series = 'view'),
L AS (SELECT lag, count(*) AS n_pairs, CASE WHEN count(*) > 200 THEN corr(A.v, B.v) END AS correlation
  FROM range(-3, 4) t(lag) JOIN A ON true JOIN B ON B.h = A.h + lag * INTERVAL 1 HOUR GROUP BY 1)"""


def _lags(spark, sf):
    h = hourly(spark, sf)
    a = h.filter("series = 'purchase'").select("hi", F.col("v").alias("va"))
    b = h.filter("series = 'view'").select("hi", F.col("v").alias("vb"))
    return profiles.lag_correlations(a, b, "hi", "va", "vb")


@query(f"{LAGS} SELECT lag, n_pairs, {r('correlation')} AS correlation FROM L")
def lag_correlation(spark, sf):
    return _lags(spark, sf).select("lag", "n_pairs", stable("correlation").alias("correlation"))


@query(f"""{LAGS}, N AS (SELECT *, lag(correlation) OVER (ORDER BY lag) AS p, lead(correlation) OVER (ORDER BY lag) AS q FROM L),
K AS (SELECT * FROM N WHERE correlation IS NOT NULL ORDER BY correlation DESC, lag LIMIT 1)
SELECT lag AS best_lag, {r('correlation')} AS best_correlation,
round(CAST(lag + coalesce(0.5*(p - q)/nullif(p - 2*correlation + q, 0.0), 0.0) AS DOUBLE) + 0.0000001, 4) AS refined_lag FROM K""")
def lag_correlation_optimum(spark, sf):
    best = profiles.lag_optimum(_lags(spark, sf))
    return best.select(
        "best_lag", stable("best_correlation").alias("best_correlation"), stable("refined_lag", 4).alias("refined_lag")
    )


@query(f"""WITH {H}, A AS (SELECT h, v FROM H WHERE series = 'purchase'),
B AS (SELECT h, v, CASE WHEN h < TIMESTAMP '2024-01-16' THEN 'before' ELSE 'after' END AS regime FROM H WHERE series = 'view'),
L AS (SELECT regime, lag, count(*) AS n_pairs, CASE WHEN count(*) > 200 THEN corr(A.v, B.v) END AS correlation
  FROM range(-3, 4) t(lag) JOIN A ON true JOIN B ON B.h = A.h + lag * INTERVAL 1 HOUR GROUP BY 1, 2)
SELECT regime, lag, n_pairs, {r('correlation')} AS correlation FROM L""")
def lag_correlation_by_regime(spark, sf):
    h = hourly(spark, sf)
    change = T.hour_index(F.lit("2024-01-16").cast("timestamp_ntz"))
    regime = F.when(F.col("hi") < change, "before").otherwise("after")
    a = h.filter("series = 'purchase'").select("hi", F.col("v").alias("va"))
    b = h.filter("series = 'view'").select("hi", F.col("v").alias("vb"), regime.alias("regime"))
    lags = profiles.lag_correlations(a, b, "hi", "va", "vb", groups=["regime"])
    return lags.select("regime", "lag", "n_pairs", stable("correlation").alias("correlation"))


@query(f"""WITH {HL},\n{MDA}, Y AS (SELECT d, max_mean FROM MD WHERE valid AND d > DATE '2024-01-15')
SELECT count(DISTINCT CASE WHEN max_mean > {LEVEL} THEN d END) AS days_above, count(DISTINCT d) AS days_measured,
{day_sql('max(d)')} AS last_day, (SELECT count(*) FROM range(DATE '2024-01-16', DATE '2024-02-01', INTERVAL 1 DAY)) AS days_in_calendar FROM Y""")
def latest_season_progress(spark, sf):
    season = valid_days(spark, sf).filter(F.col("day") > F.lit("2024-01-15").cast("date"))
    calendar = F.size(F.sequence(F.lit("2024-01-16").cast("date"), F.lit("2024-01-31").cast("date")))
    return season.agg(
        F.count_distinct(F.when(F.col("max_mean") > LEVEL, F.col("day"))).alias("days_above"),
        F.count_distinct("day").alias("days_measured"),
        T.day_text(F.max("day")).alias("last_day"),
        calendar.cast("bigint").alias("days_in_calendar"),
    )


@query(f"""WITH {H} SELECT series, count(*) FILTER (WHERE h < TIMESTAMP '2024-01-16') AS n_first,
count(*) FILTER (WHERE h >= TIMESTAMP '2024-01-16') AS n_second FROM H GROUP BY 1
HAVING count(*) FILTER (WHERE h < TIMESTAMP '2024-01-16') > 0 AND count(*) FILTER (WHERE h >= TIMESTAMP '2024-01-16') > 0""")
def both_measured(spark, sf):
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    h = hourly(spark, sf).withColumn("h", T.from_hour_index("hi"))
    return quality.both_present(h, ["series"], F.col("h") < half, F.col("h") >= half)


@query(f"""WITH {H}, X AS (SELECT event_type AS series, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT H.series, count(*) AS n, {r('max(abs(H.v - X.v))')} AS max_gap, {r('avg(abs(H.v - X.v))')} AS mean_gap
FROM H JOIN X USING (series, h) GROUP BY 1""")
def channel_reconciliation(spark, sf):
    other = (
        spark.read.parquet(f"{sf}/events.parquet")
        .groupBy(F.col("event_type").alias("series"), T.hour_index("ts").alias("hi"))
        .agg(F.avg("value").alias("v"))
    )
    out = joins.reconcile(hourly(spark, sf), other, ["series", "hi"], "v", ["series"])
    return out.select("series", "n", stable("max_gap").alias("max_gap"), stable("mean_gap").alias("mean_gap"))
