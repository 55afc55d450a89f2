"""Reconstruction queries: documents, carry-forward, live window, energy, episodes."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from . import query
from .base import B15, B15_TYPE, H, H0, HL, day_sql, hourly, hourly_local, known_day, quarter_hours, r, table, ts_sql
from ..functions import timeaxis as T
from ..functions.numeric import percent, stable
from ..operators import ordered, series
from ..sources import xml_series


@query("""WITH P AS (SELECT l_suppkey AS s, extract('year' FROM l_shipdate) AS y, extract('month' FROM l_shipdate) AS m, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY 1, 2, 3),
K AS (SELECT DISTINCT s, y FROM P), G AS (SELECT s, y, p AS m FROM K, range(1, 13) t(p)),
C AS (SELECT G.s, G.y, G.m, last_value(q IGNORE NULLS) OVER (PARTITION BY G.s, G.y ORDER BY G.m) AS v, q IS NOT NULL AS declared FROM G LEFT JOIN P ON P.s = G.s AND P.y = G.y AND P.m = G.m)
SELECT s AS series_id, y, count(*) AS n_steps, count(*) FILTER (WHERE declared) AS n_declared, round(sum(v) + 0.00001, 2) AS total FROM C WHERE v IS NOT NULL GROUP BY 1, 2""")
def xml_series_points(spark, sf):
    """A document per supplier and year gives the months it has, as positions of a twelve-step period;
    it is written as XML, parsed back, and the months it lacks repeat the one before."""
    monthly = (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("s"),
            F.year("l_shipdate").cast("bigint").alias("y"),
            F.month("l_shipdate").alias("m"),
        )
        .agg(F.sum("l_quantity").alias("q"))
    )
    # twelve columns at most per document, whatever the number of lines
    documents = monthly.groupBy("s", "y").agg(*[F.max(F.when(F.col("m") == m, F.col("q"))).alias(f"q{m}") for m in range(1, 13)])
    text = xml_series.document_text(
        F.col("s"), [(F.lit(m), F.col(f"q{m}")) for m in range(1, 13)], "PT60M", "2024-01-01T00:00Z", "2024-01-01T12:00Z"
    )
    parsed = xml_series.parse_text(documents.select("y", text.alias("xml")), "xml", ["y"])
    steps = xml_series.rebuild_points(parsed.select("y", "mRID", F.explode("Period").alias("period")), "period", leading="skip")
    return steps.groupBy(F.col("mRID").cast("bigint").alias("series_id"), "y").agg(
        F.count("*").alias("n_steps"), F.count_if("declared").alias("n_declared"), stable(F.sum("value"), 2).alias("total")
    )


@query(f"""WITH {B15} SELECT {ts_sql("to_timestamp(b//4*3600)::TIMESTAMP")} AS hour, {r('avg(c)/100.0')} AS mean_power, count(*) AS n FROM B15 GROUP BY 1""")
def resample_hourly_mean(spark, sf):
    q = quarter_hours(spark, sf).select("series", T.from_minute_index(F.col("b") * 15).alias("ts"), "c")
    out = series.resample_hourly(q, ["series"], "ts", "c")
    return out.select(T.as_text("hour_ts").alias("hour"), stable(F.col("c") / 100.0).alias("mean_power"), "n")


# A period is a (type, day); its positions are the 24 hours of the day.
_CARRY = H + """,
P AS (SELECT DISTINCT series, CAST(h AS DATE) AS day FROM H),
G AS (SELECT series, day, CAST(p AS INTEGER) AS position FROM P, range(1, 25) t(p)),
J AS (SELECT G.*, H.v FROM G LEFT JOIN H ON H.series = G.series AND H.h = G.day + (G.position - 1) * INTERVAL 1 HOUR),
C AS (SELECT series, day, position, last_value(v IGNORE NULLS) OVER (PARTITION BY series, day ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v, v IS NOT NULL AS declared FROM J)"""


def declared_points(spark, sf):
    h = hourly(spark, sf).withColumn("h", T.from_hour_index("hi"))
    return h.select("series", known_day("h").alias("day"), (F.hour("h") + 1).alias("position"), "v")


def carried(spark, sf, leading="skip"):
    points = declared_points(spark, sf)
    # the filter makes both branches need the same columns, hence one shuffle below them
    periods = points.filter(F.col("v").isNotNull()).select("series", "day").distinct().withColumn("n_positions", F.lit(24))
    if leading == "error":
        # only periods that give their first position are documents of this kind
        periods = periods.join(points.filter("position = 1").select("series", "day"), ["series", "day"], "left_semi")
    return series.carry_forward(points, periods, ["series", "day"], "position", "v", "n_positions", leading)


@query(f"""WITH {_CARRY}, F AS (SELECT series, day FROM J WHERE position = 1 AND v IS NOT NULL)
SELECT 'skip' AS mode, series, {day_sql('day')} AS day, count(*) AS n, count(*) FILTER (WHERE declared) AS n_declared, {r('sum(v)')} AS total FROM C WHERE v IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'error', series, {day_sql('day')}, count(*), count(*) FILTER (WHERE declared), {r('sum(v)')} FROM C JOIN F USING (series, day) GROUP BY 2, 3
UNION ALL SELECT 'refused', series, {day_sql('day')}, count(*), count(*), {r('sum(v)')} FROM J WHERE v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM F WHERE F.series = J.series AND F.day = J.day) GROUP BY 2, 3""")
def carry_forward_period(spark, sf):
    def mode(name):
        return carried(spark, sf, name).groupBy(F.lit(name).alias("mode"), "series", T.day_text("day").alias("day")).agg(
            F.count("*").alias("n"), F.count_if("declared").alias("n_declared"), stable(F.sum("v")).alias("total")
        )

    # the periods that the mode "error" refuses, with the points they declare
    points = declared_points(spark, sf)
    refused = points.groupBy(F.lit("refused").alias("mode"), "series", T.day_text("day").alias("day")).agg(
        F.count("*").alias("n"), F.count("*").alias("n_declared"), stable(F.sum("v")).alias("total"), F.min("position").alias("first")
    )
    return mode("skip").unionByName(mode("error")).unionByName(refused.filter("first > 1").drop("first"))


@query(f"""WITH {_CARRY}, K AS (SELECT *, epoch(day)/3600 + position AS t FROM C WHERE v IS NOT NULL),
S AS (SELECT *, CASE WHEN lag(v) OVER w = v AND lag(t) OVER w = t - 1 THEN 0 ELSE 1 END AS opens FROM K WINDOW w AS (PARTITION BY series ORDER BY t)),
I AS (SELECT *, sum(opens) OVER (PARTITION BY series ORDER BY t) AS island FROM S),
B AS (SELECT series, island, count(*) AS len FROM I WHERE v <> 0 GROUP BY 1, 2),
T AS (SELECT series, {r('100.0*sum(v) FILTER (WHERE NOT declared)/sum(v)')} AS carried_pct, count(*) FILTER (WHERE NOT declared) AS n_carried FROM K GROUP BY 1)
SELECT series, carried_pct, n_carried, (SELECT max(len) FROM B WHERE B.series = T.series) AS longest_block FROM T""")
def carried_energy_share(spark, sf):
    c = carried(spark, sf).withColumn("t", F.unix_date("day").cast("bigint") * 24 + F.col("position"))
    same = (F.col("prev.v") == F.col("v")) & (F.col("prev.t") == F.col("t") - 1)
    carried_ = ~F.col("declared")
    sizes = ordered.run_sizes(
        c,
        ["series"],
        ["t"],
        F.floor(F.col("t") / 720),
        same,
        ["v", "t"],
        {"flows": F.col("v") != 0},
        sums={"v": F.col("v"), "carried": F.when(carried_, F.col("v")), "n_carried": carried_.cast("bigint")},
    )
    return sizes.groupBy("series").agg(
        stable(percent(F.sum("carried"), F.sum("v"))).alias("carried_pct"),
        F.sum("n_carried").alias("n_carried"),
        F.max(F.when(F.col("flows"), F.col("size"))).alias("longest_block"),
    )


_LIVE = B15_TYPE + """,
E AS (SELECT series, max(b) AS e FROM B15 GROUP BY 1),
G AS (SELECT series, e, CAST(e - k AS BIGINT) AS b FROM E, range(0, 25) t(k)),
J AS (SELECT G.series, G.e, G.b, CAST(B15.c AS DOUBLE)/100.0 AS part, CAST(B15.n AS DOUBLE) AS whole, B15.b IS NOT NULL AS given FROM G LEFT JOIN B15 USING (series, b)),
W AS (SELECT *, last_value(CASE WHEN given THEN b END IGNORE NULLS) OVER p AS b0, last_value(CASE WHEN given THEN part END IGNORE NULLS) OVER p AS p0, last_value(CASE WHEN given THEN whole END IGNORE NULLS) OVER p AS w0,
  first_value(CASE WHEN given THEN b END IGNORE NULLS) OVER q AS b1, first_value(CASE WHEN given THEN part END IGNORE NULLS) OVER q AS p1, first_value(CASE WHEN given THEN whole END IGNORE NULLS) OVER q AS w1
  FROM J WINDOW p AS (PARTITION BY series ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY series ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
N AS (SELECT series, count(*) FILTER (WHERE NOT given AND b > e - 24) AS gaps, count(*) FILTER (WHERE NOT given AND b > e - 24 AND (b0 IS NULL OR b1 IS NULL)) AS open_gaps FROM W GROUP BY 1),
X AS (SELECT W.series, CASE WHEN given THEN 'read' WHEN gaps <= 2 AND open_gaps = 0 THEN 'filled' ELSE 'missing' END AS state,
  CASE WHEN given THEN part WHEN gaps <= 2 AND open_gaps = 0 THEN p0 + (p1 - p0)*(b - b0)/(b1 - b0) END AS part,
  CASE WHEN given THEN whole WHEN gaps <= 2 AND open_gaps = 0 THEN w0 + (w1 - w0)*(b - b0)/(b1 - b0) END AS whole FROM W JOIN N USING (series) WHERE b > e - 24)"""

_LIVE_OUT = f"""SELECT series, {r('100.0*sum(part)/nullif(sum(whole),0)', 4)} AS share,
CASE WHEN count(*) FILTER (WHERE state = 'missing') = 0 THEN {r('sum(part)*0.25', 4)} END AS part_energy,
CASE WHEN count(*) FILTER (WHERE state = 'missing') = 0 THEN {r('sum(whole)*0.25', 4)} END AS total_energy,
count(*) FILTER (WHERE state = 'read') AS n_read, count(*) FILTER (WHERE state = 'filled') AS n_filled, count(*) FILTER (WHERE state = 'missing') AS n_missing FROM X GROUP BY 1"""


def _live(readings):
    window = series.live_window(
        readings.select("series", "b", (F.col("c").cast("double") / 100.0).alias("part"), F.col("n").cast("double").alias("whole")),
        ["series"],
        "b",
        ["part", "whole"],
    )
    s = series.live_summary(window, ["series"], "part", "whole", 15)
    return s.select("series", *[stable(c, 4).alias(c) for c in ("share", "part_energy", "total_energy")], "n_read", "n_filled", "n_missing")


@query(f"WITH {_LIVE} {_LIVE_OUT}")
def live_window_interpolated(spark, sf):
    return _live(quarter_hours(spark, sf, per_type=True))


@query(f"WITH {_LIVE.replace(B15_TYPE, B15)} {_LIVE_OUT}")
def live_window_all(spark, sf):
    return _live(quarter_hours(spark, sf))


_SIGN = "CASE WHEN series IN ('purchase','signup') THEN v ELSE -v END"


@query(f"""WITH {_CARRY} SELECT {day_sql('day')} AS day, round(sum({_SIGN}*60/60.0) FILTER (WHERE declared) + 0.0000001, 4) AS net_declared,
round(sum({_SIGN}*60/60.0) + 0.0000001, 4) AS net_carried, count(*) FILTER (WHERE NOT declared) AS n_carried FROM C WHERE v IS NOT NULL GROUP BY 1""")
def energy_integral_net(spark, sf):
    c = carried(spark, sf)
    inward = F.col("series").isin("purchase", "signup")
    e = series.energy(F.when(inward, F.col("v")).otherwise(-F.col("v")), F.lit(60))
    return c.groupBy(T.day_text("day").alias("day")).agg(
        stable(F.sum(F.when(F.col("declared"), e)), 4).alias("net_declared"),
        stable(F.sum(e), 4).alias("net_carried"),
        F.count_if(~F.col("declared")).alias("n_carried"),
    )


# published yearly net (constants of the stand-in), compared with both readings
@query(f"""WITH {_CARRY}, N AS (SELECT CAST(extract('year' FROM day) AS BIGINT) AS y, CAST(extract('month' FROM day) AS BIGINT) AS m, sum({_SIGN}) FILTER (WHERE declared) AS a, sum({_SIGN}) AS b FROM C WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT y, m, {r('100.0*(a - pub)/abs(pub)', 4)} AS gap_declared_pct, {r('100.0*(b - pub)/abs(pub)', 4)} AS gap_carried_pct FROM N LEFT JOIN (VALUES (2024, 1, -30000.0::DOUBLE)) p(py, pm, pub) ON py = y AND pm = m""")
def net_against_published(spark, sf):
    signed = F.when(F.col("series").isin("purchase", "signup"), F.col("v")).otherwise(-F.col("v"))
    net = carried(spark, sf).groupBy(F.year("day").cast("bigint").alias("y"), F.month("day").cast("bigint").alias("m")).agg(
        F.sum(F.when(F.col("declared"), signed)).alias("a"), F.sum(signed).alias("b")
    )
    published = F.broadcast(spark.createDataFrame([(2024, 1, -30000.0)], "y bigint, m bigint, pub double"))  # a constant list
    gap = lambda c: stable(100.0 * (F.col(c) - F.col("pub")) / F.abs("pub"), 4)
    return net.join(published, ["y", "m"], "left").select("y", "m", gap("a").alias("gap_declared_pct"), gap("b").alias("gap_carried_pct"))


@query(f"""WITH {H}, N AS (SELECT h, sum(CASE WHEN series = 'purchase' THEN v ELSE -v END) AS net FROM H WHERE series IN ('purchase','view') GROUP BY 1),
T AS (SELECT h, v > 50 AS outside FROM H WHERE series = 'click'),
J AS (SELECT net, outside FROM N JOIN T USING (h))
SELECT CASE WHEN outside THEN 'above' ELSE 'below' END AS threshold, count(*) AS n_hours, {r('avg(net)')} AS mean_net,
{r('100.0*avg(CASE WHEN net > 0.000000001 THEN 1.0 ELSE 0.0 END)')} AS share_exporting FROM J GROUP BY 1""")
def resample_net_flow(spark, sf):
    h = hourly(spark, sf)
    signed = F.when(F.col("series") == "purchase", F.col("v")).otherwise(-F.col("v"))
    net = h.filter(F.col("series").isin("purchase", "view")).groupBy("hi").agg(F.sum(signed).alias("net"))
    third = h.filter("series = 'click'").select("hi", F.when(F.col("v") > 50, "above").otherwise("below").alias("threshold"))
    exporting = F.when(F.col("net") > 1e-9, 1.0).otherwise(0.0)
    return net.join(third, "hi").groupBy("threshold").agg(
        F.count("*").alias("n_hours"), stable(F.avg("net")).alias("mean_net"), stable(100.0 * F.avg(exporting)).alias("share_exporting")
    )


@query(f"""WITH {H0}, M AS (SELECT median(v) AS m FROM H0), A AS (SELECT h, v > m AS high FROM H0, M),
I AS (SELECT h, high, row_number() OVER (ORDER BY h) - row_number() OVER (PARTITION BY high ORDER BY h) AS island FROM A),
E AS (SELECT island, count(*) AS len FROM I WHERE high GROUP BY 1),
R AS (SELECT len, row_number() OVER (ORDER BY len) AS k, count(*) OVER () AS n FROM E)
SELECT count(*) AS n_episodes, max(CASE WHEN k = n//2 + 1 THEN len END) AS upper_median, max(len) AS longest FROM R""")
def threshold_episodes(spark, sf):
    h = hourly(spark, sf, per_type=False)
    middle = h.agg(F.percentile("v", 0.5)).scalar()
    flagged = h.select("series", "hi", (F.col("v") > middle).alias("high"))
    # neighbours are consecutive readings, as in a list of the hours at hand
    same = F.col("prev.high") == F.col("high")
    runs = ordered.run_sizes(flagged, ["series"], ["hi"], F.floor(F.col("hi") / 720), same, ["high"], {"high": F.col("high")})
    # lengths are few distinct numbers: walk their counts
    sizes = runs.filter("high").select("series", F.col("size").alias("len"), F.col("n").alias("k"))
    up_to = Window.partitionBy("series").orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sizes.select(
        "series", "len", "k", F.sum("k").over(up_to).alias("upto"), F.sum("k").over(Window.partitionBy("series")).alias("n")
    )
    middle_pos = F.floor(F.col("n") / 2) + 1
    holds = (F.col("upto") - F.col("k") < middle_pos) & (middle_pos <= F.col("upto"))
    return ranked.groupBy("series").agg(
        F.max("n").alias("n_episodes"), F.max(F.when(holds, F.col("len"))).alias("upper_median"), F.max("len").alias("longest")
    ).drop("series")


@query(f"""WITH {H} SELECT {ts_sql('h')} AS h, {', '.join(f"round(coalesce(sum(v) FILTER (WHERE series = '{s}'), 0) + 0.000000001, 6) AS {s}" for s in ('click', 'error', 'purchase', 'signup', 'view'))},
round(sum(v) FILTER (WHERE series <> 'error') + 0.000000001, 6) AS total_without_error FROM H GROUP BY h""")
def pivot_mix_wide(spark, sf):
    names = ["click", "error", "purchase", "signup", "view"]
    h = hourly(spark, sf)
    wide = h.groupBy("hi").agg(
        *[stable(F.coalesce(F.sum(F.when(F.col("series") == n, F.col("v"))), F.lit(0.0))).alias(n) for n in names],
        stable(F.sum(F.when(F.col("series") != "error", F.col("v")))).alias("total_without_error"),
    )
    return wide.select(T.as_text(T.from_hour_index("hi")).alias("h"), *names, "total_without_error")


@query("""SELECT event_type AS series, round(sum(value) FILTER (WHERE extract('hour' FROM ts) BETWEEN 8 AND 19) + 0.00001, 2) AS day_sum,
round(sum(value) FILTER (WHERE extract('hour' FROM ts) NOT BETWEEN 8 AND 19) + 0.00001, 2) AS night_sum,
count(*) FILTER (WHERE value > 100) AS n_high, round(max(value) FILTER (WHERE extract('hour' FROM ts) = 12) + 0.00001, 2) AS noon_max FROM events GROUP BY 1""")
def filtered_aggregates(spark, sf):
    day = F.hour("ts").between(8, 19)
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("series")).agg(
        stable(F.sum(F.when(day, F.col("value"))), 2).alias("day_sum"),
        stable(F.sum(F.when(~day, F.col("value"))), 2).alias("night_sum"),
        F.count_if(F.col("value") > 100).alias("n_high"),
        stable(F.max(F.when(F.hour("ts") == 12, F.col("value"))), 2).alias("noon_max"),
    )


@query(f"""WITH {HL}, B AS (SELECT series, extract('month' FROM loc) AS m, min(hr) AS a, max(hr) AS b FROM HL WHERE v > 60 GROUP BY 1, 2)
SELECT series, m, a AS first_hour, b AS last_hour, abs(a - 6) <= 1 AND abs(b - 20) <= 1 AS as_expected FROM B""")
def active_hour_window(spark, sf):
    b = hourly_local(spark, sf).filter("v > 60").groupBy("series", F.month("loc").cast("bigint").alias("m")).agg(
        F.min("hr").alias("first_hour"), F.max("hr").alias("last_hour")
    )
    ok = (F.abs(F.col("first_hour") - 6) <= 1) & (F.abs(F.col("last_hour") - 20) <= 1)
    return b.withColumn("as_expected", ok)
