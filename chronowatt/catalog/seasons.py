"""Monthly and seasonal demand on the daily order totals; brand medians on parts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from . import query
from .base import O, OD, day_sql, order_days, orders, r, table
from ..functions import timeaxis as T
from ..functions.numeric import avg_if, cents, ratio, stable, sum_if
from ..operators import quality, quantiles, season

COMPLETE_DAYS = 85  # stands for the hours a whole winter must hold


def M2(e):
    return f"round({e} + 0.00001, 2)"


@query(f"WITH {O} SELECT m, {M2('avg(p)/100.0')} AS mean_price, CAST(floor(avg(p)/100.0 + 0.5) AS BIGINT) AS shown, count(*) AS n FROM O GROUP BY 1")
def month_mean(spark, sf):
    mean = F.avg("p") / 100.0
    return orders(spark, sf).groupBy("m").agg(
        stable(mean, 2).alias("mean_price"), F.floor(mean + 0.5).alias("shown"), F.count("*").alias("n")
    )


@query(f"""WITH {O}, S AS (SELECT m, floor(avg(p)/100.0 + 0.5) AS shown FROM O GROUP BY 1)
SELECT m, CAST(shown AS BIGINT) AS shown, CAST(floor(100.0*(shown - lag(shown) OVER (ORDER BY m))/lag(shown) OVER (ORDER BY m) + 0.5) AS BIGINT) AS step_pct FROM S""")
def month_step_change(spark, sf):
    shown = orders(spark, sf).groupBy("m").agg(F.floor(F.avg("p") / 100.0 + 0.5).alias("shown"))
    before = F.lag("shown").over(Window.orderBy("m"))  # 12 rows
    return shown.select("m", "shown", F.floor(ratio(100.0 * (F.col("shown") - before), before) + 0.5).alias("step_pct"))


@query(f"""WITH {O}, S AS (SELECT y, avg(p) FILTER (WHERE m IN (12,1,2))/100.0 AS winter, avg(p) FILTER (WHERE m IN (6,7,8,9))/100.0 AS summer,
avg(p) FILTER (WHERE m = 8)/100.0 - avg(p) FILTER (WHERE m = 6)/100.0 AS jump FROM O GROUP BY 1)
SELECT y, {M2('winter')} AS winter, {M2('summer')} AS summer, {M2('jump')} AS jump FROM S""")
def season_means(spark, sf):
    m = F.col("m")
    a = orders(spark, sf).groupBy("y").agg(
        stable(avg_if(m.isin(*season.WINTER), "p") / 100.0, 2).alias("winter"),
        stable(avg_if(m.isin(*season.LOAD_SUMMER), "p") / 100.0, 2).alias("summer"),
        stable(avg_if(m == 8, "p") / 100.0 - avg_if(m == 6, "p") / 100.0, 2).alias("jump"),
    )
    return a


@query(f"WITH {O} SELECT y, {r('100.0*coalesce(sum(p) FILTER (WHERE m BETWEEN 3 AND 6), 0)/sum(p)')} AS share FROM O GROUP BY 1")
def season_share(spark, sf):
    spring = F.coalesce(sum_if(F.col("m").between(3, 6), "p"), F.lit(0))
    return orders(spark, sf).groupBy("y").agg(stable(ratio(100.0 * spring, F.sum("p"))).alias("share"))


_SUM = OD + """,
SM AS (SELECT * FROM OD WHERE m BETWEEN 6 AND 9),
SR AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY v DESC, d) AS rk FROM SM)"""


def summer_days(spark, sf):
    return order_days(spark, sf).filter(F.col("m").isin(*season.LOAD_SUMMER))


@query(f"""WITH {_SUM} SELECT y, count(*) AS n, max(v) AS maximum, {M2('avg(v) FILTER (WHERE rk <= 20)')} AS top_mean,
{M2('median(v)')} AS median, count(*) FILTER (WHERE v >= 2500000) AS n_at_level FROM SR GROUP BY 1""")
def summer_table(spark, sf):
    t = season.season_peaks(summer_days(spark, sf), "y", "v", "d", 20, 2_500_000.0)
    return t.select("y", "n", "maximum", stable("top_mean", 2).alias("top_mean"), stable("median", 2).alias("median"), "n_at_level")


@query(f"WITH {_SUM} SELECT y, {M2('avg(v)')} AS top_mean FROM SR WHERE rk <= 20 GROUP BY 1")
def top20_mean_by_year(spark, sf):
    t = season.top_k_mean(summer_days(spark, sf), ["y"], "v", 20, ["d"])
    return t.select("y", stable("top_mean", 2).alias("top_mean"))


@query(f"""WITH {OD}, S AS (SELECT *, m BETWEEN 6 AND 9 AS summer, row_number() OVER (PARTITION BY y, m BETWEEN 6 AND 9 ORDER BY v DESC, d) AS rk FROM OD)
SELECT y, count(*) AS n_days, {M2('avg(v)')} AS mean, {M2('max(abs(v - 100000.0*n)) FILTER (WHERE rk <= 20 AND summer)')} AS top_summer_gap FROM S GROUP BY 1""")
def top20_abs_by_year_season(spark, sf):
    days = order_days(spark, sf).withColumn("summer", F.col("m").between(6, 9))
    # days of a year by now: ranking them all costs less than a second pass
    rank = F.row_number().over(Window.partitionBy("y", "summer").orderBy(F.desc("v"), "d"))
    top = F.col("summer") & (F.col("rank") <= 20)
    return days.withColumn("rank", rank).groupBy("y").agg(
        F.count("*").alias("n_days"),
        stable(F.avg("v"), 2).alias("mean"),
        stable(F.max(F.when(top, F.abs(F.col("v") - 100000.0 * F.col("n")))), 2).alias("top_summer_gap"),
    )


_WIN = OD + f""",
WD AS (SELECT CASE WHEN m = 12 THEN y ELSE y - 1 END AS winter, * FROM OD WHERE m IN (12, 1, 2)),
WR AS (SELECT *, row_number() OVER (PARTITION BY winter ORDER BY v DESC, d) AS rk FROM WD),
WT AS (SELECT winter, count(*) AS n, max(v) AS maximum, max(CASE WHEN rk = 1 THEN m END) AS month_of_max, count(*) >= {COMPLETE_DAYS} AS complete FROM WR GROUP BY 1)"""


def winter_days_table(spark, sf):
    return season.winters(order_days(spark, sf), "y", "m", "v", COMPLETE_DAYS, "d")


@query(f"WITH {_WIN} SELECT * FROM WT")
def winter_table(spark, sf):
    return winter_days_table(spark, sf)


@query(f"WITH {_WIN} SELECT winter, {day_sql('d')} AS day, m AS month, v AS peak FROM WR WHERE rk = 1")
def winter_peak_month(spark, sf):
    days = order_days(spark, sf).filter(F.col("m").isin(*season.WINTER))
    named = days.withColumn("winter", T.winter_vintage("y", "m"))
    return season.top_k(named, ["winter"], "v", 1, ["d"]).select(
        "winter", T.day_text("d").alias("day"), F.col("m").alias("month"), F.col("v").alias("peak")
    )


@query(f"""WITH {_WIN}, S AS (SELECT y, max(v) AS p FROM OD WHERE m BETWEEN 6 AND 9 GROUP BY 1)
SELECT S.y, S.p AS summer_peak, WT.maximum AS winter_peak, {M2('S.p - WT.maximum')} AS gap FROM S JOIN WT ON WT.winter = S.y - 1 WHERE complete""")
def summer_minus_prev_winter(spark, sf):
    t = season.summer_less_previous_winter(order_days(spark, sf), "y", "m", "v", COMPLETE_DAYS)
    return t.withColumn("gap", stable("gap", 2))


_Q = {"q50": 0.5, "q75": 0.75, "q90": 0.9, "q99": 0.99}
_QSQL = ", ".join(f"{M2(f'quantile_cont(v, {p})')} AS {n}" for n, p in _Q.items())


@query(f"WITH {OD} SELECT y, {_QSQL}, max(v) AS maximum FROM OD WHERE m BETWEEN 6 AND 9 GROUP BY 1")
def seasonal_quantiles(spark, sf):
    days = summer_days(spark, sf)
    q = quantiles.small_group_quantiles(days, ["y"], "v", {**_Q, "maximum": 1.0})
    return q.select("y", *[stable(n, 2).alias(n) for n in _Q], "maximum")


_GAIN = f"""G AS (SELECT min(y) AS first_year, max(y) AS last_year FROM Q)"""


@query(f"""WITH {OD}, Q AS (SELECT y, {_QSQL}, max(v) AS maximum FROM OD WHERE m BETWEEN 6 AND 9 GROUP BY 1), {_GAIN}
SELECT first_year, last_year, {M2('b.q50 - a.q50')} AS gain_q50, {M2('b.q90 - a.q90')} AS gain_q90, {M2('b.maximum - a.maximum')} AS gain_maximum
FROM G, Q a, Q b WHERE a.y = first_year AND b.y = last_year""")
def first_last_gain(spark, sf):
    g = season.first_last_gain(seasonal_quantiles(spark, sf), "y", ["q50", "q90", "maximum"])
    return g.select("first_year", "last_year", *[stable(f"gain_{c}", 2).alias(f"gain_{c}") for c in ("q50", "q90", "maximum")])


@query(f"""WITH {OD}, S AS (SELECT y, max(v) AS p FROM OD WHERE m BETWEEN 6 AND 9 GROUP BY 1),
L AS (SELECT y, p - lag(p) OVER (ORDER BY y) AS step FROM S)
SELECT count(*) AS n, count(*) FILTER (WHERE step <= 0) AS n_drops, coalesce(bool_and(step > 0), true) AS increasing FROM L""")
def monotone_series(spark, sf):
    peaks = summer_days(spark, sf).groupBy("y").agg(F.max("v").alias("p"))
    return season.strictly_increasing(peaks, "y", "p")


@query(f"""WITH {OD}, Q AS (SELECT y, {_QSQL}, max(v) AS maximum FROM OD WHERE m BETWEEN 6 AND 9 GROUP BY 1), {_GAIN},
U AS (SELECT u.place, u.name, CASE u.place WHEN 1 THEN b.q50-a.q50 WHEN 2 THEN b.q75-a.q75 WHEN 3 THEN b.q90-a.q90 WHEN 4 THEN b.q99-a.q99 ELSE b.maximum-a.maximum END AS gain
  FROM G, Q a, Q b, (VALUES (1,'q50'),(2,'q75'),(3,'q90'),(4,'q99'),(5,'maximum')) u(place, name) WHERE a.y = first_year AND b.y = last_year)
SELECT name, {M2('gain')} AS gain, coalesce(round(gain, 2) > round(lag(gain) OVER (ORDER BY place), 2), true) AS above_previous FROM U""")
def quantile_gains(spark, sf):
    """Gains from the first to the last summer, and whether they grow with the quantile."""
    names = [*_Q, "maximum"]
    g = season.first_last_gain(seasonal_quantiles(spark, sf), "y", names)
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), F.col(f"gain_{n}").alias("gain")) for i, n in enumerate(names)])
    by_place = Window.orderBy("place")  # five rows
    d = g.select(F.inline(rows))
    above = F.round("gain", 2) > F.round(F.lag("gain").over(by_place), 2)
    return d.select("name", stable("gain", 2).alias("gain"), F.coalesce(above, F.lit(True)).alias("above_previous"))


@query(f"WITH {OD} SELECT {day_sql('d')} AS day, v AS total, n FROM OD ORDER BY v DESC, d LIMIT 1")
def record_period(spark, sf):
    best = order_days(spark, sf).orderBy(F.desc("v"), "d").limit(1)
    return best.select(T.day_text("d").alias("day"), F.col("v").alias("total"), "n")


@query(f"""SELECT p_brand AS brand, count(*) AS n, {M2('median(p_retailprice)')} AS median_price, {M2('quantile_cont(p_retailprice, 0.9)')} AS q90
FROM part GROUP BY 1 ORDER BY n DESC, brand LIMIT 20""")
def median_by_group_top20(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), "p_retailprice")
    top = part.groupBy("brand").agg(F.count("p_retailprice").alias("n")).orderBy(F.desc("n"), "brand").limit(20)
    # twenty rows: only their groups are ordered
    few = part.join(F.broadcast(top.select("brand")), "brand", "left_semi")
    q = quantiles.exact_quantiles(few, ["brand"], "p_retailprice", {"median_price": 0.5, "q90": 0.9})
    return q.select("brand", "n", stable("median_price", 2).alias("median_price"), stable("q90", 2).alias("q90"))


@query(f"""WITH {O}, A AS (SELECT m, count(*) AS n, avg(p)/100.0 AS mean FROM O WHERE m IN (6, 7) GROUP BY 1),
B AS (SELECT m, sum(day_sum)/sum(day_n)/100.0 AS mean FROM (SELECT m, d, sum(p) AS day_sum, count(*) AS day_n FROM O WHERE m IN (6, 7) GROUP BY 1, 2) GROUP BY 1)
SELECT (SELECT n FROM A WHERE m = 6) AS n_june, (SELECT n FROM A WHERE m = 7) AS n_july,
{M2('(SELECT mean FROM A WHERE m = 6)')} AS june, {M2('(SELECT mean FROM A WHERE m = 7)')} AS july,
round(100.0*((SELECT mean FROM A WHERE m = 7)/(SELECT mean FROM A WHERE m = 6) - 1) + 0.000000001, 6) AS change_pct,
(SELECT bool_and(abs(A.mean - B.mean) <= 1e-7) FROM A JOIN B USING (m)) AS reproduced""")
def proof_two_month_change(spark, sf):
    o = orders(spark, sf).filter(F.col("m").isin(6, 7))
    direct = o.groupBy("m").agg(F.count("*").alias("n"), (F.avg("p") / 100.0).alias("mean"))
    by_day = o.groupBy("m", "d").agg(F.sum("p").alias("s"), F.count("*").alias("k"))
    again = by_day.groupBy("m").agg((F.sum("s") / F.sum("k") / 100.0).alias("again"))
    both = direct.join(again, "m")
    of = lambda m, c: F.max(F.when(F.col("m") == m, F.col(c)))
    return both.agg(
        of(6, "n").alias("n_june"),
        of(7, "n").alias("n_july"),
        stable(of(6, "mean"), 2).alias("june"),
        stable(of(7, "mean"), 2).alias("july"),
        stable(100.0 * (of(7, "mean") / of(6, "mean") - 1)).alias("change_pct"),
        F.every(F.abs(F.col("mean") - F.col("again")) <= 1e-7).alias("reproduced"),
    )


@query(f"""WITH {O} SELECT y, {', '.join(f"CAST(coalesce(count(*) FILTER (WHERE m = {m}), 0) AS BIGINT) AS n{m:02d}" for m in range(1, 13))},
count(DISTINCT m) FILTER (WHERE p >= 40000000) AS months_with_big FROM O GROUP BY 1""")
def year_month_matrix(spark, sf):
    cells = orders(spark, sf).groupBy("y", "m").agg(
        F.count("*").alias("n"), F.count_if(F.col("p") >= 40000000).alias("n_big")
    )
    return cells.groupBy("y").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("m") == m, F.col("n"))), F.lit(0)).cast("bigint").alias(f"n{m:02d}")
            for m in range(1, 13)
        ],
        F.count_if(F.col("n_big") > 0).alias("months_with_big"),
    )


@query(f"WITH {O}, S AS (SELECT y, count(DISTINCT m) AS n_months FROM O GROUP BY 1) SELECT * FROM S WHERE n_months <> 12")
def complete_periods(spark, sf):
    return quality.incomplete_years(orders(spark, sf), "y", "m")


@query("""WITH L AS (SELECT extract('year' FROM l_shipdate) AS y, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS c FROM lineitem GROUP BY 1),
P AS (SELECT extract('year' FROM o_orderdate) AS y, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) AS c FROM orders GROUP BY 1)
SELECT y, round(1.0*L.c/nullif(P.c, 0) + 0.000000001, 6) AS intensity, y >= 1999 AS later_regime FROM L JOIN P USING (y)""")
def intensity_ratio(spark, sf):
    num = table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").cast("bigint").alias("y")).agg(
        F.sum(cents("l_extendedprice")).alias("a")
    )
    den = orders(spark, sf).groupBy("y").agg(F.sum("p").alias("b"))
    return num.join(den, "y").select("y", stable(ratio(1.0 * F.col("a"), "b")).alias("intensity"), (F.col("y") >= 1999).alias("later_regime"))
