"""Time-axis queries: conversions, clock changes, calendars, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from .base import AS_OF, HL, O, day_sql, hourly_local, orders, table, ts_sql
from ..functions import timeaxis as T
from ..functions.geo import solar_noon_utc_hours
from ..functions.numeric import stable
from ..operators import quality

# an hourly label for every line of an order: ship day plus the order key's hour
LABEL = "L AS (SELECT *, l_shipdate + CAST(l_orderkey % 24 AS INTEGER) * INTERVAL 1 HOUR AS label FROM lineitem)"


def labels(spark, sf):
    """label, n: lines per hourly label. Labels repeat, so they are counted before any conversion."""
    label = T.plus_hours("l_shipdate", F.col("l_orderkey") % 24)
    return table(spark, sf, "lineitem").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query(f"""WITH {LABEL}, C AS (SELECT label AS utc, timezone('Europe/Paris', timezone('UTC', label)) AS loc FROM L)
SELECT {ts_sql('utc')} AS utc, {ts_sql('loc')} AS loc, count(*) AS n FROM C GROUP BY 1, 2""")
def utc_to_local(spark, sf):
    return labels(spark, sf).select(T.as_text("label").alias("utc"), T.as_text(T.utc_to_local("label")).alias("loc"), "n")


@query(f"""WITH {LABEL}, C AS (SELECT label, timezone('UTC', timezone('Europe/Paris', label)) AS utc FROM L)
SELECT {ts_sql('label')} AS label, {ts_sql('utc')} AS utc, count(*) AS n FROM C GROUP BY 1, 2""")
def local_to_utc(spark, sf):
    return labels(spark, sf).select(T.as_text("label").alias("label"), T.as_text(T.local_to_utc("label")).alias("utc"), "n")


@query(f"""WITH {LABEL} SELECT {ts_sql('label')} AS label, count(*) AS n FROM L
WHERE timezone('Europe/Paris', timezone('Europe/Paris', label)) <> label GROUP BY 1""")
def dst_phantom_hours(spark, sf):
    # the test names the count so that it stays above the aggregation, once per distinct label
    phantom = F.when(F.col("n") > 0, T.is_phantom("label"))
    return labels(spark, sf).filter(phantom).select(T.as_text("label").alias("label"), "n")


_FOLD = """F AS (SELECT l_orderkey AS k, label AS utc, timezone('Europe/Paris', timezone('UTC', label)) AS loc FROM L),
A AS (SELECT loc FROM (SELECT DISTINCT utc, loc FROM F) GROUP BY 1 HAVING count(*) > 1)"""


@query(f"""WITH {LABEL}, {_FOLD} SELECT {ts_sql('loc')} AS loc, count(*) AS n_rows, count(DISTINCT utc) AS n_instants
FROM F WHERE loc IN (SELECT loc FROM A) GROUP BY 1""")
def ambiguous_local_hours(spark, sf):
    local = labels(spark, sf).select(T.utc_to_local("label").alias("loc"), "n")
    # one row per instant by now: a local hour with two rows occurred twice
    twice = local.groupBy("loc").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_instants"))
    return twice.filter("n_instants > 1").select(T.as_text("loc").alias("loc"), "n_rows", "n_instants")


@query(f"""WITH {LABEL}, C AS (SELECT extract('month' FROM label) AS m,
  epoch(timezone('Europe/Paris', timezone('UTC', label))) - epoch(label) AS s FROM L)
SELECT m, CAST(min(s)/3600 AS DOUBLE) AS min_offset, CAST(max(s)/3600 AS DOUBLE) AS max_offset, count(*) AS n,
count(*) FILTER (WHERE s = 7200) AS n_summer_time FROM C GROUP BY 1""")
def utc_offset_by_month(spark, sf):
    d = labels(spark, sf).select(F.month("label").cast("bigint").alias("m"), T.utc_offset_hours("label").alias("o"), "n")
    by_offset = d.groupBy("m", "o").agg(F.sum("n").alias("n"))
    return by_offset.groupBy("m").agg(
        F.min("o").alias("min_offset"),
        F.max("o").alias("max_offset"),
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("o") == 2, F.col("n"))), F.lit(0)).alias("n_summer_time"),
    )


@query(f"""WITH {O}, Y AS (SELECT DISTINCT y FROM O),
D AS (SELECT y, mo, (SELECT max(x) FROM (SELECT make_date(CAST(y AS INTEGER), mo, dd) AS x FROM range(25, 32) t(dd))
  WHERE extract('dow' FROM x) = 0) AS day FROM Y, (VALUES (3), (10)) v(mo))
SELECT D.y, CAST(mo AS BIGINT) AS month, {day_sql('day')} AS day, (SELECT count(*) FROM O WHERE O.d = D.day) AS n_orders FROM D""")
def dst_transition_days(spark, sf):
    o = orders(spark, sf).groupBy("y", "d").agg(F.count("*").alias("n"))
    sundays = [
        F.when(F.col("d") == T.last_sunday("y", m), F.col("n")) for m in (3, 10)
    ]
    per_year = o.groupBy("y").agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(f"n{m}") for s, m in zip(sundays, (3, 10))])
    rows = F.array(
        *[
            F.struct(
                F.lit(m).cast("bigint").alias("month"),
                T.day_text(T.last_sunday("y", m)).alias("day"),
                F.col(f"n{m}").alias("n_orders"),
            )
            for m in (3, 10)
        ]
    )
    return per_year.select("y", F.inline(rows))


@query(f"""SELECT event_type AS series, {day_sql('ts - INTERVAL 1 HOUR')} AS day, count(*) AS n FROM events GROUP BY 1, 2""")
def fixed_offset_to_utc(spark, sf):
    day = T.day_text(T.plus_hours("ts", -1))
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("series"), day.alias("day")).agg(
        F.count("*").alias("n")
    )


@query(f"""WITH P AS (SELECT strftime(ts, '%Y%m%d%H') AS code, ts FROM events)
SELECT code, strftime(strptime(code, '%Y%m%d%H'), '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(strptime(code, '%Y%m%d%H'), '%d/%m/%Y') AS french,
count(*) AS n, max(CAST(epoch(date_trunc('hour', ts)) AS BIGINT)) = max(CAST(epoch(strptime(code, '%Y%m%d%H')) AS BIGINT)) AS same_hour
FROM P GROUP BY 1""")
def parse_format_timestamps(spark, sf):
    coded = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyyMMddHH").alias("code")).agg(
        F.count("*").alias("n"), F.max(T.hour_index("ts")).alias("hi")
    )
    back = F.to_timestamp_ntz("code", F.lit("yyyyMMddHH"))
    return coded.select(
        "code",
        T.iso_z(back).alias("iso"),
        F.date_format(back, "dd/MM/yyyy").alias("french"),
        "n",
        (T.hour_index(back) == F.col("hi")).alias("same_hour"),
    )


@query(f"""WITH {O}, Y AS (SELECT DISTINCT y FROM O), C AS (SELECT y, CAST(g.x AS DATE) AS d FROM Y,
  LATERAL generate_series(make_date(CAST(y AS INTEGER), 6, 1)::TIMESTAMP, make_date(CAST(y AS INTEGER), 8, 31)::TIMESTAMP, INTERVAL 1 DAY) g(x))
SELECT C.y, count(*) AS n_calendar, count(S.d) AS n_measured FROM C LEFT JOIN (SELECT DISTINCT d FROM O) S ON S.d = C.d GROUP BY 1""")
def calendar_season_days(spark, sf):
    days = orders(spark, sf).select("y", "d").distinct()
    first, last = (F.make_date(F.col("y").cast("int"), F.lit(a), F.lit(b)) for a, b in ((6, 1), (8, 31)))
    calendar = days.select("y").distinct().select("y", F.explode(F.sequence(first, last)).alias("d"))
    seen = days.select("d", F.lit(1).alias("seen"))
    return calendar.join(seen, "d", "left").groupBy("y").agg(
        F.count("*").alias("n_calendar"), F.count("seen").alias("n_measured")
    )


@query(f"""WITH {HL} SELECT series, {day_sql('d')} AS day, count(*) AS n FROM HL
WHERE d > (SELECT min(d) FROM HL) AND d < (SELECT max(d) FROM HL) GROUP BY 1, 2""")
def trim_edge_days(spark, sf):
    # a day that depends on the value stays above the hourly aggregation: the zone conversion in it
    # then runs once per hour and series, not once per raw row
    hours = hourly_local(spark, sf).withColumn("d", F.when(F.col("v").isNotNull(), F.col("d")))
    kept = quality.trim_edge_days(hours, "d")
    return kept.groupBy("series", T.day_text("d").alias("day")).agg(F.count("*").alias("n"))


@query(f"""WITH A AS (SELECT event_type AS series, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts)))/3600000000.0 AS age FROM events GROUP BY 1)
SELECT series, round(age + 0.0000001, 4) AS age_h, CASE WHEN age > 24 THEN 'stale' WHEN age > 12 THEN 'warn' ELSE 'fresh' END AS tier FROM A""")
def freshness_tier(spark, sf):
    latest = table(spark, sf, "events").groupBy(F.col("event_type").alias("series")).agg(F.max("ts").alias("last"))
    age = T.as_of_age_hours("last", AS_OF)
    return latest.select("series", stable(age, 4).alias("age_h"), T.freshness(age).alias("tier"))


@query(f"""WITH D AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1),
G AS (SELECT *, 2*pi()/365.0*(extract('doy' FROM d) - 0.5) AS g FROM D),
E AS (SELECT *, 229.18*(0.000075 + 0.001868*cos(g) - 0.032077*sin(g) - 0.014615*cos(2*g) - 0.040849*sin(2*g)) AS eq FROM G)
SELECT {day_sql('d')} AS day, n, round(12.0 - 9.0/15.0 - eq/60.0 + 0.000000001, 6) AS noon_utc,
round(12.0 - 9.0/15.0 - eq/60.0 + (epoch(timezone('Europe/Paris', timezone('UTC', d + INTERVAL 12 HOUR))) - epoch(d + INTERVAL 12 HOUR))/3600.0 + 0.000000001, 6) AS noon_legal FROM E""")
def solar_noon(spark, sf):
    days = orders(spark, sf).groupBy("d").agg(F.count("*").alias("n"))
    noon = solar_noon_utc_hours(F.col("d"), 9.0)
    legal = noon + T.utc_offset_hours(T.plus_hours(T.midnight("d"), 12))
    return days.select(T.day_text("d").alias("day"), "n", stable(noon).alias("noon_utc"), stable(legal).alias("noon_legal"))
