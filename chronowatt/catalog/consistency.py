"""Guards, reconciliations and coverage as queries: each returns verdict rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from .base import H, HL, OD, PD, PY, day_sql, hourly, hourly_local, part_days, part_years, r, table, ts_sql
from ..functions import timeaxis as T
from ..functions.numeric import number, cents, percent, stable
from ..operators import coverage, joins, quality

TYPES = ["click", "error", "purchase", "signup", "view"]
TYPES_SQL = ", ".join(f"('{t}')" for t in TYPES)


@query("SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    keyed = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").cast("bigint").alias("linenumber")
    )
    return quality.duplicates(keyed, ["orderkey", "linenumber"])


@query("""SELECT l_returnflag AS flag, count(*) AS n, count(*) FILTER (WHERE TRY_CAST(l_linestatus AS DOUBLE) IS NULL) AS null_status_number,
count(*) FILTER (WHERE TRY_CAST(CAST(l_linenumber AS VARCHAR) AS DOUBLE) IS NULL) AS null_line_number, count(*) FILTER (WHERE nullif(l_discount, 0) IS NULL) AS null_discount,
count(*) FILTER (WHERE l_extendedprice IS NULL) AS null_price FROM lineitem GROUP BY 1""")
def try_cast_null_audit(spark, sf):
    d = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        number(F.col("l_linestatus")).alias("status_number"),
        number(F.col("l_linenumber").cast("string")).alias("line_number"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"),
        F.col("l_extendedprice").alias("price"),
    )
    return quality.null_counts(d, ["status_number", "line_number", "discount", "price"], ["flag"])


@query("""WITH T AS (SELECT l_returnflag AS flag, CASE l_orderkey % 9 WHEN 0 THEN 'NaN' WHEN 1 THEN 'nan' WHEN 2 THEN 'Infinity' WHEN 3 THEN '-inf' WHEN 4 THEN ' 1e3 '
  WHEN 5 THEN '.5' WHEN 6 THEN 'infinit' WHEN 7 THEN '' ELSE CAST(l_linenumber AS VARCHAR) || '.' END AS t FROM lineitem), X AS (SELECT flag, TRY_CAST(t AS DOUBLE) AS x FROM T)
SELECT flag, count(*) FILTER (WHERE x IS NULL) AS n_null, count(*) FILTER (WHERE isnan(x)) AS n_nan, count(*) FILTER (WHERE isinf(x) AND x > 0) AS n_inf,
count(*) FILTER (WHERE isinf(x) AND x < 0) AS n_minus_inf, CAST(sum(CASE WHEN isfinite(x) THEN x * 10 END) AS BIGINT) AS tenfold FROM X GROUP BY 1""")
def try_cast_special_numbers(spark, sf):
    """Numbers in text that are no finite numbers, and texts that nearly are numbers."""
    key, made = F.col("l_orderkey") % 9, ["NaN", "nan", "Infinity", "-inf", " 1e3 ", ".5", "infinit", ""]
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit("."))
    for i, value in enumerate(made):
        text = F.when(key == i, value).otherwise(text)
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), number(text).alias("x"))
    x, top = F.col("x"), float("inf")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < top)
    return d.groupBy("flag").agg(
        F.count_if(x.isNull()).alias("n_null"),
        F.count_if(F.isnan(x)).alias("n_nan"),
        F.count_if(x == top).alias("n_inf"),
        F.count_if(x == -top).alias("n_minus_inf"),
        F.sum(F.when(finite, x * 10)).cast("bigint").alias("tenfold"),
    )


@query(f"""WITH {PD}, S AS (SELECT extract('month' FROM day) AS m, CAST(sum(tot) AS BIGINT) AS whole, CAST(3*sum(af+ao) AS BIGINT) AS part FROM PD GROUP BY 1)
SELECT m, whole/100.0 AS whole, part/100.0 AS part FROM S WHERE whole < part""")
def whole_ge_part(spark, sf):
    d = part_days(spark, sf).select(
        F.month("day").cast("bigint").alias("m"), "tot", (3 * (F.col("af") + F.col("ao"))).alias("part3")
    )
    low = quality.part_above_whole(d, ["m"], "tot", "part3")
    return low.select("m", (F.col("whole") / 100.0).alias("whole"), (F.col("part") / 100.0).alias("part"))


@query(f"WITH {H} SELECT series, count(DISTINCT h) AS n_hours, date_diff('hour', min(h), max(h)) + 1 AS n_expected, count(DISTINCT h) = date_diff('hour', min(h), max(h)) + 1 AS regular FROM H GROUP BY 1")
def grid_regularity(spark, sf):
    return quality.grid_regularity(hourly(spark, sf), F.col("hi"), ["series"])


@query(f"""WITH {HL}, E AS (SELECT series, min(d) AS a, max(d) AS b FROM HL GROUP BY 1), S AS (SELECT series, d, count(DISTINCT hr) AS n_hours FROM HL GROUP BY 1, 2)
SELECT series, {day_sql('d')} AS day, n_hours, d = a OR d = b AS at_edge FROM S JOIN E USING (series) WHERE n_hours < 23""")
def incomplete_days(spark, sf):
    hollow = quality.hollow_days(hourly_local(spark, sf), ["series"], "d", "hr")
    return hollow.select("series", T.day_text("d").alias("day"), "n_hours", "at_edge")


@query(f"""WITH {HL}, N AS (SELECT * FROM HL WHERE n >= 5), E AS (SELECT min(d) AS a, max(d) AS b FROM N), S AS (SELECT d, count(DISTINCT hr) AS n_hours FROM N GROUP BY 1)
SELECT {day_sql('d')} AS day, n_hours, d = a OR d = b AS at_edge FROM S, E WHERE n_hours < 23""")
def incomplete_days_network(spark, sf):
    """Days that the whole network lacks hours of: an hour counts if any series has enough readings in it."""
    hollow = quality.hollow_days(hourly_local(spark, sf).filter("n >= 5"), [], "d", "hr")
    return hollow.select(T.day_text("d").alias("day"), "n_hours", "at_edge")


@query("""SELECT count(*) AS n_rows, count(*) FILTER (WHERE value < 0) AS negative, count(*) FILTER (WHERE value IS NULL) AS missing,
count(*) FILTER (WHERE event_type NOT IN ('click','error','purchase','signup','view')) AS unknown_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-01') AS too_early,
count(*) FILTER (WHERE props NOT LIKE '{%}') AS bad_props FROM events""")
def guard_summary(spark, sf):
    return quality.guard_counts(
        table(spark, sf, "events"),
        [
            quality.Guard("negative", F.col("value") < 0),
            quality.Guard("missing", F.col("value").isNull()),
            quality.Guard("unknown_type", ~F.col("event_type").isin(*TYPES)),
            quality.Guard("too_early", F.col("ts") < F.lit("2024-01-01").cast("timestamp_ntz")),
            quality.Guard("bad_props", ~F.col("props").like("{%}")),
        ],
    )


@query(f"""WITH {HL}, D AS (SELECT DISTINCT d FROM HL), X AS (SELECT D.d, t.series FROM D, (VALUES {TYPES_SQL}, ('refund')) t(series))
SELECT X.series, {day_sql('X.d')} AS day FROM X WHERE NOT EXISTS (SELECT 1 FROM HL WHERE HL.series = X.series AND HL.d = X.d)""")
def missing_expected_pairs(spark, sf):
    seen = measured(spark, sf).select("series", "d").distinct()
    names = F.array(*[F.lit(t) for t in (*TYPES, "refund")])
    expected = seen.select("d").distinct().select("d", F.explode(names).alias("series"))
    return quality.missing_expected(expected, seen, ["series", "d"]).select("series", T.day_text("d").alias("day"))


@query("""SELECT 'customer_without_order' AS side, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'order_without_customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey)""")
def orphans_after_join(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    buyers = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"))

    counts = quality.orphan_counts(customers, buyers, ["custkey"])
    sides = (("customer_without_order", "n_left"), ("order_without_customer", "n_right"))
    rows = F.array(*[F.struct(F.lit(name).alias("side"), F.col(c).alias("n")) for name, c in sides])
    return counts.select(F.inline(rows))


# Expected series of the audit: type, first and last day it must cover. The data lack "refund", the days before the
# stream begins and those after it ends; nothing is taken from the data to make a finding.
EXPECTED = [
    ("click", "2024-01-01", "2024-01-30"),
    ("error", "2023-12-30", "2024-01-30"),
    ("purchase", "2024-01-01", "2024-02-03"),
    ("refund", "2024-01-01", "2024-01-30"),
    ("signup", "2024-01-01", "2024-01-30"),
]
_EXP_SQL = ", ".join(f"('{s}', DATE '{a}' - DATE '1970-01-01', DATE '{b}' - DATE '1970-01-01')" for s, a, b in EXPECTED)
_OBS = HL + """,
OB AS (SELECT DISTINCT series, d - DATE '1970-01-01' AS step FROM HL),
EX(series, a, b) AS (VALUES """ + _EXP_SQL + """),
SN AS (SELECT series, min(step) AS x, max(step) AS y, count(*) AS n FROM OB GROUP BY 1)"""
_CONT = """SELECT 'absent' AS "check", EX.series AS key, '' AS detail FROM EX LEFT JOIN SN USING (series) WHERE n IS NULL
UNION ALL SELECT 'interrupted', series, CAST(y - x + 1 - n AS VARCHAR) FROM SN WHERE y - x + 1 <> n
UNION ALL SELECT 'not_expected', series, '' FROM SN WHERE series NOT IN (SELECT series FROM EX)
UNION ALL SELECT 'late_start', series, CAST(x AS VARCHAR) FROM EX JOIN SN USING (series) WHERE x > a
UNION ALL SELECT 'early_stop', series, CAST(y AS VARCHAR) FROM EX JOIN SN USING (series) WHERE y < b"""


def measured(spark, sf):
    """Hours with a value. The filter makes every branch of an audit need the same columns of the
    hourly series, so that they share one shuffle and one scan."""
    return hourly_local(spark, sf).filter(F.col("v").isNotNull())


def _audited_hours(spark, sf):
    """series, d and step: the day as a number, so that steps of all months follow one another."""
    return measured(spark, sf).select("series", "d", F.unix_date("d").cast("bigint").alias("step"))


def _observed_days(spark, sf):
    return _audited_hours(spark, sf).select("series", "step").distinct()


def _continuity(spark, sf):
    expected = spark.createDataFrame(EXPECTED, "series string, a string, b string")
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("bigint")
    expected = expected.select("series", day("a").alias("first_step"), day("b").alias("last_step"))
    return coverage.continuity(_observed_days(spark, sf), expected, ["series"], "step", "first_step", "last_step")


@query(f"WITH {_OBS} {_CONT}")
def coverage_continuity(spark, sf):
    return _continuity(spark, sf)


@query(f"""WITH {_OBS}, DC AS (SELECT step, count(DISTINCT series) AS n FROM OB GROUP BY 1),
MM AS (SELECT date_trunc('month', min(d)) AS a, last_day(max(d)) AS z FROM HL),
YS AS (SELECT CAST(unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) - DATE '1970-01-01' AS step FROM MM),
HD AS (SELECT series, d - DATE '1970-01-01' AS step, count(*) AS n FROM HL GROUP BY 1, 2)
SELECT 'empty_year' AS "check", CAST(step AS VARCHAR) AS key, '0' AS detail FROM YS WHERE step NOT IN (SELECT step FROM OB)
UNION ALL SELECT 'station_floor', CAST(YS.step AS VARCHAR), CAST(coalesce(n, 0) AS VARCHAR) FROM YS LEFT JOIN DC USING (step) WHERE coalesce(n, 0) < 5
UNION ALL SELECT 'days_floor', step || '/' || series, CAST(n AS VARCHAR) FROM HD WHERE n < 20
UNION ALL {_CONT}""")
def coverage_audit(spark, sf):
    observed = _observed_days(spark, sf)
    hours = _audited_hours(spark, sf)
    # the calendar of the audit: the whole months that the data touch
    days = F.sequence(F.trunc("first", "month"), F.last_day("last"))
    ends = hours.agg(F.min("d").alias("first"), F.max("d").alias("last"))
    steps = ends.select(F.explode(days).alias("day")).select(F.unix_date("day").cast("bigint").alias("step"))
    return coverage.union_all(
        [
            coverage.empty_years(observed, steps, "step"),
            coverage.station_floor(observed, steps, "step", "series", 5),
            coverage.days_floor(hours, "step", "series", 20),
            _continuity(spark, sf),
        ]
    )


DECLARED = [("click", "view"), ("error", "fault"), ("purchase", "sale"), ("signup", "view"), ("refund", "sale")]
_CLASS = "CASE event_type WHEN 'error' THEN 'fault' WHEN 'purchase' THEN 'sale' WHEN 'signup' THEN 'sale' ELSE 'view' END"


@query(f"""WITH D(series, declared) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in DECLARED)}),
V AS (SELECT event_type AS series, arg_max({_CLASS}, ts) AS observed FROM events GROUP BY 1)
SELECT coalesce(D.series, V.series) AS series, declared, observed, CASE WHEN observed IS NULL THEN 'not_observed' WHEN declared IS NULL THEN 'not_declared'
WHEN declared <> observed THEN 'conflict' ELSE 'same' END AS status FROM D FULL JOIN V ON D.series = V.series""")
def declared_vs_observed(spark, sf):
    kind = F.col("event_type")
    cls = F.when(kind == "error", "fault").when(kind.isin("purchase", "signup"), "sale").otherwise("view")
    observed = table(spark, sf, "events").groupBy(kind.alias("series")).agg(
        F.max_by(cls, F.struct("ts", "event_id")).alias("class")
    )
    declared = spark.createDataFrame(DECLARED, "series string, class string")
    return coverage.attribute_conflicts(declared, observed, "series", "class").select("series", "declared", "observed", "status")


@query(f"""WITH {PD}, A AS (SELECT day, tot, n FROM PD), B AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS tot, count(*) + (CASE WHEN extract('day' FROM CAST(l_shipdate AS DATE)) = 29 THEN 1 ELSE 0 END) AS n FROM lineitem GROUP BY CAST(l_shipdate AS DATE)),
X AS (SELECT 'left' AS side, * FROM (SELECT * FROM A EXCEPT SELECT * FROM B) UNION ALL SELECT 'right', * FROM (SELECT * FROM B EXCEPT SELECT * FROM A))
SELECT side, count(*) AS n_rows, {day_sql('min(day)')} AS first_day FROM X GROUP BY 1""")
def table_symmetric_difference(spark, sf):
    a = part_days(spark, sf).select("day", "tot", "n")
    again = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(
        F.sum(cents("l_extendedprice")).alias("tot"), F.count("*").alias("n")
    )
    b = again.withColumn("n", F.col("n") + F.when(F.dayofmonth("day") == 29, 1).otherwise(0))
    return quality.table_difference(a, b).groupBy("side").agg(
        F.count("*").alias("n_rows"), T.day_text(F.min("day")).alias("first_day")
    )


@query(f"""WITH {PY}, {OD}, S AS (SELECT y, 100.0*af/tot AS a, 100.0*(no+ao)/tot AS b FROM PY), K AS (SELECT
  (SELECT bool_and(a < b) FROM S) AS af_below_open, (SELECT max(a) < 50 FROM S) AS af_below_half, (SELECT count(*) >= 5 FROM S) AS enough_years,
  (SELECT corr(a, b) <= -0.8 FROM S) AS opposed)
SELECT name, CASE name WHEN 'af_below_open' THEN af_below_open WHEN 'af_below_half' THEN af_below_half WHEN 'enough_years' THEN enough_years ELSE opposed END AS ok
FROM K, (VALUES ('af_below_open'), ('af_below_half'), ('enough_years'), ('opposed')) n(name)""")
def claim_assertions(spark, sf):
    s = part_years(spark, sf).select(
        percent("af", "tot").alias("a"), percent(F.col("no") + F.col("ao"), "tot").alias("b")
    )
    return quality.claims(
        s,
        {
            "af_below_open": F.every(F.col("a") < F.col("b")),
            "af_below_half": F.max("a") < 50,
            "enough_years": F.count("*") >= 5,
            "opposed": F.corr("a", "b") <= -0.8,
        },
    )


_PT = """{0} AS (SELECT DISTINCT {1} AS k, -60.0 + ({1} * 37 % 120) AS lat, -170.0 + ({1} * 71 % 340) AS lon FROM {2})"""


@query(f"""WITH {_PT.format('A', 'c_nationkey', 'customer')}, {_PT.format('B', '(s_nationkey * 3 + 1)', 'supplier')},
D AS (SELECT A.k AS point, B.k AS target, 2*6371.0*asin(sqrt(least(1.0, pow(sin(radians(B.lat - A.lat)/2), 2) + cos(radians(A.lat))*cos(radians(B.lat))*pow(sin(radians(B.lon - A.lon)/2), 2)))) AS km FROM A, B),
R AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY round(km, 6), target) AS rk FROM D)
SELECT CAST(point AS BIGINT) AS point, CAST(target AS BIGINT) AS target, round(km + 0.000001, 3) AS distance_km, rk AS place FROM R WHERE rk <= 2""")
def nearest_k_stations(spark, sf):
    def place(name, key, out):
        k = key.cast("bigint")
        return table(spark, sf, name).select(k.alias(out)).distinct().select(
            out, (F.col(out) * 37 % 120 - 60.0).alias("lat"), (F.col(out) * 71 % 340 - 170.0).alias("lon")
        )

    points = place("customer", F.col("c_nationkey"), "point")
    targets = place("supplier", F.col("s_nationkey") * 3 + 1, "target")
    near = joins.nearest_k(points, targets, "point", "target", 2)
    return near.select("point", "target", stable("distance_km", 3).alias("distance_km"), F.col("rank").cast("bigint").alias("place"))




@query(f"""WITH {HL} SELECT series, count(*) AS n_rows, {ts_sql('min(h)')} AS first_hour, {ts_sql('max(h)')} AS last_hour, date_diff('hour', min(h), max(h)) + 1 AS n_expected,
date_diff('hour', min(h), max(h)) + 1 - count(DISTINCT h) AS n_missing, count(DISTINCT d) AS n_local_days, count(DISTINCT CAST(h AS DATE)) AS n_utc_days,
count(*) FILTER (WHERE n >= 2) AS n_validated, {r('avg(v) FILTER (WHERE n >= 2)')} AS mean_validated FROM HL GROUP BY 1""")
def series_profile(spark, sf):
    h = hourly_local(spark, sf)
    span = F.max("hi") - F.min("hi") + 1
    return h.groupBy("series").agg(
        F.count("*").alias("n_rows"),
        T.as_text(T.from_hour_index(F.min("hi"))).alias("first_hour"),
        T.as_text(T.from_hour_index(F.max("hi"))).alias("last_hour"),
        span.alias("n_expected"),
        (span - F.count("*")).alias("n_missing"),  # one row per hour by construction
        F.count_distinct("d").alias("n_local_days"),
        F.count_distinct(F.col("h").cast("date")).alias("n_utc_days"),
        F.count_if(F.col("n") >= 2).alias("n_validated"),
        stable(F.avg(F.when(F.col("n") >= 2, F.col("v")))).alias("mean_validated"),
    )
