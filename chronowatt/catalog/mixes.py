"""Mix shares, hourly profiles of the mix, thresholds, two-region comparison."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from . import query
from .base import HL, O, PD, PY, hourly_local, orders, part_days, part_years, r, table
from ..functions.numeric import avg_if, cents, clamp0, displayed_percent, percent, ratio, stable, sum_if
from ..operators import quality, shares


@query(f"WITH {PY} SELECT y, {r('100.0*af/tot')} AS af, {r('100.0*(ao+no)/tot')} AS open_part, {r('100.0*ro/tot')} AS ro FROM PY")
def share_of_sums(spark, sf):
    py = part_years(spark, sf)
    return py.select(
        "y",
        stable(percent("af", "tot")).alias("af"),
        stable(percent(F.col("ao") + F.col("no"), "tot")).alias("open_part"),
        stable(percent("ro", "tot")).alias("ro"),
    )


@query(f"""WITH {PY}, S AS (SELECT 100.0*af/tot AS s FROM PY)
SELECT {r('min(s)')} AS lowest, {r('max(s)')} AS highest, CAST(floor(min(s)+0.5) AS BIGINT) AS lowest_shown,
CAST(floor(max(s)+0.5) AS BIGINT) AS highest_shown FROM S""")
def yearly_share_range(spark, sf):
    s = part_years(spark, sf).select(percent("af", "tot").alias("s"))
    return s.agg(
        stable(F.min("s")).alias("lowest"),
        stable(F.max("s")).alias("highest"),
        F.floor(F.min("s") + 0.5).alias("lowest_shown"),
        F.floor(F.max("s") + 0.5).alias("highest_shown"),
    )


@query(f"""WITH {PY}, S AS (SELECT y, 100.0*af/tot AS a, 100.0*no/tot AS b FROM PY)
SELECT {r('corr(a, b)')} AS correlation, (SELECT y FROM S ORDER BY a, y LIMIT 1) AS year_lowest_a,
(SELECT y FROM S ORDER BY b DESC, y LIMIT 1) AS year_highest_b, count(*) AS n_years FROM S""")
def share_correlation(spark, sf):
    s = part_years(spark, sf).select("y", percent("af", "tot").alias("a"), percent("no", "tot").alias("b"))
    return s.agg(
        stable(F.corr("a", "b")).alias("correlation"),
        F.min_by("y", F.struct("a", "y")).alias("year_lowest_a"),
        F.max_by("y", F.struct(F.col("b"), -F.col("y"))).alias("year_highest_b"),
        F.count("*").alias("n_years"),
    )


@query("""WITH E AS (SELECT event_type AS code, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS c, count(*) AS n FROM events GROUP BY 1)
SELECT code, round(c/100.0 + 0.00001, 2) AS energy, CASE WHEN code <> 'error' THEN
round(100.0*c/(SELECT sum(c) FROM E WHERE code <> 'error') + 0.000000001, 6) END AS share FROM E""")
def share_excluding_code(spark, sf):
    by_code = table(spark, sf, "events").groupBy(F.col("event_type").alias("code")).agg(F.sum(cents("value")).alias("c"))
    counted = F.col("code") != "error"
    # five codes by now: a window over all of them is small
    whole = F.sum(F.when(counted, F.col("c"))).over(Window.partitionBy())
    return by_code.select(
        "code",
        stable(F.col("c") / 100.0, 2).alias("energy"),
        F.when(counted, stable(percent("c", whole))).alias("share"),
    )


@query(f"""WITH {PY} SELECT {r('100.0*sum(af+ao)/sum(tot)')} AS all_parts, {r('100.0*sum(af+ao)/sum(tot-no)')} AS without_no,
{r('100.0*sum(af+ao)/nullif(sum(af+ao+rf+ro),0)')} AS returned_only FROM PY""")
def dependence_by_perimeter(spark, sf):
    part = F.col("af") + F.col("ao")
    wholes = {"all_parts": F.col("tot"), "without_no": F.col("tot") - F.col("no"), "returned_only": part + F.col("rf") + F.col("ro")}
    return part_years(spark, sf).agg(
        *[stable(percent(F.sum(part), F.sum(w))).alias(n) for n, w in wholes.items()]
    )


_REGION = """, RG AS (SELECT O.y, r_name AS region, CAST(sum(p) AS BIGINT) AS p, CAST(sum(p) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS pf
  FROM O JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1, 2)"""


def _regions(spark, sf):
    """Yearly order totals of two regions. Orders are summed per customer and year before they meet
    the customers, so that a customer with many orders moves one row per task and year."""
    bought = orders(spark, sf).groupBy("o_custkey", "y").agg(
        F.sum("p").alias("p"), sum_if(F.col("o_orderstatus") == "F", "p").alias("pf")
    )
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    region = table(spark, sf, "region").filter(F.col("r_name").isin("ASIA", "EUROPE")).select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region")
    )
    nations = nation.join(region, "n_regionkey").select("c_nationkey", "region")
    located = customer.join(nations, "c_nationkey").select("o_custkey", "region")
    return bought.join(located, "o_custkey").groupBy("y", "region").agg(F.sum("p").alias("p"), F.sum("pf").alias("pf"))


@query(f"WITH {O}{_REGION} SELECT y, region, round(p/100.0 + 0.00001, 2) AS total, {r('100.0*pf/p')} AS share FROM RG")
def mix_two_regions(spark, sf):
    return _regions(spark, sf).select(
        "y", "region", stable(F.col("p") / 100.0, 2).alias("total"), stable(percent("pf", "p")).alias("share")
    )


@query(f"""WITH {O}{_REGION}, A AS (SELECT y FROM RG WHERE region = 'ASIA'), B AS (SELECT y FROM RG WHERE region = 'EUROPE' UNION SELECT unnest([1993, 1994]))
SELECT coalesce(A.y, B.y) AS y, CASE WHEN A.y IS NULL THEN 'right_only' ELSE 'left_only' END AS side
FROM A FULL JOIN B ON A.y = B.y WHERE A.y IS NULL OR B.y IS NULL""")
def period_alignment(spark, sf):
    region = F.col("region")
    # two years that the second side is expected to have: the finding comes from the list, not from cut data
    expected = spark.createDataFrame([(1993, "EUROPE"), (1994, "EUROPE")], "y bigint, region string")
    sides = _regions(spark, sf).select("y", "region").unionByName(expected)
    return quality.misaligned(sides, "y", region == "ASIA", region == "EUROPE")


@query(f"""WITH {PD}, S AS (SELECT extract('year' FROM day) AS y, 100.0*(greatest(af,0)+greatest(ao,0))/nullif(tot,0) AS s FROM PD)
SELECT y, count(*) FILTER (WHERE s > 17) AS above_17, count(*) FILTER (WHERE s > 40) AS above_40 FROM S GROUP BY 1""")
def threshold_hours_by_year(spark, sf):
    share = percent(clamp0("af") + clamp0("ao"), "tot")
    days = part_days(spark, sf).withColumn("y", F.year("day").cast("bigint"))
    return shares.hours_above(days, ["y"], share, {"above_17": 17, "above_40": 40})


@query(f"""WITH {PD}, S AS (SELECT extract('year' FROM day) AS y, 100.0*(greatest(af,0)+greatest(ao,0))/nullif(tot,0) AS g,
  100.0*(greatest(af,0)+greatest(ao,0))/nullif(rf+ro,0) AS c FROM PD)
SELECT y, {r('100.0*avg(CASE WHEN g > 35 THEN 1.0 ELSE 0.0 END)')} AS of_total, {r('100.0*avg(CASE WHEN c > 35 THEN 1.0 ELSE 0.0 END)')} AS of_returned,
count(*) FILTER (WHERE c IS NULL) AS n_undefined FROM S GROUP BY 1""")
def threshold_two_denominators(spark, sf):
    part = clamp0("af") + clamp0("ao")
    returned = percent(part, F.col("rf") + F.col("ro"))
    days = part_days(spark, sf).withColumn("y", F.year("day").cast("bigint"))
    d = days.select("y", percent(part, "tot").alias("g"), returned.alias("c"))
    undefined = F.count_if(F.col("c").isNull()).alias("n_undefined")
    freq = shares.frequency_above(d, ["y"], {"of_total": F.col("g"), "of_returned": F.col("c")}, 35, undefined)
    return freq.select("y", stable("of_total").alias("of_total"), stable("of_returned").alias("of_returned"), "n_undefined")


@query("""WITH D AS (SELECT CAST(l_shipdate AS DATE) AS d, max(l_extendedprice) AS top FROM lineitem GROUP BY 1)
SELECT extract('year' FROM d) AS y, count(*) AS n_days, count(*) FILTER (WHERE top > 54000) AS n_above FROM D GROUP BY 1""")
def days_above_level(spark, sf):
    daily = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(
        F.max("l_extendedprice").alias("top")
    )
    return daily.groupBy(F.year("d").cast("bigint").alias("y")).agg(
        F.count("*").alias("n_days"), F.count_if(F.col("top") > 54000).alias("n_above")
    )


@query(f"""WITH {PD}, S AS (SELECT extract('year' FROM day) AS y, 100.0*af/nullif(tot,0) AS a, 100.0*af/nullif(tot-no,0) AS b FROM PD)
SELECT y, {r('avg(abs(a-b))')} AS mean_gap, {r('max(abs(a-b))')} AS max_gap FROM S GROUP BY 1""")
def definition_gap(spark, sf):
    gap = F.abs(percent("af", "tot") - percent("af", F.col("tot") - F.col("no")))
    d = part_days(spark, sf).select(F.year("day").cast("bigint").alias("y"), gap.alias("g"))
    return d.groupBy("y").agg(stable(F.avg("g")).alias("mean_gap"), stable(F.max("g")).alias("max_gap"))


@query(f"""WITH {O}, A AS (SELECT o_orderstatus AS status, avg(p) FILTER (WHERE m = 6)/100.0 AS june, avg(p) FILTER (WHERE m = 7)/100.0 AS july FROM O GROUP BY 1)
SELECT status, round(june + 0.00001, 2) AS june, round(july + 0.00001, 2) AS july, round(100.0*(july-june)/june + 0.000000001, 6) AS change_pct FROM A""")
def change_by_status(spark, sf):
    a = orders(spark, sf).groupBy(F.col("o_orderstatus").alias("status")).agg(
        (avg_if(F.col("m") == 6, "p") / 100.0).alias("june"), (avg_if(F.col("m") == 7, "p") / 100.0).alias("july")
    )
    return a.select(
        "status",
        stable("june", 2).alias("june"),
        stable("july", 2).alias("july"),
        stable(ratio(100.0 * (F.col("july") - F.col("june")), "june")).alias("change_pct"),
    )


# published yearly totals to compare with, in thousands (constants of the stand-in)
BALANCE = [(1996, 340000.0), (1997, 338000.0), (1998, 341000.0), (1999, 339000.0), (2000, 342000.0)]


@query(f"""WITH {PY}, B(y, published) AS (VALUES {', '.join(f'({y}, {v}::DOUBLE)' for y, v in BALANCE)})
SELECT PY.y, round(tot/100000.0 + 0.0000001, 4) AS computed, published, round(100.0*(tot/100000.0 - published)/published + 0.0000001, 4) AS gap_pct,
{r('100.0*(af+ao)/nullif(rf+ro,0)')} AS in_out_ratio FROM PY LEFT JOIN B ON B.y = PY.y""")
def external_balance_gap(spark, sf):
    published = F.broadcast(spark.createDataFrame(BALANCE, "y bigint, published double"))  # a constant list
    computed = F.col("tot") / 100000.0
    return part_years(spark, sf).join(published, "y", "left").select(
        "y",
        stable(computed, 4).alias("computed"),
        "published",
        stable(100.0 * (computed - F.col("published")) / F.col("published"), 4).alias("gap_pct"),
        stable(percent(F.col("af") + F.col("ao"), F.col("rf") + F.col("ro"))).alias("in_out_ratio"),
    )


@query(f"""WITH {PY}, Q AS (SELECT y, CAST(floor(af/100000000.0 + 0.5) AS BIGINT) AS a, CAST(floor(tot/100000000.0 + 0.5) AS BIGINT) AS b FROM PY)
SELECT y, a AS part_shown, b AS total_shown, CAST(floor((200*a + b)/(2.0*b)) AS BIGINT) AS pct_shown FROM Q""")
def displayed_percentage(spark, sf):
    part, whole = F.col("af") / 100000000.0, F.col("tot") / 100000000.0
    return part_years(spark, sf).select(
        "y",
        F.floor(part + 0.5).alias("part_shown"),
        F.floor(whole + 0.5).alias("total_shown"),
        displayed_percent(part, whole).alias("pct_shown"),
    )


@query(f"""WITH {PD}, B AS (SELECT day, tot + (CASE WHEN extract('day' FROM day) % 7 = 0 THEN 12345 ELSE 0 END) AS tot, af+ao+nf+no+rf+ro AS parts FROM PD)
SELECT extract('year' FROM day) AS y, count(*) AS n_days, count(*) FILTER (WHERE abs(tot - parts) <= 5000) AS n_kept FROM B GROUP BY 1""")
def balance_filter(spark, sf):
    d = _perturbed(spark, sf)
    return d.groupBy(F.year("day").cast("bigint").alias("y")).agg(
        F.count("*").alias("n_days"), F.count_if(F.abs(F.col("tot") - F.col("parts")) <= 5000).alias("n_kept")
    )


def _perturbed(spark, sf):
    parts = sum((F.col(c) for c in ("ao", "nf", "no", "rf", "ro")), F.col("af"))
    shift = F.when(F.dayofmonth("day") % 7 == 0, 12345).otherwise(0)
    return part_days(spark, sf).select("day", (F.col("tot") + shift).alias("tot"), parts.alias("parts"))


@query(f"""WITH {PD}, B AS (SELECT day, tot + (CASE WHEN extract('day' FROM day) % 7 = 0 THEN 12345 ELSE 0 END) AS tot, af+ao+nf+no+rf+ro AS parts FROM PD)
SELECT max(abs(tot - parts))/100.0 AS max_residual, count(*) FILTER (WHERE abs(100.0*parts/tot - 100) > 0.001) AS n_shares_off, count(*) AS n FROM B""")
def balance_residual(spark, sf):
    off = F.abs(percent("parts", "tot") - 100) > 0.001
    return _perturbed(spark, sf).agg(
        (F.max(F.abs(F.col("tot") - F.col("parts"))) / 100.0).alias("max_residual"),
        F.count_if(off).alias("n_shares_off"),
        F.count("*").alias("n"),
    )


_D = "nullif(l_discount, 0)"


@query(f"""SELECT l_returnflag AS flag, {r(f'100.0*sum(coalesce({_D},0))/nullif(sum(l_tax + coalesce({_D},0)),0)')} AS share_zero_filled,
{r(f'100.0*sum({_D})/nullif(sum(l_tax + {_D}),0)')} AS share_known_only, count(*) - count({_D}) AS n_null FROM lineitem GROUP BY 1""")
def null_aware_share(spark, sf):
    disc = F.nullif(F.col("l_discount"), F.lit(0.0))
    filled = F.coalesce(disc, F.lit(0.0))
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        stable(percent(F.sum(filled), F.sum(F.col("l_tax") + filled))).alias("share_zero_filled"),
        stable(percent(F.sum(disc), F.sum(F.col("l_tax") + disc))).alias("share_known_only"),
        F.count_if(disc.isNull()).alias("n_null"),
    )


# ---- the mix by hour of day -------------------------------------------------------------------

HW = HL + """,
HC AS (SELECT hr, sum(v) FILTER (WHERE series = 'click') AS a, sum(v) FILTER (WHERE series = 'view') AS b,
  sum(v) FILTER (WHERE series = 'purchase') AS c, sum(v) FILTER (WHERE series = 'error') AS e, sum(v) AS tot FROM HL GROUP BY 1)"""


def by_hour(spark, sf):
    is_ = lambda s: F.col("series") == s
    return hourly_local(spark, sf).groupBy("hr").agg(
        sum_if(is_("click"), "v").alias("a"),
        sum_if(is_("view"), "v").alias("b"),
        sum_if(is_("purchase"), "v").alias("c"),
        sum_if(is_("error"), "v").alias("e"),
        F.sum("v").alias("tot"),
    )


@query(f"WITH {HW} SELECT hr, {r('100.0*a/tot')} AS click, {r('100.0*b/tot')} AS view, {r('100.0*c/tot')} AS purchase FROM HC")
def hour_profile(spark, sf):
    cols = {"click": "a", "view": "b", "purchase": "c"}
    return by_hour(spark, sf).select("hr", *[stable(percent(c, "tot")).alias(n) for n, c in cols.items()])


@query(f"""WITH {HW} SELECT hr, {r('greatest(100.0*(a-b)/tot,0)')} AS click_over_view, {r('greatest(100.0*(b-a)/tot,0)')} AS view_over_click,
{r('greatest(100.0*c/tot,0)')} AS purchase FROM HC""")
def hour_share_stack(spark, sf):
    parts = {"click_over_view": F.col("a") - F.col("b"), "view_over_click": F.col("b") - F.col("a"), "purchase": F.col("c")}
    return by_hour(spark, sf).select("hr", *[stable(clamp0(percent(p, "tot"))).alias(n) for n, p in parts.items()])


@query(f"""WITH {HW}, S AS (SELECT hr, {r('100.0*a/tot')} AS s1, {r('100.0*(a+b)/tot')} AS s2 FROM HC),
K AS (SELECT (SELECT hr FROM S ORDER BY s1 DESC, hr LIMIT 1) AS h1, (SELECT hr FROM S ORDER BY s2 DESC, hr LIMIT 1) AS h2)
SELECT h1 AS hour_narrow, h2 AS hour_wide, {r('100.0*sum(a)/sum(tot)')} AS slot_narrow, {r('100.0*sum(a+b)/sum(tot)')} AS slot_wide
FROM HC, K WHERE hr BETWEEN least(h1, h2) AND greatest(h1, h2) GROUP BY 1, 2""")
def greenest_slot(spark, sf):
    hc = by_hour(spark, sf).select(
        "*", stable(percent("a", "tot")).alias("s1"), stable(percent(F.col("a") + F.col("b"), "tot")).alias("s2")
    )
    # 24 rows: the argmax of both definitions next to every hour
    w = Window.partitionBy()
    top = lambda s: F.max_by("hr", F.struct(F.col(s), -F.col("hr"))).over(w)
    d = hc.select("*", top("s1").alias("h1"), top("s2").alias("h2"))
    inside = F.col("hr").between(F.least("h1", "h2"), F.greatest("h1", "h2"))
    return d.filter(inside).groupBy(F.col("h1").alias("hour_narrow"), F.col("h2").alias("hour_wide")).agg(
        stable(percent(F.sum("a"), F.sum("tot"))).alias("slot_narrow"),
        stable(percent(F.sum(F.col("a") + F.col("b")), F.sum("tot"))).alias("slot_wide"),
    )


@query(f"""WITH {HW}, S AS (SELECT hr, {r('100.0*a/tot')} AS share FROM HC)
SELECT hr, share, row_number() OVER (ORDER BY share DESC, hr) AS place FROM S ORDER BY share DESC, hr LIMIT 3""")
def top3_hours(spark, sf):
    s = by_hour(spark, sf).select("hr", stable(percent("a", "tot")).alias("share"))
    place = F.row_number().over(Window.orderBy(F.desc("share"), "hr")).cast("bigint")
    return s.withColumn("place", place).filter("place <= 3")


@query(f"WITH {HW} SELECT hr, {r('100.0*a/tot')} AS a_share, {r('100.0*b/tot')} AS b_share FROM HC WHERE round(a, 9) > round(b, 9)")
def hours_a_over_b(spark, sf):
    ahead = F.round("a", 9) > F.round("b", 9)
    return by_hour(spark, sf).filter(ahead).select(
        "hr", stable(percent("a", "tot")).alias("a_share"), stable(percent("b", "tot")).alias("b_share")
    )


@query(f"""WITH {HL}, D AS (SELECT hr, {r("avg(v) FILTER (WHERE d >= DATE '2024-01-16') - avg(v) FILTER (WHERE d < DATE '2024-01-16')")} AS delta FROM HL GROUP BY 1),
T AS (SELECT *, max(delta) OVER () AS top FROM D), P AS (SELECT min(hr) AS a, max(hr) AS b, count(*) AS n FROM T WHERE delta >= 0.97*top)
SELECT hr, delta, delta >= 0.97*top AS in_plateau, a AS plateau_from, b AS plateau_to, b - a + 1 = n AS contiguous FROM T, P""")
def hour_delta_plateau(spark, sf):
    second = F.col("d") >= F.lit("2024-01-16").cast("date")
    delta = hourly_local(spark, sf).groupBy("hr").agg(
        stable(avg_if(second, "v") - avg_if(~second, "v")).alias("delta")
    )
    w = Window.partitionBy()  # 24 rows
    d = delta.withColumn("in_plateau", F.col("delta") >= 0.97 * F.max("delta").over(w))
    hour_in = F.when(F.col("in_plateau"), F.col("hr"))
    a, b = F.min(hour_in).over(w), F.max(hour_in).over(w)
    return d.select(
        "hr", "delta", "in_plateau", a.alias("plateau_from"), b.alias("plateau_to"),
        (b - a + 1 == F.count(hour_in).over(w)).alias("contiguous"),
    )


@query(f"""WITH {HW}, S AS (SELECT hr, {r('100.0*a/tot')} AS s1, {r('100.0*(a+b)/tot')} AS s2 FROM HC),
U AS (SELECT 'narrow' AS definition, hr, s1 AS s FROM S UNION ALL SELECT 'wide', hr, s2 FROM S)
SELECT definition, min(s) FILTER (WHERE hr BETWEEN 11 AND 14) AS worst_inside, max(s) FILTER (WHERE hr NOT BETWEEN 11 AND 14) AS best_outside,
min(s) FILTER (WHERE hr BETWEEN 11 AND 14) > max(s) FILTER (WHERE hr NOT BETWEEN 11 AND 14) AS separates FROM U GROUP BY 1""")
def slot_separates(spark, sf):
    hc = by_hour(spark, sf)
    named = F.array(
        F.struct(F.lit("narrow").alias("definition"), stable(percent("a", "tot")).alias("s")),
        F.struct(F.lit("wide").alias("definition"), stable(percent(F.col("a") + F.col("b"), "tot")).alias("s")),
    )
    inside = F.col("hr").between(11, 14)
    worst, best = F.min(F.when(inside, F.col("s"))), F.max(F.when(~inside, F.col("s")))
    return hc.select("hr", F.inline(named)).groupBy("definition").agg(
        worst.alias("worst_inside"), best.alias("best_outside"), (worst > best).alias("separates")
    )


@query(f"""WITH {HW} SELECT 'morning' AS slot, {r('100.0*sum(a)/sum(tot)')} AS share, count(*) AS n_hours FROM HC WHERE hr BETWEEN 6 AND 11
UNION ALL SELECT 'evening', {r('100.0*sum(a)/sum(tot)')}, count(*) FROM HC WHERE hr BETWEEN 17 AND 22""")
def union_slots(spark, sf):
    hr = F.col("hr")
    slots = [("morning", hr.between(6, 11)), ("evening", hr.between(17, 22))]
    # each hour is labelled with the slots it belongs to, which may overlap
    labels = F.array_compact(F.array(*[F.when(inside, F.lit(name)) for name, inside in slots]))
    return by_hour(spark, sf).select("a", "tot", F.explode(labels).alias("slot")).groupBy("slot").agg(
        stable(percent(F.sum("a"), F.sum("tot"))).alias("share"), F.count("*").alias("n_hours")
    )
