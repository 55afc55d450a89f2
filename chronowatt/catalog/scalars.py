"""Row-level expressions as queries: filters, text predicates, codes, dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from .base import H, hourly, r, table
from ..functions.numeric import stable
from ..operators import quality

ALLOWED = ["click", "purchase", "view"]


@query("""SELECT user_id, event_type, count(*) AS n, round(sum(value) + 0.00001, 2) AS total FROM events
WHERE event_type = 'purchase' AND value BETWEEN 10 AND 90 GROUP BY 1, 2""")
def filter_project(spark, sf):
    kept = table(spark, sf, "events").filter((F.col("event_type") == "purchase") & F.col("value").between(10, 90))
    return kept.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), stable(F.sum("value"), 2).alias("total"))


@query("""SELECT event_type AS code, event_type IN ('click','purchase','view') AS known, count(*) AS n, count(*) FILTER (WHERE value > 0 AND value IS NOT NULL) AS n_valid FROM events GROUP BY 1
UNION ALL SELECT 'unknown codes', false, count(DISTINCT event_type), 0 FROM events WHERE event_type NOT IN ('click','purchase','view')""")
def code_allowlist(spark, sf):
    e = table(spark, sf, "events")
    per_code = e.groupBy(F.col("event_type").alias("code")).agg(
        F.count("*").alias("n"), F.count_if((F.col("value") > 0) & F.col("value").isNotNull()).alias("n_valid")
    )
    unknown = quality.unknown_codes(e, "event_type", ALLOWED).agg(F.count("*").alias("n")).select(
        F.lit("unknown codes").alias("code"), F.lit(False).alias("known"), "n", F.lit(0).cast("bigint").alias("n_valid")
    )
    return per_code.select("code", F.col("code").isin(*ALLOWED).alias("known"), "n", "n_valid").unionByName(unknown)


@query("""SELECT p_type AS kind, count(*) AS n, count(*) FILTER (WHERE lower(p_name) LIKE 'b%') AS n_b, count(*) FILTER (WHERE p_name NOT LIKE '%ring') AS n_not_ring,
count(*) FILTER (WHERE p_brand LIKE '%#1%') AS n_hash_one, CAST(sum(CAST(substr(p_brand, 7) AS INTEGER)) AS BIGINT) AS brand_sum, min(substr(p_name, 1, 4)) AS first_four FROM part GROUP BY 1""")
def string_predicates(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("kind")).agg(
        F.count("*").alias("n"),
        F.count_if(F.lower(name).like("b%")).alias("n_b"),
        F.count_if(~name.like("%ring")).alias("n_not_ring"),
        F.count_if(F.col("p_brand").like("%#1%")).alias("n_hash_one"),
        F.sum(F.substring("p_brand", 7, 10).cast("int")).cast("bigint").alias("brand_sum"),
        F.min(F.substring(name, 1, 4)).alias("first_four"),
    )


@query("""SELECT c_custkey AS custkey, regexp_extract(c_name, '([0-9]+)$', 1) AS digits, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS code,
regexp_extract(c_name, '^([A-Za-z]+)#', 1) AS prefix FROM customer""")
def regexp_extract_codes(spark, sf):
    digits = F.regexp_extract("c_name", "([0-9]+)$", 1)
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"),
        digits.alias("digits"),
        digits.cast("bigint").alias("code"),
        F.regexp_extract("c_name", "^([A-Za-z]+)#", 1).alias("prefix"),
    )


CATEGORIES = [("click", "visit"), ("view", "visit"), ("purchase", "sale"), ("signup", "sale")]


@query("""WITH M(code, category) AS (VALUES ('click','visit'), ('view','visit'), ('purchase','sale'), ('signup','sale'))
SELECT coalesce(CASE WHEN event_type = 'signup' THEN 'membership' ELSE category END, 'UNMAPPED') AS category, count(*) AS n, count(DISTINCT event_type) AS n_codes
FROM events LEFT JOIN M ON code = event_type GROUP BY 1""")
def code_map_guard(spark, sf):
    mapping = spark.createDataFrame(CATEGORIES, "code string, category string")
    counted = table(spark, sf, "events").groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"))
    mapped, _ = quality.map_codes(counted, mapping, "code", "category")
    # one code leaves its category by decision, as an override
    category = F.when(F.col("code") == "signup", "membership").otherwise(F.coalesce("category", F.lit("UNMAPPED")))
    return mapped.groupBy(category.alias("category")).agg(F.sum("n").alias("n"), F.count("*").alias("n_codes"))


NAMES = [("click", "Click", "visit"), ("view", "View", "visit"), ("purchase", "Purchase", "sale")]


@query(f"""WITH {H}, D(series, name, class) AS (VALUES {', '.join(str(n) for n in NAMES)})
SELECT name, class, count(*) AS n_hours, {r('avg(v)')} AS mean FROM H JOIN D USING (series) GROUP BY 1, 2""")
def dim_values_join(spark, sf):
    dim = F.broadcast(spark.createDataFrame(NAMES, "series string, name string, class string"))  # a constant list
    return hourly(spark, sf).join(dim, "series").groupBy("name", "class").agg(
        F.count("*").alias("n_hours"), stable(F.avg("v")).alias("mean")
    )
