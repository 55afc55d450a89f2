"""Queries over raw files: the given tables are written as the files a producer would publish, and read back through the
readers, hashes, contracts, table builders and the guarded build."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import query
from .base import table
from ..functions import timeaxis as T
from ..functions.numeric import cents
from ..plans import build, fixed_values as V, site, tables as B
from ..session import shared_folder
from ..sources import contracts, fingerprints, readers, xml_series


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/raw-{uuid.uuid4().hex}"


def _csv(df: DataFrame, path: str, sep: str = ";", **options: str) -> str:
    df.write.option("sep", sep).option("header", True).options(**options).csv(path)
    return path


def _text(c) -> F.Column:
    return F.col(c).cast("string")


_TENTHS = "CAST(round(p_retailprice * 10) AS BIGINT)"


@query(f"""WITH S AS (SELECT p_brand AS area, {_TENTHS} AS tenths, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS code FROM part WHERE p_size % 5 <> 0)
SELECT area, count(*) AS n_sales, CAST(sum(tenths) AS BIGINT) AS tenths, count(*) FILTER (WHERE code IS NULL) AS n_without_code FROM S GROUP BY 1""")
def csv_sales(spark, sf):
    """Two gzipped files with differing columns, all text, joined by name; sales only."""
    folder = _folder(spark)
    price = (F.round(F.col("p_retailprice") * 10).cast("bigint") / 10).cast("string")
    kind = F.when(F.col("p_size") % 5 == 0, "Echange").otherwise("Vente")
    raw = table(spark, sf, "part").select(
        kind.alias("nature_mutation"), price.alias("valeur_fonciere"), F.col("p_brand").alias("nom_commune"), F.col("p_type").alias("code_commune"), "p_partkey"
    )
    even = F.col("p_partkey") % 2 == 0
    first = _csv(raw.filter(even).drop("p_partkey"), f"{folder}/a", ",", compression="gzip")
    second = _csv(raw.filter(~even).select("nom_commune", "valeur_fonciere", "nature_mutation"), f"{folder}/b", ",", compression="gzip")
    sales = B.sales(readers.read_csv_union_by_name(spark, [first, second], ","))
    return sales.groupBy(F.col("nom_commune").alias("area")).agg(
        F.count("*").alias("n_sales"),
        F.sum(F.round(F.col("valeur_fonciere").cast("double") * 10).cast("bigint")).alias("tenths"),
        F.count_if(F.col("code_commune").isNull()).alias("n_without_code"),
    )


_MIX = """M AS (SELECT CAST(l_shipdate AS DATE) + (sum(l_linenumber) % 24)::BIGINT * INTERVAL 1 HOUR AS t, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY CAST(l_shipdate AS DATE)),
R AS (SELECT t, q AS thermal, n AS solar, q + n + (CASE WHEN n % 7 = 0 THEN 51 ELSE 50 END) AS total FROM M)"""


@query(f"""WITH {_MIX} SELECT extract('hour' FROM timezone('Europe/Paris', timezone('UTC', t))) AS heure_locale, count(*) AS n, CAST(sum(total) AS BIGINT) AS total, count(*) AS n_shares
FROM R WHERE total - thermal - solar <= 50 GROUP BY 1""")
def csv_live_mix(spark, sf):
    """A live feed with a zoned instant; rows out of balance are left out."""
    day = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(
        F.sum("l_quantity").cast("bigint").alias("q"), F.count("*").alias("n"), (F.sum("l_linenumber") % 24).alias("hour")
    )
    zero = F.lit("0")
    raw = day.select(
        F.format_string("%sT%02d:00:00+00:00", F.col("day").cast("string"), F.col("hour")).alias("date"),
        (F.col("q") + F.col("n") + F.when(F.col("n") % 7 == 0, 51).otherwise(50)).alias("total"),
        F.col("q").alias("filiere_thermique"), F.col("n").alias("filiere_enr_distrib"), zero.alias("hydraulique"), zero.alias("liaisons"),
        F.col("n").alias("photovoltaique"), zero.alias("eolien"), zero.alias("bioenergies"), zero.alias("micro_hydro"), F.lit("Estimé").alias("statut"),
        F.lit("unused").alias("autre"),
    )
    path = _csv(raw, f"{_folder(spark)}/mix")
    mix = B.live_mix(readers.read_csv_named(spark, path, site.MIX_SCHEMA))
    share = F.abs(F.col("part_soleil") - 100 * F.col("photovoltaique") / F.col("total")) <= 0.00501
    return mix.groupBy(F.col("heure_locale").cast("bigint").alias("heure_locale")).agg(
        F.count("*").alias("n"), F.sum("total").cast("bigint").alias("total"), F.count_if(share).alias("n_shares")
    )


_CURVE = """C AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey % 24 AS h, o_custkey % 5 = 0 AS other, count(*) AS n, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY 1, 2, 3),
L AS (SELECT day + h::BIGINT * INTERVAL 1 HOUR AS loc, CASE WHEN n % 4 = 0 THEN 0 ELSE v END AS v FROM C WHERE NOT other),
X AS (SELECT loc, v, timezone('Europe/Paris', loc) AS inst, timezone('Europe/Paris', timezone('Europe/Paris', loc)) <> loc AS phantom FROM L)"""


def _curve(spark, sf) -> str:
    key, price = F.col("o_orderkey") % 24, F.round("o_totalprice").cast("bigint")
    hours = table(spark, sf, "orders").groupBy(
        F.col("o_orderdate").cast("date").alias("day"), key.alias("h"), (F.col("o_custkey") % 5 == 0).alias("other")
    ).agg(F.count("*").alias("n"), F.sum(price).alias("v"))
    value = F.when(F.col("n") % 4 == 0, 0).otherwise(F.col("v"))
    raw = hours.select(
        F.when(F.col("other"), "Autre").otherwise(V.TERRITORY).alias("territoire"),
        F.format_string("%sT%02d:00:00+00:00", F.col("day").cast("string"), F.col("h")).alias("date_heure"),
        F.lit("Validé").alias("statut"), value.alias("production_totale_mw"), value.alias("thermique_mw"), F.lit(0).alias("hydraulique_mw"),
        F.lit(None).cast("string").alias("micro_hydraulique_mw"), F.lit(1).alias("photovoltaique_mw"), F.lit(2).alias("eolien_mw"),
        F.lit(3).alias("bioenergies_mw"), F.lit("").alias("bagasse_mw"), F.lit(0).alias("importations_mw"),
    )
    return _csv(raw, f"{_folder(spark)}/curve")


@query(f"""WITH {_CURVE} SELECT extract('year' FROM loc) AS y, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(min(timezone('UTC', inst)) AS VARCHAR) AS first_utc, CAST(sum(6) AS BIGINT) AS renewable
FROM X WHERE NOT phantom AND v > 0 GROUP BY 1""")
def csv_load_curve(spark, sf):
    """Labels that claim UTC and are legal time: suffix checked, skipped hours left out, empty micro-hydro read as zero."""
    curve = B.load_curve(readers.read_csv_named(spark, _curve(spark, sf), site.CURVE_SCHEMA))
    return curve.groupBy(F.col("annee_locale").cast("bigint").alias("y")).agg(
        F.count("*").alias("n"),
        F.sum("production_totale_mw").cast("bigint").alias("total"),
        T.as_text(F.min("date_heure_utc")).alias("first_utc"),
        F.sum("enr_distrib_mw").cast("bigint").alias("renewable"),
    )


@query(f"""WITH {_CURVE} SELECT count(*) FILTER (WHERE phantom) AS phantom_hours, count(*) FILTER (WHERE NOT phantom AND v <= 0) AS rows_at_zero FROM X""")
def csv_load_curve_losses(spark, sf):
    return B.load_curve_losses(readers.read_csv_named(spark, _curve(spark, sf), site.CURVE_SCHEMA))


_MONTHS = "M AS (SELECT extract('year' FROM o_orderdate) AS y, extract('month' FROM o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2)"


@query(f"""WITH {_MONTHS} SELECT y AS annee, m AS mois_cal, n AS hours, CASE WHEN y >= 1998 THEN n % 13 END AS rate FROM M""")
def csv_curtailment(spark, sf):
    """A file with a byte-order mark whose older lines lack their last field."""
    o = table(spark, sf, "orders")
    months = o.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    start = F.format_string("%s,%04d-%02d,%d", F.lit(V.TERRITORY), F.col("y"), F.col("m"), F.col("n"))
    lines = months.select((F.col("y") * 12 + F.col("m")).alias("at"), F.when(F.col("y") >= 1998, F.concat(start, F.lit(","), (F.col("n") % 13).cast("string"))).otherwise(start).alias("value"))
    head = spark.createDataFrame([(0, "﻿Territoire,Mois,Durée (h),Taux (%)")], "at int, value string")
    path = f"{_folder(spark)}/cut"
    # a line for each month of the calendar: one file, its header first
    head.unionByName(lines).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    out = B.curtailment(readers.read_csv_ragged(spark, path, site.CURTAILMENT_SCHEMA))
    return out.select(
        F.col("annee").cast("bigint").alias("annee"), F.col("mois_cal").cast("bigint").alias("mois_cal"),
        F.col("duree_h").cast("bigint").alias("hours"), F.col("taux_pct").cast("bigint").alias("rate"),
    )


@query("""WITH R AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN 'IT' ELSE 'FR' END AS c, CASE l_linenumber WHEN 1 THEN 1040 WHEN 2 THEN 1041 WHEN 3 THEN 206030 ELSE 5 END AS id,
  2015 + l_orderkey % 12 AS y, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS v FROM lineitem)
SELECT y AS annee, id AS eutl_id, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS n_null, CAST(sum(v) AS BIGINT) AS tons FROM R WHERE c = 'FR' AND id <> 5 AND y BETWEEN 2019 AND 2024 GROUP BY 1, 2""")
def csv_emissions(spark, sf):
    """A register whose ids are unique within a country only, and whose amounts are not all numbers."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    raw = table(spark, sf, "lineitem").select(
        F.when(key % 7 == 0, "IT").otherwise("FR").alias("country_code"),
        F.when(line == 1, 1040).when(line == 2, 1041).when(line == 3, 206030).otherwise(5).alias("eutl_id"),
        F.lit("a name, with a comma").alias("name"),
        (2015 + key % 12).alias("year"),
        F.when(F.col("l_suppkey") % 5 == 0, "n/a").otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("emissions_tco2e"),
    )
    path = _csv(raw, f"{_folder(spark)}/register", ",")
    out = B.emissions(readers.read_csv_named(spark, path, site.EMISSIONS_SCHEMA, sep=","))
    return out.groupBy(F.col("annee").cast("bigint").alias("annee"), F.col("eutl_id").cast("int").alias("eutl_id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("tco2").isNull()).alias("n_null"), F.sum("tco2").cast("bigint").alias("tons")
    )


@query("""WITH R AS (SELECT date_trunc('hour', ts) AS t, event_type AS station, event_id % 4 - 1 AS validity, CAST(round(value * 100) AS BIGINT) AS c FROM events WHERE event_id % 3 > 0),
L AS (SELECT *, timezone('Europe/Paris', timezone('UTC', t)) AS loc FROM R WHERE validity > 0)
SELECT station, extract('hour' FROM loc) AS heure_locale, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents, strftime(max(CAST(loc AS DATE)), '%Y-%m-%d') AS last_day FROM L GROUP BY 1, 2""")
def csv_air_feed(spark, sf):
    """The national feed with quoted headers: one organisation, valid rows, local hours of a UTC start."""
    hour = T.from_hour_index(T.hour_index("ts"))
    raw = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 3 > 0, V.AIR_ORGANISATION).otherwise("ELSEWHERE").alias("Organisme"),
        F.date_format(hour, "yyyy/MM/dd HH:mm:ss").alias("Date de début"),
        F.lit("Z").alias("Zas"), F.col("event_type").alias("code site"), F.col("event_type").alias("nom site"), F.lit("Urbaine").alias("type d'implantation"),
        F.lit("Fond").alias("type d'influence"), F.lit("O3").alias("Polluant"), (cents("value") / 100).alias("valeur"), F.lit("µg-m3").alias("unité de mesure"),
        (F.col("event_id") % 4 - 1).alias("validité"),
    )
    path = _csv(raw, f"{_folder(spark)}/feed", quoteAll="true")
    read = readers.read_csv_named(spark, path, site.AIR_FEED_SCHEMA)
    feed = B.air_feed(read.withColumn("Date de début", F.to_timestamp_ntz("`Date de début`", F.lit("yyyy/MM/dd HH:mm:ss"))))
    return feed.groupBy("station", F.col("heure_locale").cast("bigint").alias("heure_locale")).agg(
        F.count("*").alias("n"),
        F.sum(F.round(F.col("valeur") * 100).cast("bigint")).alias("cents"),
        F.date_format(F.max("date_locale"), "yyyy-MM-dd").alias("last_day"),
    )


@query("""WITH R AS (SELECT user_id % 6 AS post, date_trunc('hour', ts) AS t, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 9 END AS qt,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(round(value) AS BIGINT) END AS temp FROM events),
L AS (SELECT *, CAST(timezone('Europe/Paris', timezone('UTC', t)) AS DATE) AS d FROM R WHERE temp IS NOT NULL), E AS (SELECT min(d) AS a, max(d) AS z FROM L)
SELECT post, count(*) AS n, CAST(sum(temp) AS BIGINT) AS degrees, count(DISTINCT d) AS n_days FROM L, E WHERE d > a AND d < z AND qt <> 2 GROUP BY 1""")
def csv_weather(spark, sf):
    """Two gzipped, all-text files with differing columns: quality codes, edge days of the whole feed left out."""
    folder, code = _folder(spark), F.col("event_id") % 4
    temp = F.when(F.col("event_id") % 11 == 0, None).otherwise(F.round("value").cast("bigint").cast("string"))
    raw = table(spark, sf, "events").select(
        (F.col("user_id") % 6).alias("NUM_POSTE"), F.lit("POST").alias("NOM_USUEL"), F.lit("42.1").alias("LAT"), F.lit("9").alias("LON"), F.lit("10").alias("ALTI"),
        F.date_format(T.from_hour_index(T.hour_index("ts")), "yyyyMMddHH").alias("AAAAMMJJHH"), temp.alias("T"),
        F.when(code == 3, 9).otherwise(code).alias("QT"), F.lit("junk").alias("DRR1"), "event_id",
    )
    even = F.col("event_id") % 2 == 0
    first = _csv(raw.filter(even).drop("event_id", "DRR1"), f"{folder}/a", compression="gzip")
    second = _csv(raw.filter(~even).drop("event_id"), f"{folder}/b", compression="gzip")
    weather = B.weather(readers.read_csv_union_by_name(spark, [first, second], columns=B.WEATHER_COLUMNS))
    return weather.groupBy(F.col("num_poste").cast("bigint").alias("post")).agg(
        F.count("*").alias("n"), F.sum("temperature_c").cast("bigint").alias("degrees"), F.count_distinct("date_locale").alias("n_days")
    )


@query("""WITH R AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR AS utc, ['FR41001', 'FR41002', 'FR41024', 'FR99999'][event_id % 4 + 1] AS code, event_id % 3 + 7 AS pol, event_id % 5 - 1 AS validity, CAST(round(value * 100) AS BIGINT) AS c FROM events)
SELECT code AS code_site, CASE pol WHEN 7 THEN 'O3' ELSE 'NO2' END AS polluant, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents, CAST(min(utc) AS VARCHAR) AS first_utc FROM R
WHERE validity > 0 AND code <> 'FR99999' AND pol IN (7, 8) GROUP BY 1, 2""")
def parquet_air_series(spark, sf):
    """Parquet files of which only some have a column, a start in fixed UTC+1, codes inside a label, known stations only."""
    folder, key = _folder(spark), F.col("event_id")
    code = F.element_at(F.array(*map(F.lit, ("FR41001", "FR41002", "FR41024", "FR99999"))), (key % 4 + 1).cast("int"))
    raw = table(spark, sf, "events").select(
        F.concat(F.lit("SPO-"), code, F.lit("_"), (key % 3 + 7).cast("string")).alias("Samplingpoint"),
        T.from_hour_index(T.hour_index("ts")).alias("Start"), (cents("value") / 100).alias("Value"), (key % 5 - 1).cast("int").alias("Validity"),
        F.lit(1).alias("Verification"), key,
    )
    raw.filter(key % 2 == 0).drop("event_id").write.parquet(f"{folder}/a")
    raw.filter(key % 2 == 1).drop("event_id").withColumn("Extra", F.lit("only here")).write.parquet(f"{folder}/b")
    found = B.air_series(readers.read_parquet_union(spark, [f"{folder}/a", f"{folder}/b"]), site.stations(spark), site.pollutants(spark))
    return found.groupBy("code_site", "polluant").agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("valeur") * 100).cast("bigint")).alias("cents"), T.as_text(F.min("date_heure_utc")).alias("first_utc")
    )


_LINES = "L AS (SELECT n_regionkey AS k, string_agg(n_nationkey || ';' || n_name || chr(10), '' ORDER BY n_nationkey) AS body FROM nation GROUP BY 1)"


def _region_files(spark, sf, folder: str, **options: str) -> list[str]:
    """A folder for each region with one file of its nations: a key;name line each, in order."""
    lines = table(spark, sf, "nation").select("n_regionkey", "n_nationkey", F.concat_ws(";", "n_nationkey", "n_name").alias("value"))
    # a file is written by one task
    sorted_ = lines.repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey").select("n_regionkey", "value")
    sorted_.write.options(**options).partitionBy("n_regionkey").text(folder)
    return [f"{folder}/n_regionkey={r[0]}" for r in lines.select("n_regionkey").distinct().collect()]


@query(f"""WITH {_LINES} SELECT k AS region, kind, sha256(body) AS sha256, CASE WHEN k = 1 THEN 'content' ELSE 'certified' END AS state FROM L, (VALUES ('plain'), ('gzip')) t(kind)""")
def raw_file_hashes(spark, sf):
    """Files hashed as they are, and gzipped ones by their content; one certificate is wrong and is reported."""
    folder, out = _folder(spark), None
    for kind, options in (("plain", {}), ("gzip", {"compression": "gzip"})):
        found = fingerprints.files(spark, _region_files(spark, sf, f"{folder}/{kind}", **options))
        region = F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int")
        files = found.withColumn("region", region).withColumn("file", F.concat(F.lit(f"{kind}-"), region.cast("string")))
        rules = files.select("file", F.lit(None).cast("array<string>").alias("ignore_xml"), F.lit(kind == "gzip").alias("decompressed"))
        hashes = fingerprints.fingerprints(files.drop("region"), rules)
        certified = hashes.select("file", F.when(F.col("file").endswith("-1"), "0" * 64).otherwise(F.col("sha256")).alias("sha256"))
        wrong = fingerprints.mismatches(hashes, certified).select("file", F.lit("content").alias("state"))
        one = hashes.join(wrong, "file", "left").select(
            F.substring_index("file", "-", -1).cast("int").alias("region"), F.lit(kind).alias("kind"), "sha256", F.coalesce("state", F.lit("certified")).alias("state")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_LINES} SELECT k AS region, CASE WHEN k = 0 THEN 'missing columns: absent' WHEN k = 2 THEN 'header is not tabular: ' || split_part(body, chr(10), 1) WHEN k = 4 THEN 'invalid JSON' END AS problem
FROM L WHERE k IN (0, 2, 4)""")
def raw_file_contracts(spark, sf):
    """What files break of their contracts: a missing column, the wrong delimiter, another format."""
    found = fingerprints.files(spark, _region_files(spark, sf, f"{_folder(spark)}/files"))
    region = F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int")
    files = found.withColumn("file", region.cast("string"))
    header = F.split(F.concat_ws(";", F.lit("x")), ";")
    wanted = files.select(
        "file",
        F.when(region == 4, "json").otherwise("csv").alias("format"),
        F.when(region == 2, "|").otherwise(";").alias("delimiter"),
        F.when(region == 0, F.array(F.lit("absent"))).otherwise(F.filter(header, lambda c: F.lit(False))).alias("columns"),
        F.lit(None).cast("string").alias("root"),
        F.lit("text/csv").alias("content_type"),
    )
    return contracts.violations(files, wanted).select(F.col("file").cast("int").alias("region"), "problem")


@query("""SELECT 'nations' AS output, count(*) AS n, true AS verified, 'nation.csv' AS source FROM nation UNION ALL
SELECT 'regions', count(DISTINCT n_regionkey), true, 'nation.csv' FROM nation""")
def guarded_build(spark, sf):
    """A small build from a certified file: staged, gated, published, and verified against its lineage."""
    folder = _folder(spark)
    written = _csv(table(spark, sf, "nation").repartition(1), f"{folder}/raw", ",")
    (found,) = fingerprints.inspected(fingerprints.files(spark, written)).collect()
    manifest = spark.createDataFrame(
        [("nation.csv", found.file, found.sha256, "2026-01-01", None, False)],
        "source_id string, filename string, sha256 string, date_collecte string, ignore_xml array<string>, decompressed boolean",
    )
    schema = {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}
    outputs = [
        build.Output("nations", lambda c: readers.read_csv_named(c.spark, c.raw["nation.csv"], schema, ","), ["nation.csv"], order=("n_nationkey",)),
        build.Output("regions", lambda c: c.staged("nations").groupBy("n_regionkey").count(), ["nation.csv"], derived_from=("nations",)),
    ]
    unknown = lambda c: {"unknown region": c.staged("nations").join(c.staged("regions"), "n_regionkey", "left_anti")}
    build.run_build(spark, folder, "run", outputs, {"nation.csv": written}, manifest, gates=[build.Gate("regions", ("nations", "regions"), unknown)])
    build.verify_outputs(spark, folder)
    out = None
    for o in outputs:
        rows = build.published(spark, folder, o.name).agg(F.count("*").alias("n"))
        one = rows.select(F.lit(o.name).alias("output"), "n", F.lit(True).alias("verified"), F.lit(o.sources[0]).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out


_CODES = {"click": "B16", "view": "B11", "purchase": "B04", "signup": "B19", "error": "B10"}
_HOURS = """H AS (SELECT event_type AS s, CAST(ts AS DATE) AS d, extract('hour' FROM ts) AS h, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY 1, 2, 3),
A AS (SELECT 'load' AS s, d, h, CAST(sum(v) AS BIGINT) AS v FROM H GROUP BY 2, 3), B AS (SELECT * FROM H UNION ALL SELECT * FROM A),
G AS (SELECT s, d, CAST(h AS BIGINT) AS h FROM (SELECT DISTINCT s, d FROM B), range(0, 24) t(h)),
J AS (SELECT G.s, G.d, G.h, B.v FROM G LEFT JOIN B ON B.s = G.s AND B.d = G.d AND B.h = G.h)"""


def _documents(spark, sf, header, folder: str, root: str, load: bool = False, leading: bool = False) -> str:
    """A document per type (or for all of them) and day: the hours that have events, as positions of a period."""
    series = F.lit("load") if load else F.col("event_type")
    hours = table(spark, sf, "events").select(series.alias("s"), F.col("ts").cast("date").alias("d"), F.hour("ts").alias("h"), cents("value").alias("c"))
    # 24 columns a document
    sums = [F.sum(F.when(F.col("h") == h, F.col("c"))) for h in range(24)]
    wide = hours.groupBy("s", "d").agg(*[(F.coalesce(x, F.lit(0)) if leading and h == 0 else x).alias(f"q{h}") for h, x in enumerate(sums)])
    text = xml_series.document_text(F.col("s"), [(F.lit(h + 1), F.col(f"q{h}")) for h in range(24)], "PT60M", "@start", "@end")
    start, end = (F.concat(F.date_add("d", n).cast("string"), F.lit("T00:00Z")) for n in (0, 1))
    text = F.replace(F.replace(text, F.lit("@start"), start), F.lit("@end"), end)
    text = F.replace(text, F.lit("</mRID>"), F.concat(F.lit("</mRID>"), header))
    month = F.date_format("d", "yyyy-MM").alias("month")
    lines = wide.select(month, F.lit(1).alias("at"), text.alias("value"))
    # a document for each month: its root around the series
    months = wide.select(month).distinct()
    edges = [months.select("month", F.lit(at).alias("at"), F.lit(tag).alias("value")) for at, tag in ((0, f"<{root}>"), (2, f"</{root}>"))]
    whole = lines.unionByName(edges[0]).unionByName(edges[1])
    whole.repartition("month").sortWithinPartitions("month", "at").select("month", "value").write.partitionBy("month").text(folder)
    return folder


@query(f"""WITH {_HOURS}, C AS (SELECT s, d, h, last_value(CASE WHEN h = 0 THEN coalesce(v, 0) ELSE v END IGNORE NULLS) OVER (PARTITION BY s, d ORDER BY h) AS v FROM J),
W AS (SELECT d + h * INTERVAL 1 HOUR AS t, {', '.join(f"coalesce(sum(v) FILTER (WHERE s = '{s}'), 0) AS {s}" for s in (*_CODES, "load"))} FROM C GROUP BY 1)
SELECT extract('hour' FROM timezone('Europe/Rome', timezone('UTC', t))) AS heure_locale, count(*) AS n, CAST(sum(click) AS BIGINT) AS solar, CAST(sum(error) AS BIGINT) AS storage,
CAST(sum(load) AS BIGINT) AS load, CAST(sum(click + view + purchase + signup) AS BIGINT) AS total FROM W WHERE click + view + purchase + signup > 0 GROUP BY 1""")
def xml_generation(spark, sf):
    """Documents by source code and of the load, as files: codes become fuels, storage stays outside the total."""
    folder, codes = _folder(spark), F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    zone = lambda way: F.lit(f"<{way}BiddingZone_Domain.mRID>10Y</{way}BiddingZone_Domain.mRID>")
    code = F.concat(zone("in"), F.lit("<MktPSRType><psrType>"), codes[F.col("s")], F.lit("</psrType></MktPSRType>"))
    made = _documents(spark, sf, code, f"{folder}/made", "GL_MarketDocument", leading=True)
    load = _documents(spark, sf, zone("out"), f"{folder}/load", "GL_MarketDocument", load=True, leading=True)
    read = lambda path: xml_series.read_time_series(spark, path)
    table_ = B.generation(B.fuel_hours(read(made), read(load)))
    whole = lambda c: F.sum(c).cast("bigint")
    return table_.groupBy(F.col("heure_locale").cast("bigint").alias("heure_locale")).agg(
        F.count("*").alias("n"), whole("solaire_mw").alias("solar"), whole("step_mw").alias("storage"), whole("charge_mw").alias("load"),
        whole("production_totale_mw").alias("total"),
    )


@query(f"""WITH {_HOURS}, C AS (SELECT s, d, h, v IS NOT NULL AS declared, last_value(v IGNORE NULLS) OVER (PARTITION BY s, d ORDER BY h) AS v FROM J WHERE s IN ('purchase', 'view'))
SELECT CASE s WHEN 'purchase' THEN 'entrant' ELSE 'sortant' END AS sens, h AS hour, count(*) AS n, count(*) FILTER (WHERE declared) AS n_declared, CAST(sum(v) AS BIGINT) AS mw FROM C WHERE v IS NOT NULL GROUP BY 1, 2""")
def xml_flows(spark, sf):
    """Flow documents of two directions, as files: leading positions that lack are skipped, others repeat the last."""
    folder, out = _folder(spark), None
    path = _documents(spark, sf, F.lit(""), folder, "Publication_MarketDocument")
    documents = xml_series.read_time_series(spark, path)
    for kind, way in (("purchase", "entrant"), ("view", "sortant")):
        one = B.flows(documents.filter(F.col("mRID") == kind), F.lit(2024), F.lit(way))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("sens", F.hour("date_heure_utc").cast("bigint").alias("hour")).agg(
        F.count("*").alias("n"), F.count_if("declare").alias("n_declared"), F.sum("mw").cast("bigint").alias("mw")
    )
