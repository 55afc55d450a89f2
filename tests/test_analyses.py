"""The published analyses against plain SQL on small prepared tables."""

import datetime as dt
import decimal
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronowatt.functions import timeaxis as T
from chronowatt.plans import analyses as A, tables as B
from tests.test_sources import gz


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two years of hourly curve and generation, quarter-hourly flows, four summers of air."""
    root = tmp_path_factory.mktemp("prepared")
    h = spark.range(0, 24 * 800).select(T.plus_hours(F.lit("2021-11-30 23:00:00").cast("timestamp_ntz"), F.col("id")).alias("u"), "id")
    local = T.utc_to_local("u")
    day = F.sin(F.col("id") * (2 * math.pi / 24) - 1.5)
    noise = F.col("id") * 7919 % 101
    curve = h.select(
        F.col("u").alias("date_heure_utc"), local.alias("date_heure_locale"), F.hour(local).alias("heure_locale"),
        F.month(local).alias("mois_local"), F.year(local).alias("annee_locale"),
        F.when(F.year(local) < 2023, "Validé").otherwise("Estimé").alias("statut"),
        (300 + 60 * day + noise + F.month(local) * 3).alias("production_totale_mw"),
        (120 + noise / 2.0).alias("thermique_mw"), (60 + 20 * F.cos(F.col("id") / 900.0)).alias("hydraulique_mw"),
        F.when(F.col("id") % 3 > 0, 2.0).alias("micro_hydraulique_mw"),
        (F.greatest(day, F.lit(-0.01)) * 110).alias("photovoltaique_mw"), (noise / 5.0 - 2).alias("eolien_mw"),
        F.lit(3.0).alias("bioenergies_mw"), (70 - noise / 4.0).alias("importations_mw"),
    )
    curve = curve.withColumn("enr_distrib_mw", F.expr("photovoltaique_mw + eolien_mw + bioenergies_mw + coalesce(micro_hydraulique_mw, 0)"))
    generation = h.select(
        F.col("u").alias("date_heure"), F.year(local).alias("annee"), F.hour(local).alias("heure_locale"),
        F.lit(600.0).alias("thermique_mw"), F.lit(10.0).alias("hydraulique_mw"), (F.greatest(day, F.lit(0.0)) * 300).alias("solaire_mw"),
        (F.col("id") * 104729 % 400).cast("double").alias("eolien_mw"), F.lit(5.0).alias("bioenergies_mw"), F.lit(0.0).alias("autre_mw"),
        F.lit(1.0).alias("step_mw"), F.when(F.col("id") % 50 > 0, 700.0).otherwise(0.0).alias("charge_mw"),
    ).withColumn("production_totale_mw", F.expr("thermique_mw + hydraulique_mw + solaire_mw + eolien_mw + bioenergies_mw + autre_mw"))
    flows = spark.range(0, 4 * 24 * 40).select(
        F.lit(2023).alias("annee"), F.explode(F.array(F.lit("entrant"), F.lit("sortant"))).alias("sens"),
        T.plus_minutes(F.lit("2023-01-01").cast("timestamp_ntz"), F.col("id") * 15).alias("date_heure_utc"), F.lit(15).alias("minutes"),
        (F.floor(F.col("id") / 3) * 37 % 90).cast("double").alias("mw"), (F.col("id") % 4 != 3).alias("declare"),
    ).withColumn("mw", F.when(F.col("sens") == "sortant", F.col("mw") * 0.7).otherwise(F.col("mw")))
    days = spark.sql(
        """select s.*, d date_locale, 60 + (dayofyear(d) * 37 + year(d) * 11 + ascii(s.code_site) * 29) % 90 mda8, 14 heure_du_max, 24L n_moyennes_valides,
        (dayofyear(d) % 11) <> 3 valide from values ('A1','AJACCIO CANETTO','Urbaine','Fond'),('B1','BASTIA GIRAUD','Urbaine','Fond'),('C1','VENACO','Rurale régionale','Fond'),
        ('D1','BASTIA LA MARANA','Périurbaine','Industrielle'),('E1','AJACCIO CONFINA 2','Périurbaine','Fond') s(code_site, station, implantation, influence)
        lateral view explode(sequence(date'2022-05-01', date'2026-07-20')) x as d where s.station <> 'AJACCIO CONFINA 2' or d >= date'2024-02-01'"""
    ).withColumn("mda8", F.col("mda8").cast("double"))
    hours = days.filter("month(date_locale) between 6 and 8").select(
        "code_site", "station", "implantation", "influence", "date_locale", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("heure_locale"),
        F.explode(F.array(F.lit("O3"), F.lit("NO2"))).alias("polluant"), "mda8",
    )
    air = hours.select(
        "*", T.plus_hours(T.midnight("date_locale"), F.col("heure_locale") - 2).alias("date_heure_utc"),
        F.when(F.col("polluant") == "O3", F.col("mda8") + 9 * F.sin((F.col("heure_locale") - 8) / 4.0)).otherwise(20 - F.abs(F.col("heure_locale") - 8)).alias("valeur"),
        (F.year("date_locale") % 3 + 1).alias("verification"),
    ).drop("mda8").filter("polluant = 'O3' or station <> 'VENACO'")
    crossed = days.filter("valide").withColumn("t_max", F.expr("20d + dayofyear(date_locale) * 13 % 18"))
    out = {}
    for name, df in {"curve": curve, "generation": generation, "flows": flows, "mda8": days, "air": air, "crossed": crossed}.items():
        df.write.parquet(str(root / name))
        out[name] = spark.read.parquet(str(root / name))
    con = duckdb.connect()
    for name in out:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root / name}/*.parquet'")
    con.execute(
        """CREATE VIEW bg AS SELECT * FROM mda8 WHERE valide AND influence='Fond' AND month(date_locale) IN (6,7,8) AND year(date_locale) BETWEEN 2020 AND 2025"""
    )
    return out, con


def rounded(row):
    return tuple(round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v for v in row)


def check(con, df, sql):
    got = sorted((rounded(r) for r in df.collect()), key=str)
    want = sorted((rounded(r) for r in con.execute(sql).fetchall()), key=str)
    assert len(got) == len(want) and want
    for g, w in zip(got, want):
        assert g == pytest.approx(w, rel=1e-9, abs=2e-6) if all(isinstance(x, (int, float)) for x in w if x is not None) and None not in w else g == w


def test_demand(tables):
    t, con = tables
    check(con, A.yearly_share_range(t["curve"]), "SELECT min(s), max(s) FROM (SELECT 100*sum(photovoltaique_mw)/sum(production_totale_mw) s FROM curve GROUP BY annee_locale)")
    check(con, A.monthly_demand(t["curve"]).select("mois_local", "shown"), "SELECT mois_local, CAST(floor(avg(production_totale_mw)+0.5) AS INT) FROM curve GROUP BY 1")
    check(
        con, A.season_demand(t["curve"]).filter("season = 'summer'").select("june_to_july_percent"),
        "SELECT 100.0*(avg(production_totale_mw) FILTER (WHERE mois_local=7) - avg(production_totale_mw) FILTER (WHERE mois_local=6))/avg(production_totale_mw) FILTER (WHERE mois_local=6) FROM curve",
    )
    check(con, A.july_surplus(t["curve"]), "SELECT heure_locale, avg(production_totale_mw) FILTER (WHERE mois_local=7) - avg(production_totale_mw) FILTER (WHERE mois_local=6) FROM curve GROUP BY 1")
    assert A.july_plateau(t["curve"]).count() == 1 and A.july_plateau_claims(t["curve"]).count() == 2
    assert A.demand_change_by_status(t["curve"]).count() == 2


def test_mix_by_hour(tables):
    t, con = tables
    check(
        con, A.summer_hourly_shares(t["curve"]),
        "SELECT heure_locale, 100.0*sum(photovoltaique_mw)/sum(production_totale_mw), 100.0*sum(thermique_mw)/sum(production_totale_mw), 100.0*sum(importations_mw)/sum(production_totale_mw) FROM curve WHERE mois_local IN (6,7,8) GROUP BY 1",
    )
    assert A.hourly_stack(t["curve"]).filter("distributed < 0").isEmpty()
    slot = A.greenest_slot(t["curve"]).first()
    check(
        con, A.greenest_slot(t["curve"]).select("narrow_share", "wide_share"),
        f"SELECT 100.0*sum(enr_distrib_mw)/sum(production_totale_mw), 100.0*sum(enr_distrib_mw+hydraulique_mw)/sum(production_totale_mw) FROM curve WHERE heure_locale BETWEEN {min(slot.h1, slot.h2)} AND {max(slot.h1, slot.h2)}",
    )
    assert {r["name"] for r in A.greenest_slot_claims(t["curve"]).collect()} == {"one_hour_apart", "around_noon"}
    check(
        con, A.hours_renewable_over_thermal(t["curve"]).select("heure_locale"),
        "SELECT heure_locale FROM curve GROUP BY 1 HAVING sum(enr_distrib_mw+hydraulique_mw) > sum(thermique_mw)",
    )
    got = A.slot_shares(t["curve"], {"noon": (13, 14, 15), "evening": (20, 21, 22, 23)})
    check(con, got.filter("slot = 'noon'").select("solar"), "SELECT 100.0*sum(photovoltaique_mw)/sum(production_totale_mw) FROM curve WHERE mois_local IN (6,7,8) AND heure_locale IN (13,14,15)")


def test_islands(tables):
    t, con = tables
    window = (2022, 2023)
    mix = A.island_mix(t["curve"], t["generation"], window)
    check(
        con, mix.filter("island = 'A'").select("thermique", "hydraulique"),
        """WITH b AS (SELECT sum(thermique_mw) th, sum(hydraulique_mw+coalesce(micro_hydraulique_mw,0)) hy, sum(photovoltaique_mw) so, sum(eolien_mw) eo, sum(bioenergies_mw) bi FROM curve WHERE annee_locale BETWEEN 2022 AND 2023)
        SELECT 100.0*th/(th+hy+so+eo+bi), 100.0*hy/(th+hy+so+eo+bi) FROM b""",
    )
    check(con, mix.filter("island = 'B'").select("solaire"), "SELECT 100.0*sum(solaire_mw)/sum(production_totale_mw) FROM generation WHERE annee BETWEEN 2022 AND 2023")
    assert A.island_mix(t["curve"], t["generation"], window, by_year=True).count() == 4
    assert A.unmatched_years(t["curve"], t["generation"].filter("annee = 2022"), window).collect()[0].annee == 2023
    above = A.hours_above_threshold(t["curve"], t["generation"], window)
    check(
        con, above.select("annee", "a", "b_generation", "b_load"),
        """WITH c AS (SELECT annee_locale an, avg(CASE WHEN 100.0*(greatest(photovoltaique_mw,0)+greatest(eolien_mw,0))/production_totale_mw > 35 THEN 1.0 ELSE 0.0 END)*100 x FROM curve WHERE annee_locale BETWEEN 2022 AND 2023 GROUP BY 1),
        g AS (SELECT annee an, 100*avg(CASE WHEN 100.0*(greatest(solaire_mw,0)+greatest(eolien_mw,0))/production_totale_mw > 35 THEN 1.0 ELSE 0.0 END) y, 100*avg(CASE WHEN 100.0*(greatest(solaire_mw,0)+greatest(eolien_mw,0))/nullif(charge_mw,0) > 35 THEN 1.0 ELSE 0.0 END) z FROM generation WHERE annee BETWEEN 2022 AND 2023 GROUP BY 1)
        SELECT an, x, y, z FROM c JOIN g USING (an)""",
    )
    assert {r["name"]: r.ok for r in A.threshold_claims(above).collect()}["same_years"] is True
    check(
        con, A.hours_per_year_above(t["curve"]),
        "SELECT annee_locale, count(*) FILTER (WHERE p > 35), count(*) FILTER (WHERE p > 45) FROM (SELECT annee_locale, 100.0*(greatest(photovoltaique_mw,0)+greatest(eolien_mw,0))/production_totale_mw p FROM curve) GROUP BY 1",
    )
    check(con, A.dependence(t["curve"]).filter("part = 'liaisons'").select("electricity", "primary"), "SELECT 100.0*sum(importations_mw)/sum(production_totale_mw), 9.3 FROM curve")
    assert A.hydro_against_thermal(t["curve"]).first().correlation is not None and A.hydro_claims(t["curve"]).count() == 1


def test_seasonal_tables(tables):
    t, con = tables
    loads = [tuple(r) for r in t["curve"].select("annee_locale", "mois_local", "production_totale_mw").collect()]
    summers, winters = {}, {}
    for year, month, load in loads:
        if month in (6, 7, 8, 9):
            summers.setdefault(year, []).append(load)
        if month in (12, 1, 2):
            winters.setdefault(year if month == 12 else year - 1, []).append(load)
    for r in A.summer_peaks(t["curve"]).collect():
        hours = sorted(summers.pop(r.annee_locale), reverse=True)
        assert (r.n, r.maximum, r.n_at_level) == (len(hours), hours[0], sum(h >= 380 for h in hours))
        assert r.top_mean == pytest.approx(sum(hours[:20]) / 20) and r.median == pytest.approx(np.median(hours))
        summers[r.annee_locale] = hours
    for r in A.summer_quantiles(t["curve"]).collect():
        hours = summers[r.annee_locale]
        assert [r.q75, r.q99, r.maximum] == pytest.approx([np.quantile(hours, 0.75), np.quantile(hours, 0.99), max(hours)])
    found = {r.winter: (r.n, r.maximum) for r in A.winter_peaks(t["curve"]).collect()}
    assert found == {w: (len(h), max(h)) for w, h in winters.items()}
    gaps = {r.annee: r.gap for r in A.summer_less_winter(t["curve"]).collect()}
    whole = {w: h for w, h in winters.items() if len(h) >= 2100 and w + 1 in summers}
    assert gaps == pytest.approx({w + 1: max(summers[w + 1]) - max(h) for w, h in whole.items()})
    assert A.quantile_gains(t["curve"]).count() == 1 and A.peak_claims(t["curve"]).count() == 3
    perimeter = {r.annee_locale: r for r in A.micro_hydro_perimeter(t["curve"]).collect()}
    assert perimeter[2022].largest_at_peak == 2.0 and perimeter[2022].n_missing > 2000


def test_external_checks(tables, spark):
    t, con = tables
    emitted = spark.createDataFrame([(2022, 5e5), (2022, 5e5), (2023, 9e5)], "annee int, tco2 double")
    check(
        con, A.emission_intensity(emitted, t["curve"]).select("annee", "intensity"),
        "SELECT annee_locale, CASE annee_locale WHEN 2022 THEN 1e6 ELSE 9e5 END/(sum(thermique_mw)/1000) FROM curve WHERE annee_locale IN (2022, 2023) GROUP BY 1",
    )
    shift = A.intensity_shift(A.emission_intensity(emitted, t["curve"]), "Validé", "Estimé").first()
    assert shift.shift_percent < 0
    check(
        con, A.net_against_published(t["flows"]).select("declared_gwh", "carried_gwh"),
        "SELECT sum(CASE WHEN sens='entrant' THEN mw ELSE -mw END*minutes/60.0) FILTER (WHERE declare)/1000, sum(CASE WHEN sens='entrant' THEN mw ELSE -mw END*minutes/60.0)/1000 FROM flows",
    )
    check(
        con, A.net_export_around_threshold(t["flows"], t["generation"]).select("threshold", "n_hours", F.round("mean_net", 5)),
        """WITH p AS (SELECT date_trunc('hour', date_heure_utc) h, sens, avg(mw) mw FROM flows GROUP BY 1, 2), n AS (SELECT h, max(mw) FILTER (WHERE sens='sortant') - max(mw) FILTER (WHERE sens='entrant') s FROM p GROUP BY 1)
        SELECT CASE WHEN 100.0*(greatest(solaire_mw,0)+greatest(eolien_mw,0))/production_totale_mw > 35 THEN 'above' ELSE 'below' END, count(*), round(avg(s), 5) FROM generation JOIN n ON date_heure = h GROUP BY 1""",
    )
    carried = {r.sens: r for r in A.carried_share(t["flows"]).collect()}
    want = con.execute("SELECT 100.0*sum(mw) FILTER (WHERE NOT declare)/sum(mw) FROM flows WHERE sens='entrant'").fetchone()[0]
    assert carried["entrant"].carried_percent == pytest.approx(want)
    assert carried["entrant"].longest_hours == 0.75


def test_episodes_equal_sequential_count(tables):
    t, con = tables
    values = con.execute("SELECT annee, 100.0*(greatest(solaire_mw,0)+greatest(eolien_mw,0))/production_totale_mw FROM generation ORDER BY date_heure").fetchall()
    got = {r.annee: (r.n_episodes, r.upper_median, r.longest) for r in A.episodes_above(t["generation"]).collect()}
    for year in (2022, 2023):
        lengths, run = [], 0
        for v in [p for y, p in values if y == year] + [0.0]:
            if v > 35:
                run += 1
            elif run:
                lengths.append(run)
                run = 0
        assert got[year] == (len(lengths), sorted(lengths)[len(lengths) // 2], max(lengths))


def test_codes_and_balances(spark):
    hours = spark.sql("select timestamp_ntz'2024-01-01 05:00:00' date_heure, c code, v mw from values ('B05', 30d), ('B10', 50d), ('B16', 70d) t(c, v)")
    assert {r.code: r.share for r in A.code_shares(hours).collect()} == {"B05": 30.0, "B10": None, "B16": 70.0}
    pub = spark.createDataFrame([("x", 10.0)], "k string, gwh double")
    assert A.balance_gap(spark.createDataFrame([("x", 11.0)], "k string, gwh double"), pub, ["k"]).first().gap_percent == pytest.approx(10)
    one = lambda v: spark.createDataFrame([(v,)], "mw double")
    assert A.storage_efficiency(one(84.0), one(100.0)).first().efficiency == pytest.approx(0.84)


def test_lag_to_instrument(tables, spark, tmp_path):
    t, _ = tables
    rows = []
    for r in t["curve"].select("date_heure_utc", "photovoltaique_mw").collect():
        at = r.date_heure_utc + dt.timedelta(hours=1)  # the instrument is dated one hour later
        rows.append(f"{at:%Y%m%d%H};{r.photovoltaique_mw};1")
    rows += ["2022010100;999;2", "2022010101;;1"]
    from chronowatt.sources.readers import read_csv_union_by_name

    raw = read_csv_union_by_name(spark, [gz(tmp_path / "i.csv.gz", "AAAAMMJJHH;GLO;QGLO\n" + "\n".join(rows) + "\n")])
    glo = A.instrument_mean(raw)
    assert glo.count() == len(rows) - 2
    best = {r.regime: r.best_lag for r in A.lag_to_instrument(t["curve"], glo).collect()}
    assert best == {"summer": 1, "winter": 1}
    jumps = A.lag_around_changes(t["curve"], glo).filter("jump is not null").collect()
    assert len(jumps) >= 4 and all(abs(r.jump) < 0.2 for r in jumps)


def test_air(tables):
    t, con = tables
    ozone, air = t["mda8"], t["air"]
    check(
        con, A.station_exceedance(ozone).select("station", "n_days", "n_above", "years"),
        "SELECT station, count(*), count(*) FILTER (WHERE mda8 > 120), string_agg(DISTINCT CAST(year(date_locale) AS VARCHAR), ',' ORDER BY CAST(year(date_locale) AS VARCHAR)) FROM bg GROUP BY 1",
    )
    check(
        con, A.exceedance_counts(ozone),
        "SELECT count(DISTINCT CASE WHEN mda8 > 120 THEN date_locale END), count(DISTINCT date_locale), count(*) FILTER (WHERE mda8 > 120) FROM bg WHERE station <> 'AJACCIO CONFINA 2'",
    )
    check(
        con, A.alert_days(ozone, air, level=140.0),
        "SELECT count(*) FILTER (WHERE top >= 140) FROM bg JOIN (SELECT date_locale, station, max(valeur) top FROM air WHERE polluant='O3' GROUP BY 1, 2) USING (date_locale, station) WHERE station <> 'AJACCIO CONFINA 2'",
    )
    check(
        con, A.latest_season(ozone),
        "SELECT 2026, count(DISTINCT CASE WHEN mda8 > 120 THEN date_locale END), count(DISTINCT date_locale), max(date_locale), 92 FROM mda8 WHERE valide AND influence='Fond' AND month(date_locale) IN (6,7,8) AND year(date_locale) = 2026",
    )
    assert A.latest_season(ozone.filter("year(date_locale) < 2026")).isEmpty()
    scope = A.season_scope(ozone).first()
    assert (scope.stations_shown, scope.stations, scope.summers, scope.summers_recent, scope.recent_since) == (3, 4, 4, 2, 2024)
    assert all(r.ok for r in A.season_scope_claims(ozone).collect())
    rank = A.rural_rank(ozone).first()
    assert (rank.n_rural, rank.n_others) == (1, 3) and 1 <= rank["rank"] <= 4
    assert A.rural_claims(ozone).count() == 3
    by_band = {}
    for r in t["crossed"].filter("influence = 'Fond'").collect():
        if r.date_locale.month in (6, 7, 8) and 2020 <= r.date_locale.year <= 2025:
            edge = max((e for e in (25, 30, 35) if r.t_max >= e), default=None)
            by_band.setdefault(edge, []).append((r.t_max, r.mda8))
    got = {r.from_celsius: r for r in A.ozone_by_temperature(t["crossed"]).collect()}
    assert set(got) == set(by_band)
    for edge, days in by_band.items():
        assert (got[edge].coolest, got[edge].n_days) == (min(d[0] for d in days), len(days))
        assert got[edge].ozone == pytest.approx(sum(d[1] for d in days) / len(days))
    assert A.temperature_claims(t["crossed"]).count() == 1
    assert {r["class"] for r in A.rural_against_others(t["crossed"]).collect()} == {"rural", "others"}


def test_air_cycles(tables):
    t, con = tables
    cycles = A.diurnal_cycles(t["air"])
    tops = {r.polluant: r.heure_locale for r in cycles.filter("pct_of_peak = 100").collect()}
    assert tops == {"O3": 14, "NO2": 8}
    assert A.stations_with_one(t["air"]).isEmpty()
    one = t["air"].filter("not (station = 'BASTIA GIRAUD' and polluant = 'NO2')")
    assert [r.station for r in A.stations_with_one(one).collect()] == ["BASTIA GIRAUD"]
    o = A.ozone_hours(t["air"]).first()
    assert o.contiguous and o.first_hour <= o.peak_hour <= o.last_hour
    c = {r.polluant: r for r in A.channels(t["air"].withColumn("valeur", F.col("valeur") + 0.5), t["air"]).collect()}
    assert c["O3"].max_gap == pytest.approx(0.5)


def test_profiles_for_the_notes(tables, spark):
    t, con = tables
    check(
        con, A.curve_profile(t["curve"]),
        "SELECT count(*), min(annee_locale), max(annee_locale), count(*) FILTER (WHERE lower(statut) LIKE 'estim%'), count(*) FILTER (WHERE micro_hydraulique_mw IS NULL), datediff('hour', min(date_heure_utc), max(date_heure_utc)) + 1 FROM curve",
    )
    check(con, A.air_profile(t["air"]).select("n_hours", "n_stations", "n_verified", "n_background"), "SELECT count(*), count(DISTINCT station), count(*) FILTER (WHERE verification = 1), count(DISTINCT station) FILTER (WHERE influence='Fond') FROM air")
    local = t["curve"].select(F.lit("p").alias("num_poste"), "date_heure_locale")
    twice = A.duplicated_local_hours(local).collect()
    assert len(twice) == 2 and all(r.expected for r in twice)  # two autumns


def test_live_share(spark, session_zone):
    start = dt.datetime(2026, 7, 1, 4, 0)
    rows = [((start + dt.timedelta(minutes=15 * i)).isoformat() + "+00:00", 40.0 if i != 9 else None, 200.0, "Estimé" if i == 24 else "Validé") for i in range(25)]
    mix = spark.createDataFrame([r for r in rows if r[1]], "d string, photovoltaique double, total double, statut string").withColumn("date", F.col("d").cast("timestamp"))
    r = A.live_share(mix, "2026-07-01 23:00:00").first()
    assert (r.n_read, r.n_filled, r.n_missing, r.shown_percent, r.status) == (23, 1, 0, 20, "Estimé")
    assert (r.part_energy, r.total_energy) == (pytest.approx(240), pytest.approx(1200))
    assert (str(r.last_local), str(r.first_local), r.age_hours, r.tier) == ("2026-07-01 12:00:00", "2026-07-01 06:15:00", 13.0, "warn")


def test_curtailment_and_sales(spark):
    rows = [(y, m, float(m * (y - 2018))) for y in (2019, 2020) for m in range(1, 13)]
    table = spark.createDataFrame(rows, "annee int, mois_cal int, duree_h double")
    grid = {r.annee: r.m06 for r in A.curtailment_grid(table).collect()}
    assert grid == {2019: 6.0, 2020: 12.0}
    s = A.curtailment_season(table).first()
    assert s.season_percent == pytest.approx(100 * 18 / 78) and (s.record.annee, s.record.mois_cal) == (2020, 12)
    sold = spark.createDataFrame([("x", "1"), ("x", "3"), ("y", "5"), ("x", None)], "nom_commune string, valeur_fonciere string")
    assert [tuple(r) for r in A.sales_by_area(sold).collect()] == [("x", 3, 2.0), ("y", 1, 5.0)]
    gap = A.share_definition_gap(spark.createDataFrame([(12.0, 10.0, 1.0, 0.0, 0.0, 100.0)], "part_enr_distrib double, photovoltaique double, eolien double, bioenergies double, micro_hydro double, total double")).first()
    assert gap.max_gap == pytest.approx(1.0)


def test_site_outputs_follow_their_sources():
    from chronowatt.plans import build, site

    everything = {s for o in site.OUTPUTS for s in o.sources}
    assert len(build.plan(site.OUTPUTS, everything)) == 12
    assert [o.name for o in build.plan(site.OUTPUTS, set(site.AIR))] == ["air_serie", "air_o3_mda8"]
    assert len(site.AIR) == 22 and B.WEATHER_COLUMNS[0] == "NUM_POSTE"
