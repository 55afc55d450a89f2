"""The whole build, from raw files to verified tables."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from chronowatt.operators.quality import GuardError
from chronowatt.plans import build as K, fixed_values as V, site
from tests.test_build import MANIFEST
from tests.test_sources import IN, OUT, document, gz, period, time_series, write

START, DAYS = dt.datetime(2024, 7, 1), 5


def hours(n):
    return [START + dt.timedelta(hours=h) for h in range(n)]


def raw_files(spark, folder):
    raw = {}

    def put(source, name, make):
        raw[source] = make(folder / name)

    for source in site.SALES:
        put(source, f"{source}.csv.gz", lambda p: gz(p, "nature_mutation,valeur_fonciere,nom_commune,code_commune\nVente,1,X,2A1\nEchange,2,Y,2A2\n"))
    mix = "date;total;filiere_thermique;filiere_enr_distrib;hydraulique;liaisons;photovoltaique;eolien;bioenergies;micro_hydro;statut\n"
    mix += "".join(f"{t:%Y-%m-%dT%H:%M:%S}+00:00;200;100;30;40;30;20;5;3;2;Estimé\n" for t in hours(6))
    put("edf_mix_temps_reel", "mix.csv", lambda p: write(p, mix))
    curve = "territoire;date_heure;statut;production_totale_mw;thermique_mw;hydraulique_mw;micro_hydraulique_mw;photovoltaique_mw;eolien_mw;bioenergies_mw;bagasse_mw;importations_mw\n"
    curve += "".join(f"Corse;{t:%Y-%m-%dT%H:%M:%S}+00:00;Validé;200;100;50;1;10;3;2;;35\n" for t in hours(48))
    put("edf_courbe_charge_horaire", "curve.csv", lambda p: write(p, curve))
    cut = "﻿Territoire,Mois,Durée (h),Taux (%)\n" + "".join(f"Corse,2018-{m:02d},{m}\n" for m in range(1, 13))
    put("edf_ecretement_corse", "cut.csv", lambda p: write(p, cut))
    for y in V.GENERATION_YEARS:
        span = (f"{y}-06-01T00:00Z", f"{y}-06-01T02:00Z")
        put(f"entsoe_sardaigne_{y}", f"g{y}.xml", lambda p: write(p, document(time_series(IN, "B16", period(*span, "PT60M", [(1, 5)])))))
        put(f"entsoe_charge_sardaigne_{y}", f"c{y}.xml", lambda p: write(p, document(time_series(OUT, None, period(*span, "PT15M", [(1, 9)])))))
    for (y, d), source in site.FLOWS.items():
        span = (f"{y}-06-01T00:00Z", f"{y}-06-01T01:00Z")
        put(source, f"{source}.xml", lambda p: write(p, document(time_series(None, None, period(*span, "PT15M", [(2, 8)])), root="Publication_MarketDocument")))
    rows = "".join(f"FR,{i},{n},{y},100.5\n" for i, n in V.EMITTERS.items() for y in range(2019, 2025))
    put("seqe_emissions_verifiees", "seqe.csv", lambda p: write(p, "country_code,eutl_id,name,year,emissions_tco2e\nDE,1040,Other,2020,x\n" + rows))
    feed = ";".join(f'"{c}"' for c in site.AIR_FEED_SCHEMA) + "\n"
    feed += "".join(f"{V.AIR_ORGANISATION};{t:%Y/%m/%d %H:%M:%S};Z;FR41001;S;Urbaine;Fond;O3;50.5;µg-m3;1\n" for t in hours(3))
    put("lcsqa_temps_reel", "feed.csv", lambda p: write(p, feed))
    codes = {s[1].lower().replace(" ", "_"): s[0] for s in V.AIR_STATIONS}
    codes = {"ajaccio_canetto": "FR41001", "ajaccio_confina2": "FR41063", "bastia_giraud": "FR41002", "bastia_montesoro": "FR41017", "bastia_marana": "FR41004", "venaco": "FR41024"}
    for source in site.AIR:
        _, pollutant, *slug, kind = source.split("_")
        code = codes["_".join(slug)]
        label = f"SPO-{code}_{7 if pollutant == 'o3' else 8}"
        times = hours(24 * DAYS) if kind == "valide" else [START + dt.timedelta(days=DAYS, hours=h) for h in range(4)]
        data = [(label, t, 80.0 + t.hour, 1, 1 if kind == "valide" else 3) for t in times]
        frame = spark.createDataFrame(data, "Samplingpoint string, Start timestamp_ntz, Value double, Validity int, Verification int")
        frame = frame.withColumn("End", F.col("Start") + F.expr("INTERVAL 1 HOUR"))
        if kind == "continu":
            frame = frame.withColumn("Extra", F.lit("only here"))
        target = folder / f"{source}_dir"
        frame.coalesce(1).write.parquet(str(target))
        raw[source] = str(next(target.glob("*.parquet")))
    posts = sorted({p for _, p in V.AIR_TO_WEATHER})
    head = ";".join(["NUM_POSTE", "NOM_USUEL", "LAT", "LON", "ALTI", "AAAAMMJJHH", "T", "QT", "JUNK"])
    for source, times in zip(site.WEATHER, (hours(24 * 3), [START + dt.timedelta(hours=h) for h in range(72, 24 * DAYS)])):
        lines = "".join(f"{p};POST {p};42;9;10;{t:%Y%m%d%H};{20 + t.hour % 10};1;z\n" for p in posts for t in times)
        put(source, f"{source}.csv.gz", lambda p: gz(p, head + "\n" + lines))
    return raw


def manifest(spark, raw):
    rows = []
    for source, path in raw.items():
        with open(path, "rb") as f:
            rows.append((source, path.rsplit("/", 1)[-1], hashlib.sha256(f.read()).hexdigest(), "2026-10-01", None, False))
    return spark.createDataFrame(rows, MANIFEST)


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    return raw_files(spark, tmp_path_factory.mktemp("raw"))


@pytest.fixture(scope="module")
def built(spark, raw, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("site"))
    chosen = K.plan(site.OUTPUTS, raw)
    assert len(chosen) == len(site.OUTPUTS)
    # contracts are judged without being asked for
    site.publish(spark, root, "run1", raw, manifest(spark, raw), gates=(), built_at="2026-10-02 00:00:00")
    return root


def test_every_table_is_published_and_verified(spark, built):
    K.verify_outputs(spark, built)
    counts = {o.name: K.published(spark, built, o.name).count() for o in site.OUTPUTS}
    assert counts["dvf_corse_2024"] == 2 and counts["edf_mix_corse"] == 6 and counts["edf_courbe_corse"] == 48
    assert counts["edf_ecretement_corse"] == 12 and counts["entsoe_sardaigne"] == 12 and counts["seqe_corse"] == 18
    assert counts["entsoe_sarco"] == 6 * 3 and counts["air_corse"] == 3
    assert counts["air_serie"] == 11 * (24 * DAYS + 4)


def test_daily_tables(spark, built):
    daily = K.published(spark, built, "air_o3_mda8")
    assert daily.filter("valide").groupBy("code_site").count().filter("count >= 4").count() == 6
    crossed = K.published(spark, built, "air_temperature_jour")
    assert crossed.select("code_site").distinct().count() == 6
    assert {str(d[0]) for d in crossed.select("date_locale").distinct().collect()} == {"2024-07-02", "2024-07-03", "2024-07-04", "2024-07-05"}
    assert K.collected_on(spark, built, "lcsqa_temps_reel") == "2026-10-01"


def test_every_source_has_a_contract(spark, raw):
    assert set(V.SOURCE_CONTRACTS) == set(raw) == {s for o in site.OUTPUTS for s in o.sources}
    found = site.contracts(spark, manifest(spark, raw)).collect()
    assert len(found) == len(raw) and {r.format for r in found} == {"csv", "csv.gz", "xml", "parquet"}


def test_a_missing_summer_or_a_false_claim_leaves_the_old_publication(spark, built, raw):
    before = K.current_run(spark, built)
    with pytest.raises(GuardError, match="coverage of the air tables.*empty_year"):
        site.publish(spark, built, "run2", raw, manifest(spark, raw))
    one_summer = K.Gate(
        "one summer", site.GATES[0].needs, lambda c: {k: v.filter("check not in ('days_floor', 'station_floor')") for k, v in site.coverage_violations(c, (2024, 2024)).items()}
    )
    with pytest.raises(GuardError, match="july plateau.*one_stretch|july plateau.*afternoon"):
        site.publish(spark, built, "run3", raw, manifest(spark, raw), gates=(one_summer, site.GATES[1]))
    assert K.current_run(spark, built) == before
    site.publish(spark, built, "run4", raw, manifest(spark, raw), gates=(one_summer,))
    assert K.current_run(spark, built).endswith("run4")
    K.verify_outputs(spark, built)


def test_a_broken_contract_stops_before_any_table(spark, built, raw, tmp_path):
    page = write(tmp_path / "mix.csv", "<!DOCTYPE html><html>not today</html>")
    wrong = {**raw, "edf_mix_temps_reel": page}
    with pytest.raises(GuardError, match="web page"):
        site.publish(spark, built, "run5", wrong, manifest(spark, wrong), gates=())
