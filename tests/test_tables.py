import pytest
from pyspark.sql import functions as F

from chronowatt.operators.quality import GuardError
from chronowatt.plans import fixed_values as V, tables as B
from chronowatt.sources import readers, xml_series
from tests.test_sources import IN, OUT, document, gz, period, time_series, write

CURVE = (
    "territoire string, date_heure string, statut string, production_totale_mw double, thermique_mw double, "
    "hydraulique_mw double, micro_hydraulique_mw double, photovoltaique_mw double, eolien_mw double, "
    "bioenergies_mw double, importations_mw double"
)


def curve_row(label, total=200.0, where="Corse", micro=1.0, wind=3.0, solar=10.0):
    return (where, label, "Validé", total, 100.0, 50.0, micro, solar, wind, 2.0, 35.0)


def curve(spark, *rows):
    return spark.createDataFrame(list(rows), CURVE)


def test_load_curve_reads_the_label_as_legal_time(spark, session_zone):
    raw = curve(
        spark,
        curve_row("2024-03-31T01:00:00+00:00"),
        curve_row("2024-03-31T02:00:00+00:00", total=230.0),  # does not exist in legal time
        curve_row("2024-03-31T03:00:00+00:00", micro=None),
        curve_row("2024-07-01T00:00:00+00:00"),
        curve_row("2024-07-01T01:00:00+00:00", total=0.0),
        curve_row("2024-07-01T00:00:00+00:00", where="Réunion"),
    )
    rows = {r.horodatage_publie[:13]: r for r in B.load_curve(raw).collect()}
    assert set(rows) == {"2024-03-31T01", "2024-03-31T03", "2024-07-01T00"}
    july = rows["2024-07-01T00"]
    assert (str(july.date_heure_utc), july.heure_locale, july.mois_local, july.annee_locale) == ("2024-06-30 22:00:00", 0, 7, 2024)
    assert str(rows["2024-03-31T03"].date_heure_utc) == "2024-03-31 01:00:00"
    assert (rows["2024-03-31T03"].enr_distrib_mw, july.enr_distrib_mw, july.part_enr_distrib) == (15.0, 16.0, 8.0)
    losses = B.load_curve_losses(raw).first()
    assert (losses.phantom_hours, losses.rows_at_zero) == (1, 1)
    B.check_load_curve(B.load_curve(raw))


def test_load_curve_guards(spark):
    with pytest.raises(Exception, match="expected suffix"):
        B.load_curve(curve(spark, curve_row("2024-07-01T00:00:00+02:00"))).collect()
    ok = curve_row("2024-07-01T00:00:00+00:00")
    with pytest.raises(GuardError, match="null_eolien_mw"):
        B.check_load_curve(B.load_curve(curve(spark, ok, curve_row("2024-07-01T01:00:00+00:00", wind=None))))
    with pytest.raises(GuardError, match="instant twice"):
        B.check_load_curve(B.load_curve(curve(spark, ok, ok)))
    with pytest.raises(GuardError, match="solar part"):
        B.check_load_curve(B.load_curve(curve(spark, curve_row("2024-07-01T00:00:00+00:00", wind=-9.0))))


def test_live_mix_drops_the_broken_balance(spark, session_zone):
    cols = "d string, total double, filiere_thermique double, filiere_enr_distrib double, hydraulique double, liaisons double, photovoltaique double, eolien double, bioenergies double, micro_hydro double, statut string"
    row = ("2024-07-01T10:00:00+00:00", 200.0, 100.0, 30.0, 40.0, 30.0, 20.0, 5.0, 3.0, 2.0, "Estimé")
    broken = ("2024-07-01T10:15:00+00:00", -91.0, *row[2:])
    raw = spark.createDataFrame([row, broken], cols).withColumn("date", F.col("d").cast("timestamp")).drop("d")
    (got,) = B.live_mix(raw).collect()
    assert (got.heure_locale, got.part_soleil, got.part_enr_sym, got.statut) == (12, 10.0, 15.0, "Estimé")


def test_curtailment(spark, tmp_path):
    lines = [f"Corse,2018-{m:02d},0" for m in range(1, 13)] + [f"Corse,2019-{m:02d},{m},0.5" for m in range(1, 13)]
    schema = "territoire string, mois string, duree_h double, taux_pct double"
    p = write(tmp_path / "a.csv", "﻿territoire,mois,duree_h,taux_pct\n" + "\n".join([*lines, "Réunion,2018-01,5,1"]))
    table = B.curtailment(readers.read_csv_ragged(spark, p, schema))
    B.check_curtailment(table)
    assert table.filter("taux_pct is null").count() == 12 and table.agg(F.sum("duree_h")).first()[0] == 78
    p = write(tmp_path / "b.csv", "territoire,mois,duree_h,taux_pct\n" + "\n".join(lines[:-1]))
    with pytest.raises(GuardError, match="not whole"):
        B.check_curtailment(B.curtailment(readers.read_csv_ragged(spark, p, schema)))


def test_generation_by_fuel(spark, tmp_path):
    day = ("2023-12-31T22:00Z", "2024-01-01T00:00Z")
    gen = document(
        time_series(IN, "B16", period(*day, "PT60M", [(1, 10)])),
        time_series(IN, "B05", period(*day, "PT60M", [(1, 60), (2, 70)])),
        time_series(IN, "B20", period(*day, "PT60M", [(1, 5)])),
        time_series(IN, "B10", period(*day, "PT60M", [(1, 7)])),
        time_series(OUT, "B10", period(*day, "PT60M", [(1, 1000)])),
    )
    load = document(time_series(OUT, None, period(*day, "PT60M", [(1, 50)])))
    g = xml_series.read_time_series(spark, write(tmp_path / "g.xml", gen))
    c = xml_series.read_time_series(spark, write(tmp_path / "c.xml", load))
    rows = sorted(B.generation(B.fuel_hours(g, c)).collect(), key=lambda r: r.date_heure)
    assert [(r.annee, r.heure_locale) for r in rows] == [(2023, 23), (2024, 0)]  # local year, not UTC year
    first = rows[0]
    assert (first.thermique_mw, first.solaire_mw, first.step_mw, first.charge_mw, first.eolien_mw) == (65.0, 10.0, 7.0, 50.0, 0.0)
    assert first.production_totale_mw == 75.0  # storage carried, not counted
    bad = xml_series.read_time_series(spark, write(tmp_path / "x.xml", document(time_series(IN, "B99", period(*day, "PT60M", [(1, 1)])))))
    with pytest.raises(Exception, match="without a category: B99"):
        B.generation(B.fuel_hours(bad, c)).collect()


def test_flows(spark, tmp_path):
    day = ("2023-01-01T00:00Z", "2023-01-01T01:00Z")
    frames = []
    for year, sense, res, points in ((2023, "entrant", "PT15M", [(1, 40), (3, 80)]), (2023, "sortant", "PT60M", [(1, 10)])):
        text = document(time_series(None, None, period(*day, res, points)), root="Publication_MarketDocument")
        doc = xml_series.read_time_series(spark, write(tmp_path / f"{sense}.xml", text))
        frames.append(B.flows(doc, F.lit(year), F.lit(sense)))
    table = frames[0].unionByName(frames[1])
    assert table.columns == ["annee", "sens", "date_heure_utc", "minutes", "mw", "declare"]
    B.check_flows(table, (2023,))
    assert B.net_energy(table).first().net_gwh == pytest.approx((40 / 4 + 80 / 4 - 10) / 1000)
    assert B.net_energy(table, declared_only=False).first().net_gwh == pytest.approx((40 / 2 + 80 / 2 - 10) / 1000)
    with pytest.raises(GuardError, match="without any point"):
        B.check_flows(table, (2023, 2024))
    with pytest.raises(GuardError, match="negative_flow"):
        B.check_flows(table.withColumn("mw", -F.col("mw")), (2023,))


def test_emissions(spark):
    rows = [("FR", i, n, y, "1000.5") for i, n in V.EMITTERS.items() for y in range(2019, 2025)]
    other = [("DE", 1040, "Brewery", 2020, "5"), ("FR", 1040, "EDF Vazzio", 2018, "5"), ("FR", 7, "x", 2020, "5")]
    schema = "country_code string, eutl_id bigint, name string, year int, emissions_tco2e string"
    table = B.emissions(spark.createDataFrame(rows + other, schema))
    B.check_emissions(table)
    assert table.count() == 18
    with pytest.raises(GuardError, match="missing"):
        B.check_emissions(B.emissions(spark.createDataFrame(rows[1:], schema)))
    with pytest.raises(GuardError, match="empty_or_zero"):
        B.check_emissions(B.emissions(spark.createDataFrame([*rows[1:], (*rows[0][:4], "n/a")], schema)))
    with pytest.raises(GuardError, match="19 rows"):
        B.check_emissions(B.emissions(spark.createDataFrame([*rows, rows[0]], schema)))


AIR = [
    "Organisme", "Date de début", "Zas", "code site", "nom site", "type d'implantation", "type d'influence",
    "Polluant", "valeur", "unité de mesure", "validité",
]


def air_rows(hours, validity=1):
    return [(V.AIR_ORGANISATION, f"2026-07-01 {h:02d}:00:00", "Z", "FR1", "S", "Urbaine", "Fond", "O3", 50.0 if validity > 0 else None, "µg", validity) for h in hours]


def air_frame(spark, rows):
    df = spark.createDataFrame(rows, ", ".join(f"c{i} {t}" for i, t in enumerate(["string"] * 8 + ["double", "string", "int"]))).toDF(*AIR)
    return df.withColumn("Date de début", F.col("`Date de début`").cast("timestamp_ntz"))


def test_air_feed(spark, session_zone):
    raw = air_frame(spark, air_rows(range(20, 24)) + air_rows([19], -1) + [("AUTRE", *air_rows([3])[0][1:])])
    table = B.air_feed(raw)
    rows = sorted(table.collect(), key=lambda r: r.debut)
    assert [(str(r.date_locale), r.heure_locale) for r in rows] == [("2026-07-01", 22), ("2026-07-01", 23), ("2026-07-02", 0), ("2026-07-02", 1)]
    B.check_air_feed(table)


def test_air_feed_guards(spark):
    with pytest.raises(GuardError, match="irregular"):
        B.check_air_feed(B.air_feed(air_frame(spark, air_rows([1, 2, 4]))))
    with pytest.raises(GuardError, match="twice"):
        B.check_air_feed(B.air_feed(air_frame(spark, air_rows([1, 1]))))
    with pytest.raises(GuardError, match="no row"):
        B.check_air_feed(B.air_feed(air_frame(spark, [("AUTRE", *air_rows([3])[0][1:])])))


def stations(spark):
    return readers.constant_table(spark, V.AIR_STATIONS, V.AIR_STATIONS_SCHEMA)


def test_air_series_is_in_fixed_offset(spark, session_zone):
    rows = [
        ("SPO-FR41001_7", "2024-07-15 13:00:00", 80.0, 1, 1), ("SPO-FR41001_8", "2024-01-15 13:00:00", 9.0, 2, 3),
        ("SPO-FR41001_7", "2024-07-15 14:00:00", 80.0, -1, 1), ("SPO-FR41001_7", "2024-07-15 15:00:00", None, 1, 1),
        ("SPO-FR99999_7", "2024-07-15 13:00:00", 80.0, 1, 1), ("SPO-FR41001_5", "2024-07-15 13:00:00", 80.0, 1, 1),
    ]
    raw = spark.createDataFrame(rows, "Samplingpoint string, Start string, Value double, Validity int, Verification int")
    raw = raw.withColumn("Start", F.col("Start").cast("timestamp_ntz"))
    pollutants = readers.constant_table(spark, V.POLLUTANT_OF_CODE, "code_pol int, polluant string")
    table = B.air_series(raw, stations(spark), pollutants)
    got = {r.polluant: (str(r.date_heure_utc), str(r.date_heure_locale), r.heure_locale, r.station) for r in table.collect()}
    assert got == {
        "O3": ("2024-07-15 12:00:00", "2024-07-15 14:00:00", 14, "AJACCIO CANETTO"),
        "NO2": ("2024-01-15 12:00:00", "2024-01-15 13:00:00", 13, "AJACCIO CANETTO"),
    }
    with pytest.raises(GuardError, match="without ozone"):
        B.check_air_series(table, stations(spark))


def weather_file(path, hours, columns="NUM_POSTE;NOM_USUEL;LAT;LON;ALTI;AAAAMMJJHH;T;QT;JUNK", qt="1"):
    lines = [f"1;POST;42;9;10;{h};20.5;{qt};odd" for h in hours]
    return gz(path, "\n".join([columns, *lines]) + "\n")


def hours(day, count=24, start=0):
    return [f"202507{day:02d}{h:02d}" for h in range(start, start + count)]


def test_weather(spark, tmp_path):
    a = weather_file(tmp_path / "a.csv.gz", hours(1) + hours(2) + ["2025070222"])
    b = weather_file(tmp_path / "b.csv.gz", hours(3) + hours(4, 6), "NUM_POSTE;NOM_USUEL;LAT;LON;ALTI;AAAAMMJJHH;T;QT;OTHER")
    raw = readers.read_csv_union_by_name(spark, [a, b], columns=B.WEATHER_COLUMNS)
    table = B.weather(raw).dropDuplicates(["num_poste", "date_heure_utc"])
    days = {str(r.date_locale): r.n for r in table.groupBy("date_locale").agg(F.count("*").alias("n")).collect()}
    assert days == {"2025-07-02": 24, "2025-07-03": 24}  # both edge days are gone
    B.check_weather(table)
    with pytest.raises(GuardError, match="twice"):
        B.check_weather(B.weather(raw))


def test_weather_guards(spark, tmp_path):
    read = lambda name, *a, **k: readers.read_csv_union_by_name(spark, [weather_file(tmp_path / name, *a, **k)], columns=B.WEATHER_COLUMNS)
    whole = hours(1) + hours(2) + hours(3) + hours(4)
    hollow = [h for h in whole if not h.startswith("2025070212")and not h.startswith("2025070213")]
    with pytest.raises(GuardError, match="hollow day"):
        B.check_weather(B.weather(read("h.csv.gz", hollow)))
    with pytest.raises(Exception, match="unknown quality code"):
        B.weather(read("q.csv.gz", whole, qt="7")).collect()
    assert B.weather(read("d.csv.gz", whole, qt="2")).isEmpty()
    with pytest.raises(GuardError, match="no row"):
        B.check_weather(B.weather(read("s.csv.gz", hours(1))))


def test_air_weather(spark):
    ozone = spark.sql(
        """select code_site, 'S' || code_site station, 'Urbaine' implantation, 'Fond' influence, d date_locale, 100.0d mda8,
        14 heure_du_max, 24L n_moyennes_valides, ok valide from values ('A', date'2024-07-01', true), ('A', date'2024-07-02', false), ('B', date'2024-07-01', true) t(code_site, d, ok)"""
    )
    temp = spark.sql(
        "select '1' num_poste, 'P' poste, date'2024-07-01' date_locale, h heure_locale, 20.04d + h temperature_c from (select explode(sequence(0, 9)) h)"
    )
    pairing = spark.createDataFrame([("A", "1"), ("B", "2")], "code_site string, num_poste string")
    table = B.air_weather(ozone, temp, pairing)
    (row,) = table.collect()
    assert (row.code_site, row.poste, row.t_max, row.t_min, row.t_moy, row.n_heures_temp) == ("A", "P", 29.0, 20.0, 24.5, 10)
    with pytest.raises(GuardError, match="without temperature"):
        B.check_air_weather(table, ozone)
    B.check_air_weather(table, ozone.filter("code_site = 'A'"))
    with pytest.raises(GuardError, match="no row"):
        B.check_air_weather(table.filter("false"), ozone)
    problems = {(r.problem, r.key) for r in B.pairing_problems(pairing, ozone.select("code_site").distinct(), temp).collect()}
    assert problems == {("post without values", "2")}


def test_sales(spark, tmp_path):
    a = gz(tmp_path / "a.csv.gz", "nature_mutation,valeur_fonciere,code_commune\nVente,100000,2A004\nEchange,5,2A004\n")
    b = gz(tmp_path / "b.csv.gz", "nature_mutation,valeur_fonciere,extra\nVente,200000,x\n")
    table = B.sales(readers.read_csv_union_by_name(spark, [a, b], sep=","))
    assert table.count() == 2 and set(table.columns) == {"nature_mutation", "valeur_fonciere", "code_commune", "extra"}


# ---- the two-month proof -------------------------------------------------------------------------------

YEARS = range(2019, 2025)


def proof_lines():
    days = {6: 30, 7: 31}
    value = {6: "100.49", 7: "122.49"}
    return [
        ("Corse", "Validé", f"{y}-{m:02d}-{d:02d}T{h:02d}:00:00+00:00", value[m])
        for y in YEARS for m in (6, 7) for d in range(1, days[m] + 1) for h in range(24)
    ]


def proof_frame(spark, rows):
    return spark.createDataFrame(rows, "territoire string, statut string, date_heure string, production_totale_mw string")


def test_proof_extract(spark):
    lines = proof_lines()
    extra = [("Corse", "x", "2024-08-01T00:00:00+00:00", "1"), ("Réunion", "x", "2024-06-01T00:00:00+00:00", "1"), ("Corse", "x", "2018-06-01T00:00:00+00:00", "1")]
    extract = readers.proof_extract(proof_frame(spark, lines + extra), "Corse", list(YEARS), ["06", "07"])
    B.check_demand_extract(extract, list(YEARS))
    proof = B.demand_proof(extract, list(YEARS))
    got = {r.mois: (r.heures, round(r.moyenne_mw, 6), r.affiche_mw) for r in proof.collect()}
    assert got == {6: (4320, 100.49, 100), 7: (4464, 122.49, 122)}
    curve_like = extract.select(F.substring("date_heure", 6, 2).cast("int").alias("mois_local"), F.col("production_totale_mw").cast("double").alias("production_totale_mw"))
    B.check_demand_proof(proof, curve_like)
    with pytest.raises(GuardError, match="means differ"):
        B.check_demand_proof(proof, curve_like.withColumn("production_totale_mw", F.col("production_totale_mw") + 1e-3))


@pytest.mark.parametrize(
    "change,match",
    [
        (lambda r: r[1:], "not whole"),
        (lambda r: [*r[1:], r[5]], "twice"),
        (lambda r: [*r[1:], (*r[0][:3], "0")], "not_positive"),
        (lambda r: [*r[1:], (*r[0][:3], "Infinity")], "not_positive"),
        (lambda r: [*r[1:], (*r[0][:2], r[0][2].replace("+00:00", "+02:00"), "1")], "suffix"),
        (lambda r: [*r, ("Corse", "x", "2024-08-01T00:00:00+00:00", "1")], "outside_perimeter"),
    ],
)
def test_proof_refuses(spark, change, match):
    with pytest.raises(GuardError, match=match):
        B.check_demand_extract(proof_frame(spark, change(proof_lines())), list(YEARS))
