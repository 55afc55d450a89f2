"""The build of the whole site: every published table, its sources, its guards, and the gates before publication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import analyses as A, fixed_values as V, tables as B
from .build import Context, Gate, Output, claims_gate, plan, run_build
from ..operators import coverage
from ..sources import readers, xml_series
from ..sources.fingerprints import CONTRACT

SALES = ("dvf_2a_2024", "dvf_2b_2024")
WEATHER = ("meteo_horaire_corse", "meteo_horaire_corse_2020_2024")
GENERATION = tuple(f"entsoe_sardaigne_{y}" for y in V.GENERATION_YEARS)
LOAD = tuple(f"entsoe_charge_sardaigne_{y}" for y in V.GENERATION_YEARS)
FLOWS = {(y, d): f"entsoe_sarco_{y}_{d}" for y in V.FLOW_YEARS for d in V.FLOW_DIRECTIONS}

AIR = V.AIR_SOURCES

MIX_SCHEMA = {
    "date": "timestamp", "total": "double", "filiere_thermique": "double", "filiere_enr_distrib": "double",
    "hydraulique": "double", "liaisons": "double", "photovoltaique": "double", "eolien": "double",
    "bioenergies": "double", "micro_hydro": "double", "statut": "string",
}
CURVE_SCHEMA = {
    "territoire": "string", "date_heure": "string", "statut": "string", "production_totale_mw": "double",
    "thermique_mw": "double", "hydraulique_mw": "double", "micro_hydraulique_mw": "double",
    "photovoltaique_mw": "double", "eolien_mw": "double", "bioenergies_mw": "double", "importations_mw": "double",
}
CURTAILMENT_SCHEMA = "territoire string, mois string, duree_h double, taux_pct double"
EMISSIONS_SCHEMA = {
    "country_code": "string", "eutl_id": "bigint", "name": "string", "year": "int", "emissions_tco2e": "string",
}
AIR_FEED_SCHEMA = {
    "Organisme": "string", "Date de début": "string", "Zas": "string", "code site": "string", "nom site": "string",
    "type d'implantation": "string", "type d'influence": "string", "Polluant": "string", "valeur": "double",
    "unité de mesure": "string", "validité": "int",
}


def stations(spark) -> DataFrame:
    return readers.constant_table(spark, V.AIR_STATIONS, V.AIR_STATIONS_SCHEMA)


def pollutants(spark) -> DataFrame:
    return readers.constant_table(spark, V.POLLUTANT_OF_CODE, "code_pol int, polluant string")


def pairing(spark) -> DataFrame:
    return readers.constant_table(spark, V.AIR_TO_WEATHER, "code_site string, num_poste string")


def _paths(ctx: Context, ids) -> list[str]:
    return [ctx.raw[i] for i in ids]


def _sales(ctx: Context) -> DataFrame:
    return B.sales(readers.read_csv_union_by_name(ctx.spark, _paths(ctx, SALES), sep=","))


def _mix(ctx: Context) -> DataFrame:
    return B.live_mix(readers.read_csv_named(ctx.spark, ctx.raw["edf_mix_temps_reel"], MIX_SCHEMA))


def _curve(ctx: Context) -> DataFrame:
    return B.load_curve(readers.read_csv_named(ctx.spark, ctx.raw["edf_courbe_charge_horaire"], CURVE_SCHEMA))


def _curtailment(ctx: Context) -> DataFrame:
    return B.curtailment(readers.read_csv_ragged(ctx.spark, ctx.raw["edf_ecretement_corse"], CURTAILMENT_SCHEMA))


def _generation(ctx: Context) -> DataFrame:
    read = lambda ids: xml_series.read_time_series(ctx.spark, _paths(ctx, ids))
    return B.generation(B.fuel_hours(read(GENERATION), read(LOAD)))


def _flows(ctx: Context) -> DataFrame:
    out = None
    for (year, direction), source in FLOWS.items():
        document = xml_series.read_time_series(ctx.spark, ctx.raw[source])
        one = B.flows(document, F.lit(year), F.lit(direction))
        out = one if out is None else out.unionByName(one)
    return out


def _emissions(ctx: Context) -> DataFrame:
    return B.emissions(readers.read_csv_named(ctx.spark, ctx.raw["seqe_emissions_verifiees"], EMISSIONS_SCHEMA, sep=","))


def _air_feed(ctx: Context) -> DataFrame:
    raw = readers.read_csv_named(ctx.spark, ctx.raw["lcsqa_temps_reel"], AIR_FEED_SCHEMA)
    start = F.col("`Date de début`")
    read = F.coalesce(start.try_cast("timestamp_ntz"), F.to_timestamp_ntz(start, F.lit("yyyy/MM/dd HH:mm:ss")))
    return B.air_feed(raw.withColumn("Date de début", read))


def _air_series(ctx: Context) -> DataFrame:
    raw = readers.read_parquet_union(ctx.spark, _paths(ctx, AIR))
    return B.air_series(raw, stations(ctx.spark), pollutants(ctx.spark))


def _mda8(ctx: Context) -> DataFrame:
    return B.mda8(ctx.staged("air_serie").filter(F.col("polluant") == "O3"))


def _weather(ctx: Context) -> DataFrame:
    return B.weather(readers.read_csv_union_by_name(ctx.spark, _paths(ctx, WEATHER), columns=B.WEATHER_COLUMNS))


def _air_weather(ctx: Context) -> DataFrame:
    return B.air_weather(ctx.staged("air_o3_mda8"), ctx.staged("meteo_corse"), pairing(ctx.spark))


OUTPUTS = (
    Output("dvf_corse_2024", _sales, SALES),
    Output("edf_mix_corse", _mix, ("edf_mix_temps_reel",)),
    Output("edf_courbe_corse", _curve, ("edf_courbe_charge_horaire",), after=lambda t, c: B.check_load_curve(t)),
    Output("edf_ecretement_corse", _curtailment, ("edf_ecretement_corse",), after=lambda t, c: B.check_curtailment(t)),
    Output("entsoe_sardaigne", _generation, (*GENERATION, *LOAD)),
    Output(
        "entsoe_sarco", _flows, tuple(FLOWS.values()), order=("annee", "sens", "date_heure_utc"),
        after=lambda t, c: B.check_flows(t),
    ),
    Output(
        "seqe_corse", _emissions, ("seqe_emissions_verifiees",), order=("annee", "eutl_id"),
        after=lambda t, c: B.check_emissions(t),
    ),
    Output(
        "air_corse", _air_feed, ("lcsqa_temps_reel",), order=("debut", "station", "polluant"),
        after=lambda t, c: B.check_air_feed(t),
    ),
    Output(
        "air_serie", _air_series, AIR, order=("date_heure_utc", "station", "polluant"),
        after=lambda t, c: B.check_air_series(t, stations(c.spark)),
    ),
    Output("air_o3_mda8", _mda8, AIR, derived_from=("air_serie",), order=("date_locale", "station")),
    Output(
        "meteo_corse", _weather, WEATHER, order=("date_heure_utc", "num_poste"),
        after=lambda t, c: B.check_weather(t),
    ),
    Output(
        "air_temperature_jour", _air_weather, (*AIR, *WEATHER), derived_from=("air_o3_mda8", "meteo_corse"),
        order=("date_locale", "station"), after=lambda t, c: B.check_air_weather(t, c.staged("air_o3_mda8")),
    ),
)


# ---- gates --------------------------------------------------------------------------------------------


def _summers(df: DataFrame, years: tuple[int, int]) -> DataFrame:
    day = F.col("date_locale")
    return df.filter(F.month(day).isin(*V.AIR_SUMMER_MONTHS) & F.year(day).between(*years)).withColumn("year", F.year(day))


def coverage_violations(ctx: Context, years: tuple[int, int] = V.STUDY_YEARS) -> dict[str, DataFrame]:
    """What the air tables lack in the summers of the study; the expectation is a written list."""
    daily = _summers(ctx.staged("air_o3_mda8").filter("valide"), years)
    series = _summers(ctx.staged("air_serie"), years).select(F.col("polluant").alias("pollutant"), "station", "year").distinct()
    crossed = _summers(ctx.staged("air_temperature_jour"), years).select("year").distinct()
    first, last = years
    pairs = [(p, s) for p, stations_ in V.STATIONS_OF_POLLUTANT.items() for s in stations_]
    listed = [(p, s, max(V.FIRST_SUMMER.get(s, first), first), V.LAST_SUMMER.get((p, s), last)) for p, s in pairs]
    expected = ctx.spark.createDataFrame(listed, "pollutant string, station string, first_year int, last_year int")
    window = ctx.spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return {"coverage": coverage.audit_air(daily.select("station", "year"), series, crossed, window, expected)}


GATES = (
    Gate("coverage of the air tables", ("air_serie", "air_o3_mda8", "air_temperature_jour"), coverage_violations),
    claims_gate("july plateau", "edf_courbe_corse", A.july_plateau_claims),
    claims_gate("summer hours", "edf_courbe_corse", A.summer_hourly_claims),
    claims_gate("greenest slot", "edf_courbe_corse", A.greenest_slot_claims),
    claims_gate("hydro against thermal", "edf_courbe_corse", A.hydro_claims),
    claims_gate("summer peaks", "edf_courbe_corse", A.peak_claims),
    claims_gate("rural station", "air_o3_mda8", A.rural_claims),
    claims_gate("scope of the season", "air_o3_mda8", A.season_scope_claims),
    claims_gate("ozone by temperature", "air_temperature_jour", A.temperature_claims),
)


def contracts(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The contract of every file of the manifest whose source has one."""
    rows = [(s, fmt, delimiter, list(columns), root) for s, (fmt, delimiter, columns, root) in V.SOURCE_CONTRACTS.items()]
    known = spark.createDataFrame(rows, "source_id string, format string, delimiter string, columns array<string>, root string")
    named = manifest.select("source_id", F.col("filename").alias("file")).join(known, "source_id")
    typed = named.withColumn("content_type", F.lit(None).cast("string"))
    return typed.select(*[c.split()[0] for c in CONTRACT.split(", ")])


def publish(
    spark: SparkSession, root: str, run_id: str, raw: Mapping[str, str], manifest: DataFrame, gates: Sequence[Gate] = GATES, **more
) -> str:
    """Certify and judge the raw files, build every table that has its sources, pass the gates, publish."""
    return run_build(spark, root, run_id, plan(OUTPUTS, raw), raw, manifest, contracts=contracts(spark, manifest), gates=gates, **more)
