"""Builders of the prepared tables, and the guards of each.

A builder takes raw frames and returns a lazy frame with a fixed schema; ``check_*`` reads a table
that was already written. Column names are those of the published tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed_values as V
from ..functions import timeaxis as T
from ..functions.numeric import number, percent, total
from ..operators import quality, series
from ..operators.joins import broadcast_if_small
from ..operators.quality import Guard, GuardError, check_empty, check_rows
from ..sources import xml_series


def _local_columns(utc: Column, zone: str = V.ZONE) -> list[Column]:
    local = T.utc_to_local(utc, zone)
    return [
        local.alias("date_heure_locale"),
        local.cast("date").alias("date_locale"),
        F.hour(local).alias("heure_locale"),
    ]


# ---- property sales ---------------------------------------------------------------------------------


def sales(raw: DataFrame) -> DataFrame:
    """All columns of the joined yearly files, sales only."""
    return raw.filter(F.col("nature_mutation") == "Vente")


# ---- quarter-hourly live mix -------------------------------------------------------------------------

LIVE_TOLERANCE_MW = 50


def live_mix(raw: DataFrame) -> DataFrame:
    """Every published column, plus local hour and two shares; rows out of balance are left out."""
    parts = total("filiere_thermique", "filiere_enr_distrib", "hydraulique", "liaisons")
    renewable = total("photovoltaique", "eolien", "bioenergies", "micro_hydro")
    return raw.filter(F.abs(F.col("total") - parts) <= LIVE_TOLERANCE_MW).select(
        "*",
        F.hour(T.utc_to_local(T.instant_to_utc("date"))).alias("heure_locale"),
        F.round(percent("photovoltaique", "total"), 2).alias("part_soleil"),
        F.round(percent(renewable, "total"), 2).alias("part_enr_sym"),
    )


# ---- hourly load curve -------------------------------------------------------------------------------


def _territory_labels(raw: DataFrame, territory: str) -> DataFrame:
    """Rows of the territory with their label read as legal time.

    The published suffix says UTC and is wrong; it is checked, because a corrected one would change
    the meaning of the text read before it.
    """
    label = F.col("date_heure")
    message = F.concat(F.lit("label without the expected suffix: "), F.coalesce(label, F.lit("none")))
    text = F.when(label.like(f"%{V.EXPECTED_SUFFIX}"), F.substring(label, 1, 19)).otherwise(F.raise_error(message))
    local = F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return raw.filter(F.col("territoire") == territory).withColumn("__local", local)


def load_curve(raw: DataFrame, territory: str = V.TERRITORY) -> DataFrame:
    """Hourly load: UTC as key, legal time as label, raw label kept.

    Hours that legal time skips are left out (found by round trip, never by a list of dates), as are
    rows at zero. Only the micro-hydro column may be NULL and is read as zero.
    """
    micro = F.coalesce(F.col("micro_hydraulique_mw"), F.lit(0.0))
    renewable = total("photovoltaique_mw", "eolien_mw", "bioenergies_mw", micro)
    local = F.col("__local")
    real = _territory_labels(raw, territory).filter(~T.is_phantom(local) & (F.col("production_totale_mw") > 0))
    return real.select(
        F.col("date_heure").alias("horodatage_publie"),
        local.alias("date_heure_locale"),
        T.local_to_utc(local).alias("date_heure_utc"),
        "statut",
        F.hour(local).alias("heure_locale"),
        F.month(local).alias("mois_local"),
        F.year(local).alias("annee_locale"),
        "production_totale_mw",
        "thermique_mw",
        "hydraulique_mw",
        "micro_hydraulique_mw",
        "photovoltaique_mw",
        "eolien_mw",
        "bioenergies_mw",
        "importations_mw",
        renewable.alias("enr_distrib_mw"),
        F.round(percent(renewable, "production_totale_mw"), 2).alias("part_enr_distrib"),
    )


def load_curve_losses(raw: DataFrame, territory: str = V.TERRITORY) -> DataFrame:
    """Hours left out by reason: skipped by legal time, or at zero."""
    phantom = T.is_phantom("__local")
    return _territory_labels(raw, territory).agg(
        F.count_if(phantom).alias("phantom_hours"),
        F.count_if(~phantom & (F.col("production_totale_mw") <= 0)).alias("rows_at_zero"),
    )


def check_load_curve(table: DataFrame) -> None:
    check_rows(table, [Guard(f"null_{c}", F.col(c).isNull()) for c in V.ALWAYS_FILLED], "load_curve")
    check_empty(
        {
            "renewables below their solar part": quality.part_above_whole(
                table, ["heure_locale"], "enr_distrib_mw", "photovoltaique_mw"
            ),
            "instant twice": quality.duplicates(table, ["date_heure_utc"]),
        },
        "load_curve",
    )


# ---- curtailment -------------------------------------------------------------------------------------


def curtailment(raw: DataFrame, territory: str = V.TERRITORY) -> DataFrame:
    """Monthly curtailment. Its zeros are true zeros; a missing rate is documented absence."""
    return raw.filter(F.col("territoire") == territory).select(
        "mois",
        "duree_h",
        "taux_pct",
        F.substring("mois", 1, 4).cast("int").alias("annee"),
        F.substring("mois", 6, 2).cast("int").alias("mois_cal"),
    )


def check_curtailment(table: DataFrame) -> None:
    check_rows(table, [Guard(f"null_{c}", F.col(c).isNull()) for c in ("mois", "duree_h")], "curtailment")
    check_empty(
        {
            "year that is not whole": quality.incomplete_years(table, "annee", "mois_cal"),
            "month twice": quality.duplicates(table, ["annee", "mois_cal"]),
        },
        "curtailment",
    )


# ---- generation and load by fuel ---------------------------------------------------------------------


def fuel_hours(generation: DataFrame, load: DataFrame) -> DataFrame:
    """date_heure, code, filiere, mw from the two document sets; an unknown code is an error."""
    hours = xml_series.generation_hours(generation, "inBiddingZone_Domain.mRID").unionByName(
        xml_series.generation_hours(load, "outBiddingZone_Domain.mRID", "charge")
    )
    table = F.create_map(*[F.lit(x) for pair in V.FUEL_OF_CODE.items() for x in pair])
    unknown = F.raise_error(F.concat(F.lit("code without a category: "), F.coalesce(F.col("code"), F.lit("none"))))
    return hours.withColumn("filiere", F.coalesce(F.try_element_at(table, F.col("code")), unknown))


def generation(hours: DataFrame, zone: str = "Europe/Rome") -> DataFrame:
    """One row per UTC hour, one column per fuel (absent = 0), storage carried outside the total."""
    fuels = (*V.PRIMARY_FUELS, *V.CARRIED_FUELS)
    wide = hours.groupBy("date_heure").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("filiere") == f, F.col("mw"))), F.lit(0.0)).alias(f"{f}_mw")
            for f in fuels
        ]
    )
    primary = total(*[f"{f}_mw" for f in V.PRIMARY_FUELS])
    local = T.utc_to_local("date_heure", zone)
    return wide.filter(primary > 0).select(
        "date_heure",
        F.year(local).alias("annee"),
        F.hour(local).alias("heure_locale"),
        *[f"{f}_mw" for f in fuels],
        primary.alias("production_totale_mw"),
    )


# ---- interconnector flows ----------------------------------------------------------------------------


def flows(series_frame: DataFrame, year: Column, direction: Column) -> DataFrame:
    """Point-level flow: annee, sens, date_heure_utc, minutes, mw, declare. No net is stored."""
    return xml_series.flow_points(series_frame, annee=year, sens=direction)


def check_flows(table: DataFrame, years: Sequence[int] = V.FLOW_YEARS, directions: Sequence[str] = V.FLOW_DIRECTIONS) -> None:
    check_rows(table, [Guard("negative_flow", F.col("mw") < 0)], "flows")
    pairs = table.sparkSession.createDataFrame([(y, d) for y in years for d in directions], "annee int, sens string")
    check_empty({"year and direction without any point": quality.missing_expected(pairs, table, ["annee", "sens"])}, "flows")


def net_energy(table: DataFrame, inward: str = "entrant", declared_only: bool = True) -> DataFrame:
    """Net energy by year (GWh), each point weighed by its own duration."""
    rows = table.filter("declare") if declared_only else table
    signed = F.when(F.col("sens") == inward, F.col("mw")).otherwise(-F.col("mw"))
    return rows.groupBy("annee").agg((F.sum(series.energy(signed, "minutes")) / 1000.0).alias("net_gwh"))


# ---- verified emissions ------------------------------------------------------------------------------


def emissions(raw: DataFrame) -> DataFrame:
    first, last = V.EMISSION_YEARS
    return raw.filter(
        (F.col("country_code") == V.EMITTERS_COUNTRY)
        & F.col("eutl_id").isin(*V.EMITTERS)
        & F.col("year").between(first, last)
    ).select(
        F.col("year").alias("annee"),
        "eutl_id",
        F.col("name").alias("installation"),
        number("emissions_tco2e").alias("tco2"),
    )


def check_emissions(table: DataFrame) -> None:
    first, last = V.EMISSION_YEARS
    expected = table.sparkSession.createDataFrame(
        [(y, i) for y in range(first, last + 1) for i in V.EMITTERS], "annee int, eutl_id bigint"
    )
    n = check_rows(table, [Guard("empty_or_zero", F.col("tco2").isNull() | (F.col("tco2") <= 0))], "emissions")
    check_empty({"installation and year missing": quality.missing_expected(expected, table, ["annee", "eutl_id"])}, "emissions")
    if n != expected.count():
        raise GuardError(f"emissions: {n} rows for {expected.count()} installation-years")


# ---- daily air feed ----------------------------------------------------------------------------------


def air_feed(raw: DataFrame, organisation: str = V.AIR_ORGANISATION) -> DataFrame:
    """National feed cut to one organisation and valid rows; the start of the period is in UTC."""
    utc = F.col("`Date de début`")
    renamed = {
        "zone": "Zas",
        "code_site": "code site",
        "station": "nom site",
        "implantation": "type d'implantation",
        "influence": "type d'influence",
        "polluant": "Polluant",
        "valeur": "valeur",
        "unite": "unité de mesure",
        "validite": "validité",
    }
    return raw.filter((F.col("Organisme") == organisation) & (F.col("`validité`") > 0)).select(
        utc.alias("debut"),
        utc.alias("date_heure_utc"),
        *_local_columns(utc),
        *[F.col(f"`{old}`").alias(new) for new, old in renamed.items()],
    )


def check_air_feed(table: DataFrame) -> None:
    check_rows(table, [], "air_feed")
    grid = quality.grid_regularity(table, T.hour_index("debut")).filter(~F.col("regular"))
    check_empty(
        {
            "irregular hour grid": grid,
            "measure twice": quality.duplicates(table, ["code_site", "polluant", "debut"]),
        },
        "air_feed",
    )


# ---- long air series ---------------------------------------------------------------------------------


def air_series(raw: DataFrame, stations: DataFrame, pollutants: DataFrame) -> DataFrame:
    """Hourly series of the known stations and pollutants. The start is in fixed UTC+1.

    stations(code_site, station, implantation, influence), pollutants(code_pol, polluant).
    """
    measures = raw.select(
        F.regexp_extract("Samplingpoint", "SPO-(FR[0-9]+)_", 1).alias("code_site"),
        F.expr("try_cast(regexp_extract(Samplingpoint, '_([0-9]+)$', 1) AS int)").alias("code_pol"),
        T.plus_hours(F.col("Start").cast("timestamp_ntz"), -1).alias("date_heure_utc"),
        F.col("Value").cast("double").alias("valeur"),
        F.col("Validity").cast("int").alias("validite"),
        F.col("Verification").cast("int").alias("verification"),
    ).filter((F.col("validite") > 0) & F.col("valeur").isNotNull())
    named = stations.select("code_site", "station", "implantation", "influence")
    return (
        measures.join(broadcast_if_small(named), "code_site")
        .join(broadcast_if_small(pollutants), "code_pol")
        .select(
            "code_site",
            "station",
            "implantation",
            "influence",
            "polluant",
            "date_heure_utc",
            *_local_columns(F.col("date_heure_utc")),
            "valeur",
            "validite",
            "verification",
        )
    )


def check_air_series(table: DataFrame, stations: DataFrame) -> None:
    check_rows(table, [], "air_series")
    ozone = table.filter(F.col("polluant") == "O3")
    check_empty({"station without ozone": quality.missing_expected(stations.select("code_site"), ozone, ["code_site"])}, "air_series")


# ---- daily maximum of the 8-hour mean ----------------------------------------------------------------

_SITE = ("station", "implantation", "influence")


def rolling_8h(measures: DataFrame) -> DataFrame:
    """8-hour means of one pollutant at every hour of each site's whole local days.

    measures: code_site, station, implantation, influence, date_heure_utc, date_locale, valeur.
    """
    m = measures.withColumn("__h", T.hour_index("date_heure_utc"))
    bounds = series.local_day_bounds(m, ["code_site"], "date_locale", "valeur", V.ZONE, _SITE)
    rolled = series.rolling_hours(m, bounds, ["code_site"], "__h", "valeur", attrs=_SITE)
    utc = T.from_hour_index("hour")
    local = T.utc_to_local(utc)
    return rolled.select(
        "code_site",
        *_SITE,
        utc.alias("date_heure_utc"),
        local.cast("date").alias("date_locale"),
        F.hour(local).alias("heure_locale"),
        F.col("mean").alias("moyenne_8h"),
        F.col("n").alias("n_heures"),
    )


def mda8(measures: DataFrame) -> DataFrame:
    """Daily maximum of the 8-hour mean per site, with the validity kept as a column."""
    m = measures.withColumn("__h", T.hour_index("date_heure_utc"))
    bounds = series.local_day_bounds(m, ["code_site"], "date_locale", "valeur", V.ZONE, _SITE)
    rolled = series.rolling_hours(m, bounds, ["code_site"], "__h", "valeur", attrs=_SITE)
    return series.daily_max_of_rolling(rolled, ["code_site"], V.ZONE, attrs=_SITE).select(
        "code_site",
        *_SITE,
        F.col("day").alias("date_locale"),
        F.col("max_mean").alias("mda8"),
        F.col("hour_of_max").alias("heure_du_max"),
        F.col("n_means").alias("n_moyennes_valides"),
        F.col("valid").alias("valide"),
    )


# ---- weather -----------------------------------------------------------------------------------------

WEATHER_COLUMNS = ("NUM_POSTE", "NOM_USUEL", "LAT", "LON", "ALTI", "AAAAMMJJHH", "T", "QT")


def weather(raw: DataFrame) -> DataFrame:
    """Hourly temperature of good quality, without the first and last local day of the whole feed.

    ``raw`` is all text (see :func:`chronowatt.sources.readers.read_csv_union_by_name`). A quality
    code in neither list is an error.
    """
    code = F.col("QT").cast("int")
    known = code.isin(*V.QUALITY_KEPT, *V.QUALITY_DROPPED)
    unknown = F.raise_error(F.concat(F.lit("unknown quality code: "), F.coalesce(F.col("QT"), F.lit("none"))))
    utc = F.to_timestamp_ntz("AAAAMMJJHH", F.lit("yyyyMMddHH"))
    typed = raw.filter(F.col("T").isNotNull()).select(
        F.col("NUM_POSTE").alias("num_poste"),
        F.col("NOM_USUEL").alias("poste"),
        F.col("LAT").cast("double").alias("lat"),
        F.col("LON").cast("double").alias("lon"),
        F.col("ALTI").cast("int").alias("alti"),
        utc.alias("date_heure_utc"),
        F.col("T").cast("double").alias("temperature_c"),
        F.when(known, code).otherwise(unknown.cast("int")).alias("qt"),
    )
    local = typed.select(
        "num_poste", "poste", "lat", "lon", "alti", "date_heure_utc", *_local_columns(F.col("date_heure_utc")),
        "temperature_c", "qt",
    )
    return quality.trim_edge_days(local, "date_locale").filter(F.col("qt").isin(*V.QUALITY_KEPT))


def check_weather(table: DataFrame) -> None:
    """No day that the whole network lacks hours of, no instant twice at a post. A post that misses hours of a day
    which others have is no reason to stop: see :func:`weather_gaps`."""
    check_rows(table, [], "weather")
    check_empty(
        {
            "hollow day": quality.hollow_days(table, [], "date_locale", "heure_locale"),
            "instant twice": quality.duplicates(table, ["num_poste", "date_heure_utc"]),
        },
        "weather",
    )


def weather_gaps(table: DataFrame) -> DataFrame:
    """For the report: days with too few hours by post, and whether they lie at an edge of the post's series."""
    return quality.hollow_days(table, ["num_poste"], "date_locale", "heure_locale")


# ---- ozone and temperature ---------------------------------------------------------------------------


def daily_temperature(weather_table: DataFrame) -> DataFrame:
    return weather_table.groupBy("num_poste", "date_locale").agg(
        F.min("poste").alias("poste"),
        F.max("temperature_c").alias("t_max"),
        F.min("temperature_c").alias("t_min"),
        F.avg("temperature_c").alias("t_moy"),
        F.count("*").alias("n_heures_temp"),
    )


def air_weather(daily_ozone: DataFrame, weather_table: DataFrame, pairing: DataFrame) -> DataFrame:
    """Valid ozone days next to the temperatures of the paired post."""
    return (
        daily_ozone.filter("valide")
        .join(broadcast_if_small(pairing.select("code_site", "num_poste")), "code_site")
        .join(daily_temperature(weather_table), ["num_poste", "date_locale"])
        .select(
            "code_site",
            *_SITE,
            "date_locale",
            "mda8",
            "heure_du_max",
            "n_moyennes_valides",
            "num_poste",
            "poste",
            *[F.round(c, 1).alias(c) for c in ("t_max", "t_min", "t_moy")],
            "n_heures_temp",
        )
    )


def check_air_weather(table: DataFrame, daily_ozone: DataFrame) -> None:
    check_rows(table, [], "air_weather")
    stations = daily_ozone.filter("valide").select("code_site", "station").distinct()
    check_empty({"station without temperature": quality.orphans(stations, table, ["code_site"])}, "air_weather")


def pairing_problems(pairing: DataFrame, stations: DataFrame, weather_table: DataFrame) -> DataFrame:
    """A pairing must name known stations and posts that have values, and cover every station."""
    posts = weather_table.select("num_poste").distinct()
    label = lambda df, text, key: df.select(F.lit(text).alias("problem"), F.col(key).alias("key"))
    return (
        label(pairing.join(stations, "code_site", "left_anti"), "unknown station", "code_site")
        .unionByName(label(pairing.join(posts, "num_poste", "left_anti"), "post without values", "num_poste"))
        .unionByName(label(stations.select("code_site").join(pairing, "code_site", "left_anti"), "station not paired", "code_site"))
    )


# ---- two-month demand proof --------------------------------------------------------------------------


def demand_proof(extract: DataFrame, years: Sequence[int]) -> DataFrame:
    """June and July means recomputed from the raw lines alone: heures, moyenne_mw, affiche_mw.

    No time conversion is needed: no clock change falls in these months.
    """
    label = F.to_timestamp_ntz(F.substring("date_heure", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    value = F.col("production_totale_mw").cast("double")
    return (
        extract.select(F.month(label).alias("mois"), value.alias("v"))
        .groupBy("mois")
        .agg(F.count("*").alias("heures"), F.avg("v").alias("moyenne_mw"))
        .withColumn("affiche_mw", F.floor(F.col("moyenne_mw") + 0.5))
    )


def check_demand_extract(extract: DataFrame, years: Sequence[int], territory: str = V.TERRITORY) -> None:
    """Suffix, perimeter, whole hours, no hour twice, finite positive values, whole months."""
    label = F.to_timestamp_ntz(F.substring("date_heure", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    d = extract.select(
        "territoire", "date_heure", label.alias("t"), F.col("production_totale_mw").cast("double").alias("v")
    )
    month = F.month("t")
    outside = (F.col("territoire") != territory) | ~F.year("t").isin(*years) | ~month.isin(6, 7)
    check_rows(
        d,
        [
            Guard("suffix", ~F.col("date_heure").like(f"%{V.EXPECTED_SUFFIX}")),
            Guard("outside_perimeter", outside | (F.minute("t") != 0) | (F.second("t") != 0)),
            Guard(
                "not_positive",
                F.col("v").isNull() | F.isnan("v") | (F.col("v") <= 0) | (F.col("v") == float("inf")),
            ),
        ],
        "demand extract",
    )
    months = d.groupBy(F.year("t").alias("y"), month.alias("m")).agg(
        F.count("*").alias("n"), (F.dayofmonth(F.last_day(F.max("t").cast("date"))) * 24).alias("expected")
    )
    wanted = d.sparkSession.createDataFrame([(y, m) for y in years for m in (6, 7)], "y int, m int")
    check_empty(
        {
            "hour twice": quality.duplicates(d, ["t"]),
            "month not whole": months.filter("n <> expected"),
            "month missing": quality.missing_expected(wanted, months, ["y", "m"]),
        },
        "demand extract",
    )


def check_demand_proof(proof: DataFrame, load_curve_table: DataFrame, tolerance: float = 1e-7) -> None:
    """The independent recomputation must give the published table's means."""
    published = load_curve_table.filter(F.col("mois_local").isin(6, 7)).groupBy(F.col("mois_local").alias("mois")).agg(
        F.avg("production_totale_mw").alias("published")
    )
    both = proof.join(published, "mois", "full")
    apart = F.abs(F.col("moyenne_mw") - F.col("published")) > tolerance
    check_empty({"means differ": both.filter(F.coalesce(apart, F.lit(True)))}, "demand proof")
