"""The published analyses, on the prepared tables (see tables.py for their columns).

Each function returns a small frame; the claims that a publication rests on are separate frames of
(name, ok) rows, to be passed to ``check_claims`` before anything is published.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import fixed_values as V
from ..functions import timeaxis as T
from ..functions.numeric import avg_if, clamp0, displayed_percent, half_up, percent, percent_of_sums, ratio, sum_if, total
from ..operators import joins, ordered, profiles, quality, quantiles, season, series, shares

TOTAL = "production_totale_mw"
MICRO = "micro_hydraulique_mw"


# ---- live feed ----------------------------------------------------------------------------------------


def live_share(mix: DataFrame, as_of: str, part: str = "photovoltaique", step_minutes: int = 15) -> DataFrame:
    """Share and energy over the last 24 readings, readings filled, shown percentage, freshness."""
    instant = T.instant_to_utc("date")
    readings = mix.select(
        F.lit("feed").alias("feed"),
        F.floor(T.minute_index(instant) / step_minutes).cast("bigint").alias("step"),
        F.col(part).cast("double").alias("part"),
        F.col("total").cast("double").alias("whole"),
    )
    window = series.live_window(readings, ["feed"], "step", ["part", "whole"])
    summary = series.live_summary(window, ["feed"], "part", "whole", step_minutes)
    latest = mix.agg(
        F.max(instant).alias("last_reading"), F.max_by("statut", "date").alias("status")
    ).select(F.lit("feed").alias("feed"), "last_reading", "status")
    shown = F.coalesce(displayed_percent("part_energy", "total_energy"), half_up("share"))
    age = T.as_of_age_hours("last_reading", as_of)
    return summary.join(latest, "feed").select(
        "share",
        "part_energy",
        "total_energy",
        shown.alias("shown_percent"),
        "n_read",
        "n_filled",
        "n_missing",
        T.utc_to_local("last_reading").alias("last_local"),
        T.plus_minutes(T.utc_to_local("last_reading"), -23 * step_minutes).alias("first_local"),
        "status",
        age.alias("age_hours"),
        T.freshness(age).alias("tier"),
    )


def share_definition_gap(mix: DataFrame) -> DataFrame:
    """Published renewable share against the one recomputed from its parts."""
    parts = total("photovoltaique", "eolien", "bioenergies", "micro_hydro")
    gap = F.col("part_enr_distrib") - percent(parts, "total")
    return mix.agg(F.avg(gap).alias("mean_gap"), F.max(F.abs(gap)).alias("max_gap"))


# ---- demand -------------------------------------------------------------------------------------------


def yearly_share_range(curve: DataFrame, part: str = "photovoltaique_mw") -> DataFrame:
    yearly = shares.shares(curve, ["annee_locale"], {"s": part}, TOTAL)
    return yearly.agg(F.min("s").alias("lowest"), F.max("s").alias("highest"))


def monthly_demand(curve: DataFrame) -> DataFrame:
    """Mean demand by month, as displayed, and the displayed change from the month before."""
    monthly = curve.groupBy("mois_local").agg(F.avg(TOTAL).alias("mean_mw")).withColumn("shown", half_up("mean_mw"))
    before = F.lag("shown").over(Window.orderBy("mois_local"))  # twelve rows
    return monthly.withColumn("step_percent", half_up(ratio(100.0 * (F.col("shown") - before), before)))


def season_demand(curve: DataFrame) -> DataFrame:
    m = F.col("mois_local")
    name = F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")
    june, july = avg_if(m == 6, TOTAL), avg_if(m == 7, TOTAL)
    return curve.groupBy(name.alias("season")).agg(
        F.avg(TOTAL).alias("mean_mw"), ratio(100.0 * (july - june), june).alias("june_to_july_percent")
    )


def demand_change_by_status(curve: DataFrame, from_month: int = 6, to_month: int = 7) -> DataFrame:
    m = F.col("mois_local")
    a, b = avg_if(m == from_month, TOTAL), avg_if(m == to_month, TOTAL)
    return curve.groupBy("statut").agg(ratio(100.0 * (b - a), a).alias("change_percent"))


def july_surplus(curve: DataFrame) -> DataFrame:
    """July less June by hour of day."""
    m = F.col("mois_local")
    return curve.groupBy("heure_locale").agg((avg_if(m == 7, TOTAL) - avg_if(m == 6, TOTAL)).alias("delta"))


def july_plateau(curve: DataFrame, level: float = 0.97) -> DataFrame:
    surplus = july_surplus(curve).withColumn("k", F.lit("july"))
    return profiles.plateau(surplus, ["k"], "heure_locale", "delta", level).drop("k")


def july_plateau_claims(curve: DataFrame) -> DataFrame:
    return quality.claims(
        july_plateau(curve),
        {
            "one_stretch": F.every("contiguous"),
            "afternoon_to_early_evening": F.every((F.col("first_hour") >= 12) & (F.col("last_hour") <= 21)),
        },
    )


# ---- mix by hour --------------------------------------------------------------------------------------


def summer_hourly_shares(curve: DataFrame) -> DataFrame:
    parts = {"solar": "photovoltaique_mw", "thermal": "thermique_mw", "imports": "importations_mw"}
    return shares.shares(curve.filter(F.col("mois_local").isin(*season.AIR_SUMMER)), ["heure_locale"], parts, TOTAL)


def summer_hourly_claims(curve: DataFrame) -> DataFrame:
    return quality.claims(summer_hourly_shares(curve), {"solar_below_thermal": F.every(F.col("solar") < F.col("thermal"))})


def hourly_stack(curve: DataFrame) -> DataFrame:
    parts = {
        "distributed": "enr_distrib_mw", "hydro": "hydraulique_mw", "thermal": "thermique_mw", "imports": "importations_mw",
    }
    stack = shares.shares(curve, ["heure_locale"], parts, TOTAL)
    return stack.select("heure_locale", *[clamp0(c).alias(c) for c in parts])


def greenest_slot(curve: DataFrame) -> DataFrame:
    """The slot between the best hours of both definitions (with and without large hydro)."""
    hours = curve.groupBy("heure_locale").agg(
        F.sum("enr_distrib_mw").alias("narrow"), F.sum(total("enr_distrib_mw", "hydraulique_mw")).alias("wide"), F.sum(TOTAL).alias("all")
    )
    everything = Window.partitionBy()  # 24 rows
    best = lambda c: F.max_by(
        "heure_locale", F.struct(clamp0(percent(c, "all")), -F.col("heure_locale"))
    ).over(everything)
    d = hours.select("*", best("narrow").alias("h1"), best("wide").alias("h2"))
    inside = F.col("heure_locale").between(F.least("h1", "h2"), F.greatest("h1", "h2"))
    return d.filter(inside).groupBy("h1", "h2").agg(
        percent_of_sums("narrow", "all").alias("narrow_share"), percent_of_sums("wide", "all").alias("wide_share")
    )


def greenest_slot_claims(curve: DataFrame) -> DataFrame:
    lo, hi = F.least("h1", "h2"), F.greatest("h1", "h2")
    return quality.claims(
        greenest_slot(curve),
        {"one_hour_apart": F.every(hi - lo <= 1), "around_noon": F.every((lo >= 11) & (hi <= 14))},
    )


def hours_renewable_over_thermal(curve: DataFrame, with_hydro: bool = True) -> DataFrame:
    renewable = total("enr_distrib_mw", "hydraulique_mw") if with_hydro else F.col("enr_distrib_mw")
    s = shares.shares(curve, ["heure_locale"], {"renewable": renewable, "thermal": "thermique_mw"}, TOTAL)
    return s.filter(F.col("renewable") > F.col("thermal"))


def slot_shares(curve: DataFrame, slots: dict[str, Sequence[int]], months: Sequence[int] = season.AIR_SUMMER) -> DataFrame:
    """Solar, thermal and imported share of named hour slots."""
    labels = F.array_compact(F.array(*[F.when(F.col("heure_locale").isin(*hs), F.lit(n)) for n, hs in slots.items()]))
    parts = {"solar": "photovoltaique_mw", "thermal": "thermique_mw", "imports": "importations_mw"}
    rows = curve.filter(F.col("mois_local").isin(*months)).select("*", F.explode(labels).alias("slot"))
    return shares.shares(rows, ["slot"], parts, TOTAL)


# ---- curtailment --------------------------------------------------------------------------------------


def curtailment_grid(curtailed: DataFrame) -> DataFrame:
    """Year by month, and the number of months at or above the level."""
    wide = curtailed.groupBy("annee").pivot("mois_cal", list(range(1, 13))).agg(F.sum("duree_h"))
    return wide.select("annee", *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)])


def curtailment_season(curtailed: DataFrame, first: int = 3, last: int = 6) -> DataFrame:
    inside = F.col("mois_cal").between(first, last)
    return curtailed.agg(
        ratio(100.0 * sum_if(inside, "duree_h"), F.sum("duree_h")).alias("season_percent"),
        F.max("duree_h").alias("longest_month"),
        F.max_by(F.struct("annee", "mois_cal"), F.struct("duree_h", "annee", "mois_cal")).alias("record"),
    )


# ---- two islands --------------------------------------------------------------------------------------


def _local_parts(curve: DataFrame) -> DataFrame:
    """The island's own generation: imports left out, micro-hydro with hydro."""
    return curve.select(
        F.col("annee_locale").alias("annee"),
        F.col("thermique_mw").alias("thermique"),
        (F.col("hydraulique_mw") + F.coalesce(F.col(MICRO), F.lit(0.0))).alias("hydraulique"),
        F.col("photovoltaique_mw").alias("solaire"),
        F.col("eolien_mw").alias("eolien"),
        F.col("bioenergies_mw").alias("bioenergies"),
        F.lit(0.0).alias("autre"),
    )


def _other_parts(generation: DataFrame) -> DataFrame:
    return generation.select("annee", *[F.col(f"{f}_mw").alias(f) for f in V.PRIMARY_FUELS])


def island_mix(curve: DataFrame, generation: DataFrame, years: tuple[int, int], by_year: bool = False) -> DataFrame:
    """Mix of both islands over their own generation; NULL on a side a year lacks (see the claims)."""
    both = _local_parts(curve).withColumn("island", F.lit("A")).unionByName(
        _other_parts(generation).withColumn("island", F.lit("B"))
    ).filter(F.col("annee").between(*years))
    whole = total(*V.PRIMARY_FUELS)
    keys = ["island", "annee"] if by_year else ["island"]
    mixed = both.groupBy(*keys).agg(
        *[percent_of_sums(f, whole).alias(f) for f in V.PRIMARY_FUELS],
        F.min("annee").alias("first_year"),
        F.max("annee").alias("last_year"),
    )
    return mixed.drop("first_year", "last_year") if by_year else mixed


def unmatched_years(curve: DataFrame, generation: DataFrame, years: tuple[int, int]) -> DataFrame:
    both = curve.select(F.col("annee_locale").alias("annee"), F.lit("A").alias("island")).unionByName(
        generation.select("annee", F.lit("B").alias("island"))
    ).filter(F.col("annee").between(*years))
    return quality.misaligned(both, "annee", F.col("island") == "A", F.col("island") == "B")


def _intermittent(solar: str, wind: str) -> Column:
    return clamp0(solar) + clamp0(wind)


def hours_above_threshold(
    curve: DataFrame, generation: DataFrame, years: tuple[int, int], level: float = shares.THRESHOLD_IN_FORCE
) -> DataFrame:
    """Percentage of the year's hours above the level: island A, then island B over its generation
    and over its load, which bound the answer there."""
    a = curve.filter(F.col("annee_locale").between(*years)).withColumnRenamed("annee_locale", "annee")
    b = generation.filter(F.col("annee").between(*years))
    own = {"a": percent(_intermittent("photovoltaique_mw", "eolien_mw"), TOTAL)}
    part = _intermittent("solaire_mw", "eolien_mw")
    other = {"b_generation": percent(part, TOTAL), "b_load": percent(part, "charge_mw")}
    return shares.frequency_above(a, ["annee"], own, level).join(
        shares.frequency_above(b, ["annee"], other, level), "annee", "full"
    )


def threshold_claims(frequencies: DataFrame) -> DataFrame:
    return quality.claims(
        frequencies,
        {
            "same_years": F.every(F.col("a").isNotNull() & F.col("b_generation").isNotNull()),
            "lower_bound_stays_above": F.every(F.col("b_generation") > F.col("a")),
        },
    )


def hours_per_year_above(curve: DataFrame, levels: Sequence[float] = (shares.THRESHOLD_IN_FORCE, shares.THRESHOLD_AIMED_AT)) -> DataFrame:
    share = percent(_intermittent("photovoltaique_mw", "eolien_mw"), TOTAL)
    return shares.hours_above(curve, ["annee_locale"], share, {f"above_{int(x)}": x for x in levels})


def dependence(curve: DataFrame) -> DataFrame:
    """Imported share of electricity next to the published primary-energy balance."""
    others = F.coalesce(F.col(MICRO), F.lit(0.0)) + F.col("eolien_mw") + F.col("bioenergies_mw")
    parts = {
        "petrole": F.col("thermique_mw"), "liaisons": F.col("importations_mw"), "grande_hydro": F.col("hydraulique_mw"),
        "autres_enr": others, "solaire": F.col("photovoltaique_mw"),
    }
    electricity = curve.agg(*[percent_of_sums(p, TOTAL).alias(n) for n, p in parts.items()])
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("part"), F.col(n).alias("electricity"), F.lit(V.PRIMARY_BALANCE_2020[n]).alias("primary"))
            for n in parts
        ]
    )
    imported = F.col("part").isin("petrole", "liaisons")
    return electricity.select(F.inline(rows)).withColumn("imported", imported)


def hydro_against_thermal(curve: DataFrame) -> DataFrame:
    yearly = shares.shares(curve, ["annee_locale"], {"hydro": "hydraulique_mw", "thermal": "thermique_mw"}, TOTAL)
    return yearly.agg(
        F.corr("hydro", "thermal").alias("correlation"),
        F.min_by("annee_locale", F.struct("hydro", "annee_locale")).alias("driest_year"),
        F.max_by("annee_locale", F.struct(F.col("thermal"), -F.col("annee_locale"))).alias("most_thermal_year"),
    )


def hydro_claims(curve: DataFrame) -> DataFrame:
    return quality.claims(hydro_against_thermal(curve), {"opposed": F.every(F.col("correlation") <= -0.8)})


# ---- seasonal peaks -----------------------------------------------------------------------------------


def _summer(curve: DataFrame) -> DataFrame:
    return curve.filter(F.col("mois_local").isin(*season.LOAD_SUMMER))


def summer_peaks(curve: DataFrame, level: float = 380.0) -> DataFrame:
    """Hours, maximum, mean of the twenty highest, median, hours at the level, by summer."""
    return season.season_peaks(_summer(curve), "annee_locale", TOTAL, "date_heure_utc", 20, level)


def summer_quantiles(curve: DataFrame) -> DataFrame:
    return quantiles.exact_quantiles(
        _summer(curve), ["annee_locale"], TOTAL, {"median": 0.5, "q75": 0.75, "q90": 0.9, "q99": 0.99, "maximum": 1.0}
    )


def quantile_gains(curve: DataFrame) -> DataFrame:
    return season.first_last_gain(summer_quantiles(curve), "annee_locale", ["median", "q75", "q90", "q99", "maximum"])


def winter_peaks(curve: DataFrame) -> DataFrame:
    return season.winters(curve, "annee_locale", "mois_local", TOTAL, season.COMPLETE_WINTER_HOURS, "date_heure_utc")


def summer_less_winter(curve: DataFrame) -> DataFrame:
    return season.summer_less_previous_winter(
        curve, "annee_locale", "mois_local", TOTAL, season.COMPLETE_WINTER_HOURS
    ).withColumnRenamed("annee_locale", "annee")


def micro_hydro_perimeter(curve: DataFrame) -> DataFrame:
    """Hours without a micro-hydro value, its mean, and its largest weight in the twenty summer hours
    of highest demand."""
    summer = F.col("mois_local").isin(*season.LOAD_SUMMER)
    top = season.top_k(curve.filter(summer), ["annee_locale"], TOTAL, 20, ["date_heure_utc"])
    at_peak = top.groupBy("annee_locale").agg(F.max(F.abs(MICRO)).alias("largest_at_peak"))
    return curve.groupBy("annee_locale").agg(
        F.count_if(F.col(MICRO).isNull()).alias("n_missing"), F.avg(MICRO).alias("mean")
    ).join(at_peak, "annee_locale", "left")


def peak_claims(curve: DataFrame) -> DataFrame:
    gains = season.first_last_gain(summer_peaks(curve), "annee_locale", ["maximum", "median"])
    rising = season.strictly_increasing(summer_peaks(curve), "annee_locale", "maximum")
    small = F.abs(F.col("gain_median")) <= 5
    # both frames hold one row: brought together on a constant
    one = gains.withColumn("k", F.lit(1)).join(rising.withColumn("k", F.lit(1)), "k")
    return quality.claims(
        one,
        {
            "rises_every_year": F.every("increasing"),
            "median_barely_moves": F.every(small),
            "peak_gain_tenfold": F.every(F.col("gain_maximum") >= 10 * F.abs(F.col("gain_median"))),
        },
    )


# ---- external checks ----------------------------------------------------------------------------------


def emission_intensity(emissions: DataFrame, curve: DataFrame) -> DataFrame:
    """Verified tonnes per GWh of thermal generation, with the year's data status."""
    tonnes = emissions.groupBy("annee").agg(F.sum("tco2").alias("tco2"))
    energy = curve.groupBy(F.col("annee_locale").alias("annee")).agg(
        (F.sum("thermique_mw") / 1000).alias("gwh"), F.min("statut").alias("statut")
    )
    return tonnes.join(energy, "annee").select("annee", ratio("tco2", "gwh").alias("intensity"), "statut")


def intensity_shift(intensity: DataFrame, validated: str, estimated: str) -> DataFrame:
    """Change of the mean ratio from validated to estimated years, in %."""
    v, e = avg_if(F.col("statut") == validated, "intensity"), avg_if(F.col("statut") == estimated, "intensity")
    return intensity.agg(ratio(100.0 * (e - v), v).alias("shift_percent"))


def net_against_published(flows: DataFrame, published: dict[int, float] = V.PUBLISHED_NET_GWH, inward: str = "entrant") -> DataFrame:
    """Net energy by year against the published value, on declared points and with carry-forward."""
    signed = series.energy(F.when(F.col("sens") == inward, F.col("mw")).otherwise(-F.col("mw")), "minutes") / 1000.0
    known = F.create_map(*[F.lit(x) for pair in published.items() for x in (int(pair[0]), float(pair[1]))])
    net = flows.groupBy("annee").agg(
        F.sum(F.when(F.col("declare"), signed)).alias("declared_gwh"), F.sum(signed).alias("carried_gwh")
    )
    target = F.try_element_at(known, F.col("annee").cast("int"))
    return net.withColumn("published_gwh", target).withColumn(
        "gap_percent", ratio(100.0 * (F.col("declared_gwh") - target), target)
    )


def net_export_around_threshold(
    flows: DataFrame, generation: DataFrame, level: float = shares.THRESHOLD_IN_FORCE, outward: str = "sortant"
) -> DataFrame:
    """Mean net export and share of exporting hours, during and outside the hours above the level."""
    hourly = series.resample_hourly(flows, ["sens"], "date_heure_utc", "mw")
    signed = F.when(F.col("sens") == outward, F.col("mw")).otherwise(-F.col("mw"))
    net = hourly.groupBy(F.col("hour_ts").alias("date_heure")).agg(F.sum(signed).alias("net"))
    share = percent(_intermittent("solaire_mw", "eolien_mw"), TOTAL)
    above = generation.select("date_heure", F.when(share > level, "above").otherwise("below").alias("threshold"))
    exporting = F.when(F.col("net") > 0, 1.0).otherwise(0.0)
    return net.join(above, "date_heure").groupBy("threshold").agg(
        F.count("*").alias("n_hours"), F.avg("net").alias("mean_net"), (100.0 * F.avg(exporting)).alias("exporting_percent")
    )


def episodes_above(generation: DataFrame, level: float = shares.THRESHOLD_IN_FORCE) -> DataFrame:
    """Lengths of the runs of hours above the level, by year: count, upper median, longest."""
    share = percent(_intermittent("solaire_mw", "eolien_mw"), TOTAL)
    d = generation.select("annee", T.hour_index("date_heure").alias("h"), F.coalesce(share > level, F.lit(False)).alias("high"))
    same = F.col("prev.high") == F.col("high")
    runs = ordered.run_sizes(d, ["annee"], ["h"], F.floor(F.col("h") / 720), same, ["high"], {"high": F.col("high")})
    sizes = runs.filter("high").select("annee", F.col("size").alias("n"), F.col("n").alias("k"))
    up_to = Window.partitionBy("annee").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    d = sizes.select("annee", "n", "k", F.sum("k").over(up_to).alias("upto"), F.sum("k").over(Window.partitionBy("annee")).alias("all"))
    place = F.floor(F.col("all") / 2) + 1
    middle = (F.col("upto") - F.col("k") < place) & (place <= F.col("upto"))
    return d.groupBy("annee").agg(
        F.max("all").alias("n_episodes"), F.max(F.when(middle, F.col("n"))).alias("upper_median"), F.max("n").alias("longest")
    )


def code_shares(hours: DataFrame, left_out: str = "B10") -> DataFrame:
    """Energy by source code and its share of the total without storage, by year."""
    by_code = hours.groupBy(F.year("date_heure").alias("annee"), "code").agg(F.sum("mw").alias("mwh"))
    counted = F.col("code") != left_out
    whole = F.sum(F.when(counted, F.col("mwh"))).over(Window.partitionBy("annee"))  # a few codes per year
    return by_code.withColumn("share", F.when(counted, percent("mwh", whole)))


def balance_gap(by_category: DataFrame, published: DataFrame, keys: Sequence[str], value: str = "gwh") -> DataFrame:
    """Category totals against an external balance, in %."""
    known = published.select(*keys, F.col(value).alias("published"))
    return by_category.join(known, list(keys)).withColumn(
        "gap_percent", ratio(100.0 * (F.col(value) - F.col("published")), "published")
    )


def storage_efficiency(returned: DataFrame, pumped: DataFrame, value: str = "mw") -> DataFrame:
    """Energy given back over energy taken in, all years together."""
    both = returned.select(F.lit("out").alias("way"), value).unionByName(pumped.select(F.lit("in").alias("way"), value))
    return both.agg(ratio(sum_if(F.col("way") == "out", value), sum_if(F.col("way") == "in", value)).alias("efficiency"))


def carried_share(flows: DataFrame) -> DataFrame:
    """Share of the energy that rests on carried-forward points, and the longest constant block."""
    step = T.minute_index("date_heure_utc")
    d = flows.withColumn("t", step)
    e = series.energy("mw", "minutes")
    same = (F.col("prev.mw") == F.col("mw")) & (F.col("prev.t") + F.col("prev.minutes") == F.col("t"))
    sizes = ordered.run_sizes(
        d,
        ["annee", "sens"],
        ["t"],
        F.floor(F.col("t") / 43_200),
        same,
        ["mw", "t", "minutes"],
        {"flows": F.col("mw") != 0},
        size=F.col("minutes"),
        sums={"energy": e, "carried": F.when(~F.col("declare"), e)},
    )
    return sizes.groupBy("annee", "sens").agg(
        percent(F.sum("carried"), F.sum("energy")).alias("carried_percent"),
        (F.max(F.when(F.col("flows"), F.col("size"))) / 60.0).alias("longest_hours"),
    )


def instrument_mean(raw: DataFrame, value: str = "GLO", code: str = "QGLO", kept: Sequence[str] = ("1", "9")) -> DataFrame:
    """Hourly mean of an instrument over its stations, good quality codes only (all-text input)."""
    good = raw.filter(F.col(value).isNotNull() & F.col(code).isin(*kept))
    hour = T.hour_index(F.to_timestamp_ntz("AAAAMMJJHH", F.lit("yyyyMMddHH")))
    return good.groupBy(hour.alias("hour")).agg(F.avg(F.col(value).cast("double")).alias("value"))


def lag_to_instrument(curve: DataFrame, instrument: DataFrame, value: str = "photovoltaique_mw", by_regime: bool = True) -> DataFrame:
    """Best lag of a production series to an instrument, per clock regime (summer or winter time)."""
    a = curve.select(T.hour_index("date_heure_utc").alias("hour"), F.col(value).alias("a"))
    regime = F.when(T.is_summer_time(T.from_hour_index("hour")), "summer").otherwise("winter") if by_regime else F.lit("all")
    b = instrument.select("hour", regime.alias("regime"), F.col("value").alias("b"))
    c = profiles.lag_correlations(a, b, "hour", "a", "b", groups=["regime"])
    return profiles.lag_optimum(c, ["regime"])


def lag_around_changes(curve: DataFrame, instrument: DataFrame, value: str = "photovoltaique_mw", days: int = 21) -> DataFrame:
    """Best lag in the weeks before and after each clock change, and the jump between them."""
    hour, year = F.col("hour"), F.year(T.from_hour_index("hour"))
    change = lambda m: T.hour_index(T.plus_hours(T.midnight(T.last_sunday(year, m)), 1))

    def side(m: int, name: str) -> Column:
        at = change(m)
        return F.when((hour >= at - 24 * days) & (hour < at), F.struct(F.lit(name).alias("change"), year.alias("annee"), F.lit("before").alias("side"))).when(
            (hour >= at) & (hour < at + 24 * days), F.struct(F.lit(name).alias("change"), year.alias("annee"), F.lit("after").alias("side"))
        )

    tagged = instrument.withColumn("tag", F.coalesce(side(3, "spring"), side(10, "autumn"))).filter(F.col("tag").isNotNull())
    b = tagged.select("hour", "tag.change", "tag.annee", "tag.side", F.col("value").alias("b"))
    a = curve.select(T.hour_index("date_heure_utc").alias("hour"), F.col(value).alias("a"))
    groups = ["change", "annee", "side"]
    best = profiles.lag_optimum(profiles.lag_correlations(a, b, "hour", "a", "b", groups=groups), groups)
    at = lambda s: F.max(F.when(F.col("side") == s, F.col("refined_lag")))
    return best.groupBy("change", "annee").agg(at("before").alias("before"), at("after").alias("after")).withColumn(
        "jump", F.col("after") - F.col("before")
    )


# ---- property sales -----------------------------------------------------------------------------------


def sales_by_area(sales: DataFrame, area: str = "nom_commune", price: str = "valeur_fonciere", top: int = 20) -> DataFrame:
    """Sales and median price of the areas with most sales (the report's own top list)."""
    rows = sales.select(F.col(area).alias("area"), F.col(price).cast("double").alias("price"))
    most = rows.groupBy("area").agg(F.count("*").alias("n_sales")).orderBy(F.desc("n_sales"), "area").limit(top)
    # ``top`` rows: only their sales are ordered. An area without a name is one of them, by null-safe comparison.
    few = rows.join(F.broadcast(most.select(F.col("area").alias("__area"))), F.col("area").eqNullSafe(F.col("__area")), "left_semi")
    q = quantiles.exact_quantiles(few, ["area"], "price", {"median_price": 0.5}).drop("n")
    return most.join(q, "area", "left").orderBy(F.desc("n_sales"), "area")


# ---- air ----------------------------------------------------------------------------------------------


def _in_study(df: DataFrame, years: tuple[int, int] = V.STUDY_YEARS) -> DataFrame:
    day = F.col("date_locale")
    return df.filter(F.month(day).isin(*season.AIR_SUMMER) & F.year(day).between(*years))


def background_days(daily_ozone: DataFrame, without: Sequence[str] = (), years: tuple[int, int] = V.STUDY_YEARS) -> DataFrame:
    """Valid summer days of background stations within the study window."""
    kept = _in_study(daily_ozone, years).filter(F.col("valide") & (F.col("influence") == "Fond"))
    return kept.filter(~F.col("station").isin(*without)) if without else kept


def station_exceedance(daily_ozone: DataFrame, level: float = V.QUALITY_OBJECTIVE) -> DataFrame:
    days = background_days(daily_ozone).withColumn("annee", F.year("date_locale"))
    return shares.exceedance(days, ["station", "implantation"], "mda8", level, "annee")


def rural_rank(daily_ozone: DataFrame, rural_prefix: str = "Rurale") -> DataFrame:
    """Rank of the rural station, the stations it is ahead of, and how many rural stations there are."""
    rates = station_exceedance(daily_ozone)
    rural = F.col("implantation").like(f"{rural_prefix}%")
    # one row per station by now
    own = F.max(F.when(rural, F.col("rate"))).over(Window.partitionBy())
    return rates.withColumn("rural", rural).withColumn("own", own).agg(
        F.count_if("rural").alias("n_rural"),
        F.max("own").alias("rate"),
        (F.count_if(F.col("rate") > F.col("own")) + 1).alias("rank"),
        F.count_if(~F.col("rural") & (F.col("rate") < F.col("own"))).alias("n_ahead_of"),
        F.count_if(~F.col("rural")).alias("n_others"),
    )


def rural_claims(daily_ozone: DataFrame) -> DataFrame:
    return quality.claims(
        rural_rank(daily_ozone),
        {
            "one_rural_station": F.every(F.col("n_rural") == 1),
            "ahead_of_most": F.every(2 * F.col("n_ahead_of") > F.col("n_others")),
            "second": F.every(F.col("rank") == 2),
        },
    )


def rural_against_others(air_weather: DataFrame, station: str = "VENACO", level: float = V.QUALITY_OBJECTIVE) -> DataFrame:
    days = _in_study(air_weather).filter(F.col("influence") == "Fond")
    cls = F.when(F.col("station") == station, "rural").otherwise("others")
    return days.groupBy(cls.alias("class")).agg(
        F.avg("mda8").alias("mean"), ratio(100.0 * F.count_if(F.col("mda8") > level), F.count("*")).alias("rate")
    )


def latest_season(daily_ozone: DataFrame, after: int = V.STUDY_YEARS[1], level: float = V.QUALITY_OBJECTIVE) -> DataFrame:
    """The latest measured summer outside the window: calendar days above, measured, and in all.

    No row when nothing was measured after the window.
    """
    day = F.col("date_locale")
    later = daily_ozone.filter(
        F.col("valide") & (F.col("influence") == "Fond") & F.month(day).isin(*season.AIR_SUMMER) & (F.year(day) > after)
    )
    yearly = later.groupBy(F.year(day).alias("annee")).agg(
        F.count_distinct(F.when(F.col("mda8") > level, day)).alias("days_above"),
        F.count_distinct(day).alias("days_measured"),
        F.max(day).alias("last_day"),
    )
    first, last = (F.make_date("annee", F.lit(a), F.lit(b)) for a, b in ((6, 1), (8, 31)))
    return yearly.orderBy(F.desc("annee")).limit(1).withColumn("days_in_calendar", F.datediff(last, first) + 1)


def exceedance_counts(daily_ozone: DataFrame, without: Sequence[str] = ("AJACCIO CONFINA 2",), level: float = V.QUALITY_OBJECTIVE) -> DataFrame:
    """Distinct calendar days above and measured; station-days above, which are not the same thing."""
    days = background_days(daily_ozone, without)
    above = F.col("mda8") > level
    return days.agg(
        F.count_distinct(F.when(above, F.col("date_locale"))).alias("days_above"),
        F.count_distinct("date_locale").alias("days_measured"),
        F.count_if(above).alias("station_days_above"),
    )


def alert_days(daily_ozone: DataFrame, air_series: DataFrame, without: Sequence[str] = ("AJACCIO CONFINA 2",), level: float = V.INFORMATION_LEVEL) -> DataFrame:
    """Station-days whose hourly maximum reaches the information level."""
    top = air_series.filter(F.col("polluant") == "O3").groupBy("date_locale", "station").agg(F.max("valeur").alias("top"))
    days = background_days(daily_ozone, without).select("date_locale", "station")
    return days.join(top, ["date_locale", "station"]).agg(F.count_if(F.col("top") >= level).alias("n_alerts"))


def season_scope(daily_ozone: DataFrame, recent: str = "AJACCIO CONFINA 2") -> DataFrame:
    """Counts a subtitle quotes; a zero among them means the window is not populated."""
    d = background_days(daily_ozone).withColumn("annee", F.year("date_locale"))
    new = F.col("station") == recent
    return d.agg(
        F.count_distinct(F.when(~new, F.col("station"))).alias("stations_shown"),
        F.count_distinct("station").alias("stations"),
        F.count_distinct(F.when(~new, F.col("annee"))).alias("summers"),
        F.count_distinct(F.when(new, F.col("annee"))).alias("summers_recent"),
        F.min(F.when(new, F.col("annee"))).alias("recent_since"),
    )


def season_scope_claims(daily_ozone: DataFrame, recent: str = "AJACCIO CONFINA 2") -> DataFrame:
    names = ("stations_shown", "stations", "summers", "summers_recent")
    return quality.claims(season_scope(daily_ozone, recent), {n: F.every(F.col(n) > 0) for n in names})


def ozone_by_temperature(air_weather: DataFrame) -> DataFrame:
    """By band of the day's maximum (its lower edge in degrees, NULL below the first edge)."""
    band = shares.bands(F.col("t_max"), [(25, None), (30, 25), (35, 30)], 35)
    days = _in_study(air_weather).filter(F.col("influence") == "Fond")
    return days.groupBy(band.alias("from_celsius")).agg(
        F.min("t_max").alias("coolest"), F.avg("mda8").alias("ozone"), F.count("*").alias("n_days")
    )


def temperature_claims(air_weather: DataFrame) -> DataFrame:
    """The mean must not peak in the hottest band."""
    b = ozone_by_temperature(air_weather)
    return quality.claims(b, {"levels_off": F.max_by("coolest", "ozone") < F.max("coolest")})


def _background_hours(air_series: DataFrame, without: Sequence[str] = ("VENACO",)) -> DataFrame:
    kept = _in_study(air_series).filter(F.col("influence") == "Fond")
    return kept.filter(~F.col("station").isin(*without)) if without else kept


def diurnal_cycles(air_series: DataFrame) -> DataFrame:
    """Mean by local hour of both pollutants, and each as a percentage of its own peak."""
    means = _background_hours(air_series).groupBy("polluant", "heure_locale").agg(F.avg("valeur").alias("v"))
    return profiles.relative_to_peak(means, ["polluant"], "v").drop("top")


def stations_with_both(air_series: DataFrame) -> DataFrame:
    p = F.col("polluant")
    return quality.both_present(_background_hours(air_series), ["station"], p == "O3", p == "NO2").select("station")


def stations_with_one(air_series: DataFrame) -> DataFrame:
    """Stations that would feed one curve and not the other; must be empty."""
    return quality.orphans(_background_hours(air_series).select("station").distinct(), stations_with_both(air_series), ["station"])


def ozone_hours(air_series: DataFrame, level: float = 0.95) -> DataFrame:
    """Plateau, peak and trough of the summer ozone cycle."""
    hours = _background_hours(air_series, ()).filter(F.col("polluant") == "O3")
    cycle = hours.groupBy("polluant", "heure_locale").agg(F.avg("valeur").alias("v"))
    key = ["polluant"]
    return (
        profiles.plateau(cycle, key, "heure_locale", "v", level)
        .join(profiles.peak(cycle, key, "heure_locale", "v"), "polluant")
        .join(profiles.trough(cycle, key, "heure_locale", "v"), "polluant")
    )


def channels(live_air: DataFrame, air_series: DataFrame) -> DataFrame:
    """Largest gap between the daily feed and the long series, by pollutant."""
    key = ["code_site", "polluant", "date_heure_utc"]
    return joins.reconcile(live_air, air_series, key, "valeur", ["polluant"])


# ---- method notes -------------------------------------------------------------------------------------


def curve_profile(curve: DataFrame) -> DataFrame:
    hour = T.hour_index("date_heure_utc")
    return curve.agg(
        F.count("*").alias("n_hours"),
        F.min("annee_locale").alias("first_year"),
        F.max("annee_locale").alias("last_year"),
        F.count_if(F.lower("statut").like("estim%")).alias("n_estimated"),
        F.count_if(F.col(MICRO).isNull()).alias("n_without_micro"),
        (F.max(hour) - F.min(hour) + 1).alias("n_covered"),
    )


def air_profile(air_series: DataFrame) -> DataFrame:
    verified = F.col("verification") == 1
    return air_series.agg(
        F.count("*").alias("n_hours"),
        F.count_distinct("station").alias("n_stations"),
        F.min("date_locale").alias("first_day"),
        F.max("date_locale").alias("last_day"),
        F.count_if(verified).alias("n_verified"),
        F.max(F.when(verified, F.col("date_locale"))).alias("last_verified_day"),
        F.count_distinct(F.when(F.col("influence") == "Fond", F.col("station"))).alias("n_background"),
    )


def duplicated_local_hours(weather: DataFrame) -> DataFrame:
    """Local hours a post has twice: only the autumn clock change may cause them."""
    twice = quality.duplicates(weather, ["num_poste", "date_heure_locale"])
    return twice.withColumn("expected", T.is_ambiguous("date_heure_locale"))
