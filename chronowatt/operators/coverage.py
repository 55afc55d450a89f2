"""Coverage audit: what should be there is compared with a written list, not with what is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Station floors per pollutant and valid days a summer must hold.
STATION_FLOORS = {"O3": 5, "NO2": 4}
MIN_DAYS_PER_SUMMER = 60


def _anomaly(df: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def empty_years(observed: DataFrame, years: DataFrame, year: str) -> DataFrame:
    gone = years.select(year).distinct().join(observed.select(year).distinct(), year, "left_anti")
    return _anomaly(gone, "empty_year", F.col(year), F.lit("0"))


def station_floor(observed: DataFrame, years: DataFrame, year: str, station: str, floor: int, check: str = "station_floor") -> DataFrame:
    counts = observed.groupBy(year).agg(F.count_distinct(station).alias("__n"))
    low = (
        years.select(year).distinct().join(counts, year, "left")
        .withColumn("__n", F.coalesce("__n", F.lit(0)))
        .filter(F.col("__n") < floor)
    )
    return _anomaly(low, check, F.col(year), F.col("__n"))


def days_floor(observed: DataFrame, year: str, station: str, floor: int) -> DataFrame:
    low = observed.groupBy(year, station).agg(F.count("*").alias("__n")).filter(F.col("__n") < floor)
    return _anomaly(low, "days_floor", F.concat_ws("/", F.col(year).cast("string"), F.col(station)), F.col("__n"))


def continuity(
    observed: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    year: str,
    first_expected: str,
    last_expected: str,
) -> DataFrame:
    """Interruptions, late starts, early stops, series that are nowhere and series nobody expected.

    ``expected`` lists each series with the first and last step it must cover (a declared closure
    moves the last). Observed series outside that list are audited too, from their own first step to
    their last. One row per anomaly: check, key, detail.
    """
    seen = observed.groupBy(*keys).agg(
        F.min(year).alias("__first"), F.max(year).alias("__last"), F.count_distinct(year).alias("__n")
    )
    d = expected.withColumn("__listed", F.lit(True)).join(seen, list(keys), "full")
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    found = F.array_compact(
        F.array(
            F.when(F.col("__n").isNull(), F.struct(F.lit("absent").alias("check"), F.lit("").alias("detail"))),
            F.when(F.col("__listed").isNull(), F.struct(F.lit("not_expected").alias("check"), F.lit("").alias("detail"))),
            F.when(
                F.col("__last") - F.col("__first") + 1 != F.col("__n"),
                F.struct(
                    F.lit("interrupted").alias("check"),
                    (F.col("__last") - F.col("__first") + 1 - F.col("__n")).cast("string").alias("detail"),
                ),
            ),
            F.when(
                F.col("__first") > F.col(first_expected),
                F.struct(F.lit("late_start").alias("check"), F.col("__first").cast("string").alias("detail")),
            ),
            F.when(
                F.col("__last") < F.col(last_expected),
                F.struct(F.lit("early_stop").alias("check"), F.col("__last").cast("string").alias("detail")),
            ),
        )
    )
    return d.select(key.alias("key"), F.explode(found).alias("__a")).select(
        F.col("__a.check").alias("check"), "key", F.col("__a.detail").alias("detail")
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out, *rest = frames
    for f in rest:
        out = out.unionByName(f)
    return out


def audit_air(
    daily_max: DataFrame,
    series: DataFrame,
    crossed: DataFrame,
    years: DataFrame,
    expected: DataFrame,
    floors: dict[str, int] = STATION_FLOORS,
    min_days: int = MIN_DAYS_PER_SUMMER,
) -> DataFrame:
    """The six checks of the air tables over a window of summers.

    daily_max(station, year, one row per valid day), series(pollutant, station, year),
    crossed(year), years(year), expected(pollutant, station, first_year, last_year).
    """
    per_pollutant = [
        station_floor(series.filter(F.col("pollutant") == p), years, "year", "station", floor, f"floor_{p}")
        for p, floor in floors.items()
    ]
    whole = continuity(series, expected, ["pollutant", "station"], "year", "first_year", "last_year")
    ozone = expected.filter(F.col("pollutant") == "O3").drop("pollutant")
    daily = continuity(daily_max, ozone, ["station"], "year", "first_year", "last_year")
    daily = daily.select(F.concat(F.lit("daily_"), "check").alias("check"), "key", "detail")
    crossing = empty_years(crossed, years, "year").withColumn("check", F.lit("crossing_empty_year"))
    return union_all(
        [
            empty_years(daily_max, years, "year"),
            station_floor(daily_max, years, "year", "station", floors["O3"]),
            days_floor(daily_max, "year", "station", min_days),
            *per_pollutant,
            whole,
            daily,
            crossing,
        ]
    )


def attribute_conflicts(declared: DataFrame, observed: DataFrame, key: str, attribute: str) -> DataFrame:
    """Declared attribute against the latest observed one. Absence is not divergence: a key seen on
    one side only is reported as such."""
    d = declared.select(key, F.col(attribute).alias("declared"))
    o = observed.select(key, F.col(attribute).alias("observed"))
    return (
        d.join(o, key, "full")
        .withColumn(
            "status",
            F.when(F.col("observed").isNull(), "not_observed")
            .when(F.col("declared").isNull(), "not_declared")
            .when(F.col("declared") != F.col("observed"), "conflict")
            .otherwise("same"),
        )
    )


def versions_opened_inside(reference: DataFrame, opened: str, first: Column, last: Column) -> DataFrame:
    """Attribute versions that open inside the study window, hence change under the comparison."""
    return reference.filter((F.col(opened) > first) & (F.col(opened) <= last))
