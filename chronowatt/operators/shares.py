"""Mix shares and threshold frequencies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import percent, percent_of_sums

# Share of intermittent power (%) that allows disconnection, and the level aimed at.
THRESHOLD_IN_FORCE = 35
THRESHOLD_AIMED_AT = 45


def shares(df: DataFrame, keys: Sequence[str], parts: Mapping[str, Column | str], whole: Column | str) -> DataFrame:
    """100 * sum(part) / sum(whole) for each named part."""
    return df.groupBy(*keys).agg(*[percent_of_sums(p, whole).alias(name) for name, p in parts.items()])


def hours_above(df: DataFrame, keys: Sequence[str], share: Column, levels: Mapping[str, float]) -> DataFrame:
    """Count of rows strictly above each level."""
    return df.select(*keys, share.alias("__s")).groupBy(*keys).agg(
        *[F.count_if(F.col("__s") > level).alias(name) for name, level in levels.items()]
    )


def frequency_above(
    df: DataFrame, keys: Sequence[str], named_shares: Mapping[str, Column], level: float, *also: Column
) -> DataFrame:
    """Percentage of rows strictly above the level; a NULL share counts as not above."""
    flags = {n: F.when(s > level, 1.0).otherwise(0.0) for n, s in named_shares.items()}
    return df.groupBy(*keys).agg(*[(100.0 * F.avg(f)).alias(n) for n, f in flags.items()], *also)


def share_above_with_denominators(part: Column, denominators: Mapping[str, Column]) -> dict[str, Column]:
    """The same part over several denominators; a zero denominator gives NULL."""
    return {name: percent(part, den) for name, den in denominators.items()}


def exceedance(
    df: DataFrame, keys: Sequence[str], value: str, level: float, year: str | None = None
) -> DataFrame:
    """Measured days, days strictly above the level, rate, and the years present as one text."""
    aggs = [
        F.count("*").alias("n_days"),
        F.count_if(F.col(value) > level).alias("n_above"),
        (100.0 * F.count_if(F.col(value) > level) / F.count("*")).alias("rate"),
    ]
    if year:
        aggs.append(F.array_join(F.array_sort(F.collect_set(year)), ",").alias("years"))
    return df.groupBy(*keys).agg(*aggs)


def bands(value: Column, edges: Sequence[tuple[float, str]], last: str) -> Column:
    """Label of the first band whose upper edge (excluded) lies above the value."""
    (edge, label), *rest = edges
    out = F.when(value < edge, label)
    for edge, label in rest:
        out = out.when(value < edge, label)
    return out.otherwise(last)
