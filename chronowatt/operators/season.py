"""Seasonal peaks: top-k means, winter vintages, gaps between seasons, monotony."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Months of the load summer, of the air-quality summer and of the winter.
LOAD_SUMMER = (6, 7, 8, 9)
AIR_SUMMER = (6, 7, 8)
WINTER = (12, 1, 2)
# Fixed value: hours a winter must hold to be compared (about 2 160 for a whole one).
COMPLETE_WINTER_HOURS = 2100


def top_k(df: DataFrame, keys: Sequence[str], value: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The k largest rows of each group. The rank filter lets Spark trim every partition to k rows
    per group before the shuffle, so a hot group moves k rows per task."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value), *ties)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k_mean(df: DataFrame, keys: Sequence[str], value: str, k: int, ties: Sequence[str], name: str = "top_mean") -> DataFrame:
    return top_k(df, keys, value, k, ties).groupBy(*keys).agg(F.avg(value).alias(name))


def season_peaks(
    days: DataFrame, key: str, value: str, day: str, k: int = 20, level: float | None = None
) -> DataFrame:
    """Per season: count, maximum, mean of the k highest, median and count at or above a level.

    ``days`` is already aggregated to one row per step of the calendar, so the exact median's buffer
    holds at most one season.
    """
    aggs = [
        F.count("*").alias("n"),
        F.max(value).alias("maximum"),
        F.percentile(value, 0.5).alias("median"),
    ]
    if level is not None:
        aggs.append(F.count_if(F.col(value) >= level).alias("n_at_level"))
    return days.groupBy(key).agg(*aggs).join(top_k_mean(days, [key], value, k, [day]), key)


def winters(
    days: DataFrame, year: str, month: str, value: str, complete_from: int, order: str
) -> DataFrame:
    """Winters named after the year of their December: count, completeness, peak, month of the peak."""
    vintage = F.when(F.col(month) == 12, F.col(year)).otherwise(F.col(year) - 1)
    return (
        days.filter(F.col(month).isin(*WINTER))
        .groupBy(vintage.alias("winter"))
        .agg(
            F.count("*").alias("n"),
            F.max(value).alias("maximum"),
            F.min_by(month, F.struct(-F.col(value), F.col(order))).alias("month_of_max"),
        )
        .withColumn("complete", F.col("n") >= complete_from)
    )


def summer_less_previous_winter(
    days: DataFrame, year: str, month: str, value: str, complete_from: int
) -> DataFrame:
    """Summer peak less the peak of the winter before it, complete winters only.

    A winter is filed under the summer that follows it, which brings both peaks together in one
    aggregation instead of a join.
    """
    m = F.col(month)
    summer, winter = m.isin(*LOAD_SUMMER), m.isin(*WINTER)
    target = F.when(winter & (m == 12), F.col(year) + 1).otherwise(F.col(year))
    return (
        days.filter(summer | winter)
        .groupBy(target.alias(year))
        .agg(
            F.max(F.when(summer, F.col(value))).alias("summer_peak"),
            F.max(F.when(winter, F.col(value))).alias("winter_peak"),
            F.count_if(winter).alias("__n"),
        )
        .filter((F.col("__n") >= complete_from) & F.col("summer_peak").isNotNull())
        .drop("__n")
        .withColumn("gap", F.col("summer_peak") - F.col("winter_peak"))
    )


def first_last_gain(df: DataFrame, year: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Last year's value less the first year's, for each column."""
    return df.groupBy(*keys).agg(
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        *[(F.max_by(v, year) - F.min_by(v, year)).alias(f"gain_{v}") for v in values],
    )


def strictly_increasing(df: DataFrame, order: str, value: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Whether each value exceeds the one before it; for yearly rows."""
    value = F.col(value) if isinstance(value, str) else value
    step = value - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.select(*keys, step.alias("__step")).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("__step") <= 0).alias("n_drops"),
        F.coalesce(F.every(F.col("__step") > 0), F.lit(True)).alias("increasing"),
    )
