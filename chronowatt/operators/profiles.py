"""Daily profiles: shares by hour, plateaus, peaks, half-height midpoint, lag alignment.

The frames handled here are already aggregated (24 hours, 12 months, a few years per series), which
is what makes an unpartitioned or per-series window acceptable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_max(profile: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``top`` = maximum of the value over the series."""
    return profile.withColumn("top", F.max(value).over(Window.partitionBy(*keys)))


def relative_to_peak(profile: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return with_max(profile, keys, value).withColumn("pct_of_peak", 100.0 * F.col(value) / F.nullif(F.col("top"), F.lit(0)))


def plateau(profile: DataFrame, keys: Sequence[str], hour: str, value: str, level: float) -> DataFrame:
    """Bounds of the hours within ``level`` of the maximum, and whether they follow one another."""
    high = with_max(profile, keys, value).filter(F.col(value) >= level * F.col("top"))
    return high.groupBy(*keys).agg(
        F.min(hour).cast("bigint").alias("first_hour"),
        F.max(hour).cast("bigint").alias("last_hour"),
        F.count("*").alias("n_hours"),
        (F.max(hour) - F.min(hour) + 1 == F.count_distinct(hour)).alias("contiguous"),
    )


def peak(profile: DataFrame, keys: Sequence[str], hour: str, value: str) -> DataFrame:
    """Hour of the maximum, the earliest on a tie."""
    return profile.groupBy(*keys).agg(
        F.max_by(hour, F.struct(F.col(value), -F.col(hour))).cast("bigint").alias("peak_hour"),
        F.max(value).alias("peak_value"),
    )


def trough(profile: DataFrame, keys: Sequence[str], hour: str, value: str) -> DataFrame:
    return profile.groupBy(*keys).agg(
        F.min_by(hour, F.struct(F.col(value), F.col(hour))).cast("bigint").alias("trough_hour"),
        F.min(value).alias("trough_value"),
    )


def half_height_mid(profile: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Midpoint of a profile at half its maximum: mean of the first upward crossing seen from the
    left and the first seen from the right, each interpolated linearly. NULL when a side has none."""
    ordered = Window.partitionBy(*keys).orderBy(x)
    half = F.max(y).over(Window.partitionBy(*keys)) / 2.0
    d = profile.select(
        *keys,
        F.col(x).cast("double").alias("__x"),
        F.col(y).cast("double").alias("__y"),
        half.alias("__half"),
        F.lead(F.col(y).cast("double")).over(ordered).alias("__right"),
        F.lag(F.col(y).cast("double")).over(ordered).alias("__left"),
    )

    def crossing(neighbour: str, side: int) -> Column:
        met = (F.col("__y") < F.col("__half")) & (F.col("__half") <= F.col(neighbour))
        at = F.col("__x") + side * (F.col("__half") - F.col("__y")) / (F.col(neighbour) - F.col("__y"))
        return F.when(met, at)

    return d.select(
        *keys, "__x", crossing("__right", 1).alias("__up"), crossing("__left", -1).alias("__down")
    ).groupBy(*keys).agg(
        F.min_by("__up", F.when(F.col("__up").isNotNull(), F.col("__x"))).alias("rise"),
        F.max_by("__down", F.when(F.col("__down").isNotNull(), F.col("__x"))).alias("fall"),
    ).withColumn("mid", (F.col("rise") + F.col("fall")) / 2.0)


def lag_correlations(
    a: DataFrame,
    b: DataFrame,
    time: str,
    a_value: str,
    b_value: str,
    reach: int = 3,
    min_pairs: int = 200,
    groups: Sequence[str] = (),
) -> DataFrame:
    """Correlation of ``a`` shifted by each whole lag with ``b``; NULL unless pairs > ``min_pairs``.

    The lag is exploded on one side and matched by equality. ``groups`` are columns of ``b``.
    """
    shifted = a.select(
        F.col(time).alias("__t"),
        F.col(a_value).cast("double").alias("__a"),
        F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("lag"),
    ).select((F.col("__t") + F.col("lag")).alias(time), "__a", F.col("lag").cast("bigint").alias("lag"))
    other = b.select(*groups, time, F.col(b_value).cast("double").alias("__b"))
    pairs = shifted.join(other, time).filter(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    return pairs.groupBy(*groups, "lag").agg(
        F.count("*").alias("n_pairs"),
        F.when(F.count("*") > min_pairs, F.corr("__a", "__b")).alias("correlation"),
    )


def lag_optimum(correlations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lag of the best correlation, refined by a parabola through its two neighbours.

    No row for a group in which no lag has a correlation.
    """
    by_lag = Window.partitionBy(*keys).orderBy("lag")
    d = correlations.select(
        *keys,
        "lag",
        F.col("correlation").alias("__c"),
        F.lag(F.when(F.col("correlation").isNotNull(), F.struct("lag", "correlation"))).over(by_lag).alias("__p"),
        F.lead(F.when(F.col("correlation").isNotNull(), F.struct("lag", "correlation"))).over(by_lag).alias("__n"),
    )
    best = d.groupBy(*keys).agg(
        F.max_by(
            F.struct("lag", "__c", "__p", "__n"), F.when(F.col("__c").isNotNull(), F.struct(F.col("__c"), -F.col("lag")))
        ).alias("__best")
    ).filter(F.col("__best").isNotNull())
    left, mid, right = F.col("__best.__p.correlation"), F.col("__best.__c"), F.col("__best.__n.correlation")
    bend = left - 2 * mid + right
    lag = F.col("__best.lag")
    refined = lag + F.coalesce(0.5 * (left - right) / F.nullif(bend, F.lit(0.0)), F.lit(0.0))
    return best.select(
        *keys, lag.alias("best_lag"), mid.alias("best_correlation"), refined.cast("double").alias("refined_lag")
    )
