"""Hourly series: grids, regulatory rolling statistics, reconstruction, gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import timeaxis as T

# 75 % of 8 hours, and 75 % of 24 rolling means (EU directive 2008/50/EC).
MIN_HOURS_OF_8 = 6
MIN_MEANS_OF_DAY = 18


def local_day_bounds(
    measures: DataFrame,
    keys: Sequence[str],
    local_day: str,
    value: str,
    zone: str = T.PARIS,
    attrs: Sequence[str] = (),
) -> DataFrame:
    """First and last UTC hour (as hour indexes) of the whole local days with a value.

    Days of 23 or 25 hours come out of the conversion by themselves. The filter on the value also
    makes this branch need the columns the measures' own branch needs, so that Spark reuses the
    shuffle below both instead of reading the source twice.
    """
    last_hour = T.plus_hours(T.midnight(F.col("__last")), 23)
    return (
        measures.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(
            F.min(local_day).alias("__first"),
            F.max(local_day).alias("__last"),
            *[F.min(a).alias(a) for a in attrs],
        )
        .select(
            *keys,
            *attrs,
            T.hour_index(T.local_to_utc(T.midnight(F.col("__first")), zone)).alias("first_hour"),
            T.hour_index(T.local_to_utc(last_hour, zone)).alias("last_hour"),
        )
    )


def hour_grid(bounds: DataFrame, keys: Sequence[str], span: int = 240) -> DataFrame:
    """Every hour between the bounds, one row each; a long series is cut in spans before exploding."""
    block = F.explode(
        F.sequence(F.floor(F.col("first_hour") / span), F.floor(F.col("last_hour") / span))
    ).alias("__block")
    hours = F.sequence(
        F.greatest("first_hour", F.col("__block") * span),
        F.least("last_hour", F.col("__block") * span + (span - 1)),
    )
    return bounds.select(*keys, "first_hour", "last_hour", block).select(
        *keys, F.explode(hours).alias("hour")
    )


def rolling_hours(
    measures: DataFrame,
    bounds: DataFrame,
    keys: Sequence[str],
    hour: str,
    value: str,
    width: int = 8,
    span: int = 240,
    attrs: Sequence[str] = (),
) -> DataFrame:
    """Mean and count of the values within the last ``width`` hours, at every hour of the grid.

    The frame is a range of time, not a number of rows, and an hour without its own measure still
    gets the mean of the hours before it. Each series is cut in blocks of ``span`` hours that repeat
    the ``width - 1`` hours before them, so no window partition grows with the length of a series.
    Grid and measures are stacked and collapsed per hour: one shuffle serves the alignment and the
    window. Measures must be unique per (keys, hour).
    """
    back = width - 1
    block = F.floor(F.col("__hour") / span).cast("bigint")
    tail = F.col("__hour") >= (block + 1) * span - back
    copies = F.explode(F.when(tail, F.array(block, block + 1)).otherwise(F.array(block)))
    filled = (
        measures.filter(F.col(value).isNotNull())
        .select(*keys, F.col(hour).alias("__hour"), F.col(value).cast("double").alias("__v"))
        .select(*keys, "__hour", copies.alias("__block"), "__v")
    )

    blocks = F.sequence(
        F.floor(F.col("first_hour") / span).cast("bigint"), F.floor(F.col("last_hour") / span).cast("bigint")
    )
    owned = F.sequence(
        F.greatest("first_hour", F.col("__block") * span),
        F.least("last_hour", F.col("__block") * span + (span - 1)),
    )
    attr_struct = F.struct(F.lit(True).alias("__grid"), *attrs)
    grid = (
        bounds.select("*", F.explode(blocks).alias("__block"))
        .select(*keys, F.explode(owned).alias("__hour"), "__block", attr_struct.alias("__attrs"))
    )

    stacked = (
        filled.unionByName(grid, allowMissingColumns=True)
        .repartition(*keys, "__block")
        .groupBy(*keys, "__block", "__hour")
        .agg(F.max("__v").alias("__v"), F.max("__attrs").alias("__attrs"))
    )
    frame = Window.partitionBy(*keys, "__block").orderBy("__hour").rangeBetween(-back, 0)
    rolled = stacked.select(
        *keys,
        F.col("__hour").alias("hour"),
        "__attrs",
        F.avg("__v").over(frame).alias("mean"),
        F.count("__v").over(frame).cast("bigint").alias("n"),
    )
    return rolled.filter(F.col("__attrs").isNotNull()).select(
        *keys, *[F.col(f"__attrs.{a}").alias(a) for a in attrs], "hour", "mean", "n"
    )


def daily_max_of_rolling(
    rolling: DataFrame,
    keys: Sequence[str],
    zone: str = T.PARIS,
    min_hours: int = MIN_HOURS_OF_8,
    min_means: int = MIN_MEANS_OF_DAY,
    attrs: Sequence[str] = (),
) -> DataFrame:
    """Per local day: highest valid rolling mean, its hour (earliest on a tie), count, validity.

    An invalid day is kept and flagged, so that a reader can count what was left out.
    """
    local = T.utc_to_local(T.from_hour_index("hour"), zone)
    return (
        rolling.filter(F.col("n") >= min_hours)
        .select(*keys, *attrs, local.cast("date").alias("day"), F.hour(local).alias("__h"), "mean")
        .groupBy(*keys, "day")
        .agg(
            *[F.min(a).alias(a) for a in attrs],
            F.max("mean").alias("max_mean"),
            F.max_by("__h", F.struct(F.col("mean"), -F.col("__h"))).alias("hour_of_max"),
            F.count("*").alias("n_means"),
        )
        .withColumn("valid", F.col("n_means") >= min_means)
    )


def carry_forward(
    points: DataFrame,
    periods: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    n_positions: str,
    leading: str = "error",
) -> DataFrame:
    """Fill a period's missing positions with the last value given before them.

    The value never crosses into another period. With ``leading="error"`` a period without its
    first position is an error, raised while the rows are computed; with ``"skip"`` the positions
    before the first given value are left out. ``declared`` marks the given positions.
    A period has a bounded number of positions, so a window per period is balanced.
    """
    if leading not in ("error", "skip"):
        raise ValueError(f"leading must be 'error' or 'skip', not {leading!r}")
    grid = periods.select(
        *periods.columns, F.explode(F.sequence(F.lit(1), F.col(n_positions).cast("int"))).alias(position)
    )
    given = points.select(*keys, F.col(position).cast("int").alias(position), F.col(value).alias("__given"))
    so_far = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(given, [*keys, position], "left").select(
        *periods.columns,
        position,
        F.last("__given", ignorenulls=True).over(so_far).alias(value),
        F.col("__given").isNotNull().alias("declared"),
    )
    if leading == "skip":
        return filled.filter(F.col(value).isNotNull())
    message = F.concat(F.lit("period without its first position: "), F.to_json(F.struct(*keys)))
    return filled.withColumn(value, F.coalesce(F.col(value), F.raise_error(message).cast("double")))


def resample_hourly(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Mean of the sub-hourly steps of each hour, whatever the mix of resolutions."""
    return df.groupBy(*keys, T.floor_hour(ts).alias("hour_ts")).agg(
        F.avg(value).alias(value), F.count(value).alias("n")
    )


def energy(power: Column | str, minutes: Column | str) -> Column:
    """Energy of a point from its own duration; counting rows would over-count quarter-hours."""
    power = F.col(power) if isinstance(power, str) else power
    minutes = F.col(minutes) if isinstance(minutes, str) else minutes
    return power * minutes / 60.0


def live_window(
    readings: DataFrame,
    keys: Sequence[str],
    step_index: str,
    values: Sequence[str],
    steps: int = 24,
    fillable: int = 2,
) -> DataFrame:
    """The last ``steps`` readings of each series, with short gaps interpolated.

    ``step_index`` counts the steps of the feed (for a 15-minute feed, minutes / 15). One or two
    missing readings are interpolated linearly when each has a neighbour on both sides - the left
    one may lie just before the window; otherwise nothing is filled. Returns the window's rows with
    ``state`` = 'read', 'filled' or 'missing'.
    """
    # The last steps + 1 readings hold one step of each remainder: the newest reading of a remainder is in the window or
    # its step is missing. So a key keeps steps + 1 rows, found by partial aggregates; the history is read once and
    # never joined.
    at = F.col(step_index)
    newest = readings.filter(at.isNotNull()).groupBy(*keys, F.pmod(at, F.lit(steps + 1)).alias("__slot")).agg(
        F.max(at).alias("__at"), *[F.max_by(v, at).alias(v) for v in values]
    )
    reading = F.struct(F.col("__at").alias("at"), *values)
    gathered = newest.groupBy(*keys).agg(F.max("__at").alias("__end"), F.collect_list(reading).alias("__given"))
    # the axis has one step more than the window: the neighbour just before it
    gathered = gathered.withColumn("__given", F.array_sort(F.filter("__given", lambda r: r["at"] >= F.col("__end") - steps)))
    axis = F.sequence(F.col("__end") - steps + 1, F.col("__end"))

    def around(step: Column) -> Column:
        return F.struct(
            step.alias("step"),
            F.try_element_at(F.filter("__given", lambda r: r["at"] <= step), F.lit(-1)).alias("before"),
            F.get(F.filter("__given", lambda r: r["at"] >= step), 0).alias("after"),
        )

    is_gap = lambda p: ~F.coalesce(p["before"]["at"] == p["step"], F.lit(False))
    is_open = lambda p: is_gap(p) & (p["before"].isNull() | p["after"].isNull())
    d = gathered.select(*keys, F.transform(axis, around).alias("__window")).select(
        *keys,
        F.explode("__window").alias("__p"),
        ((F.size(F.filter("__window", is_gap)) <= fillable) & ~F.exists("__window", is_open)).alias("__fill"),
    )
    gap, fill = is_gap(F.col("__p")), F.col("__fill")
    place = lambda name: F.col(f"__p.{name}.at")
    weight = (F.col("__p.step") - place("before")) / (place("after") - place("before"))
    blended = [
        F.when(~gap, F.col(f"__p.before.{v}"))
        .when(fill, (1 - weight) * F.col(f"__p.before.{v}") + weight * F.col(f"__p.after.{v}"))
        .alias(v)
        for v in values
    ]
    state = F.when(~gap, "read").when(fill, "filled").otherwise("missing")
    return d.select(*keys, F.col("__p.step").alias(step_index), *blended, state.alias("state"))


def live_summary(window: DataFrame, keys: Sequence[str], part: str, whole: str, step_minutes: int) -> DataFrame:
    """Share over the available readings; energies only when nothing is missing."""
    hours = step_minutes / 60.0
    complete = F.count_if(F.col("state") == "missing") == 0
    return window.groupBy(*keys).agg(
        (100.0 * F.sum(part) / F.nullif(F.sum(whole), F.lit(0))).alias("share"),
        F.when(complete, F.sum(part) * hours).alias("part_energy"),
        F.when(complete, F.sum(whole) * hours).alias("total_energy"),
        F.count_if(F.col("state") == "read").alias("n_read"),
        F.count_if(F.col("state") == "filled").alias("n_filled"),
        F.count_if(F.col("state") == "missing").alias("n_missing"),
    )
