"""Exact interpolated quantiles without gathering a group in one task.

``percentile()`` keeps every distinct value of a group in one aggregation buffer. That suits groups
of daily totals; for raw rows, :func:`exact_quantiles` selects: equal values are counted first, then each
round cuts a group (later: the bins that hold the wanted ranks) at approximate quantiles of its distinct
values and finds by counting which of the new bins hold the ranks. Rounds go on until no such bin holds
more than ``limit`` distinct values; those are put in order. A bin shrinks by the number of cuts each round,
so a group of any size takes a few rounds, and only the first reads all of it. The sketch picks the cuts; the
counting makes the answer exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

# Distinct values of one bin that one task may be asked to order.
BIN_VALUES = 1_000_000


def small_group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles where a group is bounded by the calendar (days of a season, hours of a day)."""
    return df.groupBy(*keys).agg(*[F.percentile(value, p).alias(name) for name, p in probs.items()])


def _holds(rank: str, before: str, size: str) -> Column:
    return (F.col(before) <= F.col(rank)) & (F.col(rank) < F.col(before) + F.col(size))


def _narrowed(active: DataFrame, keys: list[str], wanted: DataFrame, bins: int, accuracy: int) -> DataFrame:
    """The rows (keys, __bin, __before, __x, __c) of the bins that hold a wanted rank, after cutting each bin anew."""
    cuts = [F.lit((i + 1) / bins) for i in range(bins - 1)]
    middle = F.min("__x") / 2 + F.max("__x") / 2
    shape = active.groupBy(*keys, "__bin").agg(
        # the middle makes sure that every bin of more than one value is cut
        F.array_append(F.percentile_approx("__x", F.array(*cuts), accuracy), middle).alias("__cuts")
    )
    part = F.size(F.filter("__cuts", lambda cut: cut < F.col("__x")))
    cut = active.join(shape, [*keys, "__bin"]).select(*keys, "__bin", part.alias("__part"), "__before", "__x", "__c")
    across = Window.partitionBy(*keys, "__bin").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, "__bin", "__before", "__part").agg(F.sum("__c").alias("__size"))
    sizes = sizes.withColumn("__from", F.col("__before") + F.coalesce(F.sum("__size").over(across), F.lit(0)))
    held = sizes.join(wanted, keys).filter(_holds("__lo", "__from", "__size") | _holds("__hi", "__from", "__size"))
    held = held.select(*keys, "__bin", "__part", "__from").distinct()
    return cut.join(held, [*keys, "__bin", "__part"]).select(*keys, F.col("__from").alias("__bin"), F.col("__from").alias("__before"), "__x", "__c")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    bins: int = 128,
    accuracy: int = 10_000,
    limit: int = BIN_VALUES,
) -> DataFrame:
    """Keys, ``n`` (non-null values) and one column per named probability."""
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__x")).filter(F.col("__x").isNotNull())
    counted = rows.groupBy(*keys, "__x").agg(F.count("*").alias("__c"))
    shape = counted.groupBy(*keys).agg(F.sum("__c").alias("n"), F.count("*").alias("__distinct"))

    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in probs.items()])
    wanted = (
        shape.select(*keys, "n", F.explode(ranks).alias("__w"))
        .select(*keys, "n", F.col("__w.name").alias("__name"), (F.col("__w.p") * (F.col("n") - 1)).alias("__pos"))
        .withColumn("__lo", F.floor("__pos").cast("bigint"))
        .withColumn("__hi", F.ceil("__pos").cast("bigint"))
    )
    # the first bin of a group is named by its first rank, as later ones are
    active = counted.select(*keys, F.lit(0).cast("bigint").alias("__bin"), F.lit(0).cast("bigint").alias("__before"), "__x", "__c")
    largest = shape.agg(F.max("__distinct")).first()[0] or 0
    while largest > limit:
        active = cut_lineage(_narrowed(active, keys, wanted, bins, accuracy))
        largest = active.groupBy(*keys, "__bin").count().agg(F.max("count")).first()[0] or 0

    inside = Window.partitionBy(*keys, "__bin").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    placed = active.withColumn("__start", F.col("__before") + F.coalesce(F.sum("__c").over(inside), F.lit(0)))
    hits = placed.join(wanted, keys).filter(_holds("__lo", "__start", "__c") | _holds("__hi", "__start", "__c"))
    at = lambda rank: F.max(F.when(_holds(rank, "__start", "__c"), F.col("__x")))
    found = hits.groupBy(*keys, "n", "__name", "__pos", "__lo").agg(at("__lo").alias("__a"), at("__hi").alias("__b"))
    answer = F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__pos") - F.col("__lo"))
    return found.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("__name") == name, answer)).alias(name) for name in probs]
    )
