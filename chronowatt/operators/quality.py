"""Data-quality guards.

A guard is a violations frame (or a counting column): empty (zero) means pass. All the counting
guards of a table run in one aggregation; only verdicts and a few examples reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import broadcast_if_small


class GuardError(ValueError):
    """A table broke one of its guards; nothing is published."""


def null_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in columns]
    )


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count (pre-aggregated before the shuffle)."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def part_above_whole(df: DataFrame, keys: Sequence[str], whole: str, part: str) -> DataFrame:
    """Groups whose total is below one of its parts. Rows may break this legitimately, groups not."""
    return df.groupBy(*keys).agg(F.sum(whole).alias("whole"), F.sum(part).alias("part")).filter(
        F.col("whole") < F.col("part")
    )


def incomplete_years(df: DataFrame, year: str, month: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, year).agg(F.count_distinct(month).alias("n_months")).filter(F.col("n_months") != 12)


def grid_regularity(df: DataFrame, hour_index: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct hours against the hours between the bounds."""
    return (
        df.select(*keys, hour_index.alias("__h"))
        .groupBy(*keys)
        .agg(
            F.count_distinct("__h").alias("n_hours"),
            (F.max("__h") - F.min("__h") + 1).alias("n_expected"),
        )
        .withColumn("regular", F.col("n_hours") == F.col("n_expected"))
    )


def hollow_days(df: DataFrame, keys: Sequence[str], day: str, hour: str, floor: int = 23) -> DataFrame:
    """Days with too few distinct local hours, and whether they lie at an edge of their series.

    23 and not 24: the spring clock-change day has no more.
    """
    days = df.groupBy(*keys, day).agg(F.count_distinct(hour).alias("n_hours"))
    # one row per day by now, so a window per series is bounded by its calendar
    of_series = Window.partitionBy(*keys)
    at_edge = (F.col(day) == F.min(day).over(of_series)) | (F.col(day) == F.max(day).over(of_series))
    return days.withColumn("at_edge", at_edge).filter(F.col("n_hours") < floor)


def trim_edge_days(df: DataFrame, day: str) -> DataFrame:
    """Without the first and last day of the whole series; the bounds are one scalar subquery."""
    edges = df.agg(F.struct(F.min(day).alias("first"), F.max(day).alias("last"))).scalar()
    return df.filter((F.col(day) > edges["first"]) & (F.col(day) < edges["last"]))


def unknown_codes(df: DataFrame, code: str, known: Sequence) -> DataFrame:
    """Codes outside the list, with their count."""
    return (
        df.groupBy(code).agg(F.count("*").alias("n")).filter(F.col(code).isNull() | ~F.col(code).isin(*known))
    )


def missing_expected(expected: DataFrame, observed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Expected keys that never occur; the observed side is reduced to its distinct keys first."""
    return expected.join(observed.select(*key).distinct(), list(key), "left_anti")


def orphans(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    return left.join(right.select(*key).distinct(), list(key), "left_anti")


def map_codes(df: DataFrame, mapping: DataFrame, code: str, category: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their category, and the codes the mapping does not know (must be empty)."""
    dim = broadcast_if_small(mapping.select(code, category))
    return df.join(dim, code, "left"), df.select(code).distinct().join(dim, code, "left_anti")


def orphan_counts(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows of each side without a counterpart (``n_left``, ``n_right``).

    Both sides are counted per key before they meet, so a frequent key moves one row per task.
    """
    a = left.groupBy(*key).agg(F.count("*").alias("__a"))
    b = right.groupBy(*key).agg(F.count("*").alias("__b"))
    met = a.join(b, list(key), "full")
    return met.agg(
        F.coalesce(F.sum(F.when(F.col("__b").isNull(), F.col("__a"))), F.lit(0)).alias("n_left"),
        F.coalesce(F.sum(F.when(F.col("__a").isNull(), F.col("__b"))), F.lit(0)).alias("n_right"),
    )


def misaligned(df: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """Keys (years) present on one side only of a comparison, in one pass over the stacked sides."""
    sides = df.groupBy(key).agg(F.count_if(left).alias("__a"), F.count_if(right).alias("__b"))
    side = F.when(F.col("__b") == 0, "left_only").otherwise("right_only")
    return sides.filter((F.col("__a") == 0) != (F.col("__b") == 0)).select(key, side.alias("side"))


def both_present(df: DataFrame, keys: Sequence[str], first: Column, second: Column) -> DataFrame:
    """Groups in which both conditions are met at least once."""
    return df.groupBy(*keys).agg(
        F.count_if(first).alias("n_first"), F.count_if(second).alias("n_second")
    ).filter((F.col("n_first") > 0) & (F.col("n_second") > 0))


def table_difference(a: DataFrame, b: DataFrame, multiset: bool = False) -> DataFrame:
    """Rows of one table that the other lacks, both ways; empty means equal."""
    minus = DataFrame.exceptAll if multiset else DataFrame.subtract
    return minus(a, b).withColumn("side", F.lit("left")).unionByName(
        minus(b, a).withColumn("side", F.lit("right"))
    )


def changed_fields(
    declared: DataFrame, recorded: DataFrame, key: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """Keys whose declaration and record differ, with the names of the fields that do."""
    d = declared.select(*key, F.struct(*fields).alias("__d"))
    r = recorded.select(*key, F.struct(*fields).alias("__r"))
    names = F.array_compact(
        F.array(*[F.when(~F.col(f"__d.{f}").eqNullSafe(F.col(f"__r.{f}")), F.lit(f)) for f in fields])
    )
    joined = d.join(r, list(key), "full").select(
        *key,
        F.when(F.col("__d").isNull(), "recorded_only")
        .when(F.col("__r").isNull(), "declared_only")
        .otherwise("both")
        .alias("presence"),
        names.alias("changed"),
    )
    return joined.filter(F.size("changed") > 0)


@dataclass(frozen=True)
class Guard:
    """Named condition a table's rows must never meet."""

    name: str
    broken: Column


def guard_counts(df: DataFrame, guards: Sequence[Guard]) -> DataFrame:
    """One row, one count per guard, in a single pass."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(g.broken).alias(g.name) for g in guards])


def check_rows(df: DataFrame, guards: Sequence[Guard], table: str) -> int:
    """Raise on any broken row guard; returns the row count. An empty table is a failure too."""
    row = guard_counts(df, guards).first()
    if not row["n_rows"]:
        raise GuardError(f"{table}: no row")
    broken = {g.name: row[g.name] for g in guards if row[g.name]}
    if broken:
        raise GuardError(f"{table}: {broken}")
    return row["n_rows"]


def check_empty(violations: Mapping[str, DataFrame], table: str, examples: int = 5) -> None:
    """Raise if any violations frame holds a row, naming a few."""
    for name, frame in violations.items():
        found = frame.limit(examples).collect()
        if found:
            raise GuardError(f"{table}: {name}: {[r.asDict() for r in found]}")


def claims(df: DataFrame, statements: Mapping[str, Column]) -> DataFrame:
    """Publication claims over a small frame, as rows (name, ok). One aggregation for all."""
    row = df.agg(*[c.alias(n) for n, c in statements.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("boolean").alias("ok")) for n in statements])
    return row.select(F.inline(pairs))


def check_claims(df: DataFrame, statements: Mapping[str, Column], what: str) -> None:
    failed = [r["name"] for r in claims(df, statements).filter("ok is distinct from true").collect()]
    if failed:
        raise GuardError(f"{what}: no longer true: {failed}")
