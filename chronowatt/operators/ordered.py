"""Ordered look-back and look-ahead that stays balanced when one key holds most of the rows.

A plain ``lag() OVER (PARTITION BY key ORDER BY t)`` sends a hot key to a single task. Here the key
is cut into buckets of the ordering axis (a column derived from the row, such as the hour):

1. inside each (key, bucket) an ordinary window answers the rows that have a neighbour there;
2. one row per (key, bucket) - the bucket's last value, found by a partial aggregate - answers the
   others through a window over buckets, whose partitions hold one row per bucket.

The answer is exactly the one of the plain window, whatever the bucket width. Keys must not be NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timeaxis import hour_index
from ..session import cut_lineage

_BUCKET, _VALUE, _NEAR, _EDGE = "__bucket", "__value", "__near", "__edge"

# Rows of one key that one task may be asked to sort.
BUCKET_ROWS = 1_000_000


def bucket_seconds(df: DataFrame, keys: Sequence[str], time: str, target_rows: int = BUCKET_ROWS) -> int:
    """Bucket width, in seconds, that keeps every (key, bucket) near ``target_rows`` at most.

    Measured, not assumed: the busiest hour of the busiest key is found by a partial aggregate, and
    one number comes back. Sparse data gets wide buckets, which makes the second step trivial.
    """
    per_hour = df.groupBy(*keys, hour_index(time).alias(_BUCKET)).agg(F.count("*").alias(_VALUE))
    busiest = per_hour.agg(F.max(_VALUE)).first()[0] or 1
    if busiest <= target_rows:
        return 3600 * (target_rows // busiest)
    return max(1, 3600 * target_rows // busiest)


def _carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: Column,
    out: str,
    inclusive: bool,
    forward: bool,
) -> DataFrame:
    direction = (lambda c: F.col(c).asc()) if forward else (lambda c: F.col(c).desc())
    d = df.withColumn(_BUCKET, bucket).withColumn(_VALUE, value)
    within = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    near = d.withColumn(_NEAR, F.last(_VALUE, ignorenulls=True).over(within))

    pick = F.max_by if forward else F.min_by
    position = F.when(F.col(_VALUE).isNotNull(), F.struct(*order))
    edges = d.groupBy(*keys, _BUCKET).agg(pick(_VALUE, position).alias(_EDGE))
    across = (
        Window.partitionBy(*keys).orderBy(direction(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    )
    edges = edges.select(
        *keys, _BUCKET, F.last(_EDGE, ignorenulls=True).over(across).alias(_EDGE)
    ).filter(F.col(_EDGE).isNotNull())

    joined = near.join(edges, [*keys, _BUCKET], "left")
    return joined.withColumn(out, F.coalesce(_NEAR, _EDGE)).drop(_BUCKET, _VALUE, _NEAR, _EDGE)


def carry_last(df, keys, order, bucket, value, out, inclusive=True) -> DataFrame:
    """``out`` = last non-null ``value`` at (``inclusive``) or before the row, per key."""
    return _carry(df, keys, order, bucket, value, out, inclusive, forward=True)


def carry_next(df, keys, order, bucket, value, out, inclusive=True) -> DataFrame:
    """``out`` = first non-null ``value`` at (``inclusive``) or after the row, per key."""
    return _carry(df, keys, order, bucket, value, out, inclusive, forward=False)


def _neighbour(df, keys, order, bucket, cols, out, forward: bool) -> DataFrame:
    """Previous (or next) row of the key.

    Only the first row of a bucket looks outside it, so the two cases are separated and put back
    together: no join, and both read the same shuffled rows.
    """
    direction = (lambda c: F.col(c).asc()) if forward else (lambda c: F.col(c).desc())
    bucketed = df.withColumn(_BUCKET, bucket)
    within = Window.partitionBy(*keys, _BUCKET).orderBy(*[direction(c) for c in order])
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    picked = F.struct(*cols)
    marked = bucketed.select(
        "*", F.lag(picked).over(within).alias(_NEAR), F.last(picked).over(whole).alias(_EDGE)
    )
    inner = marked.filter(F.col(_NEAR).isNotNull()).withColumn(out, F.col(_NEAR))
    across = Window.partitionBy(*keys).orderBy(direction(_BUCKET))
    edges = marked.filter(F.col(_NEAR).isNull()).withColumn(out, F.lag(_EDGE).over(across))
    return inner.unionByName(edges).drop(_BUCKET, _NEAR, _EDGE)


def lag_of(df, keys, order, bucket, cols: Sequence[str], out: str) -> DataFrame:
    """Struct of ``cols`` taken from the previous row of the key (NULL on its first row)."""
    return _neighbour(df, keys, order, bucket, cols, out, forward=True)


def lead_of(df, keys, order, bucket, cols: Sequence[str], out: str) -> DataFrame:
    """Struct of ``cols`` taken from the next row of the key (NULL on its last row)."""
    return _neighbour(df, keys, order, bucket, cols, out, forward=False)


def around(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    cols: Sequence[str],
    carried: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Structs ``prev`` and ``next`` of ``cols`` from the rows before and after, and for each name in ``carried`` the last
    non-null value before the row, per key: all in one pass.

    The rows are shuffled once, by (keys, bucket). One summary per bucket (its ends, and what it carries on) looks
    across the seams and comes back to the bucket, whose rows stay where they are.
    """
    carried = dict(carried or {})
    picked = F.struct(*cols)
    d = df.withColumn(_BUCKET, bucket).withColumns({f"__c_{n}": c for n, c in carried.items()})
    within = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    ends = d.groupBy(*keys, _BUCKET).agg(
        F.min_by(picked, place).alias("__first"),
        F.max_by(picked, place).alias("__last"),
        *[F.max_by(f"__c_{n}", F.when(F.col(f"__c_{n}").isNotNull(), place)).alias(f"__b_{n}") for n in carried],
    )
    across = Window.partitionBy(*keys).orderBy(_BUCKET)
    seams = ends.select(
        *keys,
        _BUCKET,
        F.lag("__last").over(across).alias("__prev"),
        F.lead("__first").over(across).alias("__next"),
        *[
            F.last(f"__b_{n}", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__a_{n}")
            for n in carried
        ],
    )
    near = d.withColumns(
        {
            "__near_prev": F.lag(picked).over(within),
            "__near_next": F.lead(picked).over(within),
            **{f"__n_{n}": F.last(f"__c_{n}", ignorenulls=True).over(before) for n in carried},
        }
    )
    return near.join(seams, [*keys, _BUCKET]).select(
        *df.columns,
        F.coalesce("__near_prev", "__prev").alias("prev"),
        F.coalesce("__near_next", "__next").alias("next"),
        *[F.coalesce(f"__n_{n}", f"__a_{n}").alias(n) for n in carried],
    )


def numbered(df: DataFrame, order: Sequence[str], out: str = "number") -> DataFrame:
    """``out``: the place of each row, from 1, in the order over all rows. They are sorted by ranges; a place is the rows of
    the ranges before plus the place within the range, so no task holds more than a range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # partition and place in it in one number
    ranged = cut_lineage(ranged.withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33))
    sizes = ranged.groupBy("__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    # one row for each range
    sizes = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n"))
    joined = ranged.join(F.broadcast(sizes.drop("__n")), "__part")
    return joined.withColumn(out, F.col("__id") - F.col("__first") + F.col("__before") + 1).drop("__id", "__part", "__first", "__before")


def runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    same_as_previous: Column,
    compared: Sequence[str],
) -> DataFrame:
    """Label every row with the position at which its run starts (``run_start``, a struct).

    ``same_as_previous`` is a predicate over the row and its ``prev`` struct (of ``compared``);
    a row for which it does not hold opens a run. Group by ``(*keys, run_start)`` to size the runs.
    """
    with_prev = lag_of(df, keys, order, bucket, compared, "prev")
    opens = ~F.coalesce(F.col("prev").isNotNull() & same_as_previous, F.lit(False))
    return carry_last(
        with_prev, keys, order, bucket, F.when(opens, F.struct(*order)), "run_start"
    ).drop("prev")


def run_sizes(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    same_as_previous: Column,
    compared: Sequence[str],
    label: Mapping[str, Column],
    size: Column | None = None,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """How many runs of each size there are: keys, the columns of ``label``, ``size``, ``n`` and the ``sums`` over their rows.

    Runs are those of :func:`runs`; ``same_as_previous`` may use the columns ``compared`` and their ``prev``. ``label`` is
    constant within a run; ``size`` is added up over its rows (their number unless given).

    The rows are shuffled once, by (keys, bucket), and summed up there: inner runs of a bucket are closed and become
    counts by size, its first and last run keep the values at their ends. These summaries are shuffled once more, by
    the keys, where runs that go on over a seam are joined. No row is joined back.
    """
    sums = dict(sums or {})
    within = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    here = F.struct(*compared)
    names, totals = [f"__label_{c}" for c in label], [f"__sum_{c}" for c in sums]
    summed = [F.sum(c).alias(c) for c in totals]
    added = [F.sum("__size").alias("__size"), *summed]

    d = df.select(
        *dict.fromkeys([*keys, *order, *compared]),
        bucket.alias(_BUCKET),
        (F.lit(1) if size is None else size).alias("__size"),
        *[c.alias(n) for n, c in zip(totals, sums.values())],
        *[c.alias(n) for n, c in zip(names, label.values())],
    )
    d = d.withColumn("prev", F.lag(here).over(within))
    d = d.withColumn("__opens", F.when(F.col("prev").isNotNull() & same_as_previous, 0).otherwise(1))
    d = d.withColumn("__run", F.sum("__opens").over(so_far)).withColumn("__runs", F.sum("__opens").over(whole))
    place = F.struct(*order)
    found = d.groupBy(*keys, _BUCKET, "__run").agg(
        *[F.first(n).alias(n) for n in names],
        *added,
        F.max("__runs").alias("__runs"),
        F.min_by(here, place).alias("__head"),
        F.max_by(here, place).alias("__tail"),
    )
    outer = (F.col("__run") == 1) | (F.col("__run") == F.col("__runs"))
    found = found.withColumn("__edge", F.when(outer, F.col("__run")))
    ends = [F.first(F.when(outer, F.col(c))).alias(c) for c in ("__head", "__tail")]
    found = found.groupBy(*keys, _BUCKET, "__edge", *names, "__size").agg(F.count("*").alias("n"), *summed, *ends)

    # at most two ends of a bucket, and its sizes
    seams = Window.partitionBy(*keys).orderBy(F.col("__edge").isNull(), _BUCKET, "__edge")
    found = found.withColumn("prev", F.lag("__tail").over(seams))
    found = found.withColumns({c: F.col(f"__head.`{c}`") for c in compared if c not in keys})
    goes_on = (F.col("__edge") == 1) & F.col("prev").isNotNull() & same_as_previous
    found = found.withColumn("__chain", F.sum(F.when(goes_on, 0).otherwise(1)).over(seams.rowsBetween(Window.unboundedPreceding, 0)))
    merged = found.groupBy(*keys, "__chain").agg(*[F.first(n).alias(n) for n in names], F.max("n").alias("n"), *added)
    counted = merged.groupBy(*keys, *names, "__size").agg(F.sum("n").alias("n"), *summed)
    shown = [F.col(n).alias(c) for n, c in zip((*names, *totals), (*label, *sums))]
    return counted.select(*keys, F.col("__size").alias("size"), "n", *shown)


def asof_join(
    probes: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    probe_time: str,
    fact_time: str,
    bucket,
    payload: Sequence[str],
    out: str = "found",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Last fact at or before each probe, per key, as a struct ``out`` (NULL when there is none).

    Probes and facts are stacked on one time axis instead of joined by inequality, so a key with
    many facts costs a sort of its buckets and never a product. ``bucket`` maps a time column to its
    bucket. Of facts with one time in a key the last by the columns ``tie``, then by the payload, counts (NULL first).
    """
    extra = [c for c in probes.columns if c not in (*keys, probe_time)]
    stacked_probes = probes.select(
        *keys,
        F.col(probe_time).alias("__t"),
        F.lit(1).alias("__kind"),
        F.struct(*extra).alias("__probe") if extra else F.struct(F.lit(1)).alias("__probe"),
    )
    fact_struct = F.struct(*[F.col(c) for c in payload])
    stacked_facts = facts.select(
        *keys,
        F.col(fact_time).alias("__t"),
        F.lit(0).alias("__kind"),
        F.struct(*[F.col(c) for c in dict.fromkeys((*tie, *payload))]).alias("__tie"),
        fact_struct.alias("__fact"),
    )
    axis = stacked_facts.unionByName(stacked_probes, allowMissingColumns=True)
    carried = carry_last(axis, keys, ["__t", "__kind", "__tie"], bucket(F.col("__t")), F.col("__fact"), out)
    return carried.filter(F.col("__kind") == 1).select(
        *keys,
        F.col("__t").alias(probe_time),
        *[F.col(f"__probe.{c}").alias(c) for c in extra],
        out,
    )
