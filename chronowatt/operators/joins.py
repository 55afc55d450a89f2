"""Reconciliation and proximity joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import haversine_km
from ..session import cut_lineage

BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32 << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after counting the rows (never more than ``limit`` + 1 of them) and their bytes as text.

    A larger side is left to Spark, which joins by shuffle and splits hot partitions.
    """
    text = F.octet_length(F.to_json(F.struct("*"))) if df.columns else F.lit(0)
    rows, taken = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(text), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and taken <= size else df


def reconcile(a: DataFrame, b: DataFrame, key: Sequence[str], value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Largest and mean absolute difference of two channels on the keys they share."""
    joined = a.select(*key, F.col(value).alias("__a")).join(b.select(*key, F.col(value).alias("__b")), list(key))
    gap = F.abs(F.col("__a") - F.col("__b"))
    return joined.groupBy(*groups).agg(
        F.count("*").alias("n"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap")
    )


# The globe lies in a cube, which is cut in four along each axis, and so on: cells of 13 m at the deepest level.
_SPLIT_BITS, _DEEPEST = 2, 10
_CUBE = 2.1
_AXES = ("cx", "cy", "cz")


def _on_sphere(df: DataFrame) -> list[Column]:
    """Coordinates of a point (columns ``lat`` and ``lon``) on the unit sphere."""
    lat, lon = F.radians("lat"), F.radians("lon")
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def _deepest_cell(df: DataFrame) -> list[Column]:
    side = 1 << _SPLIT_BITS * _DEEPEST
    return [F.floor((c / _CUBE + 0.5) * side).cast("bigint").alias(n) for c, n in zip(_on_sphere(df), _AXES)]


def _all_levels(cells: DataFrame) -> DataFrame:
    """Each row once for every level, with its cell there."""
    rows = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(_DEEPEST))))
    return rows.withColumns({a: F.expr(f"shiftright({a}, {_SPLIT_BITS} * ({_DEEPEST} - level))") for a in _AXES})


def _nearest_cells(cells: DataFrame, point: str, k: int) -> DataFrame:
    """Rows of (point, cell) without the cells that can't hold one of the k nearest: those that begin farther away than
    cells with k targets end."""
    size = _CUBE / F.pow(F.lit(float(1 << _SPLIT_BITS)), F.col("level"))
    least, most = F.lit(0.0), F.lit(0.0)
    for at, axis in zip(("__x", "__y", "__z"), _AXES):
        begin = F.col(axis) * size - _CUBE / 2
        below, above = begin - F.col(at), F.col(at) - begin - size
        least = least + F.pow(F.greatest(F.lit(0.0), below, above), 2)
        most = most + F.pow(F.greatest(-below, -above), 2)
    by_end = Window.partitionBy(point).orderBy("__most", "level", *_AXES).rowsBetween(Window.unboundedPreceding, 0)
    rows = cells.withColumn("__least", least).withColumn("__most", most)
    rows = rows.withColumn("__upto", F.when(F.sum("n").over(by_end) >= k, F.col("__most")))
    bound = F.min("__upto").over(Window.partitionBy(point))
    rows = rows.withColumn("__bound", bound).filter(F.col("__bound").isNull() | (F.col("__least") <= F.col("__bound") * (1 + 1e-9) + 1e-18))
    return rows.drop("__least", "__most", "__upto", "__bound")


def candidates(points: DataFrame, targets: DataFrame, point_key: str, target_key: str, k: int, leaf: int = 16) -> DataFrame:
    """Pairs (point, target, distance_km) that hold the k nearest targets of every point.

    The targets are counted by cell on every level. A point starts at the widest cells and goes down the tree: all
    cells that hold more than ``leaf`` targets and can hold one of the nearest are replaced by the cells in them,
    round after round, so it comes close to no more cells than lie at the distance of its k-th target, however dense
    the targets are elsewhere. Then it meets the targets of its last cells.
    """
    homes = targets.select(target_key, F.col("lat").alias("__tlat"), F.col("lon").alias("__tlon"), *_deepest_cell(targets))
    homes = homes.filter(F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("cz").isNotNull())
    nodes = cut_lineage(
        _all_levels(homes.groupBy(*_AXES).agg(F.count("*").alias("n"))).groupBy("level", *_AXES).agg(F.sum("n").alias("n"))
    )
    p = points.select(
        point_key,
        F.col("lat").alias("__plat"),
        F.col("lon").alias("__plon"),
        *[c.alias(n) for c, n in zip(_on_sphere(points), ("__x", "__y", "__z"))],
    ).filter(F.col("__x").isNotNull() & F.col("__z").isNotNull())
    # the one cell of level 0
    rows = p.crossJoin(F.broadcast(nodes.filter("level = 0")))
    inner = nodes.filter("level > 0").select(
        *[F.shiftright(a, _SPLIT_BITS).alias(f"p{a}") for a in _AXES], (F.col("level") - 1).alias("plevel"),
        *[F.col(a).alias(f"n{a}") for a in _AXES], F.col("n").alias("nn"),
    )
    for level in range(_DEEPEST):
        wide = (F.col("level") == level) & (F.col("n") > leaf)
        if rows.filter(wide).isEmpty():
            break
        under = inner.filter(F.col("plevel") == level)
        down = rows.filter(wide).join(under, [F.col(a) == F.col(f"p{a}") for a in _AXES])
        down = down.select(
            point_key, "__plat", "__plon", "__x", "__y", "__z", (F.col("level") + 1).alias("level"),
            *[F.col(f"n{a}").alias(a) for a in _AXES], F.col("nn").alias("n"),
        )
        rows = cut_lineage(_nearest_cells(rows.filter(~wide).unionByName(down), point_key, k))
    met = rows.join(_all_levels(homes), ["level", *_AXES])
    distance = haversine_km(F.col("__plat"), F.col("__plon"), F.col("__tlat"), F.col("__tlon"))
    return met.select(point_key, target_key, distance.alias("distance_km"))


def nearest_k(points: DataFrame, targets: DataFrame, point_key: str, target_key: str, k: int, leaf: int = 16) -> DataFrame:
    """The k nearest targets of every point (columns ``lat`` and ``lon`` on both sides), exactly: point, target,
    distance_km and rank; ties by target. Points and targets without a position have no neighbours."""
    by_distance = Window.partitionBy(point_key).orderBy("distance_km", target_key)
    pairs = candidates(points, targets, point_key, target_key, k, leaf)
    return pairs.withColumn("rank", F.row_number().over(by_distance)).filter(F.col("rank") <= k)
