"""Version history of sources: change-only intervals, known-at lookup, anomalies, merge, states.

Snapshots are rows (source_id, seq, observed_at, sha256, ...) in observation order. All look-backs
go through :mod:`ordered`, so one source may own a large part of the history. ``every`` is the bucket
width: in seconds when time leads the order, measured on the data if not given; otherwise in steps of
the leading sequence number, which is unique and so bounds a bucket by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timeaxis import instant_to_utc, second_index
from .ordered import BUCKET_ROWS, around, asof_join, bucket_seconds, lag_of, lead_of, numbered

KEY = ["source_id"]
# Revision policies under which an earlier state need not be archived.
NOT_ARCHIVED_POLICIES = ("immutable", "append_only")
KNOWN_POLICIES = ("immutable", "append_only", "revisable", "unknown")


def _width(df: DataFrame, order: Sequence[str], time: str, every: int | None) -> int:
    if every is not None:
        return every
    return bucket_seconds(df, KEY, time) if order[0] == time else BUCKET_ROWS


def _bucket(order: Sequence[str], time: str, every: int) -> Column:
    """Bucket that follows the ordering: by time when time leads it, else by sequence number."""
    lead = second_index(time) if order[0] == time else F.col(order[0])
    return F.floor(lead / every).cast("bigint")


def changes(
    snapshots: DataFrame, order: Sequence[str], time: str = "observed_at", sha: str = "sha256", every: int | None = None
) -> DataFrame:
    """Rows whose hash differs from the source's last known one.

    Compared with the last version only: A, B, A opens three versions. Rows without a hash are
    ignored, not taken for a change.
    """
    known = snapshots.filter(F.col(sha).isNotNull())
    bucket = _bucket(order, time, _width(known, order, time, every))
    prev = lag_of(known, KEY, order, bucket, [sha, time], "prev")
    changed = F.col("prev").isNull() | (F.col(f"prev.{sha}") != F.col(sha))
    return prev.filter(changed).drop("prev")


def intervals(
    snapshots: DataFrame, order: Sequence[str], time: str = "observed_at", sha: str = "sha256", every: int | None = None
) -> DataFrame:
    """Half-open intervals ``[first_observed_at, superseded_at)``; the last one stays open."""
    every = _width(snapshots, order, time, every)
    opened = changes(snapshots, order, time, sha, every)
    chained = lead_of(opened, KEY, order, _bucket(order, time, every), [time], "next")
    return chained.withColumn("first_observed_at", F.col(time)).withColumn(
        "superseded_at", F.col(f"next.{time}")
    ).drop("next")


def known_at(versions: DataFrame, lookups: DataFrame, payload: Sequence[str], every: int | None = None) -> DataFrame:
    """Version held by each (source_id, at) lookup: a struct ``found``, NULL when nothing was held.

    Start included, end excluded: a version replaced at the instant it appeared was never held. Of versions that
    begin together the one that ends last counts. Presence of bytes is a column of the version, not a condition.
    """
    cols = list(dict.fromkeys([*payload, "first_observed_at", "superseded_at"]))
    if every is None:
        every = min(bucket_seconds(versions, KEY, "first_observed_at"), bucket_seconds(lookups, KEY, "at"))
    lasting = versions.filter(F.col("superseded_at").isNull() | (F.col("superseded_at") > F.col("first_observed_at")))
    held = asof_join(
        lookups,
        lasting.withColumns({"__open": F.col("superseded_at").isNull(), "__end": F.col("superseded_at")}),
        KEY,
        "at",
        "first_observed_at",
        lambda t: F.floor(second_index(t) / every).cast("bigint"),
        cols,
        tie=["__open", "__end"],
    )
    over = F.col("found.superseded_at") <= F.col("at")
    return held.withColumn("found", F.when(F.coalesce(~over, F.lit(True)), F.col("found")))


def utc_instant(text: Column) -> Column:
    """ISO 8601 text with a zone to a UTC zone-less instant; a text without a zone is refused."""
    zoned = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    instant = instant_to_utc(text.cast("timestamp"))
    return F.when(zoned, instant).when(text.isNull(), None).otherwise(
        F.raise_error(F.concat(F.lit("instant without a time zone: "), text)).cast("timestamp_ntz")
    )


def anomalies(
    snapshots: DataFrame,
    order: Sequence[str],
    time: str = "observed_at",
    sha: str = "sha256",
    collected: str | None = None,
    every: int | None = None,
) -> DataFrame:
    """Inverted and zero-width intervals (blocking), collection dates after the observation (not)."""
    every = _width(snapshots, order, time, every)
    opened = changes(snapshots, order, time, sha, every)
    chained = lag_of(opened, KEY, order, _bucket(order, time, every), [time], "before")
    kinds = [
        F.when(F.col(time) < F.col(f"before.{time}"), F.lit("inverted")),
        F.when(F.col(time) == F.col(f"before.{time}"), F.lit("zero_width")),
    ]
    if collected:
        kinds.append(F.when(F.col(collected) > F.col(time).cast("date"), F.lit("collected_later")))
    return (
        chained.withColumn("kind", F.explode(F.array_compact(F.array(*kinds))))
        .withColumn("blocking", F.col("kind").isin("inverted", "zero_width"))
        .drop("before")
    )


def disappearances(snapshots: DataFrame, snapshot: str) -> DataFrame:
    """Per source, the snapshots after its first sight in which it is absent.

    Counted, not listed: snapshots since the first sight less snapshots it is in.
    """
    pairs = snapshots.select(*KEY, snapshot).distinct()
    axis = numbered(pairs.select(snapshot).distinct(), [snapshot], "__no")
    last = axis.agg(F.count("*")).scalar()
    seen = pairs.groupBy(*KEY).agg(F.min(snapshot).alias(snapshot), F.count("*").alias("n_present"))
    return (
        seen.join(axis, snapshot)
        .withColumn("n_absent", last - F.col("__no") + 1 - F.col("n_present"))
        .drop("__no")
    )


def merge_history(live: DataFrame, rebuilt: DataFrame, sha: str = "sha256", every: int | None = None) -> DataFrame:
    """Rebuilt versions placed in front of the live registry, which is never rewritten.

    A rebuilt version that starts at or after the live registry is left out. When the last one kept
    carries the hash of the first live version the two are one: the live start moves back. Otherwise
    it ends where the live registry begins. Both tables: source_id, sha, first_observed_at,
    superseded_at; the versions of a table begin at different instants. The two are stacked on one time axis, where
    each version sees its neighbours, so a source with a long history is neither gathered nor joined.
    """
    time = "first_observed_at"
    cols = [*KEY, sha, time, "superseded_at"]
    stacked = live.select(*cols, F.lit(True).alias("__live")).unionByName(rebuilt.select(*cols, F.lit(False).alias("__live")))
    instants = "timestamp" in stacked.schema[time].dataType.typeName()
    if every is None:
        every = bucket_seconds(stacked, KEY, time) if instants else BUCKET_ROWS
    bucket = F.floor((second_index(time) if instants else F.col(time)) / every).cast("bigint")
    # at one instant the live version comes first, and leaves the rebuilt one out
    stacked = stacked.withColumn("__rank", (~F.col("__live")).cast("int"))
    mark = F.when(F.col("__live"), True)
    near = around(stacked, KEY, [time, "__rank"], bucket, [sha, time, "__live"], {"__begun": mark})
    first_live = F.col("__live") & F.col("__begun").isNull()
    last_kept = ~F.col("__live") & F.coalesce(F.col("next.__live"), F.lit(False))
    moves = first_live & F.col("prev").isNotNull() & (F.col(f"prev.{sha}") == F.col(sha))
    absorbed = last_kept & F.coalesce(F.col(f"next.{sha}") == F.col(sha), F.lit(False))
    return near.filter(F.col("__live") | (F.col("__begun").isNull() & ~absorbed)).select(
        *KEY,
        sha,
        F.when(moves, F.col(f"prev.{time}")).otherwise(F.col(time)).alias(time),
        F.when(last_kept, F.col(f"next.{time}")).otherwise(F.col("superseded_at")).alias("superseded_at"),
        F.when(F.col("__live"), "live").otherwise("rebuilt").alias("origin"),
    )


def states(versions: DataFrame) -> DataFrame:
    """Adds four answers that may hold together: ``pending`` (what remains to be uploaded), ``current_without_bytes``,
    ``lost`` and ``never_held``.

    Expects payload_archived, payload_key, superseded_at, origin and ``copy_intact`` (the served copy
    still has the certified bytes).
    """
    missing = ~F.col("payload_archived") & F.col("payload_key").isNotNull()
    intact, current = F.coalesce("copy_intact", F.lit(False)), F.col("superseded_at").isNull()
    return versions.withColumns(
        {
            "pending": missing & intact,
            "current_without_bytes": missing & current,
            "lost": missing & ~current & ~intact,
            "never_held": F.coalesce(F.col("origin") == "rebuilt", F.lit(False)),
        }
    )


def archived_volume(versions: DataFrame, size: str = "size") -> DataFrame:
    return versions.agg(
        F.coalesce(F.sum(F.when(F.col("payload_archived"), F.coalesce(F.col(size), F.lit(0)))), F.lit(0)).alias("bytes")
    )


def keeps_versions(flag: Column, rolling: Column, policy: Column) -> Column:
    """Explicit flag first; otherwise rolling sources, unless their policy makes it useless."""
    known = F.when(policy.isin(*KNOWN_POLICIES), policy).otherwise("unknown")
    return F.coalesce(flag, F.coalesce(rolling, F.lit(False)) & ~known.isin(*NOT_ARCHIVED_POLICIES))


def restore_candidates(versions: DataFrame, expected: DataFrame, sha: str = "sha256") -> DataFrame:
    """Archived versions that may hold the wanted bytes, with ``other_hash`` (0 = the wanted hash).

    They are tried in the order (other_hash, newest first).
    """
    return (
        versions.filter(F.col("payload_archived") & F.col("payload_key").isNotNull())
        .join(expected.select(*KEY, F.col(sha).alias("expected_sha")), KEY)
        .withColumn("other_hash", (~F.col(sha).eqNullSafe(F.col("expected_sha"))).cast("int"))
    )


def restore_first(
    versions: DataFrame, expected: DataFrame, newest: Sequence[str], sha: str = "sha256"
) -> DataFrame:
    """Per source: number of candidates and the one to try first, by aggregation alone."""
    held = versions.filter(F.col("payload_archived") & F.col("payload_key").isNotNull())
    payload = F.struct(*[F.col(c) for c in versions.columns if c not in KEY])
    # what is wanted is stacked below what is held: equal hashes meet by aggregation, not by a join on the source
    asked = expected.select(*KEY, F.col(sha).alias("__sha"), F.lit(True).alias("__asked"))
    rows = held.select(*KEY, F.col(sha).alias("__sha"), F.struct(*newest).alias("__newest"), payload.alias("__payload"))
    by_hash = (
        rows.unionByName(asked, allowMissingColumns=True)
        .groupBy(*KEY, "__sha")
        .agg(
            F.count("__newest").alias("n"),
            F.max_by("__payload", "__newest").alias("__payload"),
            F.max("__newest").alias("__newest"),
            F.coalesce(F.max("__asked"), F.lit(False)).alias("__asked"),
        )
    )
    preference = F.when(F.col("n") > 0, F.struct("__asked", "__newest"))
    return (
        by_hash.groupBy(*KEY)
        .agg(
            F.sum("n").alias("n_candidates"),
            F.sum(F.when(F.col("__asked"), F.col("n")).otherwise(0)).alias("n_same_hash"),
            F.max_by("__payload", preference).alias("first"),
            F.max("__asked").alias("__wanted"),
        )
        .filter((F.col("n_candidates") > 0) & F.col("__wanted"))
        .drop("__wanted")
    )


def grouped_manifest(manifest: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Count of entries and sorted distinct items per group (duplicates removed before gathering)."""
    counts = manifest.groupBy(*keys, item).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(
        F.sum("__n").alias("n"), F.array_sort(F.collect_list(item)).alias("items")
    )
