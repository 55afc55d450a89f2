"""Version-history queries on the event stream read as source observations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import query
from .base import VS, snapshots, table, ts_sql
from ..functions import timeaxis as T
from ..functions.numeric import cents
from ..operators import quality, versions
from ..operators.ordered import bucket_seconds
from ..session import cut_lineage, shared_folder
from ..streaming.snapshots import Feed

ORDER = ["observed_at", "seq"]


def _text(c):
    return T.as_text(c).alias(c)


def intervals(spark, sf):
    return versions.intervals(snapshots(spark, sf), ORDER).select(
        "source_id", "seq", "sha256", "size", "first_observed_at", "superseded_at"
    )


@query(f"WITH {VS} SELECT source_id, seq, sha256, {ts_sql('first_observed_at')} AS first_observed_at, {ts_sql('superseded_at')} AS superseded_at FROM IV")
def version_intervals(spark, sf):
    return intervals(spark, sf).select("source_id", "seq", "sha256", _text("first_observed_at"), _text("superseded_at"))


@query(f"""WITH {VS}, L AS (SELECT DISTINCT source_id, moment FROM VS, (VALUES (TIMESTAMP '2023-12-31 00:00:00'), (TIMESTAMP '2024-01-10 08:00:00'), (TIMESTAMP '2024-02-01 00:00:00')) t(moment)
UNION SELECT source_id, max(observed_at) FROM VS GROUP BY 1)
SELECT L.source_id, {ts_sql('L.moment')} AS moment, IV.seq, IV.sha256 FROM L LEFT JOIN IV ON IV.source_id = L.source_id AND IV.first_observed_at <= L.moment AND (IV.superseded_at IS NULL OR L.moment < IV.superseded_at)""")
def version_known_at(spark, sf):
    # the registry is read by both halves of the look-up: stored once, as a registry is
    held = cut_lineage(intervals(spark, sf))
    at = [F.lit(t).cast("timestamp_ntz") for t in ("2023-12-31 00:00:00", "2024-01-10 08:00:00", "2024-02-01 00:00:00")]
    # every source is looked up at three moments and at its own last observation
    sources = snapshots(spark, sf).groupBy("source_id").agg(F.max("observed_at").alias("last"))
    lookups = sources.select("source_id", F.explode(F.array_distinct(F.array(*at, F.col("last")))).alias("at"))
    found = versions.known_at(held, lookups, ["seq", "sha256"])
    return found.select("source_id", T.as_text("at").alias("moment"), "found.seq", "found.sha256")


@query(f"""WITH {VS}, Q AS (SELECT *, observed_at - CAST(CASE WHEN seq % 97 = 0 THEN 5 ELSE 0 END AS INTEGER) * INTERVAL 1 DAY AS seen,
  CAST(observed_at AS DATE) + CAST(CASE WHEN seq % 89 = 0 THEN 1 ELSE 0 END AS INTEGER) AS collected FROM VS),
C AS (SELECT * FROM (SELECT *, lag(sha256) OVER (PARTITION BY source_id ORDER BY seq) AS b FROM Q) WHERE b IS NULL OR b <> sha256),
N AS (SELECT *, lag(seen) OVER (PARTITION BY source_id ORDER BY seq) AS s FROM C),
A AS (SELECT source_id, CASE WHEN seen < s THEN 'inverted' ELSE 'zero_width' END AS kind FROM N WHERE seen <= s
  UNION ALL SELECT source_id, 'collected_later' FROM N WHERE collected > CAST(seen AS DATE))
SELECT source_id, kind, kind IN ('inverted', 'zero_width') AS blocking, count(*) AS n FROM A GROUP BY 1, 2""")
def version_anomalies(spark, sf):
    late = F.when(F.col("seq") % 97 == 0, 5).otherwise(0)
    shifted = snapshots(spark, sf).select(
        "source_id",
        "seq",
        "sha256",
        T.plus_hours("observed_at", -24 * late).alias("observed_at"),
        F.date_add(F.col("observed_at").cast("date"), F.when(F.col("seq") % 89 == 0, 1).otherwise(0)).alias("collected"),
    )
    found = versions.anomalies(shifted, ["seq"], collected="collected")
    return found.groupBy("source_id", "kind", "blocking").agg(F.count("*").alias("n"))


@query(f"""WITH {VS}, P AS (SELECT DISTINCT source_id, CAST(observed_at AS DATE) AS day FROM VS), S AS (SELECT DISTINCT day FROM P),
F AS (SELECT source_id, min(day) AS first_day, count(*) AS n_present FROM P GROUP BY 1)
SELECT source_id, n_present, (SELECT count(*) FROM S WHERE S.day >= F.first_day) - n_present AS n_absent FROM F""")
def version_disappearances(spark, sf):
    daily = snapshots(spark, sf).select("source_id", F.col("observed_at").cast("date").alias("snapshot"))
    return versions.disappearances(daily, "snapshot").select("source_id", "n_present", "n_absent")


_CHAIN = """SELECT source_id, sha256, observed_at AS a, lead(observed_at) OVER (PARTITION BY source_id ORDER BY observed_at, seq) AS z
  FROM (SELECT *, lag(sha256) OVER (PARTITION BY source_id ORDER BY observed_at, seq) AS b FROM VS WHERE {0}) WHERE b IS NULL OR b <> sha256"""


@query(f"""WITH {VS}, RB AS ({_CHAIN.format("observed_at < TIMESTAMP '2024-01-18'")}), LV AS ({_CHAIN.format("observed_at >= TIMESTAMP '2024-01-15'")}),
LS AS (SELECT source_id, min(a) AS ls, arg_min(sha256, a) AS lsha FROM LV GROUP BY 1),
BF AS (SELECT RB.*, ls, lsha FROM RB LEFT JOIN LS USING (source_id) WHERE ls IS NULL OR a < ls),
LB AS (SELECT source_id, max(a) AS la, arg_max(sha256, a) AS lasha FROM BF GROUP BY 1),
KB AS (SELECT BF.source_id, sha256, a, CASE WHEN a = la AND ls IS NOT NULL THEN ls ELSE z END AS z, 'rebuilt' AS origin FROM BF JOIN LB USING (source_id) WHERE NOT coalesce(a = la AND lasha = lsha, false)),
ML AS (SELECT LV.source_id, sha256, CASE WHEN a = ls AND lasha = lsha THEN la ELSE a END AS a, z, 'live' AS origin FROM LV JOIN LS USING (source_id) LEFT JOIN LB USING (source_id)),
U AS (SELECT * FROM KB UNION ALL SELECT * FROM ML)
SELECT source_id, sha256, {ts_sql('a')} AS first_observed_at, {ts_sql('z')} AS superseded_at, origin FROM U""")
def version_merge(spark, sf):
    cut, live_from = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-18", "2024-01-15"))
    seen = snapshots(spark, sf)
    every = bucket_seconds(seen, versions.KEY, "observed_at")
    rebuilt = versions.intervals(seen.filter(F.col("observed_at") < cut), ORDER, every=every)
    live = versions.intervals(seen.filter(F.col("observed_at") >= live_from), ORDER, every=every)
    merged = versions.merge_history(live, rebuilt, every=every)
    return merged.select("source_id", "sha256", _text("first_observed_at"), _text("superseded_at"), "origin")


_REG = """RG AS (SELECT *, seq % 3 = 0 AS payload_archived, CASE WHEN seq % 7 <> 1 THEN 'k' || seq END AS payload_key,
  CASE WHEN seq % 11 = 0 THEN 'rebuilt' ELSE 'live' END AS origin, seq % 5 = 0 AS copy_intact FROM IV)"""


def registry(spark, sf):
    seq = F.col("seq")
    return intervals(spark, sf).select(
        "*",
        (seq % 3 == 0).alias("payload_archived"),
        F.when(seq % 7 != 1, F.concat(F.lit("k"), seq.cast("string"))).alias("payload_key"),
        F.when(seq % 11 == 0, "rebuilt").otherwise("live").alias("origin"),
        (seq % 5 == 0).alias("copy_intact"),
    )


@query(f"""WITH {VS}, {_REG}, S AS (SELECT payload_archived AS archived, NOT payload_archived AND payload_key IS NOT NULL AND coalesce(copy_intact, false) AS pending,
NOT payload_archived AND payload_key IS NOT NULL AND superseded_at IS NULL AS current_without_bytes,
NOT payload_archived AND payload_key IS NOT NULL AND superseded_at IS NOT NULL AND NOT coalesce(copy_intact, false) AS lost,
coalesce(origin = 'rebuilt', false) AS never_held, size FROM RG)
SELECT archived, pending, current_without_bytes, lost, never_held, count(*) AS n, CAST(sum(CASE WHEN archived THEN size ELSE 0 END) AS BIGINT) AS archived_bytes FROM S GROUP BY ALL""")
def version_states(spark, sf):
    """How many versions there are of each combination of answers."""
    held = F.when(F.col("payload_archived"), F.col("size")).otherwise(0)
    answers = ("pending", "current_without_bytes", "lost", "never_held")
    return versions.states(registry(spark, sf)).groupBy(F.col("payload_archived").alias("archived"), *answers).agg(
        F.count("*").alias("n"), F.sum(held).cast("bigint").alias("archived_bytes")
    )


@query(f"""WITH {VS}, {_REG} SELECT CAST(coalesce(sum(size) FILTER (WHERE payload_archived), 0) AS BIGINT) AS bytes FROM RG""")
def archived_volume(spark, sf):
    return versions.archived_volume(registry(spark, sf))


@query("""WITH P AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 5 = 0 THEN p_size % 10 = 0 END AS flag, p_size % 2 = 0 AS rolling,
  CASE WHEN p_type = 'PROMO' THEN 'immutable' WHEN p_type = 'SMALL' THEN 'append_only' WHEN p_type = 'LARGE' THEN 'revisable' ELSE p_type END AS policy FROM part)
SELECT p_brand AS brand, count(*) AS n, count(*) FILTER (WHERE coalesce(flag, rolling AND policy NOT IN ('immutable', 'append_only'))) AS n_kept FROM P GROUP BY 1""")
def retention_policy(spark, sf):
    size, kind = F.col("p_size"), F.col("p_type")
    policy = F.when(kind == "PROMO", "immutable").when(kind == "SMALL", "append_only").when(kind == "LARGE", "revisable").otherwise(kind)
    kept = versions.keeps_versions(F.when(size % 5 == 0, size % 10 == 0), size % 2 == 0, policy)
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(
        F.count("*").alias("n"), F.count_if(kept).alias("n_kept")
    )


@query(f"""WITH {VS}, {_REG}, C AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY sha256 <> 'purchase', first_observed_at DESC, seq DESC) AS rk FROM RG WHERE payload_archived AND payload_key IS NOT NULL)
SELECT source_id, count(*) AS n_candidates, count(*) FILTER (WHERE sha256 = 'purchase') AS n_same_hash,
max(CASE WHEN rk = 1 THEN seq END) AS first_tried, max(CASE WHEN rk = 1 THEN sha256 END) AS first_sha FROM C GROUP BY 1""")
def restore_candidates(spark, sf):
    wanted = snapshots(spark, sf).select("source_id").distinct().withColumn("sha256", F.lit("purchase"))
    return versions.restore_first(registry(spark, sf), wanted, ["first_observed_at", "seq"]).select(
        "source_id", "n_candidates", "n_same_hash", F.col("first.seq").alias("first_tried"), F.col("first.sha256").alias("first_sha")
    )


@query("""SELECT p_brand AS brand, p_type AS kind, count(*) AS n, count(DISTINCT p_size) AS n_items, string_agg(DISTINCT lpad(CAST(p_size AS VARCHAR), 3, '0'), ',' ORDER BY lpad(CAST(p_size AS VARCHAR), 3, '0')) AS items
FROM part GROUP BY 1, 2""")
def grouped_manifest(spark, sf):
    entries = table(spark, sf, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.lpad(F.col("p_size").cast("string"), 3, "0").alias("item")
    )
    g = versions.grouped_manifest(entries, ["brand", "kind"], "item")
    return g.select("brand", "kind", "n", F.size("items").cast("bigint").alias("n_items"), F.array_join("items", ",").alias("items"))


@query("""WITH D AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, CAST(round(o_totalprice*100) AS BIGINT) AS price FROM orders WHERE o_orderdate < TIMESTAMP '2001-07-01'),
R AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS priority,
  CAST(round(o_totalprice*100) AS BIGINT) + (CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END) AS price FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01'),
J AS (SELECT coalesce(D.id, R.id) AS id, CASE WHEN D.id IS NULL THEN 'recorded_only' WHEN R.id IS NULL THEN 'declared_only' ELSE 'both' END AS presence,
  concat_ws(',', CASE WHEN D.status IS DISTINCT FROM R.status THEN 'status' END, CASE WHEN D.priority IS DISTINCT FROM R.priority THEN 'priority' END, CASE WHEN D.price IS DISTINCT FROM R.price THEN 'price' END) AS changed
  FROM D FULL JOIN R ON D.id = R.id)
SELECT * FROM J WHERE changed <> ''""")
def declared_vs_recorded_diff(spark, sf):
    key = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    price = cents("o_totalprice")
    declared = o.filter(F.col("o_orderdate") < F.lit("2001-07-01").cast("timestamp_ntz")).select(
        key.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), price.alias("price")
    )
    recorded = o.filter(F.col("o_orderdate") >= F.lit("1995-03-01").cast("timestamp_ntz")).select(
        key.alias("id"),
        F.when(key % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(key % 17 != 0, F.col("o_orderpriority")).alias("priority"),
        (price + F.when(key % 19 == 0, 1).otherwise(0)).alias("price"),
    )
    d = quality.changed_fields(declared, recorded, ["id"], ["status", "priority", "price"])
    return d.select("id", "presence", F.array_join("changed", ",").alias("changed"))


@query("""SELECT user_id, event_type AS latest_type, CAST(ts AS VARCHAR) AS observed_at FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1""")
def latest_attribute(spark, sf):
    latest = F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id"))
    return table(spark, sf, "events").groupBy("user_id").agg(latest.alias("l")).select(
        "user_id", F.col("l.event_type").alias("latest_type"), T.as_text("l.ts").alias("observed_at")
    )


@query("""WITH R AS (SELECT event_type AS series, event_id, CAST(ts AS DATE) - DATE '1970-01-01' + k AS taken, k, CAST(round(value*100) AS BIGINT) + k * (event_id % 3) AS c
  FROM events, range(0, 3) t(k)),
S AS (SELECT *, row_number() OVER (PARTITION BY series, event_id ORDER BY k DESC) AS rk, max(k) OVER (PARTITION BY series, event_id) AS top FROM R WHERE taken % 5 <> 0)
SELECT series, count(*) FILTER (WHERE rk = 1) AS n_readings, count(*) FILTER (WHERE rk = 1 AND k = 2) AS n_final,
CAST(sum(c) FILTER (WHERE rk = 1) AS BIGINT) AS cents, count(*) FILTER (WHERE rk > 1 AND (top = 2 OR k > 0)) AS n_superseded FROM S GROUP BY 1""")
def feed_newest_revision(spark, sf):
    """Readings come in snapshots of the day and of the two days after, revised each time; every fifth day has no
    snapshot. The stream meets the last snapshots first, then the first, then those between."""
    target = f"{shared_folder(spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    feed = Feed(spark, target, "series string, event_id bigint, ts timestamp_ntz, taken int, c bigint", ["series", "event_id"], "ts", "taken")
    readings = table(spark, sf, "events").select(F.col("event_type").alias("series"), "event_id", "ts", cents("value").alias("first"))
    for k in (2, 0, 1):
        taken = F.unix_date(F.col("ts").cast("date")) + k
        snapshot = readings.select("series", "event_id", "ts", taken.alias("taken"), (F.col("first") + k * (F.col("event_id") % 3)).alias("c"))
        snapshot.filter("taken % 5 <> 0").write.mode("append").parquet(f"{target}/in")
        feed.ingest(f"{target}/in", f"{target}/checkpoint")
    final = F.col("taken") - F.unix_date(F.col("ts").cast("date")) == 2
    found = feed.current().groupBy("series").agg(
        F.count("*").alias("n_readings"), F.count_if(final).alias("n_final"), F.sum("c").alias("cents")
    )
    late = feed.late().filter("reason = 'superseded'").groupBy("series").agg(F.count("*").alias("n"))
    return found.join(late, "series", "left").select("series", "n_readings", "n_final", "cents", F.coalesce("n", F.lit(0)).alias("n_superseded"))
