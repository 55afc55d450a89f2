import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronowatt.operators import versions as V

T0 = dt.datetime(2026, 1, 1)


def snaps(spark, rows):
    data = [(s, i, T0 + dt.timedelta(hours=h), sha) for i, (s, h, sha) in enumerate(rows)]
    return spark.createDataFrame(data, "source_id string, seq bigint, observed_at timestamp_ntz, sha256 string")


def chain(df):
    cols = ("source_id", "sha256", "first_observed_at", "superseded_at")
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def at(h):
    return T0 + dt.timedelta(hours=h)


def test_return_of_a_content_opens_a_third_version(spark):
    df = snaps(spark, [("s", 0, "A"), ("s", 5, "A"), ("s", 30, "B"), ("s", 100, "A"), ("n", 0, "Z"), ("n", 90, "Z")])
    for every in (3_600, 86_400, 10**9, None):
        got = chain(V.intervals(df, ["observed_at", "seq"], every=every))
        assert got == [("n", "Z", at(0), None), ("s", "A", at(0), at(30)), ("s", "A", at(100), None), ("s", "B", at(30), at(100))]


def test_missing_hash_is_no_change(spark):
    df = snaps(spark, [("s", 0, "A"), ("s", 1, None), ("s", 2, "A")])
    assert chain(V.intervals(df, ["observed_at", "seq"])) == [("s", "A", at(0), None)]


def test_known_at_is_half_open(spark):
    held = V.intervals(snaps(spark, [("s", 0, "A"), ("s", 30, "B")]), ["observed_at", "seq"])
    lookups = spark.createDataFrame(
        [("s", at(-1)), ("s", at(0)), ("s", at(29)), ("s", at(30)), ("s", at(900)), ("x", at(5))], "source_id string, at timestamp_ntz"
    )
    got = {(r.source_id, r["at"]): (r.found.sha256 if r.found else None) for r in V.known_at(held, lookups, ["sha256"]).collect()}
    assert got == {("s", at(-1)): None, ("s", at(0)): "A", ("s", at(29)): "A", ("s", at(30)): "B", ("s", at(900)): "B", ("x", at(5)): None}


def test_known_at_honours_a_closed_end(spark):
    held = spark.createDataFrame([("s", "A", at(0), at(10))], "source_id string, sha256 string, first_observed_at timestamp_ntz, superseded_at timestamp_ntz")
    lookups = spark.createDataFrame([("s", at(9)), ("s", at(10))], "source_id string, at timestamp_ntz")
    got = {r["at"]: r.found for r in V.known_at(held, lookups, ["sha256"]).collect()}
    assert got[at(9)].sha256 == "A" and got[at(10)] is None


@pytest.mark.parametrize("reverse", [False, True])
def test_known_at_with_equal_starts(spark, reverse):
    """A version replaced at the instant it appeared was never held; of two that begin together the longer counts."""
    rows = [("s", "A", at(0), at(10)), ("s", "B", at(10), at(10)), ("s", "C", at(10), None), ("t", "D", at(0), at(5)), ("t", "E", at(0), at(9))]
    schema = "source_id string, sha256 string, first_observed_at timestamp_ntz, superseded_at timestamp_ntz"
    held = spark.createDataFrame(rows[::-1] if reverse else rows, schema)
    lookups = spark.createDataFrame([("s", at(9)), ("s", at(10)), ("s", at(20)), ("t", at(7)), ("t", at(9))], "source_id string, at timestamp_ntz")
    got = {(r.source_id, r["at"]): (r.found.sha256 if r.found else None) for r in V.known_at(held, lookups, ["sha256"]).collect()}
    assert got == {("s", at(9)): "A", ("s", at(10)): "C", ("s", at(20)): "C", ("t", at(7)): "E", ("t", at(9)): None}


def test_states_overlap(spark):
    schema = "id int, payload_archived boolean, payload_key string, superseded_at timestamp_ntz, origin string, copy_intact boolean"
    rows = [(1, False, "k", at(1), "rebuilt", True), (2, True, "k", None, "rebuilt", True), (3, False, "k", None, "live", False), (4, False, "k", at(1), "live", None), (5, False, None, None, "live", True)]
    got = {r["id"]: (r["pending"], r["current_without_bytes"], r["lost"], r["never_held"]) for r in V.states(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (True, False, False, True), 2: (False, False, False, True), 3: (False, True, False, False), 4: (False, False, True, False), 5: (False,) * 4}


def test_lookup_text_needs_a_zone(spark, session_zone):
    df = spark.createDataFrame([("2026-01-01T10:00:00.250+02:00",), ("2026-01-01T08:00:00Z",)], "s string")
    got = [str(r[0]) for r in df.select(V.utc_instant(F.col("s"))).collect()]
    assert got == ["2026-01-01 08:00:00.250000", "2026-01-01 08:00:00"]
    with pytest.raises(Exception, match="without a time zone"):
        spark.createDataFrame([("2026-01-01T10:00:00",)], "s string").select(V.utc_instant(F.col("s"))).collect()


def test_blocking_anomalies(spark):
    rows = [("i", 10, "A"), ("i", 5, "B"), ("z", 7, "A"), ("z", 7, "B"), ("c", 0, "A")]
    df = snaps(spark, rows).withColumn(
        "collected", F.when(F.col("source_id") == "c", F.lit("2026-01-02")).otherwise(F.lit("2026-01-01")).cast("date")
    )
    got = {(r.source_id, r.kind, r.blocking) for r in V.anomalies(df, ["seq"], collected="collected").collect()}
    assert got == {("i", "inverted", True), ("z", "zero_width", True), ("c", "collected_later", False)}


def test_disappearances(spark):
    days = [("a", 1), ("a", 2), ("a", 4), ("b", 2), ("b", 3), ("b", 4), ("c", 1), ("c", 4)]
    df = spark.createDataFrame(days + days[:1], "source_id string, snapshot int")
    got = {r.source_id: (r.n_present, r.n_absent) for r in V.disappearances(df, "snapshot").collect()}
    assert got == {"a": (3, 1), "b": (3, 0), "c": (2, 2)}


def brute_merge(live, rebuilt):
    out = {}
    for s in {*live, *rebuilt}:
        new, old = [dict(v) for v in live.get(s, [])], [dict(v) for v in rebuilt.get(s, [])]
        if new:
            start = new[0]["a"]
            old = [v for v in old if v["a"] < start]
            if old and old[-1]["sha"] == new[0]["sha"]:
                new[0]["a"] = old.pop()["a"]
                start = new[0]["a"]
            if old:
                old[-1]["z"] = start
        out[s] = old + new
    return out


def test_merge_equals_sequential_rule(spark):
    rng = random.Random(11)

    def make(first, last):
        history = {}
        for s in "abcdefgh":
            if rng.random() < 0.2:
                continue
            hours = sorted(rng.sample(range(first, last), rng.randrange(1, 6)))
            versions, previous = [], None
            for h in hours:
                sha = rng.choice([x for x in "XYZ" if x != previous])
                previous = sha
                versions.append({"sha": sha, "a": h, "z": None})
            for v, w in zip(versions, versions[1:]):
                v["z"] = w["a"]
            history[s] = versions
        return history

    schema = "source_id string, sha256 string, first_observed_at int, superseded_at int"
    flat = lambda h: [(s, v["sha"], v["a"], v["z"]) for s, vs in h.items() for v in vs]
    for _ in range(4):
        rebuilt, live = make(0, 60), make(40, 100)
        got = V.merge_history(spark.createDataFrame(flat(live), schema), spark.createDataFrame(flat(rebuilt), schema))
        rows = sorted(map(str, (tuple(r)[:4] for r in got.select("source_id", "sha256", "first_observed_at", "superseded_at").collect())))
        assert rows == sorted(map(str, flat(brute_merge(live, rebuilt))))


def test_states(spark):
    rows = [
        ("kept", True, "k", None, "live", False), ("now", False, "k", None, "live", False),
        ("retry", False, "k", 5, "live", True), ("gone", False, "k", 5, "live", False),
        ("never", False, None, 5, "rebuilt", False),
    ]
    df = spark.createDataFrame(rows, "id string, payload_archived boolean, payload_key string, superseded_at int, origin string, copy_intact boolean")
    got = {r.id: {n for n in ("pending", "current_without_bytes", "lost", "never_held") if r[n]} for r in V.states(df).collect()}
    assert got == {"kept": set(), "now": {"current_without_bytes"}, "retry": {"pending"}, "gone": {"lost"}, "never": {"never_held"}}


def test_volume_and_policy(spark):
    df = spark.createDataFrame([(True, 5), (True, None), (False, 9)], "payload_archived boolean, size int")
    assert V.archived_volume(df).first()[0] == 5
    rows = [(None, True, "unknown"), (None, True, "immutable"), (None, True, "append_only"), (None, False, "revisable"), (True, False, "immutable"), (False, True, "revisable"), (None, None, None)]
    d = spark.createDataFrame(rows, "flag boolean, rolling boolean, policy string")
    assert [r[0] for r in d.select(V.keeps_versions(F.col("flag"), F.col("rolling"), F.col("policy"))).collect()] == [True, False, False, False, True, False, False]


def test_restore_order(spark):
    rows = [("s", "A", 1, True, "k1"), ("s", "B", 2, True, "k2"), ("s", "A", 3, False, "k3"), ("s", "C", 4, True, None)]
    df = spark.createDataFrame(rows, "source_id string, sha256 string, seq int, payload_archived boolean, payload_key string")
    first = lambda sha: V.restore_first(df, spark.createDataFrame([("s", sha)], "source_id string, sha256 string"), ["seq"]).first()
    assert (first("A")["first"].payload_key, first("A").n_candidates, first("A").n_same_hash) == ("k1", 2, 1)
    assert first("Z")["first"].payload_key == "k2"  # newest first when no hash is the wanted one
