"""Fingerprints: share kept, containment, merging, the next document, edge cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chronowatt.llm import fingerprints as fp

WORDS = [f"w{i}" for i in range(5_000)]


def text(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_keeps_the_stated_share_of_all_hashes(spark):
    rnd = random.Random(1)
    row = frame(spark, [(1, text(rnd, 40_000))]).select(
        fp.fingerprint(F.col("text")).alias("f"), fp.fingerprint(F.col("text"), fraction=1.0).alias("all")
    ).first()
    assert len(row["all"]) == 39_996 and row["all"] == sorted(row["all"])
    limit = -(1 << 63) + (1 << 61)
    assert row["f"] == [h for h in row["all"] if h < limit]
    assert len(row["f"]) == pytest.approx(5_000, rel=0.1)


def test_estimates_of_likeness_and_containment_of_unequal_texts(spark):
    rnd = random.Random(2)
    big = text(rnd, 8_000)
    small = " ".join(big.split()[1_000:2_000])
    other = text(rnd, 1_000)
    mixed = f"{small} {other}"
    pairs = [(small, big), (big, small), (mixed, big), (small, mixed), (other, big)]
    docs = spark.createDataFrame(pairs, "a string, b string")
    docs = docs.select("a", "b", fp.fingerprint(F.col("a")).alias("x"), fp.fingerprint(F.col("b")).alias("y"))
    for r in docs.select("a", "b", fp.likeness(F.col("x"), F.col("y")).alias("l"), fp.containment(F.col("x"), F.col("y")).alias("c")).collect():
        a, b = shingles(r["a"]), shingles(r["b"])
        assert r["l"] == pytest.approx(len(a & b) / len(a | b), abs=0.1)
        assert r["c"] == pytest.approx(len(a & b) / len(a), abs=0.12)


def test_fingerprint_of_a_union_is_the_union(spark):
    rnd = random.Random(3)
    a, b = text(rnd, 900), text(rnd, 900)
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        fp.merged(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("m"), fp.fingerprint(F.concat_ws(" ", "a", "b")).alias("u")
    ).first()
    # the joined text has four runs more, across the seam
    assert set(row["m"]) <= set(row["u"]) and len(row["u"]) - len(row["m"]) <= 4


def test_union_and_containment_of_short_texts(spark):
    """Texts of five and six words, of which mostly no hash is kept: nothing that stands in for one is merged."""
    rnd = random.Random(6)
    pairs = [(text(rnd, rnd.choice([5, 6])), text(rnd, rnd.choice([5, 6, 80]))) for _ in range(200)]
    f = lambda c: fp.fingerprint(F.col(c))
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", f("a").alias("x"), f("b").alias("y"), fp.fingerprint(F.concat_ws(" ", "a", "b")).alias("u"),
    ).select("*", fp.merged(F.col("x"), F.col("y")).alias("m"), fp.containment(F.col("x"), F.col("y")).alias("c")).collect()
    limit, unknown = -(1 << 63) + (1 << 61), 0
    for r in rows:
        assert all(h < limit for h in r["m"])
        # what the joined text keeps beyond its parts lies across the seam
        low = {h for h in r["u"] if h < limit}
        assert set(r["m"]) <= low and len(low) - len(r["m"]) <= 4
        own = [h for h in r["x"] if h < limit]
        unknown += not own
        assert (r["c"] is None) == (not own) and (r["c"] is None or r["c"] == len(set(own) & set(r["y"])) / len(own))
    assert unknown > 100


@pytest.mark.parametrize("ids", [list(range(50)), [i * i * i * 10**12 for i in range(-40, 40)], [0], [-(1 << 63), (1 << 63) - 1, 5], [10**15 + i for i in range(300)]])
def test_next_document_in_descending_order(spark, ids, monkeypatch):
    monkeypatch.setattr(fp, "_ROWS", 8)
    docs = frame(spark, [(i, f"text of {i}") for i in ids])
    got = {r["doc_id"]: r["next_text"] for r in fp.with_next(docs).collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: f"text of {b}" for a, b in zip(down, down[1:] + down[:1])}


def test_next_of_repeated_and_missing_ids(spark):
    rows = [(3, "three"), (3, "three"), (2, "two"), (None, "none"), (None, "other")]
    got = fp.with_next(frame(spark, rows)).collect()
    assert len(got) == 5
    followers = sorted(r["next_text"] for r in got)
    # a circle through all rows; the last guest may stand for either of two equal rows
    assert followers == sorted(t for _, t in rows)
    assert [r["next_text"] for r in got if r["doc_id"] == 2][0] in ("none", "other")


def query(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return fp.op5_fingerprints(spark, str(tmp_path)).collect()


def test_query_by_hand(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(1, text(rnd, 200)), (2, None), (5, "été à la mer"), (7, ""), (9, text(rnd, 31)), (10, text(rnd, 400)), (11, "x " * 30_000)]
    got = {r["doc_id"]: r for r in query(spark, tmp_path, rows)}
    down = sorted(rows, reverse=True)
    for (i, t), (_, after) in zip(down, down[1:] + down[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[2]["fingerprint"] == got[7]["fingerprint"] == ""


def test_equal_texts_have_equal_fingerprints_and_no_rows_give_none(spark, tmp_path):
    got = query(spark, tmp_path / "a", [(1, "the same text stands here twice or so"), (2, "the same text stands here twice or so")])
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != "" and got[0]["near_next"] == 1.0
    assert query(spark, tmp_path / "b", []) == []


def test_likeness_is_the_jaccard_similarity_of_the_shown_fingerprints(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in fp.op5_fingerprints(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    down = sorted(rows, reverse=True)
    for i, after in zip(down, down[1:] + down[:1]):
        own, e, n = (set(x.split()) for x in (rows[i]["fingerprint"], rows[i]["edited_fingerprint"], rows[after]["fingerprint"]))
        assert rows[i]["near_edited"] == pytest.approx(len(own & e) / len(own | e))
        assert rows[i]["near_next"] == pytest.approx(len(own & n) / len(own | n))
