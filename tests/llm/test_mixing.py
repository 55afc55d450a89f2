"""Raking against a plain loop; marginals of the sample; edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronowatt.llm import mixing
from chronowatt.llm.common import Scratch

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, chance string, n_tokens string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", "y") for i, t, lang, s in rows], SCHEMA)


def plain(cells, goals, rounds=2_000):
    """Iterative proportional fitting of a three-way table."""
    w = cells / cells.sum()
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            other = tuple(i for i in range(3) if i != axis)
            have = w.sum(other)
            shape = [1, 1, 1]
            shape[axis] = len(goal)
            w = w * np.where(have > 0, goal / np.where(have > 0, have, 1), 0).reshape(shape)
    return w


@pytest.mark.parametrize("given", [False, True])
def test_rake_equals_the_plain_loop(spark, given):
    rng = np.random.default_rng(1)
    n = rng.integers(0, 50, (4, 3, 2)).astype(float)
    n[0] += 400
    names = [[f"s{i}" for i in range(4)], [f"l{i}" for i in range(3)], [f"t{i}" for i in range(2)]]
    rows = [(names[0][i], names[1][j], names[2][k], int(n[i, j, k])) for i in range(4) for j in range(3) for k in range(2)]
    cells = spark.createDataFrame(rows, "__source string, __lang string, __topic string, tokens long")
    goals = [np.array(g) for g in ([0.4, 0.3, 0.2, 0.1], [0.5, 0.25, 0.25], [0.7, 0.3])]
    if not given:
        sums = [n.sum((1, 2)), n.sum((0, 2)), n.sum((0, 1))]
        goals = [s**mixing.ALPHA / (s**mixing.ALPHA).sum() for s in sums]
    asked = [dict(zip(a, map(float, g))) for a, g in zip(names, goals)] if given else [None] * 3
    mix = mixing.rake(cells, Scratch(spark, "test"), *asked)
    f = {r["__source"]: r["__f"] for r in mix.by_source.collect()}
    got = np.array([[[n[i, j, k] * f[s] * mix.lang[x] * mix.topic[t] for k, t in enumerate(names[2])] for j, x in enumerate(names[1])] for i, s in enumerate(names[0])])
    assert mix.error < mixing.TOLERANCE
    assert np.allclose(got, plain(n, goals), atol=1e-5)
    for axis, goal in enumerate(goals):
        assert np.allclose(got.sum(tuple(i for i in range(3) if i != axis)), goal, atol=1e-5)


def test_expected_tokens_have_the_target_shares(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.chances(docs, alpha=0.5).withColumn("e", F.col("chance") * F.col("n_tokens"))
    assert got.agg(F.max("chance")).first()[0] == pytest.approx(1.0)
    for column in ("source", "lang", "topic_class"):
        by = got.groupBy(column).agg(F.sum("e").alias("e"), F.sum("n_tokens").alias("n")).toPandas()
        want = by["n"] ** 0.5 / (by["n"] ** 0.5).sum()
        assert np.allclose(by["e"] / by["e"].sum(), want, atol=1e-4)


def test_budget_lowers_all_chances_alike(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = mixing.chances(docs).select("doc_id", F.col("chance").alias("a"))
    b = mixing.chances(docs, budget=0.1).select("doc_id", F.col("chance").alias("b"), "n_tokens")
    row = a.join(b, "doc_id").agg(F.sum(F.col("b") * F.col("n_tokens")) / F.sum("n_tokens"), F.max(F.abs(F.col("b") / F.col("a")))).first()
    assert row[0] == pytest.approx(0.1, abs=1e-3)
    assert row[1] < 1


def test_draw_is_uniform_and_repeatable(spark):
    ids = spark.range(20_000).select(F.col("id"), mixing.draw(F.col("id")).alias("u"), mixing.draw(F.col("id"), 1).alias("v"))
    r = ids.agg(F.avg("u"), F.min("u"), F.max("u"), F.corr("u", "v"), F.avg((F.col("u") < 0.1).cast("int"))).first()
    assert r[0] == pytest.approx(0.5, abs=0.01) and 0 <= r[1] and r[2] < 1 and abs(r[3]) < 0.03
    assert r[4] == pytest.approx(0.1, abs=0.01)


def test_sample_is_that_of_the_chances(spark):
    got = mixing.op9_mix_raking(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    want = got["chance"].sum()
    assert abs(got["kept"].sum() - want) < 4 * np.sqrt((got["chance"] * (1 - got["chance"])).sum())


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "word " * 40_000, "en", "a"), (4, "all rights reserved", None, "b"), (4, "all rights reserved", None, "b"), (None, "a b", "fr", None)]
    got = mixing.chances(frame(spark, rows)).toPandas()
    assert len(got) == 6 and got["chance"].between(0, 1).all()
    assert set(got[got["doc_id"].isin([1, 2])]["chance"]) == {1.0}
    assert set(got[got["doc_id"] == 4]["topic_class"]) == {"legal"}
    assert mixing.chances(frame(spark, rows[:2])).count() == 2
    assert mixing.chances(frame(spark, [])).count() == 0


def test_target_without_tokens_is_refused(spark):
    with pytest.raises(ValueError):
        mixing.chances(frame(spark, [(1, "a b", "en", "a")]), langs={"xx": 1.0})
    with pytest.raises(ValueError):
        mixing.chances(frame(spark, [(1, "a b", "en", "a")]), sources={"xx": 1.0})


def test_one_document_of_a_new_category_leaves_the_chances_of_others(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    rare = spark.createDataFrame([(-1, "rare " * 60, "xx", "new")], docs.schema)
    for alpha, budget in ((mixing.ALPHA, mixing.BUDGET), (0.95, 0.75)):
        a = mixing.chances(docs, alpha=alpha, budget=budget).select("doc_id", F.col("chance").alias("a"), "n_tokens")
        with_rare = mixing.chances(docs.unionByName(rare), alpha=alpha, budget=budget)
        b = with_rare.select("doc_id", F.col("chance").alias("b"))
        both = a.join(b, "doc_id").toPandas()
        assert (both["a"] - both["b"]).abs().max() < 0.01
        for c in ("a", "b"):
            assert (both[c] * both["n_tokens"]).sum() / both["n_tokens"].sum() == pytest.approx(budget, abs=2e-3)
        assert b.filter("doc_id = -1").first()["b"] == 1.0


def test_full_categories_stay_whole_and_the_rest_is_raked(spark):
    rng = np.random.default_rng(2)
    n = rng.integers(50, 400, (4, 3, 2)).astype(float)
    n[0] *= 50
    n[3] = np.array([[3, 0], [0, 2], [1, 0]])
    rows = [(f"s{i}", f"l{j}", f"t{k}", int(n[i, j, k])) for i in range(4) for j in range(3) for k in range(2)]
    cells = spark.createDataFrame(rows, "__source string, __lang string, __topic string, tokens long")
    mix = mixing.rake(cells, Scratch(spark, "test"), alpha=0.9, budget=0.7)
    f = {r["__source"]: r["__f"] for r in mix.by_source.collect()}
    p = np.array([[[min(1.0, f[f"s{i}"] * mix.lang[f"l{j}"] * mix.topic[f"t{k}"]) for k in range(2)] for j in range(3)] for i in range(4)])
    got, total = p * n, n.sum()
    assert mix.error < mixing.TOLERANCE
    assert got.sum() == pytest.approx(0.7 * total) and np.allclose(p[3][n[3] > 0], 1)
    by_source, goal = got.sum((1, 2)), n.sum((1, 2)) ** 0.9
    whole = np.isclose(by_source, n.sum((1, 2)))
    assert whole[3] and not whole[0]
    assert np.ptp((by_source / goal)[~whole]) < 1e-3 * (by_source / goal)[~whole].max()
    for axes in ((0, 2), (0, 1)):
        have, goal = got.sum(axes), n.sum(axes) ** 0.9
        assert np.allclose(have / have.sum(), goal / goal.sum(), atol=1e-5)


def test_shortfall_names_what_is_missing(spark):
    rows = [(i, "a b c d " * 50, "en", "big") for i in range(200)] + [(1_000, "a b", None, "small")]
    found = mixing.chances(frame(spark, rows), alpha=0.5, budget=0.5)
    got = {(r["kind"], r["category"]): r for r in mixing.shortfall(found, alpha=0.5).collect()}
    small = got[("source", "small")]
    assert small["tokens"] == 2 and small["expected"] == pytest.approx(2) and small["missing"] > 100
    assert got[("lang", None)]["missing"] > 100 and got[("source", "big")]["missing"] == 0
