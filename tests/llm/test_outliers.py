"""Base statistics by hand, estimates against plain numpy, verdicts, edge cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronowatt.llm import outliers as o
from chronowatt.llm.common import Scratch

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, part string, d2 string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {k for i, r in enumerate(runs) if runs.count(r) > 1 for k in (i, i + 1, i + 2)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(lines)


ODD = [None, "", "  \n\t", "one", "a b", "a b c", "a b c a b c", "a a a a a", "a a a", "x\ny\nx\n\n\ny", "é$$ ñ## |\n<>&%*", "a b c d a b c d a b c", " a\xa0b c\x0bd "]


def test_base_statistics_by_hand(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)]
    got = {r["doc_id"]: r for r in o.base_statistics(frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_lines"]) == plain(t), repr(t)


def test_quantiles_of_chi_square():
    # known values
    assert o.quantile(o.chi_square_5, 0.95) == pytest.approx(11.0705, abs=1e-3)
    assert o.quantile(o.chi_square_5, 0.975) == pytest.approx(12.8325, abs=1e-3)
    assert o.quantile(o.chi_square_7, 0.5) == pytest.approx(6.3458, abs=1e-3)
    assert o.consistency(1 - 1e-12) == pytest.approx(1.0, abs=1e-6)


def vectors(spark, x, part="p"):
    return spark.createDataFrame([(part, *map(float, r)) for r in x], "part string, x0 double, x1 double, x2 double, x3 double, x4 double")


def raised(c):
    """A covariance whose variances below the floors stand at them."""
    out = c.copy()
    np.fill_diagonal(out, np.maximum(np.diag(c), np.square(o.FLOORS)))
    return out


def plain_mcd(x):
    """Concentration steps in numpy, with exact ordering in place of the histogram, until nothing moves."""
    med = np.median(x, 0)
    starts = [(med, np.diag((1.4826 * np.median(np.abs(x - med), 0)) ** 2)), (x.mean(0), np.cov(x.T, bias=True))]
    found = []
    for m, c in starts:
        for _ in range(60):
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(raised(c)), x - m)
            near = x[d2 <= np.sort(d2)[int(np.ceil(len(x) * o.SHARE)) - 1]]
            m, c = near.mean(0), np.cov(near.T, bias=True) * o.consistency(o.SHARE)
        found.append((np.linalg.slogdet(raised(c))[1], m, raised(c)))
    _, m, c = min(found, key=lambda f: f[0])
    inside = x[np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) <= o.INNER]
    return inside.mean(0), raised(np.cov(inside.T, bias=True) * o.consistency(0.975))


def test_estimate_resists_a_fifth_of_outliers_and_equals_numpy(spark):
    rng = np.random.default_rng(4)
    mixing = rng.normal(size=(5, 5))
    x = rng.normal(size=(2_000, 5)) @ mixing
    x[:400] = rng.normal(size=(400, 5)) + 40
    row = o.fitted(vectors(spark, x), Scratch(spark, "t")).first()
    m = np.array([row[f"m{i}"] for i in range(5)])
    low = np.array([[row[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    want_m, want_c = plain_mcd(x)
    assert np.allclose(m, want_m, atol=0.05)
    assert np.allclose(low @ low.T, want_c, rtol=0.05, atol=0.05)
    truth = mixing.T @ mixing
    assert np.allclose(m, 0, atol=0.3) and np.allclose(low @ low.T, truth, atol=0.15 * np.abs(truth).max())


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 5))
    rows = vectors(spark, x)
    factors = o.factored(o.estimate(rows, ("part",)), 1.0)
    got = sorted(r["d2"] for r in o.distance(rows.join(factors.select("part", *o.FACTORS), "part")).collect())
    c = raised(np.cov(x.T, bias=True))
    y = x - x.mean(0)
    assert np.allclose(got, np.sort(np.einsum("ij,jk,ik->i", y, np.linalg.inv(c), y)), atol=1e-4)


def test_statistics_that_a_group_shares_do_not_break_it(spark):
    x = np.zeros((200, 5))
    x[:5, 1] = 50
    rows = vectors(spark, x)
    got = o.distance(rows.join(o.fitted(rows, Scratch(spark, "t")), "part")).groupBy("x1").agg(F.max("d2")).collect()
    assert {r[0]: r[1] > o.CUT for r in got} == {0.0: False, 50.0: True}


def test_a_floor_raises_only_what_is_below_it(spark):
    """Ample variances are left alone, so the determinant is that of the covariance itself."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2_000, 5)) * np.array([1, 3, 1, 0.01, 2])
    row = o.factored(o.estimate(vectors(spark, x), ("part",)), 1.0).first()
    low = np.array([[row[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    c = np.cov(x.T, bias=True)
    assert np.allclose(np.diag(low @ low.T)[[0, 1, 2, 4]], np.diag(c)[[0, 1, 2, 4]], rtol=1e-6)
    assert np.diag(low @ low.T)[3] == pytest.approx(o.FLOORS[3] ** 2)


def test_planted_lines_and_symbols_are_rejected(spark):
    """Four lines in ten repeated, or 25 symbols in a hundred words, in a group without any."""

    def lines(i, repeated):
        own = [" ".join(ordinary(i * 97 + k, 12).split()) for k in range(20)]
        return "\n".join(own[: 20 - repeated] + own[:repeated])

    rows = [(i, lines(i, 0), "en", "s") for i in range(400)]
    rows += [(1000 + i, lines(2000 + i, 8), "en", "s") for i in range(10)]
    rows += [(2000 + i, " ".join(w + ("#" if k % 4 == 0 else "") for k, w in enumerate(lines(3000 + i, 0).split(" "))), "en", "s") for i in range(10)]
    got = {r["doc_id"]: r["kept"] for r in o.judged(frame(spark, rows)).collect()}
    assert all(got[i] for i in range(400))
    assert not any(got[i] for i in got if i >= 1000)


def ordinary(i, n=120):
    return " ".join(f"word{(i * 31 + k * 7 + k * k) % 9973}" for k in range(n))


def test_junk_goes_clean_stays_small_groups_are_pooled(spark):
    rows = [(i, ordinary(i, 80 + i % 90), "en", "big" if i % 3 else f"small{i % 40}") for i in range(600)]
    rows += [(1000 + i, " ".join(w + "$%&|" for w in ordinary(i).split()), "en", "big") for i in range(20)]
    rows += [(2000 + i, ordinary(i), "fr", "tiny") for i in range(5)]
    rows += [(3000, "too short", "en", "big"), (3001, "again and again " * 60, "en", "big")]
    got = {r["doc_id"]: r for r in o.judged(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["kept"] for i in range(600))
    assert not any(got[1000 + i]["kept"] for i in range(20))
    assert all(got[2000 + i]["kept"] and got[2000 + i]["d2"] is None for i in range(5))
    assert got[3000]["base_failed"] and got[3001]["base_failed"] and not got[3000]["kept"] and not got[3001]["kept"]


def test_odd_rows(spark):
    rows = [(i, t, None, None) for i, t in enumerate(ODD)] + [(None, ordinary(1), None, "s"), (50, "w " * 50_000, "en", None), (51, ordinary(2), "en", "s"), (51, ordinary(2), "en", "s")]
    got = o.judged(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r["kept"] is not None and (not r["base_failed"] or not r["kept"]) for r in got)
    assert o.judged(frame(spark, [])).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = o.op4_robust_outliers(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for r in docs.sample(60, random_state=1).itertuples():
        n, chars, symbols, dup, rep, _ = plain(r.text)
        row = got.loc[r.doc_id]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert row.base_failed == (n < 50 or 100 * rep > 50 * n)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    both = got.join(labels, how="inner")
    both = both[~both["base_failed"]]
    assert both[both["quality"] == 1]["kept"].mean() > 0.98
    assert both[both["quality"] == 0]["kept"].mean() < 0.5
