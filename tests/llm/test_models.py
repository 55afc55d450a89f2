"""Quality, language, toxicity: methods against plain versions, edge cases, held-out accuracy."""

import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronowatt.llm import language, quality, toxicity
from chronowatt.llm.common import held_out

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
LABELS = "doc_id long, quality int, toxic int"


def documents(spark, rows=()):
    return spark.createDataFrame([(i, t, lang, "s", None, "clash") for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(120):
        bad = i % 3 == 0
        text = "SHOUT!! NOISE!! " * 20 + f"x{i}" if bad else f"a calm sentence about thing {i} and nothing else " * 3
        rows.append((i, text, "en"))
        labels.append((i, int(not bad), int(bad)))
    return documents(spark, rows), spark.createDataFrame(labels, LABELS)


ODD = [(1, None, "en"), (2, "", None), (None, "calm sentence", "en"), (4, "word " * 30_000, "en"), (4, "word " * 30_000, "en"), (5, "  \n ", "fr"), (6, "123 !?", "de")]


def test_log_ratio_counts_presence():
    rows = [np.array([0, 1], np.int32), np.array([1, 2], np.int32), np.array([2], np.int32)]
    got = quality.log_ratio(rows, np.array([1.0, 1.0, -1.0]), 4)
    p, q = np.array([2, 3, 2, 1.0]), np.array([1, 1, 2, 1.0])
    assert np.allclose(got, np.log(p / p.sum()) - np.log(q / q.sum()))


def test_dual_descent_reaches_the_optimum():
    """The objective settles, and the optimum separates the rows."""
    rng = np.random.default_rng(1)
    labels = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    rows = [np.unique(np.append(rng.integers(2, 40, 8), int(y > 0))).astype(np.int32) for y in labels]
    ratio = quality.log_ratio(rows, labels, 40)

    def objective(w, b):
        hinge = sum(max(0.0, 1 - y * (w[r] @ quality.scaled(r, ratio) + b)) for r, y in zip(rows, labels))
        return 0.5 * (w @ w + b * b) + hinge

    quick, long = quality.hinge_fit(rows, ratio, labels, epochs=500), quality.hinge_fit(rows, ratio, labels, epochs=3000)
    assert objective(*quick) <= 1.01 * objective(*long)
    assert all(y * (long[0][r] @ quality.scaled(r, ratio) + long[1]) > 0 for r, y in zip(rows, labels))


def test_quality_scores_every_row(spark, labelled):
    docs, labels = labelled
    model = quality.train(docs, labels, "quality", ~held_out("doc_id", 5, 0))
    odd = quality.scores(documents(spark, ODD), model).toPandas()
    assert len(odd) == len(ODD) and odd["score"].between(0, 1).all()
    assert odd[odd["doc_id"] == 4]["score"].nunique() == 1
    got = quality.scores(docs, model).toPandas().set_index("doc_id")["score"]
    assert all((got[i] >= 0.5) == (i % 3 != 0) for i in range(120))
    assert quality.scores(documents(spark), model).count() == 0


@pytest.mark.parametrize("which", ["none", "one class"])
def test_quality_without_two_classes(spark, which):
    labels = spark.createDataFrame([] if which == "none" else [(i, 1, 0) for i in range(1, 7)], LABELS)
    model = quality.train(documents(spark, ODD), labels, "quality", F.lit(True))
    assert set(quality.scores(documents(spark, ODD), model).toPandas()["score"]) == {0.5 if which == "none" else 1.0}


def test_unseen_word_backs_off_to_the_longest_known_ngrams():
    words = {"chat": np.array([-1.0, -5.0])}
    grams = {(3, "cha"): np.array([-2.0, -3.0]), (3, "hat"): np.array([-4.0, -1.0]), (1, "z"): np.array([-9.0, -8.0])}
    scorer = language.Scorer({"langs": ["en", "fr"], "words": words, "grams": grams})
    assert scorer.word("chat").tolist() == words["chat"].tolist()
    assert np.allclose(scorer.word("chats"), [-3.0, -2.0])
    assert np.allclose(scorer.word("z"), [-9.0, -8.0])
    assert np.allclose(scorer.word("q"), 0)
    assert scorer.predict("chats")[0] == "fr"


def test_unseen_words_are_backed_off_together():
    """Scores as by one mean a word up to rounding, in half the time at most."""
    rng = np.random.default_rng(2)
    letters = list("abcdefghijklmnop")
    grams = {(size, "".join(rng.choice(letters, size))): rng.random(4) for size in range(1, 6) for _ in range(3_000)}
    grams |= {(1, c): rng.random(4) for c in letters}
    model = {"langs": list("wxyz"), "words": {"known": rng.random(4)}, "grams": grams}
    unseen = ["".join(w) for w in rng.choice(letters, (20_000, 9))]
    text = " ".join([*unseen, "ß"])

    def plain(w):
        for size in range(5, 0, -1):
            if seen := [v for g in language.grams_of(w, size) if (v := grams.get((size, g))) is not None]:
                return np.mean(seen, axis=0)

    def least(run):
        took = []
        for _ in range(3):
            started = time.thread_time()
            found = run()
            took.append(time.thread_time() - started)
        return found, min(took)

    want, slow = least(lambda: [plain(w) for w in unseen])
    scorer, quick = least(lambda: (s := language.Scorer(model)).predict(text) and s)
    assert np.allclose([scorer.word(w) for w in unseen], want, rtol=1e-12, atol=0) and not scorer.word("ß").any()
    # the same bits, whatever else is looked up with a word
    alone = language.Scorer(model)
    assert all(np.array_equal(alone.word(w), scorer.word(w)) for w in unseen[:2_000])
    assert quick < slow / 2


def test_counts_are_those_of_all_occurrences(spark):
    """Also of words that stand in many texts, which many tasks read."""
    rows = [(i, f"the hill w{chr(97 + i % 20)}", "en" if i % 2 else "fr") for i in range(400)]
    model = language.train(documents(spark, rows).repartition(16), F.lit(True))
    for lang in ("en", "fr"):
        total = Counter(w for _, t, own in rows if own == lang for w in language.words_of(t))
        place = model["langs"].index(lang)
        n = np.array([total[w] for w in model["words"]]) + 0.1
        assert np.allclose([v[place] for v in model["words"].values()], np.log(n / n.sum()))
        parts = Counter()
        for w, k in total.items():
            for g in (f" {w} "[i : i + 3] for i in range(len(w))):
                parts[g] += k
        three = [g for size, g in model["grams"] if size == 3]
        n = np.array([parts[g] for g in three]) + 0.1
        assert np.allclose([model["grams"][3, g][place] for g in three], np.log(n / n.sum()))


def test_language_of_odd_texts(spark):
    rows = [(i, "the cat sat on the mat and the dog" if i % 2 else "der Hund und die Katze auf der Matte", "en" if i % 2 else "de") for i in range(40)]
    model = language.train(documents(spark, rows), ~held_out("doc_id", 4, 2))
    got = language.predict(documents(spark, [*ODD, (9, "der Hund", None)]), model).toPandas()
    by = got.set_index("doc_id")
    assert len(got) == len(ODD) + 1 and got["score"].between(0, 1).all()
    assert by.loc[9, "lang_pred"] == "de"
    assert {by.loc[i, "lang_pred"] for i in (1, 2, 5, 6)} == {"und"}
    empty = language.train(documents(spark), ~held_out("doc_id", 4, 2))
    assert set(language.predict(documents(spark, ODD), empty).toPandas()["lang_pred"]) == {"und"}


def test_a_rare_language_is_learnt_beside_a_hot_one(spark):
    """Three texts among thirty thousand."""
    hot = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("the lake and the hill number"), F.hex("id"), F.lit(" are near the town")).alias("text"), F.lit("en").alias("lang")
    )
    rare = spark.createDataFrame([(40_000 + i, t, "xx") for i, t in enumerate(["zquo wexi plorn zquo", "wexi zquo trask plorn", "plorn wexi zquo"])], "doc_id long, text string, lang string")
    model = language.train(hot.unionByName(rare), F.lit(True), rows=600, words=200, grams=300)
    assert model["langs"] == ["en", "xx"] and "zquo" in model["words"] and "trask" in model["words"]
    assert len(model["words"]) <= 200 and len(model["grams"]) <= 300
    got = language.predict(documents(spark, [(1, "wexi plorn zquor", None), (2, "the hill", None)]), model).toPandas()
    assert got.sort_values("doc_id")["lang_pred"].tolist() == ["xx", "en"]


def test_shares_of_a_sample():
    assert language.level([5, 100, 100], 65) == 30 and language.level([5, 7], 100) == 7 and language.level([], 10) == 1
    assert language.level([10, 10], 4) == 2


def test_language_memory_is_bounded_and_changes_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    model = {"langs": ["a", "b"], "words": {"x": np.array([0.0, 1.0])}, "grams": {(1, c): rng.random(2) for c in "abcdefgh"}}
    text = " ".join("".join(rng.choice(list("abcdefgh"), 3)) for _ in range(300)) + " x"
    want = language.Scorer(model).predict(text)
    monkeypatch.setattr(language, "_REMEMBERED", 8)
    small = language.Scorer(model)
    got = [small.predict(t) for t in (text, text[:40], text)]
    assert got[0][0] == want[0] and got[0][1] == pytest.approx(want[1]) and got[0] == got[2] and len(small.scores) == 9


def test_language_held_out_accuracy(spark):
    got = language.op2_language_backoff(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    assert got.count() == docs.count()
    assert got.filter("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_quality_held_out_accuracy(spark):
    got = quality.op1_quality_nbsvm(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9


def _postings(rng, rows, terms, idf, topics):
    """example, term, weight of unit vectors; each example draws most of its terms from one topic."""
    example, term, weight = [], [], []
    for i in range(rows):
        topic = int(rng.integers(topics))
        some = np.flatnonzero((np.arange(terms) % topics == topic) | (rng.random(terms) < 0.05))
        at = rng.choice(some, rng.integers(1, min(12, len(some))), replace=False)
        w = (1 + np.log(rng.integers(1, 4, len(at)))) * idf[at]
        example.append(np.full(len(at), i))
        term.append(at)
        weight.append(w / np.sqrt(w @ w))
    return tuple(map(np.concatenate, (example, term, weight)))


@pytest.mark.parametrize("rows, block, common", [(300, 16, 24), (300, 16, 2), (300, 7, 1000), (5, 16, 24), (40, 64, 8)])
def test_nearest_equals_brute_force(monkeypatch, rows, block, common):
    monkeypatch.setattr(toxicity, "_COMMON", common)
    rng = np.random.default_rng(3)
    idf = rng.random(60) + 0.5
    example, term, weight = _postings(rng, rows, 60, idf, 5)
    index = toxicity.BlockMaxIndex(example, term, weight, rows, 60, block)
    dense = np.zeros((rows, 60))
    dense[example, term] = weight
    query, at, q = _postings(rng, 50, 60, idf, 5)
    asked = np.zeros((50, 60))
    asked[query, at] = q
    left_out = rng.integers(0, rows, 50)
    for without in (None, left_out):
        got = index.nearest(query, at, q, 50, 10, without)
        for i, (ids, cosines) in enumerate(got):
            full = np.round(dense @ asked[i], 6)
            if without is not None:
                full[without[i]] = 0
            hit = np.flatnonzero(full > 0)
            want = hit[np.lexsort((hit, -full[hit]))][:10]
            assert np.allclose(full[ids], cosines, atol=2e-6) and np.allclose(full[want], cosines, atol=2e-6)
            assert without is None or without[i] not in ids


def test_blocks_that_cannot_hold_a_neighbour_are_skipped():
    rng = np.random.default_rng(4)
    idf = np.ones(400)
    example, term, weight = _postings(rng, 1_000, 400, idf, 20)
    index = toxicity.BlockMaxIndex(example, term, weight, 1_000, 400, 16)
    query, at, q = _postings(rng, 100, 400, idf, 20)
    index.nearest(query, at, q, 100, 5)
    assert 200 <= index.blocks_seen < 0.7 * 100 * index.blocks


def test_terms_are_words_and_beginnings():
    text, term, count = toxicity.terms_of(["Hüte, hüte-hüten! x_1y", "", "HÜTEN hüten ab"])
    by = [dict(zip(term[text == i].tolist(), count[text == i].tolist())) for i in range(3)]
    # x and y stand alone between a mark and digits
    assert sorted(by[0].values()) == [1, 1, 1, 1, 2] and by[1] == {}
    assert sorted(by[2].values()) == [1, 2, 2] and len(set(by[0]) & set(by[2])) == 2
    whole, beginning = toxicity.terms_of(["abcde"])[1], toxicity.terms_of(["abcdef"])[1]
    assert len(set(whole) & set(beginning)) == 1
    long = toxicity.terms_of(["zeta " * 200_000 + "omega"])
    assert sorted(long[2].tolist()) == [1, 1, 200_000]


def test_pools_make_a_sequence_rise():
    assert np.allclose(toxicity.rising(np.array([0.1, 0.5, 0.3, 0.9]), np.array([1, 1, 3, 1.0])), [0.1, 0.35, 0.35, 0.9])


def test_toxicity_scores_every_row(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels, "toxic", ~held_out("doc_id", 4, 2))
    got = toxicity.scores(docs, model).toPandas().set_index("doc_id")
    assert all((got.loc[i, "score"] >= 0.3) == (i % 3 == 0) for i in range(120))
    near = got.loc[0, "neighbour_ids"]
    assert len(near) and all(n % 3 == 0 for n in near)
    odd = toxicity.scores(documents(spark, ODD), model).toPandas()
    assert len(odd) == len(ODD) and odd["score"].between(0, 1).all()
    assert toxicity.scores(documents(spark), model).count() == 0


def test_toxicity_without_labels(spark):
    model = toxicity.train(documents(spark, ODD), spark.createDataFrame([], LABELS), "toxic", F.lit(True))
    assert set(toxicity.scores(documents(spark, ODD), model).toPandas()["score"]) == {0.0}


def hashed(*words):
    """A word's own term: the one that the word before it does not share."""
    return np.array([next(t for t in toxicity.terms_of([w])[1] if t not in toxicity.terms_of([w + "zz"])[1]) for w in words])


def test_document_frequencies_count_all_documents(spark):
    docs = documents(spark, [(1, "moron here", "en"), (2, "moron moron", "en"), (3, "calm", "en"), (4, None, "en")])
    vocabulary = hashed("moron", "calm")
    order = np.argsort(vocabulary)
    assert np.allclose(toxicity.idf_of(docs, vocabulary[order]), (np.log(5 / np.array([3, 2])) + 1)[order])
    assert toxicity.idf_of(docs, vocabulary[:0]).size == 0


def test_association_follows_the_labels():
    labels = np.array([1.0] * 6 + [0.0] * 60)
    ratio = toxicity.association(np.array([6.0, 60.0]), np.array([6.0, 0.0]), len(labels), labels.sum())
    assert ratio[0] > 25 and ratio[1] == 0 and np.allclose(toxicity.factors(ratio), [1.0, toxicity.TOPIC])
    assert not toxicity.association(np.array([6.0]), np.array([6.0]), 6, 6.0).any()


def test_equal_texts_are_one_example_with_the_mean_of_their_labels(spark):
    rows = [(i, "same words here", "en") for i in range(4)] + [(9, "quite another text", "en")]
    labels = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (2, 0, 1), (3, 0, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(spark, rows), labels, "toxic", F.lit(True))
    assert model.ids.tolist() == [0, 9] and model.labels.tolist() == [0.75, 0.0]
    assert len(set(toxicity.scores(documents(spark, rows), model).filter("doc_id < 4").toPandas()["score"])) == 1


def test_toxicity_held_out(spark):
    got = toxicity.op7_toxicity_neighbours(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().toPandas()
    n = {(int(r.toxic), int(r.predicted)): r["count"] for _, r in rows.iterrows()}
    assert n.get((0, 1), 0) <= 0.1 * n[(0, 0)]
    assert n[(1, 1)] >= 0.5 * (n.get((1, 0), 0) + n[(1, 1)])


def test_every_word_of_the_examples_counts(spark):
    """Texts without a word that labels tell about have neighbours; five toxic texts are enough to learn a word."""
    calm = [(i, f"calm harbour number{chr(97 + i % 26)} lies near village{chr(97 + i % 7)}", "en") for i in range(100)]
    rude = [(200 + i, f"zorgle harbour side{chr(97 + i)} lies there", "en") for i in range(5)]
    labels = spark.createDataFrame([(i, 0, int(i >= 200)) for i, _, _ in calm + rude], "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(spark, calm + rude), labels, "toxic", F.lit(True))
    asked = documents(spark, [(1, "village", "en"), (2, "you zorgle", "en"), (3, "calm village", "en")])
    got = toxicity.scores(asked, model).toPandas().set_index("doc_id")
    assert got.loc[2, "score"] >= toxicity.THRESHOLD and sorted(got.loc[2, "neighbour_ids"]) == [200, 201, 202, 203, 204]
    assert len(got.loc[3, "neighbour_ids"]) == toxicity.NEIGHBOURS and got.loc[3, "score"] < toxicity.THRESHOLD
    assert len(got.loc[1, "neighbour_ids"]) == toxicity.NEIGHBOURS
