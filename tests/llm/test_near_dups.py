"""Near duplicates against all pairs; sampling; groups that buckets split; edge cases."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronowatt.llm import near_dups as nd

WORDS = [f"w{i}" for i in range(4_000)]


def text(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def edited(rnd, base, n):
    words = base.split()
    for i in rnd.sample(range(len(words)), n):
        words[i] = rnd.choice(WORDS)
    return " ".join(words)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def frequencies(texts):
    """The idf by counting every shingle of every text."""
    df = Counter(x for t in texts for x in set(nd.shingles(t).tolist()))
    n = sum(len(nd.shingles(t)) > 0 for t in texts)
    often = {x: c for x, c in df.items() if c > max(1, nd.FLOOR * n)}
    return nd.Idf(np.array(list(often), np.int64), np.array(list(often.values()), float), n)


def given(values):
    """An idf of given values: of the shingles 0, 1, ..."""
    idf = nd.Idf(np.arange(len(values)), np.ones(len(values)), 1)
    idf.value = np.array(values)
    return idf


def plain(texts):
    """Classes from all pairs: components of weighted Jaccard >= 0.8, and of equal texts."""
    idf, own = frequencies(texts), [nd.shingles(t) for t in texts]
    group = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            equal = (texts[i] or "") == (texts[j] or "")
            if group[i] != group[j] and (equal or (len(own[i]) and len(own[j]) and nd.similarity(own[i], own[j], idf) >= nd.THRESHOLD)):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return {i: g for i, g in enumerate(group)}


def classes(spark, docs, **options):
    return {r["doc_id"]: r["class_id"] for r in nd.Classes(spark, **options).of(docs).collect()}


@pytest.fixture(scope="module")
def mixed():
    rnd = random.Random(5)
    texts = [text(rnd, 120) for _ in range(30)]
    shared = text(rnd, 60)
    for base in texts[:8]:
        texts += [edited(rnd, base, k) for k in (1, 2, 3, 6)] + [base]
    # a chain: each a little further from the first
    step = texts[9]
    for _ in range(6):
        step = edited(rnd, step, 2)
        texts.append(step)
    texts += [f"{shared} {text(rnd, 40)}" for _ in range(12)]
    return texts + [None, "", "  ", "two words", "two words", "TWO  words", "two others"]


def test_equals_all_pairs(spark, mixed):
    assert classes(spark, frame(spark, mixed)) == plain(mixed)


def test_small_limit_of_buckets_changes_nothing(spark, mixed):
    """Splitting by rarest shingles, and more rounds of leaders, lose no link."""
    assert classes(spark, frame(spark, mixed), small=2) == plain(mixed)


def test_samples_agree_as_often_as_texts_are_similar():
    rnd = np.random.default_rng(2)
    agree, want = [], []
    for _ in range(400):
        a = np.sort(rnd.integers(0, 1 << 32, 60, dtype=np.uint32))
        b = np.sort(np.concatenate((a[: rnd.integers(20, 60)], rnd.integers(0, 1 << 32, 10, dtype=np.uint32))))
        every = np.unique(np.concatenate((a, b)))
        idf = nd.Idf(every, np.ones(len(every)), 1)
        idf.value = rnd.random(len(every)) + 0.2
        agree.append(np.mean(nd.samples(*nd.weights(a, idf)) == nd.samples(*nd.weights(b, idf))))
        want.append(nd.similarity(a, b, idf))
    assert abs(np.mean(agree) - np.mean(want)) < 0.02
    assert np.corrcoef(agree, want)[0, 1] > 0.8


def test_similarity_by_hand():
    idf = given([1.0, 2.0, 3.0, 4.0])
    a, b = np.array([0, 1, 1, 2], np.uint32), np.array([1, 2, 2, 3], np.uint32)
    # min: 1 -> 2, 2 -> 3; max: 0 -> 1, 1 -> 4, 2 -> 6, 3 -> 4
    assert nd.similarity(a, b, idf) == pytest.approx(5 / 15)


def test_linked_texts_share_a_prefix_shingle():
    rnd = random.Random(8)
    base = text(rnd, 150)
    texts = [base, *[edited(rnd, base, k) for k in (1, 2, 3, 4)], text(rnd, 90)]
    idf, own = frequencies(texts), [nd.shingles(t) for t in texts]
    df = Counter(x for o in own for x in set(o.tolist()))

    def rarest(o):
        shared = np.array([x for x in np.unique(o).tolist() if df[x] > 1], np.uint32)
        return nd.prefix(o, idf, shared, np.array([df[x] for x in shared.tolist()], np.int64), 0.8)

    pairs = [(i, j) for j in range(len(own)) for i in range(j) if nd.similarity(own[i], own[j], idf) >= 0.8]
    assert pairs and all(len(np.intersect1d(rarest(own[i]), rarest(own[j]))) for i, j in pairs)
    # a text that has enough of its own meets nobody
    assert not len(rarest(own[-1]))


def test_frequencies_above_the_floor_are_exact(spark):
    rnd = random.Random(4)
    common = [text(rnd, 5) for _ in range(6)]
    texts = [". ".join([*common[: k % 7], text(rnd, 30)]) + " end" for k in range(400)] + [None, ""]
    # few counters, so that nearly all shingles share one with a frequent one
    for slots in (4, nd.SLOTS):
        got = nd.frequencies(frame(spark, texts), slots=slots)
        want = frequencies(texts)
        assert got.shingle.tolist() == want.shingle.tolist() and np.allclose(got.value, want.value) and got.rest == want.rest
    # the idf is spread: from what is in half of the texts to what is in one
    assert len(want.shingle) > 5 and want.value.min() < 2.3 and want.rest > 5.5 and len(set(np.round(want.value, 3))) >= 5
    assert nd.frequencies(frame(spark, texts).limit(0)).rest > 0


def test_links_of_a_bucket_equal_pairwise_comparison():
    rnd = random.Random(12)
    texts = [text(rnd, 60) for _ in range(10)]
    texts += [edited(rnd, t, k) for t in texts for k in (1, 2, 3)] + ["no no no no no no " * 30, "no no no no no no " * 25, "no no no no no no " * 5]
    idf = frequencies(texts)
    own = [nd.shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i, j in nd.linked(own, idf, 0.8):
        assert nd.similarity(own[i], own[j], idf) >= 0.8 - 1e-9
        group = [group[i] if g == group[j] else g for g in group]
    for i in range(len(texts)):
        for j in range(i):
            if nd.similarity(own[i], own[j], idf) >= 0.8:
                assert group[i] == group[j]


def test_large_group_of_near_copies_is_one_class_with_few_comparisons(spark):
    rnd = random.Random(9)
    base = text(rnd, 300)
    texts = [edited(rnd, base, 1) for _ in range(400)] + [text(rnd, 100) for _ in range(800)]
    found = nd.Classes(spark)
    compared = []
    similarities = found.similarities
    found.similarities = lambda pairs: compared.append(pairs.count()) or similarities(pairs)
    got = {r["doc_id"]: r["class_id"] for r in found.of(frame(spark, texts)).collect()}
    assert {got[i] for i in range(400)} == {0}
    assert sum(compared) < 10 * 400


def test_components_of_a_long_chain(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1"), (b"\xf1", b"\xf0")]
    links = spark.createDataFrame(chain, "leader binary, key binary")
    got = {bytes(r["key"]): bytes(r["root"]) for r in nd.Classes(spark).components(links).collect()}
    assert all(got[bytes([i])] == b"\x00" for i in range(1, 41))
    assert got[b"\xf1"] == b"\xf0"


def test_odd_rows(spark):
    schema = "doc_id long, text string, key string, root string, class_id string, __rest string"
    rows = [(None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (8, None), (9, ""), (10, "x " * 50_000), (None, "alone here")]
    docs = spark.createDataFrame([(*r, "k", "r", "c", "z") for r in rows], schema)
    got = [(r["doc_id"], r["class_id"]) for r in nd.Classes(spark).of(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 7), (7, 7), (7, 7), (8, 8), (9, 8), (10, 10), (None, None)], key=str)
    first = nd.Classes(spark).first_of_each(docs)
    assert first.columns == docs.columns
    assert sorted((r["doc_id"] for r in first.collect()), key=str) == sorted([7, 8, 10, None], key=str)
    assert nd.Classes(spark).of(docs.limit(0)).count() == 0
    assert nd.Classes(spark).first_of_each(docs.limit(0)).count() == 0


def test_query_covers_every_document(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").toPandas()
    got = {r["doc_id"]: r["class_id"] for r in nd.op10_near_dups_icws(spark, sf).collect()}
    at = docs["doc_id"].tolist()
    assert got == {at[i]: at[g] for i, g in plain(docs["text"].tolist()).items()}
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_marks_leave_all_wanted_and_few_others(spark):
    texts = spark.range(20_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), F.col("id").alias("own"))
    wanted = texts.filter("own % 50 = 7").select("key").unionByName(texts.filter("own = 57").select("key"))
    left = {r["own"] for r in nd.marked(texts, wanted, bits=16).collect()}
    assert left >= set(range(7, 20_000, 50)) and len(left) < 700
    assert nd.marked(texts, wanted, bits=16).columns == texts.columns
    assert nd.marked(texts, wanted.limit(0)).isEmpty()


def test_texts_are_dealt_out_once(spark, monkeypatch):
    """No join on the key shuffles the texts again."""
    rnd = random.Random(3)
    bases = [text(rnd, 60) for _ in range(20)]
    plans, keep = [], nd.Scratch.keep

    def kept(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df)

    monkeypatch.setattr(nd.Scratch, "keep", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        classes(spark, frame(spark, bases + [edited(rnd, b, k) for b in bases for k in (1, 2)]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    compared = [p.splitlines() for p in plans if "own_leader" in p]
    assert compared
    for lines in compared:
        at = [i for i, line in enumerate(lines) if "InMemoryTableScan" in line]
        # above a scan up to the join on the key
        above = [lines[i - 1] if "Sort" in lines[i - 1] else lines[i - 2] for i in at]
        assert len(at) == 2 and all("Sort [key#" in line for line in above)
        # the joined texts and the leaders can be split: both are shuffled
        assert sum("Exchange hashpartitioning(at#" in line for line in lines) == 2
