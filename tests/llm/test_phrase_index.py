"""Phrase index: against SQL, against word-by-word search on random texts, proximity, blocks, segments, odd rows."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from chronowatt.llm import phrase_index as px

SF = "/root/testdata/sf0.001"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_phrases(text, items, window):
    """Hit word numbers and item names, by comparing every place with every window."""
    doc, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for at in range(len(doc) - size + 1):
                if doc[at : at + size] == w[i : i + size]:
                    hit.update(range(at, at + size))
                    names.add(name)
    return hit, names


def plain_near(doc, terms, within):
    """Least stretches of at most ``within`` words with all terms as often as listed, other than the terms in order."""
    out = []
    for a in range(len(doc)):
        for z in range(a, min(a + within, len(doc))):
            part = doc[a : z + 1]
            holds = lambda p: all(p.count(t) >= terms.count(t) for t in terms)
            if holds(part) and not holds(part[1:]) and not holds(part[:-1]) and part != terms:
                out.append((a, z))
    return out


@pytest.fixture(scope="module")
def random_docs():
    rnd = random.Random(3)
    some = ["A", "b", "C", "d1", "é", "ñandú", "Zz"]
    docs = [(i, rnd.choice([" ", "\n", ", "]).join(rnd.choice(some) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    items = [(j, " ".join(rnd.choice(some) for _ in range(rnd.randint(1, 6)))) for j in range(25)]
    return docs, items


@pytest.mark.parametrize("segment_bytes, block_words", [(1, 1 << 20), (300, 1 << 20), (1 << 20, 9)])
def test_phrases_equal_plain_search(spark, random_docs, segment_bytes, block_words):
    docs, items = random_docs
    index = px.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), segment_bytes).cache()
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = px.search(index, tests, window=4, block_words=block_words).collect()
    index.unpersist()
    assert len(got) == len(docs)
    by_id = dict(docs)
    for r in got:
        hit, names = plain_phrases(by_id[r["doc_id"]], items, 4)
        assert {m["item"] for m in r["matches"]} == {str(n) for n in names}
        assert {i for m in r["matches"] for i in range(m["first"], m["last"] + 1)} == hit
        assert r["n_words"] == len(words(by_id[r["doc_id"]]))


def test_proximity_equals_plain_search(spark, random_docs):
    docs, items = random_docs
    index = px.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), 500)
    items = [(j, t) for j, t in items if 2 <= len(words(t)) <= 4][:8]
    got = px.search(index, spark.createDataFrame(items, "item_id long, text string"), window=4, within=6).collect()
    by_id, seen = dict(docs), 0
    for r in got:
        for j, text in items:
            want = px.joined(plain_near(words(by_id[r["doc_id"]]), words(text), 6))
            mine = [(m["first"], m["last"]) for m in r["matches"] if m["item"] == str(j) and m["kind"] == "proximity"]
            assert mine == want, (r["doc_id"], text)
            seen += len(want)
    assert seen > 20


def test_rarest_terms_come_first():
    windows = px.Windows([("x", np.array([5, 7, 9])), ("y", np.array([5, 7, 9])), ("z", np.array([7]))], 3)
    windows.order(np.array([100, 1, 10]))
    assert windows.of.tolist() == [[0, 1, 2], [1, -1, -1]]
    assert windows.by_rarity[0].tolist() == [1, 2, 0] and windows.by_rarity[1][0] == 0
    assert windows.owners == [[0, 1], [2]] and windows.lengths.tolist() == [3, 1]


def test_words_do_not_run_over_texts():
    cuts, data = px.text_bytes(pa.array(["abc", None, "def Ghi", "", " ", "É1-x"]))
    hashes, counts = px.hashed_words(data, cuts)
    assert counts.tolist() == [1, 0, 2, 0, 0, 2]
    again, _ = px.hashed_words(*reversed(px.text_bytes(pa.array(["xx abc DEF ghi É1 X"]))))
    assert again[1:].tolist() == hashes.tolist()
    sliced = px.text_bytes(pa.array(["zz", "abc"]).slice(1))
    assert px.hashed_words(sliced[1], sliced[0])[0].tolist() == hashes[:1].tolist()


def test_query_equals_sql(spark):
    got = {tuple(r) for r in px.op13_phrase_decontamination(spark, SF).collect()}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(px.OP13_SQL).fetchall()
    assert got == set(want) and len(want) == 200
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_odd_rows(spark):
    long = "w " * 50_000 + "needle in The HAY " + "w " * 50_000
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (None, "needle in the hay", 1), (3, " .,- ", 1), (4, long, 1), (5, "needle, in; the-hay", 1),
         (5, "needle, in; the-hay", 1), (9007199254740993, "needle in a hay", 1)],
        "doc_id long, text string, segment int",
    )
    tests = spark.createDataFrame([(None, "in THE hay"), (7, None), (8, ""), (9, "..."), (7, "needle in the"), (7, "in the")], "item_id long, text string")
    got = px.search(px.build(docs), tests, window=3).collect()
    assert len(got) == 8
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(sorted((m["item"], m["first"], m["last"]) for m in r["matches"]))
    assert by[1] == by[2] == by[3] == by[9007199254740993] == [[]]
    assert by[5] == [[("", 1, 3), ("7", 0, 2)]] * 2 and by[None] == [[("", 1, 3), ("7", 0, 2)]]
    assert by[4] == [[("", 50_001, 50_003), ("7", 50_000, 50_002)]]
    assert px.search(px.build(docs.limit(0)), tests).count() == 0
    none = px.search(px.build(docs), tests.limit(0)).collect()
    assert len(none) == 8 and not any(r["matches"] for r in none)


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(px, "_PART_WORDS", 5)
    item = [f"t{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(["x", *item[i : i + 4], "y"])) for i in range(37)], "doc_id long, text string")
    tests = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = px.search(px.build(docs), tests, window=4, block_words=20).collect()
    assert [[(m["first"], m["last"]) for m in r["matches"]] for r in got] == [[(1, 4)]] * 37


def test_words_covered(spark):
    rows = [([(0, 3), (2, 5), (5, 5), (8, 9)],), ([],), ([(4, 4), (0, 9)],)]
    df = spark.createDataFrame(rows, "m array<struct<first: long, last: long>>")
    assert [r[0] for r in df.select(px.covered(df.m)).collect()] == [8, 0, 10]
