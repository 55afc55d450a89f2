"""Periodic runs: against trying all periods, on random and structured sequences, on odd rows and as a query."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from chronowatt.llm import periodic_runs as pr

SF = "/root/testdata/sf0.001"


def plain(x, min_length):
    """Every period, every stretch; the smallest period of a stretch wins."""
    found = {}
    for q in range(1, len(x) // 2 + 1):
        start = 0
        while start + q < len(x):
            end = start
            while end + q < len(x) and x[end] == x[end + q]:
                end += 1
            if end + q - start >= max(min_length, 2 * q):
                found.setdefault((start, end + q), q)
            start = end + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def sequences():
    rnd = random.Random(5)
    for _ in range(250):
        yield [rnd.randrange(2) for _ in range(rnd.randint(0, 150))]
    for _ in range(150):
        yield [rnd.randrange(rnd.choice([3, 9, 400])) for _ in range(rnd.randint(0, 90))]
    for _ in range(300):
        # powers of blocks that are powers themselves, cut and joined
        out = []
        while len(out) < rnd.randint(40, 260):
            block = [rnd.randrange(2) for _ in range(rnd.randint(1, 6))]
            for _ in range(rnd.randint(1, 3)):
                block = (block * rnd.randint(1, 4))[rnd.randint(0, 2) :] or [1]
                if rnd.random() < 0.3:
                    block.append(rnd.randrange(3))
            out += block[:120]
        yield out
    for m in (5, 20, 40):
        yield [0, 1] * m + [0] + [0, 1] * m + [0]
    fib, last = [0, 1], [0]
    while len(fib) < 230:
        fib, last = fib + last, fib
    yield fib
    yield [bin(i).count("1") % 2 for i in range(256)]


@pytest.mark.parametrize("first, least", [(4, 4), (4, 2), (8, 8), (16, 12), (4, 20)])
def test_equals_all_periods(monkeypatch, first, least):
    monkeypatch.setattr(pr, "_FIRST", first)
    for x in sequences():
        assert pr.Runs(pr.numbered(x), least).all() == plain(x, least), x


def test_long_periods_meet_all_scales():
    rnd = random.Random(2)
    for q in (31, 62, 63, 100, 257, 700):
        block = [rnd.randrange(10**6) for _ in range(q)]
        x = [-1] + block * 2 + [-2] + block[: q // 2] * 3 + [-3]
        assert pr.Runs(pr.numbered(x)).all() == plain(x, 12)


@pytest.mark.parametrize("words", [["a"] * 300_000, ["a", "b"] * 150_000, (["a"] * 999 + ["b"]) * 200, (["a", "b"] * 9_000 + ["a"]) * 8])
def test_long_texts_take_linear_steps(words):
    started = time.time()
    found = pr.runs_of(words)
    assert time.time() - started < 20
    assert (0, len(words)) in {(s, n) for s, n, _ in found}


def test_collapsed_drops_all_but_the_first_period():
    words = list("xabcabcabcabcy")
    assert pr.runs_of(words) == [(1, 12, 3)]
    assert pr.collapsed(words, pr.runs_of(words)) == "x a b c y"
    assert pr.collapsed(words, []) == " ".join(words)


def expected(doc_id, text):
    """The contract's row, word by word."""
    words = re.findall(pr.WORD, text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words, 12)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (
        len(runs), *best, best[1] * 1000 // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(kept).encode()).hexdigest(),
    )


def test_query(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in pr.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    short = [r for r in docs if len(r["text"]) < 3_000]
    assert len(short) > 100 and any(zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in short)
    for r in short:
        assert got[r["doc_id"]] == expected(r["doc_id"], r["text"]), r["doc_id"]


def test_odd_rows(spark):
    rows = [
        (None, "a b " * 8, "x"), (1, None, "x"), (2, "", "x"), (3, " \t\n\x0b\x0c\r", "x"), (4, "é ñ " * 12, "x"),
        (4, "é ñ " * 12, "x"), (9007199254740993, "one two", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = pr.periodic_runs(docs, keep=("doc_id", "start")).collect()
    assert sorted((r["doc_id"] or -1, r["start"] or "", [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == [
        (-1, "x", [(0, 16, 2)], "a b"), (1, "x", [], ""), (2, "x", [], ""), (3, "x", [], ""), (4, "x", [(0, 12, 1)], "é ñ"),
        (4, "x", [(0, 12, 1)], "é ñ"), (9007199254740993, "", [], "one two"),
    ]
    assert pr.periodic_runs(docs.limit(0)).count() == 0
    planted = {r["doc_id"]: r["text"] for r in pr.with_planted_tails(docs.select("doc_id", "text")).collect()}
    assert planted[1] is None and planted[2] == "" and len(planted) == 6
    with pytest.raises(ValueError, match="runs"):
        pr.periodic_runs(docs.withColumnRenamed("start", "runs"), keep=("doc_id", "runs"))


def test_sliding():
    rnd = np.random.default_rng(1)
    for n, size in ((1, 1), (5, 5), (9, 4), (64, 8), (65, 8)):
        x = rnd.integers(0, 50, n)
        assert pr.sliding(x, size, np.minimum, 99).tolist() == [x[i : i + size].min() for i in range(n - size + 1)]
