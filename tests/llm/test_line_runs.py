"""Repeated line runs against a direct search; ranks; edge cases."""

import random
import re

import duckdb
import pytest

from chronowatt.llm import line_runs as lr
from chronowatt.llm.common import Scratch

SF = "/root/testdata/sf0.01"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def plain(rows, min_words):
    """Every least run of min_words words, against the earlier ones, in the order of id and line."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[(doc_id, text)] = (None, 0)
            continue
        lines = text.split("\n")
        symbols = [(k, s, len(_WORD.findall(s))) for k, s in enumerate(lines) if _WORD.search(s)]
        gone = set()
        for a in range(len(symbols)):
            total = 0
            for b in range(a, len(symbols)):
                total += symbols[b][2]
                if total >= min_words:
                    run = tuple(s for _, s, _ in symbols[a : b + 1])
                    if run in seen:
                        gone.update(k for k, _, _ in symbols[a : b + 1])
                    seen.add(run)
                    break
        left = "\n".join(s for k, s in enumerate(lines) if k not in gone)
        out[(doc_id, text)] = (left if not gone or _WORD.search(left) else "", len(gone))
    return out


def check(spark, rows, min_words):
    got = lr.without_copies(frame(spark, rows), min_words).collect()
    ids = {r["doc_id"] for r in got}
    assert len(got) == len(rows) and ids == {r[0] for r in rows}
    by_id = {doc_id: v for (doc_id, _), v in plain(rows, min_words).items()}
    assert {r["doc_id"]: (r["text"], r["deleted_lines"]) for r in got} == by_id


@pytest.mark.parametrize("seed", range(4))
def test_random_documents(spark, seed):
    rnd = random.Random(seed)
    pool = ["a", "b c", "d e f", "g h i j", "", "  ", "k"] + [f"u{i} v{i}" for i in range(6)]
    passage = ["p1 p2", "p3", "", "p4 p5 p6", "p7"]
    rows = []
    for i in range(60):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(0, 25))]
        at = rnd.randint(0, len(lines))
        rows.append((i, "\n".join(lines[:at] + passage * rnd.randint(0, 3) + lines[at:])))
    # equal ids with different texts have no order that the direct search could know
    check(spark, rows, 7)


def test_runs_longer_than_one_power_of_two(spark):
    rnd = random.Random(3)
    passage = [f"w{rnd.randint(0, 9)}" for _ in range(45)]
    rows = [(i, "\n".join([f"own{i}", *passage[: 20 + i], f"end{i}"])) for i in range(12)]
    check(spark, rows, 19)


def test_first_copy_stays_and_short_runs_stay(spark):
    long = "\n".join(f"line {k} of a passage that is long enough to count" for k in range(6))
    rows = [(1, f"one\n{long}\ntail"), (2, f"{long}"), (3, "one\ntwo"), (4, f"x\n{long}\none\ny"), (5, "one\ntwo")]
    got = {r["doc_id"]: r for r in lr.without_copies(frame(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "" and got[4]["text"] == "x\none\ny"
    assert got[3]["text"] == got[5]["text"] == "one\ntwo"
    assert [(r["first"], r["last"]) for r in got[4]["runs"]] == [(1, 6)] and got[1]["runs"] is None


def test_odd_rows(spark):
    text = "\n".join(f"row {k} has words" for k in range(40))
    docs = spark.createDataFrame(
        [(1, None, "c", 5, 6), (2, "", "c", 5, 6), (None, text, "c", 5, 6), (3, text, "c", 5, 6), (3, text, "c", 5, 6), (4, "w " * 80_000, "c", 5, 6), (5, "\n\n \n", "c", 5, 6)],
        "doc_id long, text string, line string, th int, known int",
    )
    found = lr.without_copies(docs)
    assert found.columns == [*docs.columns, "deleted_lines", "runs"]
    got = [(r["doc_id"], r["text"], r["deleted_lines"], r["line"], r["th"]) for r in found.collect()]
    want = [(1, None, 0), (2, "", 0), (None, text, 0), (3, "", 40), (3, "", 40), (4, "w " * 80_000, 0), (5, "\n\n \n", 0)]
    assert sorted(got, key=str) == sorted([(*w, "c", 5) for w in want], key=str)
    assert lr.without_copies(docs.limit(0)).count() == 0


def test_ranks_follow_the_order_of_keys(spark):
    rnd = random.Random(7)
    keys = [(rnd.randint(0, 500), rnd.randint(0, 3)) for _ in range(3_000)]
    members = spark.createDataFrame(keys, "a long, b long")
    from pyspark.sql import functions as F

    got = {(r["a"], r["b"]): r["rank"] for r in lr.ranked(members, "a", "b", F.floor(F.col("a") / 20)).collect()}
    repeated = sorted(k for k in set(keys) if keys.count(k) > 1)
    assert got == {k: i for i, k in enumerate(repeated)}


def test_suffixes_count_words(spark):
    docs = frame(spark, [(1, "a b\n\nc\nd e f\ng"), (2, "a b\nc\nd e f\ng")])
    got = {(r["id"], r["line"]): (r["span"], r["last"], r["enough"]) for r in lr.suffixes(docs, 4, Scratch(spark, "t")).collect()}
    assert got[(1, 0)] == (3, 3, True) and got[(1, 2)] == (2, 3, True) and got[(1, 3)] == (2, 4, True) and got[(1, 4)][2] is False


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(lr.OP6_SQL).fetchall()
    assert sorted(tuple(r) for r in lr.op6_line_runs(spark, SF).collect()) == sorted(want)
    assert sum(r[1] for r in want) > 100
