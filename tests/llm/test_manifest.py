"""Merkle manifest: against SQL, against a plain tree in Python for blocks of several sizes, odd rows, versions."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from chronowatt.llm import manifest as mf
from chronowatt.llm.common import Scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def plain(rows):
    """(leaf, subroot, root, proof_sha256) of rows (as in SCHEMA), by whole trees."""
    langs, out = {}, []
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    trees = [climb([plain_leaf(r) for r in langs[x]]) for x in order]
    top = climb([t[-1][0] for t in trees])
    for j, x in enumerate(order):
        for i, r in enumerate(langs[x]):
            proof, at = "", i
            for level in trees[j][:-1]:
                proof += "".join(d for k, d in enumerate(level) if k // 8 == at // 8 and k != at)
                at //= 8
            at = j
            for level in top[:-1]:
                proof += "".join(d for k, d in enumerate(level) if k // 8 == at // 8 and k != at)
                at //= 8
            out.append((r[0], plain_leaf(r), trees[j][-1][0], top[-1][0], sha(proof)))
    return out


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_equals_whole_trees(spark, block):
    rnd = random.Random(block)
    rows = [(i, rnd.choice(["s", None]), rnd.choice([None, "en", "en", "en", "fr"]), i % 7, f"Text {i}") for i in range(700)]
    rows += [(1000 + i, "s", f"l{i:02d}", None, None) for i in range(70)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    changed = F.when(F.col("doc_id") % 3 == 0, mf.leaf(text=F.translate("text", "T", "t")))
    got = mf.manifest(docs, changed, Scratch(spark, "t"), nodes=True, size=block).collect()
    want = plain(rows)
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    # folding another leaf gives the root of the tree over the changed rows
    for one in (0, 3, 699, 1002):
        altered = [(*r[:4], r[4] and r[4].replace("T", "t")) if r[0] == one else r for r in rows]
        (mine,) = [r for r in got if r["doc_id"] == one]
        assert mine["folded_root"] == plain(altered)[0][3]
        assert (mine["folded_root"] == mine["root"]) == (one % 3 > 0 or one >= 1000)
    for r in got:
        # a version has one node of its own on each level, the others are those of the proof
        assert len(r["own"]) == len(r["proof"]) + 1 and r["own"][-1] == r["folded_root"]
        assert all(len(level) <= 7 for level in r["proof"])


def test_query_equals_sql(spark):
    got = mf.op12_merkle_manifest(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(mf.OP12_SQL)
    names = [c[0] for c in want.description]
    want = want.fetchall()
    assert names == got.columns and {tuple(r) for r in got.collect()} == set(want)
    assert len(want) == 200 and 0 < sum(not r[-1] for r in want) < 100
    docs = con.execute("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()
    assert sorted(r[:5] for r in want) == sorted(plain(docs))


def test_untouched_rows_verify_and_any_change_shows(spark):
    rows = [(i, "s", "en", 3, f"abc {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = mf.manifest(docs, F.lit(None).cast("string"), Scratch(spark, "t")).collect()
    assert all(r["folded_root"] == r["root"] for r in none)
    for c, value in (("source", F.lit(None).cast("string")), ("n_chars", F.lit(4)), ("text", F.lit(""))):
        some = mf.manifest(docs, mf.leaf(**{c: value}), Scratch(spark, "t")).collect()
        assert all(r["folded_root"] != r["root"] for r in some)


def test_odd_rows(spark, tmp_path):
    rows = [
        (None, None, None, None, None), (1, "", "", 0, ""), (1, "", "", 0, ""), (2, "-", None, 1, "-"), (3, "é", "é", 2, "Ñ" * 300_000),
        (None, "x", "", 5, "A"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("at", "n", "known", "name", "digest", "block")})
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    got = mf.op12_merkle_manifest(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(plain(rows), key=key)
    by = {r["leaf"]: r["verified"] for r in got}
    # a null id counts as empty text, whose crc32 is 0: tampered, which shows where there was a capital
    assert by[plain_leaf(rows[5])] is False and by[plain_leaf(rows[0])] is True
    one = mf.manifest(docs.filter("doc_id = 2"), F.lit(None).cast("string"), Scratch(spark, "t")).collect()
    assert [(r["leaf"], r["root"], r["proof_sha256"]) for r in one] == [(plain_leaf(rows[3]), plain_leaf(rows[3]), sha(""))]
    assert mf.manifest(docs.limit(0), F.lit(None).cast("string"), Scratch(spark, "t")).count() == 0


def test_heights_and_paths():
    assert [mf.height(n) for n in (1, 2, 8, 9, 64, 65, 4096, 5000)] == [0, 1, 1, 2, 2, 3, 4, 4]
    block = mf.Block(list("abcdefghij"), 2)
    assert block.path(9) == [(1, ["i"]), (1, [sha("abcdefgh")])]
    assert mf.version("j", block.path(9))[-1] == block.top
    assert re.fullmatch("[0-9a-f]{64}", block.top)
