"""The pipeline: stages in order, columns, effects, odd rows, and the whole run against the stages by hand."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.01"


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "byte BPE"]


def test_run_applies_every_stage(spark, tmp_path):
    docs, counts = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
    total = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert total > counts[0] > counts[1] > counts[2] > counts[3] == counts[4] > 0.4 * total
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_every_stage_takes_odd_rows_and_no_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, key long, runs string, chance int, `a.b` int, topic_class array<int>"
    more = ("s", 1, "r", 2, 3, [1])
    passage = "\n".join(f"line {k} of a passage that many documents share" for k in range(12))
    rows = [
        (1, None, None, None, None, *more),
        (2, "", "en", "a", 0, *more),
        (3, passage, "en", "a", len(passage), *more),
        (4, f"first\n{passage}\nlast", "en", None, 7, *more),
        (5, "idiot moron scum", "en", "b", 16, *more),
        (6, "w " * 30_000, None, "b", 60_000, *more),
        (7, "a b c d e f g", "fr", "b", 13, *more),
        (7, "a b c d e f g", "fr", "b", 13, *more),
        (None, "a b c d e f g", "fr", "b", 13, *more),
    ]
    os.makedirs(tmp_path / "sf")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/sf/labels.parquet")
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        outs = [stage(spark, docs, str(tmp_path / "sf")) for _, stage in corpus_pipeline.STAGES]
        for out in outs[:-1]:
            assert out.columns == docs.columns
        got = [[(r["doc_id"], r["n_chars"]) for r in out.collect()] for out in outs[:-1]]
        if not docs.isEmpty():
            assert len(got[0]) == 9
            assert (4, len("first\nlast")) in got[1] and (1, None) in got[1]
            # 4 is nearly 3; null and empty are one text; 7 stands for its copies
            assert sorted(i for i, _ in got[2]) == [1, 3, 5, 6, 7]
        assert outs[-1].count() == docs.count()


def test_line_dedup_drops_what_it_empties(spark):
    passage = "\n".join(f"line {k} of a passage that many documents share" for k in range(12))
    docs = spark.createDataFrame([(1, passage, "en", "a", 1), (2, passage, "en", "a", 1), (3, "", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3]
