import glob
import hashlib
import os
import shutil

import pytest
from pyspark.sql import functions as F

from chronowatt.operators.quality import GuardError, check_empty, claims, duplicates
from chronowatt.plans import build as K
from chronowatt.plans.build import Context, LineageError, Output
from chronowatt.sources.fingerprints import FingerprintMismatch

MANIFEST = "source_id string, filename string, sha256 string, date_collecte string, ignore_xml array<string>, decompressed boolean"


def outputs(fail=False):
    def base(ctx: Context):
        return ctx.spark.read.option("header", True).schema("k string, v int").csv(ctx.raw["src"])

    def derived(ctx: Context):
        total = ctx.staged("base").groupBy("k").agg(F.sum("v").alias("v"))
        return total.filter("false") if fail else total

    unique = lambda t, ctx: check_empty({"k twice": duplicates(t, ["k"])}, "derived")
    return [
        Output("base", base, ["src"], order=("v", "k")),
        Output("derived", derived, ["src"], derived_from=("base",), after=unique),
        Output("optional", base, ["absent_source"]),
        Output("after_optional", base, ["src"], derived_from=("optional",)),
    ]


@pytest.fixture
def site(spark, tmp_path):
    text = "k,v\na,1\nb,2\na,3\n"
    (tmp_path / "src.csv").write_text(text)
    manifest = spark.createDataFrame(
        [("src", "src.csv", hashlib.sha256(text.encode()).hexdigest(), "2026-10-01", None, False)], MANIFEST
    )
    return str(tmp_path / "out"), {"src": str(tmp_path / "src.csv")}, manifest, tmp_path


def run(spark, site, run_id, fail=False, manifest=None):
    root, raw, good, _ = site
    chosen = K.plan(outputs(fail), raw)
    return K.run_build(spark, root, run_id, chosen, raw, manifest or good, code_version="abc", built_at="2026-10-02 00:00:00")


def test_build_plan_keeps_order_and_conditions():
    assert [o.name for o in K.plan(outputs(), ["src"])] == ["base", "derived"]
    assert [o.name for o in K.plan(outputs(), ["src", "absent_source"])] == ["base", "derived", "optional", "after_optional"]
    assert K.plan(outputs(), []) == []


def test_published_tables_and_lineage(spark, site):
    run(spark, site, "r1")
    root = site[0]
    assert sorted(map(tuple, K.published(spark, root, "derived").collect())) == [("a", 4), ("b", 2)]
    K.verify_outputs(spark, root)
    assert K.collected_on(spark, root, "src") == "2026-10-01"
    with pytest.raises(LineageError):
        K.collected_on(spark, root, "other")
    run(spark, site, "r2")
    assert K.current_run(spark, root).endswith("/runs/r2")
    with pytest.raises(ValueError, match="exists"):
        run(spark, site, "r2")


def test_failure_leaves_the_previous_publication(spark, site):
    run(spark, site, "r1")
    with pytest.raises(GuardError, match="empty table"):
        run(spark, site, "r2", fail=True)
    assert K.current_run(spark, site[0]).endswith("/runs/r1")
    K.verify_outputs(spark, site[0])


def test_inputs_must_be_certified(spark, site):
    root, raw, manifest, _ = site
    with pytest.raises(FingerprintMismatch):
        run(spark, site, "r1", manifest=manifest.withColumn("sha256", F.lit("0" * 64)))
    with pytest.raises(GuardError, match="absent from the manifest"):
        run(spark, site, "r1", manifest=manifest.filter("false"))
    with pytest.raises(LineageError, match="no published run"):
        K.current_run(spark, root)


def test_stray_and_altered_tables_are_refused(spark, site):
    path = run(spark, site, "r1")
    shutil.copytree(f"{path}/base", f"{path}/stray")
    with pytest.raises(LineageError, match="outside the lineage"):
        K.verify_outputs(spark, site[0])
    path = run(spark, site, "r2")
    spark.createDataFrame([("z", 9)], "k string, v int").write.mode("append").parquet(f"{path}/base")
    with pytest.raises(LineageError, match="altered content"):
        K.verify_outputs(spark, site[0])


def test_lineage_shape(spark):
    sha = "a" * 64
    outs = spark.createDataFrame([("t", ["s"]), ("u", []), ("w", ["ghost"])], "output string, sources array<string>")
    files = spark.createDataFrame([("t", "f", sha), ("u", "f", "XYZ")], "output string, file string, sha256 string")
    sources = spark.createDataFrame([("s", "f.csv", sha, "2026-01-01"), ("q", "", sha, None)], "source_id string, filename string, sha256 string, date_collecte string")
    present = spark.createDataFrame([("t",), ("x",)], "output string")
    got = {(r.problem, r.key) for r in K.lineage_problems(outs, files, sources, present, files).collect()}
    assert got == {
        ("output without source", "u"), ("unknown source", "w/ghost"), ("incomplete source", "q"), ("invalid hash", "u/f"),
        ("output without hash", "w"), ("table outside the lineage", "x"), ("missing table", "u"), ("missing table", "w"),
    }


def test_contracts_and_checks_come_before_any_table(spark, site):
    from chronowatt.sources.contracts import CONTRACT

    root, raw, manifest, folder = site
    chosen = K.plan(outputs(), raw)
    contract = lambda column: spark.createDataFrame([("src.csv", "csv", ",", ["k", column], None, None), ("other.csv", "csv", ",", ["z"], None, None)], CONTRACT)
    with pytest.raises(GuardError, match="missing columns: w"):
        K.run_build(spark, root, "r1", chosen, raw, manifest, contracts=contract("w"))

    def refuse(ctx):
        raise GuardError("refused")

    last = Output("late", chosen[0].build, ["src"], before=refuse)
    with pytest.raises(GuardError, match="refused"):
        K.run_build(spark, root, "r1", [*chosen, last], raw, manifest)
    assert not (folder / "out").exists()
    K.run_build(spark, root, "r1", chosen, raw, manifest, contracts=contract("v"))
    assert K.published(spark, root, "derived").count() == 2


def test_one_changed_row_is_found_in_a_table_of_any_file_size(spark, site):
    """The hash of a file is that of its rows, in any order; a row changed within the same file is found."""
    path = run(spark, site, "r1")
    before = K.table_files(spark, path, "base").collect()
    table = spark.read.parquet(f"{path}/base")
    rows = table.collect()

    def rewrite(rows):
        # the same file name with other content
        (file,) = glob.glob(f"{path}/base/*.parquet")
        spark.createDataFrame(rows, table.schema).coalesce(1).write.mode("overwrite").parquet(f"{site[3]}/other")
        (other,) = glob.glob(f"{site[3]}/other/*.parquet")
        shutil.copy(other, file)
        for crc in glob.glob(f"{path}/base/.*.crc"):
            os.remove(crc)

    if len(before) == 1:
        rewrite(rows[::-1])
        assert K.table_files(spark, path, "base").first().sha256 == before[0].sha256
        K.verify_outputs(spark, site[0])
        rewrite([(r.k, r.v + (i == 1)) for i, r in enumerate(rows)])
        with pytest.raises(LineageError, match="altered content"):
            K.verify_outputs(spark, site[0])
    assert {(r.output, r.rows) for r in before} == {("base", 3)} or sum(r.rows for r in before) == 3


def test_content_hash_tells_nulls_columns_and_repeats_apart(spark):
    def of(rows, schema="a int, b int, c array<int>"):
        return K.content_hash(spark.createDataFrame(rows, schema), []).first().sha256

    one = of([(1, None, [1, None]), (2, 3, [])])
    assert one == of([(2, 3, []), (1, None, [1, None])])
    others = [
        of([(None, 1, [1, None]), (2, 3, [])]), of([(1, None, [None, 1]), (2, 3, [])]), of([(1, None, [1, None]), (2, 3, []), (2, 3, [])]),
        of([(1, None, [1, None]), (2, 3, None)]), of([(1, None, [1, None]), (2, 3, [])], "a int, z int, c array<int>"), of([]),
    ]
    assert len({one, *others}) == 7


def test_gates_stand_before_the_pointer(spark, site):
    root, raw, manifest, _ = site
    chosen = K.plan(outputs(), raw)

    def publish(run_id, *gates):
        return K.run_build(spark, root, run_id, chosen, raw, manifest, gates=gates)

    publish("r1", K.claims_gate("sums", "derived", lambda t: claims(t, {"positive": F.every(F.col("v") > 0)})))
    with pytest.raises(GuardError, match="sums: no longer true.*large"):
        publish("r2", K.claims_gate("sums", "derived", lambda t: claims(t, {"positive": F.every(F.col("v") > 0), "large": F.every(F.col("v") > 3)})))
    few = lambda c: {"few rows": c.staged("base").groupBy("k").count().filter("count < 2")}
    with pytest.raises(GuardError, match="enough: few rows.*'b'"):
        publish("r3", K.Gate("enough", ("base",), few))
    with pytest.raises(GuardError, match="enough: not built: absent"):
        publish("r4", K.Gate("enough", ("base", "absent"), few))
    assert K.current_run(spark, root).endswith("/r1")
    publish("r5", K.claims_gate("elsewhere", "absent", lambda t: t))
    assert K.current_run(spark, root).endswith("/r5")
