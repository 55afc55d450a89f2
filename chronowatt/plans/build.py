"""Guarded build: certified inputs, staged outputs, guards on what was written, one-step publication.

A run writes every table under ``<root>/runs/<run_id>/`` and readers follow the pointer file
``<root>/CURRENT``. The pointer moves once, after every table and the lineage are in place, so a
failure anywhere leaves the previous publication and its lineage as they were.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.quality import GuardError, check_empty
from ..session import cut_lineage
from ..sources.fingerprints import files as read_files, inspected, verify
from ..sources.sinks import write_ordered, write_table

POINTER = "CURRENT"
LINEAGE = "_lineage"
SHA = r"^[0-9a-f]{64}$"


class LineageError(ValueError):
    """The published tables and their lineage disagree; nothing may be read from them."""


@dataclass(frozen=True)
class Context:
    """What a builder may read: raw paths by source, and tables staged earlier in the same run."""

    spark: SparkSession
    raw: Mapping[str, str]
    run: str

    def staged(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.run}/{name}")


@dataclass(frozen=True)
class Output:
    """A table: how to build it, its raw sources, the tables it derives from, its guards.

    ``before`` checks what the builder may read, for all tables before the first is built; ``after`` checks the
    staged table, as it was written.
    """

    name: str
    build: Callable[[Context], DataFrame]
    sources: Sequence[str]
    derived_from: Sequence[str] = ()
    order: Sequence[str] = ()
    before: Callable[[Context], None] | None = field(default=None)
    after: Callable[[DataFrame, Context], None] | None = field(default=None)


@dataclass(frozen=True)
class Gate:
    """A check between the last table and the publication: ``violations`` derives, from the tables it ``needs``, frames that
    must be empty. A gate whose tables are not all built stops the publication too, unless ``optional``."""

    name: str
    needs: Sequence[str]
    violations: Callable[[Context], Mapping[str, DataFrame]]
    optional: bool = False


def claims_gate(name: str, needs: str, claims: Callable[[DataFrame], DataFrame]) -> Gate:
    """A gate of publication claims: ``claims`` gives (name, ok) rows over a table; each must be true."""
    untrue = lambda c: {"no longer true": claims(c.staged(needs)).filter("ok is distinct from true").select("name")}
    return Gate(name, (needs,), untrue, optional=True)


def pass_gates(context: Context, gates: Sequence[Gate], built: Sequence[str]) -> None:
    for gate in gates:
        absent = sorted(set(gate.needs) - set(built))
        if absent and gate.optional:
            continue
        if absent:
            raise GuardError(f"{gate.name}: not built: {', '.join(absent)}")
        check_empty(gate.violations(context), gate.name)


def plan(outputs: Iterable[Output], available: Iterable[str]) -> list[Output]:
    """Outputs whose sources are all present, each after the tables it derives from."""
    have, chosen, names = set(available), [], set()
    for out in outputs:
        if set(out.sources) <= have and set(out.derived_from) <= names:
            chosen.append(out)
            names.add(out.name)
    return chosen


def check_inputs(
    spark: SparkSession, manifest: DataFrame, raw: Mapping[str, str], needed: Sequence[str], contracts: DataFrame | None = None
) -> DataFrame:
    """Every needed source is in the manifest, has the certified content and keeps its contract (see
    ``sources.contracts``; files without one are not judged); returns the manifest's entries.

    ``manifest``: source_id, filename, sha256, date_collecte, ignore_xml, decompressed.
    """
    wanted = spark.createDataFrame([(s,) for s in sorted(set(needed))], "source_id string")
    check_empty({"source absent from the manifest": wanted.join(manifest, "source_id", "left_anti")}, "inputs")
    entries = manifest.join(wanted, "source_id", "left_semi")
    rules = entries.select(F.col("filename").alias("file"), "sha256", "ignore_xml", "decompressed")
    judged = None if contracts is None else contracts.join(rules.select("file"), "file", "left_semi")
    # every file is read once, for its hash and its contract
    found = cut_lineage(inspected(read_files(spark, [raw[s] for s in sorted(set(needed))]), rules, judged))
    verify(found, rules)
    check_empty({"contract": found.select("file", "problem").filter("problem is not null")}, "inputs")
    return entries.select("source_id", "filename", "sha256", "date_collecte")


_SEEDS = (11, 23, 37, 53)


def content_hash(df: DataFrame, by: Sequence[Column]) -> DataFrame:
    """``by``, rows and sha256 of the rows as a multiset: for each seed the sum of the rows' hashes, as exact decimals. A row
    counts with all columns, a NULL as such; the order of rows does not count. It is summed where the rows are read."""
    parts: list[Column] = []
    for field_ in df.schema.fields:
        c = F.col(f"`{field_.name}`")
        parts += [c.isNull(), c]
        if field_.dataType.typeName() in ("array", "struct", "map"):
            # a hash passes over NULLs inside, their text does not
            parts[-1] = c.cast("string")
    sums = [F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)")).alias(f"s{seed}") for seed in _SEEDS]
    found = df.groupBy(*by).agg(F.count("*").alias("rows"), *sums)
    names = F.lit(",".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields))
    text = F.concat_ws(";", names, "rows", *[F.coalesce(F.col(f"s{s}"), F.lit(0)).cast("string") for s in _SEEDS])
    return found.withColumn("sha256", F.sha2(text.cast("binary"), 256)).drop(*[f"s{s}" for s in _SEEDS])


def table_files(spark: SparkSession, run: str, name: str) -> DataFrame:
    """output, file, sha256 (of the content), size, rows of a staged table's data files, of any size."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
        .load(f"{run}/{name}")
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"))
    )
    table = spark.read.parquet(f"{run}/{name}")
    content = content_hash(table, [F.col("_metadata.file_name").alias("file")])
    joined = listed.join(content, "file", "left")
    # a file without rows
    empty = F.sha2(F.lit("no rows").cast("binary"), 256)
    return joined.select(
        F.lit(name).alias("output"), "file", F.coalesce("sha256", empty).alias("sha256"), "size", F.coalesce("rows", F.lit(0)).alias("rows")
    )


def run_build(
    spark: SparkSession,
    root: str,
    run_id: str,
    outputs: Sequence[Output],
    raw: Mapping[str, str],
    manifest: DataFrame,
    code_version: str = "unknown",
    built_at: str | None = None,
    contracts: DataFrame | None = None,
    gates: Sequence[Gate] = (),
) -> str:
    """Build and publish; returns the run's folder. All ``gates`` must let the staged tables pass before the pointer moves."""
    if not outputs:
        raise ValueError("nothing to build: no output has all its sources")
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"run id {run_id!r} is not a plain name")
    run = f"{root}/runs/{run_id}"
    if _exists(spark, run):
        raise ValueError(f"{run} exists already; a run never overwrites another")
    entries = check_inputs(spark, manifest, raw, [s for o in outputs for s in o.sources], contracts)
    context = Context(spark, raw, run)
    for out in outputs:
        if out.before:
            out.before(context)
    files = None
    for out in outputs:
        frame = out.build(context)
        path = f"{run}/{out.name}"
        write_ordered(frame, path, out.order) if out.order else write_table(frame, path)
        staged = spark.read.parquet(path)
        if staged.isEmpty():
            raise GuardError(f"{out.name}: empty table")
        if out.after:
            out.after(staged, context)
        one = table_files(spark, run, out.name)
        files = one if files is None else files.unionByName(one)
    pass_gates(context, gates, [o.name for o in outputs])
    rows = [(o.name, list(o.sources), list(o.derived_from)) for o in outputs]
    moment = F.lit(built_at).cast("timestamp") if built_at else F.current_timestamp()
    declared = spark.createDataFrame(rows, "output string, sources array<string>, derived_from array<string>")
    write_table(declared.select("*", moment.alias("built_at"), F.lit(code_version).alias("code_version")), f"{run}/{LINEAGE}/outputs")
    write_table(files, f"{run}/{LINEAGE}/files")
    write_table(entries, f"{run}/{LINEAGE}/sources")
    _point(spark, root, run_id)
    return run


def lineage_problems(outputs: DataFrame, files: DataFrame, sources: DataFrame, present: DataFrame, found: DataFrame) -> DataFrame:
    """problem, key: malformed or missing lineage, tables outside it, changed content.

    outputs(output, sources), files(output, file, sha256), sources(source_id, filename, sha256,
    date_collecte), present(output) = tables in the folder, found(output, file, sha256) = their files.
    """

    def rows(df: DataFrame, label: str, key: Column) -> DataFrame:
        return df.select(F.lit(label).alias("problem"), key.alias("key"))

    used = outputs.select("output", F.explode_outer("sources").alias("source_id"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    key = ["output", "file"]
    then, now = files.select(*key, "sha256"), found.select(*key, F.col("sha256").alias("now"))
    compared = then.join(now, key, "full")
    parts = [
        rows(outputs.filter(F.coalesce(F.size("sources"), F.lit(0)) == 0), "output without source", F.col("output")),
        rows(
            used.filter(F.col("source_id").isNotNull()).join(sources, "source_id", "left_anti"),
            "unknown source",
            F.concat_ws("/", "output", "source_id"),
        ),
        rows(
            sources.filter(blank("filename") | blank("sha256") | blank("date_collecte")),
            "incomplete source",
            F.col("source_id"),
        ),
        rows(files.filter(~F.coalesce(F.col("sha256").rlike(SHA), F.lit(False))), "invalid hash", F.concat_ws("/", *key)),
        rows(outputs.join(files.select("output").distinct(), "output", "left_anti"), "output without hash", F.col("output")),
        rows(present.join(outputs, "output", "left_anti"), "table outside the lineage", F.col("output")),
        rows(outputs.join(present, "output", "left_anti"), "missing table", F.col("output")),
        rows(
            compared.filter(~F.col("sha256").eqNullSafe(F.col("now"))), "altered content", F.concat_ws("/", *key)
        ),
    ]
    out, *rest = parts
    for p in rest:
        out = out.unionByName(p)
    return out


def read_lineage(spark: SparkSession, root: str) -> tuple[str, DataFrame, DataFrame, DataFrame]:
    run = current_run(spark, root)
    outputs, files, sources = (spark.read.parquet(f"{run}/{LINEAGE}/{t}") for t in ("outputs", "files", "sources"))
    return run, outputs, files, sources


def verify_outputs(spark: SparkSession, root: str, examples: int = 5) -> None:
    """Refuse to publish from tables that are altered, missing, or outside the lineage."""
    run, outputs, files, sources = read_lineage(spark, root)
    if outputs.isEmpty() or sources.isEmpty():
        raise LineageError("empty lineage")
    names = [n for n in _children(spark, run) if n != LINEAGE]
    present = spark.createDataFrame([(n,) for n in names], "output string")
    found = None
    for name in names:
        one = table_files(spark, run, name)
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise LineageError("no table in the published run")
    bad = lineage_problems(outputs, files, sources, present, found).limit(examples).collect()
    if bad:
        raise LineageError(str([r.asDict() for r in bad]))


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{current_run(spark, root)}/{name}")


def collected_on(spark: SparkSession, root: str, source_id: str) -> str:
    """Collection date of the data actually built, with no fallback."""
    _, _, _, sources = read_lineage(spark, root)
    row = sources.filter(F.col("source_id") == source_id).select("date_collecte").first()
    if row is None:
        raise LineageError(f"{source_id} is not in the lineage of the published tables")
    return row[0]


def current_run(spark: SparkSession, root: str) -> str:
    pointer = f"{root}/{POINTER}"
    if not _exists(spark, pointer):
        raise LineageError(f"{root} has no published run")
    return f"{root}/runs/{spark.read.text(pointer).first()[0].strip()}"


# ---- file-system steps, through the file system Spark itself uses ---------------------------------


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def _children(spark: SparkSession, path: str) -> list[str]:
    return sorted(s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, path)) if s.isDirectory())


def _point(spark: SparkSession, root: str, run_id: str) -> None:
    """Write the pointer beside its place, then rename it over the old one."""
    temporary = f"{root}/.{POINTER}.{run_id}"
    stream = _fs(spark, temporary).create(_path(spark, temporary), True)
    try:
        stream.write(bytearray(f"{run_id}\n".encode()))
    finally:
        stream.close()
    jvm = spark._jvm
    target = _path(spark, f"{root}/{POINTER}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _fs(spark, root).getUri(), spark._jsc.hadoopConfiguration()
    )
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(_path(spark, temporary), target, options)
