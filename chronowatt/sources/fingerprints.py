"""Content fingerprints of raw files, one row per file.

Three rules: the raw bytes; the decompressed content of a gzip (its header carries the compression
instant); an XML with the text of a few exact paths blanked (the envelope an API stamps anew on
every request). A rule travels with the certified hash.

What goes round in Spark is a table of paths: the task that gets a path reads the file as a stream, block by block, so
a file of any size takes little memory. The contracts of the files are judged in the same pass.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import streams


class FingerprintMismatch(ValueError):
    """A file no longer has the content that was certified."""


FILES = "file string, path string, size bigint, content binary"


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file (base name), path, size; content only for files of a store that executors can't open by themselves. Spark lists
    no empty files: they count as missing."""
    first = path if isinstance(path, str) else path[0]
    where = spark._jvm.org.apache.hadoop.fs.Path(first)
    scheme = where.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    raw = spark.read.format("binaryFile").load(path)
    streamed = scheme in (*streams.LOCAL, *streams.REMOTE)
    # without the column Spark lists the files and reads none
    content = F.lit(None).cast("binary") if streamed else F.col("content")
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.col("length").alias("size"), content.alias("content"))


def canonical_xml(content: bytes, ignored: list[str]) -> str:
    """The hash of :class:`streams.XmlDigest` of a document at hand."""
    digest = streams.XmlDigest(ignored)
    digest.feed(content)
    digest.close()
    return digest.result()


def decompressed(content: bytes) -> str:
    """SHA-256 of the content of all members of a gzip at hand."""
    digest = streams.Digest()
    gunzip = streams.Gunzip(digest)
    gunzip.feed(content)
    gunzip.close()
    return digest.result()


# Types of web pages, and the four bytes around a Parquet file.
HTML_TYPES = ("text/html", "application/xhtml+xml")
PARQUET_MAGIC = b"PAR1"
_CSV, _JSON = ("csv", "csv.gz"), ("json", "geojson")


def _judged(row, stream, start, consumer, error) -> str | None:
    """The first rule of its contract that a file breaks; None if it keeps them all."""
    kind = (row.content_type or "").split(";")[0].strip().lower()
    if kind in HTML_TYPES or start.is_page():
        return "web page instead of data"
    columns = list(row.columns) if row.columns is not None else []
    if row.format in _CSV:
        if error is not None:
            return f"gzip: {error}"
        header, names = consumer.names(row.delimiter or ",")
        if len(names) < 2:
            return f"header is not tabular: {header[:80]}"
        absent = [c for c in columns if c not in names]
    elif row.format in _JSON:
        if not consumer.valid:
            return "invalid JSON"
        return f"missing root key: {row.root}" if row.root is not None and not consumer.found else None
    elif row.format == "parquet":
        if consumer.size < 8:
            return "Parquet file too short"
        if (consumer.first, consumer.last) != (PARQUET_MAGIC, PARQUET_MAGIC):
            return "Parquet magic number missing"
        absent = []
        if columns:
            stream.seek(0)
            known = pq.ParquetFile(stream).schema_arrow.names
            absent = [c for c in columns if c not in known]
    elif row.format == "xml":
        if consumer.entities:
            return "XML with internal entities"
        if consumer.root is None:
            return "invalid XML"
        return f"unexpected root: {consumer.root}" if row.root is not None and consumer.root != row.root else None
    else:
        return None
    return f"missing columns: {','.join(absent)}" if absent else None


def _inspected(row) -> tuple[str | None, str | None, str | None]:
    """sha256, error, problem of one file, from one reading."""
    if row.path is None:
        return None, None, "missing file"
    ignored = list(row.ignore_xml) if row.ignore_xml is not None else []
    digest = streams.XmlDigest(ignored) if ignored else streams.Digest()
    whole = streams.Gunzip(digest) if row.decompressed and not ignored else digest
    start, consumer, checked = streams.Start(), None, []
    if row.judged:
        consumer = {
            **dict.fromkeys(_CSV, streams.Header), "parquet": streams.Ends, "xml": streams.Root, **dict.fromkeys(_JSON, lambda: streams.Json(row.root)),
        }.get(row.format, streams.Ends)()
        zipped = row.format == "csv.gz" or (row.format == "csv" and row.file.endswith(".gz"))
        checked = [start, streams.Gunzip(consumer) if zipped else consumer]
    with (streams.opened(row.path) if row.content is None else io.BytesIO(row.content)) as stream:
        error, *others = streams.through(stream, [whole, *checked])
        problem = _judged(row, stream, start, consumer, others[1]) if row.judged else None
    if error is not None:
        return None, f"{type(error).__name__}: {error}", problem
    return digest.result(), None, problem


CONTRACT = (
    "file STRING, format STRING, delimiter STRING, columns ARRAY<STRING>, root STRING, content_type STRING"
)


def inspected(files_table: DataFrame, rules: DataFrame | None = None, contracts: DataFrame | None = None) -> DataFrame:
    """file, sha256, error, problem of every file of the table and of the contracts. Each file is read once.

    ``rules``: file, ignore_xml ARRAY<STRING>, decompressed BOOLEAN; a file that cannot be read under its rule has a NULL
    hash and its error. ``contracts``: see :data:`CONTRACT`; files without one have no problem.
    """
    spark = files_table.sparkSession
    if rules is None:
        rules = spark.createDataFrame([], "file string, ignore_xml array<string>, decompressed boolean")
    if contracts is None:
        contracts = spark.createDataFrame([], CONTRACT)
    d = files_table.join(rules.select("file", "ignore_xml", F.coalesce("decompressed", F.lit(False)).alias("decompressed")), "file", "left")
    d = d.join(contracts.withColumn("judged", F.lit(True)), "file", "full")
    d = d.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("judged", "decompressed")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame([(row.file, *_inspected(row))], columns=["file", "sha256", "error", "problem"])

    # one path is one row: by size, large files come first and lie in tasks of their own
    return d.repartition("file").sortWithinPartitions(F.desc("size")).mapInPandas(run, "file string, sha256 string, error string, problem string")


def fingerprints(files_table: DataFrame, rules: DataFrame) -> DataFrame:
    """file, sha256, error, by the rules of :func:`inspected`."""
    return inspected(files_table, rules).select("file", "sha256", "error")


def mismatches(found: DataFrame, certified: DataFrame) -> DataFrame:
    """Certified files (file, sha256) that are missing, unreadable or changed."""
    return (
        certified.select("file", F.col("sha256").alias("expected"))
        .join(found, "file", "left")
        .filter(F.col("expected").isNull() | ~F.col("sha256").eqNullSafe(F.col("expected")))
        .select("file", "expected", F.col("sha256").alias("found"), "error")
    )


def verify(found: DataFrame, certified: DataFrame, examples: int = 5) -> None:
    bad = mismatches(found, certified).limit(examples).collect()
    if bad:
        raise FingerprintMismatch(f"content not certified: {[r.asDict() for r in bad]}")
