"""Contracts of raw files: is this the data that was asked for, and not an error page?

Judged for a whole table of files, each read once as a stream (see ``fingerprints.inspected``, which can certify the
content in the same reading). A header is everything before the first line break; the rules for XML hold for the whole
prolog, however long; a gzip is read to its end, so a truncated or altered member is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .fingerprints import CONTRACT, inspected

__all__ = ["CONTRACT", "gzip_header_problems", "parquet_column_problems", "violations"]


def violations(files_table: DataFrame, contracts: DataFrame) -> DataFrame:
    """file, problem. ``files_table``: see ``fingerprints.files``; ``contracts``: see :data:`CONTRACT`."""
    return inspected(files_table, contracts=contracts).select("file", "problem").filter("problem is not null")


def gzip_header_problems(spark: SparkSession, path: str, delimiter: str, columns: list[str]) -> list[str]:
    """The rules of a header for a gzipped CSV, from the header alone (Spark decompresses it)."""
    found = spark.read.option("sep", delimiter).option("header", True).option("inferSchema", False).csv(path).columns
    if len(found) < 2:
        return [f"header is not tabular: {found}"]
    absent = [c for c in columns if c not in found]
    return [f"missing columns: {','.join(absent)}"] if absent else []


def parquet_column_problems(spark: SparkSession, path: str, columns: list[str]) -> list[str]:
    """Expected columns a Parquet file lacks, from its footer alone."""
    found = spark.read.parquet(path).columns
    absent = [c for c in columns if c not in found]
    return [f"missing columns: {','.join(absent)}"] if absent else []
