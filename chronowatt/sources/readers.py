"""File readers with declared schemas. Labels that look like instants are read as text on purpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, sep: str = ";", header: bool = True
) -> DataFrame:
    """CSV under a declared schema; the header must carry the declared names, in order.

    A value that does not fit its type fails the read instead of turning into NULL.
    """
    return (
        spark.read.option("sep", sep)
        .option("header", header)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .schema(schema)
        .csv(list(path) if not isinstance(path, str) else path)
    )


def read_csv_named(
    spark: SparkSession, path: str, wanted: dict[str, str], sep: str = ";"
) -> DataFrame:
    """Only the wanted columns of a CSV, found by name (quoted or not), with explicit types.

    Every column is read as text first, so an odd value in an unused one cannot fail the build; the
    wanted ones are converted and fail loudly. Spark prunes the others from the parse.
    """
    raw = spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path)
    return raw.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in wanted.items()])


def read_csv_ragged(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV with a byte-order mark and short rows: missing trailing fields become NULL.

    The header line is dropped and the declared columns apply by position. Text that is not a
    number fails, which a permissive numeric read would hide.
    """
    declared = T._parse_datatype_string(schema)
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in declared.fields])
    raw = spark.read.option("sep", sep).option("header", True).schema(as_text).csv(path)
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in declared.fields])


def read_csv_union_by_name(
    spark: SparkSession, paths: Sequence[str], sep: str = ";", columns: Sequence[str] | None = None
) -> DataFrame:
    """Several (gzipped) CSV files with differing columns, as text, aligned by name.

    ``columns`` are taken from each file before the union, so a 200-column file is parsed for those
    alone; a column a file lacks is NULL there.
    """
    frames = []
    for path in paths:
        raw = spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path)
        frames.append(raw.select(*[F.col(f"`{c}`") for c in columns if c in raw.columns]) if columns else raw)
    out, *rest = frames
    for frame in rest:
        out = out.unionByName(frame, allowMissingColumns=True)
    if columns:
        absent = [c for c in columns if c not in out.columns]
        if absent:
            raise ValueError(f"no file has the columns {absent}")
    return out


def read_parquet_union(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Parquet files with differing columns, aligned by name."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.option("mergeSchema", True).parquet(*paths)


def constant_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A dimension written in code (station list, code map)."""
    return spark.createDataFrame(list(rows), schema)


def proof_extract(raw: DataFrame, territory: str, years: Sequence[int], months: Sequence[str], label: str = "date_heure") -> DataFrame:
    """Raw lines of a territory, years and months, chosen on the label's text and left untouched."""
    text = F.col(label)
    return raw.filter(
        (F.col("territoire") == territory)
        & F.substring(text, 1, 4).cast("int").isin(*years)
        & F.substring(text, 6, 2).isin(*months)
    )
