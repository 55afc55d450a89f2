"""Table writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_ordered(df: DataFrame, path: str, order: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Globally ordered files: ranges of the leading keys per file, sorted inside.

    Range partitioning samples the keys, so a hot leading key is cut by the ones after it; give
    enough of them to tell rows apart.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
