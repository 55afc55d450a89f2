"""Overlapping snapshots of a sliding feed, ingested run by run: the newest revision of every reading wins.

Each run of a 14-day feed repeats most of the run before, and may revise it. A reading is known by its keys and its
instant, a revision by when its snapshot was taken. The table is a log of revisions, one folder per micro-batch and
day: a batch is first reduced to its newest revision of each reading, then compared with what the log has for the
days it touches, and what is newer is appended. The table that readers see is the newest revision over the log.
So it does not depend on the order in which the files arrive, and no reading is ever too late: there is no
watermark. A batch that is run again after a failure replaces its own folder.

What came out of order is also listed in a side table, with the reason: ``superseded`` (a newer revision was known),
``backfilled`` (new, but older than the overlap; in the table all the same) and ``no instant`` (can't be placed).

Readings are compared by (keys, instant), whatever the keys, so a series that holds most of the rows is spread. Two
values of one reading in one snapshot: the greater counts. Null keys are a key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StructType

from ..functions.timeaxis import floor_hour

_BATCH, _DAY, _REVISION, _KNOWN = "batch", "day", "__revision", "__known"


def read_snapshots(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def newest(readings: DataFrame, keys: Sequence[str], instant: str, taken: str) -> DataFrame:
    """The newest revision of each reading, over a table of snapshots: the batch form of the feed."""
    others = [c for c in readings.columns if c not in (*keys, instant, taken)]
    revision = F.struct(taken, *others)
    found = readings.groupBy(*keys, instant).agg(F.max(revision).alias(_REVISION))
    return found.select(*[F.col(c) if c in (*keys, instant) else F.col(f"{_REVISION}.`{c}`").alias(c) for c in readings.columns])


def hourly_means(readings: DataFrame, keys: Sequence[str], instant: str, value: str) -> DataFrame:
    return readings.groupBy(*keys, floor_hour(instant).alias("hour")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


class Feed:
    """The table of a feed under ``target``. ``schema`` is that of the snapshots, with ``taken``, the instant of the
    snapshot that gave the row; ``overlap`` the days that a run normally repeats."""

    def __init__(
        self, spark: SparkSession, target: str, schema: str | StructType, keys: Sequence[str], instant: str, taken: str, overlap: int = 15
    ):
        self.spark, self.target = spark, target.rstrip("/")
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.keys, self.instant, self.taken, self.overlap = list(keys), instant, taken, overlap

    def _folders(self, name: str) -> list[int]:
        """Numbers of the complete folders of a kind, ascending."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.target}/{name}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        found = [s.getPath() for s in system.listStatus(path) if s.isDirectory()]
        done = [p for p in found if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def _read(self, folders: list[str], schema: StructType) -> DataFrame:
        """All folders as one frame; each may be partitioned by itself."""
        found = self.spark.createDataFrame([], schema)
        for folder in folders:
            found = found.unionByName(self.spark.read.schema(schema).parquet(folder))
        return found

    def log(self, before: int | None = None) -> DataFrame:
        """All revisions kept, with ``day``; of the batches before a given one."""
        schema = StructType([*self.schema.fields]).add(_DAY, DateType())
        earlier = lambda n: before is None or n < before
        base = [n for n in self._folders("base") if earlier(n)][-1:]
        batches = [n for n in self._folders("log") if earlier(n) and (not base or n > base[0])]
        folders = [f"{self.target}/base/{_BATCH}={n}" for n in base] + [f"{self.target}/log/{_BATCH}={n}" for n in batches]
        return self._read(folders, schema)

    def current(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """The newest revision of every reading; of a span of days only their folders are read."""
        log = self.log()
        if first is not None:
            log = log.filter(F.col(_DAY) >= F.lit(first))
        if last is not None:
            log = log.filter(F.col(_DAY) <= F.lit(last))
        return newest(log.drop(_DAY), self.keys, self.instant, self.taken)

    def late(self) -> DataFrame:
        """Rows that came out of order, with ``reason``."""
        folders = [f"{self.target}/late/{_BATCH}={n}" for n in self._folders("late")]
        return self._read(folders, StructType([*self.schema.fields]).add("reason", "string"))

    def hourly(self, value: str) -> DataFrame:
        return hourly_means(self.current(), self.keys, self.instant, value)

    def merge(self, batch: DataFrame, number: int) -> None:
        """One micro-batch into the log. May be run again with the same number."""
        day = F.col(self.instant).cast("date")
        found = newest(batch.filter(F.col(self.instant).isNotNull()), self.keys, self.instant, self.taken).withColumn(_DAY, day)
        others = [c for c in self.schema.names if c not in (*self.keys, self.instant)]
        # a revision compares by when it was taken, then by its values
        revision = F.struct(self.taken, *[c for c in others if c != self.taken])
        log = self.log(before=number)
        # one row per day of the batch: the calendar bounds them
        days = F.broadcast(found.select(_DAY).distinct())
        known = log.join(days, _DAY, "left_semi").groupBy(*self.keys, self.instant).agg(F.max(revision).alias(_KNOWN))
        decided = self._matched(found, known, [*self.keys, self.instant])
        decided = self._matched(decided, self._horizon(number), self.keys)
        newer = F.col(_KNOWN).isNull() | (revision > F.col(_KNOWN))
        old = F.col(_DAY) < F.date_sub(F.col("__upto").cast("date"), self.overlap)
        decided = decided.withColumn("__newer", newer).withColumn(
            "reason", F.when(~newer & (revision < F.col(_KNOWN)), "superseded").when(newer & old & F.col(_KNOWN).isNull(), "backfilled")
        )
        decided.persist()
        try:
            fresh = decided.filter("__newer").select(*self.schema.names, _DAY)
            # few files a day, a large day in several
            fresh.hint("rebalance", _DAY).write.partitionBy(_DAY).mode("overwrite").parquet(f"{self.target}/log/{_BATCH}={number}")
            nowhere = batch.filter(F.col(self.instant).isNull()).select(*self.schema.names, F.lit("no instant").alias("reason"))
            late = decided.filter(F.col("reason").isNotNull()).select(*self.schema.names, "reason").unionByName(nowhere)
            late.write.mode("overwrite").parquet(f"{self.target}/late/{_BATCH}={number}")
            upto = decided.groupBy(*self.keys).agg(F.max(self.instant).alias("__upto"))
            upto.write.mode("overwrite").parquet(f"{self.target}/horizon/{_BATCH}={number}")
        finally:
            decided.unpersist()

    def _horizon(self, number: int) -> DataFrame:
        """The last instant of each series before a batch."""
        fields = [f for f in self.schema.fields if f.name in self.keys]
        schema = StructType(fields).add("__upto", self.schema[self.instant].dataType)
        folders = [f"{self.target}/horizon/{_BATCH}={n}" for n in self._folders("horizon") if n < number]
        return self._read(folders, schema).groupBy(*self.keys).agg(F.max("__upto").alias("__upto"))

    @staticmethod
    def _matched(rows: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
        """rows with what ``other`` has for the same columns, nulls alike."""
        other = other.withColumnsRenamed({c: f"__of_{c}" for c in columns})
        same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in columns]
        return rows.join(other, same, "left").drop(*[f"__of_{c}" for c in columns])

    def ingest(self, source: str, checkpoint: str, files_per_batch: int | None = None) -> None:
        """Merge the snapshots that are new under ``source``, then stop (one scheduled run)."""
        query = (
            read_snapshots(self.spark, source, self.schema, files_per_batch)
            .writeStream.foreachBatch(self.merge)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def compact(self) -> None:
        """Write the newest revisions of all batches but the last, which a restart may repeat, as one base; then
        remove the folders that it replaces. To be run between two runs of ``ingest``."""
        batches = self._folders("log")[:-1]
        if not batches:
            return
        upto = batches[-1]
        log = self.log(before=upto + 1)
        kept = newest(log.drop(_DAY), self.keys, self.instant, self.taken).withColumn(_DAY, F.col(self.instant).cast("date"))
        older = self._folders("base")
        kept.hint("rebalance", _DAY).write.partitionBy(_DAY).mode("overwrite").parquet(f"{self.target}/base/{_BATCH}={upto}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for folder in [f"base/{_BATCH}={n}" for n in older if n < upto] + [f"log/{_BATCH}={n}" for n in batches]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.target}/{folder}")
            path.getFileSystem(conf).delete(path, True)
