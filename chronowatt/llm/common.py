"""What the operators of this folder share: tables, scratch tables, label samples, rolling hashes.

Scratch tables are Parquet folders below the folder that ``spark.checkpoint.dir`` names, which driver
and executors share; they survive the loss of any executor.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(_BASE)
_ODD_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_SMALL = np.uint64(1)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


class Scratch:
    """Tables of one run of an operator. ``keep`` writes a frame and reads it back; ``drop`` removes one
    that nothing reads any more, so that disk use stays that of the tables in use."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/scratch-{name}-{uuid.uuid4().hex}"
        self.written = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.written:03d}"
        self.written += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def rest(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo: the fold of a row. NULL ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def held_out(column: str, modulus: int, remainder: int) -> Column:
    return rest(column, modulus) == remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """text and label (double) of at most ``rows`` labelled documents to learn from, chosen by the hash of
    their id. An id labelled twice counts with its higher label, an id with several texts with the least
    of them; rows without id, label or text are not learnt from. The chosen ids are a bounded list, which
    is why they may be broadcast."""
    ship_code(docs.sparkSession)
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .filter(learn)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("double")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return (
        docs.filter(F.col("text").isNotNull())
        .select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )


def ship_code(spark: SparkSession) -> None:
    """Makes this package importable on the executors, whatever their search path: Spark hands out an archive of
    it, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_chronowatt_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "chronowatt.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._chronowatt_shipped = True


def share(spark: SparkSession, value):
    """A model of bounded size for the executors, and the code that uses it."""
    ship_code(spark)
    return spark.sparkContext.broadcast(value)


def give_back() -> None:
    """Return freed memory to the system: the driver goes on to other stages, beside a JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# -- hashes of words and of runs of words, without a loop over words -----------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as the longest text so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate(([_SMALL], np.full(size - 1, _ODD))))
            self.down = np.cumprod(np.concatenate(([_SMALL], np.full(size - 1, _ODD_INVERSE))))


_POWERS = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse."""
    _POWERS.upto(n)
    return _POWERS.up, _POWERS.down


class Words:
    """The words of one text as byte ranges with a prefix hash, so that the hash of any run of words is one
    subtraction. ``text`` holds words separated by single spaces."""

    __slots__ = ("n", "starts", "ends", "_prefix")

    def __init__(self, text: str):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if not len(data):
            self.n = 0
            self.starts = self.ends = np.zeros(0, np.int64)
            return
        _POWERS.upto(len(data) + 1)
        gaps = np.flatnonzero(data == 32)
        self.starts = np.concatenate(([0], gaps + 1))
        self.ends = np.concatenate((gaps, [len(data)]))
        self.n = len(self.starts)
        self._prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _SMALL) * _POWERS.up[: len(data)], out=self._prefix[1:])

    def runs(self, size: int) -> np.ndarray:
        """Hash of each run of ``size`` words; of the whole text if it has fewer words, but one."""
        if not self.n:
            return np.zeros(0, np.uint64)
        size = min(size, self.n)
        first = self.starts[: self.n - size + 1]
        return mix((self._prefix[self.ends[size - 1 :]] - self._prefix[first]) * _POWERS.down[first])


def spaced(text: str | None) -> str:
    """Lower-case words of a text, one space between them."""
    return " ".join((text or "").lower().split())
