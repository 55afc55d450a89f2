"""Periodic runs of words: multi-scale minimizers seed extension, direct lag scans cover short periods.

A run is a stretch of words with smallest period q, of at least max(MIN_LENGTH, 2 * q) words, that no neighbouring
word extends. Lags below ``2 * _FIRST - 1`` are scanned directly. For longer ones scale w = _FIRST, 2 * _FIRST, ...
looks for periods from 2w - 1 to 4w - 2:

* Each stretch of w words has a name, the same for equal stretches. In each window of w places the least scrambled
  name is a minimizer. Two windows a period apart in a run hold the same words, so a minimizer p of the first
  comes with a minimizer p + q of the second that has its name. Pairs of equal minimizers at a distance of this
  scale are seeds.
* Stretches that have themselves a period of w / 2 or less (they lie in runs already found) are no minimizers, which
  leaves at most eight partners a place. The one kind of run that loses its seed by that has a first period within a
  run of a shorter period, and the second in the next such run, which begins no later than the first ends: there
  the end of the first against the place a lag before it is a seed, for each lag of the scale.

A seed is extended to both sides in logarithmic time by comparing names of stretches of 2**k words. Names are
exact, not hashes, so runs are too. A text takes n log(n) steps; texts whose stretches of _FIRST words are all
different end after the direct scans.

Words are ``[^ \\t\\n\\v\\f\\r]+``. Null, empty and wordless texts have no words and no runs. Equal runs under two
periods keep the smaller one; runs are in order of start, then period. Repeated rows each have their result, an
empty table gives none. A text is worked on in one piece, in memory proportional to its words; texts do not meet
each other, so there is no shuffle. Columns to ``keep`` may not be called ``runs`` or ``collapsed``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import mix, rest, ship_code, table

MIN_LENGTH = 12
# Stretches of the first scale must be at least MIN_LENGTH words, so that those with a short period lie in runs.
_FIRST = 16
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)


def numbered(words: Sequence[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


class Names:
    """Names of the stretches of 2**k symbols from each place, and how far two places agree."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.levels = [symbols]
        # whether all stretches of the last level differ
        self.distinct = False

    def upto(self, level: int) -> None:
        """Names up to this level, or to the first one at which no stretch repeats, or the last one that fits."""
        while not self.distinct and len(self.levels) <= level:
            size, last = 1 << (len(self.levels) - 1), self.levels[-1]
            if 2 * size > self.n:
                return
            _, names = np.unique(last[:-size] * np.int64(self.n + 1) + last[size:], return_inverse=True)
            self.levels.append(names)
            self.distinct = bool(names.max() + 1 == len(names))

    def repeat(self, level: int) -> bool:
        self.upto(level)
        return level < len(self.levels) - self.distinct

    def forward(self, p: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Number of equal symbols from p and from r > p on."""
        far = np.zeros(len(p), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[k], 1 << k
            top = len(names) - 1
            # the last level with repeats may fit more than once: longer stretches have no names
            while True:
                right = r + far
                same = (right <= top) & (names[np.minimum(p + far, top)] == names[np.minimum(right, top)])
                if not same.any():
                    break
                far += same * size
                if k < len(self.levels) - 1:
                    break
        return far

    def backward(self, p: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Number of equal symbols before p and before r > p."""
        far = np.zeros(len(p), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[k], 1 << k
            top = len(names) - 1
            while True:
                left = p - far - size
                right = np.minimum(r - far - size, top)
                same = (left >= 0) & (r - far - size <= top) & (names[np.maximum(left, 0)] == names[np.maximum(right, 0)])
                if not same.any():
                    break
                far += same * size
                if k < len(self.levels) - 1:
                    break
        return far


def sliding(values: np.ndarray, size: int, best: np.ufunc, worst) -> np.ndarray:
    """Best of each ``size`` neighbours, in linear time: from the block's begin and from its end."""
    n = len(values) - size + 1
    blocks = -(-len(values) // size)
    padded = np.full(blocks * size, worst, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, size)
    begin = best.accumulate(grid, axis=1).ravel()
    end = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(end[:n], begin[size - 1 : size - 1 + n])


class Runs:
    """The runs of one sequence of symbols."""

    def __init__(self, symbols: np.ndarray, min_length: int = MIN_LENGTH):
        self.x, self.n, self.min_length = symbols, len(symbols), min(min_length, _FIRST)
        self.least = min_length
        # smallest period by (start, end)
        self.found: dict[tuple[int, int], int] = {}

    def add(self, start: int, end: int, period: int) -> None:
        if end - start >= max(self.min_length, 2 * period):
            known = self.found.get((start, end))
            if known is None or period < known:
                self.found[(start, end)] = period

    def scan(self, lag: int) -> None:
        same = self.x[lag:] == self.x[:-lag]
        need = max(self.min_length - lag, lag)
        if np.count_nonzero(same) < need:
            return
        breaks = np.concatenate(([-1], np.flatnonzero(~same), [len(same)]))
        for i in np.flatnonzero(np.diff(breaks) > need).tolist():
            self.add(int(breaks[i]) + 1, int(breaks[i + 1]) + lag, lag)

    def minimizers(self, names: np.ndarray, w: int) -> np.ndarray:
        """Places whose stretch has no period of w / 2 or less and the least scrambled name of some window."""
        inside = np.zeros(len(names) + 1, np.int64)
        for (start, end), q in self.found.items():
            if 2 * q <= w and end - start >= w:
                inside[start] += 1
                inside[end - w + 1] -= 1
        barred = np.cumsum(inside)[:-1] > 0
        order = mix(names.astype(np.uint64) + np.uint64(1)) >> np.uint64(1)
        top = np.uint64((1 << 64) - 1)
        order[barred] = top
        size = min(w, len(order))
        least = sliding(order, size, np.minimum, top)
        # the windows that hold a place: those that begin up to size - 1 before it
        edge = np.zeros(size - 1, np.uint64)
        widest = sliding(np.concatenate((edge, least, edge)), size, np.maximum, np.uint64(0))
        return np.flatnonzero((widest == order) & ~barred)

    def pairs(self, names: np.ndarray, places: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places with one name, 2w - 1 to 4w - 2 apart."""
        places = places[np.lexsort((places, names[places]))]
        value, left, lag = names[places], [], []
        for shift in range(1, len(places)):
            apart = places[shift:] - places[:-shift]
            near = (value[shift:] == value[:-shift]) & (apart <= 4 * w - 2)
            if not near.any():
                break
            hit = near & (apart >= 2 * w - 1)
            left.append(places[:-shift][hit])
            lag.append(apart[hit])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(left), np.concatenate(lag)

    def seams(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Seeds where a run of period w / 2 or less ends within or beside the next run of the same period."""
        short = sorted((q, start, end) for (start, end), q in self.found.items() if 2 * q <= w and end - start >= 2 * w - 1)
        left, lag = [], []
        for (q, a, b), (r, c, d) in zip(short, short[1:]):
            if q == r and c <= b:
                lags = np.arange(2 * w - 1, min(4 * w - 2, b - a, d - c) + 1)
                lags = lags[self.x[b - lags] == self.x[b]]
                left.append(b - lags)
                lag.append(lags)
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(left), np.concatenate(lag)

    def all(self) -> list[tuple[int, int, int]]:
        """(start, length, period) in order of start, then period."""
        for lag in range(1, min(2 * _FIRST - 2, self.n // 2) + 1):
            self.scan(lag)
        names, w = Names(self.x), _FIRST
        while 2 * w - 1 <= self.n // 2:
            level = w.bit_length() - 1
            if not names.repeat(level):
                # nothing of w words repeats, so neither does a period of 2w - 1 or more
                break
            here = names.levels[level]
            seeds = [self.pairs(here, self.minimizers(here, w), w), self.seams(w)]
            at, lag = (np.concatenate(both) for both in zip(*seeds))
            if len(at):
                # extension needs names of longer stretches too
                names.upto(self.n.bit_length())
                start = at - names.backward(at, at + lag)
                end = at + lag + names.forward(at, at + lag)
                whole = end - start >= 2 * lag
                for found in set(zip(start[whole].tolist(), end[whole].tolist(), lag[whole].tolist())):
                    self.add(*found)
            w *= 2
        return sorted((s, e - s, q) for (s, e), q in self.found.items() if e - s >= max(self.least, 2 * q))


def runs_of(words: Sequence[str], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    return Runs(numbered(words), min_length).all() if len(words) >= 2 else []


def collapsed(words: Sequence[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run contains after its first period, one space between them."""
    if not runs:
        return " ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()])


def periodic_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), min_length: int = MIN_LENGTH) -> DataFrame:
    """The columns ``keep`` of docs, runs (start, length, period; from word 0) and collapsed, the text without the
    repeats in its runs."""
    if clash := {"runs", "collapsed"} & set(keep):
        raise ValueError(f"columns to keep are also result columns: {sorted(clash)}")
    ship_code(docs.sparkSession)

    run_type = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, short = [], []
            for text in b.column("text"):
                words = _WORD.findall(text.as_py() or "")
                runs = runs_of(words, min_length)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                short.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(found, run_type), pa.array(short, pa.string())], [*keep, "runs", "collapsed"]
            )

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    schema += "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*keep, "text"))]).mapInArrow(run, schema)


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of the documents, chosen by crc32 of the id, end in a run whose place and period follow from
    the id and the number of words."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    h = rest("doc_id", 1 << 32)
    g, n = F.floor(h / 10).cast("bigint"), F.size("__words").cast("bigint")
    marked = docs.withColumn("__words", F.when((h % 10 == 0) & F.col("text").isNotNull(), words))
    some = n > 0

    def word(x: Column, i: Column) -> Column:
        return F.when(i < F.col("__a"), x).otherwise(
            F.element_at("__words", (F.col("__a") + (i - F.col("__a")) % F.col("__p") + 1).cast("int"))
        )

    placed = marked.withColumn("__a", F.when(some, g % n))
    placed = placed.withColumn("__p", F.when(some, 1 + F.floor((n - F.col("__a")) / (3 + g % 8)).cast("bigint")))
    text = F.when(some, F.array_join(F.transform("__words", word), " ")).otherwise(F.col("text"))
    return placed.withColumn("text", text).drop("__words", "__a", "__p")


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, n_runs, the longest run, checksums of all runs and of the collapsed text, for every document."""
    docs = with_planted_tails(table(spark, sf, "documents").select("doc_id", "text"))
    found = periodic_runs(docs)

    def longer(best: Column, r: Column) -> Column:
        # runs come by start, then period: the first of the longest stays
        return F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best)

    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    best = F.col("best")
    return found.withColumn("best", F.aggregate("runs", nothing, longer)).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
