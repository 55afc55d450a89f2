"""Quality rules: a base rule, then robust multivariate outliers by language and source.

Each text gets a vector of transformed statistics: log mean word length, log of symbols by hundred words, arcsine
of the root of the share of repeated lines and of that of repeated words, log number of words. Within each language and
source, the minimum covariance determinant estimate is the mean and covariance of those three quarters of
the rows whose covariance has the smallest determinant. Two starts (the coordinates' medians with their
median deviations, and plain mean and variance) are improved by concentration steps: distances under the
estimate, the three quarters nearest rows, their mean and covariance, and again, until no group's determinant falls any
more (at most ``STEPS`` times); the start that ends with the
smaller determinant counts, and is reweighted once by the rows within its 97.5 % ellipsoid. Rows beyond the
``BEYOND`` quantile of the squared distance are rejected.

The cut between near and far rows comes from a histogram of the squared distances, in bins of about 0.1 %,
counted by group, and rows of the cut's own bin are all taken, so nothing is ordered in one place. A variance below
its floor (``FLOORS``) is raised to it, without which a statistic that most rows of a group share would reject
every other row. Estimates use the rows that pass the base rule. Groups of fewer than ``LEAST`` such rows are
pooled by language, and if still small over all; if that is small too, rows are judged by the base alone.

Null texts have no words; null languages and sources are values of their own. Repeated rows count as often as they
occur; rows at one distance are all within a cut or all beyond it. A text of any length is one row, its statistics are
of the whole text. An empty table has no rows. Only doc_id, text, lang and source are looked at, other columns may have
any name. Only built-in functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch, table
from .fingerprints import let

LEAST = 100
STEPS = 12
SHARE = 0.75
BEYOND = 0.999
NAMES = ("x0", "x1", "x2", "x3", "x4")
# Standard deviations that no estimate goes below, by statistic.
FLOORS = (0.05, 0.4, 0.12, 0.12, 0.4)
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOLS = "#*$%&|<>"
_BINS_A_DOUBLING = 700


def chi_square_5(x: float) -> float:
    """Distribution function with 5 degrees of freedom."""
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)


def chi_square_7(x: float) -> float:
    return chi_square_5(x) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * x * x / 15


def quantile(cdf, p: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """What the covariance of the nearest share of normal rows is multiplied by to be that of all."""
    return share / chi_square_7(quantile(chi_square_5, share))


INNER = quantile(chi_square_5, 0.975)
CUT = quantile(chi_square_5, BEYOND)


def repeated_words(words: Column) -> Column:
    """How many words stand in runs of three words that occur twice or more."""

    def places(runs: Column) -> Column:
        def twin(i: Column) -> Column:
            own, no = runs[i]["h"], F.lit(False)
            return F.coalesce(F.get(runs, i - 1)["h"] == own, no) | F.coalesce(F.get(runs, i + 1)["h"] == own, no)

        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(runs) - 1), twin), lambda i: runs[i]["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, s: total + s)

    def of(w: Column) -> Column:
        hashed = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )
        return F.when(F.size(w) < 3, F.lit(0).cast("bigint")).otherwise(let(F.sort_array(hashed), lambda r: let(places(r), covered)))

    return let(words, of)


def base_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(_WORD))
    found = docs.select(*keep, text.alias("__text"), words.alias("__words"), lines.alias("__lines"))
    squeezed = F.length(F.regexp_replace("__text", _SPACE, ""))
    symbols = F.length("__text") - F.length(F.translate("__text", _SYMBOLS, ""))
    return found.select(
        *keep,
        F.size("__words").cast("bigint").alias("n_words"),
        squeezed.cast("bigint").alias("word_chars"),
        symbols.cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.size("__lines").cast("bigint").alias("n_lines"),
    )


def base_failed(least_words: int = 50, most_repeated: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rows = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(100 * F.col("n_symbols") / n),
        F.asin(F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))),
        F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_repeat_words") / n))),
        F.log(n),
    ]
    return [F.round(x, 6).alias(name) for x, name in zip(rows, NAMES)]


_PAIRS = [(i, j) for i in range(5) for j in range(i + 1)]


def estimate(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Mean (m0 ...) and covariance (c00, c10, c11 ...) by group. Results are rounded, so
    that the order in which partial sums arrive does not show."""
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.sum(x).alias(f"s{i}") for i, x in enumerate(NAMES)],
        *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q{i}{j}") for i, j in _PAIRS],
    )
    mean = {i: F.col(f"s{i}") / F.col("n") for i in range(5)}
    return sums.select(
        *keys,
        "n",
        *[F.round(mean[i], 9).alias(f"m{i}") for i in range(5)],
        *[F.round(F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j], 9).alias(f"c{i}{j}") for i, j in _PAIRS],
    )


def factored(estimates: DataFrame, inflate: float) -> DataFrame:
    """Adds the Cholesky factor (l00, l10, l11 ...) of the inflated covariance with floored variances, and its log
    determinant."""
    out = estimates
    for i in range(5):
        for j in range(i + 1):
            c = F.col(f"c{i}{j}") * inflate
            c = F.greatest(c, F.lit(FLOORS[i] ** 2)) if i == j else c
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # floors make every pivot positive but for rounding
            value = F.sqrt(F.greatest(c, F.lit(FLOORS[i] ** 2 / 100))) if i == j else c / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    return out.withColumn("log_det", sum((F.log(f"l{i}{i}") for i in range(5)), F.lit(0.0)) * 2)


FACTORS = [f"m{i}" for i in range(5)] + [f"l{i}{j}" for i, j in _PAIRS]


def distance(rows: DataFrame) -> DataFrame:
    """rows (with the columns of the factors) with d2, the squared distance: forward substitution."""
    out = rows
    for i in range(5):
        y = F.col(NAMES[i]) - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(5)), F.lit(0.0))
    return out.withColumn("d2", F.round(d2, 6)).drop(*[f"y{i}" for i in range(5)])


def share_within(binned: DataFrame, keys: tuple[str, ...], share: float) -> DataFrame:
    """By group the bin (column bin) up to which at least ``share`` of the rows lie, as cut."""
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    # a row for each bin of a group, whose number does not depend on that of the rows
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    ranked = counts.withColumn("upto", upto).withColumn("total", total)
    return ranked.filter(F.col("upto") >= F.ceil(F.col("total") * share)).groupBy(*keys).agg(F.min("bin").alias("cut"))


def distance_bin() -> Column:
    return F.floor(F.log2(F.col("d2") + 1e-6) * _BINS_A_DOUBLING).cast("bigint")


def median_start(rows: DataFrame) -> DataFrame:
    """Median and median deviation by group, from counts of values rounded to 1/1000."""
    flat = rows.select("part", F.posexplode(F.array(*NAMES)).alias("i", "x")).withColumn("bin", F.round(F.col("x") * 1000).cast("bigint"))
    middle = share_within(flat, ("part", "i"), 0.5)
    off = flat.join(middle, ["part", "i"]).withColumn("bin", F.abs(F.col("bin") - F.col("cut")))
    spread = share_within(off.drop("cut"), ("part", "i"), 0.5).withColumnRenamed("cut", "spread")
    both = middle.join(spread, ["part", "i"]).groupBy("part")
    at = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c) / 1000.0))
    found = both.agg(*[at(i, "cut").alias(f"m{i}") for i in range(5)], *[at(i, "spread").alias(f"d{i}") for i in range(5)])
    cov = [(F.pow(F.col(f"d{i}") * 1.4826, F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    return found.select("part", F.lit(0).alias("start"), F.lit(0).cast("bigint").alias("n"), *[f"m{i}" for i in range(5)], *cov)


def fitted(rows: DataFrame, scratch: Scratch, steps: int = STEPS) -> DataFrame:
    """part and the factors of the reweighted minimum covariance determinant estimate of each part of rows."""
    keys = ("part", "start")
    plain = estimate(rows, ("part",)).withColumn("start", F.lit(1))
    now = median_start(rows).unionByName(plain)
    inflate, before, ended = 1.0, None, None
    for step in range(steps):
        held = scratch.keep(factored(now, inflate).select(*keys, *FACTORS, F.round("log_det", 3).alias("log_det")))
        # one number for each part and start; the first two steps change the inflation
        if step > 1:
            fallen = held.join(before, list(keys)).filter(F.col("log_det") < F.col("log_det_before") - 0.001)
            if fallen.isEmpty():
                ended = held
                break
        before = held.select(*keys, F.col("log_det").alias("log_det_before"))
        now = held.select(*keys, *FACTORS)
        near = distance(rows.join(now, "part")).withColumn("bin", distance_bin()).select(*keys, *NAMES, "bin")
        cuts = share_within(near, keys, SHARE)
        now = estimate(near.join(cuts, list(keys)).filter(F.col("bin") <= F.col("cut")), keys)
        inflate = consistency(SHARE)
    if ended is None:
        ended = factored(now, inflate)
    best = F.struct(F.round("log_det", 6).alias("log_det"), "start", *FACTORS)
    chosen = ended.groupBy("part").agg(F.min(best).alias("b")).select("part", *[F.col(f"b.{c}").alias(c) for c in FACTORS])
    chosen = scratch.keep(chosen)
    inside = distance(rows.join(chosen, "part")).filter(F.col("d2") <= INNER).select("part", *NAMES)
    again = factored(estimate(inside, ("part",)), consistency(0.975))
    return scratch.keep(again.select("part", *FACTORS))


def judged(docs: DataFrame, least: int = LEAST, cut: float = CUT) -> DataFrame:
    """docs' doc_id, lang and source with the base statistics, base_failed, distance (null without an estimate) and
    kept."""
    scratch = Scratch(docs.sparkSession, "mcd")
    found = base_statistics(docs, ("doc_id", "lang", "source")).withColumn("base_failed", base_failed())
    rows = scratch.keep(found.select("*", *vector()))
    fit_rows = rows.filter(~F.col("base_failed"))
    own = fit_rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    # groups, not rows, are pooled: one row for each language and source
    small = own.filter(F.col("n") < least).groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("of_lang"))
    level = F.when(F.col("n") >= least, 0).when(F.col("of_lang") >= least, 1).otherwise(2)
    sized = own.join(small, F.col("lang").eqNullSafe(F.col("of")), "left")
    none = F.lit("\x00none")
    name = F.when(F.col("level") == 0, F.concat_ws("\x00/", F.lit("own"), F.coalesce("lang", none), F.coalesce("source", none)))
    name = name.when(F.col("level") == 1, F.concat_ws("\x00/", F.lit("lang"), F.coalesce("lang", none))).otherwise("all")
    groups = sized.withColumn("level", level).withColumn("part", name).select(F.col("lang").alias("l"), F.col("source").alias("s"), "part")
    placed = fit_rows.join(groups, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s")
    placed = scratch.keep(placed)
    enough = placed.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("part")
    factors = fitted(placed.join(enough, "part").select("part", *NAMES), scratch)
    measured = distance(placed.join(factors, "part", "left")).drop("part", *FACTORS)
    failed = rows.filter("base_failed").withColumn("d2", F.lit(None).cast("double"))
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= cut))
    return measured.unionByName(failed).withColumn("kept", kept)


def op4_robust_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("d2").alias("distance")
    )
