"""Repeated runs of lines: suffix ranks by distributed prefix doubling; later copies are deleted.

Lines with a word (``[^ \\t\\n\\v\\f\\r]+``) are the symbols of a document's sequence; lines without one are no symbols, break
nothing and stay. Prefix doubling ranks the suffixes of all sequences by their first 1, 2, 4, ... lines:
the rank at 2k follows from the pair of ranks at k, here and k lines further on. Suffixes whose rank nobody
shares have no repeated prefix of that length and leave, so each round works on what still repeats.

A repeated run counts from ``MIN_WORDS`` words on. At each suffix that length is reached after a known
number of lines, and two overlapping powers of two rank exactly that many, so the groups of suffixes with
one rank are the intervals of the suffix array whose longest common prefix has MIN_WORDS words or more. The
first suffix of an interval, by (doc_id, text hash, line), is the original; the lines that the others cover
are deleted. Covered stretches that overlap or touch make one maximal run, which is reported.

Only built-in functions, and no group is gathered: ranks of keys come from counts by key range, members
find their rank by a join, and windows run within one document. Null texts have no lines. Rows that repeat an
id with the same text are one document and lose the same lines; equal texts under two ids are copies of each
other. Null ids come first. A text that has lost all its symbols is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch, table

MIN_WORDS = 50
_RANGES = 4_096
WORD = r"[^\x20\x09-\x0D]+"


_DOC = ("known", "id", "th")


def identity() -> dict[str, Column]:
    """Columns that tell documents apart: whether the id is known (null ids come first), the id, the text's hash."""
    return {"known": F.col("doc_id").isNotNull(), "id": F.coalesce("doc_id", F.lit(0)), "th": F.xxhash64("text")}


def lines_of(docs: DataFrame) -> DataFrame:
    """known, id, th, line (number from 0), words, h1 and h2 (128 bits of hash) of each line with a word."""
    split = docs.filter(F.col("text").isNotNull()).select(
        *[c.alias(n) for n, c in identity().items()], F.posexplode(F.split("text", "\n")).alias("line", "s")
    )
    # rows that repeat are one document
    return (
        split.withColumn("words", F.regexp_count("s", F.lit(WORD)))
        .filter("words > 0")
        .select(*_DOC, "line", "words", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s", F.length("s")).alias("h2"))
        .distinct()
    )


def ranked(members: DataFrame, first: str, second: str, spread: Column) -> DataFrame:
    """first, second and rank (from 0) of the keys that more than one member has, in the order of the keys.
    ``spread`` cuts the keys into ranges, in their order, so that a rank is the count of the ranges before plus the
    place within one; no range depends on how many members share a key."""
    keys = members.groupBy(first, second).agg(F.count("*").alias("n")).filter("n > 1").select(first, second, spread.alias("range"))
    ranges = keys.groupBy("range").agg(F.count("*").alias("size"))
    # one row for each of at most _RANGES ranges
    before = ranges.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(first, second)) - 1
    return keys.withColumn("place", place).join(before, "range").select(first, second, (F.col("before") + F.col("place")).alias("rank"))


def suffixes(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """known, id, th, line, at (number among the symbols), last (line that completes min_words), span (symbols until
    then), enough and r, the rank of the line itself, of each symbol that repeats."""
    lines = lines_of(docs)
    spread = (F.shiftrightunsigned("h1", 52) + F.lit(2048)) % _RANGES
    ranks = ranked(lines, "h1", "h2", spread)
    own = Window.partitionBy(*_DOC)
    before = F.sum("words").over(own.orderBy("line")) - F.col("words")
    found = lines.join(ranks, ["h1", "h2"], "left").withColumn("before", before)
    found = found.withColumn("at", F.row_number().over(own.orderBy("line")))
    # the symbols that begin before min_words words from here are complete
    reach = own.orderBy("before").rangeBetween(0, min_words - 1)
    return scratch.keep(
        found.withColumn("span", F.count("*").over(reach))
        .withColumn("last", F.max("line").over(reach))
        .withColumn("enough", F.sum("words").over(reach) >= min_words)
        .filter(F.col("rank").isNotNull())
        .select(*_DOC, "line", "at", "last", "span", "enough", F.col("rank").alias("r"))
    )


def doubled(level: DataFrame, step: int, scratch: Scratch) -> DataFrame:
    """Ranks by twice as many symbols: known, id, th, at, r. ``level`` has the ranks by ``step`` symbols."""
    further = level.select(*_DOC, (F.col("at") - step).alias("at"), F.col("r").alias("s"))
    pairs = level.join(further, [*_DOC, "at"])
    # ranks are dense, so equal ranges of them are even
    top = level.agg(F.coalesce(F.max("r"), F.lit(0))).first()[0] + 1
    ranks = ranked(pairs, "r", "s", F.floor(F.col("r").cast("double") * _RANGES / float(top)).cast("bigint"))
    return scratch.keep(pairs.join(ranks, ["r", "s"]).select(*_DOC, "at", F.col("rank").alias("r")))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """known, id, th, first and last (lines): the maximal stretches of lines that repeat an earlier run."""
    scratch = Scratch(docs.sparkSession, "runs")
    base = suffixes(docs, min_words, scratch)
    starts = base.filter("enough").select(*_DOC, "line", "at", "last", "span")
    longest = starts.agg(F.max("span")).first()[0] or 0
    level, step, groups = base.select(*_DOC, "at", "r"), 1, []
    while True:
        # suffixes whose run has step .. 2 * step - 1 symbols: two windows of step symbols cover it
        here = starts.filter((F.col("span") >= step) & (F.col("span") < 2 * step))
        tail = (F.col("at") + F.col("span") - step).alias("at")
        ends = level.withColumnRenamed("r", "s")
        begun = here.join(level, [*_DOC, "at"]).select(*_DOC, "line", "last", "span", "r", tail)
        groups.append(scratch.keep(begun.join(ends, [*_DOC, "at"]).drop("at")))
        step *= 2
        if step > longest:
            break
        level = doubled(level, step // 2, scratch)
    members = groups[0]
    for more in groups[1:]:
        members = members.unionByName(more)
    place = F.struct(*_DOC, "line")
    intervals = members.groupBy("span", "r", "s").agg(F.min(place).alias("original"), F.count("*").alias("n")).filter("n > 1")
    copies = members.join(intervals, ["span", "r", "s"]).filter(place != F.col("original")).select(*_DOC, "line", "last")
    own = Window.partitionBy(*_DOC).orderBy("line")
    reached = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reached.isNull() | (F.col("line") > reached + 1), 1).otherwise(0)
    runs = copies.withColumn("begins", begins).withColumn("run", F.sum("begins").over(own))
    return runs.groupBy(*_DOC, "run").agg(F.min("line").alias("first"), F.max("last").alias("last")).drop("run")


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, with text shortened by its later copies of repeated runs; deleted_lines counts the symbols lost, and runs
    lists the maximal runs (first and last line). Lines without a word stay, unless no line with a word is left.
    Columns of docs with one of these two names give way."""
    names = [c for c in docs.columns if c not in ("deleted_lines", "runs")]
    runs = repeated_runs(docs.select("doc_id", "text"), min_words)
    by_doc = runs.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    by_doc = by_doc.select(*[F.col(c).alias(f"__{c}") for c in _DOC], "runs")
    keyed = docs.select(*[F.col(f"`{c}`") for c in names]).withColumns({f"__{n}": c for n, c in identity().items()})
    joined = keyed.join(by_doc, [f"__{c}" for c in _DOC], "left")
    parts = F.split("text", "\n")

    def stays(line: Column, number: Column) -> Column:
        return ~F.exists("runs", lambda r: (r["first"] <= number) & (number <= r["last"])) | ~line.rlike(WORD)

    left = joined.withColumn("__left", F.when(F.col("runs").isNotNull(), F.filter(parts, stays)))
    worded = lambda a: F.size(F.filter(a, lambda s: s.rlike(WORD)))
    gone = F.when(F.col("runs").isNull(), 0).otherwise(worded(parts) - worded(F.col("__left"))).cast("bigint")
    short = F.array_join("__left", "\n")
    text = F.when(F.col("runs").isNull(), F.col("text")).when(short.rlike(WORD), short).otherwise("")
    return left.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names], gone.alias("deleted_lines"), "runs")


def op6_line_runs(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, deleted_lines, kept_sha256 (of the shortened text) for every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return without_copies(docs).select(
        "doc_id",
        "deleted_lines",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP6_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM d),
sym AS (SELECT doc_id, text, s, line, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS words FROM raw),
num AS (SELECT doc_id, text, s, line, words, row_number() OVER (PARTITION BY doc_id, text ORDER BY line) AS at,
  sum(words) OVER (PARTITION BY doc_id, text ORDER BY line) AS upto FROM sym WHERE words > 0),
st AS (SELECT a.doc_id, a.text, a.line, a.at, min(b.at) AS last_at, min(b.line) AS last
  FROM num a JOIN num b ON a.doc_id = b.doc_id AND a.text = b.text AND b.at >= a.at AND b.at < a.at + {MIN_WORDS}
  AND b.upto >= a.upto - a.words + {MIN_WORDS} GROUP BY ALL),
win AS (SELECT st.doc_id, st.text, st.line, st.last, string_agg(n.s, chr(10) ORDER BY n.line) AS body
  FROM st JOIN num n ON st.doc_id = n.doc_id AND st.text = n.text AND n.at BETWEEN st.at AND st.last_at GROUP BY ALL),
cop AS (SELECT doc_id, text, line, last FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, line) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT n.doc_id, n.text, n.line FROM num n JOIN cop c ON n.doc_id = c.doc_id AND n.text = c.text AND n.line BETWEEN c.line AND c.last),
keep AS (SELECT r.doc_id, r.text, string_agg(r.s, chr(10) ORDER BY r.line) AS body FROM raw r
  LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.text = g.text AND r.line = g.line WHERE g.line IS NULL GROUP BY ALL),
cnt AS (SELECT doc_id, text, count(*) AS n FROM gone GROUP BY ALL)
SELECT o.doc_id, coalesce(cnt.n, 0) AS deleted_lines,
  sha256(CASE WHEN cnt.n IS NULL THEN coalesce(o.text, '') WHEN regexp_matches(coalesce(keep.body, ''), '[^\x20\x09-\x0D]') THEN keep.body ELSE '' END) AS kept_sha256
FROM documents o LEFT JOIN keep ON o.doc_id = keep.doc_id AND o.text = keep.text
LEFT JOIN cnt ON o.doc_id = cnt.doc_id AND o.text = cnt.text
"""
