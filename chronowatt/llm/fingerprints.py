"""Document fingerprints: every shingle hash below a fixed share of the hash range is kept.

The hashes of a text's runs of five words (lower case, between ASCII white space; a shorter text is one
run) below ``FRACTION`` of the range form its fingerprint, in ascending order. Which hashes are kept does not
depend on the text's length, so fingerprints merge by union, and the share of one fingerprint found in
another estimates containment whatever the lengths. A text with words none of whose hashes is kept shows its
smallest hash instead, so that short texts can be told apart; it lies beyond the threshold, by which ``merged`` and
``containment`` know it and leave it out: the containment of such a text is unknown, NULL. Texts without a word, null
texts included, have an empty fingerprint.

Likeness is the Jaccard similarity of two fingerprints; two empty ones have likeness 1, one empty
one 0. A text of any length is one row. Repeated rows stand next to each other in the order of ids, an empty table gives
none. Columns of the table other than doc_id and text are not looked at. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table

SHINGLE = 5
FRACTION = 1 / 8
_SPACE = r"[\x20\x09-\x0D]+"
_RANGES = 4_096
_ROWS = 2_048


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def threshold(fraction: float = FRACTION) -> Column:
    """The first hash that is not kept."""
    return F.lit(min(-(1 << 63) + int(fraction * (1 << 64)), (1 << 63) - 1))


def fingerprint(text: Column, fraction: float = FRACTION, size: int = SHINGLE) -> Column:
    """Ascending array of the kept hashes."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != "")
    least = threshold(fraction)

    def hashes(w: Column) -> Column:
        runs = F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))
        return F.transform(runs, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: x < least)
        return F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).otherwise(F.array(F.array_min(h)))

    empty = F.array().cast("array<bigint>")
    return let(words, lambda w: F.when(F.size(w) == 0, empty).otherwise(let(hashes(w), kept)))


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of a's shingles that b has; 1 for a text without words, NULL where no hash of a is kept."""
    low = F.filter(a, lambda h: h < threshold(fraction))
    share = F.size(F.array_intersect(low, b)).cast("double") / F.greatest(F.size(low), F.lit(1))
    return F.when(F.size(a) == 0, 1.0).when(F.size(low) > 0, share)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Fingerprint of two texts together, without hashes that stand in for kept ones."""
    return F.sort_array(F.filter(F.array_union(a, b), lambda h: h < threshold(fraction)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.hex(h))), " ")


def in_ranges(docs: DataFrame) -> DataFrame:
    """docs with range and part: contiguous pieces of the order of doc_id, of about _ROWS rows each, however the
    ids are spread. 4,096 equal ranges of ids are counted, and each is cut according to its count. Rows
    without an id come last in descending order, and are cut by the hash of their text."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    lo, hi = lo or 0, hi or 0
    width = -(-(hi - lo + 1) // _RANGES)
    offset = (F.col("doc_id").cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")).cast("bigint") if hi - lo < (1 << 63) else None
    if offset is None:  # ids over more than half of the 64-bit range
        offset = F.shiftright("doc_id", 1) - (lo >> 1)
        width = -(-((hi >> 1) - (lo >> 1) + 1) // _RANGES)
    number = F.floor(offset / F.lit(width).cast("decimal(20,0)")).cast("bigint")
    counts = docs.filter("doc_id is not null").groupBy(number.alias("range")).agg(F.count("*").alias("n")).collect()
    cut = {r["range"]: max(1, width * _ROWS // r["n"]) for r in counts}
    # one number for each of at most 4,096 ranges
    widths = F.array(*[F.lit(cut.get(i, width)).cast("bigint") for i in range(max(cut, default=0) + 1)])
    ranged = docs.withColumn("range", F.coalesce(number, F.lit(-1))).withColumn("offset", offset)
    part = F.floor((F.col("offset") - F.col("range") * width) / F.get(widths, F.col("range").cast("int")).cast("decimal(20,0)"))
    by_hash = F.shiftright("th", 44)
    return ranged.withColumn("part", F.when(F.col("doc_id").isNull(), by_hash).otherwise(part.cast("bigint"))).drop("offset")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with fp, next_text and next_fp: fingerprint, and those of the next row in descending order of doc_id, ties by
    text hash; after the last row comes the first. The text moves once: each piece of the order is one window
    partition, to which the first row of the next piece is added."""
    keyed = in_ranges(docs.withColumn("th", F.xxhash64("text")))
    order = [F.desc_nulls_last("doc_id"), F.desc_nulls_last("th")]
    top = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("th"))
    pieces = keyed.groupBy("range", "part").agg(F.max(F.struct(top.alias("order"), "doc_id")).alias("top"))
    pieces = pieces.select("range", "part", F.col("top.doc_id").alias("doc_id"), F.col("top.order.th").alias("th"))
    # the piece after each: within its range, else the first of the next range, of which there are at most 4,097
    head = F.struct("doc_id", "th")
    near = F.lead(head).over(Window.partitionBy("range").orderBy(F.desc("part")))
    near = pieces.withColumn("next", near)
    heads = pieces.groupBy("range").agg(F.max(F.struct("part", "doc_id", "th")).alias("head"))
    along = Window.orderBy(F.desc("range"))
    around = heads.select(
        "range",
        F.coalesce(F.lead("head").over(along), F.first("head").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("far"),
    )
    wanted = near.join(around, "range").select(
        "range",
        "part",
        F.coalesce(F.col("next"), F.struct(F.col("far.doc_id").alias("doc_id"), F.col("far.th").alias("th"))).alias("next"),
    )
    wanted = wanted.select("range", "part", F.col("next.doc_id").alias("id"), F.col("next.th").alias("at"))
    source = docs.withColumn("th", F.xxhash64("text"))
    guests = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("at")))
    guests = guests.dropDuplicates(["range", "part"]).select("doc_id", "text", "th", "range", "part", F.lit(True).alias("guest"))
    both = keyed.select("doc_id", "text", "th", "range", "part", F.lit(False).alias("guest")).unionByName(guests)
    w = Window.partitionBy("range", "part").orderBy("guest", *order)
    # fingerprints are made after the shuffle, which moves the texts alone
    led = both.withColumn("next_text", F.lead("text").over(w)).withColumn("fp", fingerprint(F.col("text")))
    led = led.withColumn("next_fp", F.lead("fp").over(w))
    return led.filter(~F.col("guest")).select("doc_id", "text", "fp", "next_text", "next_fp")


def op5_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """The fingerprint of each document and of its edited text, and their likeness; near_next is that to the next
    document's fingerprint."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    found = led.withColumn("edited", edited).withColumn("efp", fingerprint(F.col("edited")))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        containment(F.col("fp"), F.col("efp")).alias("contained_in_edited"),
    )
