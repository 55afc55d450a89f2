"""Benchmark decontamination: a distributed positional inverted index and exact phrase and proximity search in it.

``build`` cuts the documents into segments of about SEGMENT_BYTES of text, each of whole documents, and stores for
each segment the posting list of every term: its places, counted through the segment with one place left free
after each document. One more row of a segment lists its documents. Neither a term nor a document is ever
gathered over segments, so a term that is in all documents has as many lists as there are segments.

``search`` cuts the test items into windows of consecutive words. The total counts of their terms come from the
index; a window's terms are then taken from the rarest on. The lists of the tests' terms meet by segment, and there
a window starts as the rarest term's list, moved back by the term's offset, and is intersected with the moved
list of the next rarest until nothing is left. What stays are exact phrases. With ``within``, stretches
of at most so many words that hold all words of a window, in any order, are found around the places of its rarest
term; a phrase is not reported again as such.

The tests are a stated query set: their windows are handed out in blocks of about BLOCK_WORDS words (parts of long
items overlap), and each block is sought in the whole index. Terms are compared by a 64-bit hash; a wrong hit
would need all other words of a window equal and one pair of different words with one hash.

Words are runs of ``0-9``, ``a-z`` and everything beyond ASCII, after lower-casing A-Z. Null, empty and wordless texts
have no words, hit nothing and are returned; items without words are not sought; an item shorter than the window
is one window. Items with one id are one item, ids are compared as text, a null id is the empty text. Repeated
documents each have their row, an empty table gives none, without items nothing is hit. A document of any length
is one segment at least, so a task needs memory in proportion to its longest document. Other columns of the
tables are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, mix, powers, share, ship_code, table

WINDOW = 10
SEGMENT_BYTES = 4 << 20
BLOCK_WORDS = 1 << 20
_PART_WORDS = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDLY = np.zeros(256, bool)
_WORDLY[48:58] = _WORDLY[97:123] = _WORDLY[128:] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins (and the last ends), and the bytes. Nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return cuts, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def hashed_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts that lie between the cuts, and the number of words of each text."""
    data = _LOWER[data[cuts[0] : cuts[-1]]]
    cuts = cuts - cuts[0]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(cuts) - 1, np.int64)
    wordly = _WORDLY[data]
    first, last = wordly.copy(), wordly.copy()
    first[1:] &= ~wordly[:-1]
    last[:-1] &= ~wordly[1:]
    # a word ends with its text
    edges = cuts[(cuts > 0) & (cuts < len(data))]
    first[edges] |= wordly[edges]
    last[edges - 1] |= wordly[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * down[starts]).view(np.int64)
    return hashes, np.diff(np.searchsorted(starts, cuts))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<i4").astype(np.int64))


INDEX = "segment bigint, term bigint, n bigint, places binary, ids array<bigint>"
_INDEX_TYPE = pa.schema(
    [("segment", pa.int64()), ("term", pa.int64()), ("n", pa.int64()), ("places", pa.binary()), ("ids", pa.list_(pa.int64()))]
)


def segment_rows(segment: int, ids: pa.Array, hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each term, sorted, and one without term that has the documents and their numbers of words."""
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) + doc
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    begins = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    places = place[order]
    deltas = np.diff(places, prepend=0)
    deltas[begins] = places[begins]
    n = np.diff(np.concatenate((begins, [len(hashes)])))
    cuts = np.concatenate((begins, [len(hashes), len(hashes) + len(counts)])) * 4
    data = np.concatenate((deltas, counts)).astype("<i4")
    rows = len(begins) + 1
    lists = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(cuts.astype("<i4")), pa.py_buffer(data)])
    term = pa.array(np.concatenate((sorted_[begins], [0])), pa.int64(), mask=np.arange(rows) == rows - 1)
    docs = pa.ListArray.from_arrays(
        pa.array(np.zeros(rows + 1, np.int32) + np.where(np.arange(rows + 1) == rows, len(ids), 0), pa.int32()), ids
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(rows, segment)), term, pa.array(np.concatenate((n, [len(counts)]))), lists, docs], schema=_INDEX_TYPE
    )


def build(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of all texts: segment, term, n (places), places (packed); a row without term has the documents of
    its segment: n, their numbers of words in places, ids. One pass over the texts, without a shuffle."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for b in batches:
            cuts, data = text_bytes(b.column("text"))
            ids, at = b.column("doc_id"), 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + segment_bytes, "right")) - 1)
                yield segment_rows(segment, ids.slice(at, end - at), *hashed_words(data, cuts[at : end + 1]))
                segment, at = segment + 1, end

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, INDEX)


class Windows:
    """Windows of the test items: different word sequences, each with the items that have it.

    terms: the different terms (hashes); of: the terms' numbers, one row for a window, -1 after a short one."""

    def __init__(self, parts: list[tuple[str, np.ndarray]], size: int):
        self.size = size
        self.items = sorted({item for item, _ in parts})
        number = {item: i for i, item in enumerate(self.items)}
        rows, owner = [np.zeros((0, size), np.int64)], [np.zeros(0, np.int64)]
        self.terms, flat = np.unique(np.concatenate([np.zeros(0, np.int64), *[w for _, w in parts]]), return_inverse=True)
        at = 0
        for item, words in parts:
            mine = flat[at : at + len(words)]
            at += len(words)
            if len(mine) >= size:
                cut = np.lib.stride_tricks.sliding_window_view(mine, size)
            else:
                cut = np.concatenate((mine, np.full(size - len(mine), -1)))[None]
            rows.append(cut)
            owner.append(np.full(len(cut), number[item]))
        self.of, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.of >= 0).sum(axis=1)
        pairs = np.unique(np.stack((which.ravel(), np.concatenate(owner)), axis=1), axis=0)
        self.owners = [o.tolist() for o in np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, len(self.of))))]

    def order(self, counts: np.ndarray) -> None:
        """counts: how often each term is in the documents. Offsets of each window, from the rarest term on."""
        weight = np.where(self.of >= 0, np.append(counts, 0)[self.of], np.iinfo(np.int64).max)
        self.by_rarity = np.argsort(weight, axis=1, kind="stable")


def among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, values)
    return sorted_[np.minimum(at, len(sorted_) - 1)] == values


def phrase(lists: dict[int, np.ndarray], terms: list[int], offsets: list[int]) -> np.ndarray:
    """Places where the terms stand at consecutive places; offsets: from the rarest term on."""
    starts = lists[terms[offsets[0]]] - offsets[0]
    for o in offsets[1:]:
        if not len(starts):
            break
        starts = starts[among(starts + o, lists[terms[o]])]
    return starts


def near(lists: dict[int, np.ndarray], terms: list[int], rarest: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the least stretches of at most ``within`` places that hold all the terms, as often as
    they are listed, in any order. Sought around the places of the rarest term."""
    anchors, often = lists[rarest], {t: terms.count(t) for t in terms}
    starts = []
    for t in often:
        lo, hi = np.searchsorted(lists[t], anchors - within + 1), np.searchsorted(lists[t], anchors, "right")
        size = hi - lo
        starts.append(lists[t][np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())])
    first = np.unique(np.concatenate(starts))
    last = first.copy()
    for t, m in often.items():
        at = np.searchsorted(lists[t], first) + m - 1
        some = at < len(lists[t])
        first, last, at = first[some], last[some], at[some]
        last = np.maximum(last, lists[t][at])
    close = last - first < within
    first, last = first[close], last[close]
    least = np.append(last[1:] != last[:-1], True) if len(last) else np.zeros(0, bool)
    return first[least], last[least]


def joined(stretches: np.ndarray) -> list[tuple[int, int]]:
    """Union of (first, last), sorted; those that overlap become one."""
    out: list[list[int]] = []
    for first, last in sorted(stretches):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def matches_in(windows: Windows, lists: dict[int, np.ndarray], firsts: np.ndarray, within: int | None) -> dict[int, list[dict]]:
    """Matches by document number of one segment."""
    held = np.zeros(len(windows.terms) + 1, bool)
    held[list(lists)] = True
    held[-1] = True
    found: dict[tuple[int, int, str], list[tuple[int, int]]] = {}

    def add(w: int, kind: str, first: np.ndarray, last: np.ndarray) -> None:
        doc = np.searchsorted(firsts, first, "right") - 1
        same = doc == np.searchsorted(firsts, last, "right") - 1
        for d, a, z in zip(doc[same].tolist(), first[same].tolist(), last[same].tolist()):
            base = int(firsts[d])
            for item in windows.owners[w]:
                found.setdefault((d, item, kind), []).append((a - base, z - base))

    for w in np.flatnonzero(held[windows.of].all(axis=1)).tolist():
        size = int(windows.lengths[w])
        terms = windows.of[w, :size].tolist()
        offsets = windows.by_rarity[w, :size].tolist()
        starts = phrase(lists, terms, offsets)
        if len(starts):
            add(w, "phrase", starts, starts + size - 1)
        if within is not None and size > 1:
            first, last = near(lists, terms, terms[offsets[0]], max(within, size))
            other = ~((last - first == size - 1) & among(first, starts)) if len(starts) else np.ones(len(first), bool)
            if other.any():
                add(w, "proximity", first[other], last[other])
    out: dict[int, list[dict]] = {}
    for (d, item, kind), stretches in sorted(found.items()):
        out.setdefault(d, []).extend(
            {"item": windows.items[item], "kind": kind, "first": a, "last": z} for a, z in joined(stretches)
        )
    return out


_MATCHES = "array<struct<item: string, kind: string, first: bigint, last: bigint>>"


def item_words(tests: DataFrame, item: str, window: int) -> DataFrame:
    """item (text) and words (hashes) of each test with words; long items in parts that share window - 1 words."""
    ship_code(tests.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts, data = text_bytes(b.column("text"))
            hashes, counts = hashed_words(data, cuts)
            names, parts = [], []
            for name, words in zip(b.column("item").to_pylist(), np.split(hashes, np.cumsum(counts)[:-1])):
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), _PART_WORDS):
                    names.append(name)
                    parts.append(words[at : at + _PART_WORDS + window - 1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.list_(pa.int64()))], ["item", "words"])

    name = F.coalesce(F.col(item).cast("string"), F.lit(""))
    return tests.select(name.alias("item"), "text").mapInArrow(run, "item string, words array<bigint>").distinct()


def search(
    index: DataFrame, tests: DataFrame, item: str = "item_id", window: int = WINDOW, within: int | None = None, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """segment, place (number in the segment), doc_id, n_words and matches (item, kind, first and last word number) of
    every document of the index. kind is ``phrase`` or, with ``within``, also ``proximity``."""
    spark = index.sparkSession
    parts = item_words(tests, item, window)
    total = parts.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = -(-total // block_words) or 1
    found = None
    for block in range(blocks):
        mine = parts if blocks == 1 else parts.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block)
        # about block_words words
        windows = Windows([(r["item"], np.array(r["words"], np.int64)) for r in mine.collect()], window)
        one = _search_block(spark, index, windows, within)
        found = one if found is None else found.unionByName(one)
    if blocks == 1:
        return found
    all_ = F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches")
    return found.groupBy("segment", "place", "doc_id", "n_words").agg(all_)


def _search_block(spark: SparkSession, index: DataFrame, windows: Windows, within: int | None) -> DataFrame:
    terms = spark.createDataFrame(
        pd.DataFrame({"term": windows.terms, "number": np.arange(len(windows.terms))}), "term bigint, number bigint"
    )
    # at most block_words terms of 16 bytes
    terms = F.broadcast(terms)
    counted = index.select("term", "n").join(terms, "term").groupBy("number").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(windows.terms), np.int64)
    counts[counted["number"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    windows.order(counts)
    shared = share(spark, windows)

    def run(rows: pa.Table) -> pa.Table:
        lists, directory = {}, None
        for number, places, ids in zip(rows["number"].to_pylist(), rows["places"], rows["ids"]):
            if number is None:
                directory = np.frombuffer(places.as_py(), "<i4").astype(np.int64), ids.values
            else:
                lists[number] = unpacked(places.as_py())
        counts, ids = directory
        firsts = np.cumsum(counts + 1) - counts - 1
        hits = matches_in(shared.value, lists, firsts, within)
        return pa.table(
            {
                "segment": pa.array(np.full(len(counts), rows["segment"][0].as_py())),
                "place": pa.array(np.arange(len(counts))),
                "doc_id": ids.cast(pa.int64()),
                "n_words": pa.array(counts),
                "matches": pa.array([hits.get(d, []) for d in range(len(counts))], _MATCH_TYPE),
            }
        )

    wanted = index.join(terms, "term", "left").filter(F.col("term").isNull() | F.col("number").isNotNull())
    wanted = wanted.select("segment", "number", "places", "ids")
    return wanted.groupBy("segment").applyInArrow(run, f"segment bigint, place bigint, doc_id bigint, n_words bigint, matches {_MATCHES}")


_MATCH_TYPE = pa.list_(pa.struct([("item", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))


def covered(stretches: Column) -> Column:
    """Number of words inside any of the stretches (first, last)."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("upto"))

    def step(a: Column, s: Column) -> Column:
        new = F.greatest(F.lit(0), s["last"] - F.greatest(a["upto"], s["first"] - 1))
        return F.struct((a["n"] + new).alias("n"), F.greatest(a["upto"], s["last"]).alias("upto"))

    in_order = F.array_sort(F.transform(stretches, lambda m: F.struct(m["first"].alias("first"), m["last"].alias("last"))))
    return F.aggregate(in_order, start, step)["n"]


def op13_phrase_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    scratch = Scratch(spark, "phrases")
    index = scratch.keep(build(table(spark, sf, "documents")))
    found = search(index, table(spark, sf, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    hit = covered(F.col("matches"))
    result = scratch.keep(
        found.select(
            "doc_id",
            "n_words",
            hit.alias("n_hit"),
            F.size(items).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
            (hit > 0).alias("contaminated"),
        )
    )
    scratch.drop(index)
    return result


# SQL of the words of a text
_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS size,
    array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT row, i, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT DISTINCT dw.row, dw.i, dw.size, bw.item FROM dw JOIN bw USING (size, phrase)),
words AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS p FROM hits) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)
"""
