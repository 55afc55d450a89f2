"""Near duplicates by consistent weighted sampling over TF-IDF shingles, banded and verified.

A text's shingles are its runs of five words (lower case, cut at white space; a shorter text is one
shingle), each weighted by tf * idf. Document frequencies are counted over all documents: ``2**SLOTS`` counters by
shingle hash sift out what can be in more than ``FLOOR`` of the documents, whose frequencies are then counted
exactly. There are at most 1 / FLOOR times as many of them as shingles in a mean document, so their table may be
broadcast. All rarer shingles count as if ``FLOOR`` of the documents had them: that and the added 1 keep the weight of
what a large group of near copies shares from vanishing beside that of its edits.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples from a text: two texts draw the same
sample with a probability equal to their weighted Jaccard similarity. ``ROWS`` samples make a band; texts
that agree in a band share a bucket. At a similarity of 0.8 the bands miss a pair with probability
(1 - 0.8**2)**8 < 0.0003, and a pair that shares a group is missed only if all its paths are.

Nobody is compared with everybody. A bucket's members are compared with one of them, its leader, in
full. Members at least as similar as the threshold are linked to it. 1 - J is a metric, so a linked member
whose distance to the leader differs by more than 1 - threshold from that of each member that is not
linked can't be linked to any of them, and leaves. Those who are left meet again by their rarest shingles, of
which two linked texts always share one (prefix filter). How rare a shingle is, is counted exactly among those who are
left; what only one of them has brings nobody together. The texts that share a rare shingle, and are not all connected
yet, form the buckets of the next round. First each text is compared in one of its buckets; then what is still apart: large
buckets have a leader again, and each is compared in blocks of a bounded number of texts, one matrix product a block. No link is lost by this. A group of copies of any size costs
its leaders' comparisons, which are linear; only texts that share a rare shingle, and that neither leader could settle,
are compared in blocks with each other. Connected components of the links are the classes.

Equal texts are one text from the start; null counts as empty, and all empty texts are equal. The class of
a document is the smallest id in its component; rows without an id have the class of their component, or
null if no member has an id. Repeated rows have the same class. A text of any length is one row of shingle hashes, four
bytes a word. An empty table has no rows. Only doc_id and text are looked at; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import SparkSession

from .common import Scratch, Words, mix, share, ship_code, spaced, table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 8, 2
SLOTS = 18
FLOOR = 0.01
SMALL = 256
MARKS = 24
_GRID = 1 << 16
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_PART = 8_192


def shingles(text: str | None) -> np.ndarray:
    """Sorted 32-bit shingle hashes, as often as they occur."""
    return np.sort((Words(spaced(text)).runs(SHINGLE) >> np.uint64(32)).astype(np.uint32))


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, whose distribution function is 1 - (1 + x) e**-x."""
    x = np.concatenate(([0.0], np.geomspace(1e-5, 40, 200_000)))
    return np.interp((np.arange(_GRID) + 0.5) / _GRID, 1 - (1 + x) * np.exp(-x), x)


_GAMMA = _gamma_quantiles()
_LOG_GAMMA = np.log(_GAMMA)


class Idf:
    """1 + log(1 + N / df) of a shingle, with the exact df where it is above the floor."""

    def __init__(self, shingle: np.ndarray, df: np.ndarray, n: float, floor: float = FLOOR):
        order = np.argsort(shingle)
        self.shingle, self.least = shingle[order].astype(np.uint32), max(1.0, floor * n)
        self.rest = 1 + float(np.log1p(max(n, 1.0) / self.least))
        self.value = 1 + np.log1p(max(n, 1.0) / np.maximum(df[order], self.least))

    def __call__(self, distinct: np.ndarray) -> np.ndarray:
        out = np.full(len(distinct), self.rest)
        if len(self.shingle):
            at = np.minimum(np.searchsorted(self.shingle, distinct), len(self.shingle) - 1)
            known = self.shingle[at] == distinct
            out[known] = self.value[at[known]]
        return out


def weights(own: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights."""
    distinct, tf = np.unique(own, return_counts=True)
    return distinct, tf * idf(distinct)


def samples(distinct: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One consistent weighted sample per seed, as a hash of the shingle and its level. Three uniform numbers
    a shingle and seed (for r, c and beta) are bits of one hash; the gamma variates are read from quantiles."""
    best = np.full(len(_SEEDS), np.inf)
    found = np.zeros(len(_SEEDS), np.uint64)
    low = np.uint64(_GRID - 1)
    for at in range(0, len(distinct), _PART):
        h = distinct[at : at + _PART].astype(np.uint64)
        log_w = np.log(weight[at : at + _PART])
        z = mix((h * _SPREAD)[None, :] ^ _SEEDS[:, None])
        r = _GAMMA[z & low]
        log_c = _LOG_GAMMA[(z >> np.uint64(16)) & low]
        beta = ((z >> np.uint64(32)) & low).astype(float) / _GRID
        level = np.floor(log_w[None, :] / r + beta)
        log_a = log_c - r * (level - beta) - r
        i = log_a.argmin(axis=1)
        rows = np.arange(len(_SEEDS))
        least = log_a[rows, i]
        new = mix(h[i] * _SPREAD + level[rows, i].astype(np.int64).astype(np.uint64))
        found = np.where(least < best, new, found)
        best = np.minimum(best, least)
    return found


def bands(drawn: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band."""
    groups = drawn.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        out = mix(out * _SPREAD + groups[:, row])
    return out.astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, idf: Idf) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    (x, wx), (y, wy) = weights(a, idf), weights(b, idf)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = float(np.minimum(wx[i], wy[j]).sum())
    either = float(wx.sum() + wy.sum()) - both
    return both / either if either > 0 else 1.0


def prefix(own: np.ndarray, idf: Idf, shared: np.ndarray, count: np.ndarray, threshold: float) -> np.ndarray:
    """Of the rarest shingles that leave less than ``threshold`` of the weight behind them, those that are shared.
    shared, count: the text's shingles that other texts have too, and how many texts have them."""
    distinct, w = weights(own, idf)
    texts = np.ones(len(distinct), np.int64)
    at = np.minimum(np.searchsorted(distinct, shared), len(distinct) - 1)
    known = distinct[at] == shared
    texts[at[known]] = count[known]
    order = np.lexsort((distinct, texts))
    behind = w.sum() - np.cumsum(w[order])
    first = order[: int(np.argmax(behind < threshold * w.sum())) + 1]
    return distinct[first[texts[first] > 1]]


def linked(texts: list[np.ndarray], idf: Idf, threshold: float) -> list[tuple[int, int]]:
    """Links that connect what is similar enough among a bounded number of texts: overlaps of all of them at once
    are a product of the matrix of texts by the shingles that several have."""
    found = [weights(t, idf) for t in texts]
    total = np.array([w.sum() for _, w in found])
    flat = np.concatenate([f[0] for f in found])
    shared, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times > 1)
    column = np.full(len(shared), -1)
    column[several] = np.arange(len(several))
    row = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
    at, value = column[place], np.concatenate([f[1] for f in found])
    row, at, value = row[at >= 0], at[at >= 0], value[at >= 0]
    unit = idf(shared[several])
    overlap = np.zeros((len(texts), len(texts)))
    for lo in range(0, len(several), _PART):
        hi = min(lo + _PART, len(several))
        inside = (at >= lo) & (at < hi)
        w = np.zeros((len(texts), hi - lo))
        w[row[inside], at[inside] - lo] = value[inside]
        one = unit[lo:hi]
        once = (w <= one * (1 + 1e-9)).all(axis=0)
        b = (w[:, once] > 0).astype(float)
        overlap += (b * one[once]) @ b.T
        for c in np.flatnonzero(~once):
            overlap += np.minimum.outer(w[:, c], w[:, c])
    either = total[:, None] + total[None, :] - overlap
    near = overlap >= threshold * either * (1 - 1e-12)
    links, open_ = [], set(range(len(texts)))
    while open_:
        stack = [open_.pop()]
        while stack:
            i = stack.pop()
            for j in [j for j in np.flatnonzero(near[i]).tolist() if j in open_]:
                open_.discard(j)
                links.append((i, j))
                stack.append(j)
    return links


def text_key() -> Column:
    """Identity of a text: 128 bits of its hash."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def counters(docs: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, float]:
    """Documents by slot, and the number of documents with a word, counted over all documents."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << slots, np.int64), 0
        for b in batches:
            for text in b["text"]:
                at = np.unique(shingles(text) & np.uint32((1 << slots) - 1))
                df[at] += 1
                n += len(at) > 0
        used = np.flatnonzero(df)
        yield pd.DataFrame({"slot": np.append(used, -1), "n": np.append(df[used], n)})

    found = docs.select("text").mapInPandas(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << slots)
    at, n = found["slot"].to_numpy(np.int64), found["n"].to_numpy(float)
    df[at[at >= 0]] = n[at >= 0]
    return df, float(n[at < 0].sum())


def frequencies(docs: DataFrame, floor: float = FLOOR, slots: int = SLOTS) -> Idf:
    """The idf behind all weights. A shingle above the floor has a counter above it, so no such shingle is missed."""
    spark = docs.sparkSession
    ship_code(spark)
    df, n = counters(docs, slots)
    least = max(1.0, floor * n)
    if not (df > least).any():
        return Idf(np.zeros(0, np.uint32), np.zeros(0), n, floor)
    shared = share(spark, df > least)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, low = shared.value, np.uint32((1 << slots) - 1)
        for b in batches:
            found = [np.zeros(0, np.uint32)]
            for text in b["text"]:
                distinct = np.unique(shingles(text))
                found.append(distinct[often[distinct & low]])
            shingle, times = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"shingle": shingle.astype(np.int64), "n": times})

    exact = docs.select("text").mapInPandas(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    exact = exact.filter(F.col("n") > least).toPandas()
    return Idf(exact["shingle"].to_numpy(np.int64), exact["n"].to_numpy(float), n, floor)


def marked(texts: DataFrame, wanted: DataFrame, bits: int = MARKS) -> DataFrame:
    """The rows of texts whose key has a mark that a key of wanted has too: all that a join on the key would find, and few
    others. The marks are ``2**bits`` bits in rows of 64, so their table may be broadcast, however many keys there are."""
    mark = F.pmod(F.xxhash64("key"), F.lit(1 << bits))
    row, bit = F.shiftright(mark, 6).alias("__row"), F.pmod(mark, F.lit(64)).cast("int").alias("__bit")
    marks = wanted.select(row, bit).groupBy("__row").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__marks"))
    found = texts.select("*", row, bit).join(F.broadcast(marks), "__row").filter(F.getbit("__marks", "__bit") == 1)
    return found.select(*[F.col(f"`{c}`") for c in texts.columns])


class Classes:
    """The near-duplicate classes of one table of documents (doc_id, text)."""

    def __init__(self, spark: SparkSession, threshold: float = THRESHOLD, small: int = SMALL):
        self.spark, self.threshold, self.small = spark, threshold, small
        self.scratch = Scratch(spark, "near")

    def sketched(self, docs: DataFrame) -> DataFrame:
        """key, own (packed shingles) and bands of each text with a word; a text that a task meets again it
        leaves out."""
        idf = self.idf

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            met: set[bytes] = set()
            for b in batches:
                rows = []
                for key, text in zip(b["key"], b["text"]):
                    if key not in met:
                        met.add(key)
                        own = shingles(text)
                        if len(own):
                            rows.append((key, own.tobytes(), bands(samples(*weights(own, idf.value)))))
                yield pd.DataFrame(rows, columns=["key", "own", "bands"])

        found = docs.select(text_key().alias("key"), "text").mapInPandas(run, "key binary, own binary, bands array<bigint>")
        return self.scratch.keep(found)

    def dealt(self, texts: DataFrame) -> DataFrame:
        """The texts, dealt out by key once for all joins on it; a part that gets lost is made again from the scratch table."""
        conf, name = self.spark.conf, "spark.sql.adaptive.enabled"
        before = conf.get(name)
        # an adaptive plan of a kept frame would not tell how it is dealt out
        conf.set(name, "false")
        try:
            return texts.repartition(int(conf.get("spark.sql.shuffle.partitions")), "key").persist(StorageLevel.DISK_ONLY)
        finally:
            conf.set(name, before)

    def similarities(self, pairs: DataFrame) -> DataFrame:
        """leader, key, sim for pairs of keys."""
        idf = self.idf

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                sims = [
                    similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), idf.value)
                    for x, y in zip(b["own_leader"], b["own"])
                ]
                yield pd.DataFrame({"leader": b["leader"], "key": b["key"], "sim": sims})

        wanted = pairs.select(F.col("leader").alias("key")).distinct()
        leaders = self.texts.join(wanted, "key", "left_semi")
        # dealt out anew, by two columns: two shuffled sides, of which adaptive execution splits a leader that many texts have
        at = F.xxhash64("leader").alias("at")
        leaders = leaders.select(F.col("key").alias("leader"), F.col("own").alias("own_leader")).select("*", at)
        both = pairs.join(self.texts, "key").select("*", at).join(leaders, ["at", "leader"]).select("leader", "key", "own_leader", "own")
        return self.scratch.keep(both.mapInPandas(run, "leader binary, key binary, sim double"))

    def round(self, buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links found with the leaders of the buckets (bucket, key), and the buckets that are left."""
        t = self.threshold
        leaders = buckets.groupBy("bucket").agg(F.min("key").alias("leader"), F.count("*").alias("n")).filter("n > 1")
        members = buckets.join(leaders.drop("n"), "bucket").filter(F.col("key") != F.col("leader"))
        sims = self.similarities(members.select("leader", "key").distinct())
        judged = members.join(sims, ["leader", "key"])
        apart = F.col("sim") < t
        nearest = judged.filter(apart).groupBy("bucket").agg(F.max("sim").alias("nearest"), F.count("*").alias("n_apart"))
        left = (
            judged.join(nearest, "bucket")
            .filter(apart | (F.col("sim") <= F.col("nearest") + (1 - t) + 1e-9))
            .select("bucket", "key")
        )
        several = left.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
        return sims.filter(~apart).select("leader", "key"), self.scratch.keep(left.join(several, "bucket"))

    def settled(self, buckets: DataFrame) -> DataFrame:
        """Links within buckets (bucket, key, n). A bucket of up to ``small`` members is compared in one task. A larger
        one is cut into parts of about that size by the hash of the key, and each two parts are compared in
        one task, so a task holds about twice ``small`` texts whatever the bucket's size."""
        idf, t = self.idf, self.threshold

        def run(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values("key")
            keys = list(b["key"])
            links = linked([np.frombuffer(o, np.uint32) for o in b["own"]], idf.value, t)
            return pd.DataFrame([(keys[i], keys[j]) for i, j in links], columns=["leader", "key"])

        parts = F.ceil(F.col("n") / self.small).cast("bigint")
        own = F.pmod(F.xxhash64("key"), parts)
        cut = buckets.select("bucket", "key", own.alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("other"))
        low, high = F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
        members = cut.select("bucket", "key", low, high).join(self.texts, "key")
        return members.groupBy("bucket", "low", "high").applyInPandas(run, "leader binary, key binary")

    def by_rarest(self, keys: DataFrame) -> DataFrame:
        """bucket, key: the rarest shingles of the texts with these keys that several of them have."""
        idf, t = self.idf, self.threshold

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [np.unique(np.frombuffer(o.as_buffer(), np.uint32)) for o in b.column("own")]
                cuts = np.cumsum([0, *[len(o) for o in own]])
                values = np.concatenate([np.zeros(0, np.uint32), *own]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("k"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))], ["k", "own"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rare = []
                for own, shared in zip(b["own"], b["shared"]):
                    shingle = np.array([r["shingle"] for r in shared], np.uint32)
                    count = np.array([r["texts"] for r in shared], np.int64)
                    rare.append(prefix(np.frombuffer(own, np.uint32), idf.value, shingle, count, t).astype(np.int64).tolist())
                yield pd.DataFrame({"key": b["key"], "rare": rare})

        texts = self.texts.join(keys, "key", "left_semi").withColumn("k", F.xxhash64("key"))
        # rows of two numbers travel; should two texts have one k, each gets the other's shingles too and passes over them
        each = texts.select("k", "own").mapInArrow(flat, "k bigint, own array<bigint>").select("k", F.explode("own").alias("shingle"))
        often = each.groupBy("shingle").agg(F.count("*").alias("texts")).filter("texts > 1")
        # no more rows for a text than it has shingles
        shared = each.join(often, "shingle").groupBy("k").agg(F.collect_list(F.struct("shingle", "texts")).alias("shared"))
        found = texts.join(shared, "k").select("key", "own", "shared").mapInPandas(run, "key binary, rare array<bigint>")
        return found.select(F.explode("rare").alias("bucket"), "key")

    def apart(self, buckets: DataFrame, links: DataFrame) -> DataFrame:
        """bucket, key, root, n of the buckets (bucket, key) that the links do not connect; of several buckets with
        the same members one."""
        rooted = buckets.join(self.components(links), "key", "left").withColumn("root", F.coalesce("root", "key"))
        members = [F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("sum"), F.min("key").alias("low"), F.max("key").alias("high")]
        open_ = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"), *members)
        once = open_.filter("a < b").groupBy("n", "sum", "low", "high").agg(F.min("bucket").alias("bucket"))
        return self.scratch.keep(rooted.join(once.select("bucket", "n"), "bucket"))

    def links(self, docs: DataFrame) -> DataFrame:
        """leader, key: links between different texts that connect each class."""
        self.idf = share(self.spark, frequencies(docs))
        sketched = self.sketched(docs)
        banded = sketched.select("key", F.explode("bands").alias("bucket")).distinct()
        shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
        buckets = self.scratch.keep(banded.join(shared, "bucket"))
        # written, or the optimizer would put the join below the marks
        near = self.scratch.keep(marked(sketched.select("key", "own"), buckets))
        self.scratch.drop(sketched)
        # one row a text: a task wrote each text at most once
        texts = self.scratch.keep(
            near.join(buckets.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("own").alias("own"))
        )
        self.scratch.drop(near)
        self.texts = self.dealt(texts)
        try:
            return self.connected(buckets)
        finally:
            self.texts.unpersist()
            self.scratch.drop(texts)

    def connected(self, buckets: DataFrame) -> DataFrame:
        """leader, key: the links among the texts that share a bucket (bucket, key)."""
        found, left = self.round(buckets)
        if left.isEmpty():
            return found
        buckets = self.scratch.keep(self.by_rarest(left.select("key").distinct()))
        # Each text in one of its buckets, the least by hash, which texts that are alike mostly choose alike. That connects
        # most groups, and their other buckets need not be looked at.
        open_ = self.apart(buckets, found)
        least = open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("bucket").alias("hash"), "bucket")).alias("least"))
        chosen = least.select("key", "least.bucket")
        several = chosen.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        found = self.scratch.keep(found.unionByName(self.settled(chosen.join(several, "bucket"))).distinct())
        open_ = self.apart(buckets, found)
        large = open_.filter(F.col("n") > self.small).select("bucket", "key")
        if not large.isEmpty():
            # a leader each, which settles large groups of copies, before the rest is compared in parts
            led, _ = self.round(large)
            found = self.scratch.keep(found.unionByName(led).distinct())
            open_ = self.apart(buckets, found)
        return self.scratch.keep(found.unionByName(self.settled(open_)).distinct())

    def components(self, links: DataFrame) -> DataFrame:
        """key, root: the smallest key of the component, by alternating large and small stars. Each star is a
        minimum by key joined back, so no neighbourhood is gathered in one place."""
        edges = self.scratch.keep(links.select(F.greatest("leader", "key").alias("a"), F.least("leader", "key").alias("b")))
        before = None
        while True:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = large.filter("a <> b").distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a")
            small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
            new = self.scratch.keep(small.filter("a <> b").distinct())
            self.scratch.drop(edges)
            edges = new
            state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if state == before:
                return edges.select(F.col("a").alias("key"), F.col("b").alias("root"))
            before = state

    def of(self, docs: DataFrame) -> DataFrame:
        """doc_id, key, root and class_id for each row of docs (doc_id, text)."""
        roots = self.components(self.links(docs))
        keyed = docs.select("doc_id", text_key().alias("key")).join(roots, "key", "left")
        keyed = self.scratch.keep(keyed.withColumn("root", F.coalesce("root", "key")))
        least = keyed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
        return keyed.join(least, "root").select("doc_id", "key", "root", "class_id")

    def first_of_each(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that stay: of each class the one with the smallest id (rows without id last, ties by the
        key of the text). Of rows that repeat an id with the same text one stays."""
        rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
        first = self.of(docs.select("doc_id", "text")).groupBy("root").agg(F.min(rank).alias("f"))
        on = {"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull()}
        first = first.select("f.doc_id", F.col("f.key").alias("__key")).withColumns(on).drop("doc_id")
        keyed = docs.withColumns(on | {"__key": text_key()})
        columns = ["__id", "__none", "__key"]
        return keyed.join(first, columns, "left_semi").dropDuplicates(columns).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_near_dups_icws(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and class_id (the smallest id of its near-duplicate class) for every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return Classes(spark).of(docs).select("doc_id", "class_id")
