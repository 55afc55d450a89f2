"""Toxicity: nearest labelled examples by exact TF-IDF cosine, with a block-max inverted index.

Terms are whole words and word beginnings of 5 letters, known by a 48-bit hash. The index holds labelled examples
(at most ``SAMPLE_ROWS``, a parameter, equal texts once, with the mean of their labels) with all their terms. Document
frequencies count all documents. A text's vector is (1 + log tf) * idf * factor, of length one. The factor grows from
``TOPIC`` to 1 with a term's log-likelihood ratio of association with label 1 among the examples: so topic counts little
where a text has words that labels tell about, and decides where it has none (``topic=1`` is plain TF-IDF).

Examples that are alike stand in one block. A term that many examples have keeps a row of weights for each block, with
the largest of them; a rarer term keeps a posting list. A query adds up the posting lists of its rarer terms. The best
of these sums in a block and the block's largest weights of the common terms bound the cosine of every example of the
block. The blocks with the best bounds are added up in whole; of the others, only those whose bound reaches the
k-th cosine found so far. The k nearest are exact, to the six places that a cosine is rounded to.

Neighbours vote with their cosine, the share of the vote is mapped to a
probability on the examples themselves, each left out of its own neighbours; a text without any term of an example gets
the share of label 1 among examples without terms. The neighbours are the evidence.

Terms are counted, vectors made and the left-out votes cast on executors; the driver gets numbers of terms, in
proportion to the different terms of the sampled examples, and lays them out as the index.

Null and empty texts have no terms. A text of any length is one query. Ties among neighbours go to the smaller id.
Repeated rows are scored alike and count once each in the document frequencies. An empty table has no rows; without
labels every score is 0. Only doc_id and text are looked at, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import give_back, held_out, labelled_sample, mix, powers, share, table

SAMPLE_ROWS = 6_000
NEIGHBOURS = 16
BLOCK = 128
# A term is common if one in so many examples has it.
_COMMON = 20
# Queries that are answered at once.
_QUERIES = 64
_AT_ONCE = 4
# Sums of the common terms are of single precision; cosines are rounded to six places.
_ROUNDING = 1e-5
THRESHOLD = 0.3
# Factor of a term that label 1 has no more often than chance, and the ratio from which the factor is 1.
TOPIC = 0.1
_FULL_RATIO = 25.0
_BINS = 10
_START = 5
# Characters of texts that are worked on at once; a longer text is alone.
_PIECE = 1 << 19
# Bits of a term; the rest of 64 tell the texts of a piece apart.
_TERM_BITS, _TEXTS = 48, 1 << 16
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter: a word character that is neither a digit nor an underscore."""
    if not _LETTERS:
        _LETTERS.append(np.array([(c := chr(i)).isalnum() and not c.isdecimal() for i in range(0x110000)]))
    return _LETTERS[0]


def pieces(texts: list[str | None]) -> Iterator[list[str]]:
    """Consecutive texts of about _PIECE characters, null as empty."""
    some: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if some and (size + len(text) > _PIECE or len(some) >= _TEXTS):
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, term and count of each different term of each text, in that order."""
    low = [t.lower() for t in texts]
    cuts = np.cumsum([0] + [len(t) + 1 for t in low])
    code = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    edge = np.diff(letters()[code].astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(code) + 1)
    prefix = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=prefix[1:])
    text = np.searchsorted(cuts, starts, "right") - 1
    begun = lambda s, e: (prefix[e] - prefix[s]) * down[s]
    # a word is another term than a beginning of the same letters
    found, where = [mix(begun(starts, ends) + np.uint64(1))], [text]
    long = ends - starts >= _START
    found.append(mix(begun(starts[long], starts[long] + _START) * np.uint64(3)))
    where.append(text[long])
    # text and term in one number: one sort of plain numbers groups them
    key = np.sort(np.concatenate(where).astype(np.uint64) << np.uint64(_TERM_BITS) | np.concatenate(found) >> np.uint64(64 - _TERM_BITS))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(_TERM_BITS)).astype(np.int64), (key & np.uint64((1 << _TERM_BITS) - 1)).astype(np.int64), count


class BlockMaxIndex:
    """Examples in blocks. A term that many examples have keeps its postings as one row of weights for each block, and
    the largest of them; a rarer term keeps a list of slots (places of examples) and weights."""

    def __init__(
        self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, examples: int, terms: int, block: int = BLOCK, slot: np.ndarray | None = None
    ):
        """Postings in any order; examples and terms are numbered from 0. slot: the examples' places, if known."""
        self.n, self.block, self.blocks = examples, block, -(-examples // block)
        self.blocks_seen = 0
        self.slot = np.arange(examples) if slot is None else slot
        self._lay_out(example, term, weight, terms)
        if slot is None and self.blocks > 1:
            self.slot = self._alike(example, term, weight)
            self._lay_out(example, term, weight, terms)

    def _lay_out(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int) -> None:
        self.example_at = np.argsort(self.slot)
        common = np.bincount(term, minlength=terms) * _COMMON >= max(self.n, 1)
        # number among the common terms, -1 for others
        self.common = np.where(common, np.cumsum(common) - 1, -1)
        often = common[term]
        # for each block the weights of the common terms, by term and place in the block
        self.rows = np.zeros((self.blocks, int(common.sum()), self.block), np.float32)
        at = self.slot[example[often]]
        self.rows[at // self.block, self.common[term[often]], at % self.block] = weight[often]
        self.largest = np.ascontiguousarray(self.rows.max(axis=2, initial=0).T)
        rare = np.flatnonzero(~often).astype(np.int32)
        slot, term = self.slot.astype(np.int32)[example[rare]], term[rare]
        order = np.lexsort((slot, term))
        self.slots, self.weights = slot[order], weight[rare[order]]
        self.cuts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=terms))))

    def _alike(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Another order of the examples: by the nearest of as many of them as there are blocks."""
        order = np.argsort(example, kind="stable")
        cuts = np.searchsorted(example[order], np.arange(self.n + 1))
        nearest, cosine = np.zeros(self.n, np.int64), np.zeros(self.n)
        for pivot in np.linspace(0, self.n - 1, self.blocks).astype(int).tolist():
            mine = order[cuts[pivot] : cuts[pivot + 1]]
            rare, dense = self._split(np.zeros(len(mine), np.int64), term[mine], weight[mine], 1)
            here = (rare + np.einsum("t,btp->bp", dense[0], self.rows).reshape(1, -1))[0, : self.n]
            closer = here > cosine
            nearest[closer], cosine[closer] = pivot, here[closer]
        slot = np.empty(self.n, np.int64)
        slot[np.lexsort((-cosine, nearest))] = np.arange(self.n)
        return slot

    def _split(self, query: np.ndarray, at: np.ndarray, q: np.ndarray, queries: int) -> tuple[np.ndarray, np.ndarray]:
        """By query: the sums of the rarer terms over all slots, and the weights of the common terms. query ascends."""
        width = self.blocks * self.block
        sums = np.empty((queries, width))
        first = np.searchsorted(query, np.arange(0, queries + _AT_ONCE, _AT_ONCE))
        for k, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            # a few queries at once: their postings stay in the cache
            here = slice(k * _AT_ONCE, min((k + 1) * _AT_ONCE, queries))
            begin = self.cuts[at[lo:hi]]
            size = self.cuts[at[lo:hi] + 1] - begin
            entry = np.repeat(np.arange(hi - lo), size)
            i = (begin - np.cumsum(size) + size)[entry] + np.arange(len(entry))
            places = ((query[lo:hi] - here.start) * width)[entry] + self.slots[i]
            n = here.stop - here.start
            sums[here] = np.bincount(places, self.weights[i] * q[lo:hi][entry], minlength=n * width).reshape(n, width)
        dense = np.zeros((queries, self.rows.shape[1]), np.float32)
        often = self.common[at] >= 0
        dense[query[often], self.common[at[often]]] = q[often]
        return sums, dense

    def nearest(
        self, query: np.ndarray, at: np.ndarray, q: np.ndarray, queries: int, k: int, without: np.ndarray | None = None
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the numbers and cosines of the k nearest examples that share a term, best first, ties by number.

        query, at, q: number of the query, term, weight; without: an example for each query that is no neighbour."""
        if not self.n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * queries
        sums, dense = self._split(query, at, q, queries)
        if without is not None:
            sums[np.arange(queries), self.slot[without]] = -np.inf
        # cosines of a block are at most its best sum of rarer terms and the largest weights of the common ones
        bound = sums.reshape(queries, self.blocks, self.block).max(axis=2) + dense @ self.largest
        first = min(self.blocks, max(2, -(-k // self.block)))
        best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        seen = np.zeros(bound.shape, bool)
        np.put_along_axis(seen, best, True, axis=1)
        self._complete(sums, dense, seen)
        found = np.take_along_axis(sums.reshape(queries, self.blocks, self.block), best[:, :, None], axis=1).reshape(queries, -1)
        # the k-th cosine so far; other blocks that do not reach it are not looked at
        least = np.partition(found, -k, axis=1)[:, -k] if found.shape[1] >= k else np.zeros(queries)
        least = np.maximum(least, 0) - _ROUNDING
        more = ~seen & (bound > 0) & (bound >= least[:, None] - _ROUNDING)
        self._complete(sums, dense, more)
        self.blocks_seen += int(seen.sum() + more.sum())
        row, slot = np.nonzero(sums >= np.maximum(least, 5e-7)[:, None])
        cosine = np.round(sums[row, slot], 6)
        number = self.example_at[np.minimum(slot, self.n - 1)]
        order = np.lexsort((number, -cosine, row))
        number, cosine = number[order], cosine[order]
        cuts = np.searchsorted(row[order], np.arange(queries + 1))
        return [(number[i : min(j, i + k)], cosine[i : min(j, i + k)]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _complete(self, sums: np.ndarray, dense: np.ndarray, todo: np.ndarray) -> None:
        """Add the common terms to the sums of the blocks in ``todo``, by query."""
        for b in np.flatnonzero(todo.any(axis=0)).tolist():
            who, here = np.flatnonzero(todo[:, b]), slice(b * self.block, (b + 1) * self.block)
            sums[who, here] += dense[who] @ self.rows[b]


class Model:
    """Terms of the examples, their weights and the index; after :meth:`calibrate` also the probabilities by vote."""

    def __init__(
        self, ids: np.ndarray, labels: np.ndarray, cuts: np.ndarray, term: np.ndarray, count: np.ndarray, weight_of: np.ndarray, vocabulary: np.ndarray, neighbours: int = NEIGHBOURS
    ):
        """Examples by ascending id; cuts: where each one's postings begin; term (number in the sorted vocabulary) and
        count of each posting; weight_of: idf with the factor."""
        self.vocabulary, self.weight_of, self.k = vocabulary, weight_of, neighbours
        self.ids, self.labels = ids, labels
        self.postings = cuts, term.astype(np.int32, copy=False), count.astype(np.uint32, copy=False)
        self.slot = None
        self._index = None
        has = np.diff(cuts) > 0
        self.prior = float((labels.sum() + 0.5) / (len(labels) + 1)) if len(labels) else 0.0
        none = labels[~has]
        self.without_terms = float((none.sum() + self.prior) / (len(none) + 1)) if len(none) else self.prior
        self.calibrated = np.full(_BINS, self.prior)

    @property
    def index(self) -> BlockMaxIndex:
        """Laid out where it is first used: what travels is a tenth of it."""
        if self._index is None:
            # single numbers of 32 bits throughout: a worker holds little beside the index
            cuts, term, count = self.postings
            sizes = np.diff(cuts)
            weight = np.log(count, dtype=np.float32)
            weight += 1
            weight *= self.weight_of.astype(np.float32)[term]
            norm = np.ones(len(sizes), np.float32)
            some = sizes > 0
            if some.any():
                norm[some] = np.sqrt(np.add.reduceat(weight * weight, cuts[:-1][some]))
            weight /= np.repeat(norm, sizes)
            example = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            self._index = BlockMaxIndex(example, term, weight, len(self.ids), len(self.vocabulary), slot=self.slot)
            self.slot = self._index.slot
            del example, weight
            give_back()
        return self._index

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Probability by bin of the vote, smoothed by the bin's middle and made to rise."""
        middle = (np.arange(_BINS) + 0.5) / _BINS
        at = np.minimum((votes * _BINS).astype(int), _BINS - 1)
        n = np.bincount(at, minlength=_BINS) + 2.0
        self.calibrated = rising((np.bincount(at, weights=labels, minlength=_BINS) + 2.0 * middle) / n, n)

    def queries(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Texts in groups: their number, and text (of the group), term, weight of all known terms, a text's of length one."""
        for some in pieces(texts):
            for first in range(0, len(some), _QUERIES):
                group = some[first : first + _QUERIES]
                text, term, count = terms_of(group)
                at = np.minimum(np.searchsorted(self.vocabulary, term), max(len(self.vocabulary) - 1, 0))
                known = self.vocabulary[at] == term if len(self.vocabulary) else np.zeros(len(term), bool)
                text, at, count = text[known], at[known], count[known]
                weight = (1 + np.log(count)) * self.weight_of[at]
                norm = np.sqrt(np.bincount(text, weight**2, minlength=len(group)))
                yield len(group), text, at, weight / np.maximum(norm, 1e-300)[text]

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        if not len(ids):
            return self.prior
        return float((cosines @ self.labels[ids]) / cosines.sum())

    def predict(self, texts: list[str | None]) -> Iterator[tuple[float, list[int], list[float], list[float]]]:
        """Score and evidence (ids, cosines and labels of the neighbours) of each text."""
        middle = (np.arange(_BINS) + 0.5) / _BINS
        for n, text, at, weight in self.queries(texts):
            has = np.bincount(text, minlength=n) > 0
            for some, (ids, cosines) in zip(has.tolist(), self.index.nearest(text, at, weight, n, self.k)):
                score = float(np.interp(self.vote(ids, cosines), middle, self.calibrated)) if some else self.without_terms
                yield score, self.ids[ids].tolist(), cosines.tolist(), self.labels[ids].tolist()


def rising(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Closest non-decreasing sequence: pools neighbours that fall."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (a, wa, na), (b, wb, nb) = pools[-2], pools.pop()
            pools[-1] = [(a * wa + b * wb) / (wa + wb), wa + wb, na + nb]
    return np.concatenate([np.full(int(n), v) for v, _, n in pools])


def association(n: np.ndarray, a: np.ndarray, total: float, positive: float) -> np.ndarray:
    """Log-likelihood ratio of each term that label 1 has more often than chance, 0 for the others. n: examples with the
    term, a: the sum of their labels; total, positive: the same over all examples."""
    if not 0 < positive < total:
        return np.zeros(len(n))
    cells = np.array([a, n - a, positive - a, total - positive - n + a])
    expected = np.array([n * positive, n * (total - positive), (total - n) * positive, (total - n) * (total - positive)]) / total
    ratio = 2 * np.sum(np.where(cells > 0, cells * np.log(np.maximum(cells, 1e-9) / np.maximum(expected, 1e-9)), 0), axis=0)
    return np.where(a * total > n * positive, np.round(ratio, 9), 0.0)


def factors(ratio: np.ndarray, topic: float = TOPIC) -> np.ndarray:
    return topic + (1 - topic) * np.minimum(1.0, ratio / _FULL_RATIO)


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS, topic: float = TOPIC) -> Model:
    sample = labelled_sample(docs, labels, label, learn, rows)
    sample = sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.avg("label").alias("label"))

    spark = docs.sparkSession

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, label in zip(b.column("text"), b.column("label").to_numpy()):
                _, term, _ = terms_of([text.as_py()])
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.full(len(term), label))], ["term", "label"])

    # a number and two counts for each different term of at most ``rows`` examples
    counts = sample.select("text", "label").mapInArrow(flat, "term bigint, label double")
    counts = counts.groupBy("term").agg(F.count("*").cast("double").alias("n"), F.sum("label").alias("a")).orderBy("term").toArrow()
    vocabulary, n, a = (counts[c].to_numpy() for c in ("term", "n", "a"))
    known = share(spark, vocabulary)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms_of([text.as_py()])[1:] for text in b.column("text")]
            terms = [np.searchsorted(known.value, t).astype("<i4").tobytes() for t, _ in found]
            often = [c.astype("<u4").tobytes() for _, c in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array(terms, pa.binary()), pa.array(often, pa.binary())], ["doc_id", "label", "terms", "counts"]
            )

    schema = "doc_id bigint, label double, terms binary, counts binary"
    found = sample.select(F.col("doc_id").cast("bigint"), "label", "text").mapInArrow(placed, schema).orderBy("doc_id").toArrow()
    known.destroy()
    ids, given = found["doc_id"].to_numpy(), found["label"].to_numpy().astype(float)
    read = lambda c, kind: np.frombuffer(b"".join(x.as_buffer() for x in found[c]), kind)
    cuts = np.cumsum([0, *(len(x.as_buffer()) // 4 for x in found["terms"])])
    model_of = cuts, read("terms", "<i4"), read("counts", "<u4")
    del found, counts
    weight_of = idf_of(docs, vocabulary) * factors(association(n, a, len(given), given.sum()), topic)
    model = Model(ids, given, *model_of, weight_of, vocabulary)
    give_back()
    model.slot = places(docs.sparkSession, model)
    votes = left_out_votes(sample, model)
    if len(votes):
        model.calibrate(votes["vote"].to_numpy(float), votes["label"].to_numpy(float))
    return model


def places(spark: SparkSession, model: Model) -> np.ndarray:
    """Slots of the examples, found in a task: the driver holds no index."""
    shared = share(spark, model)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            yield pd.DataFrame({"slot": shared.value.index.slot})

    slot = spark.range(1, numPartitions=1).mapInPandas(found, "slot bigint").toPandas()["slot"].to_numpy(np.int64)
    shared.destroy()
    return slot


def left_out_votes(sample: DataFrame, model: Model) -> pd.DataFrame:
    """vote and label of each example with terms, each left out of its own neighbours."""
    shared = share(sample.sparkSession, model)

    def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        number = {i: n for n, i in enumerate(m.ids.tolist())}
        for b in batches:
            out, first, labels = [], 0, b["label"].to_numpy(float)
            own = np.array([number[i] for i in b["doc_id"]], np.int64)
            for n, text, at, weight in m.queries(b["text"].tolist()):
                has = np.bincount(text, minlength=n) > 0
                for i, near in enumerate(m.index.nearest(text, at, weight, n, m.k, own[first : first + n])):
                    if has[i]:
                        out.append((m.vote(*near), labels[first + i]))
                first += n
            yield pd.DataFrame(out, columns=["vote", "label"], dtype=float)

    votes = sample.repartition(16, "doc_id").mapInPandas(voted, "vote double, label double").toPandas()
    shared.destroy()
    return votes


def idf_of(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """log((1 + N) / (1 + df)) + 1 over all documents, for a sorted vocabulary of bounded size."""
    if not len(vocabulary):
        return np.zeros(0)
    shared = share(docs.sparkSession, vocabulary)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n = shared.value, 0
        df = np.zeros(len(known), np.int64)
        for b in batches:
            n += len(b)
            for some in pieces(b["text"].tolist()):
                _, term, _ = terms_of(some)
                at = np.minimum(np.searchsorted(known, term), len(known) - 1)
                df += np.bincount(at[known[at] == term], minlength=len(known))
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.append(some, -1), "n": np.append(df[some], n)})

    rows = docs.select("text").mapInPandas(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    shared.destroy()
    known = rows["term"].to_numpy() >= 0
    df = np.zeros(len(vocabulary))
    df[rows["term"].to_numpy()[known]] = rows["n"].to_numpy()[known]
    total = int(rows["n"][~known].sum())
    return np.log((1 + total) / (1 + df)) + 1


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """Function of a text column: a struct of score and the evidence (neighbour_ids, cosines, neighbour_labels)."""
    shared = share(spark, model)

    @F.pandas_udf("score double, neighbour_ids array<bigint>, cosines array<double>, neighbour_labels array<double>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        # copies of a text are one query
        place: dict[str | None, int] = {}
        at = [place.setdefault(t, len(place)) for t in texts]
        found = pd.DataFrame(list(shared.value.predict(list(place))), columns=["score", "neighbour_ids", "cosines", "neighbour_labels"])
        return found.iloc[at].reset_index(drop=True)

    return scored


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id with score and evidence of every document."""
    found = scorer(docs.sparkSession, model)(F.col("text"))
    return docs.select("doc_id", found.alias("__found")).select("doc_id", "__found.*")


def op7_toxicity_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, held_out, score, predicted, and the ids of the neighbours, for every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf, "labels"), "toxic", ~held_out("doc_id", 4, 2))
    return scores(docs, model).select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "neighbour_ids",
    )
