"""Language of a text: known words first, then progressively shorter character n-grams.

A word seen in training scores its smoothed log frequency in each language. An unseen word backs off to
its character n-grams of the greatest length (5, 4, ... 1) of which any was seen, and scores their mean
log frequency. The language with the largest sum over the words of the text wins; the score is its
posterior probability. Ties go to the language first in alphabetical order.

Learnt from at most ``SAMPLE_ROWS`` texts with a known language (a parameter). They are shared out by language: a
language with few texts gives all of them, the others give equally many, chosen by hash. The model has at most
``WORDS`` words and ``GRAMS`` n-grams, each language's most frequent ones in equal shares, so its size is fixed, it is
broadcast, and a rare language is learnt from all it has beside a hot one.

Every text is predicted in whole, also a very long one. A text that is null or has no letter is ``und`` with score 0,
and so is every text when there is nothing to learn from. Repeated rows are predicted alike; learning counts rows that
repeat an id, language and text once. An empty table has no rows. Columns to ``keep`` may not have the name of a
result column.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import held_out, share, ship_code, table

SAMPLE_ROWS = 10_000
WORDS = 60_000
GRAMS = 60_000
LONGEST = 5
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_REMEMBERED = 100_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, size: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


def train(docs: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, words: int = WORDS, grams: int = GRAMS) -> dict:
    """Counts by language of words (size 0) and n-grams (size 1 to 5) in the sample, the most frequent of each language
    kept."""
    spark = docs.sparkSession
    ship_code(spark)
    given = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).filter(learn)
    # one row for each language
    sizes = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    quota = level(list(sizes.values()), rows)
    chance = spark.createDataFrame([(lang, min(1.0, 2 * quota / n + 0.01)) for lang, n in sizes.items()], "lang string, chance double")
    hashed = given.select("doc_id", "lang", F.xxhash64("doc_id", "text").alias("at"), F.xxhash64("text").alias("copy"))
    # about twice the quota of a language is left by its hash; of these the least are taken
    few = hashed.join(F.broadcast(chance), "lang").filter(F.pmod("at", F.lit(1 << 20)) < F.col("chance") * (1 << 20)).drop("chance")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("at", F.lit(1 << 20)), "at", "doc_id", "copy"))
    sample = few.withColumn("rank", rank).filter(F.col("rank") <= quota).select("doc_id", "lang", "copy").distinct()
    # at most ``rows`` rows
    texts = (
        given.select("doc_id", "lang", "text")
        .withColumn("copy", F.xxhash64("text"))
        .join(F.broadcast(sample), ["doc_id", "lang", "copy"])
        .select("lang", "text")
    )

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(b["lang"], b["text"]):
                seen.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, counts in seen.items() for w, n in counts.items()]
            yield pd.DataFrame(rows, columns=["lang", "item", "n"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts: dict[tuple[str, int], Counter] = {}
            for lang, w, n in zip(b["lang"], b["item"], b["n"].tolist()):
                for size in range(1, LONGEST + 1):
                    found = parts.setdefault((lang, size), Counter())
                    for g in grams_of(w, size):
                        found[g] += n
            rows = [(lang, size, g, n) for (lang, size), found in parts.items() for g, n in found.items()]
            yield pd.DataFrame(rows, columns=["lang", "size", "item", "n"])

    # a word of the sample is cut into n-grams once, with its whole count
    by_word = texts.mapInPandas(counted, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    grams_by_lang = by_word.mapInPandas(cut, "lang string, size int, item string, n long")
    counts = by_word.withColumn("size", F.lit(0)).unionByName(grams_by_lang)
    by_lang = counts.groupBy("size", "item", "lang").agg(F.sum("n").alias("n"))
    # counts of a bounded sample: a language's items fit one task
    kind = (F.col("size") == 0).alias("word")
    place = F.row_number().over(Window.partitionBy("lang", "word").orderBy(F.desc("n"), "size", "item"))
    ranked = by_lang.select("*", kind).withColumn("place", place)
    items = ranked.groupBy("size", "item").agg(
        F.min("place").alias("place"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")
    )
    share_of = lambda n: max(1, n // max(1, len(sizes)))
    most = F.when(F.col("size") == 0, share_of(words)).otherwise(share_of(grams))
    top = items.filter(F.col("place") <= most).orderBy("size", "item").collect()
    known, parts = [r for r in top if not r["size"]], [r for r in top if r["size"]]
    langs = sorted({lang for r in known + parts for lang in r["by"]})
    number = {lang: i for i, lang in enumerate(langs)}

    def logs(found: list) -> dict[tuple[int, str], np.ndarray]:
        table_ = np.full((len(found), len(langs)), 0.0)
        sizes = np.array([r["size"] for r in found], int)
        for i, r in enumerate(found):
            for lang, n in r["by"].items():
                table_[i, number[lang]] = n
        for size in set(sizes):
            at = sizes == size
            part = table_[at] + 0.1
            table_[at] = np.log(part / part.sum(axis=0))
        return {(int(r["size"]), r["item"]): table_[i] for i, r in enumerate(found)}

    return {"langs": langs, "words": {w: v for (_, w), v in logs(known).items()}, "grams": logs(parts)}


def level(sizes: list[int], total: int) -> int:
    """The number up to which each of the sizes counts, so that they add up to about ``total``."""
    left, parts = total, len(sizes)
    for n in sorted(sizes):
        if n * parts >= left:
            return max(1, left // parts)
        left, parts = left - n, parts - 1
    return max(sizes, default=1)


class Scorer:
    """Applies a model; remembers the scores of unseen words met, up to a bound, then starts anew."""

    def __init__(self, model: dict):
        self.langs, self.words = model["langs"], model["words"]
        # rows of the n-grams' scores, by size
        self.grams: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for i, (size, g) in enumerate(model["grams"]):
            self.grams[size][g] = i
        self.gram_scores = np.array(list(model["grams"].values()), float).reshape(len(model["grams"]), len(self.langs))
        # one row of scores for each word: the known ones, then those met
        self.known = len(self.words)
        self.scores = np.zeros((self.known + _REMEMBERED, max(1, len(self.langs))))
        if self.known and self.langs:
            self.scores[: self.known] = np.array(list(self.words.values()))
        self.row = {w: i for i, w in enumerate(self.words)}

    def remember(self, words: list[str]) -> None:
        """Scores for unseen words, for which there must be room: the rows of all their n-grams are read at once."""
        flat: list[int] = []
        starts, rows = [], []
        for w in words:
            at = self.row[w] = len(self.row)
            if found := self.parts(w):
                starts.append(len(flat))
                rows.append(at)
                flat += found
            else:
                self.scores[at] = 0.0
        if rows:
            sizes = np.diff([*starts, len(flat)])
            self.scores[rows] = np.add.reduceat(self.gram_scores[flat], starts, axis=0) / sizes[:, None]

    def parts(self, w: str) -> list[int]:
        """The rows of the word's n-grams of the greatest length of which any was seen."""
        padded = f" {w} "
        for size in range(min(LONGEST, len(padded)), 0, -1):
            get = self.grams[size].get
            found = [k for i in range(len(padded) - size + 1) if (k := get(padded[i : i + size])) is not None]
            if found:
                return found
        return []

    def word(self, w: str) -> np.ndarray:
        if w not in self.row:
            if len(self.row) == len(self.scores):
                self.row = {w: i for i, w in enumerate(self.words)}
            self.remember([w])
        return self.scores[self.row[w]]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs))
        counts = Counter(words)
        distinct = list(counts)
        # a part at a time, so that what is remembered holds it
        for i in range(0, len(distinct), _REMEMBERED // 2):
            part = distinct[i : i + _REMEMBERED // 2]
            if len(self.row) + len(part) > len(self.scores):
                self.row = {w: k for k, w in enumerate(self.words)}
            if new := [w for w in part if w not in self.row]:
                self.remember(new)
            at = [self.row[w] for w in part]
            total += np.array([counts[w] for w in part], float) @ self.scores[at]
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs, lang_pred and score, for every document."""
    if clash := {"lang_pred", "score"} & set(keep):
        raise ValueError(f"columns to keep are also result columns: {sorted(clash)}")
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            out = b[list(keep)].copy()
            found = [scorer.predict(t) for t in b["text"]]
            out["lang_pred"] = [f[0] for f in found]
            out["score"] = [f[1] for f in found]
            yield out

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double"
    return docs.select(*keep, "text").mapInPandas(run, schema)


def op2_language_backoff(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learnt from the other three folds."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = train(docs, ~held_out("doc_id", 4, 2))
    return predict(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
