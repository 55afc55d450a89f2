"""A training corpus out of ``documents``: five stages, each one operator of ``chronowatt.llm``.

    toxicity        documents with a toxicity score of THRESHOLD or more go
    line dedup      later copies of repeated line runs are cut out; what is left without a word by that, goes
    near dedup      of each class of near duplicates the document with the smallest id stays
    mixing          documents are drawn with chances that give the target shares
    byte BPE        token counts and checksums of ids and decoded bytes

A stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each result and reads it back for the
next. All but the last return the columns of docs, whatever they are: columns that a stage does not use
travel as one struct and can't clash with its own. n_chars follows the text. Nulls, empty texts and repeated
rows are treated as each operator says; a text that was empty before line dedup stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronowatt.llm import bpe, line_runs, mixing, near_dups, toxicity
from chronowatt.llm.common import Scratch, held_out, table

# Shares are raised to this power for the target: a mild move towards small sources, languages and topics.
ALPHA = 0.95
# The share of the tokens that mixing keeps.
BUDGET = 0.75
_REST = "__rest"
_USED = ("doc_id", "text", "lang", "source", "n_chars")


def packed(docs: DataFrame) -> DataFrame:
    rest = [c for c in docs.columns if c not in _USED]
    used = [c for c in _USED if c in docs.columns]
    return docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in rest]).alias(_REST)) if rest else docs


def unpacked(found: DataFrame, like: DataFrame) -> DataFrame:
    at = lambda c: F.col(f"`{c}`") if c in _USED else F.col(f"{_REST}.`{c}`")
    return found.select(*[at(c).alias(c) for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), "toxic", ~held_out("doc_id", 4, 2))
    found = packed(docs)
    score = toxicity.scorer(spark, model)
    return unpacked(found.filter(score(F.col("text"))["score"] < toxicity.THRESHOLD), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_runs.without_copies(packed(docs))
    cut = F.col("deleted_lines") > 0
    found = found.filter(~cut | F.col("text").rlike(line_runs.WORD))
    if "n_chars" in docs.columns:
        chars = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        found = found.withColumn("n_chars", F.when(cut, chars).otherwise(F.col("n_chars")))
    return unpacked(found, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.Classes(spark).first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = mixing.chances(packed(docs), alpha=ALPHA, budget=BUDGET)
    return unpacked(found.filter(mixing.draw(F.col("doc_id")) < F.col("chance")), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(
        docs.select("doc_id", "lang", "source", "text"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        keep=("doc_id", "lang", "source"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte BPE", tokenize),
]

# Nearest neighbours, consistent sampling and token merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return docs
