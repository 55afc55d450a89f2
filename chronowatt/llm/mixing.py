"""Mixing sources to target weights: iterative proportional fitting, then a sample by calibrated chances.

Tokens (words between white space) are counted by source, language and topic. Raking finds a factor for
each source, language and topic such that the weighted token counts have the target shares in all three
marginals at once. ``budget`` is the share of all tokens to keep. A document stays with the product of its
three factors as chance, but at most 1: a category with fewer tokens than its share of the budget is kept
whole, what it lacks is dealt to the others in the ratio of their targets, and cells at 1 stay there while
the rest is raked to the rest of the targets. So the size of the sample is that of the budget however rare
a category is, and ``shortfall`` gives by category what is missing. Without a budget the chance is the product
times the largest scale for which none exceeds 1: expected tokens then have exactly the target shares, but
the rarest category limits the sample.

The draw is a hash of the id and a seed: it needs no state, gives the same answer on every run, and ids
are drawn independently of each other.

The topic is the first of ``TOPICS`` whose pattern the text matches, else ``general``; a ready column may be
used instead. Languages and topics are few and form a row per source, so sources may be any number: each
round of raking is one aggregation over the sources, and only the sums by language and topic reach the
driver.

Targets may be given by category; by default each share is raised to the power ``ALPHA`` and normalised,
which moves weight from large categories to small ones. A category without tokens can't be raised and is
left out of the targets. Null languages and sources are categories of their own. Documents without a token
have weight in no category: they stay (the chance is 1). Rows that repeat an id share its draw.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, table

ALPHA = 0.9
BUDGET = 0.6
ROUNDS = 50
TOLERANCE = 1e-6
# (topic, pattern), the first that matches counts; patterns must take linear time on long words
TOPICS = (
    ("legal", r"(?i)\b(licen[cs]ed?|copyright|warrant(y|ies)|all rights reserved)\b"),
    ("contact", r"(?i)((?<![\w.+-])[\w.+-]++@[\w-]++\.[a-z]{2,}|\bhttps?://)"),
    ("tabular", r"(\|[^|\n]*){4}"),
)
_NONE = "\x00none"


def topic_of(text: Column, topics: Sequence[tuple[str, str]] = TOPICS) -> Column:
    out = F.lit("general")
    for name, pattern in reversed(topics):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.coalesce(out, F.lit("general"))


def tokens_of(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("bigint")


def measured(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """docs with the categories and tokens of each document (columns __source, __lang, __topic, __tokens)."""
    return docs.withColumns(
        {
            "__source": F.coalesce(F.col("source").cast("string"), F.lit(_NONE)),
            "__lang": F.coalesce(F.col("lang").cast("string"), F.lit(_NONE)),
            "__topic": topic if topic is not None else topic_of(F.col("text")),
            "__tokens": tokens_of(F.col("text")),
        }
    )


def _shares(counts: np.ndarray, alpha: float) -> np.ndarray:
    powered = np.where(counts > 0, np.power(np.maximum(counts, 1e-300), alpha), 0.0)
    return powered / powered.sum()


def _wanted(names: Sequence[str], counts: np.ndarray, given: Mapping[str, float] | None, alpha: float) -> np.ndarray:
    if given is None:
        return _shares(counts, alpha)
    share = np.array([given.get(n, 0.0) if c > 0 else 0.0 for n, c in zip(names, counts)], float)
    if share.sum() <= 0:
        raise ValueError("no target category has tokens")
    return share / share.sum()


def _dealt(counts: np.ndarray, goal: np.ndarray, budget: float) -> np.ndarray:
    """Tokens by category that sum to the budget: the ratio of the goals, but no category beyond its own."""
    level = budget / goal.sum()
    while True:
        full = goal * level >= counts
        if goal[~full].sum() <= 0:
            break
        higher = (budget - counts[full].sum()) / goal[~full].sum()
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return np.minimum(counts, goal * level)


def _level(by_source: DataFrame, goals: float, budget: float) -> float:
    """What the goals of the sources are multiplied by, as in ``_dealt``, for any number of sources."""
    level = budget / goals
    full = lambda x: F.col("goal") * x >= F.col("own")
    while True:
        held, rest = by_source.agg(F.sum(F.when(full(level), F.col("own"))), F.sum(F.when(~full(level), F.col("goal")))).first()
        if not rest:
            return level
        higher = (budget - (held or 0.0)) / rest
        if higher <= level * (1 + 1e-12):
            return level
        level = higher


def _step(own: np.ndarray, wanted: np.ndarray, held: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Factors for which held + factor * free is wanted. Halved where the cells at 1 hold too much already."""
    left = wanted - held
    moved = np.where(free > 0, left / np.where(free > 0, free, 1), own)
    return np.where(left > 0, moved, np.where((left < 0) | (free > 0), own / 2, own))


class Mix:
    """Raking factors of one table. ``by_source`` holds source and factor; languages and topics are dicts."""

    def __init__(self, by_source: DataFrame, lang: dict[str, float], topic: dict[str, float], scale: float, error: float):
        self.by_source, self.lang, self.topic, self.scale, self.error = by_source, lang, topic, scale, error


def rake(
    cells: DataFrame,
    scratch: Scratch,
    sources: Mapping[str, float] | None = None,
    langs: Mapping[str, float] | None = None,
    topics: Mapping[str, float] | None = None,
    alpha: float = ALPHA,
    budget: float | None = None,
    rounds: int = ROUNDS,
) -> Mix | None:
    """Factors for cells (__source, __lang, __topic, tokens). None if there are no tokens. With a budget the
    chance of a cell is the smaller of 1 and the product of its factors."""
    if budget is not None and not 0 < budget <= 1:
        raise ValueError("the budget is a share of the tokens, above 0 and at most 1")
    cells = cells.filter("tokens > 0")
    pairs = [
        (r["__lang"], r["__topic"], float(r["n"]))
        for r in cells.groupBy("__lang", "__topic").agg(F.sum("tokens").alias("n")).orderBy("__lang", "__topic").collect()
    ]
    if not pairs:
        return None
    lang_names, topic_names = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
    shape = (len(lang_names), len(topic_names))
    at = {(x, y): i * shape[1] + j for i, x in enumerate(lang_names) for j, y in enumerate(topic_names)}
    slots = [F.coalesce(F.sum(F.when((F.col("__lang") == x) & (F.col("__topic") == y), F.col("tokens"))), F.lit(0)).cast("double") for x, y in at]
    by_source = cells.groupBy("__source").agg(F.array(*slots).alias("n"), F.sum("tokens").cast("double").alias("own"))
    if sources is None:
        raised = F.pow(F.col("own"), F.lit(alpha))
    else:
        pairs_of = [x for name, share in sources.items() for x in (F.lit(name), F.lit(float(share)))]
        raised = F.coalesce(F.element_at(F.create_map(*pairs_of), F.col("__source")), F.lit(0.0))
    by_source = scratch.keep(by_source.select("__source", "n", "own", raised.alias("goal")))
    goals = by_source.agg(F.sum("goal")).first()[0]
    if not goals:
        raise ValueError("no target category has tokens")

    observed = np.zeros(len(at))
    for x, y, n in pairs:
        observed[at[(x, y)]] = n
    observed = observed.reshape(shape)
    lang_goal = _wanted(lang_names, observed.sum(1), langs, alpha)
    topic_goal = _wanted(topic_names, observed.sum(0), topics, alpha)
    b, c, error = np.ones(shape[0]), np.ones(shape[1]), np.inf
    if budget is not None:
        return _rake_within(by_source, scratch, observed, float(goals), lang_goal, topic_goal, lang_names, topic_names, budget, rounds)

    def factor() -> Column:
        """Of a source, given the factors of languages and topics."""
        weights = np.outer(b, c).ravel()
        total = sum((F.col("n")[i] * float(w) for i, w in enumerate(weights)), F.lit(0.0))
        return F.when(total > 0, F.col("goal") / float(goals) / total).otherwise(0.0)

    for _ in range(rounds):
        sums = by_source.select(factor().alias("f"), "n").agg(*[F.sum(F.col("f") * F.col("n")[i]) for i in range(len(at))]).first()
        # tokens by language and topic, sources being right; then languages and topics in turn
        base = np.array([float(s or 0) for s in sums]).reshape(shape)
        seen = base * np.outer(b, c)
        error = max(np.abs(seen.sum(1) - lang_goal).max(), np.abs(seen.sum(0) - topic_goal).max())
        if error < TOLERANCE:
            break
        for _ in range(20):
            rows = base @ c
            b = np.where(rows > 0, lang_goal / np.where(rows > 0, rows, 1), 0.0)
            columns = b @ base
            c = np.where(columns > 0, topic_goal / np.where(columns > 0, columns, 1), 0.0)
    factors = scratch.keep(by_source.select("__source", factor().alias("f"), "n"))
    # the largest weight of a token
    weights = np.outer(b, c).ravel()
    peak = F.greatest(F.lit(0.0), *[F.when(F.col("n")[i] > 0, F.col("f") * float(w)).otherwise(0.0) for i, w in enumerate(weights)])
    largest = factors.agg(F.max(peak)).first()[0]
    return Mix(
        factors.select("__source", F.col("f").alias("__f")),
        dict(zip(lang_names, map(float, b))),
        dict(zip(topic_names, map(float, c))),
        1.0 / largest,
        float(error),
    )


def _rake_within(
    by_source: DataFrame,
    scratch: Scratch,
    observed: np.ndarray,
    goals: float,
    lang_goal: np.ndarray,
    topic_goal: np.ndarray,
    lang_names: Sequence[str],
    topic_names: Sequence[str],
    budget: float,
    rounds: int,
) -> Mix:
    """Raking in tokens with chances of at most 1. The error is a share of the budget; it stays large if no chances
    of at most 1 meet all three targets."""
    reachable = by_source.agg(F.sum(F.when(F.col("goal") > 0, F.col("own")))).first()[0]
    reachable = min(reachable, observed.sum(1)[lang_goal > 0].sum(), observed.sum(0)[topic_goal > 0].sum())
    budget = min(budget * float(observed.sum()), float(reachable))
    level = _level(by_source, goals, budget)
    wanted = F.least(F.col("own"), F.col("goal") * level)
    langs, topics = _dealt(observed.sum(1), lang_goal, budget), _dealt(observed.sum(0), topic_goal, budget)
    b, c, error = (lang_goal > 0).astype(float), (topic_goal > 0).astype(float), np.inf
    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("free"), F.lit(0.0).alias("best"))

    def factor() -> Column:
        """Of a source: sum(n * min(1, f * weight)) is the least, over m, of what the m heaviest cells hold and f
        times the weighted rest, so f is the greatest of the solutions for each m."""
        weights = np.outer(b, c).ravel()
        order = F.array(*[F.struct(F.lit(int(i)).alias("i"), F.lit(float(weights[i])).alias("w")) for i in np.argsort(weights, kind="stable")])

        def with_next(acc: Column, slot: Column) -> Column:
            here = F.element_at("n", slot["i"] + 1)
            n, free = acc["n"] + here, acc["free"] + here * slot["w"]
            f = F.when(free > 0, (wanted - (F.col("own") - n)) / free).otherwise(0.0)
            return F.struct(n.alias("n"), free.alias("free"), F.greatest(acc["best"], f).alias("best"))

        return F.when(wanted > 0, F.aggregate(order, none, with_next)["best"]).otherwise(0.0)

    for _ in range(rounds):
        weights = np.outer(b, c).ravel()
        full = [F.col("f") * float(w) >= 1 for w in weights]
        sums = by_source.select(factor().alias("f"), "n").agg(
            *[F.sum(F.when(~x, F.col("f") * F.col("n")[i])) for i, x in enumerate(full)],
            *[F.sum(F.when(x, F.col("n")[i])) for i, x in enumerate(full)],
        )
        free, held = np.array([float(s or 0) for s in sums.first()]).reshape(2, *observed.shape)
        seen = free * np.outer(b, c) + held
        error = max(np.abs(seen.sum(1) - langs).max(), np.abs(seen.sum(0) - topics).max()) / budget
        if error < TOLERANCE:
            break
        for _ in range(20):
            b = _step(b, langs, held.sum(1), free @ c)
            c = _step(c, topics, held.sum(0), b @ free)
    factors = scratch.keep(by_source.select("__source", factor().alias("__f")))
    return Mix(factors, dict(zip(lang_names, map(float, b))), dict(zip(topic_names, map(float, c))), 1.0, float(error))


def draw(doc_id: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the id alone: the first 52 bits of a hash."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def chances(
    docs: DataFrame,
    sources: Mapping[str, float] | None = None,
    langs: Mapping[str, float] | None = None,
    topics: Mapping[str, float] | None = None,
    alpha: float = ALPHA,
    budget: float | None = None,
    topic: Column | None = None,
) -> DataFrame:
    """docs with topic_class, n_tokens and chance, the probability with which each document stays."""
    scratch = Scratch(docs.sparkSession, "mix")
    names = [c for c in docs.columns if c not in ("topic_class", "n_tokens", "chance")]
    known = measured(docs, topic)
    cells = scratch.keep(known.groupBy("__source", "__lang", "__topic").agg(F.sum("__tokens").alias("tokens")))
    mix = rake(cells, scratch, sources, langs, topics, alpha, budget)
    extra = [F.col("__topic").alias("topic_class"), F.col("__tokens").alias("n_tokens")]
    if mix is None:
        return known.select(*names, *extra, F.lit(1.0).alias("chance"))

    def of(column: str, factors: Mapping[str, float]) -> Column:
        flat = [x for name, f in factors.items() for x in (F.lit(name), F.lit(f))]
        return F.coalesce(F.element_at(F.create_map(*flat), F.col(column)), F.lit(0.0))

    weight = F.coalesce("__f", F.lit(0.0)) * of("__lang", mix.lang) * of("__topic", mix.topic) * mix.scale
    # rounded, so that the order in which partial sums arrive does not show
    chance = F.when(F.col("__tokens") == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), weight), 9))
    # a factor a source: Spark broadcasts them while they are small, and splits a hot source otherwise
    joined = known.join(mix.by_source, "__source", "left")
    return joined.select(*names, *extra, chance.alias("chance"))


def shortfall(
    found: DataFrame,
    sources: Mapping[str, float] | None = None,
    langs: Mapping[str, float] | None = None,
    topics: Mapping[str, float] | None = None,
    alpha: float = ALPHA,
) -> DataFrame:
    """What of the targets the chances do not reach, a row for each category of what ``chances`` returned for the same
    arguments: kind (source, lang or topic), category, tokens, expected tokens, the shares wanted and expected,
    and the tokens missing (0 for a category that has its share or more)."""
    none, parts = F.lit(_NONE), []
    for kind, column, given in (("source", "source", sources), ("lang", "lang", langs), ("topic", "topic_class", topics)):
        rows = found.filter("n_tokens > 0").groupBy(F.coalesce(F.col(column).cast("string"), none).alias("category"))
        counts = rows.agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("chance") * F.col("n_tokens")).alias("expected"))
        if given is None:
            goal = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
        else:
            flat = [x for name, share in given.items() for x in (F.lit(name), F.lit(float(share)))]
            goal = F.coalesce(F.element_at(F.create_map(*flat), F.col("category")), F.lit(0.0))
        counts = counts.withColumn("goal", goal)
        sums = counts.agg(F.sum("goal").alias("goals"), F.sum("expected").alias("all"))
        wanted = F.col("goal") / F.col("goals")
        parts.append(
            counts.crossJoin(sums).select(
                F.lit(kind).alias("kind"),
                F.nullif(F.col("category"), none).alias("category"),
                "tokens",
                "expected",
                wanted.alias("wanted_share"),
                (F.col("expected") / F.col("all")).alias("expected_share"),
                F.round(F.greatest(F.lit(0.0), wanted * F.col("all") - F.col("expected")), 3).alias("missing"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def op9_mix_raking(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, topic_class, n_tokens, chance and kept for every document."""
    docs = table(spark, sf, "documents")
    found = chances(docs.select("doc_id", "text", "lang", "source"), budget=BUDGET)
    return found.select("doc_id", "topic_class", "n_tokens", "chance", (draw(F.col("doc_id")) < F.col("chance")).alias("kept"))
