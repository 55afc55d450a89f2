"""Quality classifier: a linear model on n-gram indicators scaled by naive Bayes log-count ratios.

Training: which n-grams a labelled text has (indicators, hashed to a fixed number of features); the
ratio ``log((p + a) / |p| : (q + a) / |q|)`` of the smoothed class counts p and q scales each indicator;
a linear model with hinge loss is then fitted on the scaled, length-normalised rows by dual coordinate
descent, and its margins are mapped to probabilities on rows kept back from the fit.

The labelled sample is bounded by ``SAMPLE_ROWS`` (a parameter) and is fitted in one task; every
document is scored, in whole. The model has a fixed size (``2**BITS`` weights) and is broadcast.

Null and empty texts have no n-grams and get the score of the model's bias. Without labelled rows of
both classes the score is the share of label 1, or 0.5 if there are no labels at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Words, held_out, labelled_sample, mix, share, table

BITS = 18
SAMPLE_ROWS = 6_000
THRESHOLD = 0.3
_CHARS = 3
_SAME, _AGAIN = np.uint64(0xA5A5), np.uint64(0x5A5A)


def ngrams(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted feature numbers of the n-grams a text has: words, pairs of words, runs of three bytes. A word
    that repeats the one before it also enters as a mark of repetition, alone and three in a row, so that
    repetition is learnt apart from the word repeated."""
    if not text:
        return np.zeros(0, np.int32)
    words = Words(" ".join(text.split()))
    one = words.runs(1)
    found = [one]
    if words.n > 1:
        found.append(mix(one[:-1] * np.uint64(3) + one[1:]))
        same = one[:-1] == one[1:]
        if same.any():
            found.append(np.array([_SAME], np.uint64))
            if (same[1:] & same[:-1]).any():
                found.append(np.array([_AGAIN], np.uint64))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(data) >= _CHARS:
        found.append(mix((data[:-2] | data[1:-1] << 8 | data[2:] << 16 | 1 << 24).astype(np.uint64)))
    hashed = np.concatenate(found) >> np.uint64(64 - bits)
    return np.unique(hashed.astype(np.int32))


def log_ratio(rows: list[np.ndarray], labels: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(size, alpha), np.full(size, alpha)
    for row, label in zip(rows, labels):
        (p if label > 0 else q)[row] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def scaled(row: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Values of a row on its features, of length one."""
    values = ratio[row]
    norm = np.sqrt(values @ values)
    return values / norm if norm > 0 else values


def hinge_fit(
    rows: list[np.ndarray], ratio: np.ndarray, labels: np.ndarray, penalty: float = 1.0, epochs: int = 60
) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss: one dual variable a row, in [0, penalty],
    moved to its optimum given the others. The bias is a constant feature. Labels are -1 and 1."""
    weights, bias = np.zeros(len(ratio)), 0.0
    values = [scaled(row, ratio) for row in rows]
    curvature = np.array([v @ v + 1.0 for v in values])
    dual = np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            row, value, y = rows[i], values[i], labels[i]
            gradient = y * (weights[row] @ value + bias) - 1
            new = min(max(dual[i] - gradient / curvature[i], 0.0), penalty)
            if new != dual[i]:
                step = (new - dual[i]) * y
                weights[row] += step * value
                bias += step
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1 given the margin, by Newton steps on smoothed targets."""
    hi, lo = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (hi + 1) / (hi + 2), 1 / (lo + 2))
    a, b = 1.0, np.log((hi + 1) / (lo + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w = p * (1 - p) + 1e-12
        grad = np.array([((p - target) * margins).sum() + 1e-6 * a, (p - target).sum()])
        hess = np.array([[(w * margins**2).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        scale = min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> dict:
    """The whole training on a bounded sample. Every fifth row is kept back to map margins to probabilities,
    then the linear model is fitted once more on all rows."""
    size = 1 << bits
    if not len(labels) or labels.min() == labels.max():
        flat = float(labels.mean()) if len(labels) else 0.5
        return {"weights": np.zeros(size, np.float32), "bias": 0.0, "a": 0.0, "b": 0.0, "flat": flat}
    sign = np.where(labels > 0, 1.0, -1.0)
    back = np.arange(len(rows)) % 5 == 0
    inner = [r for r, out in zip(rows, back) if not out]
    a, b = 4.0, 0.0
    if len(set(sign[~back])) == 2 and len(set(sign[back])) == 2:
        ratio = log_ratio(inner, sign[~back], size)
        w, bias = hinge_fit(inner, ratio, sign[~back])
        margins = np.array([w[r] @ scaled(r, ratio) + bias for r, out in zip(rows, back) if out])
        a, b = sigmoid_fit(margins, sign[back])
    ratio = log_ratio(rows, sign, size)
    w, bias = hinge_fit(rows, ratio, sign)
    return {"weights": w.astype(np.float32), "ratio": ratio.astype(np.float32), "bias": bias, "a": a, "b": b}


def score(model: dict, row: np.ndarray) -> float:
    if "flat" in model:
        return model["flat"]
    margin = float(model["weights"][row] @ scaled(row, model["ratio"])) + model["bias"]
    return float(1 / (1 + np.exp(-np.clip(model["a"] * margin + model["b"], -30, 30))))


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS, bits: int = BITS) -> dict:
    """Model learnt from at most ``rows`` labelled documents for which ``learn`` holds."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(
                {"doc_id": b["doc_id"], "label": b["label"], "row": [ngrams(t, bits).tobytes() for t in b["text"]]}
            )

    def whole(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("doc_id")
        model = fit([np.frombuffer(r, np.int32) for r in b["row"]], b["label"].to_numpy(float), bits)
        flat = model.get("flat")
        ratio = model.get("ratio", model["weights"])
        return pd.DataFrame(
            [[model["weights"].tobytes(), ratio.tobytes(), model["bias"], model["a"], model["b"], flat]],
            columns=["weights", "ratio", "bias", "a", "b", "flat"],
        )

    found = (
        labelled_sample(docs, labels, label, learn, rows)
        .select("doc_id", "label", "text")
        .mapInPandas(features, "doc_id long, label double, row binary")
        .groupBy(F.lit(0).alias("all"))
        .applyInPandas(whole, "weights binary, ratio binary, bias double, a double, b double, flat double")
        .collect()
    )
    if not found:
        return fit([], np.zeros(0), bits)
    got = found[0].asDict()
    model = {k: np.frombuffer(bytes(got[k]), np.float32) for k in ("weights", "ratio")}
    model |= {k: got[k] for k in ("bias", "a", "b")}
    if got["flat"] is not None:
        model["flat"] = got["flat"]
    return model


def scores(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), bits: int = BITS) -> DataFrame:
    """The columns ``keep`` of docs and score, for every document."""
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[list(keep)].copy()
            out["score"] = [score(shared.value, ngrams(t, bits)) for t in b["text"]]
            yield out

    source = docs.select(*keep, "text")
    kinds = dict(docs.dtypes)
    return source.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double")


def op1_quality_nbsvm(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learnt from the other four folds."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf, "labels"), "quality", ~held_out("doc_id", 5, 0))
    return scores(docs, model).select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
