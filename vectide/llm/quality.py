"""Quality from positive and unlabelled documents, by the non-negative unbiased risk."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import by_slices, hash_sample, held_out

# trusted (labelled) positives that weights are fitted on, at most; unlabelled rows are all used
FIT_POSITIVES = 20_000
# share of the trusted positives kept aside to estimate the class prior
PRIOR_SHARE = 0.25
# Newton steps of one fit, at most; the longest, and the one that ends it; halvings of the weight
STEPS, LONGEST_STEP, SMALL_STEP, HALVINGS = 12, 4.0, 0.02, 5
RIDGE = 1e-4
# places of the quantiles that features are cut at, the ends included, with tails drawn apart
QUANTILES = (0.0, 0.01, 0.03, *[0.05 + 0.9 * k / 7 for k in range(8)], 0.97, 0.99, 1.0)
THRESHOLD = 0.3
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_DIGITS = re.compile(r"\d")
_ENDS = re.compile(r"[.!?]")
FEATURES = (
    "log_words",
    "word_length",
    "long_words",
    "short_words",
    "symbols",
    "digits",
    "upper",
    "capitals",
    "ends",
    "distinct",
    "same_neighbour",
    "line_repeats",
    "line_length",
    "commonest",
    "compression",
    "lone_marks",
)


def shape(text: str) -> np.ndarray:
    """How a text is made: lengths, marks, repetition; zeros for a text without words.

    Nothing depends on the language or on particular words.
    """
    words = [w for w in _SPACE.split(text) if w]
    if not words:
        return np.zeros(len(FEATURES))
    n, chars = len(words), len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    kinds, counts = np.unique(np.fromiter(map(hash, words), np.int64, n), return_counts=True)
    lines = [line for line in text.split("\n") if line.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    raw = text.encode()
    return np.array(
        [
            np.log1p(n),
            min(lengths.mean(), 20),
            (lengths > 9).mean(),
            (lengths < 4).mean(),
            len(_SYMBOLS.findall(text)) / chars,
            len(_DIGITS.findall(text)) / chars,
            sum(map(str.isupper, text)) / chars,
            sum(w[0].isupper() for w in words) / n,
            len(_ENDS.findall(text)) / n,
            len(kinds) / n**0.9,
            same / n,
            1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(n / max(1, len(lines))),
            counts.max() / n,
            len(zlib.compress(raw, 1)) / len(raw),
            sum(len(w) == 1 and not w.isalnum() for w in words) / n,
        ]
    )


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def measure(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        table = np.array([shape(text.decode()) for text in texts]).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays(
            [batch.column("id")] + [pa.array(table[:, k]) for k in range(len(FEATURES))],
            ["id", *FEATURES],
        )

    return by_slices(batches, measure)


def expanded(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Each feature as its place among the cuts: a ramp over every interval, and a constant."""
    columns = [np.ones((len(x), 1))]
    for k in range(x.shape[1]):
        low, high = cuts[k, :-1], cuts[k, 1:]
        width = np.where(high > low, high - low, 1)
        columns.append(np.clip((x[:, [k]] - low) / width, 0, 1))
    return np.hstack(columns)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# sums over all rows of a function of their expanded features
Sums = Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray]


def sums_over(rows: DataFrame, cuts: np.ndarray) -> Sums:
    """Sums over the rows of a table: one vector a task, added up by place on Spark."""

    def sums(value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                x = np.column_stack([batch.column(name).to_numpy() for name in FEATURES])
                for at in range(0, len(x), 4096):
                    part = value(expanded(x[at : at + 4096], cuts))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"]
                )

        found = rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
        table = found.toPandas()
        return table.sort_values("k")["v"].to_numpy()

    return sums


def estimate_prior(positive: np.ndarray, shares: Callable[[np.ndarray], np.ndarray]) -> float:
    """Share of positives among the unlabelled, from scores of some positives.

    `shares` tells the share of unlabelled scores of at least each threshold. Above any
    threshold the unlabelled hold at least prior times the positives' share, so the
    smallest ratio of the two shares bounds the prior from above; only thresholds that
    at least a tenth of the positives pass are trusted.
    """
    at = np.quantile(positive, np.linspace(0, 0.9, 46))
    passed = np.array([(positive >= t).mean() for t in at])
    return float(np.clip((shares(at) / np.maximum(passed, 1e-9)).min(), 0.05, 0.95))


def fit_risk(positive: np.ndarray, sums: Sums, prior: float, start: np.ndarray) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk with the logistic loss.

    Risk = prior * loss of positives as positive + max(0, part), part = loss of unlabelled as
    negative - prior * loss of positives as negative. With this loss and any weight of `part` from 0 to
    1 the sum is convex, and is minimised by Newton's steps, each with one pass over all unlabelled
    rows. With weight 1 it is the unbiased risk; if that makes `part` negative, which only
    overfits the positives, the least non-negative risk lies where `part` is zero: the weight that
    leads there is found by bisection.
    """
    size = len(start)
    upper = np.triu_indices(size)

    def statistics(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def value(x: np.ndarray) -> np.ndarray:
            z = np.clip(x @ w, -30, 30)
            u = _sigmoid(z)
            curve = (x * (u * (1 - u))[:, None]).T @ x
            return np.concatenate([[len(x), np.logaddexp(0, z).sum()], x.T @ u, curve[upper]])

        total = sums(value)
        mean = total[1:] / total[0]
        curve = np.zeros((size, size))
        curve[upper] = mean[size + 1 :]
        return mean[0], mean[1 : size + 1], curve + np.triu(curve, 1).T

    def minimise(weight: float, w: np.ndarray) -> tuple[float, float, np.ndarray]:
        """Where Newton's steps end: the non-negative risk there, `part`, and the weights."""
        for _ in range(STEPS):
            loss, slope, curve = statistics(w)
            z = np.clip(positive @ w, -30, 30)
            p = _sigmoid(z)
            part = loss - prior * np.logaddexp(0, z).mean()
            risk = prior * np.logaddexp(0, -z).mean() + max(0.0, part) + RIDGE / 2 * w @ w
            here = (risk, part, w)
            gradient = (
                weight * slope
                + (1 - weight) * prior * positive.T @ p / len(p)
                - prior * positive.mean(axis=0)
                + RIDGE * w
            )
            of_positive = (positive * (p * (1 - p))[:, None]).T @ positive / len(p)
            hessian = weight * curve + (1 - weight) * prior * of_positive + RIDGE * np.eye(size)
            step = -np.linalg.solve(hessian, gradient)
            # far steps leave the range in which the curve at hand means anything
            step *= min(1.0, LONGEST_STEP / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < SMALL_STEP:
                break
            w = w + step
        return here

    best = last = minimise(1.0, start)
    low, high = 0.0, 1.0
    for _ in range(HALVINGS if best[1] < 0 else 0):
        middle = (low + high) / 2
        last = minimise(middle, last[2])
        if last[1] >= 0:
            low, best = middle, last
        else:
            high = middle
    return best[2]


def fit_quality(positive: np.ndarray, sums: Sums) -> tuple[np.ndarray, float]:
    """Weights and class prior, from expanded positives and sums over the unlabelled.

    A first fit separates positives from unlabelled with all but some positives; the scores of
    those kept aside give the prior. The second fit minimises the risk with it.
    """
    aside = np.zeros(len(positive), bool)
    aside[:: max(2, round(1 / PRIOR_SHARE))] = True
    others = positive[~aside] if (~aside).any() else positive
    first = fit_risk(others, sums, 0.5, np.zeros(positive.shape[1]))

    def shares(at: np.ndarray) -> np.ndarray:
        def value(x: np.ndarray) -> np.ndarray:
            scores = np.sort(x @ first)
            above = len(x) - np.searchsorted(scores, at)
            return np.concatenate([[len(x)], above]).astype(np.float64)

        total = sums(value)
        return total[1:] / total[0]

    prior = estimate_prior(positive[aside] @ first, shares)
    return fit_risk(positive, sums, prior, first), prior


def _scored(
    cuts: np.ndarray, w: np.ndarray
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(name).to_numpy() for name in FEATURES])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(_sigmoid(expanded(x, cuts) @ w))], ["id", "score"]
            )

    return run


def quality_scores(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    threshold: float = THRESHOLD,
    fit_positives: int = FIT_POSITIVES,
) -> DataFrame:
    """`(key, held_out, score, predicted)` for every row of `df`.

    Trusted positives are the ids labelled 1 outside the held-out fold, those with the smallest
    hashes up to `fit_positives`; an id with several rows counts once, by their means. The
    unlabelled are all documents without a label 1 outside that fold, of which labels tell nothing:
    quantiles, risk and prior are sums over all of them. Whole texts are read once, without a
    shuffle. `predicted` is 1 from a score of `threshold`.

    Null or empty text: a text without words, scored like others of that shape. Null keys and
    repeated rows are rows like others; a null id counts as held out. Without positives or
    without unlabelled rows nothing can be learned and all score 0. An empty table gives an
    empty one. Other columns are not read.
    """
    texts = df.select(
        F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")
    )
    types = ", ".join(f"{name} double" for name in FEATURES)
    shapes = cut(texts.mapInArrow(_shaped, f"id long, {types}"))
    trusted = (
        labels.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"))
        .filter("id is not null and label = 1")
        .filter(~held_out(F.col("id")))
        .select("id")
        .distinct()
    )
    learnable = shapes.filter(~held_out(F.col("id")))
    chosen = hash_sample(trusted, "id", fit_positives)
    # one row for each chosen id: bounded by the labelled sample
    found = (
        learnable.join(F.broadcast(chosen), "id", "left_semi")
        .groupBy("id")
        .agg(*[F.avg(name).alias(name) for name in FEATURES])
        .orderBy("id")
        .toPandas()
    )
    positive = found[list(FEATURES)].to_numpy(np.float64)
    unlabelled = cut(learnable.join(trusted, "id", "left_anti").select(*FEATURES))
    at = F.array(*[F.lit(q) for q in QUANTILES])
    quantiles = unlabelled.agg(
        *[F.percentile_approx(name, at, F.lit(2000)).alias(name) for name in FEATURES]
    ).first()
    scored = shapes.select("id", F.lit(0.0).alias("score"))
    if len(positive) and quantiles[0]:
        cuts = np.array([quantiles[name] for name in FEATURES], np.float64)
        w, _ = fit_quality(expanded(positive, cuts), sums_over(unlabelled, cuts))
        scored = shapes.mapInArrow(_scored(cuts, w), "id long, score double")
    return scored.select(
        F.col("id").alias(key),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
