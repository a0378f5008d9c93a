"""Toxicity from a lexicon trie met by a Levenshtein automaton, read in context."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import by_slices, hash_sample, held_out, text_slices

# labelled rows of each label that lexicon and weights are learned from, at most
FIT_ROWS = 10_000
# a term is in so many fitted toxic documents at least, and in this share of them
LEAST_DOCUMENTS, LEAST_SHARE = 5, 0.01
LEAST_LOG_ODDS = 4.0
LEXICON = 500
# stems are the first letters of longer words; misspellings are sought for longer terms only
STEM_LETTERS = (4, 5)
FUZZY_LETTERS = 5
# a misspelled term counts so much of its weight
MISSPELLED = 0.5
WINDOW = 5
RIDGE = 0.1
_WORDS = re.compile(r"[^\W_]+")
_QUOTES = re.compile(
    r'"[^"\n]{1,400}"|“[^”]{1,400}”|„[^“”]{1,400}[“”]|«[^»]{1,400}»|(?m:^\s*>.*$)'
)
# fixed values: words that report speech, and words that address or point
REPORTING = frozenset(
    "said says say saying called calls call wrote writes word words term phrase quote quoted "
    "quotes insult insults slur slurs sagte nannte wort dit appelle mot dijo llama palabra".split()
)
DIRECTED = frozenset(
    "you your yours u ur youre this that these those du dein deine ihr euch tu ton ta vous votre "
    "ce cet cette usted tu eres este esta".split()
)
FEATURES = ("abuse", "quoted", "directed", "density")
_FEATURE_TYPES = ", ".join(f"{name} double" for name in FEATURES)


class Automaton:
    """Words within one edit of a lexicon's terms, by a lazily determinised product.

    A state is a set of (trie node, edits). Reading a letter follows the trie (match),
    any child with one more edit (replaced letter) or stays with one more edit (extra
    letter); a child may also be entered unread (missing letter). Sets met once are numbered
    and their transitions kept, so a word costs one lookup per letter and most words end
    after a few. A term that ends in "*" is a stem: it matches exactly, whatever follows.
    """

    def __init__(self, weights: dict[str, float]):
        self._children: list[dict[str, int]] = [{}]
        self._weight: list[float] = [0.0]
        self._stem: list[bool] = [False]
        # ends of terms that may be misspelled, and nodes with such an end below
        self._long: list[bool] = [False]
        self._fuzzy: list[bool] = [False]
        for term, weight in weights.items():
            self._add(term.rstrip("*"), term.endswith("*"), weight)
        self._numbers: dict[frozenset, int] = {frozenset(): 0}
        self._sets: list[frozenset] = [frozenset()]
        self._steps: list[dict[str, int]] = [{}]
        self._start = self._number(self._closed({(0, 0)}))

    def _add(self, letters: str, stem: bool, weight: float) -> None:
        fuzzy = not stem and len(letters) >= FUZZY_LETTERS
        node = 0
        self._fuzzy[0] |= fuzzy
        for letter in letters:
            nxt = self._children[node].get(letter)
            if nxt is None:
                nxt = len(self._children)
                self._children[node][letter] = nxt
                self._children.append({})
                self._weight.append(0.0)
                self._stem.append(False)
                self._long.append(False)
                self._fuzzy.append(False)
            node = nxt
            self._fuzzy[node] |= fuzzy
        if weight > self._weight[node]:
            self._weight[node] = weight
        self._stem[node] |= stem
        self._long[node] |= fuzzy

    def _closed(self, places: set[tuple[int, int]]) -> frozenset:
        """With missing letters entered; places one edit off need a longer term below."""
        missing = {
            (child, 1)
            for node, edits in places
            if edits == 0
            for child in self._children[node].values()
        }
        places = places | missing
        exact = {node for node, edits in places if edits == 0}
        return frozenset(
            (node, edits)
            for node, edits in places
            if edits == 0 or (self._fuzzy[node] and node not in exact)
        )

    def _number(self, places: frozenset) -> int:
        if places not in self._numbers:
            self._numbers[places] = len(self._sets)
            self._sets.append(places)
            self._steps.append({})
        return self._numbers[places]

    def _step(self, state: int, letter: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, edits in self._sets[state]:
            child = self._children[node].get(letter)
            if child is not None:
                after.add((child, edits))
            if edits == 0:
                after.add((node, 1))
                after.update((other, 1) for other in self._children[node].values())
        number = self._number(self._closed(after))
        if len(self._steps[state]) < 4096:  # letters are bounded, but not by this class
            self._steps[state][letter] = number
        return number

    def find(self, word: str) -> tuple[int, float] | None:
        """Edits and weight of the best term that the word matches, fewest edits first."""
        state = self._start
        best: tuple[int, float] | None = None
        steps = self._steps
        for letter in word:
            nxt = steps[state].get(letter)
            if nxt is None:
                nxt = self._step(state, letter)
            state = nxt
            if not state:
                return best
            for node, edits in self._sets[state]:
                if edits == 0 and self._stem[node]:
                    if best is None or self._weight[node] > best[1]:
                        best = (0, self._weight[node])
        for node, edits in self._sets[state]:
            weight = self._weight[node]
            if not weight or (edits and not self._long[node]):
                continue
            if best is None or (edits, -weight) < (best[0], -best[1]):
                best = (edits, weight)
        return best


def context_features(
    text: str, automaton: Automaton, ordinary: frozenset[str] = frozenset()
) -> tuple[float, ...]:
    """Sums over the hits of a text, dampened: abuse, quoted, directed, density.

    A word one edit off a term is a misspelling unless clean documents use it (`ordinary`).

    A hit inside quotation marks or a quoted line, or with a reporting word near it, counts as
    quoted and as nothing else; a hit near a word that addresses or points is directed too.
    """
    text = text.lower()
    words = _WORDS.findall(text)
    hits = {
        w: found[1] * (MISSPELLED if found[0] else 1)
        for w in set(words)
        if (found := automaton.find(w)) is not None and w not in ordinary
    }
    if not hits:
        return (0.0,) * len(FEATURES)
    spans = [m.span() for m in _QUOTES.finditer(text)]
    sums = [0.0] * 3
    count = span = 0
    for k, m in enumerate(_WORDS.finditer(text)):
        weight = hits.get(m[0])
        if weight is None:
            continue
        while span < len(spans) and spans[span][1] <= m.start():
            span += 1
        near = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
        inside = span < len(spans) and spans[span][0] <= m.start()
        if inside or not REPORTING.isdisjoint(near):
            sums[1] += weight
            continue
        sums[0] += weight
        sums[2] += not DIRECTED.isdisjoint(near)
        count += 1
    return (*np.log1p(sums).tolist(), 100 * count / len(words))


def _terms(text: str) -> set[str]:
    words = set(_WORDS.findall(text.lower()))
    return words | {f"{w[:n]}*" for n in STEM_LETTERS for w in words if len(w) > n}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        labels = batch.column("label").to_pylist()
        for at, texts in text_slices(batch):
            for label, text in zip(labels[at:], texts):
                counts[label].update(_terms(text.decode()))
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(terms, pa.string()),
                pa.array([counts[1][t] for t in terms], pa.int64()),
                pa.array([counts[0][t] for t in terms], pa.int64()),
            ],
            ["term", "toxic", "clean"],
        )


def _near(
    weights: dict[str, float],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words of clean documents that are one edit off a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(weights)

        def near(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            words = {w for text in texts for w in _WORDS.findall(text.decode().lower())}
            found = [w for w in words if (hit := automaton.find(w)) and hit[0]]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["word"])

        return by_slices(batches, near)

    return run


def _measured(
    weights: dict[str, float], ordinary: frozenset[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(weights)

        def measure(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            rows = [context_features(text.decode(), automaton, ordinary) for text in texts]
            return pa.RecordBatch.from_arrays(
                [batch.column("id")]
                + [
                    pa.array([row[k] for row in rows], pa.float64())
                    for k in range(len(FEATURES))
                ],
                ["id", *FEATURES],
            )

        return by_slices(batches, measure)

    return run


def fitted_rows(labels: DataFrame, key: str, label: str, most: int = FIT_ROWS) -> DataFrame:
    """`(id, label)`: up to `most` labelled rows of each label outside the held-out fold.

    Those with the smallest id hashes; of an id's several labels the largest.
    """
    rows = (
        labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .filter(~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    parts = [
        hash_sample(rows.filter(F.col("label") == value), "id", most) for value in (0, 1)
    ]
    return cut(parts[0].unionByName(parts[1]))


def learn_lexicon(texts: DataFrame, fit: DataFrame) -> dict[str, float]:
    """Terms and stems with their log odds of being in toxic rather than clean documents."""
    sizes = {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    # at most two times FIT_ROWS rows
    labelled = texts.join(F.broadcast(fit), "id")
    counts = (
        labelled.select("text", "label")
        .mapInArrow(_counted, "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log(
        (F.col("clean") + 0.5) / (clean + 1)
    )
    kept = (
        counts.filter(F.col("toxic") >= max(LEAST_DOCUMENTS, LEAST_SHARE * toxic))
        .withColumn("odds", odds)
        .filter(F.col("odds") >= LEAST_LOG_ODDS)
        .orderBy(F.desc("odds"), "term")
        .limit(LEXICON)
    )
    return {row["term"]: row["odds"] for row in kept.collect()}


def fit_logistic(
    x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 100
) -> np.ndarray:
    """Weights of a ridge logistic regression with intercept last, by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            return w
    raise RuntimeError("The logistic fit did not converge.")


def toxicity_scores(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """`(key, held_out, score, predicted, *FEATURES)` for every row of `df`.

    The lexicon and the weights of the context features are learned from at most `fit_rows`
    labelled rows of each label, none of the held-out fold. Every whole text is then read
    once, without a shuffle. `predicted` is 1 from a score of 0.5.

    Null or empty text: no hits, so the score of the intercept. Null keys and repeated rows are
    rows like others; a null id counts as held out. Null labels, labels other than 0 and 1
    and labels of unknown ids are not used. If one label has no rows, nothing can be
    learned and all score 0. An empty table gives an empty one. Other columns are not read.
    """
    texts = df.select(
        F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")
    )
    fit = fitted_rows(labels, key, label, fit_rows)
    weights = learn_lexicon(texts, fit)
    clean = texts.join(F.broadcast(fit.filter("label = 0")), "id").select("text")
    # bounded by the lexicon: one edit of its terms
    near = clean.mapInArrow(_near(weights), "word string").distinct().collect()
    ordinary = frozenset(row["word"] for row in near)
    features = cut(texts.mapInArrow(_measured(weights, ordinary), f"id long, {_FEATURE_TYPES}"))
    # one row for each fitted id, however many rows repeat it; a repeated id counts by its means
    learned = (
        features.join(F.broadcast(fit), "id")
        .groupBy("id")
        .agg(F.first("label").alias("label"), *[F.avg(name).alias(name) for name in FEATURES])
        .toPandas()
    )
    if learned["label"].nunique() == 2:
        w = fit_logistic(learned[list(FEATURES)].to_numpy(), learned["label"].to_numpy())
        z = F.lit(float(w[-1]))
        for name, value in zip(FEATURES, w):
            z = z + F.col(name) * float(value)
        score = 1 / (1 + F.exp(-z))
    else:
        score = F.lit(0.0)
    return features.select(
        F.col("id").alias(key),
        held_out(F.col("id")).alias("held_out"),
        score.alias("score"),
        *FEATURES,
    ).select(
        key, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES
    )
