"""Operators that read each text for itself: tokens, toxicity, quality."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_tables import awkward, nothing, prose
from tokenizers import Tokenizer

from vectide.llm.quality import (
    FEATURES,
    QUANTILES,
    RIDGE,
    estimate_prior,
    expanded,
    fit_risk,
    quality_scores,
    sums_over,
)
from vectide.llm.tokens import TokenCounter, token_counts
from vectide.llm.toxicity import Automaton, context_features, toxicity_scores

PATH = public_tokenizers.path("byte_bpe_50k.json")


def awkward_texts():
    rng = random.Random(5)
    kinds = [
        lambda: chr(rng.randrange(32, 127)),
        lambda: chr(rng.randrange(160, 0x600)),
        lambda: chr(rng.randrange(0x3000, 0x9FFF)),
        lambda: chr(rng.randrange(0x1F300, 0x1F700)),
        lambda: rng.choice(" \n\t  \x1c\x85"),
    ]
    texts = ["".join(rng.choice(kinds)() for _ in range(rng.randrange(120))) for _ in range(300)]
    return texts + [
        "",
        "a" * 1001,
        "don't we'll 'S I'd",
        "x<|endoftext|><|endoftext|> y <|endoftext",
        "!" * 77 + " " * 55 + "\t\n",
        "abababababab" * 50,
    ]


def test_counts_are_the_librarys(monkeypatch):
    library = Tokenizer.from_file(PATH)
    texts = awkward_texts()
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert TokenCounter(PATH).counts(texts) == want
    import vectide.llm.tokens as tokens

    # blocks and forgetting change nothing
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 50)
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", 7)
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    assert TokenCounter(PATH).counts(texts) == want


def test_texts_without_spaces_merge_in_time(monkeypatch):
    """Long pre-tokens count as the library does, and time grows nearly with their length."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    long = [
        "".join(rng.choice(letters) for _ in range(200_000)),
        "x" * 50_001,
        "theinternationalization" * 2000,
        "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(20_000)),
    ]
    library, counter = Tokenizer.from_file(PATH), TokenCounter(PATH)
    start = time.process_time()
    got = counter.counts(long)
    assert time.process_time() - start < 5
    assert got == [len(e.ids) for e in library.encode_batch(long, add_special_tokens=False)]
    # the same merges for short sequences, overlapping pairs among them
    monkeypatch.setattr("vectide.llm.tokens.LONG", 1)
    texts = ["".join(rng.choice("abeht é漢x") for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += ["a" * k for k in range(60)] + awkward_texts()
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert TokenCounter(PATH).counts(texts) == want


def test_token_counts_of_awkward_rows(spark):
    docs = awkward(spark)
    library = Tokenizer.from_file(PATH)
    want = sorted(
        (str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "").ids))
        for r in docs.collect()
    )
    rows = token_counts(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert token_counts(nothing(spark), PATH).collect() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_agrees_with_brute_force():
    rng = random.Random(2)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 8))) for _ in range(40)}
    weights = {t: 1 + rng.random() for t in terms}
    automaton = Automaton(weights)
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
        fits = [(edits(word, t), -w) for t, w in weights.items() if edits(word, t) <= (len(t) >= 5)]
        best = min(fits, default=None)
        assert automaton.find(word) == (best and (best[0], -best[1]))
    stems = Automaton({"lowe*": 2.0})
    assert stems.find("loweichen") == (0, 2.0) and stems.find("lowe") == (0, 2.0)
    assert stems.find("lowi") is None


def test_context_separates_quotation_from_abuse():
    automaton = Automaton({"idiot": 9.0})
    names = ("abuse", "quoted", "directed", "density")
    def read(text):
        return dict(zip(names, context_features(text, automaton)))

    abuse, slip = read("you are an idiot"), read("you are an idiott")
    assert abuse["abuse"] > slip["abuse"] > 0 and abuse["directed"] > 0
    for text in ('the film "idiot and fool" ran long', "> you idiot", "he said idiot aloud"):
        assert read(text)["abuse"] == 0 and read(text)["quoted"] > 0
    assert not any(read("a clean text").values()) and not any(read("").values())
    assert not any(context_features("an idiott", automaton, frozenset({"idiott"})))


def labelled(spark, count=400):
    """Toxic rows hold an abusive word, low quality rows a run of one word."""
    docs, labels = [], []
    for k in range(count):
        text = prose(k, 60)
        toxic, good = k % 5 == 0, k % 4 != 1
        if toxic:
            text += " you " + ("blargh " if k % 2 else "snorfel ") * 2
        if not good:
            text += " " + "spam " * 60
        docs.append((k, text))
        labels.append((k, int(good), int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def accuracy(rows, want):
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {k for k in want if zlib.crc32(str(k).encode()) % 5 == 0}
    return np.mean([r.predicted == want[r.doc_id] for r in held])


def test_toxicity_of_unseen_rows(spark):
    docs, labels = labelled(spark)
    rows = toxicity_scores(docs, labels).collect()
    assert accuracy(rows, {r.doc_id: r.toxic for r in labels.collect()}) > 0.97
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_of_unseen_rows(spark):
    docs, labels = labelled(spark)
    # a third of the positives is not labelled: the unlabelled hold good documents too
    labels = labels.filter("doc_id % 3 != 0")
    want = {k: int(k % 4 != 1) for k in range(400)}
    rows = quality_scores(docs, labels).collect()
    assert accuracy(rows, want) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_are_not_used(spark):
    docs, labels = labelled(spark, 120)
    flipped = labels.selectExpr(
        "doc_id",
        "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality",
        "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic",
    )
    for scores in (toxicity_scores, quality_scores):
        one = {r.doc_id: r.score for r in scores(docs, labels).collect()}
        assert one == {r.doc_id: r.score for r in scores(docs, flipped).collect()}


def test_prior_is_found():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 4000)
    mixed = np.concatenate([rng.normal(2, 1, 3000), rng.normal(-2, 1, 7000)])
    shares = lambda at: np.array([(mixed >= t).mean() for t in at])
    assert estimate_prior(positive, shares) == pytest.approx(0.3, abs=0.04)


def test_risk_is_minimised_over_all_rows(spark):
    """Sums on Spark are those of all rows, and no small change of the weights lowers the risk."""
    rng = np.random.default_rng(2)
    rows = rng.normal(0, 1, (3000, len(FEATURES)))
    rows[:1200, :4] += 1.5
    good = rows[:900]
    cuts = np.quantile(rows, QUANTILES, axis=0).T
    table = spark.createDataFrame(rows.tolist(), ", ".join(f"{f} double" for f in FEATURES))
    sums = sums_over(table.repartition(7), cuts)
    x, p = expanded(rows, cuts), expanded(good, cuts)
    assert np.allclose(sums(lambda x: x.sum(axis=0)), x.sum(axis=0))

    def risk(w, prior=0.4):
        other = np.logaddexp(0, x @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        return prior * np.logaddexp(0, -(p @ w)).mean() + other + RIDGE / 2 * w @ w, other

    w = fit_risk(p, sums, 0.4, np.zeros(x.shape[1]))
    least, part = risk(w)
    assert least < risk(np.zeros(len(w)))[0]
    # no small change lowers it by more than the last halving leaves open
    for _ in range(50):
        other, at = risk(w + rng.normal(0, 0.02, len(w)))
        assert min(part, at) < 0 or other > least - 2e-3


def test_one_hot_id_does_not_fill_the_sample(spark):
    """An id on most rows is one id of the sample, and its rows do not reach the driver."""
    docs, labels = labelled(spark, 200)
    hot = docs.limit(1).select("text").crossJoin(spark.range(3000)).selectExpr("5L as doc_id", "text")
    docs = docs.select("doc_id", "text").unionByName(hot)
    for scores, column in ((toxicity_scores, "toxic"), (quality_scores, "quality")):
        rows = scores(docs, labels).collect()
        assert len(rows) == 3200
        want = {r.doc_id: r[column] for r in labels.collect()}
        right = [r.predicted == want[r.doc_id] for r in rows if r.doc_id != 5 and r.doc_id in want]
        assert np.mean(right) > 0.9


@pytest.mark.parametrize("scores", [toxicity_scores, quality_scores])
def test_scores_of_awkward_rows(spark, scores):
    docs = awkward(spark)
    labels = spark.createDataFrame(
        [(0, 1, 1), (0, 0, 0), (5, None, None), (None, 1, 1), (77, 1, 1), (6, 0, 0), (4, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    rows = scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert scores(nothing(spark), labels).collect() == []
    unlabelled = scores(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in unlabelled} == {(0.0, 0)}
