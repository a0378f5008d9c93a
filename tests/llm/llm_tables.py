"""Small tables with everything that may go wrong in a row."""

CLASHING = "size long, shard int, _part int, id string, node long, score double, key string"
_CLASH = (7, 3, 1, "x", 9, 0.5, "k")


def awkward(spark, texts=(), lang="en"):
    """Documents with null ids, texts and sources, repeats, blanks and a very long text."""
    long_text = " ".join(f"word{k % 977}x" for k in range(30_000))
    rows = [
        (0, "the quick brown fox jumps over the lazy dog", "a"),
        (0, "the quick brown fox jumps over the lazy dog", "a"),
        (1, None, "a"),
        (2, "", None),
        (3, " \t\n ", None),
        (None, "the quick brown fox jumps over the lazy dog", "b"),
        (None, None, "b"),
        (4, long_text, "b"),
        (5, "five", "c"),
        (6, "the quick brown fox jumps over the lazy dog", "c"),
        (7, "Été à Paris   naïve 漢字 😀", None),
    ]
    rows += [(100 + k, text, f"s{k % 3}") for k, text in enumerate(texts)]
    return spark.createDataFrame(
        [(*row, lang, *_CLASH) for row in rows],
        f"doc_id long, text string, source string, lang string, {CLASHING}",
    )


def nothing(spark, schema="doc_id long, text string, source string, lang string"):
    return spark.createDataFrame([], schema)


def prose(seed, words, vocabulary=400):
    import random

    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))
