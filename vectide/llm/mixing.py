"""Mixing sources to target weights by cutting hash-ordered running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import WORD, hash60, ordered_parts, running_total

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
_WIDE = "decimal(38,0)"


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS
) -> DataFrame:
    """Adds `target` to `(source, source_size)`, one row per source.

    Sources in code point order, null last, take the weights in turn. Together they
    share all words; a target stops at `most_epochs` times its source, and the excess goes to
    the others by weight until none is above. That is the level at which the sum of
    min(limit, level x weight) is the whole: sources sorted by limit / weight are full up
    to some place, and running sums find it. Ranks and sums are distributed, so there may be as many
    sources as documents.
    """
    one = F.lit(1).cast("long")
    named = [F.col("source").asc_nulls_last()]
    parts = ordered_parts(sizes.withColumn("_one", one), *named)
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = (
        running_total(parts, [], named, "_one", "_rank")
        .drop("_part", "_one")
        .withColumn("_weight", F.get(turn, F.col("_rank") % len(weights)))
        .withColumn("_limit", F.col("source_size") * most_epochs)
        .withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    )
    by_ratio = [F.col("_ratio"), F.col("_rank")]
    parts = ordered_parts(ranked, *by_ratio)
    summed = running_total(parts, [], by_ratio, "_limit", "_full")
    summed = cut(running_total(summed, [], by_ratio, "_weight", "_before").drop("_part"))
    whole = summed.agg(F.sum("source_size").alias("words"), F.sum("_weight").alias("weights")).first()
    left = F.lit(whole["words"] or 0).cast("long") - F.col("_full")
    rest = F.lit(whole["weights"] or 0).cast("long") - F.col("_before")
    fits = F.col("_limit").cast(_WIDE) * rest >= F.col("_weight").cast(_WIDE) * left
    # the first source that stays under its limit, and what is left from there on
    level = (
        summed.filter(fits)
        .agg(F.min(F.struct("_ratio", "_rank", left.alias("left"), rest.alias("rest"))).alias("l"))
        .first()["l"]
    )
    if level is None:
        return summed.select("source", "source_size", F.col("_limit").cast("double").alias("target"))
    below = F.struct("_ratio", "_rank") < F.struct(
        F.lit(level["_ratio"]).alias("_ratio"), F.lit(level["_rank"]).cast("long").alias("_rank")
    )
    share = (F.col("_weight") * F.lit(level["left"]).cast("long")).cast("double") / F.lit(
        level["rest"]
    ).cast("double")
    return summed.select(
        "source",
        "source_size",
        F.when(below, F.col("_limit").cast("double")).otherwise(share).alias("target"),
    )


def mix_sources(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """`(key, source, size, source_size, target, taken, copies)` for every row of `df`.

    Rows get a hash-random order within their source, a range sort and running word counts
    place each on its source's line of words, and the line is cut at the budget, the
    target's whole part: every full epoch takes all words, the last one those before the cut.
    `taken` counts a row's words over all epochs; the row at the cut gives the part
    before it, so a source's taken words are its budget exactly. `copies` is the same
    decision in whole rows: the row at the cut counts if at least half lies before it; a row
    without words costs nothing and is kept once.

    Null or empty text: size 0. A null source is a source of its own. Null keys and
    repeated rows are rows like others (ties in the order: by key, then by size). An empty
    table gives an empty one. Other columns are not read. The sources' table, one row per
    source, is the only thing handled in one task.
    """
    rows = cut(
        df.select(
            F.col(key).alias("_key"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0))
            .cast("long")
            .alias("size"),
            hash60(F.col(key)).alias("_hash"),
        )
    )
    order = [F.col("_hash"), F.col("_key"), F.col("size")]
    parts = ordered_parts(rows, F.col("source").asc_nulls_last(), *order)
    sizes = parts.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, most_epochs)).select(
        F.col("source").alias("_s"), "source_size", "target"
    )
    # the targets travel by part and source, so a large source meets them in all its parts
    spread = parts.select("_part", "source").distinct()
    spread = spread.join(targets, spread["source"].eqNullSafe(targets["_s"])).select(
        F.col("_part").alias("_p"), "_s", "source_size", "target"
    )
    placed = running_total(parts, ["source"], order, "size", "_before")
    whole, rest = F.col("_whole"), F.col("_rest")
    size, before = F.col("size"), F.col("_before")
    extra = F.least(F.greatest(rest - before, F.lit(0)), size)
    counted = whole + (before * 2 + size <= rest * 2).cast("long")
    return (
        placed.join(
            spread,
            (placed["_part"] == spread["_p"]) & placed["source"].eqNullSafe(spread["_s"]),
        )
        .withColumn("_budget", F.floor("target"))
        .withColumn(
            "_whole",
            F.when(
                F.col("source_size") > 0, F.expr("_budget div source_size")
            ).otherwise(0),
        )
        .withColumn("_rest", F.col("_budget") - F.col("_whole") * F.col("source_size"))
        .select(
            F.col("_key").alias(key),
            "source",
            "size",
            "source_size",
            "target",
            (whole * size + extra).cast("long").alias("taken"),
            F.when(size == 0, 1).otherwise(counted).cast("int").alias("copies"),
        )
    )
