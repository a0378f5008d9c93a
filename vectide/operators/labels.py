"""Colour labels: the most frequent keep their name, the rest are pooled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP_LABELS = 12


def top_labels(labels: DataFrame, top: int = TOP_LABELS) -> DataFrame:
    """`(label, n)` of the `top` most frequent labels, ties by name."""
    return (
        labels.filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("label"))
        .limit(top)
    )


def pooled_labels(proteins: DataFrame, labels: DataFrame, top: int = TOP_LABELS):
    """`(protein_id, label, layer)`: 'other' beyond the top, NULL without a label.

    `layer` is the drawing order: unlabelled, other, named.
    """
    known = labels.select("protein_id", F.col("label").cast("string").alias("label"))
    tagged = proteins.select("protein_id").join(known, "protein_id", "left")
    kept = top_labels(tagged, top).select("label", F.lit(True).alias("_kept"))
    # `top` rows
    marked = tagged.join(F.broadcast(kept), "label", "left")
    label = F.when(F.col("label").isNull(), None).when(
        F.col("_kept"), F.col("label")
    ).otherwise(F.lit("other"))
    return marked.select("protein_id", label.alias("label")).withColumn(
        "layer",
        F.when(F.col("label").isNull(), 0).when(F.col("label") == "other", 1).otherwise(2),
    )
