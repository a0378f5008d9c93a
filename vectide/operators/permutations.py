"""Permutations of samples as a table: ranks of hashes, which any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import InvalidInput


def check_design(samples: DataFrame, group: str, block: str | None) -> DataFrame:
    """`(sample_id, group, block)`, one complete row for each sample."""
    stratum = F.col(block).cast("string") if block else F.lit("")
    design = samples.select(
        F.col("sample_id").cast("string").alias("sample_id"),
        F.col(group).cast("string").alias("group"),
        stratum.alias("block"),
    )
    gaps = design.filter("sample_id is null or `group` is null or block is null")
    twice = design.groupBy("sample_id").count().filter("count > 1")
    if not gaps.isEmpty() or not twice.isEmpty():
        raise InvalidInput("The design must give one label per sample.")
    return design


def group_shape(design: DataFrame, test: str) -> tuple[int, int]:
    """Samples and groups; a test needs two groups and more samples than groups."""
    row = design.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group").alias("a")).first()
    if row["a"] < 2 or row["n"] <= row["a"]:
        raise InvalidInput(f"{test} needs two groups and more samples than groups.")
    return row["n"], row["a"]


def draw_key(seed: int, perm: Column, sample: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed), perm, sample).cast("binary"))


def permuted(design: DataFrame, value: str, permutations: int, seed: int) -> DataFrame:
    """`(perm, sample_id, value)` for permutations 1 to `permutations`.

    Within a `block` the samples of a permutation are ordered by
    `md5(seed-permutation-sample)`; the k-th of them takes the value of the k-th sample by name.
    One permutation of one block is sorted in a task: a value for each sample.
    """
    place = lambda *by: F.row_number().over(
        Window.partitionBy(*by[:-1]).orderBy(by[-1], "sample_id")
    )
    base = design.select("block", place("block", "sample_id").alias("_at"), F.col(value).alias(value))
    drawn = (
        design.select(
            "block", "sample_id", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm")
        )
        .withColumn("_key", draw_key(seed, F.col("perm"), F.col("sample_id")))
        .withColumn("_at", place("perm", "block", "_key"))
    )
    return drawn.join(base, ["block", "_at"]).select("perm", "sample_id", value)
