"""Pipeline stages: each applies one operator to every document it is given.

All but the last return the columns they were given, in rows that the operator kept.
A stage decides by `doc_id`: rows that share an id share its fate, and rows without an id,
which no decision can name, stay (the mixing stage treats them as one document).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .decontam import leaks
from .mixing import mix_sources
from .neardup import near_duplicates
from .sharding import ring_shards
from .toxicity import toxicity_scores


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Documents whose id is not in `rejected`, a table that is usually small."""
    gone = cut(rejected.select(F.col("doc_id").alias("_id")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not predict to be toxic."""
    scores = toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scores.filter("predicted = 1"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    If that id has several rows, the smallest of them by all columns.
    """
    found = near_duplicates(docs.select("doc_id", "text"))
    kept = _without(docs, found.filter("doc_id is not null and not kept"))
    several = cut(
        docs.filter("doc_id is not null")
        .groupBy(F.col("doc_id").alias("_id"))
        .count()
        .filter("count > 1")
        .select("_id")
    )
    if several.isEmpty():
        return kept
    repeated = kept.join(several, kept["doc_id"] == several["_id"], "left_semi")
    first = (
        repeated.groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("_row"))
        .select("_row.*")
    )
    single = kept.join(several, kept["doc_id"] == several["_id"], "left_anti")
    return single.unionByName(first)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, leaks(docs, benchmark))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target shares of words."""
    copies = mix_sources(docs).select(F.col("doc_id").alias("_id"), F.col("copies").alias("_n"))
    copies = copies.groupBy("_id").agg(F.max("_n").alias("_n")).filter("_n > 0")
    spare = "_copy"
    while spare in docs.columns:
        spare += "_"
    return (
        docs.join(copies, docs["doc_id"].eqNullSafe(copies["_id"]))
        .select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), copies["_n"])).alias(spare))
        .drop(spare)
    )


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and its place there."""
    return ring_shards(docs)
