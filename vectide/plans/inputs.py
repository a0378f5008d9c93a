"""The driver's tables seen as catalogs, counts, samples and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..operators.checks import RESIDUES


class Inputs:
    """Lazy views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def vectors(self) -> DataFrame:
        """Catalog of every stored vector; `vec_id` is both name and order."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("ord"),
            F.col("vec_id").alias("protein_id"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            F.col("label").alias("family"),
        )

    def units(self) -> DataFrame:
        return self.vectors().select(
            "ord",
            "protein_id",
            unit(F.col("embedding"), F.col("protein_id")).alias("embedding"),
        )

    def samples(self) -> DataFrame:
        """Nations are samples, their regions the groups."""
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
            F.col("n_name").alias("sample_id"),
            F.col("n_nationkey").cast("long").alias("ord"),
            F.col("r_name").alias("group"),
        )

    def counts(self) -> DataFrame:
        """Quantity sold to each nation, parts folded onto the vectors."""
        size = self.table("embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()
        line = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_name")
        # the lines are the longest table: they are shuffled for one join only
        sold_to = (
            orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("o_orderkey", "n_name")
        )
        return (
            line.join(sold_to, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(
                F.col("n_name").alias("sample_id"),
                (F.col("l_partkey") % size).alias("protein_id"),
            )
            .agg(F.sum("l_quantity").alias("value"))
        )

    def membership(self) -> DataFrame:
        """Stored labels as bins, for exact checks of what follows clustering."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("ord"),
            F.col("vec_id").alias("protein_id"),
            F.concat(F.lit("bin"), (F.col("label") + 1).cast("string")).alias("bin"),
        )

    def texts(self, table: str = "documents", key: str = "doc_id") -> DataFrame:
        """Whole texts read as residue sequences: other characters removed."""
        # removed first: some characters change length when upper-cased
        keep = RESIDUES + RESIDUES.lower()
        letters = F.upper(F.regexp_replace("text", f"[^{keep}]", ""))
        return (
            self.table(table)
            .select(
                F.col(key).alias("ord"),
                F.col(key).alias("protein_id"),
                letters.alias("sequence"),
            )
            .filter(F.col("sequence") != "")
        )

    def passages(self) -> DataFrame:
        """Benchmark passages that have a vector: sequence and embedding."""
        return self.texts("benchmark", "item_id").join(
            self.vectors().select("protein_id", "embedding"), "protein_id"
        )
