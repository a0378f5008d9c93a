"""Count and sample tables in tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import InvalidInput, check_ids
from .lines import in_file_order, read_text


def read_counts(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """A samples x proteins table as long `(sample_id, protein_id, value)` rows.

    The header is read as data and paired with cells by position: names keep
    their dots and case, and a repeated name is an error instead of a silent
    rename. Zeros are kept, since a listed protein needs a vector. A table may lie in
    several files; each has the header.
    """
    lines = in_file_order(read_text(spark, path, "Count table")).select(
        "ord", "opens", "value", F.split("value", "\t", -1).alias("cells")
    )
    header = lines.filter("ord = 0").select(
        F.posexplode("cells").alias("at", "protein_id")
    ).filter("at > 0")
    rows = lines.filter("not opens").filter(F.size("cells") > 1)
    cells = rows.select(
        F.element_at("cells", 1).alias("sample_id"),
        F.posexplode("cells").alias("at", "text"),
    ).filter("at > 0")
    long = cells.join(header, "at").select(
        "sample_id", "protein_id", F.expr("try_cast(text AS DOUBLE)").alias("value")
    )
    if validate:
        if lines.filter("opens").select("value").distinct().count() > 1:
            raise InvalidInput("every file of the count table needs the same header")
        check_ids(header, "protein_id", "Protein")
        check_ids(rows.select(F.element_at("cells", 1).alias("s")), "s", "Sample")
        if long.filter(F.col("value").isNull()).limit(1).count():
            raise InvalidInput("`counts` must be numeric and finite.")
        ragged = rows.select(F.size("cells").alias("n")).agg(F.min("n"), F.max("n"))
        low, high = ragged.first()
        if low is not None and (low != high or low != header.count() + 1):
            raise InvalidInput("every row of the count table needs one cell per column")
    return long


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """One row per sample with its metadata, and `ord`, its place in the file or files.

    The first column names the sample and is returned as `sample_id`.
    """
    table = spark.read.csv(path, sep="\t", header=True)
    first = table.columns[0]
    named = in_file_order(table).drop("file", "opens").withColumnRenamed(first, "sample_id")
    check_ids(named, "sample_id", "Sample")
    return named


def write_counts(counts: DataFrame, path: str) -> None:
    """Long counts as tab-separated `sample_id, protein_id, value` text."""
    counts.select("sample_id", "protein_id", "value").write.csv(
        path, sep="\t", header=True
    )
