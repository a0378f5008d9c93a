"""Text in the order of its files, whether they are one, many, or the parts of a folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.checks import InvalidInput


def read_text(spark: SparkSession, path: str, what: str, **options) -> DataFrame:
    """Rows of text under `path`, in any store that Spark reads; a path without files is an error."""
    try:
        return spark.read.text(path, **options)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise InvalidInput(f"{what} not found: {path}") from error


def in_file_order(rows: DataFrame) -> DataFrame:
    """`rows` of a file source with `ord`, `file` and `opens`.

    `ord` numbers all rows from 0: files by path, rows as they stand in their file. `opens` marks the
    first row of each file. Rows of one split of a file are read in order by one task, so a
    row's number is the rows of earlier splits plus its place in its own; only a count for each split
    is sorted, never the rows.
    """
    keyed = rows.select(
        *rows.columns,
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    # one row for each split
    splits = keyed.groupBy("file", "_start").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first")
    )
    earlier = Window.orderBy("file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "file",
        "_start",
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        (F.col("_start") == F.min("_start").over(Window.partitionBy("file"))).alias("_opening"),
    )
    place = F.col("_at") - F.col("_first")
    return keyed.join(splits, ["file", "_start"]).select(
        *rows.columns,
        "file",
        (F.col("_before") + place).alias("ord"),
        (F.col("_opening") & (place == 0)).alias("opens"),
    )
