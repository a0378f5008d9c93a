"""Global ranks and running values without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def sorted_slices(df: DataFrame, *order) -> DataFrame:
    """Range-partition and sort by `order`; adds `_slice` and the row's `_at` in it.

    The result is materialised: the range boundaries come from sampling, so a
    recomputed slice could otherwise disagree with the offsets derived from it.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_mid", 33))
        .withColumn("_at", F.col("_mid") - F.shiftleft(F.col("_slice"), 33))
        .drop("_mid")
    )
    return cut(placed)


def slice_offsets(sliced: DataFrame) -> DataFrame:
    """Rows before each slice: one row per partition, so the window stays tiny."""
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )


def global_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """1-based position of every row in the total order `order`."""
    sliced = sorted_slices(df, *order)
    # one row per partition: bounded by the number of partitions
    return (
        sliced.join(F.broadcast(slice_offsets(sliced)), "_slice")
        .withColumn(name, F.col("_before") + F.col("_at") + 1)
        .drop("_slice", "_at", "_before")
    )
