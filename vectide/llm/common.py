"""Helpers the operators share: hashed keys, distributed running totals, lineage cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

# positions are the first 60 bits of an MD5 digest
HASH_BITS = 60
# the only white space that separates words: space, tab, LF, VT, FF, CR
WORD = r"[^\x20\x09-\x0D]+"
# labels may be learned from rows whose remainder is not this fold
HELD_OUT_FOLDS, HELD_OUT = 5, 0


def hash60(value: Column) -> Column:
    """60-bit hash of a string that any SQL engine with MD5 can repeat; null hashes as ''."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from (a null id belongs to it)."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(True))


def hash_sample(rows: DataFrame, key: str, most: int, *ties: str) -> DataFrame:
    """At most `most` rows, those with the smallest hashes of `key`, in that order.

    A first cut at the hash below which so many rows are expected, with a margin of ten
    standard deviations, keeps tasks from sending `most` rows each to the final sort.
    """
    total = rows.count()
    share = min(1.0, (most + 10 * most**0.5 + 10) / max(total, 1))
    place = hash60(F.col(key))
    return (
        rows.filter(place <= int(share * (2**HASH_BITS - 1)))
        .orderBy(place, key, *ties)
        .limit(most)
    )


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ordered_parts(df: DataFrame, *order: Column) -> DataFrame:
    """`df` range-partitioned by `order`, with the partition's number in `_part`, written out.

    Written because `_part` must stay what it was if a task is run again.
    """
    tasks = shuffle_tasks(df.sparkSession)
    return cut(
        df.repartitionByRange(tasks, *order).withColumn("_part", F.spark_partition_id())
    )


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = left["_part"] == right["_r_part"]
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[f"_r_{key}"])
    return condition


def running_total(
    parts: DataFrame,
    keys: list[str],
    order: list[Column],
    value: str,
    out: str,
    largest: bool = False,
) -> DataFrame:
    """Adds `out`: the sum of `value` over all earlier rows of the same `keys`.

    With `largest` their largest value instead, null if there is none. `parts` comes from
    `ordered_parts` on (keys, order). A window runs within one part only; one row per part
    and key carries what came before, so a key that holds most rows is still spread over
    all the parts it spans.
    """
    combine = F.max if largest else F.sum
    within = Window.partitionBy("_part", *keys).orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        parts.groupBy("_part", *keys)
        .agg(combine(value).alias("_sum"))
        .select(
            F.col("_part").alias("_r_part"),
            *[F.col(key).alias(f"_r_{key}") for key in keys],
            combine("_sum").over(earlier).alias("_carried"),
        )
    )
    local = parts.withColumn(out, combine(value).over(before))
    joined = local.join(carried, _same(local, carried, keys))
    if largest:
        total = F.greatest(out, "_carried")
    else:
        total = F.coalesce(out, F.lit(0)) + F.coalesce("_carried", F.lit(0))
    return joined.withColumn(out, total).drop(
        "_r_part", "_carried", *[f"_r_{key}" for key in keys]
    )


def key_bitmap(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits places with the low bits of every `key` set, packed in longs.

    Its size is fixed, whatever the number of keys: with more keys it only lets more
    through. It is a filter before an exact join, never the join itself.
    """
    place = F.col(key).bitwiseAND(F.lit(2**bits - 1))
    words = (
        df.select(
            F.shiftright(place, 6).alias("word"),
            F.expr(f"shiftleft(1L, cast(({key}) & 63 as int))").alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toPandas()
    )
    bitmap = np.zeros(2 ** (bits - 6), np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bit"].to_numpy(np.int64)
    return bitmap


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit `keys` have their bit set."""
    keys = keys.astype(np.int64, copy=False)
    place = keys & np.int64(len(bitmap) * 64 - 1)
    return (bitmap[place >> 6] >> (keys & 63)) & 1 == 1


# bytes of texts that a task handles at a time
SLICE_BYTES = 2**18


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, list[bytes]]]:
    """First row and texts of runs of rows of about SLICE_BYTES; null texts are empty.

    Only the run at hand is copied out of the batch's buffer. A longer text is a run of its own.
    """
    values = batch.column(column)
    _, offsets, data = values.buffers()
    if data is None:
        ends = np.zeros(len(values) + 1, np.int64)
        data = memoryview(b"")
    else:
        width = np.int64 if pa.types.is_large_binary(values.type) else np.int32
        ends = np.frombuffer(offsets, width)[values.offset : values.offset + len(values) + 1]
        data = memoryview(data)
    at = 0
    while at < len(values):
        stop = int(np.searchsorted(ends, int(ends[at]) + SLICE_BYTES))
        stop = min(max(stop, at + 1), len(values))
        places = ends[at : stop + 1].tolist()
        yield at, [bytes(data[a:b]) for a, b in zip(places, places[1:])]
        at = stop


def by_slices(
    batches: Iterator[pa.RecordBatch],
    handle: Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch],
) -> Iterator[pa.RecordBatch]:
    """`handle` of every run of rows with its texts; unused Arrow memory is given back at the end."""
    for batch in batches:
        for at, texts in text_slices(batch):
            yield handle(batch.slice(at, len(texts)), texts)
        del batch
        pa.default_memory_pool().release_unused()
