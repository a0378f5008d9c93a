"""Shards from a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .common import HASH_BITS, hash60, ordered_parts, running_total

VIRTUAL_NODES = 64
# a shard takes at most this many thousandths above the mean
SLACK = 2
# equal texts stay together up to this share of a shard; larger groups are dealt by row
TOGETHER = 10
# the ring is cut into so many equal slices to find a key's arc by an equi-join
SLICES = 4096
ROUNDS_A_WRITE = 4


def ring_arcs(spark: SparkSession, shards: int, virtual_nodes: int) -> DataFrame:
    """`(arc, shard, low, high)`: keys with low < position <= high belong to `shard`.

    A table of shards x virtual_nodes + 1 rows, whatever the data: the last arc leads
    over the end of the ring to the first node.
    """
    nodes = spark.range(0, shards * virtual_nodes, 1, 1).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        hash60(
            F.concat_ws(
                "-", F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)
            )
        ).alias("high"),
    )
    around = Window.orderBy("high", "shard")
    arcs = nodes.select(
        F.row_number().over(around).alias("arc"),
        "shard",
        F.lag("high", 1, -1).over(around).alias("low"),
        "high",
    )
    last = arcs.agg(
        (F.max("arc") + 1).alias("arc"),
        F.min_by("shard", "arc").alias("shard"),
        F.max("high").alias("low"),
        F.lit(2**HASH_BITS - 1).alias("high"),
    )
    return arcs.unionByName(last)


def _round(arcs: DataFrame, shards: int, capacity: int) -> DataFrame:
    """What each arc has left asks the next shard clockwise that is not full.

    Shards accept in ring order until they are full. Every row carries all loads.
    """
    ring = Window.partitionBy(F.lit(0)).orderBy("arc")
    onward = ring.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    asked_before = (
        Window.partitionBy("ask").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    )
    not_full = F.when(F.get("loads", F.col("shard")) < capacity, F.col("shard"))
    left = F.col("bytes") - F.col("done")
    ahead = F.coalesce(F.sum(left).over(asked_before), F.lit(0))
    free = F.lit(capacity) - F.get("loads", F.col("ask")) - ahead
    taking = arcs.withColumn(
        "ask",
        F.coalesce(
            F.first(not_full, ignorenulls=True).over(onward),
            F.first(not_full, ignorenulls=True).over(whole),
        ),
    ).withColumn("take", F.coalesce(F.greatest(F.least(left, free), F.lit(0)), F.lit(0)))
    by_shard = F.array(
        *[
            F.coalesce(F.sum(F.when(F.col("ask") == s, F.col("take"))).over(whole), F.lit(0))
            for s in range(shards)
        ]
    )
    end = F.col("done") + F.col("take")
    piece = F.array(
        F.struct(F.col("ask").alias("shard"), F.col("done").alias("begin"), end.alias("end"))
    )
    return taking.withColumn("added", by_shard).select(
        "arc",
        "shard",
        "bytes",
        end.alias("done"),
        F.zip_with("loads", "added", lambda x, y: x + y).alias("loads"),
        F.when(F.col("take") > 0, F.concat("pieces", piece))
        .otherwise(F.col("pieces"))
        .alias("pieces"),
    )


def _place(demand: DataFrame, shards: int, capacity: int) -> DataFrame:
    """Splits each arc's bytes among shards: `(arc, shard, begin, end)`.

    Each round fills a shard or ends, so there are at most `shards` rounds, over a table of
    fixed size that is written after every few of them.
    """
    nothing = F.array().cast("array<struct<shard:int,begin:bigint,end:bigint>>")
    arcs = demand.select(
        "arc",
        "shard",
        "bytes",
        F.lit(0).cast("long").alias("done"),
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        nothing.alias("pieces"),
    )
    for turn in range(1, shards + 1):
        arcs = _round(arcs, shards, capacity)
        if turn % ROUNDS_A_WRITE == 0 or turn == shards:
            arcs = cut(arcs)
            if arcs.filter("bytes > done").isEmpty():
                break
    return arcs.select("arc", F.explode("pieces").alias("_piece")).select("arc", "_piece.*")


def ring_shards(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = 16,
    virtual_nodes: int = VIRTUAL_NODES,
    slack: int = SLACK,
) -> DataFrame:
    """`(key, size, text_crc32, shard, slot)` for every row of `df`.

    A row's size is its text's UTF-8 bytes plus one; its place on the ring is a hash of
    the text, so equal texts meet. Rows are ordered by place, each arc's bytes are
    split among shards by `_place`, and a row goes where its middle byte goes. Equal
    texts go together (by the middle of all their bytes) unless they weigh over 1/TOGETHER
    of a shard. No shard takes over (1000 + slack)/1000 of the mean, but for half of the
    rows or groups on the edges of its pieces.
    `slot` numbers a shard's rows from 0 without gaps.

    Null text: size 1, placed as an empty text, crc null. Null keys and repeated rows are
    rows like others; ties in place are broken by key, then by text. An empty table gives an
    empty one. Other columns are not read.
    """
    spark = df.sparkSession
    content = F.col(text).cast("string")
    rows = cut(
        df.select(
            F.col(key).alias("_key"),
            (F.coalesce(F.octet_length(content), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"),
            hash60(content).alias("_place"),
        )
    )
    order = [F.col(x) for x in ("_place", "_key", "text_crc32")]
    parts = ordered_parts(rows, *order)

    arcs = cut(ring_arcs(spark, shards, virtual_nodes))
    width = 2**HASH_BITS // SLICES
    slices = arcs.select(
        "arc",
        "low",
        "high",
        F.explode(
            F.sequence(
                F.floor((F.col("low") + 1) / F.lit(width)).cast("long"),
                F.floor(F.col("high") / F.lit(width)).cast("long"),
            )
        ).alias("_slice"),
    )
    # at most SLICES + 2 x arcs rows, whatever the data
    located = cut(
        parts.withColumn("_slice", F.shiftright("_place", HASH_BITS - 12))
        .join(F.broadcast(slices), "_slice")
        .filter((F.col("_place") > F.col("low")) & (F.col("_place") <= F.col("high")))
        .drop("_slice", "low", "high")
    )
    located = cut(running_total(located, ["arc"], order, "size", "_start"))
    sums = located.groupBy("arc").agg(F.sum("size").alias("bytes"))
    demand = cut(
        arcs.select("arc", "shard")
        .join(sums, "arc", "left")
        .select("arc", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    )
    total = demand.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    capacity = total * (1000 + slack) // (1000 * shards) + 1
    pieces = _place(demand, shards, capacity)

    # a group's rows are spread over parts: totals go back by part and place
    groups = located.groupBy("_part", "_place").agg(
        F.sum("size").alias("_bytes"), F.min("_start").alias("_first")
    )
    totals = groups.groupBy("_place").agg(
        F.sum("_bytes").alias("_bytes"), F.min("_first").alias("_first")
    )
    groups = groups.select("_part", "_place").join(totals, "_place")
    anchored = located.join(groups, ["_part", "_place"]).withColumn(
        "_anchor",
        F.when(
            F.col("_bytes") * TOGETHER <= capacity,
            F.col("_first") + F.expr("_bytes div 2"),
        ).otherwise(F.col("_start") + F.expr("size div 2")),
    )
    # each round adds a piece to an arc at most: bounded by arcs x shards
    placed = cut(
        anchored.join(F.broadcast(pieces), "arc")
        .filter((F.col("_anchor") >= F.col("begin")) & (F.col("_anchor") < F.col("end")))
        .select("_key", "size", "text_crc32", "_place", "_part", "shard")
        .withColumn("_one", F.lit(1).cast("long"))
    )
    return running_total(placed, ["shard"], order, "_one", "slot").select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", "slot"
    )
