"""All-pairs work on a vector set, laid out as bounded tiles.

Rows are hashed into blocks. A row is sent to the tiles that pair its block
with every other block, so what is shuffled grows with the number of blocks:
they are as few as keep the cores busy, or as hold `_STRIPS` x `tile_rows` rows.
One task evaluates one tile in strips of `tile_rows`, a matrix product for each
pair of strips, so no pair is ever a Spark row unless the tile function emits
it, and `merge` folds what the strips of a tile emit. A tile holds at most two
blocks whatever the data looks like: blocks are cut by hash of a unique key, so
no value can be hot.

`map_close_tiles` adds exact pruning for similarity thresholds. Each vector is
at home at its nearest pivot and visits only cells that the triangle inequality
on angles cannot rule out; crowded cells are split into blocks again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, task_slots

TILE_ROWS = 2048
# blocks are not cut smaller than this to keep cores busy
_LEAST_ROWS = 512
# most strips of a block
_STRIPS = 32
# rows that strips have emitted before they are merged
_MERGE_ROWS = 1_000_000
_MAX_PIVOTS = 1024
_ANGLE_SLACK = 1e-6

TileFn = Callable[[pa.Table, "pa.Table | None"], Iterator[pa.RecordBatch]]
MergeFn = Callable[[pa.Table], pa.Table]


def matrix(table: pa.Table, name: str = "embedding") -> np.ndarray:
    """A list column as a rows x dimensions array."""
    column = table[name].combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def folded(keys: list[str], how: dict[str, str]) -> MergeFn:
    """Merges rows with equal `keys`; `how` names the aggregate of each other column."""

    def merge(table: pa.Table) -> pa.Table:
        out = table.group_by(keys).aggregate(list(how.items()))
        named = {f"{c}_{a}": c for c, a in how.items()}
        return out.rename_columns([named.get(c, c) for c in out.column_names]).select(
            table.column_names
        )

    return merge


def _strips(fn: TileFn, left: pa.Table, right: pa.Table | None, tile_rows: int):
    """`fn` on every pair of strips of one tile."""
    cut_up = lambda t: [t.slice(at, tile_rows) for at in range(0, len(t), tile_rows)]
    parts = cut_up(left)
    if right is None:
        for k, part in enumerate(parts):
            yield from fn(part, None)
            for other in parts[k + 1 :]:
                yield from fn(part, other)
    else:
        others = cut_up(right)
        for part in parts:
            for other in others:
                yield from fn(part, other)


def _merged(batches: Iterator[pa.RecordBatch], merge: MergeFn) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows, limit = 0, _MERGE_ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > limit:
            held = merge(pa.Table.from_batches(held)).to_batches()
            rows = sum(b.num_rows for b in held)
            # what does not shrink is not merged again for every strip
            limit = max(_MERGE_ROWS, 2 * rows)
    if held:
        yield from merge(pa.Table.from_batches(held)).to_batches(max_chunksize=65_536)


def _runner(fn: TileFn, key: str, tile_rows: int, merge: MergeFn | None):
    def tile(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        out = _strips(fn, left, right, tile_rows)
        return out if merge is None else _merged(out, merge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted, so a recomputed tile multiplies its rows in the same order
        table = pa.Table.from_batches(list(batches)).sort_by(key)
        left = table.filter(pc.less_equal(table["_side"], 1))
        right = table.filter(pc.equal(table["_side"], 2))
        if len(right):
            if len(left):
                yield from tile(left, right)
        elif table["_side"][0].as_py() == 0:
            yield from tile(left, None)

    return run


def _apply(placed: DataFrame, tiles: int, key: str, run: Callable, schema: str):
    slots = task_slots(placed.sparkSession)
    # more parts than tiles, so that few of them hold two
    parts = min(8 * tiles, max(4 * slots, math.ceil(tiles / 8)), 100_000)
    # an explicit count: tiles are heavy for their bytes, so size-based
    # coalescing would put them all in one task
    return (
        placed.repartition(parts, "_cell", "_ti", "_tj")
        .groupBy("_cell", "_ti", "_tj")
        .applyInArrow(run, schema)
    )


def _blocks(rows: DataFrame, total: int, tile_rows: int) -> int:
    """Blocks that give every core several tiles, while tiles are worth a task and fit in one."""
    wanted = math.isqrt(16 * rows.sparkSession.sparkContext.defaultParallelism)
    worth = math.ceil(total / min(tile_rows, _LEAST_ROWS))
    return max(1, min(wanted, worth), math.ceil(total / (_STRIPS * tile_rows)))


def map_tiles(
    rows: DataFrame,
    key: str,
    fn: TileFn,
    schema: str,
    tile_rows: int = TILE_ROWS,
    count: int | None = None,
    merge: MergeFn | None = None,
) -> DataFrame:
    """Run `fn` once for every unordered pair of strips of `rows`, `merge` on each tile's results."""
    total = rows.count() if count is None else count
    blocks = _blocks(rows, total, tile_rows)
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    partners = F.transform(
        F.sequence(F.lit(0), F.lit(blocks - 1)),
        lambda other: F.struct(
            F.least(F.col("_block"), other).alias("ti"),
            F.greatest(F.col("_block"), other).alias("tj"),
        ),
    )
    placed = (
        rows.withColumn("_block", block)
        .withColumn("_pair", F.explode(partners))
        .select(
            *[F.col(f"`{c}`") for c in rows.columns],
            F.lit(0).alias("_cell"),
            F.col("_pair.ti").alias("_ti"),
            F.col("_pair.tj").alias("_tj"),
            F.when(F.col("_pair.ti") == F.col("_pair.tj"), 0)
            .when(F.col("_pair.ti") == F.col("_block"), 1)
            .otherwise(2)
            .alias("_side"),
        )
    )
    tiles = blocks * (blocks + 1) // 2
    return _apply(placed, tiles, key, _runner(fn, key, tile_rows, merge), schema)


def _cells(pivots: np.ndarray, reach: float):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            cosine = np.clip(matrix(table) @ pivots.T, -1.0, 1.0)
            angle = np.arccos(cosine)
            home = angle.argmin(axis=1)
            limit = angle[np.arange(len(home)), home] + reach
            near = (angle <= limit[:, None]) & (
                np.arange(len(pivots))[None, :] < home[:, None]
            )
            visits = pa.array([np.flatnonzero(r).astype(np.int32) for r in near])
            table = table.append_column("_home", pa.array(home.astype(np.int32)))
            table = table.append_column("_visits", visits.cast(pa.list_(pa.int32())))
            yield from table.to_batches()

    return assign


def map_close_tiles(
    rows: DataFrame,
    key: str,
    fn: TileFn,
    schema: str,
    min_sim: float,
    tile_rows: int = TILE_ROWS,
    count: int | None = None,
    merge: MergeFn | None = None,
) -> DataFrame:
    """As `map_tiles`, skipping block pairs that cannot reach cosine `min_sim`.

    Exact: if u is at home at pivot h and cos(u, v) >= min_sim, then v's angle
    to h exceeds v's angle to its own pivot by at most twice the threshold
    angle, so v visits h. A pair from two homes is met once, in the lower one.
    """
    total = rows.count() if count is None else count
    wanted = min(_MAX_PIVOTS, total // tile_rows)
    if min_sim < 0.5 or wanted < 2:
        return map_tiles(rows, key, fn, schema, tile_rows, total, merge)
    # at most _MAX_PIVOTS vectors reach the driver, whatever the table holds
    picked = rows.orderBy(F.xxhash64(key), key).limit(wanted).select("embedding")
    pivots = np.array([r[0] for r in picked.collect()], dtype=float)
    reach = 2.0 * math.acos(min(min_sim, 1.0)) + _ANGLE_SLACK
    plain = rows.schema.simpleString()[len("struct<") : -1]
    # materialised: the cell sizes below and the rows sent to the cells must
    # come from one and the same assignment
    homed = cut(
        rows.mapInArrow(
            _cells(pivots, reach),
            f"{plain},_home:int,_visits:array<int>",
        )
    )
    residents = homed.groupBy(F.col("_home").alias("_cell")).agg(
        F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("_homes")
    )
    visitors = (
        homed.select(F.explode("_visits").alias("_cell"))
        .groupBy("_cell")
        .agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("_outers"))
    )
    # one row per pivot: at most _MAX_PIVOTS rows are collected and shipped
    sizes = {
        r["_cell"]: (r["_homes"], r["_outers"] or 0)
        for r in residents.join(visitors, "_cell", "left").collect()
    }
    tiles = sum(h * (h + 1) // 2 + h * o for h, o in sizes.values())
    layout = rows.sparkSession.createDataFrame(
        [(c, h, o) for c, (h, o) in sizes.items()],
        "_cell int, _homes int, _outers int",
    )
    hashed = F.xxhash64(key)
    placed = (
        homed.withColumn(
            "_stay",
            F.explode(
                F.concat(
                    F.array(F.struct(F.col("_home").alias("c"), F.lit(True).alias("h"))),
                    F.transform(
                        "_visits",
                        lambda c: F.struct(c.alias("c"), F.lit(False).alias("h")),
                    ),
                )
            ),
        )
        .withColumn("_cell", F.col("_stay.c"))
        .join(F.broadcast(layout), "_cell")
        .withColumn("_hb", F.pmod(hashed, F.col("_homes")).cast("int"))
        .withColumn(
            "_ob",
            F.when(F.col("_outers") > 0, F.pmod(hashed, F.col("_outers"))).cast("int"),
        )
    )
    # visitor blocks are numbered after the home blocks of their cell
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
        F.array().cast("array<int>")
    )
    among_homes = F.transform(
        upto(F.col("_homes")),
        lambda x: F.struct(
            F.least(F.col("_hb"), x).alias("ti"),
            F.greatest(F.col("_hb"), x).alias("tj"),
            F.when(x == F.col("_hb"), 0)
            .when(x > F.col("_hb"), 1)
            .otherwise(2)
            .alias("side"),
        ),
    )
    with_visitors = F.transform(
        upto(F.col("_outers")),
        lambda x: F.struct(
            F.col("_hb").alias("ti"),
            (F.col("_homes") + x).alias("tj"),
            F.lit(1).alias("side"),
        ),
    )
    as_visitor = F.transform(
        upto(F.col("_homes")),
        lambda x: F.struct(
            x.alias("ti"),
            (F.col("_homes") + F.col("_ob")).alias("tj"),
            F.lit(2).alias("side"),
        ),
    )
    spread = placed.withColumn(
        "_pair",
        F.explode(
            F.when(F.col("_stay.h"), F.concat(among_homes, with_visitors)).otherwise(
                as_visitor
            )
        ),
    ).select(
        *[F.col(f"`{c}`") for c in rows.columns],
        "_cell",
        F.col("_pair.ti").alias("_ti"),
        F.col("_pair.tj").alias("_tj"),
        F.col("_pair.side").alias("_side"),
    )
    # tiles are cut by cells and may lie a little above `tile_rows`: two strips, then
    return _apply(spread, tiles, key, _runner(fn, key, 2 * tile_rows, merge), schema)
