"""Markov clustering of a weighted graph, one connected component at a time.

Small components are clustered whole inside a task, many to a task. A component
above `DENSE_LIMIT` nodes is never gathered: its matrix is a table of column
strips, and a task multiplies all strips, streamed one by one, with its own.
Neither prunes: only flows vanish that are too small to change any other in double arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graphs import lowest_labels
from ..functions.ranking import global_rank
from ..session import cut, discard, settings, task_slots
from .components import connected_components

DENSE_LIMIT = 2048
# a strip has at most so many columns, and at most so many cells: 32 MB
TILE = 512
STRIP_CELLS = 1 << 22
# cells of the strips that one task works on: 150 MB
_GROUP_CELLS = 9 << 21
MAX_ITERATIONS = 1000
TOLERANCE = 1e-12
# rounding before picking an attractor, so that last-bit noise breaks no tie
_DECIMALS = 9
# A flow this small squares to less than the smallest double. It is set to 0:
# it cannot change a sum, and arithmetic on what is left of it is slow.
_VANISHING = 1e-150
# flows closer than this are equal at the end
_AT_REST = 1e-9
_PACK_EDGES = 50_000


class NotConverged(RuntimeError):
    """Markov clustering reached its iteration cap."""


def _restlessness(flow: np.ndarray) -> float:
    """How far columns are from being spread evenly over what they reach; 0 at the end.

    An even column's largest share is the sum of its squared shares.
    """
    return float((flow.max(axis=0) - np.einsum("ij,ij->j", flow, flow)).max())


def _attractor_systems(flow: np.ndarray) -> np.ndarray:
    """Each node's cluster as its first member, from a flow at rest.

    Nodes that keep flow of their own attract; attractors that flow to each other are one
    system, and a node belongs to the system that most of its flow goes to, the first of equals.
    """
    size = len(flow)
    draws = np.flatnonzero(flow.diagonal() > _AT_REST)
    system = np.arange(size)
    to, by = np.nonzero(flow[np.ix_(draws, draws)] > _AT_REST)
    system = lowest_labels(draws[to], draws[by], size)
    heads = np.unique(system[draws])
    share = np.zeros((len(heads), size))
    np.add.at(share, np.searchsorted(heads, system[draws]), flow[draws])
    home = heads[(share > share.max(axis=0) - _AT_REST).argmax(axis=0)]
    return lowest_labels(np.arange(size), home, size)


def _dense_clusters(i: np.ndarray, j: np.ndarray, w: np.ndarray, inflation: float):
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    flow = np.zeros((len(nodes), len(nodes)))
    flow[a, b] = flow[b, a] = w
    # a loop as strong as a node's strongest edge
    loops = np.arange(len(nodes))
    flow[loops, loops] = flow.max(axis=0)
    flow /= flow.sum(axis=0)
    for _ in range(MAX_ITERATIONS):
        flow = np.power(flow @ flow, inflation)
        flow /= flow.sum(axis=0)
        flow[flow < _VANISHING] = 0.0
        if _restlessness(flow) < TOLERANCE:
            return nodes, nodes[_attractor_systems(flow)]
    raise NotConverged(f"MCL did not converge within {MAX_ITERATIONS} iterations.")


def _small(edges: DataFrame, inflation: float) -> DataFrame:
    def cluster(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = pd.concat(list(frames))
        for component, part in pack.groupby("component", sort=False):
            part = part.sort_values(["i", "j"])
            node, first = _dense_clusters(
                part["i"].to_numpy(),
                part["j"].to_numpy(),
                part["weight"].to_numpy(),
                inflation,
            )
            yield pd.DataFrame(
                {"node": node, "component": component, "cluster": first}
            )

    packs = max(1, edges.count() // _PACK_EDGES + 1)
    packs = max(packs, edges.sparkSession.sparkContext.defaultParallelism)
    return (
        edges.withColumn(
            "_pack", F.pmod(F.xxhash64("component"), F.lit(packs)).cast("int")
        )
        .repartition(packs, "_pack")
        .groupBy("_pack")
        .applyInPandas(cluster, "node long, component long, cluster long")
    )


# --- large components: the matrix as a table of column strips -------------------

# Rows are offsets in the component. `ends` is empty if all columns of the rows that hold flow are
# stored; otherwise only flows are, column by column, and `ends` says where each column ends.
_ONE_BY_ONE = {
    # a strip is megabytes: tasks read one file, and readers and batches hold one row
    "spark.sql.files.openCostInBytes": str(1 << 30),
    "spark.sql.files.maxPartitionBytes": str(1 << 30),
    "spark.sql.parquet.columnarReaderBatchSize": "1",
    "spark.sql.parquet.compression.codec": "uncompressed",
}
_ROW_BY_ROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
_PLACE = ["first", "size", "start", "width", "team", "mates", "low", "high"]
_PACKED = ["rows", "cells", "ends"]
_STRIPS = ", ".join([f"{c} long" for c in _PLACE] + [f"{c} binary" for c in _PACKED])
# a strip with a smaller share of flows than this is stored as flows
_SPARSE = 0.2
# nanoseconds of a product of two flows, and of one inside a matrix product
_FLOW_COST, _CELL_COST = 40.0, 0.05
# products of flows formed together
_PRODUCTS = 1 << 20
# rows of a product that are added while they are in a core's cache
_CACHED_ROWS = 256


def _strip(place: list[int], cells: np.ndarray) -> pa.RecordBatch:
    """One strip as a row, from its place and its cells in all rows of the component."""
    used = np.flatnonzero(cells.any(axis=1))
    count = np.count_nonzero(cells, axis=0)
    if count.sum() < _SPARSE * len(used) * cells.shape[1]:
        column, rows = np.nonzero(cells.T)
        packed = [rows.astype(np.int64), cells[rows, column], np.cumsum(count, dtype=np.int64)]
    else:
        whole = np.ascontiguousarray(cells if len(used) == len(cells) else cells[used])
        packed = [used.astype(np.int64), whole, np.empty(0, dtype=np.int64)]
    columns = [pa.array([v], pa.int64()) for v in place]
    # views: a strip is not copied into bytes first
    columns += [
        pa.Array.from_buffers(
            pa.binary(), 1, [None, pa.py_buffer(np.array([0, p.nbytes], dtype=np.int32)), pa.py_buffer(p)]
        )
        for p in packed
    ]
    return pa.RecordBatch.from_arrays(columns, names=_PLACE + _PACKED)


class _Strip:
    """Columns as they are stored: rows with all their columns, or the flows of each column."""

    def __init__(self, size: int, width: int, rows: np.ndarray, cells: np.ndarray, ends: np.ndarray):
        self.size, self.width = size, width
        self.rows, self.ends = rows, ends
        self.sparse = len(ends) > 0
        self.cells = cells if self.sparse else cells.reshape(len(rows), width)
        self._whole: np.ndarray | None = None

    def counts(self) -> np.ndarray:
        """Flows of each column of a sparse strip."""
        return np.diff(self.ends, prepend=0)

    def columns(self) -> np.ndarray:
        """The column of each flow of a sparse strip."""
        return np.repeat(np.arange(self.width), self.counts())

    def whole(self) -> np.ndarray:
        """All rows of the component, all columns."""
        if self._whole is None:
            if not self.sparse and len(self.rows) == self.size:
                self._whole = self.cells
            else:
                self._whole = np.zeros((self.size, self.width))
                if self.sparse:
                    self._whole[self.rows, self.columns()] = self.cells
                else:
                    self._whole[self.rows] = self.cells
        return self._whole

    def stored(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold flow, and all their columns."""
        if not self.sparse:
            return self.rows, self.cells
        used = np.unique(self.rows)
        cells = np.zeros((len(used), self.width))
        cells[np.searchsorted(used, self.rows), self.columns()] = self.cells
        return used, cells


def _unpack(batch: pa.RecordBatch, at: int) -> tuple[list[int], _Strip]:
    place = [batch[n][at].as_py() for n in _PLACE]
    rows, cells, ends = (batch[n][at].as_buffer() for n in _PACKED)
    ints = [np.frombuffer(b, dtype=np.int64) for b in (rows, ends)]
    return place, _Strip(place[1], place[3], ints[0], np.frombuffer(cells), ints[1])


def _side_by_side(strips: list[_Strip]) -> _Strip:
    """Neighbouring strips of a component as one."""
    size, width = strips[0].size, sum(s.width for s in strips)
    if all(s.sparse for s in strips):
        before = np.cumsum([0] + [len(s.rows) for s in strips])
        ends = np.concatenate([s.ends + b for s, b in zip(strips, before)])
        rows, cells = (np.concatenate([getattr(s, n) for s in strips]) for n in ("rows", "cells"))
        return _Strip(size, width, rows, cells, ends)
    used = np.unique(np.concatenate([s.rows for s in strips]))
    cells = np.zeros((len(used), width))
    at = 0
    for strip in strips:
        rows, part = strip.stored()
        cells[np.searchsorted(used, rows), at : at + strip.width] = part
        at += strip.width
    return _Strip(size, width, used, cells, np.empty(0, dtype=np.int64))


def _add_flows(grown: np.ndarray, over: _Strip, at: np.ndarray, by: np.ndarray, flow: np.ndarray):
    """Adds the columns `at` of a sparse strip, times `flow`, to the columns `by`."""
    spans = over.counts()[at]
    upto = np.cumsum(spans)
    begins = over.ends[at] - spans
    flat = grown.reshape(-1)
    for low in range(0, int(upto[-1]) if len(upto) else 0, _PRODUCTS):
        place = np.arange(low, min(low + _PRODUCTS, int(upto[-1])))
        which = np.searchsorted(upto, place, side="right")
        entry = begins[which] + place - (upto[which] - spans[which])
        np.add.at(flat, over.rows[entry] * grown.shape[1] + by[which], over.cells[entry] * flow[which])


def _add_cells(grown: np.ndarray, rows: np.ndarray, cells: np.ndarray, through: np.ndarray):
    """Adds a matrix product to the given rows."""
    held = np.empty((min(_CACHED_ROWS, len(rows)), through.shape[1]))
    for low in range(0, len(rows), _CACHED_ROWS):
        part = slice(low, low + _CACHED_ROWS)
        product = np.matmul(cells[part], through, out=held[: len(rows[part])])
        if len(rows) == len(grown):
            grown[part] += product
        else:
            grown[rows[part]] += product


def _expand(grown: np.ndarray, own: _Strip, over: _Strip, offset: int) -> None:
    """Adds to `grown` what flows on from `own` through the columns of `over`, the first at `offset`."""
    if own.sparse and over.sparse:
        mine = np.flatnonzero((own.rows >= offset) & (own.rows < offset + over.width))
        at = own.rows[mine] - offset
        products = over.counts()[at].sum()
        used = len(np.unique(over.rows))
        if _FLOW_COST * products <= _CELL_COST * used * over.width * own.width:
            _add_flows(grown, over, at, own.columns()[mine], own.cells[mine])
            return
    if own.sparse or len(own.rows) == own.size:
        through, at = own.whole()[offset : offset + over.width], None
    else:
        low, high = np.searchsorted(own.rows, [offset, offset + over.width])
        through, at = own.cells[low:high], own.rows[low:high] - offset
    if not len(through):
        return
    rows, cells = over.stored()
    if at is not None and len(at) < over.width:
        cells = cells[:, at]
    _add_cells(grown, rows, cells, through)


def _build_strip(
    key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    place = [k.as_py() for k in key]
    cells = np.zeros((place[1], place[3]))
    for batch in batches:
        cells[batch["pi"].to_numpy(), batch["pj"].to_numpy()] = batch["v"].to_numpy()
    yield _strip(place, cells)


def _lost_in_rounding(size: int, inflation: float) -> float:
    """Flows below this change no flow that is kept, in double arithmetic.

    A kept flow v comes from a sum of at least (v * size ** (1 - r)) ** (1 / r), since a column's powers
    sum to size ** (1 - r) or more; all that was dropped adds less than size * v to it. This is the
    largest v for which that stays below the sum's rounding.
    """
    rounding = np.finfo(float).eps / 2 * float(size) ** (1 / inflation - 2)
    return max(_VANISHING, rounding ** (inflation / (inflation - 1)))


def _inflated(flow: np.ndarray, inflation: float) -> np.ndarray:
    """Columns raised to a power and normalised, in place."""
    if inflation == 2.0:
        np.square(flow, out=flow)
    else:
        held = flow > 0
        flow[held] = np.power(flow[held], inflation)
    flow /= flow.sum(axis=0)
    flow[flow < _lost_in_rounding(len(flow), inflation)] = 0.0
    return flow


def _step(inflation: float):
    """Expansion, inflation and normalisation of a team of strips, past which all strips are streamed.

    A task meets its own strips first (`own`), then all those of their components.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, list[tuple[list[int], _Strip]]] = {}
        teams: dict[int, tuple[_Strip, np.ndarray]] = {}
        early: list[tuple[list[int], _Strip]] = []
        waiting = -1

        def meet(place: list[int], over: _Strip) -> None:
            first, _, start = place[:3]
            if first not in mine:
                return
            if first not in teams:
                mine[first].sort(key=lambda m: m[0])
                own = _side_by_side([strip for _, strip in mine[first]])
                # only places are needed from here
                mine[first] = [(at, None) for at, _ in mine[first]]
                teams[first] = own, np.zeros((own.size, own.width))
            own, grown = teams[first]
            _expand(grown, own, over, start - first)

        for batch in batches:
            for at in range(batch.num_rows):
                place, strip = _unpack(batch, at)
                if batch["own"][at].as_py():
                    mine.setdefault(place[0], []).append((place, strip))
                    # mates: the strips of the team
                    waiting = place[5] - sum(map(len, mine.values()))
                else:
                    # the order of files is not promised everywhere
                    early.append((place, strip))
                while early and waiting == 0:
                    meet(*early.pop())
                del strip
        for first in list(teams):
            own, flow = teams.pop(first)
            del own
            _inflated(flow, inflation)
            at = 0
            for place, _ in mine.pop(first):
                part = flow[:, at : at + place[3]]
                at += place[3]
                out = _strip(place, part)
                yield out.append_column("restless", pa.array([_restlessness(part)]))

    return fn


def _attractors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            place, strip = _unpack(batch, at)
            rows, cells = strip.stored()
            lead = rows[np.round(cells, _DECIMALS).argmax(axis=0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[2] + np.arange(strip.width)), pa.array(place[0] + lead)],
                names=["col", "row"],
            )


def _large(edges: DataFrame, inflation: float) -> DataFrame:
    spark = edges.sparkSession
    both = edges.select("component", "i", "j", "weight").unionByName(
        edges.select(
            "component", F.col("j").alias("i"), F.col("i").alias("j"), "weight"
        )
    )
    loops = both.groupBy("component", "j").agg(F.max("weight").alias("weight"))
    flow = both.unionByName(
        loops.select("component", F.col("j").alias("i"), "j", "weight")
    )
    column = flow.groupBy(F.col("j").alias("node")).agg(
        F.sum("weight").alias("mass"), F.min("component").alias("component")
    )
    ranked = global_rank(column, "component", "node", name="at")
    spans = ranked.groupBy("component").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("size")
    )
    index = cut(
        ranked.join(spans, "component").select(
            "component", "node", "mass", "first", "size", "at"
        )
    )
    row = index.select(F.col("node").alias("i"), F.col("at").alias("ai"))
    col = index.select(F.col("node").alias("j"), F.col("at").alias("aj"), "mass", "first", "size")
    # as many columns as a task holds cells for; teams of strips fill whole rounds of the cores
    cores = spark.sparkContext.defaultParallelism
    columns, tallest = index.agg(F.count(F.lit(1)), F.max("size")).first()
    teams = math.ceil(columns / max(1, _GROUP_CELLS // tallest))
    teams = math.ceil(teams / cores) * cores
    team = math.ceil(columns / teams)
    most = F.least(F.lit(TILE), F.greatest(F.lit(1), F.floor(F.lit(STRIP_CELLS) / F.col("size"))))
    wide = F.ceil(F.lit(team) / F.ceil(F.lit(team) / most))
    begin = F.col("first") + F.floor((F.col("aj") - F.col("first")) / wide) * wide
    of = lambda at: F.floor(at / team)
    strip = (
        col.withColumn("start", begin)
        .withColumn("width", F.least(wide, F.col("first") + F.col("size") - F.col("start")))
        .withColumns({"team": of(F.col("start")), "low": of(F.col("first"))})
        .withColumn("high", of(F.col("first") + F.col("size") - 1))
    )
    mates = strip.groupBy("team").agg(F.countDistinct("start").alias("mates"))
    placed = (
        flow.join(row, "i")
        .join(strip.join(mates, "team"), "j")
        .select(
            *_PLACE,
            (F.col("ai") - F.col("first")).alias("pi"),
            (F.col("aj") - F.col("start")).alias("pj"),
            (F.col("weight") / F.col("mass")).alias("v"),
        )
    )
    with settings(spark, _ONE_BY_ONE):
        strips = cut(
            placed.repartition(task_slots(spark), "start")
            .groupBy(*_PLACE)
            .applyInArrow(_build_strip, _STRIPS),
            rows_per_file=1,
        )
    with settings(spark, _ONE_BY_ONE | _ROW_BY_ROW):
        for _ in range(MAX_ITERATIONS):
            # Every task streams all strips past its own ones, from the files: a product needs no
            # shuffle, and whole columns are in one task, so what follows it needs none either.
            met = (
                strips.withColumn("own", F.lit(True))
                .unionByName(strips.withColumn("own", F.lit(False)))
                .coalesce(1)
            )
            inside = F.when(F.col("own"), F.col("id") == F.col("team")).otherwise(
                F.col("id").between(F.col("low"), F.col("high"))
            )
            tasks = spark.range(0, teams, 1, teams)
            grown = cut(
                # the hint: a small table is no reason to meet all strips in one task
                met.crossJoin(tasks.hint("shuffle_replicate_nl"))
                .filter(inside)
                .select(*_PLACE, *_PACKED, "own")
                .mapInArrow(_step(inflation), _STRIPS + ", restless double"),
                rows_per_file=1,
            )
            restless = grown.agg(F.max("restless")).first()[0]
            discard(strips)
            strips = grown.drop("restless")
            if restless < TOLERANCE:
                break
        else:
            raise NotConverged(
                f"MCL did not converge within {MAX_ITERATIONS} iterations."
            )
        best = cut(strips.mapInArrow(_attractors, "col long, row long"))
        discard(strips)
    place = index.select(F.col("node").alias("i"), F.col("at").alias("col"))
    lead = index.select(F.col("node").alias("j"), F.col("at").alias("row"))
    links = best.join(place, "col").join(lead, "row")
    clusters = connected_components(
        links.select("i", "j"), index.select("node")
    ).withColumnRenamed("component", "cluster")
    return clusters.join(index.select("node", "component"), "node").select(
        "node", "component", "cluster"
    )


def markov_clusters(
    edges: DataFrame,
    components: DataFrame,
    inflation: float = 2.0,
    dense_limit: int = DENSE_LIMIT,
) -> DataFrame:
    """`(node, component, cluster)` for every node of `components`.

    Components and clusters are named by their smallest node. Self-loops take
    the weight of the node's heaviest edge. Flow never crosses components;
    components of one or two nodes are one cluster without any work.
    """
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    trivial = components.join(sizes.filter("size <= 2"), "component").select(
        "node", "component", F.col("component").alias("cluster")
    )
    placed = edges.join(components.withColumnRenamed("node", "i"), "i").join(
        sizes.filter("size > 2"), "component"
    )
    placed = placed.select("component", "size", "i", "j", "weight").persist()
    small = placed.filter(F.col("size") <= dense_limit).drop("size")
    out = trivial.unionByName(_small(small, inflation))
    large = placed.filter(F.col("size") > dense_limit).drop("size")
    if not large.isEmpty():
        out = out.unionByName(_large(large, inflation))
    out = cut(out)
    placed.unpersist()
    return out
