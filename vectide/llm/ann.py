"""Nearest neighbours: probed lists scanned in column blocks, with early abandoning."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .common import hash_sample

NEIGHBOURS = 10
# vectors that centroids are fitted on, lists at most, and rounds of the fit
SAMPLE = 20_000
MOST_LISTS = 1024
FIT_ROUNDS = 10
# a query probes its nearest lists until they hold the share of all vectors at which so many of the
# true neighbours of so many sampled vectors, among the sample, are in probed lists
RECALL, TRIED = 0.98, 500
# rows and queries of one scan
CELL_ROWS, CELL_QUERIES = 4096, 512
# columns after which the partial distance is tested, and the test's strictness: a
# candidate goes if its scaled partial distance exceeds (1 + EPSILON / sqrt(columns)) times
# the distance to beat
COLUMN_BLOCK = 16
EPSILON = 2.1


def _usable(vector: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")),
    )
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def clean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """`(id, vector)`: usable vectors of the commonest length (the larger of equals)."""
    rows = df.select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")
    ).filter(F.col("id").isNotNull() & _usable(F.col("vector")))
    common = (
        rows.groupBy(F.size("vector").alias("n"))
        .count()
        .orderBy(F.desc("count"), F.desc("n"))
        .first()
    )
    return rows.filter(F.size("vector") == (common["n"] if common else 0))


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """k-means on a sample; a centroid without members stays where it is."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(FIT_ROUNDS):
        nearest = ((centroids**2).sum(axis=1) - 2 * sample @ centroids.T).argmin(axis=1)
        counts = np.bincount(nearest, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        some = counts > 0
        centroids[some] = sums[some] / counts[some, None]
    return centroids


def rotation(n: int, seed: int = 2) -> np.ndarray:
    """A random orthonormal matrix: it spreads every difference over all columns."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]


def scan(
    rows: np.ndarray, turned: np.ndarray, query: np.ndarray, turned_query: np.ndarray,
    bound: float, k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of the rows that may be among the k nearest.

    The distance to beat starts at `bound` (or the k-th of a first block) and squared
    differences are summed column block by column block over the rows still alive. After
    each block a row goes if even its partial sum is too large, or if the sum scaled to all
    columns is too large by the test's margin. The rows that set the distance to beat stay, so k rows
    are left of k or more.
    """
    columns = rows.shape[1]
    leading = np.zeros(len(rows), bool)
    if not np.isfinite(bound) and len(rows) >= k:
        head = np.sqrt(((rows[: max(k, 256)] - query) ** 2).sum(axis=1))
        best = np.argpartition(head, k - 1)[:k]
        bound = head[best].max()
        leading[best] = True
    # rounding of the turned vectors must not cost a tie
    limit = (bound * (1 + 1e-9)) ** 2
    alive = np.arange(len(rows))
    partial = np.zeros(len(rows))
    for at in range(0, columns, COLUMN_BLOCK):
        block = slice(at, at + COLUMN_BLOCK)
        partial += ((turned[alive, block] - turned_query[block]) ** 2).sum(axis=1)
        done = min(at + COLUMN_BLOCK, columns)
        margin = (1 + EPSILON / np.sqrt(done)) ** 2
        keep = (partial <= limit) & (partial * columns <= limit * margin * done)
        keep |= leading[alive]
        alive, partial = alive[keep], partial[keep]
    exact = np.sqrt(((rows[alive] - query) ** 2).sum(axis=1))
    return alive, exact


def _scanned(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def matrix(table: pa.Table) -> np.ndarray:
        flat = table.column("vector").combine_chunks().flatten().to_numpy()
        return flat.reshape(table.num_rows, -1)

    def run(_: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and queries.num_rows:
            data, asked = matrix(rows), matrix(queries)
            turn = rotation(data.shape[1])
            turned, turned_asked = data @ turn, asked @ turn
            ids = rows.column("id").to_numpy()
            bounds = queries.column("bound").to_numpy()
            for q, query in enumerate(queries.column("id").to_numpy()):
                at, scores = scan(
                    data, turned, asked[q], turned_asked[q], float(bounds[q]), k + 1
                )
                other = ids[at] != query
                near, scores = ids[at][other], scores[other]
                best = np.lexsort((near, scores))[:k]
                found.append((np.full(len(best), query), near[best], scores[best]))
        parts = zip(*found) if found else ([np.zeros(0)],) * 3
        query_ids, near_ids, scores = (np.concatenate(part) for part in parts)
        return pa.table(
            {
                "query_id": pa.array(query_ids.astype(np.int64)),
                "vec_id": pa.array(near_ids.astype(np.int64)),
                "score": pa.array(scores.astype(np.float64)),
            }
        )

    return run


def _listed(centroids: np.ndarray) -> Callable:
    def run(batches):
        norms = (centroids**2).sum(axis=1)
        for batch in batches:
            vectors = batch.column("vector").flatten().to_numpy()
            vectors = vectors.reshape(batch.num_rows, centroids.shape[1])
            nearest = (norms - 2 * vectors @ centroids.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest.astype(np.int32))],
                ["id", "vector", "list"],
            )

    return run


def _probing(centroids: np.ndarray, sizes: np.ndarray, least: int) -> Callable:
    """Each query's lists, nearest first, until they hold `least` vectors."""

    def run(batches):
        norms = (centroids**2).sum(axis=1)
        for batch in batches:
            vectors = batch.column("vector").flatten().to_numpy()
            vectors = vectors.reshape(batch.num_rows, centroids.shape[1])
            order = (norms - 2 * vectors @ centroids.T).argsort(axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            probes = 1 + (held < least).sum(axis=1).clip(max=len(sizes) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(
                        [o[:n].tolist() for o, n in zip(order, probes)], pa.list_(pa.int32())
                    ),
                ],
                ["id", "vector", "lists"],
            )

    return run


def probed_share(
    points: np.ndarray, centroids: np.ndarray, sizes: np.ndarray, k: int, recall: float = RECALL
) -> float:
    """The share of vectors whose lists hold `recall` of the k nearest of sampled vectors.

    Known neighbours within the sample: with fewer rows they are farther than the table's, so in
    lists no nearer. Clustered vectors need a small share, those without structure most of the lists.
    """
    tried = points[:: max(1, len(points) // TRIED)][:TRIED]
    norms = (points**2).sum(axis=1)
    to_lists = (centroids**2).sum(axis=1)
    home = np.concatenate(
        [
            (to_lists - 2 * points[at : at + 4096] @ centroids.T).argmin(axis=1)
            for at in range(0, len(points), 4096)
        ]
    )
    needed = []
    for query in tried:
        distances = norms - 2 * points @ query
        near = np.argpartition(distances, min(k, len(points) - 1))[: k + 1]
        order = (to_lists - 2 * centroids @ query).argsort(kind="stable")
        before = np.empty(len(order))
        before[order] = np.cumsum(sizes[order])
        needed.append(before[home[near]])
    return float(np.quantile(np.concatenate(needed), recall) / max(1, sizes.sum()))


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; a vector found twice counts once."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def nearest(
    df: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    probed: float | None = None,
) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: each query's k nearest found rows of `df`.

    Score: Euclidean distance of the original vectors in double precision; ties go to the
    smaller id. Rows with a query's id are not its candidates. Centroids are fitted on the
    SAMPLE vectors with the smallest id hashes; every vector is in a list. A query probes its
    nearest lists until they hold `probed` of all vectors (`probed_share`, if not given) and more
    than k. Its first list
    gives the distance to beat; the others are scanned against it.

    A list is cut into blocks of about CELL_ROWS vectors by a hash of the id, and its queries
    into blocks of CELL_QUERIES, so a list that holds most rows is many scans. The product of
    vectors and queries within probed lists is the work; nothing but the best k of a
    scan leaves it.

    Vectors that are null, zero, not of the commonest length or hold null or non-finite
    components take no part, nor do null ids. Repeated candidates count once, by their
    nearest; a repeated query id asks with each of its vectors. Empty tables give an empty
    one. Other columns are not read.
    """
    schema = "query_id long, vec_id long, score double"
    rows = cut(clean_vectors(df, key, vector))
    total = rows.count()
    asked = clean_vectors(queries, key, vector)
    sample = hash_sample(rows, "id", SAMPLE, "vector").toPandas()
    if not total:
        return rows.sparkSession.createDataFrame([], schema).select(
            "query_id", F.lit(0).alias("rank"), "vec_id", "score"
        )
    points = np.stack(sample["vector"].to_numpy())
    asked = asked.filter(F.size("vector") == points.shape[1])
    lists = int(min(MOST_LISTS, max(1, total**0.5 / 2), len(points)))
    centroids = fit_centroids(points, lists)
    listed = cut(rows.mapInArrow(_listed(centroids), "id long, vector array<double>, list int"))
    counted = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}
    sizes = np.array([counted.get(n, 0) for n in range(lists)])
    if probed is None:
        probed = probed_share(points, centroids, sizes, k)
    least = max(int(np.ceil(probed * total)), min(2 * k + 2, total))

    probes = cut(
        asked.mapInArrow(
            _probing(centroids, sizes, least), "id long, vector array<double>, lists array<int>"
        )
    )
    asking = probes.select("id", F.posexplode("lists").alias("turn", "list"))
    asking = {r["list"]: r["count"] for r in asking.groupBy("list").count().collect()}
    # at most MOST_LISTS entries each
    blocks = F.array(*[F.lit(int(-(-sizes[n] // CELL_ROWS) or 1)) for n in range(lists)])
    turns = F.array(*[F.lit(-(-asking.get(n, 1) // CELL_QUERIES)) for n in range(lists)])
    placed = listed.select(
        "id",
        "vector",
        "list",
        F.pmod(F.xxhash64("id"), F.get(blocks, F.col("list"))).alias("block"),
        F.explode(F.sequence(F.lit(0), F.get(turns, F.col("list")) - 1)).alias("turn"),
    )

    def scanned(which: DataFrame) -> DataFrame:
        spread = which.select(
            "id",
            "vector",
            "bound",
            "list",
            F.explode(
                F.sequence(F.lit(0).cast("long"), F.get(blocks, F.col("list")).cast("long") - 1)
            ).alias("block"),
            F.pmod(F.xxhash64("id"), F.get(turns, F.col("list"))).cast("int").alias("turn"),
        )
        cell = ("list", "block", "turn")
        return (
            placed.groupBy(*cell)
            .cogroup(spread.groupBy(*cell))
            .applyInArrow(_scanned(k), schema)
        )

    first = probes.select(
        "id", "vector", F.lit(float("inf")).alias("bound"), F.get("lists", F.lit(0)).alias("list")
    )
    opening = cut(scanned(first))
    bounds = (
        _top(opening, k)
        .filter(F.col("rank") == k)
        .select(F.col("query_id").alias("_id"), F.col("score").alias("_bound"))
    )
    rest = probes.join(bounds, F.col("id") == F.col("_id"), "left").select(
        "id",
        "vector",
        F.coalesce("_bound", F.lit(float("inf"))).alias("bound"),
        F.explode(F.slice("lists", 2, lists)).alias("list"),
    )
    found = opening.unionByName(scanned(rest))
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
