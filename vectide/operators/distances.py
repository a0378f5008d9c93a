"""Samples as weighted distributions over vectors: bandwidth, Gram sums, MMD."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_rank
from ..functions.vectors import gaussian_distances, squared_distances, squared_strips
from ..session import cut
from .checks import InvalidInput, check_counts, check_sigma, check_vectors, count_cells, flag
from .similarity import unit_vectors
from .tiles import TILE_ROWS, folded, map_tiles, matrix

# histogram resolution of one median pass
_BINS = 4096
# no two unit vectors are further apart
_FARTHEST = 2.0000001
# vectors whose pairs tell where the first pass looks, and the share of ranks it covers on either side
_FEW_ROWS = 1024
_ASIDE = 0.02
# distances that are few enough to be written: so many, or so many for each row
_FEW_VALUES = 1_000_000
_VALUES_A_ROW = 16
# samples handled together inside a tile
_SAMPLE_BLOCK = 1024


def sample_order(counts: DataFrame, samples: DataFrame | None) -> DataFrame:
    """`(sample_id, ord)`: the given order, or the order of the names."""
    if samples is not None and "ord" in samples.columns:
        return samples.select("sample_id", F.col("ord").cast("long").alias("ord"))
    source = counts if samples is None else samples
    return global_rank(source.select("sample_id").distinct(), "sample_id", name="ord")


def relative_abundance(counts: DataFrame, weighted: bool = True) -> DataFrame:
    """`(sample_id, protein_id, weight)`, weights of a sample summing to 1.

    Zero cells carry no weight, so proteins that are zero everywhere vanish.
    Totals are aggregated before the join: no sample is gathered in one task.
    """
    flag(weighted, "weighted")
    value = F.col("value").cast("double")
    seen = counts.select(
        "sample_id",
        "protein_id",
        (value if weighted else F.signum(value)).alias("value"),
    ).filter(F.col("value") > 0)
    totals = seen.groupBy("sample_id").agg(F.sum("value").alias("total"))
    return seen.join(totals, "sample_id").select(
        "sample_id", "protein_id", (F.col("value") / F.col("total")).alias("weight")
    )


def retained_units(weights: DataFrame, vectors: DataFrame) -> DataFrame:
    """Unit vectors of the proteins that carry weight in some sample."""
    seen = weights.select("protein_id").distinct()
    return unit_vectors(vectors).join(seen, "protein_id", "left_semi")


@dataclass(frozen=True)
class Catalog:
    """Vectors of a catalog with identical ones collapsed.

    distinct  `(ord, embedding, copies)`, one row per distinct vector
    rep       `(protein_id, rep)`, the `ord` of the row that stands for a protein
    proteins  number of proteins
    rows      number of distinct vectors
    """

    distinct: DataFrame
    rep: DataFrame
    proteins: int
    rows: int

    @property
    def has_copies(self) -> bool:
        return self.rows < self.proteins


def collapse_copies(units: DataFrame) -> Catalog:
    """Stand one row with a multiplicity for every crowd of identical vectors.

    Identical vectors have identical kernel rows, so nothing downstream sees a
    crowd. The table is materialised: every tile pass reads it.
    """
    units = units.persist()
    distinct = cut(
        units.groupBy("embedding")
        .agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("copies"))
        .select("ord", "embedding", "copies")
    )
    proteins, rows = distinct.agg(F.sum("copies"), F.count(F.lit(1))).first()
    proteins, rows = int(proteins or 0), int(rows)
    if rows == proteins:
        rep = units.select("protein_id", F.col("ord").alias("rep"))
    else:
        rep = units.join(
            distinct.select("embedding", F.col("ord").alias("rep")), "embedding"
        ).select("protein_id", "rep")
    return Catalog(distinct, rep, proteins, rows)


# --- median pair distance -------------------------------------------------------

_HISTOGRAM = "target int, bin int, n long, low double, high double"
_VALUES = "target int, value double, n long"
# a distance is within this of the root of its square
_ROOT_SLACK = 1e-12


def _tile_pairs(left: pa.Table, right: pa.Table | None):
    """Squared distances of a tile strip by strip, with the copies of their rows and columns.

    What is not a pair of its own (the lower triangle of a block with itself) is infinite.
    """
    a, na = matrix(left), left["copies"].to_numpy()
    if right is not None:
        nb = right["copies"].to_numpy()
        for at, d2 in squared_strips(a, matrix(right)):
            yield d2, na[at : at + len(d2)], nb
        return
    whole = squared_distances(a, a)
    whole[np.tril_indices(len(a))] = np.inf
    yield whole, na, na


def _inside(left: pa.Table, right: pa.Table | None, low: float, high: float):
    """Number of the tile's pairs below `low`; distances from `low` to `high`, their multiplicities."""
    bottom, top = low * low * (1 - _ROOT_SLACK), high * high * (1 + _ROOT_SLACK)
    below = 0
    found, times = [], []
    for d2, na, nb in _tile_pairs(left, right):
        under = d2 < bottom
        if (na == 1).all() and (nb == 1).all():
            below += int(np.count_nonzero(under))
        else:
            below += int(na @ (under @ nb))
        at = np.flatnonzero(~under & (d2 <= top))
        found.append(np.sqrt(d2.ravel()[at]))
        times.append(na[at // len(nb)] * nb[at % len(nb)])
    if right is None:
        # copies of one vector are at distance 0 from each other
        own = left["copies"].to_numpy()
        found.append(np.zeros(1))
        times.append(np.array([(own * (own - 1) // 2).sum()]))
    distance, n = np.concatenate(found), np.concatenate(times)
    short = distance < low
    below += int(n[short].sum())
    keep = ~short & (distance <= high) & (n > 0)
    return below, distance[keep], n[keep]


def _histogram_tile(intervals: list[tuple[float, float]]):
    def fn(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        for target, (low, high) in enumerate(intervals):
            below, d, n = _inside(left, right, low, high)
            width = (high - low) / _BINS
            if width > 0:
                at = np.minimum(((d - low) / width).astype(np.int64), _BINS - 1)
            else:
                at = np.zeros(len(d), dtype=np.int64)
            total = np.zeros(_BINS, dtype=np.int64)
            lows = np.full(_BINS, np.inf)
            highs = np.full(_BINS, -np.inf)
            np.add.at(total, at, n)
            np.minimum.at(lows, at, d)
            np.maximum.at(highs, at, d)
            used = np.flatnonzero(total)
            rows = len(used) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows, target, dtype=np.int32)),
                    pa.array(np.append(used, -1).astype(np.int32)),
                    pa.array(np.append(total[used], below)),
                    pa.array(np.append(lows[used], -1.0)),
                    pa.array(np.append(highs[used], -1.0)),
                ],
                names=["target", "bin", "n", "low", "high"],
            )

    return fn


def _values_tile(intervals: list[tuple[float, float]]):
    def fn(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        for target, (low, high) in enumerate(intervals):
            _, d, n = _inside(left, right, low, high)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(d), target, dtype=np.int32)), pa.array(d), pa.array(n)],
                names=["target", "value", "n"],
            )

    return fn


def _narrow(bins: list, span: tuple[float, float], rank: int):
    """`(span, rank in it, pairs in it)` of the bin that holds `rank`.

    If the rank lies outside of `span`, what is below or above it is the next span.
    """
    left = rank
    for r in sorted(bins, key=lambda r: r["bin"]):
        if left < r["n"]:
            return ((0.0, span[0]) if r["bin"] < 0 else (r["low"], r["high"])), left, r["n"]
        left -= r["n"]
    if span[1] >= _FARTHEST:
        raise RuntimeError("pair distances changed between two passes")
    return (span[1], _FARTHEST), rank, None


def _value_at(values: DataFrame, span: tuple[float, float], rank: int) -> float:
    """The value of `rank` in a table `(value, n)` whose values lie in `span`."""
    while span[0] < span[1]:
        low, high = span
        at = F.least(F.floor((F.col("value") - low) / ((high - low) / _BINS)), F.lit(_BINS - 1))
        place = F.when(F.col("value") < low, -1).otherwise(at).cast("int")
        bins = (
            values.filter(F.col("value") <= high)
            .groupBy(place.alias("bin"))
            .agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
            .collect()  # at most one histogram of _BINS bins
        )
        span, _, n = _narrow(bins, span, rank)
        if n is None:
            raise RuntimeError("pair distances changed between two passes")
    return span[0]


def _likely_span(catalog: Catalog) -> tuple[float, float]:
    """Distances between which the middle rank most likely lies, from pairs of a few vectors.

    Only a place to begin: ranks are counted over all pairs, and one outside is looked for there.
    """
    picked = catalog.distinct.orderBy(F.xxhash64("ord"), "ord").limit(_FEW_ROWS)
    few = picked.select("embedding", "copies").toArrow()
    a, copies = matrix(few), few["copies"].to_numpy()
    upper = np.triu_indices(len(a), 1)
    distance = np.append(np.sqrt(squared_distances(a, a)[upper]), 0.0)
    times = np.append(copies[upper[0]] * copies[upper[1]], (copies * (copies - 1) // 2).sum())
    order = np.argsort(distance)
    share = np.cumsum(times[order]) / max(times.sum(), 1)
    at = np.searchsorted(share, [0.5 - _ASIDE, 0.5 + _ASIDE])
    low, high = distance[order][np.minimum(at, len(order) - 1)]
    return float(low), float(high)


def pair_median(catalog: Catalog, tile_rows: int = TILE_ROWS) -> float | None:
    """Exact median of all pair distances, or None without a pair.

    A pass over the tiles returns histograms, never distances, and narrows the interval that holds
    the middle rank to one bin. Once a bin holds few distances for the rows there are, one more pass
    writes these as a table, in which the rank is found. Two passes, then, unless the first
    interval was a bad guess or many distances are next to equal.
    """
    total = catalog.proteins
    pairs = total * (total - 1) // 2
    if not pairs:
        return None
    tiles = lambda fn, schema, keys, how: map_tiles(
        catalog.distinct, "ord", fn, schema, tile_rows, catalog.rows, folded(keys, how)
    )
    ranks = sorted({(pairs - 1) // 2, pairs // 2})
    spans = [_likely_span(catalog)] * len(ranks)
    # ranks inside the spans and the pairs there, once counted
    inner: list[tuple[int, int | None]] = [(0, None)] * len(ranks)
    few = max(_FEW_VALUES, _VALUES_A_ROW * catalog.rows)
    while (live := [t for t, span in enumerate(spans) if inner[t][1] is None or span[0] < span[1]]):
        # both ranks usually share an interval: one pass serves them
        wanted = sorted({spans[t] for t in live})
        if all(inner[t][1] is not None and inner[t][1] <= few for t in live):
            values = cut(
                tiles(_values_tile(wanted), _VALUES, ["target", "value"], {"n": "sum"})
            )
            for t in live:
                mine = values.filter(F.col("target") == wanted.index(spans[t]))
                value = _value_at(mine, spans[t], inner[t][0])
                spans[t] = (value, value)
            break
        found = (
            tiles(
                _histogram_tile(wanted),
                _HISTOGRAM,
                ["target", "bin"],
                {"n": "sum", "low": "min", "high": "max"},
            )
            .groupBy("target", "bin")
            .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
            .collect()  # at most two histograms of _BINS bins
        )
        for t in live:
            mine = [r for r in found if r["target"] == wanted.index(spans[t])]
            spans[t], left, n = _narrow(mine, spans[t], ranks[t])
            inner[t] = (left, n)
    return float(sum(low for low, _ in spans) / len(spans))


def sigma_or_fail(median: float | None) -> float:
    if median is None:
        return 1.0
    if median == 0:
        raise InvalidInput(
            "The median protein distance is zero. Check for identical embeddings, "
            "or pass a positive `sigma`."
        )
    return median


def median_sigma(
    counts: DataFrame, x: DataFrame, weighted: bool = True, tile_rows: int = TILE_ROWS
) -> float:
    """Default bandwidth of `sample_mmd`: median distance of retained proteins."""
    weights = relative_abundance(counts, weighted)
    catalog = collapse_copies(retained_units(weights, x))
    return sigma_or_fail(pair_median(catalog, tile_rows))


# --- Gram sums ------------------------------------------------------------------

_GRAM = "sa long, sb long, g double"


def _dense(table: pa.Table, samples: np.ndarray) -> np.ndarray:
    """Weights of the tile's rows on `samples` (sorted) as rows x samples."""
    column = table["samples"].combine_chunks()
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    which = column.flatten().to_numpy()
    at = np.minimum(np.searchsorted(samples, which), len(samples) - 1)
    hit = samples[at] == which
    out = np.zeros((len(column), len(samples)))
    out[rows[hit], at[hit]] = table["weights"].combine_chunks().flatten().to_numpy()[hit]
    return out


def _samples_of(table: pa.Table) -> np.ndarray:
    return np.unique(table["samples"].combine_chunks().flatten().to_numpy())


def _gram_tile(sigma: float):
    def fn(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        a = matrix(left)
        other = left if right is None else right
        b = a if right is None else matrix(right)
        kernel = gaussian_distances(a, b, sigma)
        sides_a, sides_b = _samples_of(left), _samples_of(other)
        for at_b in range(0, len(sides_b), _SAMPLE_BLOCK):
            sb = sides_b[at_b : at_b + _SAMPLE_BLOCK]
            spread = kernel @ _dense(other, sb)
            for at_a in range(0, len(sides_a), _SAMPLE_BLOCK):
                sa = sides_a[at_a : at_a + _SAMPLE_BLOCK]
                part = _dense(left, sa).T @ spread
                i = np.repeat(sa, len(sb))
                j = np.tile(sb, len(sa))
                g = part.ravel()
                if right is None:
                    # the tile is symmetric: one triangle says it all
                    keep = i <= j
                    i, j, g = i[keep], j[keep], g[keep]
                else:
                    # met in one order only; the mirror image adds the rest
                    g = np.where(i == j, 2.0 * g, g)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(g)],
                    names=["sa", "sb", "g"],
                )

    return fn


def gram_sums(
    catalog: Catalog,
    weights: DataFrame,
    order: DataFrame,
    sigma: float,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """`(sa, sb, g)` with sa <= sb: weighted kernel sums between samples.

    Tiles multiply their block of the kernel by both weight blocks and emit
    only sums per sample pair, which Spark adds up.
    """
    placed = weights.join(order.withColumnRenamed("ord", "s"), "sample_id").join(
        catalog.rep, "protein_id"
    )
    if catalog.has_copies:
        placed = placed.groupBy("rep", "s").agg(F.sum("weight").alias("weight"))
    # at most one entry per sample
    entries = F.sort_array(F.collect_list(F.struct("s", F.col("weight").alias("w"))))
    per_vector = placed.groupBy(F.col("rep").alias("ord")).agg(entries.alias("entries"))
    # sent to the tiles as two arrays: as a struct an entry takes twice the bytes of its numbers
    rows = catalog.distinct.join(per_vector, "ord").select(
        "ord",
        "embedding",
        F.col("entries.s").alias("samples"),
        F.col("entries.w").alias("weights"),
    )
    parts = map_tiles(
        rows,
        "ord",
        _gram_tile(sigma),
        _GRAM,
        tile_rows,
        catalog.rows,
        folded(["sa", "sb"], {"g": "sum"}),
    )
    return parts.groupBy("sa", "sb").agg(F.sum("g").alias("g"))


def gram_to_distance(gram: DataFrame, order: DataFrame, sigma: float) -> DataFrame:
    own = gram.filter(F.col("sa") == F.col("sb"))
    a = own.select("sa", F.col("g").alias("g_aa"))
    b = own.select("sb", F.col("g").alias("g_bb"))
    name_a = order.select(F.col("ord").alias("sa"), F.col("sample_id").alias("sample_a"))
    name_b = order.select(F.col("ord").alias("sb"), F.col("sample_id").alias("sample_b"))
    squared = F.greatest(
        F.col("g_aa") + F.col("g_bb") - F.lit(2.0) * F.col("g"), F.lit(0.0)
    )
    return (
        gram.filter(F.col("sa") < F.col("sb"))
        .join(a, "sa")
        .join(b, "sb")
        .join(name_a, "sa")
        .join(name_b, "sb")
        .select(
            "sample_a",
            "sample_b",
            F.sqrt(squared).alias("distance"),
            F.lit(float(sigma)).alias("sigma"),
        )
    )


def mmd_of_weights(
    weights: DataFrame,
    x: DataFrame,
    order: DataFrame,
    sigma: float | None,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    weights = weights.persist()
    units = retained_units(weights, x)
    catalog = collapse_copies(units)
    if sigma is None:
        sigma = sigma_or_fail(pair_median(catalog, tile_rows))
    # one row per sample pair; materialised because three branches read it
    gram = cut(gram_sums(catalog, weights, order, sigma, tile_rows))
    weights.unpersist()
    return gram_to_distance(gram, order, sigma)


def sample_mmd(
    counts: DataFrame,
    x: DataFrame,
    weighted: bool = True,
    sigma: float | None = None,
    samples: DataFrame | None = None,
    tile_rows: int = TILE_ROWS,
    validate: bool = True,
) -> DataFrame:
    """Maximum mean discrepancy between samples: `(sample_a, sample_b, distance, sigma)`.

    Each sample is its abundance-weighted distribution over unit vectors; the
    kernel is exp(-(1 - cosine) / sigma^2). `sigma=None` takes the exact median
    distance between the proteins seen in any sample; pass the returned value
    to hold it fixed. `samples` gives the sample order and names samples that
    must not be empty.
    """
    flag(weighted, "weighted")
    if sigma is not None:
        check_sigma(sigma)
    cells = cut(count_cells(counts))
    if validate:
        check_vectors(x)
        check_counts(cells, x, samples)
    order = sample_order(cells, samples)
    weights = relative_abundance(cells, weighted)
    return mmd_of_weights(weights, x, order, sigma, tile_rows)


def kernel_row_sums(
    catalog: Catalog, sigma: float, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """`(ord, density)`: kernel mass of every vector over the whole catalog."""

    def fn(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        a = matrix(left)
        other = left if right is None else right
        b = a if right is None else matrix(right)
        kernel = gaussian_distances(a, b, sigma)
        sums = [(left, kernel @ other["copies"].to_numpy().astype(float))]
        if right is not None:
            sums.append((right, left["copies"].to_numpy().astype(float) @ kernel))
        for table, mass in sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(table["ord"].to_numpy()), pa.array(mass)],
                names=["ord", "density"],
            )

    parts = map_tiles(
        catalog.distinct,
        "ord",
        fn,
        "ord long, density double",
        tile_rows,
        catalog.rows,
        folded(["ord"], {"density": "sum"}),
    )
    return parts.groupBy("ord").agg(F.sum("density").alias("density"))

