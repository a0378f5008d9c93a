"""Regions of near-copies, principal coordinates, and group outlines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bins import PlotData
from .checks import (
    InvalidInput,
    check_counts,
    check_sigma,
    check_vectors,
    count_cells,
    finite_number,
    flag,
    whole_number,
)
from .components import connected_components
from .distances import (
    Catalog,
    collapse_copies,
    mmd_of_weights,
    pair_median,
    relative_abundance,
    retained_units,
    sample_order,
    sigma_or_fail,
)
from .similarity import threshold_links
from .tiles import TILE_ROWS

_EXTRA_AXES = 8
# products of the centred matrix with a block of vectors before giving up
_MOST_PRODUCTS = 60
_RESIDUAL = 1e-11
_MASS_DECIMALS = 12


def regions(
    catalog: Catalog, min_sim: float, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """`(protein_id, region)`: proteins linked by cosines of at least `min_sim`."""
    # written: a round of the components reads its edges more than once, and each time is all pairs
    links = cut(threshold_links(catalog.distinct, min_sim, tile_rows, catalog.rows))
    nodes = catalog.distinct.select(F.col("ord").alias("node"))
    parts = connected_components(links, nodes).withColumnRenamed("node", "rep")
    return catalog.rep.join(parts, "rep").select(
        "protein_id", F.col("component").alias("region")
    )


def region_mass(weights: DataFrame, region: DataFrame) -> DataFrame:
    """`(region, mass)`: summed sample weights, a region named by its first protein."""
    return (
        weights.join(region, "protein_id")
        .groupBy("region")
        .agg(F.sum("weight").alias("mass"))
    )


def heaviest(mass: DataFrame, drop: int) -> DataFrame:
    return mass.orderBy(
        F.round("mass", _MASS_DECIMALS).desc(), F.col("region").asc()
    ).limit(drop)


def centred(distances: DataFrame, order: DataFrame) -> DataFrame:
    """Double-centred -D^2/2 as `(sa, sb, b)` over all ordered sample pairs."""
    a = order.select(F.col("sample_id").alias("sample_a"), F.col("ord").alias("sa"))
    b = order.select(F.col("sample_id").alias("sample_b"), F.col("ord").alias("sb"))
    half = (
        distances.join(a, "sample_a")
        .join(b, "sample_b")
        .select("sa", "sb", (F.col("distance") * F.col("distance")).alias("d2"))
    )
    square = half.unionByName(
        half.select(F.col("sb").alias("sa"), F.col("sa").alias("sb"), "d2")
    ).unionByName(
        order.select(
            F.col("ord").alias("sa"), F.col("ord").alias("sb"), F.lit(0.0).alias("d2")
        )
    )
    rows = square.groupBy("sa").agg(F.avg("d2").alias("mean_a"))
    cols = rows.select(F.col("sa").alias("sb"), F.col("mean_a").alias("mean_b"))
    # every row has one cell per sample, so the mean of row means is the mean
    grand = rows.agg(F.avg("mean_a").alias("mean_all"))
    return (
        square.join(rows, "sa")
        .join(cols, "sb")
        .select(
            "sa",
            "sb",
            (
                F.lit(-0.5)
                * (
                    F.col("d2")
                    - F.col("mean_a")
                    - F.col("mean_b")
                    + grand.scalar()
                )
            ).alias("b"),
        )
    )


def _image(b: DataFrame, ids: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The matrix times a block of vectors, as a Spark aggregate."""
    names = [f"q{c}" for c in range(block.shape[1])]
    q = pd.DataFrame(block, columns=names)
    q.insert(0, "sb", ids)
    return (
        b.join(b.sparkSession.createDataFrame(q), "sb")
        .groupBy("sa")
        .agg(*[F.sum(F.col("b") * F.col(n)).alias(n) for n in names])
        .toPandas()
        .sort_values("sa")[names]
        .to_numpy()
    )


def _top_axes(b: DataFrame, ids: np.ndarray, k: int):
    """The k largest eigenpairs by a block Krylov method; products are Spark aggregates.

    The basis grows by the image of its last block, and the largest (not the largest in size)
    Ritz values are taken, so negative eigenvalues cannot crowd the block. It ends when
    the pairs' residuals vanish or the basis spans all samples.
    """
    width = min(len(ids), k + _EXTRA_AXES)
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(len(ids), width)))[0]
    basis = np.empty((len(ids), 0))
    images = np.empty((len(ids), 0))
    for _ in range(_MOST_PRODUCTS):
        basis = np.hstack([basis, block])
        images = np.hstack([images, _image(b, ids, block)])
        small = basis.T @ images
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1][:k], turn[:, ::-1][:, :k]
        vectors = basis @ turn
        residual = np.linalg.norm(images @ turn - vectors * ritz, axis=0).max()
        if residual <= _RESIDUAL * max(np.abs(ritz).max(), 1e-300):
            return ritz, vectors
        fresh = images[:, -block.shape[1] :]
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        u, size, _ = np.linalg.svd(fresh, full_matrices=False)
        room = len(ids) - basis.shape[1]
        block = u[:, size > 1e-13 * max(np.abs(ritz).max(), 1e-300)][:, :room]
        if not block.shape[1]:
            return ritz, vectors
    raise RuntimeError(f"Principal coordinates did not converge: residual {residual:.1e}.")


def pcoa(distances: DataFrame, samples: DataFrame, k: int = 2):
    """Classical scaling: `(sample_id, ord, pco1..k)`, eigenvalues, and the trace.

    `samples` is `(sample_id, ord)`. The trace is the sum of all eigenvalues; for Euclidean
    distances such as MMD it is the sum of the positive ones. Only blocks of one value per
    sample leave Spark, at every size. An axis points to the side of its largest
    coordinate.
    """
    order = samples.select("sample_id", F.col("ord").cast("long").alias("ord"))
    b = cut(centred(distances, order))
    ids = order.select("ord").orderBy("ord").toPandas()["ord"].to_numpy()
    trace = b.filter("sa = sb").agg(F.sum("b")).first()[0]
    values, vectors = _top_axes(b, ids, k)
    floor = 1e-12 * max(abs(values[0]), 1e-300)
    if len(values) < k or values[k - 1] <= floor:
        raise InvalidInput(
            "The samples differ along fewer than two principal coordinates."
        )
    axes = vectors[:, :k] * np.sqrt(values[:k])
    lead = np.abs(axes).argmax(axis=0)
    axes = axes * np.sign(axes[lead, np.arange(k)])
    table = pd.DataFrame(axes, columns=[f"pco{c + 1}" for c in range(k)])
    table.insert(0, "ord", ids)
    points = order.join(distances.sparkSession.createDataFrame(table), "ord")
    return points.select("sample_id", "ord", *table.columns[1:]), values.tolist(), float(trace)


def _hull(points: np.ndarray) -> np.ndarray:
    """Positions of the strict hull corners, counter-clockwise."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    keep = np.ones(len(order), dtype=bool)
    keep[1:] = np.any(np.diff(points[order], axis=0) != 0, axis=1)
    order = order[keep]
    if len(order) < 3:
        return order

    def chain(sequence):
        out: list[int] = []
        for p in sequence:
            while len(out) > 1:
                u = points[out[-1]] - points[out[-2]]
                v = points[p] - points[out[-2]]
                if u[0] * v[1] - u[1] * v[0] > 0:
                    break
                out.pop()
            out.append(p)
        return out

    lower, upper = chain(order), chain(order[::-1])
    return np.array(lower[:-1] + upper[:-1])


def group_hulls(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Convex hull corners of every group: the input row plus `corner`, 1-based.

    Every task trims its rows to hulls, then the hull of what they kept is
    taken: exact, and no group is gathered whole.
    """
    columns = points.columns
    schema = points.schema

    def trim(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one running hull per group and task
        kept: dict = {}
        for frame in frames:
            for name, part in frame.groupby(group, sort=False):
                both = pd.concat([kept[name], part]) if name in kept else part
                at = _hull(both[[x, y]].to_numpy(dtype=float))
                kept[name] = both.iloc[at]
        for part in kept.values():
            yield part[columns]

    def outline(frame: pd.DataFrame) -> pd.DataFrame:
        at = _hull(frame[[x, y]].to_numpy(dtype=float))
        out = frame.iloc[at].copy()
        out["corner"] = np.arange(1, len(out) + 1)
        return out

    kept = points.mapInPandas(trim, schema)
    corners = schema.simpleString()[len("struct<") : -1] + ",corner:int"
    return kept.groupBy(group).applyInPandas(outline, corners)


def _check_plot_arguments(drop, min_sim) -> None:
    if not whole_number(drop):
        raise InvalidInput("`drop` must be a whole number of regions.")
    if not finite_number(min_sim) or not 0 <= min_sim <= 1:
        raise InvalidInput("`min_sim` must be a single number in [0, 1].")


def drop_regions(
    weights: DataFrame,
    x: DataFrame,
    order: DataFrame,
    drop: int,
    min_sim: float,
    weighted: bool = True,
    sigma: float | None = None,
    tile_rows: int = TILE_ROWS,
    strict: bool = True,
):
    """Weights without the `drop` heaviest regions, the bandwidth, and a report.

    The bandwidth is that of the full set, so the kernel does not move. Samples that hold only
    dropped regions are an error; unless `strict`, they are left out, all of them if no region stays.
    """
    units = retained_units(weights, x)
    catalog = collapse_copies(units)
    if sigma is None:
        sigma = sigma_or_fail(pair_median(catalog, tile_rows))
    region = cut(regions(catalog, min_sim, tile_rows))
    mass = cut(region_mass(weights, region))
    n_regions = mass.count()
    if strict and drop >= n_regions:
        raise InvalidInput(f"`drop` must be below the {n_regions} regions.")
    gone = heaviest(mass, drop)
    top = gone.collect() if drop else []
    dropped = region.join(gone.select("region"), "region", "left_semi")
    kept = weights.join(dropped.select("protein_id"), "protein_id", "left_anti")
    left = kept.groupBy("sample_id").agg(F.sum("weight").alias("left"))
    shares = order.select("sample_id").join(left, "sample_id", "left")
    bare = shares.filter(F.col("left").isNull()).limit(5).collect()
    if bare and strict:
        names = ", ".join(str(r["sample_id"]) for r in bare)
        raise InvalidInput(
            f"Sample(s) {names} hold only dropped regions; lower `drop`."
        )
    message = None
    if drop:
        per_protein = (
            weights.join(dropped, "protein_id")
            .groupBy("region", "protein_id")
            .agg(F.sum("weight").alias("mass"))
            .join(units.select("protein_id", "ord"), "protein_id")
        )
        lead = {
            r["region"]: r
            for r in per_protein.groupBy("region")
            .agg(
                F.min(
                    F.struct(
                        (-F.round("mass", _MASS_DECIMALS)).alias("m"),
                        "ord",
                        "protein_id",
                    )
                ).alias("best"),
                F.count(F.lit(1)).alias("n"),
            )
            .collect()
        }
        share = 100.0 * (1.0 - shares.agg(F.avg(F.coalesce("left", F.lit(0.0)))).first()[0])
        described = ", ".join(
            f"{lead[r['region']]['best']['protein_id']} "
            f"({lead[r['region']]['n']} protein{'s' if lead[r['region']]['n'] > 1 else ''})"
            for r in top
        )
        message = (
            f"Dropped {drop} region{'s' if drop > 1 else ''}, {share:.0f}% of "
            f"abundance: {described}."
        )
    survivors = relative_abundance(
        kept.withColumnRenamed("weight", "value"), weighted
    )
    return survivors, sigma, message


def plot_pcoa(
    counts: DataFrame,
    x: DataFrame,
    group: DataFrame | None = None,
    drop: int = 2,
    min_sim: float = 0.9,
    weighted: bool = True,
    sigma: float | None = None,
    samples: DataFrame | None = None,
    tile_rows: int = TILE_ROWS,
) -> PlotData:
    """PCoA table of `sample_mmd` without the `drop` heaviest protein regions.

    `group` is `(sample_id, group)`. The data holds `(sample_id, pco1, pco2)`
    and the group; labels hold the axis titles, the message and the hulls.
    """
    flag(weighted, "weighted")
    if sigma is not None:
        check_sigma(sigma)
    check_vectors(x)
    counts = cut(count_cells(counts))
    check_counts(counts, x, samples)
    _check_plot_arguments(drop, min_sim)
    order = cut(sample_order(counts, samples))
    if order.count() < 3:
        raise InvalidInput("A PCoA needs at least 3 samples.")
    if group is not None:
        labelled = order.join(group, "sample_id", "left")
        odd = labelled.groupBy("sample_id").agg(
            F.count(F.lit(1)).alias("n"), F.count("group").alias("labels")
        )
        if odd.filter("n <> 1 or labels <> 1").limit(1).count():
            raise InvalidInput("`group` must give one label per sample.")
    weights = relative_abundance(counts, weighted)
    survivors, sigma, message = drop_regions(
        weights, x, order, int(drop), float(min_sim), weighted, sigma, tile_rows
    )
    distances = mmd_of_weights(survivors, x, order, sigma, tile_rows)
    # MMD is Euclidean: the trace is the sum of the positive eigenvalues
    points, values, trace = pcoa(distances, order)
    share = [100.0 * value / trace for value in values]
    labels = {
        "x": f"PCo1 ({share[0]:.0f}%)",
        "y": f"PCo2 ({share[1]:.0f}%)",
        "message": message,
        "sigma": sigma,
    }
    data = points.select("sample_id", "pco1", "pco2")
    if group is not None:
        data = data.join(group.select("sample_id", "group"), "sample_id")
        labels["hulls"] = group_hulls(data, "group", "pco1", "pco2")
    return PlotData(data, labels)
