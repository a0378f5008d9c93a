"""Distances between samples on features, and tests on any sample distance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .checks import InvalidInput, whole_number
from .distances import sample_order
from .permutations import check_design, group_shape, permuted

_SAMPLE_BLOCK = 512
_CHUNK_CELLS = 200_000
# pairs times permutations that a task compares at once
_TILE_CELLS = 4_000_000
# statistics this close to the observed one count as equal to it
_TIE = 1.5e-8


# --- Bray-Curtis ----------------------------------------------------------------


def _shared_tile(
    key: tuple[pa.Scalar, ...], frames: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(frames))
    ti, tj = key[1].as_py(), key[2].as_py()
    samples, s = np.unique(table["s"].to_numpy(), return_inverse=True)
    block = np.empty(len(samples), dtype=np.int64)
    block[s] = table["_block"].to_numpy()
    names = table["feature"].combine_chunks().dictionary_encode().indices
    f = names.fill_null(-1).to_numpy()
    cells = np.zeros((len(samples), int(f.max(initial=-1)) + 1))
    real = f >= 0
    cells[s[real], f[real]] = table["value"].to_numpy()[real]
    right = np.flatnonzero(block == tj)
    for a in np.flatnonzero(block == ti):
        partners = right[right > a] if ti == tj else right
        if not len(partners):
            continue
        shared = np.minimum(cells[partners], cells[a]).sum(axis=1)
        one = np.full(len(partners), samples[a])
        two = samples[partners]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.minimum(one, two)),
                pa.array(np.maximum(one, two)),
                pa.array(shared),
            ],
            names=["sa", "sb", "shared"],
        )


def bray_curtis(
    counts: DataFrame,
    feature: str = "protein_id",
    samples: DataFrame | None = None,
) -> DataFrame:
    """Bray-Curtis dissimilarity `(sample_a, sample_b, distance)` on `value`.

    The table is cut into feature chunks and sample blocks; a task sums the
    shared amounts of its sample pairs over its features, so a feature held by
    every sample is never paired out as rows.
    """
    order = sample_order(counts, samples)
    value = F.col("value").cast("double")
    cells = (
        counts.select("sample_id", F.col(feature).cast("string").alias("feature"), value.alias("value"))
        .filter(F.col("value") > 0)
        .join(order.withColumnRenamed("ord", "s"), "sample_id")
        .select("s", "feature", "value")
    )
    shape = cells.agg(F.count(F.lit(1)).alias("n")).first()
    chunks = max(1, math.ceil(shape["n"] / _CHUNK_CELLS))
    blocks = max(1, math.ceil(order.count() / _SAMPLE_BLOCK))
    chunk = F.pmod(F.xxhash64("feature"), F.lit(chunks)).cast("int")
    # a roster chunk without features meets every sample pair once, so pairs
    # that share nothing are in the result too
    roster = order.select(
        F.col("ord").alias("s"),
        F.lit(None).cast("string").alias("feature"),
        F.lit(0.0).alias("value"),
        F.lit(-1).alias("_chunk"),
    )
    spread = (
        cells.withColumn("_chunk", chunk)
        .unionByName(roster)
        .withColumn("_block", F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("_ti", F.least("_block", "_other"))
        .withColumn("_tj", F.greatest("_block", "_other"))
        .drop("_other")
    )
    shared = (
        spread.groupBy("_chunk", "_ti", "_tj")
        .applyInArrow(_shared_tile, "sa long, sb long, shared double")
        .groupBy("sa", "sb")
        .agg(F.sum("shared").alias("shared"))
    )
    totals = cells.groupBy("s").agg(F.sum("value").alias("total"))
    named = order.join(totals, order["ord"] == totals["s"], "left").select(
        "sample_id", "ord", F.coalesce("total", F.lit(0.0)).alias("total")
    )
    a = named.select(
        F.col("ord").alias("sa"),
        F.col("sample_id").alias("sample_a"),
        F.col("total").alias("total_a"),
    )
    b = named.select(
        F.col("ord").alias("sb"),
        F.col("sample_id").alias("sample_b"),
        F.col("total").alias("total_b"),
    )
    total = F.col("total_a") + F.col("total_b")
    return (
        shared.join(a, "sa")
        .join(b, "sb")
        .select(
            "sample_a",
            "sample_b",
            F.try_divide(
                F.greatest(total - F.lit(2.0) * F.col("shared"), F.lit(0.0)), total
            ).alias("distance"),
        )
    )


# --- PERMANOVA ------------------------------------------------------------------


def _within_tile(
    key: tuple[pa.Scalar, ...], pairs: pa.Table, labels: pa.Table
) -> pa.Table:
    """Sums of squares within groups, for every permutation, over the pairs of two blocks."""
    names = labels["sample_id"].combine_chunks()
    i = pc.index_in(pairs["sample_a"], names)
    j = pc.index_in(pairs["sample_b"], names)
    known = pc.and_(pc.is_valid(i), pc.is_valid(j)).to_numpy()
    i = i.fill_null(0).to_numpy()[known]
    j = j.fill_null(0).to_numpy()[known]
    d2 = pairs["distance"].to_numpy()[known] ** 2
    codes, shares = (
        labels[c].combine_chunks().flatten().to_numpy().reshape(len(names), -1).T
        for c in ("codes", "shares")
    )
    within = np.zeros(len(codes))
    step = max(1, _TILE_CELLS // max(1, len(i)))
    for at in range(0, len(codes), step):
        part, share = codes[at : at + step], shares[at : at + step]
        mine = part[:, i]
        within[at : at + step] = ((mine == part[:, j]) * share[:, i]) @ d2
    return pa.table(
        {
            "perm": pa.array(np.arange(len(codes), dtype=np.int64)),
            "within": pa.array(within),
            "total": pa.array(np.full(len(codes), d2.sum())),
        }
    )


def permanova(
    distances: DataFrame,
    samples: DataFrame,
    group: str = "group",
    permutations: int = 999,
    block: str | None = None,
    seed: int = 1,
) -> DataFrame:
    """One-way PERMANOVA: one row of sums of squares, R2, pseudo-F and p.

    Permutations are a table (`permuted`), with a row of labels for each sample. Samples are hashed
    into blocks; a task holds the pairs of two blocks and these blocks' labels, and returns one
    sum for each permutation, so pairs are never multiplied by permutations and
    neither pairs nor samples reach the driver. `block` permutes within its levels.
    """
    if not whole_number(permutations):
        raise InvalidInput("`permutations` must be a whole number.")
    design = cut(check_design(samples, group, block))
    n, a = group_shape(design, "PERMANOVA")
    # one row for each group
    groups = design.groupBy("group").agg((F.lit(1.0) / F.count(F.lit(1))).alias("share"))
    groups = groups.withColumn("code", F.row_number().over(Window.orderBy("group")))
    coded = design.join(groups, "group").withColumn("label", F.struct("code", "share"))
    drawn = coded.select(F.lit(0).alias("perm"), "sample_id", "label")
    if permutations:
        drawn = drawn.unionByName(permuted(coded, "label", int(permutations), seed))
    blocks = math.ceil(n / _SAMPLE_BLOCK)
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), F.lit(blocks - 1)),
        lambda k: F.struct(F.least("_b", k).alias("ti"), F.greatest("_b", k).alias("tj")),
    )
    labels = (
        drawn.groupBy("sample_id")
        .agg(F.array_sort(F.collect_list(F.struct("perm", "label"))).alias("_rows"))
        .select(
            "sample_id",
            F.transform("_rows", lambda r: r["label"]["code"]).alias("codes"),
            F.transform("_rows", lambda r: r["label"]["share"]).alias("shares"),
            hashed("sample_id").alias("_b"),
        )
        .select("sample_id", "codes", "shares", F.inline(tiles))
    )
    one, two = hashed("sample_a"), hashed("sample_b")
    pairs = distances.select(
        F.col("sample_a").cast("string").alias("sample_a"),
        F.col("sample_b").cast("string").alias("sample_b"),
        F.col("distance").cast("double").alias("distance"),
    ).withColumns({"ti": F.least(one, two), "tj": F.greatest(one, two)})
    sums = (
        pairs.groupBy("ti", "tj")
        .cogroup(labels.groupBy("ti", "tj"))
        .applyInArrow(_within_tile, "perm long, within double, total double")
        .groupBy("perm")
        .agg(
            F.sum("within").alias("ss_residual"),
            (F.sum("total") / n).alias("ss_total"),
        )
        .withColumn("ss_group", F.col("ss_total") - F.col("ss_residual"))
        .withColumn(
            "f",
            F.try_divide(
                F.col("ss_group") / (a - 1), F.col("ss_residual") / (n - a)
            ),
        )
    )
    observed = lambda c: F.max(F.when(F.col("perm") == 0, F.col(c)))
    # one row per permutation from here on
    table = sums.agg(
        observed("ss_group").alias("ss_group"),
        observed("ss_residual").alias("ss_residual"),
        observed("ss_total").alias("ss_total"),
        observed("f").alias("f"),
        F.collect_list(F.when(F.col("perm") > 0, F.col("f"))).alias("drawn"),
    )
    beyond = F.size(
        F.filter("drawn", lambda v: v >= F.col("f") - F.lit(_TIE))
    )
    return table.select(
        F.lit(a - 1).alias("df_group"),
        F.lit(n - a).alias("df_residual"),
        "ss_group",
        "ss_residual",
        "ss_total",
        (F.col("ss_group") / F.col("ss_total")).alias("r2"),
        "f",
        (
            (beyond + 1) / F.lit(float(permutations + 1))
            if permutations
            else F.lit(None).cast("double")
        ).alias("p"),
    )


# --- PERMDISP -------------------------------------------------------------------


def centre_distances(
    distances: DataFrame,
    samples: DataFrame,
    group: str = "group",
    center: str = "median",
    iterations: int = 500,
    tolerance: float = 1e-8,
) -> DataFrame:
    """`(sample_id, group, spread)`: each sample's distance to its group's centre.

    A centre is a weighted mean of its members, so its distances follow from
    pair distances alone: weights are equal for the centroid, and are refined
    towards the spatial median by reweighting with inverse distances, until no distance moves by
    `tolerance`. Weights and distances are tables from round to round; it is an error if they do not
    settle in `iterations` rounds.
    """
    if center not in ("median", "centroid"):
        raise InvalidInput("`center` must be 'median' or 'centroid'.")
    labels = samples.select("sample_id", F.col(group).alias("group"))
    a = labels.select(F.col("sample_id").alias("sample_a"), F.col("group").alias("ga"))
    b = labels.select(F.col("sample_id").alias("sample_b"), F.col("group").alias("gb"))
    inside = (
        distances.join(a, "sample_a")
        .join(b, "sample_b")
        .filter(F.col("ga") == F.col("gb"))
        .select(
            F.col("ga").alias("group"),
            "sample_a",
            "sample_b",
            (F.col("distance") * F.col("distance")).alias("d2"),
        )
    )
    both = inside.unionByName(
        inside.select(
            "group",
            F.col("sample_b").alias("sample_a"),
            F.col("sample_a").alias("sample_b"),
            "d2",
        )
    )
    if center == "median":
        both = cut(both)
    sizes = labels.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    weights = labels.join(sizes, "group").select(
        "sample_id", "group", (F.lit(1.0) / F.col("size")).alias("w")
    )

    def spread_around(weights: DataFrame) -> DataFrame:
        other = weights.select(F.col("sample_id").alias("sample_b"), "w")
        cross = both.join(other, "sample_b").groupBy("sample_a").agg(
            F.sum(F.col("w") * F.col("d2")).alias("cross")
        )
        per = weights.join(
            cross.withColumnRenamed("sample_a", "sample_id"), "sample_id", "left"
        ).select("sample_id", "group", "w", F.coalesce("cross", F.lit(0.0)).alias("cross"))
        own = per.groupBy("group").agg(
            (F.sum(F.col("w") * F.col("cross")) / 2).alias("own")
        )
        return per.join(own, "group").select(
            "sample_id",
            "group",
            F.sqrt(F.abs(F.col("cross") - F.col("own"))).alias("spread"),
        )

    if center == "centroid":
        return spread_around(weights)
    # the state is a table: one weight for each sample
    state = cut(spread_around(weights))
    for _ in range(iterations):
        inverse = F.lit(1.0) / F.greatest("spread", F.lit(1e-12))
        totals = state.groupBy("group").agg(F.sum(inverse).alias("_total"))
        weights = state.join(totals, "group").select(
            "sample_id", "group", (inverse / F.col("_total")).alias("w")
        )
        before = state.select("sample_id", F.col("spread").alias("_before"))
        state = cut(spread_around(weights).join(before, "sample_id"))
        moved = state.agg(F.max(F.abs(F.col("spread") - F.col("_before")))).first()[0]
        state = state.drop("_before")
        if moved is None or moved < tolerance:
            return state
    raise RuntimeError(f"The spatial median did not settle in {iterations} rounds.")


def permdisp(
    distances: DataFrame,
    samples: DataFrame,
    group: str = "group",
    permutations: int = 999,
    center: str = "median",
    seed: int = 1,
) -> DataFrame:
    """Homogeneity of spread: F of the distances to group centres, and p.

    The null distribution permutes the residuals, as a table with a row for each permutation and
    sample (`permuted`); all F values come from one aggregate by permutation and group.
    """
    if not whole_number(permutations):
        raise InvalidInput("`permutations` must be a whole number.")
    design = check_design(samples, group, None)
    n, a = group_shape(design, "PERMDISP")
    spread = cut(centre_distances(distances, design, "group", center))
    # one row for each group
    means = spread.groupBy("group").agg(
        F.avg("spread").alias("_mean"), F.count(F.lit(1)).alias("size")
    )
    residuals = cut(
        spread.join(means, "group").select(
            "sample_id",
            "group",
            "size",
            F.lit("").alias("block"),
            (F.col("spread") - F.col("_mean")).alias("value"),
        )
    )
    observed = spread.join(means, "group").select(
        F.lit(0).alias("perm"), "group", "size", F.col("spread").alias("value")
    )
    every = observed
    if permutations:
        who = residuals.select("sample_id", "group", "size")
        drawn = permuted(residuals, "value", int(permutations), seed).join(who, "sample_id")
        every = observed.unionByName(drawn.select("perm", "group", "size", "value"))
    by_group = every.groupBy("perm", "group").agg(
        F.sum("value").alias("s"),
        F.sum(F.col("value") * F.col("value")).alias("q"),
        F.first("size").alias("size"),
    )
    tests = by_group.groupBy("perm").agg(
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("size")).alias("b"),
    )
    f = F.try_divide(
        (F.col("b") - F.col("s") * F.col("s") / n) / (a - 1), (F.col("q") - F.col("b")) / (n - a)
    )
    found = tests.select("perm", f.alias("f"))
    at_zero = F.max(F.when(F.col("perm") == 0, F.col("f")))
    table = found.agg(
        at_zero.alias("f"), F.collect_list(F.when(F.col("perm") > 0, F.col("f"))).alias("drawn")
    )
    hits = F.size(F.filter("drawn", lambda v: v >= F.col("f") - F.lit(_TIE)))
    return table.select(
        F.lit(a - 1).alias("df_group"),
        F.lit(n - a).alias("df_residual"),
        "f",
        ((hits + 1.0) / F.lit(float(permutations + 1))).alias("p"),
    )
