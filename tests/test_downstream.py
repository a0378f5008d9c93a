import hashlib
import math

import numpy as np
import pytest
from helpers import catalog, long_counts, square, unit
from pyspark.sql import functions as F

from vectide.functions.stats import t_two_sided
from vectide.operators.checks import InvalidInput
from vectide.operators.beta import bray_curtis, centre_distances, permanova, permdisp
from vectide.operators.differential import bh_adjust, clr, clr_baseline, ols_by_group
from vectide.operators.labels import pooled_labels
from vectide.operators.tsne import plot_tsne


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    counts = rng.poisson(3.0, (8, 20)).astype(float)
    counts[4:, :5] *= 4
    return counts


def groups(spark, n=8):
    return spark.createDataFrame(
        [(f"s{i}", i, "AB"[i >= n // 2], f"b{i % 4}") for i in range(n)],
        "sample_id string, ord long, group string, block string",
    )


def dense_bray(c):
    return np.abs(c[:, None] - c[None]).sum(axis=2) / (c[:, None] + c[None]).sum(axis=2)


def test_bray_curtis_in_blocks(spark, table, monkeypatch):
    import vectide.operators.beta as beta

    monkeypatch.setattr(beta, "_SAMPLE_BLOCK", 3)
    monkeypatch.setattr(beta, "_CHUNK_CELLS", 25)
    out = bray_curtis(long_counts(spark, table), samples=groups(spark))
    assert np.allclose(square(out), dense_bray(table), atol=1e-12)


def test_samples_that_share_nothing_are_one_apart(spark):
    out = bray_curtis(long_counts(spark, [[1, 0], [0, 2]]))
    assert out.first()["distance"] == 1.0


def f_statistic(d2, g):
    n, names = len(g), sorted(set(g))
    total = d2[np.triu_indices(n, 1)].sum() / n
    within = 0
    for name in names:
        at = [i for i in range(n) if g[i] == name]
        within += d2[np.ix_(at, at)].sum() / 2 / len(at)
    a = len(names)
    return (total - within) / (a - 1) / (within / (n - a)), (total - within) / total


def test_permanova_f_r2_and_p(spark, table):
    d = bray_curtis(long_counts(spark, table), samples=groups(spark))
    got = permanova(d, groups(spark), permutations=199).first()
    f, r2 = f_statistic(square(d) ** 2, list("AAAABBBB"))
    assert math.isclose(got["f"], f, rel_tol=1e-9) and math.isclose(got["r2"], r2, rel_tol=1e-9)
    assert 1 / 200 <= got["p"] <= 0.1
    again = permanova(d.repartition(3), groups(spark), permutations=199).first()
    assert again["p"] == got["p"]
    blocked = permanova(d, groups(spark), permutations=99, block="block").first()
    assert math.isclose(blocked["f"], f, rel_tol=1e-9) and 0 < blocked["p"] <= 1


def by_hash(names, values, perm, seed=1):
    """Values of a permutation by its definition: ranks of digests of seed, number and name."""
    base = dict(zip(names, values))
    order = sorted(names, key=lambda s: (hashlib.md5(f"{seed}-{perm}-{s}".encode()).hexdigest(), s))
    return {s: base[t] for s, t in zip(order, sorted(names))}


def test_p_values_count_the_hashed_permutations(spark, table):
    d = bray_curtis(long_counts(spark, table), samples=groups(spark))
    d2, names, labels = square(d) ** 2, [f"s{k}" for k in range(8)], list("AAAABBBB")
    assert sorted(r.sample_id for r in groups(spark).collect()) == names
    seen, _ = f_statistic(d2, labels)
    drawn = [by_hash(names, labels, p) for p in range(1, 100)]
    hits = sum(f_statistic(d2, [x[s] for s in names])[0] >= seen - 1.5e-8 for x in drawn)
    assert permanova(d, groups(spark), permutations=99).first()["p"] == (hits + 1) / 100

    spread = {r.sample_id: r.spread for r in centre_distances(d, groups(spark)).collect()}
    values = np.array([spread[s] for s in names])
    def anova(v):
        parts = v[:4], v[4:]
        within = sum(((x - x.mean()) ** 2).sum() for x in parts)
        return sum(4 * (x.mean() - v.mean()) ** 2 for x in parts) / (within / 6)
    residuals = values - np.repeat([values[:4].mean(), values[4:].mean()], 4)
    drawn = [by_hash(names, residuals, p) for p in range(1, 100)]
    hits = sum(anova(np.array([x[s] for s in names])) >= anova(values) - 1.5e-8 for x in drawn)
    got = permdisp(d, groups(spark), permutations=99).first()
    assert got["p"] == (hits + 1) / 100 and math.isclose(got["f"], anova(values), rel_tol=1e-6)


def test_many_blocks_of_samples_and_bad_designs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    rows = [
        (f"s{i}", f"s{j}", float(np.linalg.norm(x[i] - x[j]))) for i in range(60) for j in range(i)
    ]
    d = spark.createDataFrame(rows, "sample_a string, sample_b string, distance double")
    who = [(f"s{k}", "ABC"[k % 3], "xy"[k % 2]) for k in range(60)]
    samples = spark.createDataFrame(who, "sample_id string, group string, block string")
    whole = permanova(d, samples, permutations=49, block="block").first()
    monkeypatch.setattr("vectide.operators.beta._SAMPLE_BLOCK", 7)
    parts = permanova(d, samples, permutations=49, block="block").first()
    assert parts["p"] == whole["p"] and math.isclose(parts["f"], whole["f"], rel_tol=1e-9)
    with pytest.raises(InvalidInput, match="one label per sample"):
        permanova(d, samples.unionByName(samples.limit(1)))
    with pytest.raises(InvalidInput, match="two groups"):
        permdisp(d, samples.withColumn("group", F.lit("A")))
    with pytest.raises(RuntimeError, match="did not settle"):
        centre_distances(d, samples, iterations=1)


@pytest.mark.parametrize("center", ["centroid", "median"])
def test_spread_around_group_centres(spark, center):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(9, 3)) * np.where(np.arange(9) < 4, 1, 3)[:, None]
    rows = [
        (f"s{i}", f"s{j}", float(np.linalg.norm(x[i] - x[j])))
        for i in range(9)
        for j in range(i + 1, 9)
    ]
    d = spark.createDataFrame(rows, "sample_a string, sample_b string, distance double")
    who = spark.createDataFrame([(f"s{i}", "AB"[i >= 4]) for i in range(9)], "sample_id string, group string")
    got = {r.sample_id: r.spread for r in centre_distances(d, who, center=center).collect()}
    for at in (range(4), range(4, 9)):
        c = x[list(at)].mean(axis=0)
        for _ in range(3000 if center == "median" else 0):
            w = 1 / np.linalg.norm(x[list(at)] - c, axis=1)
            c = (x[list(at)] * w[:, None]).sum(axis=0) / w.sum()
        for i in at:
            assert abs(got[f"s{i}"] - np.linalg.norm(x[i] - c)) < 1e-6
    out = permdisp(d, who, permutations=99, center="centroid").first()
    assert out["f"] > 0 and 0 < out["p"] <= 1


def test_clr_and_linear_model(spark, table):
    counts = long_counts(spark, table)
    logged = np.log2(table + 1)
    dense = logged - logged.mean(axis=1, keepdims=True)
    for r in clr(counts).collect():
        assert abs(r.clr - dense[int(r.sample_id[1:]), int(r.feature[1:])]) < 1e-12
    for r in clr_baseline(counts).collect():
        assert abs(r.baseline + logged[int(r.sample_id[1:])].mean()) < 1e-12
    for r in ols_by_group(counts, groups(spark), "B", "A").collect():
        y = dense[:, int(r.feature[1:])]
        a, b = y[:4], y[4:]
        error = math.sqrt((a.var() * 4 + b.var() * 4) / 6 * (1 / 4 + 1 / 4))
        assert abs(r.lfc - (b.mean() - a.mean())) < 1e-9
        assert abs(r.t - r.lfc / error) < 1e-6


def test_t_tail_against_closed_forms():
    t = np.array([0.0, 0.3, 1.0, 2.5, 40.0])
    one = 1 - 2 / math.pi * np.arctan(t)
    two = 1 - t / np.sqrt(2 + t * t)
    assert np.allclose(t_two_sided(t, np.full(5, 1.0)), one, rtol=1e-12)
    assert np.allclose(t_two_sided(t, np.full(5, 2.0)), two, rtol=1e-10)
    assert abs(t_two_sided(np.array([2.0687]), np.array([23.0]))[0] - 0.05) < 1e-4


def test_bh_adjustment(spark):
    rng = np.random.default_rng(13)
    p = np.concatenate([rng.random(40) ** 3, np.full(20, 1.0)])
    rows = [(f"f{i}", float(v)) for i, v in enumerate(p)] + [("none", None)]
    out = bh_adjust(spark.createDataFrame(rows, "feature string, p double"))
    got = {r.feature: r.q for r in out.collect()}
    order = np.argsort(-p, kind="stable")
    want = np.minimum(1, np.minimum.accumulate(p[order] * len(p) / np.arange(len(p), 0, -1)))
    for i, q in zip(order, want):
        assert abs(got[f"f{i}"] - q) < 1e-12
    assert got["none"] is None


def test_labels_beyond_twelve_are_pooled(spark):
    letters = "ABCDEFGHIJKLM"
    rows = [(f"p{2 * i + k}", c) for i, c in enumerate(letters) for k in (0, 1)]
    rows += [("p26", "N"), ("p27", None)]
    labels = spark.createDataFrame(rows, "protein_id string, label string")
    proteins = spark.createDataFrame([(f"p{i}",) for i in range(30)], "protein_id string")
    got = {r.protein_id: (r.label, r.layer) for r in pooled_labels(proteins, labels).collect()}
    assert got["p0"] == ("A", 2) and got["p23"] == ("L", 2)
    assert [got[p] for p in ("p24", "p25", "p26")] == [("other", 1)] * 3
    assert [got[p] for p in ("p27", "p28", "p29")] == [(None, 0)] * 3


def test_tsne_covers_every_protein(spark):
    z = unit(np.random.default_rng(14).normal(size=(30, 3)))
    labels = spark.createDataFrame([("p0", "x")], "protein_id string, label string")
    plot = plot_tsne(catalog(spark, z), color=labels, iterations=3)
    rows = plot.data.toPandas()
    assert len(rows) == 30 and np.isfinite(rows[["tsne1", "tsne2"]].to_numpy()).all()
    assert plot.labels["subtitle"] == "cosine distance, perplexity 9"
    with pytest.raises(ValueError, match="at least 4"):
        plot_tsne(catalog(spark, z[:3]))
    with pytest.raises(ValueError, match="named"):
        plot_tsne(catalog(spark, z), color=labels.drop("protein_id"))


def test_nearest_rows_send_only_what_is_asked(spark):
    from vectide.operators.similarity import unit_vectors
    from vectide.operators.tsne import nearest_rows

    z = unit(np.random.default_rng(9).normal(size=(1300, 4)))
    z[7] = z[1200]
    units = unit_vectors(catalog(spark, z))
    got = {r.i: [(x.d, x.j) for x in r.near] for r in nearest_rows(units, 9, 1300).collect()}
    d = 1.0 - np.clip(z @ z.T, -1, 1)
    np.fill_diagonal(d, np.inf)
    assert len(got) == 1300
    for i, near in got.items():
        assert len(near) == 9 and near == sorted(near)
        assert np.allclose([x for x, _ in near], np.sort(d[i])[:9], atol=1e-12)
        assert np.allclose([d[i, j] for _, j in near], [x for x, _ in near], atol=1e-12)


def test_regions_that_hold_all_may_be_dropped(spark):
    from vectide.operators.distances import mmd_of_weights, relative_abundance, sample_order
    from vectide.operators.ordination import drop_regions

    # one region holds every protein of s0 and s1 (and of s2, in the second table)
    z = unit([[1, 0], [1, 0.01], [1, 0.02], [0, 1]])
    x = catalog(spark, z)
    for cells, rows in (([[1, 2, 0, 0], [0, 1, 3, 0], [1, 1, 0, 2], [2, 0, 0, 5]], 1), ([[1, 2, 3, 0]] * 4, 0)):
        counts = long_counts(spark, cells)
        weights, order = relative_abundance(counts), sample_order(counts, None)
        kept, sigma, _ = drop_regions(weights, x, order, 1, 0.9, strict=False)
        assert mmd_of_weights(kept, x, order, sigma).count() == rows
        with pytest.raises(InvalidInput, match="regions|only dropped"):
            drop_regions(weights, x, order, 1, 0.9)


def test_tsne_query_takes_every_step(spark, monkeypatch):
    from inspect import signature

    from vectide.operators.tsne import ITERATIONS, tsne_layout
    from vectide.plans import queries

    asked = []

    def seen(units, affinities, *rest, **named):
        given = signature(tsne_layout).bind(units, affinities, *rest, **named)
        given.apply_defaults()
        asked.append(given.arguments["iterations"])
        return units.selectExpr("ord", "0D AS tsne1", "0D AS tsne2")

    z = unit(np.random.default_rng(2).normal(size=(100, 4)))
    monkeypatch.setattr(queries, "tsne_layout", seen)
    rows = catalog(spark, z).select("ord", "embedding")
    tables = type("Tables", (), {"units": lambda self: rows})()
    assert queries.tsne(tables).count() == 100
    assert asked == [ITERATIONS]


@pytest.mark.parametrize("alone", [2048, 8])
def test_tsne_steps_follow_the_gradient(spark, monkeypatch, alone):
    """Steps of one task and of several blocks, with a copied row, against sums over all pairs."""
    import vectide.operators.tsne as tsne

    monkeypatch.setattr(tsne, "_ALONE", alone)
    monkeypatch.setattr(tsne, "_BLOCK_POINTS", 7)
    n = 40
    rng = np.random.default_rng(4)
    p = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.3), 1)
    p = (p + p.T) / (2 * p.sum())
    i, j = np.nonzero(p)
    triples = [(int(a), int(b), float(p[a, b])) for a, b in zip(i, j)]
    near = spark.createDataFrame(triples, "i long, j long, p double")
    units = spark.createDataFrame([(k,) for k in [*range(n), 5]], "ord long")

    def points(steps):
        rows = tsne.tsne_layout(units, near, n + 1, steps).toPandas().sort_values("ord")
        assert len(rows) == n + 1
        rows = rows.drop_duplicates()
        assert len(rows) == n
        return rows[["tsne1", "tsne2"]].to_numpy()

    times = np.ones(n)
    times[5] = 2.0
    y, speed, gain = points(0), np.zeros((n, 2)), np.ones((n, 2))
    for _ in range(4):
        gap = y[:, None] - y[None]
        q = 1.0 / (1.0 + np.square(gap).sum(axis=2))
        pairs = np.outer(times, times) * q
        total = pairs.sum() - times.sum()
        pull = np.einsum("ij,ijc->ic", np.outer(times, times) * p * q, gap)
        push = np.einsum("ij,ijc->ic", pairs * q, gap)
        slope = 4.0 * (12.0 * pull - push / total)
        gain = np.maximum(np.where(np.sign(slope) == np.sign(speed), gain * 0.8, gain + 0.2), 0.01)
        speed = 0.5 * speed - 200.0 * gain * slope
        y = y + speed
    y -= np.average(y, axis=0, weights=times)
    got = points(4)
    assert np.allclose(got, y, rtol=1e-6, atol=1e-9 * np.abs(y).max())
