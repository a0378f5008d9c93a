import numpy as np
import pytest
from helpers import catalog, dense_mmd, long_counts, square, unit

from vectide.operators import distances
from vectide.operators.checks import InvalidInput
from vectide.operators.distances import median_sigma, sample_mmd
from vectide.operators.ordination import group_hulls, pcoa, plot_pcoa


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    centre = np.array([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 1.0]])
    z = unit(np.repeat(centre, 10, axis=0) + rng.normal(0, 0.05, (30, 4)))
    return z, rng.poisson(20, (6, 30)) + 1.0


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("tile_rows", [7, 2048])
def test_mmd_matches_dense(spark, data, weighted, tile_rows):
    z, counts = data
    counts = counts.copy()
    counts[np.arange(180).reshape(6, 30) % 4 != 0] = 0
    out = sample_mmd(
        long_counts(spark, counts), catalog(spark, 3 * z), weighted, tile_rows=tile_rows
    )
    want, sigma = dense_mmd(counts, z, weighted=weighted)
    assert np.allclose(square(out), want, atol=1e-9)
    assert abs(out.first()["sigma"] - sigma) < 1e-12


def test_a_third_of_all_vectors_may_be_copies(spark, data):
    z, counts = data
    z = z.copy()
    z[:10] = z[0]
    x = catalog(spark, z)
    want, sigma = dense_mmd(counts, z)
    out = sample_mmd(long_counts(spark, counts), x, tile_rows=6)
    assert np.allclose(square(out), want, atol=1e-9)
    assert abs(out.first()["sigma"] - sigma) < 1e-12


def test_totals_and_zero_proteins_do_not_matter(spark, data):
    z, counts = data
    x = catalog(spark, np.vstack([z, [[0, 0, 0, 1.0]]]))
    scaled = np.hstack([counts * np.arange(1, 7)[:, None], np.zeros((6, 1))])
    a = square(sample_mmd(long_counts(spark, scaled), x))
    assert np.allclose(a, dense_mmd(counts, z)[0], atol=1e-9)


def test_support_and_abundance_differ(spark):
    x = catalog(spark, [[1, 0], [0, 1], [-1, 0]])
    counts = long_counts(spark, [[98, 1, 1], [1, 1, 98]])
    assert sample_mmd(counts, x).first()["distance"] > 0.1
    assert sample_mmd(counts, x, weighted=False).first()["distance"] < 1e-7


def test_one_protein_and_degenerate_bandwidth(spark, data):
    one = long_counts(spark, [[10.0], [20.0]])
    out = sample_mmd(one, catalog(spark, data[0])).first()
    assert out["distance"] == 0 and out["sigma"] == 1
    same = catalog(spark, np.tile(data[0][:1], (30, 1)))
    with pytest.raises(InvalidInput, match="identical embeddings"):
        sample_mmd(long_counts(spark, data[1]), same)
    near = np.tile(data[0][:1], (30, 1))
    near[:, 1] += np.arange(1, 31) * 1e-6
    out = sample_mmd(long_counts(spark, data[1]), catalog(spark, near))
    assert np.isfinite(square(out)).all()


@pytest.mark.parametrize("sigma", [0, -1, "1", True, float("nan"), float("inf")])
def test_sigma_is_checked(spark, data, sigma):
    with pytest.raises(InvalidInput, match="sigma"):
        sample_mmd(long_counts(spark, data[1]), catalog(spark, data[0]), sigma=sigma)


@pytest.mark.parametrize("cell", [-1.0, float("nan"), float("inf"), None])
def test_bad_cells_are_rejected(spark, data, cell):
    rows = [("a", "p0", 1.0), ("a", "p1", cell)]
    counts = spark.createDataFrame(rows, "sample_id string, protein_id string, value double")
    with pytest.raises(InvalidInput, match="finite"):
        sample_mmd(counts, catalog(spark, data[0]))


def test_missing_vectors_and_empty_samples(spark, data):
    z, counts = data
    with pytest.raises(InvalidInput, match="25 protein.* no embedding in `x`, e.g. p"):
        sample_mmd(long_counts(spark, counts), catalog(spark, z[:5]))
    empty = counts.copy()
    empty[0] = 0
    with pytest.raises(InvalidInput, match="no counts: s0"):
        sample_mmd(long_counts(spark, empty), catalog(spark, z))
    samples = spark.createDataFrame([(f"s{i}", i) for i in range(7)], "sample_id string, ord long")
    with pytest.raises(InvalidInput, match="no counts: s6"):
        sample_mmd(long_counts(spark, counts), catalog(spark, z), samples=samples)
    twice = long_counts(spark, counts).union(long_counts(spark, counts))
    with pytest.raises(InvalidInput, match="unique"):
        sample_mmd(twice, catalog(spark, z))


def test_median_is_exact_for_even_and_odd_pair_counts(spark):
    rng = np.random.default_rng(9)
    for n in (6, 7):
        z = unit(rng.normal(size=(n, 3)))
        d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))[np.triu_indices(n, 1)]
        got = median_sigma(long_counts(spark, np.ones((1, n))), catalog(spark, z), tile_rows=3)
        assert abs(got - np.median(d)) < 1e-12


def test_median_takes_two_passes_over_the_pairs(spark, monkeypatch):
    """However fine the distances lie, and wherever the search begins."""
    rng = np.random.default_rng(3)
    z = unit(rng.normal(size=(300, 8)))
    z[200:260] = z[:60]
    d = np.sqrt(np.maximum(2 - 2 * z @ z.T, 0))[np.triu_indices(300, 1)]
    rows = catalog(spark, z).selectExpr("ord", "protein_id", "embedding")
    found = distances.collapse_copies(distances.unit_vectors(rows))
    assert found.rows == 240
    passes = []
    tiles = distances.map_tiles
    monkeypatch.setattr(distances, "map_tiles", lambda *a: passes.append(a) or tiles(*a))
    assert abs(distances.pair_median(found, 50) - np.median(d)) < 1e-12
    assert len(passes) == 2
    begins = (((0.0, 0.1), 10**6), ((1.9, 1.95), 5), ((0.2, 0.2), 10**6))
    monkeypatch.setattr(distances, "_VALUES_A_ROW", 0)
    for span, few in begins:
        monkeypatch.setattr(distances, "_likely_span", lambda _, span=span: span)
        monkeypatch.setattr(distances, "_FEW_VALUES", few)
        assert abs(distances.pair_median(found, 50) - np.median(d)) < 1e-12


def gaps(points):
    p = points[["pco1", "pco2"]].to_numpy()
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))


def classical(d):
    j = np.eye(len(d)) - 1 / len(d)
    v, w = np.linalg.eigh(-0.5 * j @ d**2 @ j)
    xy = w[:, ::-1][:, :2] * np.sqrt(v[::-1][:2])
    return np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2)), 100 * v[::-1][:2] / v[v > 0].sum()


def test_pcoa_of_the_full_distance(spark, data):
    z, counts = data
    plot = plot_pcoa(long_counts(spark, counts), catalog(spark, z), drop=0)
    want, _ = classical(dense_mmd(counts, z)[0])
    table = plot.data.toPandas().sort_values("sample_id")
    assert np.allclose(gaps(table), want, atol=1e-8)
    assert plot.labels["message"] is None
    samples = spark.createDataFrame([(f"s{i}", i) for i in range(6)], "sample_id string, ord long")
    d = sample_mmd(long_counts(spark, counts), catalog(spark, z))
    points, values, trace = pcoa(d, samples)
    assert np.allclose(gaps(points.toPandas().sort_values("sample_id")), want, atol=1e-6)
    share = 100 * np.array(values) / trace
    assert np.allclose(share, classical(dense_mmd(counts, z)[0])[1], atol=1e-4)


def test_pcoa_of_a_distance_that_is_not_euclidean(spark):
    # more samples than a few blocks span, and large negative eigenvalues
    n = 60
    rng = np.random.default_rng(3)
    d = np.abs(rng.normal(1, 0.4, (n, n)))
    d = np.triu(d, 1) + np.triu(d, 1).T
    cells = [(f"s{i}", f"s{j}", float(d[i, j])) for i in range(n) for j in range(i + 1, n)]
    samples = spark.createDataFrame([(f"s{i}", i) for i in range(n)], "sample_id string, ord long")
    frame = spark.createDataFrame(cells, "sample_a string, sample_b string, distance double")
    points, values, trace = pcoa(frame, samples)
    j = np.eye(n) - 1 / n
    v, w = np.linalg.eigh(-0.5 * j @ d**2 @ j)
    assert np.allclose(values, v[::-1][:2]) and np.isclose(trace, v.sum())
    table = points.orderBy("ord").select("pco1", "pco2").toPandas().to_numpy()
    want = w[:, ::-1][:, :2] * np.sqrt(v[::-1][:2])
    assert np.allclose(np.abs(table), np.abs(want), atol=1e-6)


def test_pcoa_drops_the_heaviest_region(spark, data):
    z, counts = data
    big = counts.copy()
    big[:, :10] *= 10
    sigma = dense_mmd(big, z)[1]
    want, _ = classical(dense_mmd(big[:, 10:], z[10:], sigma)[0])
    group = spark.createDataFrame([(f"s{i}", "ab"[i // 3]) for i in range(6)], "sample_id string, group string")
    plot = plot_pcoa(long_counts(spark, big), catalog(spark, z), group, drop=1)
    assert np.allclose(gaps(plot.data.toPandas().sort_values("sample_id")), want, atol=1e-8)
    assert plot.labels["message"].startswith("Dropped 1 region, ")
    assert "(10 proteins)" in plot.labels["message"]
    assert set(plot.labels["hulls"].toPandas()["group"]) == {"a", "b"}
    alone = big.copy()
    alone[0, 10:] = 0
    with pytest.raises(InvalidInput, match="s0 hold only"):
        plot_pcoa(long_counts(spark, alone), catalog(spark, z), drop=1)
    with pytest.raises(InvalidInput, match="below the 3 regions"):
        plot_pcoa(long_counts(spark, big), catalog(spark, z), drop=3)


@pytest.mark.parametrize("bad", [{"drop": -1}, {"drop": 1.5}, {"min_sim": 1.5}])
def test_pcoa_arguments(spark, data, bad):
    with pytest.raises(InvalidInput, match=f"`{next(iter(bad))}`"):
        plot_pcoa(long_counts(spark, data[1]), catalog(spark, data[0]), **bad)


def test_hull_keeps_corners_only(spark):
    rows = [("g", i, float(x), float(y)) for i, (x, y) in enumerate(
        [(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (1, 3), (2, 0)])]
    points = spark.createDataFrame(rows, "grp string, id int, x double, y double").repartition(3)
    got = group_hulls(points, "grp", "x", "y").orderBy("corner").toPandas()
    assert got["id"].tolist() == [0, 1, 2, 3]


def test_weights_reach_the_tiles_as_plain_arrays(spark, data, monkeypatch):
    """What is sent once a block holds no structs, which double the bytes of an entry."""
    z, counts = data
    counts = counts.copy()
    counts[np.arange(180).reshape(6, 30) % 5 == 0] = 0
    sent = []
    tiles = distances.map_tiles
    monkeypatch.setattr(
        distances, "map_tiles", lambda rows, *rest: sent.append(rows.schema) or tiles(rows, *rest)
    )
    out = sample_mmd(long_counts(spark, counts), catalog(spark, z), sigma=0.5, tile_rows=7)
    assert np.allclose(square(out), dense_mmd(counts, z, 0.5)[0], atol=1e-9)
    (schema,) = sent
    assert [f.dataType.simpleString() for f in schema] == [
        "bigint", "array<double>", "array<bigint>", "array<double>"
    ]


def test_lines_are_joined_once(spark):
    """Customers are joined to the orders, not to the longer lines."""
    from vectide.plans.inputs import Inputs

    counts = Inputs(spark, "/root/testdata/sf0.001").counts()
    plan = counts._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [line for line in plan if "Join Inner" in line]
    depth = {k: next(j.index("Join") for j in joins if k in j) for k in ("l_orderkey", "o_custkey")}
    assert len(joins) == 3 and depth["l_orderkey"] < depth["o_custkey"]
