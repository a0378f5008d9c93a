import numpy as np
import pytest
from helpers import catalog, components_of, dense_mcl, edges_of, long_counts, unit

from vectide.operators.bins import bin_glom, bin_proteins, plot_bin_similarity
from vectide.operators.checks import InvalidInput
from vectide.operators.components import connected_components
from vectide.operators.mcl import markov_clusters


def graph(z, bound):
    s = np.clip(z @ z.T, 0, 1)
    s[s < bound] = 0
    np.fill_diagonal(s, 0)
    return s


def families():
    rng = np.random.default_rng(0)
    return unit(np.repeat(np.eye(3), 5, axis=0) + rng.normal(0, 0.03, (15, 3)))


def test_components_of_paths_stars_and_isolated(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 140)]
    e = spark.createDataFrame(edges, "i long, j long")
    nodes = spark.createDataFrame([(n,) for n in [*range(61), *range(100, 140), 999]], "node long")
    got = {r.node: r.component for r in connected_components(e, nodes).collect()}
    assert {got[n] for n in range(61)} == {0}
    assert {got[n] for n in range(100, 140)} == {100}
    assert got[999] == 999


def test_components_of_a_long_shuffled_path(spark):
    at = np.random.default_rng(1).permutation(3000)
    rows = [(int(at[k]), int(at[k + 1])) for k in range(2999) if k != 1499]
    got = connected_components(spark.createDataFrame(rows, "i long, j long"))
    sizes = {r.component: r["count"] for r in got.groupBy("component").count().collect()}
    assert sizes == {int(at[:1500].min()): 1500, int(at[1500:].min()): 1500}


@pytest.mark.parametrize(
    "inflation, dense_limit", [(1.4, 2048), (2, 2048), (4, 2048), (2, 4)]
)
def test_mcl_agrees_with_dense(spark, inflation, dense_limit, monkeypatch):
    import vectide.operators.mcl as mcl

    # several tiles per side where components go through tiles
    monkeypatch.setattr(mcl, "TILE", 20)
    rng = np.random.default_rng(8)
    centres = unit(rng.normal(size=(4, 8)))
    z = unit(np.repeat(centres, 12, axis=0) + rng.normal(0, 0.35, (48, 8)))
    s = graph(z, 0.5)
    nodes = spark.range(48).withColumnRenamed("id", "node")
    parts = connected_components(edges_of(spark, s), nodes)
    rows = markov_clusters(edges_of(spark, s), parts, inflation, dense_limit).collect()
    got = np.array([r.cluster for r in sorted(rows, key=lambda r: r.node)])
    assert np.array_equal(got, dense_mcl(s, inflation))
    home = components_of(s > 0)
    assert all(r.component == home[r.node] for r in rows)


def test_bins_membership_medoids_and_stats(spark):
    z = families()
    s = graph(z, 0.5)
    x = catalog(spark, z)
    out = bin_proteins(edges_of(spark, s), x)
    member = out.membership.toPandas().sort_values("ord")
    assert member["bin"].tolist() == ["bin1"] * 5 + ["bin2"] * 5 + ["bin3"] * 5
    shape = out.graph.first().asDict()
    assert shape == {
        "proteins": 15, "edges": 30, "isolated": 0, "components": 3, "largest_component": 5,
    }
    for r in out.bins.collect():
        mine = member.loc[member["bin"] == r.bin, "ord"].to_numpy()
        best = mine[s[np.ix_(mine, mine)].sum(axis=0).argmax()]
        assert r.representative == f"p{best}"
    listed = out.clusters.toPandas().sort_values(["bin", "position"])
    assert listed.groupby("bin")["protein_id"].apply(list)["bin1"] == [f"p{i}" for i in range(5)]


def test_bins_are_ranked_by_size_with_isolated_last(spark):
    s = np.zeros((6, 6))
    for a, b in [(3, 4), (4, 5), (3, 5)]:
        s[a, b] = s[b, a] = 0.9
    out = bin_proteins(edges_of(spark, s), catalog(spark, np.eye(6)))
    got = {r.protein_id: r.bin for r in out.membership.collect()}
    assert got == {"p3": "bin1", "p4": "bin1", "p5": "bin1", "p0": "bin2", "p1": "bin3", "p2": "bin4"}
    assert out.graph.first()["isolated"] == 3


def test_glom_conserves_totals_and_rejects_strangers(spark):
    out = bin_proteins(edges_of(spark, graph(families(), 0.5)), catalog(spark, families()))
    counts = np.random.default_rng(4).poisson(20, (4, 15))
    rolled = bin_glom(long_counts(spark, counts), out).toPandas()
    assert rolled.groupby("sample_id")["value"].sum().tolist() == counts.sum(axis=1).tolist()
    part = long_counts(spark, counts[:, 5:10], proteins=[f"p{i}" for i in range(5, 10)])
    assert set(bin_glom(part, out).toPandas()["bin"]) == {"bin2"}
    stranger = long_counts(spark, [[1.0]], proteins=["extra"])
    with pytest.raises(InvalidInput, match="in no bin, e.g. extra"):
        bin_glom(stranger, out)


def test_heatmap_of_a_chain_has_missing_pairs(spark):
    angle = np.array([0, 0.5, 1, 1.5])
    z = np.column_stack([np.cos(angle), np.sin(angle)])
    e = edges_of(spark, graph(z, 0.8))
    out = bin_proteins(e, catalog(spark, z), inflation=1.4)
    grid = plot_bin_similarity(out, "bin1", e, full_grid=True)
    table = grid.data.toPandas()
    assert len(table) == 16 and table["similarity"].isna().sum() == 6
    assert grid.labels["subtitle"].startswith("50% of pairs are edges")
    assert len(plot_bin_similarity(out, "bin1", e).data.collect()) == 10
    first = table.loc[table["protein_at"] == 1, "protein"].iloc[0]
    assert first == out.bins.first()["representative"]
    with pytest.raises(InvalidInput, match="must name one"):
        plot_bin_similarity(out, "bin99", e)
    with pytest.raises(InvalidInput, match="6 edges but `bins` was built from 3"):
        plot_bin_similarity(out, "bin1", edges_of(spark, graph(z, 0.01)))


@pytest.mark.parametrize("bad", [1, 0.5, float("inf"), float("nan"), "2", None])
def test_inflation_is_checked(spark, bad):
    with pytest.raises(InvalidInput, match="inflation"):
        bin_proteins(edges_of(spark, graph(families(), 0.5)), catalog(spark, families()), bad)


@pytest.mark.parametrize(
    "row", [(0, 1, 1.5), (0, 1, -0.1), (1, 0, 0.5), (0, 1, None), (0, 77, 0.5)]
)
def test_malformed_graphs_are_rejected(spark, row):
    e = spark.createDataFrame([row], "i long, j long, weight double")
    with pytest.raises(InvalidInput, match="`S`"):
        bin_proteins(e, catalog(spark, families()))


def test_a_large_component_leaves_no_matrices_behind(spark, monkeypatch, tmp_path):
    import os

    import vectide.operators.mcl as mcl

    monkeypatch.setattr(mcl, "TILE", 7)
    monkeypatch.setattr("vectide.session.checkpoint_dir", lambda _: str(tmp_path))
    z = unit(np.random.default_rng(5).normal(size=(60, 5)))
    s = graph(z, 0.4)
    nodes = spark.range(60).withColumnRenamed("id", "node")
    parts = connected_components(edges_of(spark, s), nodes)
    rows = markov_clusters(edges_of(spark, s), parts, 2.0, dense_limit=2).collect()
    got = np.array([r.cluster for r in sorted(rows, key=lambda r: r.node)])
    assert np.array_equal(got, dense_mcl(s, 2.0))
    left = [spark.read.parquet(str(tmp_path / d)).columns for d in os.listdir(tmp_path)]
    assert left and not any("cells" in columns for columns in left)


@pytest.mark.parametrize("mine", [0.02, 1.0])
@pytest.mark.parametrize("theirs", [0.02, 1.0])
def test_strips_are_stored_by_their_flows(mine, theirs):
    """A strip of few flows takes their room, not that of all its cells, and gives the same product."""
    import vectide.operators.mcl as mcl

    rng = np.random.default_rng(3)
    n, wide = 400, 50

    def cells(share):
        return rng.random((n, wide)) * (rng.random((n, wide)) < share)

    def stored(at, flow):
        batch = mcl._strip([0, n, at, wide, 0, 1, 0, 0], flow)
        if (flow > 0).mean() < 0.1:
            assert batch.nbytes < flow.nbytes / 4
        return mcl._unpack(batch, 0)[1]

    left, own = cells(theirs), [cells(mine), cells(mine)]
    joined = mcl._side_by_side([stored(0, own[0]), stored(wide, own[1])])
    grown = np.zeros((n, 2 * wide))
    mcl._expand(grown, joined, stored(100, left), 100)
    assert np.allclose(grown, left @ np.hstack(own)[100 : 100 + wide], rtol=1e-12, atol=0)


@pytest.mark.parametrize("inflation", [1.4, 2.0, 4.0])
def test_dropped_flows_change_no_kept_one(inflation):
    import vectide.operators.mcl as mcl

    rng = np.random.default_rng(6)
    z = unit(rng.normal(size=(120, 5)))
    flow = np.where(graph(z, 0.3) > 0, graph(z, 0.3), 0.0) + np.eye(120)
    flow /= flow.sum(axis=0)
    least = mcl._lost_in_rounding(120, inflation)
    assert mcl._VANISHING <= least < 1e-25
    every = flow.copy()
    for _ in range(25):
        flow = mcl._inflated(flow @ flow, inflation)
        every = np.power(every @ every, inflation)
        every /= every.sum(axis=0)
        every[every < 1e-300] = 0.0
        kept = flow > 1e3 * least
        assert kept.any() and np.allclose(flow[kept], every[kept], rtol=1e-6, atol=0)
