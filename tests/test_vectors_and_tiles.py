import numpy as np
import pytest
from helpers import catalog, unit
from pyspark.sql import functions as F

from vectide.operators.checks import InvalidInput
from vectide.operators.similarity import (
    protein_similarity,
    similarity_degrees,
    threshold_graph,
    threshold_links,
    unit_vectors,
)
from vectide.operators.components import connected_components, graph_stats


def pairs(df):
    return {(r.i, r.j): r.weight for r in df.collect()}


def dense_pairs(z, bound):
    s = z @ z.T
    return {
        (i, j): s[i, j]
        for i in range(len(z))
        for j in range(i + 1, len(z))
        if s[i, j] >= bound
    }


@pytest.mark.parametrize("tile_rows", [16, 512])
def test_threshold_graph_equals_brute_force(spark, tile_rows):
    z = unit(np.random.default_rng(1).normal(size=(120, 6)))
    got = pairs(threshold_graph(catalog(spark, z), 0.4, tile_rows))
    want = dense_pairs(z, 0.4)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("min_sim", [0.6, 0.9, 0.99])
def test_pivot_pruning_loses_no_pair(spark, min_sim):
    # clustered, with a third of all rows in one cluster
    rng = np.random.default_rng(2)
    centres = unit(rng.normal(size=(9, 12)))
    home = np.where(rng.random(400) < 1 / 3, 0, rng.integers(1, 9, 400))
    z = unit(centres[home] + rng.normal(0, 0.08, (400, 12)))
    got = pairs(threshold_graph(catalog(spark, z), min_sim, tile_rows=40))
    assert got.keys() == dense_pairs(z, min_sim).keys()


def test_links_keep_connectivity_with_few_edges(spark):
    rng = np.random.default_rng(3)
    z = unit(np.vstack([np.tile([[1.0, 0, 0]], (80, 1)), rng.normal(size=(40, 3))]))
    x = catalog(spark, z)
    links = threshold_links(unit_vectors(x), 0.95, tile_rows=50)
    assert links.count() < 3 * len(z)
    nodes = x.selectExpr("ord AS node")
    a = {r.node: r.component for r in connected_components(links, nodes).collect()}
    b = {
        r.node: r.component
        for r in connected_components(threshold_graph(x, 0.95), nodes).collect()
    }
    assert a == b


def test_similarity_without_gate_is_clipped_cosine(spark):
    z = np.array([[1 + 1e-7, 0], [3, 0], [-1, 0], [1, 1]])
    got = pairs(protein_similarity(catalog(spark, z), max_evalue=float("inf")))
    assert got.keys() == {(0, 1), (0, 3), (1, 3)}
    assert got[(0, 1)] == 1.0
    assert max(got.values()) <= 1.0


def test_degrees_sum_positive_similarity(spark):
    z = unit(np.random.default_rng(4).normal(size=(60, 4)))
    s = np.clip(z @ z.T, 0, 1)
    np.fill_diagonal(s, 0)
    rows = similarity_degrees(catalog(spark, z), tile_rows=17).collect()
    for r in rows:
        assert r.degree == (s[r.ord] > 0).sum()
        assert abs(r.strength - s[r.ord].sum()) < 1e-9


def test_zero_norm_names_the_row(spark):
    x = catalog(spark, [[1.0, 0], [0.0, 0]], ["fine", "dead"])
    with pytest.raises(Exception, match="zero or non-finite norm, e.g. dead"):
        threshold_graph(x, 0.5).collect()


@pytest.mark.parametrize("bad", [0, -1, float("nan"), "1", True, None])
def test_max_evalue_is_checked(spark, bad):
    with pytest.raises(InvalidInput, match="max_evalue"):
        protein_similarity(catalog(spark, [[1.0, 0]]), max_evalue=bad)


def test_vectors_need_unique_names_and_one_length(spark):
    with pytest.raises(InvalidInput, match="unique"):
        protein_similarity(
            catalog(spark, [[1.0, 0], [0, 1.0]], ["a", "a"]), float("inf")
        )
    with pytest.raises(InvalidInput, match="one length"):
        protein_similarity(catalog(spark, [[1.0, 0], [1.0]]), float("inf"))


def test_blocks_hold_many_strips_and_lose_no_pair(spark):
    from vectide.operators import tiles

    # 75 strips of 8 rows: rows are sent to 11 tiles, not to 75
    z = unit(np.random.default_rng(6).normal(size=(600, 6)))
    x = catalog(spark, z)
    got = pairs(threshold_graph(x, 0.4, tile_rows=8))
    assert got.keys() == dense_pairs(z, 0.4).keys()
    assert tiles._blocks(x, 600, 8) <= 16
    # what is sent grows with the rows, not with their square
    assert tiles._blocks(x, 600_000, 2048) <= 16


def test_edges_within_bins_are_those_of_the_graph(spark):
    z = unit(np.random.default_rng(7).normal(size=(90, 5)))
    x = catalog(spark, z)
    bins = x.selectExpr("ord", "concat('bin', ord % 4) AS bin")
    got = pairs(threshold_graph(x, 0.3, tile_rows=20, within=bins))
    want = {k: v for k, v in dense_pairs(z, 0.3).items() if k[0] % 4 == k[1] % 4}
    assert want and got.keys() == want.keys()


def test_links_of_a_tile_are_one_forest(spark):
    # 10 strips a tile: their forests are merged before they leave it
    z = unit(np.random.default_rng(8).normal(size=(100, 2)))
    links = threshold_links(unit_vectors(catalog(spark, z)), 0.0, tile_rows=100)
    from vectide.operators import tiles

    blocks = tiles._blocks(links, 100, 100)
    assert links.count() <= 100 * blocks
    few = threshold_links(unit_vectors(catalog(spark, z).repartition(1)), 0.0, tile_rows=5)
    assert few.count() <= 100 * tiles._blocks(links, 100, 5)


@pytest.mark.parametrize("min_sim", [0.2, 0.7])
def test_links_number_all_edges_of_the_graph(spark, min_sim):
    """The pass that finds the spanning links counts the edges: no second one is needed."""
    z = unit(np.random.default_rng(9).normal(size=(300, 5)))
    z[:60] = z[0]
    x = catalog(spark, z)
    links = threshold_links(unit_vectors(x), min_sim, tile_rows=40)
    want = threshold_graph(x, min_sim).count()
    assert links.count() < want == len(dense_pairs(z, min_sim - 1e-9))
    parts = connected_components(links, x.selectExpr("ord AS node"))
    assert graph_stats(links, parts, number="edges").first()["edges"] == want


def test_graph_shape_meets_the_pairs_once(spark, monkeypatch):
    from vectide.operators import similarity
    from vectide.plans.queries import REGISTRY

    passes = []
    tiles = similarity.map_close_tiles
    monkeypatch.setattr(
        similarity, "map_close_tiles", lambda *a, **k: passes.append(a[1]) or tiles(*a, **k)
    )
    row = REGISTRY["graph_shape"](spark, "/root/testdata/sf0.001").first()
    assert passes == ["ord"] and row["edges"] > 0


@pytest.mark.parametrize("edges", [0, 30, 400])
def test_forest_spans_with_the_fewest_edges(edges):
    from vectide.functions.graphs import lowest_labels
    from vectide.operators.similarity import _forest

    rng = np.random.default_rng(edges)
    n = 200
    rows, cols = rng.integers(0, n, (2, edges))
    kept = _forest(rows, cols, n)
    whole = lowest_labels(rows, cols, n)
    assert np.array_equal(lowest_labels(rows[kept], cols[kept], n), whole)
    assert len(kept) == n - len(np.unique(whole))


def test_regions_look_at_the_pairs_once(spark, monkeypatch):
    """The links are a written table before their components are sought."""
    from vectide.operators import ordination

    links = []

    def seen(edges, nodes=None):
        links.append(edges)
        return nodes.select("node", F.col("node").alias("component"))

    monkeypatch.setattr(ordination, "connected_components", seen)
    vectors = catalog(spark, unit(np.random.default_rng(1).normal(size=(50, 4))))
    units = vectors.selectExpr("CAST(ord AS LONG) AS ord", "protein_id", "embedding")
    ordination.regions(ordination.collapse_copies(units), 0.5).count()
    plan = links[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "FlatMapGroups" not in plan
