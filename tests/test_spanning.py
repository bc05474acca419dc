"""Spanning links of mutual reachability against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landstrata.operators import cluster as C
from landstrata.operators import spanning as SP
from landstrata.operators.neighbors import knn_join


def frame(spark, ids, x):
    return spark.createDataFrame(pd.DataFrame({"id": ids, "z": [r.tolist() for r in x]}))


def clumps(n=160, seed=4):
    """Uneven clumps, scattered rows, and a quarter of the rows on one point."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * 0.3 + 3 * rng.integers(0, 3, n)[:, None]
    x[: n // 4] = x[0]
    x[-n // 8 :] = rng.uniform(-4, 10, size=(len(x[-n // 8 :]), 3))
    return rng.permutation(n) + 5, x


def brute(ids, x, min_pts, cut):
    """Smallest id of each dense row's component."""
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    core = np.sort(d + np.where(np.eye(len(x)), np.inf, 0), axis=1)[:, max(min_pts - 1, 1) - 1]
    dense = core <= cut
    near = (d <= cut) & dense[:, None] & dense[None]
    lab = ids.copy()
    while True:
        new = np.array([min(lab[i], lab[near[i]].min() if near[i].any() else lab[i]) for i in range(len(x))])
        if (new == lab).all():
            return {int(i): int(c) for i, c, k in zip(ids, lab, dense) if k}
        lab = new


@pytest.mark.parametrize("kw", [{}, {"block": 40}, {"block": 40, "pivots": 6}])
def test_links_serve_every_cut_and_min_pts(spark, kw):
    ids, x = clumps()
    df = frame(spark, ids, x)
    nn = knn_join(df, df, 7, qid="id", rid="id").cache()
    links = SP.density_links(df, "id", "z", nn, 8, 2.5, **kw)
    runs = [(2, 0.1), (3, 0.4), (5, 0.4), (8, 0.4), (5, 1.0), (8, 2.5), (4, 0.0)]
    got = SP.density_components(links, nn, "id", runs).toPandas()
    for i, (mp, cut) in enumerate(runs):
        part = got[got["run"] == i]
        assert dict(zip(part["id"], part["component"])) == brute(ids, x, mp, cut), (mp, cut)
    # fewer links than lists and tree hold together, far fewer than pairs
    assert links.count() <= 7 * 160 + 159


def test_forest_is_a_smallest_tree(spark):
    ids, x = clumps(90)
    df = frame(spark, ids, x)
    nn = knn_join(df, df, 4, qid="id", rid="id").cache()
    core = SP.core_distances(nn, "id", 5).cache()
    got = SP.reachability_forest(df, "id", "z", core, block=30).toPandas()
    c = core.toPandas().set_index("id")["core"].loc[ids].to_numpy()
    w = np.maximum(np.maximum(np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9), c[:, None]), c[None])
    tree, best, left = 0.0, w[0].copy(), np.ones(90, bool)
    left[0] = False
    for _ in range(89):
        at = int(np.where(left, best, np.inf).argmin())
        tree += best[at]
        left[at] = False
        best = np.minimum(best, w[at])
    assert len(got) == 89 and abs(got["w"].sum() - tree) < 1e-6
    at = {v: i for i, v in enumerate(ids)}
    assert all(abs(w[at[r.i], at[r.j]] - r.w) < 1e-9 for r in got.itertuples())


def test_forest_of_given_links(spark):
    links = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 3, 0.0), (3, 4, 9.0), (4, 5, 1.0), (8, 9, 2.0)], "i long, j long, w double")
    got = {tuple(r) for r in SP.spanning_forest(links).collect()}
    assert got == {(1, 2, 1.0), (1, 3, 1.0), (3, 4, 9.0), (4, 5, 1.0), (8, 9, 2.0)}
    assert SP.spanning_forest(links.limit(0)).count() == 0


def test_density_grid_edges(spark):
    ids, x = clumps(60)
    df = frame(spark, ids, x)
    grid = C.density_grid(df, "id", "z", [3, 5], [0.25, 0.5, 1.0]).orderBy("min_pts", "cut").collect()
    assert len(grid) == 6 and all(0 <= r["noise"] <= 1 and r["k"] >= 1 for r in grid)
    assert [r["noise"] for r in grid if r["cut_quantile"] == 1.0] == [0.0, 0.0]
    assert C.density_grid(df.limit(0), "id", "z", [3]).count() == 0
    none, runs = C.density_clusters(df.limit(1), "id", "z", [3], 2)
    assert runs == [] and none.select("cluster", "noise").first() == (0, True)
    # no row of the largest minPts has that many neighbours, the smaller one still has its clusters
    few = C.density_grid(df.orderBy("id").limit(4).withColumn("z", F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))), "id", "z", [3, 9], cut=0.5).orderBy("min_pts").collect()
    assert [(r["min_pts"], r["k"], r["noise"]) for r in few] == [(3, 1, 0.0), (9, 0, 1.0)]


@pytest.mark.parametrize("most", [1 << 19, 60])
def test_long_chains_in_parts_of_any_size(spark, monkeypatch, most):
    """Long chains, in one part and in many; one part takes a fixed number of steps, whatever the length."""
    steps = []
    monkeypatch.setattr(SP, "MOST_LINKS", most)
    monkeypatch.setattr(SP, "cut_lineage", lambda df, cut=SP.cut_lineage: (steps.append(1), cut(df))[1])
    rng = np.random.default_rng(2)
    names = rng.permutation(600).tolist()
    pairs = [(names[i], names[i + 1], float(rng.integers(1, 50))) for i in range(599) if i % 200 != 199]
    extra = [(names[a], names[a + 5], 60.0) for a in range(0, 190, 7)]
    links = spark.createDataFrame(pairs + extra, "i long, j long, w double")
    forest = SP.spanning_forest(links).collect()
    assert sorted((r["i"], r["j"], r["w"]) for r in forest) == sorted((min(i, j), max(i, j), w) for i, j, w in pairs)
    want = {x: min(names[k : k + 200]) for k in (0, 200, 400) for x in names[k : k + 200]}
    nodes = spark.createDataFrame([(x,) for x in names] + [(900,)], "id long")
    got = {r["id"]: r["component"] for r in SP.connected_components(nodes, links, "id").collect()}
    assert got == want | {900: 900}
    assert most < 600 or len(steps) <= 5
