"""Approximation files, distance bands and inner-product bands against brute force."""

import numpy as np
import pytest

from landstrata.operators import bands, cluster, neighbors, pairs, products, vafile


def table(spark, v, extra=None, names=""):
    rows = [(i, [float(x) for x in row], *(extra[i] if extra else ())) for i, row in enumerate(v)]
    return spark.createDataFrame(rows, "id bigint, z array<double>" + names)


def distances(v):
    return np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 9)


def nearest(d, k):
    out = []
    for i in range(len(d)):
        order = sorted((d[i, j], j) for j in range(len(d)) if j != i)
        out += [(i, j, x, r + 1) for r, (x, j) in enumerate(order[:k])]
    return out


@pytest.mark.parametrize("bits", [1, 4, 8])
@pytest.mark.parametrize("dim", [2, 64])
def test_file_gives_exact_neighbours(spark, bits, dim):
    rng = np.random.default_rng(bits * 100 + dim)
    v = rng.normal(size=(260, dim))
    v[7] = v[3]  # copies, and ties between a row's two sides
    v[20:24] = v[19]
    v[30], v[31] = v[29] + 0.25, v[29] - 0.25
    v[40:, 0] = 1.5 if dim == 2 else v[40:, 0]
    got = neighbors.knn_join(table(spark, v), table(spark, v), 5, bits=bits, ref_block=50, query_block=70).collect()
    want = sorted(nearest(distances(v), 5))
    got = sorted((r["i"], r["j"], r["d"], r["rank"]) for r in got)
    assert [(i, j, r) for i, j, _, r in got] == [(i, j, r) for i, j, _, r in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-8)


def test_few_exact_distances_on_the_test_vectors(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS z")
    n, asked = e.count(), []
    whole = vafile.exact_distances
    monkeypatch.setattr(vafile, "exact_distances", lambda p, *a: (asked.append(p.count()), whole(p, *a))[1])
    assert neighbors.knn_join(e, e, 8, bits=8, ref_block=128).count() == 8 * n
    assert 8 * n <= asked[0] < 0.1 * n * (n - 1)
    left = []
    real = vafile.nearest_candidates
    monkeypatch.setattr(vafile, "nearest_candidates", lambda p, k: (left.append(p.count()), real(p, k))[1])
    neighbors.knn_join(e, e, 8, bits=8).count()
    assert left[0] < 0.1 * n * (n - 1)  # also what the blocks return stays below a tenth of all pairs


def test_joined_vectors_grow_with_the_queries_only(spark, monkeypatch):
    """The bounds leave little more than the answers, however many references there are."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1600, 32))
    asked, whole = [], vafile.exact_distances
    monkeypatch.setattr(vafile, "exact_distances", lambda p, *a: (asked.append(p.count()), whole(p, *a))[1])
    for n in (400, 1600):
        t = table(spark, v[:n])
        got = neighbors.knn_join(t.filter("id < 200"), t, 3, bits=6, ref_block=100).collect()
        want = [x for x in nearest(distances(v[:n]), 3) if x[0] < 200]
        assert sorted((r["i"], r["j"], r["rank"]) for r in got) == sorted((i, j, r) for i, j, _, r in want)
    assert all(600 <= x < 700 for x in asked)


def test_file_radius_predicate_and_no_rows(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 6))
    d = distances(v)
    t = table(spark, v)
    got = neighbors.radius_join(t, t, 0.5, 2.0, bits=5, ref_block=40, query_block=60).collect()
    assert sorted((r["i"], r["j"]) for r in got) == sorted((i, j) for i in range(150) for j in range(150) if i != j and 0.5 <= d[i, j] < 2.0)
    place = [(i // 12, i % 12) for i in range(150)]
    t = table(spark, v, place, ", row int, col int")
    far = [[np.hypot(a[0] - b[0], a[1] - b[1]) >= 3 for b in place] for a in place]
    got = pairs.knn_pairs_spatial(t, 4, 3.0, bits=8, ref_block=40).collect()
    want = nearest(np.where(far, d, np.inf), 4)
    assert sorted((r["i"], r["j"]) for r in got) == sorted(x[:2] for x in want)
    none = t.filter("id < 0")
    assert neighbors.knn_join(none, none, 3, bits=8).count() == 0 and neighbors.radius_join(none, none, 0, 1, bits=8).count() == 0
    assert neighbors.knn_join(none, t, 3, bits=8).count() == 0


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=(200, 9)), np.zeros((3, 9)), np.full((2, 9), 1e6)])
    for bits in (1, 3, 8):
        grid = vafile.Grid(v.min(0), v.max(0), bits)
        codes, rest = grid.encode(v)
        lo, up = vafile._bounds(v, grid.centres(codes), rest)
        true = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
        assert (lo <= true + 1e-9).all() and (true <= up + 1e-9).all()


@pytest.mark.parametrize("low, high, few, within", [(0.5, 0.75, 50_000, ()), (0.0, 0.1, 3, ()), (0.25, 1.0, 3, ("g",)), (0.3, 0.6, 10, ("g",))])
def test_band_equals_listing_all_pairs(spark, low, high, few, within):
    rng = np.random.default_rng(few)
    v = np.round(rng.normal(size=(120, 4)), 1)  # many equal distances
    v[50:60] = v[49]
    group = [(i % 7 % 3,) for i in range(120)]
    t = table(spark, v, group, ", g int")
    d = distances(v)
    all_pairs = [(i, j) for i in range(120) for j in range(120) if i != j and (not within or group[i] == group[j])]
    lo, hi = np.quantile([d[p] for p in all_pairs], [low, high])
    got = bands.band_pairs(t, low, high, within=within, ref_block=40, query_block=50, few=few).collect()
    assert sorted((r["i"], r["j"]) for r in got) == sorted(p for p in all_pairs if lo <= d[p] < hi)


def test_band_without_pairs(spark):
    t = table(spark, np.zeros((1, 3)))
    assert bands.band_pairs(t, 0.2, 0.8).collect() == [] and bands.band_pairs(t.filter("id > 5"), 0.2, 0.8).collect() == []


@pytest.mark.parametrize("n, k, band", [(300, 5, 30), (40, 60, 8), (300, 5, 4096)])
def test_inner_products_equal_brute_force(spark, n, k, band):
    rng = np.random.default_rng(n + k)
    v = rng.normal(size=(n, 5)) * rng.gamma(1.0, 2.0, size=(n, 1))
    v[9] = 0
    v[20:25] = v[19]
    s = np.round(v @ v.T, 9)
    t = table(spark, v)
    got = products.inner_product_join(t, t, k, band=band, query_block=64).collect()
    want = []
    for i in range(n):
        order = sorted((-s[i, j], j) for j in range(n) if j != i)
        want += [(i, j, r + 1) for r, (_, j) in enumerate(order[:k])]
    assert sorted((r["i"], r["j"], r["rank"]) for r in got) == sorted(want)


def test_queries_skip_bands_of_small_norms(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 5)) * rng.gamma(0.5, 3.0, size=(600, 1))
    sent, real = [], products.route
    monkeypatch.setattr(products, "route", lambda q, stats, *a: (sent.append((real(q, stats, *a).count(), q.count() * (len(stats) - len(a[1])))), real(q, stats, *a))[1])
    t = table(spark, v)
    assert products.inner_product_join(t, t, 3, band=30).count() == 1800
    assert sent[0][0] < 0.6 * sent[0][1]
    none = t.filter("id < 0")
    assert products.inner_product_join(t, none, 3).count() == 0 and products.inner_product_join(none, t, 3).count() == 0


def test_ward_of_two_thousand_rows_is_quick():
    import time

    x = np.random.default_rng(1).normal(size=(2000, 4))
    start = time.perf_counter()
    labels = cluster.ward_labels(cluster._distances(x), 12)
    assert time.perf_counter() - start < 30 and set(labels) == set(range(1, 13))
