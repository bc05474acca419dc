"""Skew, duplicates and the paths for large tables, checked against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landstrata.operators import cluster as C
from landstrata.operators import features as X
from landstrata.operators import fit as L
from landstrata.operators import neighbors as NB
from landstrata.operators import pairmetrics as PM
from landstrata.operators import pairs as P
from landstrata.operators import places as PL
from landstrata.operators import sample as N
from landstrata.operators import survey as S
from landstrata.operators.quantiles import exact_quantiles, rank_quantiles
from landstrata.operators.ranks import global_prefix_sum, global_rank, group_average_rank


def skewed(n=600, d=6, seed=0):
    """A third of the rows are copies of one vector, the rest sit in unequal clumps."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * 0.2 + rng.integers(0, 4, n)[:, None] ** 2
    x[: n // 3] = x[0]
    return rng.permutation(n), x


def frame(spark, ids, x, **extra):
    pdf = pd.DataFrame({"id": ids, "z": [r.tolist() for r in x], **extra})
    return spark.createDataFrame(pdf)


def brute_knn(ids, x, k, allow=None):
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    d[np.arange(len(x)), np.arange(len(x))] = np.inf
    if allow is not None:
        d[~allow] = np.inf
    out = set()
    for a in range(len(x)):
        best = sorted((d[a, b], ids[b]) for b in range(len(x)) if np.isfinite(d[a, b]))[:k]
        out |= {(ids[a], j, r + 1) for r, (_, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("kw", [{}, {"pivots": 12, "ref_block": 40, "query_block": 50}, {"ref_block": 100}])
def test_knn_with_copies(spark, kw):
    ids, x = skewed()
    df = frame(spark, ids, x)
    got = {(r["i"], r["j"], r["rank"]) for r in NB.knn_join(df, df, 4, **kw).collect()}
    assert got == brute_knn(ids, x, 4)


def test_knn_ignores_broken_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, float("nan")]), (3, [0.0, 2.0]), (4, None)], "id long, z array<double>")
    assert {(r["i"], r["j"]) for r in NB.knn_join(df, df, 3).collect()} == {(1, 3), (3, 1)}


@pytest.mark.parametrize("pivots", [None, 9])
def test_knn_spatial_exclusion(spark, pivots):
    rng = np.random.default_rng(3)
    cells = rng.choice(900, 300, replace=False)
    row, col = cells // 30, cells % 30
    x = rng.normal(size=(300, 3))
    ids = cells.astype(int)
    far = np.hypot(row[:, None] - row[None], col[:, None] - col[None]) >= 5
    df = frame(spark, ids, x, row=row, col=col)
    kw = {"pivots": pivots, "ref_block": 50, "query_block": 60} if pivots else {}
    got = {(r["i"], r["j"], r["rank"]) for r in P.knn_pairs_spatial(df, 3, 5.0, **kw).collect()}
    assert got == brute_knn(ids, x, 3, far)


@pytest.mark.parametrize("block", [4096, 17])
def test_search_within_a_key(spark, block):
    rng = np.random.default_rng(8)
    n = 260
    x, key = rng.normal(size=(n, 4)), np.where(np.arange(n) % 3 == 0, 0, np.arange(n) % 11 + 1)
    df = frame(spark, np.arange(n), x, g=key)
    same = key[:, None] == key[None]
    got = {(r["i"], r["j"], r["rank"]) for r in P.knn_pairs(df, 4, within=("g",), ref_block=block, query_block=block).collect()}
    assert got == brute_knn(np.arange(n), x, 4, same)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    want = {(a, b) for a in range(n) for b in range(n) if a != b and same[a, b] and d[a, b] < 1.5}
    got = {(r["i"], r["j"]) for r in NB.radius_join(df, df, 0.0, 1.5, within=("g",), ref_block=block, query_block=block).collect()}
    assert got == want


def test_rows_are_copied_within_their_key_only(spark):
    df = spark.range(600).select(F.col("id").alias("_q"), F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 50 + 1).cast("int").alias("_w0"))
    q, r = NB.scoped_blocks(df, df.withColumnRenamed("_q", "_r"), ["_w0"], 64, 32)
    copies = {x["_w0"]: x["m"] for x in q.groupBy("_w0", "_q").count().groupBy("_w0").agg(F.max("count").alias("m")).collect()}
    assert copies.pop(0) == 4 and set(copies.values()) == {1}  # 200 references in blocks of 64; 8 in one block
    assert r.groupBy("_w0", "_sub", "_qc").count().agg(F.max("count")).first()[0] < 200


def test_landmarks_beyond_the_shipped_ones(spark):
    rng = np.random.default_rng(5)
    x, m = rng.normal(size=(40, 3)), rng.normal(size=(25, 3))
    df, marks = frame(spark, np.arange(40), x), frame(spark, np.arange(100, 125), m)
    for metric in ("l2", "l1", "cosine"):
        few, many = ({(r["i"], r["j"]): r["d"] for r in P.pairwise_distance(df, "id", "z", marks, "id", "z", metric, shipped=s).collect()} for s in (25, 7))
        assert few.keys() == many.keys() and len(few) == 1000 and all(abs(few[p] - many[p]) < 1e-12 for p in few)
    near = x[:1] + 1e-9
    got = P.pairwise_distance(frame(spark, [0], x[:1] * 1e4), "id", "z", frame(spark, [1], near * 1e4), "id", "z").first()["d"]
    assert abs(got - np.sqrt(3) * 1e-5) < 1e-9  # digits that an expanded square would lose


def test_centroids_beyond_the_shipped_ones(spark, monkeypatch):
    from landstrata.operators import knn as K

    rng = np.random.default_rng(6)
    df, c = frame(spark, np.arange(60), rng.normal(size=(60, 3)), g=np.arange(60) % 2), frame(spark, np.arange(30), rng.normal(size=(30, 3)), g=np.arange(30) % 2)
    for same in (None, "g"):
        few = {r["id"]: (r["centroid"], round(r["d"], 6)) for r in K.nearest_centroid(df, "id", "z", c, "id", "z", same).collect()}
        monkeypatch.setattr(K, "MAX_CENTROIDS", 5)
        assert few == {r["id"]: (r["centroid"], round(r["d"], 6)) for r in K.nearest_centroid(df, "id", "z", c, "id", "z", same).collect()}
        monkeypatch.undo()


def test_large_samples_are_cut_at_a_rank(spark):
    from landstrata.operators import sample as N

    df = spark.range(5000).withColumn("w", (F.col("id") % 7).cast("double"))
    got = {r["id"] for r in N.epoch_sample(df, ["id"], "number", 1234, seed=3).collect()}
    want = [r["id"] for r in df.withColumn("h", N.seeded(3, "id")).orderBy("h", "id").limit(1234).collect()]
    assert got == set(want)
    for out in (N.epoch_sample(df, ["id"], "frac", 0.3), N.reservoir(df, 2000, ["id"]), N.cap_pairs(df.select(F.col("id").alias("i"), F.col("id").alias("j")), 900)):
        assert "TakeOrderedAndProject" not in out._jdf.queryExecution().executedPlan().toString()
    draws = N.weighted_bootstrap(df, ["id"], "w", 20_000, seed=1)
    assert "Join [_b" not in draws._jdf.queryExecution().executedPlan().toString()
    share = {r["w"]: r["count"] / 20_000 for r in draws.groupBy("w").count().collect()}
    assert draws.count() == 20_000 and 0.0 not in share and all(abs(share[w] - w / 21) < 0.02 for w in share)


def test_codes_outside_the_class_table(spark):
    from landstrata.operators import stats as T

    df = spark.createDataFrame([(3,), (3,), (300,), (None,), (-1,)], "code int")
    got = {r["code"]: r["n"] for r in T.legacy_class_table(df, "code").collect()}
    assert len(got) == 258 and got[3] == 2 and got[300] == 1 and got[None] == 1 and got[-1] == 1 and got[0] == 0


def test_silhouette_on_squared_distances(spark):
    rng = np.random.default_rng(7)
    x, lab = rng.normal(size=(80, 3)), np.append(rng.integers(0, 3, 79), 9)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    s = []
    for i in range(80):
        own = (lab == lab[i]) & (np.arange(80) != i)
        if not own.any():
            s.append(0.0)
            continue
        a, b = d2[i, own].mean(), min(d2[i, lab == c].mean() for c in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b))
    from landstrata.operators import cluster as C

    assert abs(C.silhouette(frame(spark, np.arange(80), x, lab=lab), "id", "z", "lab") - np.mean(s)) < 1e-9


def test_cross_patch_pairs_follow_the_anchors(spark):
    from landstrata.operators import places as PL

    for patches, per in ((3, 4), (200, 2)):
        a = spark.range(600).select("id", (F.col("id") % patches).alias("patch"))
        got = PL.cross_patch_negatives(a, "patch", "id", per).collect()
        assert 0 < len(got) <= per * 600 and all(r["patch_i"] != r["patch_j"] and r["i"] % patches != r["j"] % patches for r in got)
        assert len(got) > 0.9 * per * 600


def test_one_scan_where_one_is_enough(spark, tmp_path):
    from landstrata.operators import masks, survey
    from landstrata.operators import stats as T

    path = str(tmp_path / "t")
    spark.range(200).select((F.col("id") % 20).alias("k"), (F.col("id") % 9).cast("int").alias("yr"), (F.col("id") % 3).cast("string").alias("g"),
                            F.col("id").cast("double").alias("y")).dropDuplicates(["k", "yr"]).write.parquet(path)
    df = spark.read.parquet(path)
    for out in (masks.reindex_years(df.select("k", "yr", "y"), ["k"], "yr", 2, 5), survey.per_unit_table(df, "k", {"a": "g", "b": "yr"}, "y"), T.channel_stats(df, ["y"], probs=[])):
        assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    full = masks.reindex_years(df.select("k", "yr", "y"), ["k"], "yr", 2, 5)
    assert full.count() == 4 * df.select("k").distinct().count()


def test_mutual_is_symmetric(spark):
    ids, x = skewed(200)
    got = {(r["i"], r["j"]) for r in P.mutual_knn_pairs(frame(spark, ids, x), 5).collect()}
    assert got == {(j, i) for i, j in got} and got


def test_radius_join_cells(spark):
    ids, x = skewed(300, 4)
    df = frame(spark, ids, x)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    want = {(ids[a], ids[b]) for a in range(300) for b in range(300) if a != b and 0.1 <= d[a, b] < 0.5}
    got = {(r["i"], r["j"]) for r in NB.radius_join(df, df, 0.1, 0.5, pivots=10, ref_block=30, query_block=40).collect()}
    assert got == want


def test_exact_quantiles_with_hot_value(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([np.full(1000, 7.0), rng.normal(5, 3, 2000)])
    g = np.where(np.arange(3000) % 10 == 0, "b", "a")
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))
    probs = [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]
    for out in (exact_quantiles(df, ["g"], "v", probs), rank_quantiles(df, ["g"], "v", probs)):
        for r in out.collect():
            want = np.quantile(v[g == r["g"]], probs)
            assert np.allclose([r[c] for c in ("q00", "q02", "q25", "q50", "q75", "q98", "q100")], want)


def test_exact_quantiles_survive_a_coarse_sketch(spark, monkeypatch):
    from landstrata.operators import quantiles as Q

    v = np.random.default_rng(5).normal(size=20000)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    probs = [0.02, 0.5, 0.98]
    for accuracy, margin in ((100, 0.04), (100, 0.0)):  # wide brackets, then brackets that may miss
        monkeypatch.setattr(Q, "ACCURACY", accuracy)
        monkeypatch.setattr(Q, "MARGIN", margin)
        r = Q.exact_quantiles(df, [], "v", probs).first()
        assert np.allclose([r["q02"], r["q50"], r["q98"]], np.quantile(v, probs))
    monkeypatch.setattr(Q, "MAX_GROUPS", 2)
    many = df.withColumn("g", F.pmod(F.hash("v"), F.lit(5)))
    out = Q.exact_quantiles(many, ["g"], "v", probs, extra={"n": (F.count("_v"), "bigint")})
    assert out.count() == 5 and out.agg(F.sum("n")).first()[0] == 20000


def test_quantiles_of_null_groups_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None)], "g string, v double")
    got = {r["g"]: r["q50"] for r in exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {None: 2.0, "a": 2.0}
    assert exact_quantiles(df.filter("v > 9"), ["g"], "v", [0.5]).count() == 0


def test_global_ranks(spark):
    v = [3.0, 1.0, 2.0, 2.0, 2.0, 9.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v double")
    got = {r["id"]: r["r"] for r in global_rank(df, [F.col("v"), F.col("id")], "r").collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 0: 5, 5: 6}
    avg = {r["id"]: r["r"] for r in group_average_rank(df, "v", "r").collect()}
    assert avg[2] == avg[3] == avg[4] == 3.0 and avg[0] == 5.0
    cum = {r["id"]: r["c"] for r in global_prefix_sum(df, [F.col("id")], "v", "c").collect()}
    assert cum[5] == sum(v) and cum[0] == 3.0


@pytest.mark.parametrize("n,k", [(10, 4), (3, 5), (23, 5)])
def test_quantile_bins_are_balanced(spark, n, k):
    df = spark.range(n).withColumn("x", (F.col("id") * 7) % 5)
    sizes = sorted((r["q"], r["count"]) for r in S.quantile_bins(df, "x", k, "id", "q").groupBy("q").count().collect())
    want = [n // k + (1 if i < n % k else 0) for i in range(k)]
    assert [c for _, c in sizes] == [w for w in want if w]


def test_reservoir_is_a_subset_of_the_right_size(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, "big").otherwise((F.col("id") % 3).cast("string")))
    got = N.reservoir(df, 50, ["id"], ["g"], seed=3).groupBy("g").count().collect()
    assert {r["count"] for r in got} == {50} and len(got) == 4
    again = N.reservoir(df.repartition(7), 50, ["id"], ["g"], seed=3)
    assert again.join(N.reservoir(df, 50, ["id"], ["g"], seed=3), ["id"], "left_anti").count() == 0


def test_weighted_supplement_prefers_weight(spark):
    df = spark.range(2000).withColumns({"p": F.lit(1), "w": F.when(F.col("id") < 1000, 9.0).otherwise(1.0)})
    got = N.supplement(df, 400, ["p"], ["id"], "w", seed=5)
    assert got.count() == 400 and got.filter("id < 1000").count() > 300
    zero = N.supplement(df.withColumn("w", F.lit(0.0)), 400, ["p"], ["id"], "w", seed=5)
    assert zero.count() == 400


def test_cross_patch_negatives_are_balanced(spark):
    a = spark.range(120).withColumn("patch", F.when(F.col("id") < 80, 0).otherwise(1 + F.col("id") % 3))
    out = PL.cross_patch_negatives(a, "patch", "id", 6)
    sizes = {r["count"] for r in out.groupBy("patch_i", "patch_j").count().collect()}
    at = {r["id"]: r["patch"] for r in a.collect()}
    assert sizes == {6 * 120 // 12} and all(at[r["i"]] != at[r["j"]] for r in out.collect())


def test_chunk_batches_with_replacement(spark):
    df = spark.range(25).withColumn("c", F.col("id") % 2)
    out = N.chunk_batches(df, ["c"], ["id"], 5, replacement=True)
    assert {r["count"] for r in out.groupBy("c", "batch").count().collect()} == {5}
    assert out.filter("id % 2 <> c").count() == 0


# fits ----------------------------------------------------------------------------------------


def test_ridge_against_normal_equations(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(3, 2, (400, 5)), rng.normal(size=(5, 2))
    y = x @ w + [1.0, -2.0] + rng.normal(0, 0.1, (400, 2))
    df = spark.createDataFrame(pd.DataFrame({"x": [r.tolist() for r in x], "a": y[:, 0], "b": y[:, 1]}))
    f = L.ridge_fit(df, "x", 5, ["a", "b"], 0.7)
    xa = np.hstack([x, np.ones((400, 1))])
    reg = 0.7 * np.eye(6)
    reg[5, 5] = 0
    want = np.linalg.solve(xa.T @ xa + reg, xa.T @ y)
    assert np.allclose(f.weights, want[:5]) and np.allclose(f.bias, want[5])


def test_oof_equals_refit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, 2.0, -1.0] + rng.normal(size=200)
    fold = np.arange(200) % 5
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "x": [r.tolist() for r in x], "y": y, "fold": fold}))
    got = L.oof_linear(df, "x", 3, "y", "fold").orderBy("id").toPandas()["score"].to_numpy()
    want = np.empty(200)
    for f in range(5):
        tr = fold != f
        b = np.linalg.lstsq(np.hstack([x[tr], np.ones((tr.sum(), 1))]), y[tr], rcond=None)[0]
        want[~tr] = x[~tr] @ b[:3] + b[3]
    assert np.allclose(got, want)


def natural(x, kn):
    cube = lambda k: np.maximum(x - k, 0) ** 3
    bend = lambda k: (cube(k) - cube(kn[-1])) / (kn[-1] - k)
    return np.column_stack([x] + [bend(k) - bend(kn[-2]) for k in kn[:-2]])


def test_spline_calibration(spark):
    rng = np.random.default_rng(2)
    n = 300
    x, u, fold = rng.uniform(0, 100, n), rng.integers(0, 3, n), np.arange(n) % 5
    y = np.sin(x / 20) * 30 + u * 4 + rng.normal(0, 2, n)
    df = spark.createDataFrame(pd.DataFrame({"u": u, "x": x, "y": y, "fold": fold}))
    got = L.calibration_variance(df, "u", [0, 1, 2], "y", "fold", spline="x")
    pred = np.empty(n)
    for f in range(5):
        tr = fold != f
        kn = np.quantile(x[tr], [0, 0.25, 0.5, 0.75, 1])
        z = lambda m: np.hstack([np.ones((m.sum(), 1)), (u[m, None] == [1, 2]), natural(x[m], kn)])
        b = np.linalg.lstsq(z(tr), y[tr], rcond=None)[0]
        pred[~tr] = z(~tr) @ b
    r = y - pred
    ss = sum(((r[u == k] - r[u == k].mean()) ** 2).sum() for k in range(3))
    assert abs(got - ss / (n - 3)) < 1e-5 * got


def test_interaction_pca_scores_are_white(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4)) + 5
    df = spark.createDataFrame(pd.DataFrame({"x": [r.tolist() for r in x]}))
    p = L.interaction_pca(df, "x", 4, 2)
    s = np.array([r[0] for r in df.select(p.scores("x")).collect()])
    assert np.allclose(np.cov(s.T, ddof=0), np.eye(2), atol=1e-8) and 0 < p.explained.sum() <= 1


def test_whitening_is_mahalanobis(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3, 3))
    cov = a @ a.T + np.eye(3)
    w = X.whitening_factor(cov, 0.0)
    v = rng.normal(size=3)
    assert abs(((w @ v) ** 2).sum() - v @ np.linalg.inv(cov) @ v) < 1e-9
    assert np.allclose(X.whitening_factor(cov, 0.0, "lower"), w.T)
    df = spark.createDataFrame([(1.0, None, 100.0)], "a double, b double, c double")
    out = df.select(X.whiten([F.col(c) for c in "abc"], [0, 0, 0], np.eye(3))).first()[0]
    assert out == [1.0, 0.0, 5.0]


# clusters ------------------------------------------------------------------------------------


def clumps(n=300, seed=0):
    rng = np.random.default_rng(seed)
    c = np.arange(n) % 3
    return c, rng.normal(size=(n, 2)) * 0.3 + np.array([[0, 0], [5, 0], [0, 6]])[c]


@pytest.mark.parametrize("kind", ["diag", "full", "tied", "spherical"])
def test_mixture_recovers_clumps(spark, kind):
    c, x = clumps()
    df = frame(spark, np.arange(len(x)), x)
    m = C.gmm_fit(df, "z", 3, kind, max_iter=20)
    assert np.allclose(sorted(m.weights), [1 / 3] * 3, atol=1e-3) and m.converged and m.aic < m.bic
    lab = C.gmm_predict(df, "id", "z", m).orderBy("id").toPandas()["cluster"].to_numpy()
    assert all(len(set(lab[c == k])) == 1 for k in range(3)) and len(set(lab)) == 3
    means = np.array(sorted(m.means.tolist()))
    assert np.allclose(means, sorted([x[c == k].mean(0).tolist() for k in range(3)]), atol=1e-3)


def test_silhouette(spark):
    c, x = clumps(90)
    df = frame(spark, np.arange(90), x, lab=c)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(90):
        a = d[i, (c == c[i]) & (np.arange(90) != i)].mean()
        b = min(d[i, c == k].mean() for k in range(3) if k != c[i])
        s.append((b - a) / max(a, b))
    assert abs(C.silhouette_euclidean(df, "id", "z", "lab", None) - np.mean(s)) < 1e-6
    assert C.silhouette_euclidean(df.withColumn("lab", F.lit(1)), "id", "z", "lab", None) == -1.0
    assert C.silhouette(df.withColumn("lab", F.lit(1)), "id", "z", "lab") == -1.0


def brute_ward(x, k):
    groups = [[i] for i in range(len(x))]
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
    while len(groups) > k:
        a, b = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[b] = groups[b] + groups[a]
        del groups[a]
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed,k", [(0, 3), (1, 5), (2, 1)])
def test_ward(seed, k):
    x = np.random.default_rng(seed).normal(size=(25, 3))
    lab = C.ward_labels(C._distances(x), k)
    assert {frozenset(np.flatnonzero(lab == c).tolist()) for c in set(lab)} == brute_ward(x, k) and lab[0] == 1


def test_cannot_link(spark):
    rng = np.random.default_rng(5)
    cls = np.repeat(np.arange(8), 30)
    x = rng.normal(size=(240, 3)) * 0.1 + rng.normal(size=(8, 3))[cls]
    df = frame(spark, np.arange(240), x, cls=cls, tree=(cls < 3))
    _, group = C.ward_on_centroids(df, "id", "z", 3, "cls", 4, 10, "tree")
    tree = {group[c] for c in range(3)}
    assert not tree & {group[c] for c in range(3, 8)} and len(set(group.values())) == 4


def test_subdivide(spark):
    rng = np.random.default_rng(6)
    b = np.arange(200) % 4
    x = rng.normal(size=(200, 2)) * 0.01
    half = (np.arange(200) // 4) % 2
    x[b == 2] += np.where(half[b == 2], 10, -10)[:, None]
    out = C.subdivide_by_phase(frame(spark, np.arange(200), x, b=b), "id", "b", "z", 2, 0.25, 2).toPandas().sort_values("id")
    sub = out["phase_sub"].to_numpy()
    assert (sub[b != 2] == 1).all() and len(set(sub[(b == 2) & (half == 0)])) == 1 and set(sub[b == 2]) == {1, 2}


@pytest.mark.parametrize("kw", [{}, {"pivots": 8, "ref_block": 30, "query_block": 30}])
def test_links_and_components(spark, kw):
    ids, x = skewed(240, 3, 7)
    df = frame(spark, ids, x)
    cut = 0.35
    near = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9) <= cut
    lab = np.arange(240)
    while True:
        new = np.array([lab[near[i]].min() for i in range(240)])
        if (new == lab).all():
            break
        lab = new
    want = {frozenset(ids[lab == c].tolist()) for c in set(lab)}
    edges = C.link_within(df, "id", "z", cut, **kw)
    comp = C.connected_components(df, edges, "id").toPandas()
    got = {frozenset(g["id"].tolist()) for _, g in comp.groupby("component")}
    assert got == want and (comp["component"] <= comp["id"]).all()
    assert edges.count() < near.sum() / 10


def test_density_clusters(spark):
    c, x = clumps(150, 8)
    x[0] = [40.0, 40.0]
    out, runs = C.density_clusters(frame(spark, np.arange(150), x), "id", "z", [4, 6], 3, cut=1.0)
    p = out.toPandas().sort_values("id")
    assert p["cluster"].nunique() == 3 and p["noise"].iloc[0] and (p["cluster"] > 0).all() and len(runs) == 2
    for k in range(3):
        assert p["cluster"].to_numpy()[(c == k) & ~p["noise"].to_numpy()].std() == 0


def test_class_profile_blocks(spark):
    ids, x = skewed(150, 3)
    lab = np.arange(150) % 4
    df = frame(spark, ids, x, lab=lab)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = PM.class_distance_profile(df, df, "id", "z", "lab", 0.5, ref_block=40, query_block=64).toPandas()
    at = {v: i for i, v in enumerate(ids)}
    for r in got.sample(60, random_state=1).itertuples():
        m = (lab == r.label) & (np.arange(150) != at[r.i])
        row = d[at[r.i]][m]
        assert r.n == m.sum() and abs(r.s - row.sum()) < 1e-5 and abs(r.e - np.exp(-(row - row.min()) / 0.5).sum()) < 1e-5


def test_neighbour_baseline(spark):
    rng = np.random.default_rng(9)
    z, y = rng.normal(size=(80, 6)), rng.normal(size=80)
    df = frame(spark, np.arange(80), z, y=y)
    got = P.baseline_demean_by_neighbours(df, "id", "z", 6, ["y"], 3, 5).orderBy("id").toPandas()["y_demeaned"].to_numpy()
    zc = z - z.mean(0)
    u = np.linalg.svd(zc, full_matrices=False)[0][:, :3]
    sim = u @ u.T
    np.fill_diagonal(sim, -np.inf)
    want = np.array([y[i] - y[np.argsort(-sim[i])[:5]].mean() for i in range(80)])
    assert np.allclose(got, want)


def test_pooled_within_never_exceeds_total(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("u"), (F.col("id") % 7).alias("s"), F.rand(1).alias("y"))
    a = S.pooled_within(df, ["u"], "y").first()["within_var"]
    ss = S.pooled_within(df, ["u", "s"], "y").first()
    assert ss["within_var"] * (ss["n"] - ss["cells"]) <= a * 497 + 1e-9


def test_stream_ignores_older_years(spark, tmp_path):
    from landstrata.streaming import streams as ST

    src = str(tmp_path / "in")
    for i, rows in enumerate([[(1, 2000, 15), (1, 2001, 3)], [(1, 1999, 5), (1, 2002, 15)]]):
        spark.createDataFrame(rows, "pixel long, yr int, change int").coalesce(1).write.mode("append").parquet(f"{src}/{i}")
    recs = spark.readStream.schema("pixel long, yr int, change int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(src)
    out = ST.run_to_table(ST.stream_change_state(recs, "pixel", "yr", "change"), "append", "late").orderBy("yr").collect()
    assert [(r["yr"], r["last_fast_year"], r["cum_events"], r["late"]) for r in out] == [
        (1999, None, None, True), (2000, 1980, 0, False), (2001, 2001, 1, False), (2002, 2001, 1, False)]


def test_top_per_group_beyond_the_group_limit(spark):
    from landstrata.operators.ranks import top_per_group

    df = spark.range(9000).select(F.when(F.col("id") % 9 < 6, "hot").otherwise("cold").alias("g"), ((F.col("id") * 7919) % 10007).alias("o"), "id")
    got = top_per_group(df, 1500, ["g"], ["o", "id"]).toPandas()
    want = df.toPandas().sort_values(["o", "id"]).groupby("g").head(1500)
    assert set(got["id"]) == set(want["id"]) and len(got) == 3000


def test_stream_windows_ignore_the_session_zone(spark):
    from landstrata.streaming import streams as ST

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        r = spark.range(1).select(F.lit("2024-01-05 23:30:00").cast("timestamp_ntz").alias("t")).select("t", ST.utc_clock("t").alias("u"))
        r = r.withColumn("w", F.window("u", "1 day")["start"]).select("t", "u", "w").withColumns({"back": ST.wall_clock("u"), "day": ST.wall_clock("w")}).first()
        assert r["back"] == r["t"] and str(r["day"]) == "2024-01-05 00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
