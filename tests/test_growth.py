"""Work, copies and results of the pair searches as tables grow."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landstrata.operators import bands, neighbors, pairmetrics, sample


def sides(spark, n):
    v = np.random.default_rng(5).normal(size=(n, 3))
    t = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, z array<double>")
    return neighbors._side(t, "id", "z", (), "q"), neighbors._side(t, "id", "z", (), "r")


def test_small_blocks_do_not_multiply_copies(spark):
    def counted(q, r):
        return pd.DataFrame({"_q": [0], "_r": [0], "d": [0.0]})

    q, r = sides(spark, 400)
    schema = neighbors._pair_schema(q, r)
    most = 2 * neighbors.BLOCKS**2
    assert neighbors.block_product(q, r, counted, schema, 400, 2, 2).count() <= most
    assert neighbors._cell_join(q, r, counted, schema, 400, None, 100.0, 200, 2, 2).count() <= most  # no cell can be left out


def test_cells_that_leave_out_rows_stay(spark):
    v = [[float(i % 20) * 100, float(i)] for i in range(400)]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id bigint, z array<double>")
    got = neighbors.radius_join(t, t, 0.0, 50.0, pivots=40, ref_block=5, query_block=5).collect()
    d = np.sqrt(((np.array(v)[:, None] - np.array(v)[None]) ** 2).sum(2))
    assert sorted((x["i"], x["j"]) for x in got) == [(i, j) for i in range(400) for j in range(400) if i != j and d[i, j] < 50]


def test_blocks_stay_bounded():
    assert neighbors.grown(64, 10**9, 64) == neighbors.MOST_VALUES // 64 and neighbors.grown(4096, 100, 64) == 4096


@pytest.mark.parametrize("spread", [1e-9, 1e-3, 1.0, 1e25])
def test_near_copies_are_told_apart(spread):
    rng = np.random.default_rng(8)
    v = np.concatenate([1.0 + spread * rng.normal(size=(500, 6)), rng.normal(size=(200, 6))])
    v[3] = v[4]
    frame = [pd.DataFrame({f"_{c}": np.arange(700), f"_{c}v": list(v)}) for c in "qr"]
    got = neighbors._topk_kernel(4, True, None)(*frame)
    d = neighbors._exact(v, v, *np.divmod(np.arange(490000), 700)).reshape(700, 700)
    want = [(i, j, d[i, j]) for i in range(700) for j in sorted((j for j in range(700) if j != i), key=lambda j: (d[i, j], j))[:4]]
    assert list(zip(got["_q"], got["_r"], got["d"])) == want


def test_distances_from_products_equal_exact_ones():
    rng = np.random.default_rng(4)
    for scale in (1e-7, 1.0, 1e4):
        q, r = rng.normal(size=(60, 20)) * scale, rng.normal(size=(80, 20)) * scale
        r[:9] = q[:9]
        most = neighbors.square_error(20, 2.0**-53) * ((q * q).sum(1).max() + (r * r).sum(1).max())
        at = np.arange(4800)
        got = neighbors.rounded_distances(neighbors._sq(q, r).ravel(), most, q, r, at)
        assert (got == neighbors._exact(q, r, *np.divmod(at, 80))).all()


def test_places_equal_searchsorted():
    rng = np.random.default_rng(6)
    for edges in (np.append(np.linspace(0, 2, 65)[:-1], np.inf), np.unique(rng.random(50)), np.array([0.5]), np.array([1.0, 1.0])):
        d = np.concatenate([rng.random(1000) * 3 - 0.5, edges[np.isfinite(edges)], [0.0, 2.0]])
        assert (bands._places(edges, d) == np.searchsorted(edges, d, "right")).all()


def test_class_profile_grows_and_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    v, lab = rng.normal(size=(150, 3)), rng.integers(0, 4, 150)
    t = spark.createDataFrame([(i, [float(x) for x in v[i]], int(lab[i])) for i in range(150)], "id bigint, z array<double>, l int")
    got = {(r["i"], r["label"]): r for r in pairmetrics.class_distance_profile(t, t, "id", "z", "l", 0.5, ref_block=20, query_block=30).collect()}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    for i in range(150):
        for c in range(4):
            x = d[i, (lab == c) & (np.arange(150) != i)]
            row = got[i, c]
            assert row["n"] == len(x)
            assert [row["s"], row["lo"], row["e"]] == pytest.approx([x.sum(), x.min(), np.exp(-(x - x.min()) / 0.5).sum()], rel=1e-7)


def test_mixed_keys_do_not_overflow(spark):
    p = 2147483647

    def by_hand(k, seed):
        def rest(a):
            return a % p if a >= 0 else -(-a % p)

        return rest(rest(k * 2654435761 + seed * 40503) * 48271)

    keys = [0, 1, -1, -5, 17, p, -p, -3 * p, 99_999 * 100_000 + 99_998, 9 * 10**18, -9 * 10**18]
    for seed in (0, 11, 10**6):
        got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", sample.mixed("k", seed).alias("h")).collect()
        assert {r["k"]: r["h"] for r in got} == {k: by_hand(k, seed) for k in keys}
    assert spark.range(1).select(sample.mixed(F.lit(None).cast("bigint"), 3)).first()[0] is None


def test_segments_shuffle_once_and_stay_narrow(spark):
    from landstrata.functions import segments
    from landstrata.plans import fixtures, q_scalar

    d = "/root/testdata/sf0.001"
    got = q_scalar._segs(spark, d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = segments.segments_from_rows(fixtures.fx(spark, d, "seg_rows"))
    assert sorted(got.collect()) == sorted(want.collect()) and got.schema.simpleString() == want.schema.simpleString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "collect_list(struct(seg_no" in plan and "0.05" not in plan.split("collect_list(struct(seg_no")[-1]


def test_quantiles_keep_the_values_where_they_are(spark, monkeypatch):
    """The brackets go to the values; no join sorts all values of a group in one task."""
    from landstrata.operators import quantiles

    plans = []
    monkeypatch.setattr(quantiles, "cut_lineage", lambda df, cut=quantiles.cut_lineage: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    t = spark.range(2000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 1009).cast("double").alias("x"))
    got = {r["g"]: r["q50"] for r in quantiles.exact_quantiles(t, ["g"], "x", [0.5]).collect()}
    x = np.arange(2000) * 7 % 1009
    assert got == {g: float(np.median(x[g::2])) for g in (0, 1)}
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
