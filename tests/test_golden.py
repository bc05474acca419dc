"""Known answers written out as literal rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landstrata.functions import indices as I
from landstrata.functions import segments as G
from landstrata.functions import transforms as T
from landstrata.functions.special import log_gamma
from landstrata.operators import grid as GR
from landstrata.operators import masks as M
from landstrata.operators import pairmetrics as PM
from landstrata.operators import pairs as P
from landstrata.operators import stats as ST
from landstrata.operators import survey as S
from landstrata.operators import timeseries as W


def series(spark, by_pixel):
    rows = [(p, t, int(v)) for p, vals in by_pixel.items() for t, v in enumerate(vals)]
    return spark.createDataFrame(rows, "pixel long, t int, ysfc int")


@pytest.mark.parametrize("a,b,want", [([0, 1, 2, 3, 4], [3, 4, 5, 6, 7], [3, 4]), ([20, 21, 0, 1, 2], [0, 1, 2, 3, 4], [0, 1, 2]), ([0, 1], [5, 6], [])])
def test_ysfc_overlap(spark, a, b, want):
    s = series(spark, {1: a, 2: b})
    out = P.ysfc_overlap(spark.createDataFrame([(1, 2)], "i long, j long"), s, "pixel", "ysfc").first()
    assert out["shared"] == want and out["overlap"] == len(want)


@pytest.mark.parametrize("vals,want", [([0, 1, 2, 0, 1, 2, 3, 4], 3), ([0, 1, 2, 0, 1, 2], 3)])
def test_best_step(spark, vals, want):
    runs = W.ysfc_runs(series(spark, {1: vals}), ["pixel"], "t")
    out = W.best_step_per_ysfc(runs, ["pixel"], "t").filter("ysfc = 0").first()
    assert out["t"] == want


def ysfc_with(t, disturbed):
    out, cur = [], 20
    for i in range(t):
        cur = 0 if i in disturbed else cur + 1
        out.append(cur)
    return out


@pytest.mark.parametrize("disturbed,t,n,large", [([5], (2, 8, 12), 3, 2), ([10], (2, 6, 13), 3, 2), ([], (2, 6, 13), 2, 0), ([4, 10], (2, 6, 13), 0, 0), ([6], (2, 6, 13), 0, 0)])
def test_triplets(spark, disturbed, t, n, large):
    c = PM.triplet_constraints(series(spark, {1: ysfc_with(15, disturbed)}), "pixel", "t", "ysfc", *t).collect()
    assert len(c) == n and sum(r["large"] for r in c) == large


def test_triplets_mixed(spark):
    s = series(spark, {1: ysfc_with(15, [5]), 2: ysfc_with(15, [10]), 3: ysfc_with(15, []), 4: ysfc_with(15, [8])})
    assert PM.triplet_constraints(s, "pixel", "t", "ysfc", 2, 8, 12).count() == 8


def test_robust_iqr(spark):
    v = spark.range(1).select(T.robust_iqr(F.lit(535.89), F.lit(378.23), F.lit(456.96), F.lit(561.99))).first()[0]
    assert abs(v - 0.43) < 0.005


def test_scale_guard(spark):
    assert spark.range(1).select(T.zscore(F.lit(5.0), F.lit(2.0), F.lit(1e-12))).first()[0] == 3.0


def test_unknown_transform():
    with pytest.raises(ValueError):
        T.transform(F.lit(1.0), "cube_root_of_seven")


@pytest.mark.parametrize("name", ["log1p", "log10", "sqrt", "cbrt", "log"])
def test_transform_round_trip(spark, name):
    back = spark.range(1).select(T.inverse_transform(T.transform(F.lit(2.5), name), name)).first()[0]
    assert abs(back - 2.5) < 1e-9


def test_kl_is_zero_for_equal_distances(spark):
    rng = np.random.default_rng(1)
    rows = [(1, a, b, float(abs(rng.normal()))) for a in range(5) for b in range(5) if a != b]
    df = spark.createDataFrame(rows, "p int, a int, b int, d double")
    out = PM.soft_neighbourhood_kl(df, ["p"], "a", "d", "d", 0.1, 0.1).first()
    assert abs(out["loss"]) < 1e-9 and out["n_rows_valid"] == 5 and out["mean_overlap"] == 4


def test_kl_needs_two_valid_entries(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.5, 0.1), (1, 1, 0, 0.5, 0.3)], "p int, a int, b int, dr double, dl double")
    assert PM.soft_neighbourhood_kl(df, ["p"], "a", "dr", "dl", 0.1, 0.1).first()["n_rows_valid"] == 0
    with pytest.raises(ValueError):
        PM.soft_neighbourhood_kl(df, ["p"], "a", "dr", "dl", 0.1, 0.1, min_valid=1)


def test_kl_weights(spark):
    rng = np.random.default_rng(2)
    rows = [(p, float(p), a, b, float(abs(rng.normal())), float(abs(rng.normal()))) for p in (1, 3) for a in range(4) for b in range(4) if a != b]
    df = spark.createDataFrame(rows, "p int, w double, a int, b int, dr double, dl double")
    whole = PM.soft_neighbourhood_kl(df, ["p"], "a", "dr", "dl", 0.3, 0.2, weight="w").first()["loss"]
    one, three = (PM.soft_neighbourhood_kl(df.filter(F.col("p") == p), ["p"], "a", "dr", "dl", 0.3, 0.2).first()["loss"] for p in (1, 3))
    assert abs(whole - (one + 3 * three) / 4) < 1e-9


def test_covariance_of_normal_sample(spark):
    x = np.random.default_rng(0).normal([10, 20, 30], [1, 2, 3], (1000, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = ST.matrix(ST.global_covariance(df, ["a", "b", "c"]), ["a", "b", "c"])
    assert np.allclose(got, np.cov(x.T))


def test_windows():
    a, b = GR.SpatialWindow(0, 0, 10, 10), GR.SpatialWindow(5, 8, 10, 10)
    assert a.intersection(b) == GR.SpatialWindow(5, 8, 5, 2) and not a.intersects(GR.SpatialWindow(10, 0, 5, 5))
    w = GR.TemporalWindow(2020, 5)
    assert w.years() == [2016, 2017, 2018, 2019, 2020] and w.expand(2).start_year == 2014 and w.shift(-1).end_year == 2019
    assert w.overlaps(GR.TemporalWindow(2016, 3)) and not w.contains(2015) and w.index_range(2010) == (6, 11)


def test_split_fractions(spark):
    cells = GR.scaffold(spark, 0, 0, 64, 64)
    n = {r["s"]: r["count"] for r in cells.select(GR.split_code("row", "col", 4, 2, 2).alias("s")).groupBy("s").count().collect()}
    assert sum(n.values()) == 64 * 64 and set(n) <= {1, 2, 3} and n[1] > n[3]


def test_year_checks(spark):
    df = spark.createDataFrame([(1, 2000, 1.0)], "pixel long, year int, v double")
    with pytest.raises(ValueError):
        M.year_extract(df, ["pixel"], "year", "v", 1999, 2000, 2005)
    with pytest.raises(ValueError):
        M.threshold("v", "~", 1)


def test_fixed_bins_edges(spark):
    df = spark.createDataFrame([(10.0,), (10.1,), (85.0,), (None,)], "x double")
    assert [r[0] for r in df.select(S.fixed_bins("x", [10, 48, 85], ["a", "b", "c", "d"])).collect()] == ["a", "b", "c", None]


def test_dh_constant(spark):
    df = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert S.dh_breaks(df, "x", 4) == [] and df.select(S.dh_strata("x", [])).distinct().first()[0] == 1


def test_safe_date_and_fraction(spark):
    r = spark.range(1).select(I.safe_date(F.lit(2023), F.lit(2), F.lit(31)).alias("d"), I.frac_year(F.lit("2024-12-31").cast("date")).alias("y")).first()
    assert str(r["d"]) == "2023-02-28" and abs(r["y"] - (2024 + 365 / 366)) < 1e-12


def test_log_gamma(spark):
    xs = [0.5, 1.0, 2.5, 10.0, 171.0, 5000.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(log_gamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], rtol=1e-10, atol=1e-10)


def test_segments_without_match_are_null(spark):
    coefs = "array<double>"
    band = f"struct<coefs:{coefs},rmse:double,mag:double>"
    b = ([0.1, 0.01, 0.3, 0.4], 0.02, -0.2)
    seg = (1, 2000.0, 2001.0, 2001.0, b, b, b, b, b)
    fields = ",".join(f"{n}:{band}" for n in G.BANDS)
    df = spark.createDataFrame([(1, [seg])], f"pixel long, segs array<struct<seg_no:int,t_start:double,t_end:double,t_break:double,{fields}>>")
    out = G.snapshot(df, 1990.0).first()
    assert out["ndvi"] is None and out["spectral_velocity"] is None
    out = G.all_segment_metrics(df, {"x": 2000.5}).first()
    assert abs(out["snap_x_seasonal_amp_nir"] - 0.5) < 1e-12 and out["rapid_loss_year_2"] is None
    assert abs(out["rapid_loss_mean_magnitude"] - math.sqrt(5) * 0.2) < 1e-9
    assert G.with_sentinel(G.snapshot(df, 1990.0), ["ndvi"]).first()["ndvi"] == -9999.0


def test_reductions_of_empty_history(spark):
    df = spark.createDataFrame([(1, [])], "pixel long, v array<double>")
    assert [df.select(G.array_reduce(F.col("v"), h)).first()[0] for h in ("first", "mean", "variance", "max", "sum")] == [None] * 5
