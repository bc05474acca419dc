"""Scalar, index, transform and segment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indices as I
from ..functions import segments as G
from ..functions import transforms as T
from ..functions import vectors as V
from .fixtures import BANDS, SEG_COLUMNS, ctes, fx, read, seg_parts
from .registry import R, query, rounded, rounds

# --- QA and indices --------------------------------------------------------------------------


@query("f01_clear_land_fmask", ctes("obs") + """
select pixel, day, fmask, cast((fmask >> 1) & 1 as int) cloud, (fmask & 63) = 0 as clear from obs""")
def _(spark, d):
    return fx(spark, d, "obs").select("pixel", "day", "fmask", I.bit("fmask", 1).alias("cloud"), I.clear_land_fmask("fmask").alias("clear"))


@query("f02_clear_landsat", ctes("obs") + """
select pixel, day, qa, radsat, (qa & 63) = 0 and ((qa >> 7) & 1) = 0 and radsat = 0 as clear from obs""")
def _(spark, d):
    return fx(spark, d, "obs").select("pixel", "day", "qa", "radsat", I.clear_landsat("qa", "radsat").alias("clear"))


@query("f03_qa_interp", ctes("obs") + "select qa & 1 as interp, count(*) n from obs group by 1")
def _(spark, d):
    return fx(spark, d, "obs").groupBy(I.qa_interp("qa").alias("interp")).agg(F.count("*").alias("n"))


@query("f04_scale_sr", """
select l_orderkey, l_linenumber, round(l_extendedprice * 0.0000275 - 0.2, 6) sr from lineitem""")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R(I.scale_sr("l_extendedprice"), 6).alias("sr"))


_ND = "case when {a} > 0 and {b} > 0 and {a} + {b} > 0.02 and abs(({a} - {b}) / ({a} + {b})) <= 1 then ({a} - {b}) / ({a} + {b}) end"
_IDX_SQL = {
    "ndvi": "case when nir > 0 and nir + red > 0.02 and abs((nir - red) / (nir + red)) <= 1 then (nir - red) / (nir + red) end",
    "nbr": _ND.format(a="nir", b="swir2"),
    "ndmi": _ND.format(a="nir", b="swir1"),
    "evi": "case when nir + 6 * red - 7.5 * blue + 1 > 0.02 and nir > 0 and abs(2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1)) <= 2.5 "
           "then 2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1) end",
    "evi2": "case when nir + 2.4 * red + 1 > 0.02 and nir > 0 and abs(2.5 * (nir - red) / (nir + 2.4 * red + 1)) <= 2.5 "
            "then 2.5 * (nir - red) / (nir + 2.4 * red + 1) end",
    "fi": "(nir + swir1 + swir2) / 3",
}
IDX_CTE = "idx as (select obs.*, " + ", ".join(f"{v} as {k}" for k, v in _IDX_SQL.items()) + ", dayofyear(ts) - 1 as doy from obs)"


def _safe(name, *idx):
    @query(name, ctes("obs") + ", " + IDX_CTE + f" select pixel, day, sensor, {rounds(list(idx), 6)} from idx")
    def _(spark, d):
        return rounded(I.add_indices(fx(spark, d, "obs")).select("pixel", "day", "sensor", *idx), 6)


_safe("f05_safe_nd", "ndvi", "nbr", "ndmi")
_safe("f06_safe_evi", "evi", "evi2")
_safe("f10_add_indices", "fi", "ndvi", "evi")


@query("f07_eps_indices", ctes("annual") + """
select pixel, yr, round((nir - red) / (nir + red + 1e-6), 6) ndvi, round((nir - swir2) / (nir + swir2 + 1e-6), 6) nbr,
  round((nir - swir1) / (nir + swir1 + 1e-6), 6) ndmi from annual""")
def _(spark, d):
    return fx(spark, d, "annual").select(
        "pixel", "yr", R(I.ndvi("nir", "red"), 6).alias("ndvi"), R(I.nbr("nir", "swir2"), 6).alias("nbr"),
        R(I.ndmi("nir", "swir1"), 6).alias("ndmi"))


@query("f08_index_derivative", ctes("annual") + """
select pixel, yr, round(2 * (red * swir1 - nir * swir2) / ((nir + red + 1e-6) * (nir + red + 1e-6) + 1e-6), 6) dndvi from annual""")
def _(spark, d):
    return fx(spark, d, "annual").select("pixel", "yr", R(I.index_derivative("nir", "red", "swir1", "swir2"), 6).alias("dndvi"))


@query("f09_tasseled_cap", ctes("obs") + """
select pixel, day, round(0.4596 * green + 0.5046 * red + 0.5458 * nir + 0.4114 * swir1 + 0.2589 * swir2, 6) tcb,
  round(-0.3374 * green - 0.4901 * red + 0.7909 * nir + 0.0177 * swir1 - 0.1416 * swir2, 6) tcg,
  round(0.2254 * green + 0.3681 * red + 0.2250 * nir - 0.6053 * swir1 - 0.6298 * swir2, 6) tcw from obs""")
def _(spark, d):
    return rounded(fx(spark, d, "obs").withColumns(I.tasseled_cap(*BANDS)).select("pixel", "day", "tcb", "tcg", "tcw"), 6)


@query("f45_ndvi_positive_sum", ctes("obs") + """
select pixel, day, round(case when nir + red > 0 then (nir - red) / (nir + red) end, 6) ndvi from obs""")
def _(spark, d):
    return fx(spark, d, "obs").select("pixel", "day", R(I.ndvi_positive_sum("nir", "red"), 6).alias("ndvi"))


@query("f11_doy", """
select o_orderkey, cast(dayofyear(o_orderdate) - 1 as int) doy0, cast(dayofyear(o_orderdate) as int) doy1 from orders""")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", I.doy("o_orderdate", 0).alias("doy0"), I.doy("o_orderdate", 1).alias("doy1"))


@query("f12_frac_year", """
select o_orderkey, round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / dayofyear(make_date(year(o_orderdate), 12, 31)), 6) yf from orders""")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", R(I.frac_year("o_orderdate"), 6).alias("yf"))


@query("f13_safe_date", """
select o_orderkey, cast(make_date(year(o_orderdate), month(o_orderdate),
  least(31 - o_custkey % 4, day(last_day(cast(o_orderdate as date))))) as string) d from orders""")
def _(spark, d):
    return read(spark, d, "orders").select(
        "o_orderkey",
        I.safe_date(F.year("o_orderdate"), F.month("o_orderdate"), (31 - F.col("o_custkey") % 4).cast("int")).cast("string").alias("d"))


@query("f14_hydro_season", """
select o_orderkey, cast(year(o_orderdate) + case when month(o_orderdate) >= 10 then 1 else 0 end as int) hydro_year,
  case when month(o_orderdate) in (12, 1, 2) then 'winter' when month(o_orderdate) in (6, 7, 8) then 'summer' end season from orders""")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", I.hydro_year("o_orderdate").alias("hydro_year"), I.season("o_orderdate").alias("season"))


# --- transforms and normalisers --------------------------------------------------------------


@query("f15_transform", """
select c_custkey, round(case when c_acctbal > -1 then ln(1 + c_acctbal) end, 6) t_log1p, round(case when c_acctbal > 0 then log10(c_acctbal) end, 6) t_log10,
  round(case when c_acctbal >= 0 then sqrt(c_acctbal) end, 6) t_sqrt, round(cbrt(c_acctbal), 6) t_cbrt,
  round(case when c_acctbal + 1 > 0 then ln(c_acctbal + 1) end, 6) t_log from customer""")
def _(spark, d):
    names = ["log1p", "log10", "sqrt", "cbrt", "log"]
    return read(spark, d, "customer").select("c_custkey", *[R(T.transform("c_acctbal", n), 6).alias(f"t_{n}") for n in names])


@query("f16_inverse_transform", """
select l_orderkey, l_linenumber, round(exp(l_discount) - 1, 6) i_log1p, round(pow(10, l_discount), 6) i_log10,
  round(l_discount * l_discount, 6) i_sqrt, round(l_discount * l_discount * l_discount, 6) i_cbrt, round(exp(l_discount) - 1, 6) i_log from lineitem""")
def _(spark, d):
    names = ["log1p", "log10", "sqrt", "cbrt", "log"]
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", *[R(T.inverse_transform("l_discount", n), 6).alias(f"i_{n}") for n in names])


def _price_stats(df):
    """One-row struct of the statistics of l_extendedprice, as a scalar subquery."""
    from ..operators.stats import channel_stats

    names = ["mean", "sd", "min", "max", "q25", "q50", "q75"]
    return channel_stats(df, ["l_extendedprice"], probs=[0.25, 0.5, 0.75]).select(F.struct(*names)).scalar()


_ST = """with s as (select avg(l_extendedprice) mean, stddev_pop(l_extendedprice) sd, min(l_extendedprice) mn, max(l_extendedprice) mx,
  quantile_cont(l_extendedprice, 0.25) q25, quantile_cont(l_extendedprice, 0.5) q50, quantile_cont(l_extendedprice, 0.75) q75 from lineitem) """


def _norm(name, preset, sql):
    @query(name, _ST + f"select l_orderkey, l_linenumber, l_extendedprice, round({sql}, 6) v from lineitem, s")
    def _(spark, d):
        li = read(spark, d, "lineitem")
        out = li.withColumn("s", _price_stats(li))
        stats = {k: F.col(f"s.{k}") for k in ("mean", "sd", "min", "max", "q25", "q50", "q75")}
        return out.select("l_orderkey", "l_linenumber", "l_extendedprice", R(preset.apply("l_extendedprice", stats), 6).alias("v"))


_norm("f17_zscore", T.Preset("zscore"), "(l_extendedprice - mean) / sd")
_norm("f18_robust_iqr", T.Preset("robust_iqr", -8, 8), "greatest(-8, least(8, (l_extendedprice - q50) / (q75 - q25)))")
_norm("f19_minmax", T.Preset("minmax", 0, 1), "greatest(0, least(1, (l_extendedprice - mn) / (mx - mn)))")
_norm("f20_linear_rescale", T.Preset("linear_rescale", in_min=900.0, in_max=100000.0, out_min=-1.0, out_max=1.0),
      "(l_extendedprice - 900) / 99100 * 2 - 1")
_norm("f21_clamp", T.Preset("zscore", -1.0, 1.0), "greatest(-1, least(1, (l_extendedprice - mean) / sd))")


@query("f22_inverse_norm", _ST + """
select l_orderkey, l_linenumber, round((l_discount * 10) * sd + mean, 4) z, round((l_discount * 10) * (q75 - q25) + q50, 4) r from lineitem, s""")
def _(spark, d):
    li = read(spark, d, "lineitem")
    out = li.withColumn("s", _price_stats(li)).withColumn("x", F.col("l_discount") * 10)
    return out.select("l_orderkey", "l_linenumber", R(T.inverse_zscore("x", "s.mean", "s.sd"), 4).alias("z"),
                      R(T.inverse_robust_iqr("x", "s.q25", "s.q50", "s.q75"), 4).alias("r"))


@query("f44_ramp_weight", """
select l_orderkey, l_linenumber, round(greatest(0, least(1, (l_quantity - 10) / 20)), 6) w,
  round(0.1 + (1.0 - 0.1) * 0.5 * (1 + cos(least(1, l_quantity / 40) * pi())), 6) lr from lineitem""")
def _(spark, d):
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", R(T.ramp_weight("l_quantity", 10, 20), 6).alias("w"),
        R(T.rate_schedule("l_quantity", "cosine", 1.0, 0.1, 40), 6).alias("lr"))


# --- vectors ---------------------------------------------------------------------------------

_EZ = ctes("emb") + ", v as (select id, split, list_transform(z[1:48], lambda x: x::double) t, list_transform(z[57:64], lambda x: x::double) p from emb)"


def _emb_blocks(spark, d):
    return fx(spark, d, "emb").select(
        "id", "split", F.slice(V.doubles("z"), 1, 48).alias("t"), F.slice(V.doubles("z"), 57, 8).alias("p"))


@query("f27_block_l2_normalise", _EZ + """,
m as (select avg(sqrt(list_sum(list_transform(t, lambda x: x * x)))) mt from v where split = 'train'),
s as (select id, list_transform(t, lambda x: x / mt) t from v, m),
n as (select id, t, greatest(sqrt(list_sum(list_transform(t, lambda x: x * x))), 1e-12) nn from s)
select id, i - 1 as pos, round(t[i] / nn, 6) val from n, (select unnest(range(1, 49)) i)""")
def _(spark, d):
    from ..operators.features import block_l2_normalise

    out = block_l2_normalise(_emb_blocks(spark, d), "t", F.col("split") == "train")
    return out.select("id", F.posexplode("t").alias("pos", "val")).withColumn("pos", F.col("pos").cast("long")).withColumn("val", R("val", 6))


@query("f28_weighted_concat", _EZ + """
select id, len(list_concat(t, p)) n, round(list_sum(list_concat(t, list_transform(p, lambda x: 2.5 * x))), 5) total,
 round(2.5 * p[8], 6) last from v""")
def _(spark, d):
    w = V.weighted_concat("t", "p", 2.5)
    return _emb_blocks(spark, d).select("id", F.size(w).cast("long").alias("n"), R(V.vsum(w), 5).alias("total"), R(F.element_at(w, -1), 6).alias("last"))


@query("f29_design_matrix", _EZ + """,
f as (select id, list_concat([1.0::double], t, p, flatten(list_transform(t, lambda x: list_transform(p, lambda y: x * y)))) x from v)
select id, len(x) n, round(list_sum(x), 4) total, round(x[58], 6) first_inter, round(x[441], 6) last_inter from f""")
def _(spark, d):
    x = V.design_matrix("t", "p", "full")
    return _emb_blocks(spark, d).select("id", x.alias("x")).select(
        "id", F.size("x").cast("long").alias("n"), R(V.vsum("x"), 4).alias("total"), R(F.element_at("x", 58), 6).alias("first_inter"),
        R(F.element_at("x", 441), 6).alias("last_inter"))


# --- segments --------------------------------------------------------------------------------

SNAP_T = 1999.5


def _segs(spark, d):
    return G.segments_from_rows(seg_parts(spark, d), columns=SEG_COLUMNS)


_SEG = ctes("seg_rows")
_AT = _SEG + f", p as (select distinct pixel from seg_rows), s as (select p.pixel as px, q.* from p left join seg_rows q on p.pixel = q.pixel and t_start <= {SNAP_T} and t_end >= {SNAP_T}) "


def _val(b):
    return f"({b}_c0 + {b}_c1 * {SNAP_T})"


@query("f30_segment_at", _AT + "select px as pixel, round(t_start, 5) t_start, round(t_end, 5) t_end, round(nir_c0, 6) nir_c0 from s")
def _(spark, d):
    return _segs(spark, d).withColumn("s", G.segment_at("segs", SNAP_T)).select(
        "pixel", R("s.t_start", 5).alias("t_start"), R("s.t_end", 5).alias("t_end"), R(F.col("s.nir.coefs")[0], 6).alias("nir_c0"))


@query("f31_array_reduce", _SEG + """
select pixel, round(max_by(nir_c0, seg_no), 6) v_last, round(min_by(nir_c0, seg_no), 6) v_first, round(avg(nir_c0), 6) v_mean, round(sum(nir_c0), 5) v_sum,
 round(max(nir_c0), 6) v_max, round(min(nir_c0), 6) v_min, round(var_pop(nir_c0), 6) v_variance, round(stddev_pop(nir_c0), 6) v_stddev
from seg_rows group by 1""")
def _(spark, d):
    vals = F.transform("segs", lambda s: s["nir"]["coefs"][0])
    hows = ["first", "last", "mean", "sum", "max", "min", "variance", "stddev"]
    return _segs(spark, d).select("pixel", *[R(G.array_reduce(vals, h), 5 if h == "sum" else 6).alias(f"v_{h}") for h in hows])


_TC = {n: " + ".join(f"({w}) * {_val(b)}" for w, b in zip(ws, BANDS)) for n, ws in I.TASSELED_CAP.items()}


@query("f32_snapshot_state", _AT + "select px as pixel, " + ", ".join(f"round({_val(b)}, 6) {b}" for b in BANDS)
       + f", round(({_val('nir')} - {_val('red')}) / ({_val('nir')} + {_val('red')} + 1e-6), 6) ndvi, "
       + f"round(({_val('nir')} - {_val('swir2')}) / ({_val('nir')} + {_val('swir2')} + 1e-6), 6) nbr, "
       + f"round(({_val('nir')} - {_val('swir1')}) / ({_val('nir')} + {_val('swir1')} + 1e-6), 6) ndmi, "
       + ", ".join(f"round({e}, 6) {n}" for n, e in _TC.items()) + " from s")
def _(spark, d):
    df = _segs(spark, d).withColumn("s", G.segment_at("segs", SNAP_T))
    return rounded(df.select("pixel", *[v.alias(k) for k, v in G.snapshot_state(F.col("s"), SNAP_T).items()]), 6)


@query("f33_snapshot_harmonic", _AT + "select px as pixel, " + ", ".join(
    f"round(sqrt({b}_cos * {b}_cos + {b}_sin * {b}_sin), 6) seasonal_amp_{b}" for b in G.HARMONIC_BANDS) + " from s")
def _(spark, d):
    df = _segs(spark, d).withColumn("s", G.segment_at("segs", SNAP_T))
    return rounded(df.select("pixel", *[v.alias(k) for k, v in G.snapshot_harmonic(F.col("s")).items()]), 6)


def _deriv(b):
    n, m = _val("nir"), _val(b)
    return f"2 * ({m} * nir_c1 - {n} * {b}_c1) / (pow({n} + {m} + 1e-6, 2) + 1e-6)"


_VEL = "sqrt(" + " + ".join(f"{b}_c1 * {b}_c1" for b in BANDS) + ")"


@query("f34_snapshot_trajectory", _AT + f"""select px as pixel, round({_VEL}, 8) spectral_velocity, round(t_end - t_start, 6) segment_duration,
 round(({' + '.join(b + '_rmse' for b in BANDS)}) / 5, 6) rmse_mean, round({_deriv('red')}, 6) dndvi_dt, round({_deriv('swir1')}, 6) dndmi_dt,
 round({_deriv('swir2')}, 6) dnbr_dt from s""")
def _(spark, d):
    df = _segs(spark, d).withColumn("s", G.segment_at("segs", SNAP_T))
    out = G.snapshot_trajectory(F.col("s"), SNAP_T)
    return df.select("pixel", *[R(v, 8 if k == "spectral_velocity" else 6).alias(k) for k, v in out.items()])


@query("f35_annual_snapshots", _SEG + f""", p as (select distinct pixel from seg_rows),
y as (select unnest([1996, 1998, 2000]) as yr),
t as (select p.pixel, yr as "year", yr + (dayofyear(make_date(yr, 2, day(last_day(make_date(yr, 2, 1))))) - 1) / dayofyear(make_date(yr, 12, 31)) tt from p, y),
s as (select t.pixel, t."year", tt, q.nir_c0, q.nir_c1, q.t_start, q.t_end, q.red_c0, q.red_c1 from t left join seg_rows q on t.pixel = q.pixel and q.t_start <= tt and q.t_end >= tt)
select pixel, "year", round(nir_c0 + nir_c1 * tt, 6) nir, round(((nir_c0 + nir_c1 * tt) - (red_c0 + red_c1 * tt)) / ((nir_c0 + nir_c1 * tt) + (red_c0 + red_c1 * tt) + 1e-6), 6) ndvi,
 round(t_end - t_start, 6) segment_duration from s""")
def _(spark, d):
    out = G.annual_snapshots(_segs(spark, d), [1996, 1998, 2000], 2, 31)
    return rounded(out.select("pixel", "year", "nir", "ndvi", "segment_duration"), 6)


_LT = _SEG + """, q as (select *, t_end - t_start as dur, """ + ", ".join(
    f"{b}_c0 + {b}_c1 * (t_start + t_end) / 2 as {b}_mid, sqrt({b}_cos * {b}_cos + {b}_sin * {b}_sin) as {b}_amp" for b in BANDS) + f""",
  {_VEL} as vel, ({' + '.join(b + '_rmse' for b in BANDS)}) / 5 as joint, ({' + '.join(f'abs({b}_mag)' for b in BANDS)}) / 5 as absmag,
  sqrt({' + '.join(f'{b}_mag * {b}_mag' for b in BANDS)}) as specmag from seg_rows),
l as (select *, dur < 1.5 and specmag > 0.10 and nir_mag < 0 as is_loss from q) """


def _nd(a, b):
    return f"({a}_mid - {b}_mid) / ({a}_mid + {b}_mid + 1e-6)"


def _longterm(name, fn, sql, digits=6):
    @query(name, _LT + f"select pixel, {sql} from l group by pixel")
    def _(spark, d):
        return rounded(G.with_derived(_segs(spark, d)).select("pixel", *[v.alias(k) for k, v in fn("segs", "_derived").items()]), digits)


_longterm("f36_longterm_state", G.longterm_state, ", ".join(
    [f"round(sum({b}_mid * dur) / (sum(dur) + 1e-6), 6) mean_{b}" for b in BANDS]
    + [f"round(sum({_nd(a, b)} * dur) / (sum(dur) + 1e-6), 6) mean_{n}" for n, a, b in
       (("ndvi", "nir", "red"), ("nbr", "nir", "swir2"), ("ndmi", "nir", "swir1"))]))
_longterm("f37_longterm_harmonic", G.longterm_harmonic, ", ".join(
    f"round(sum({b}_amp * dur) / (sum(dur) + 1e-6), 6) mean_seasonal_amp_{b}, "
    f"round(sum({b}_amp * dur) / (sum(dur) + 1e-6) / (avg({b}_rmse) + 1e-6), 6) mean_seasonal_snr_{b}, "
    f"round(var_pop({b}_amp), 6) variance_seasonal_amp_{b}" for b in G.HARMONIC_BANDS)
    + ", " + ", ".join(f"round(max({b}_amp), 6) max_seasonal_amp_{b}, round(max_by({b}_amp, seg_no) - min_by({b}_amp, seg_no), 6) net_change_seasonal_amp_{b}"
                       for b in ("nir", "swir1")))
_SPAN = "greatest((max(t_end) - min(t_start)) / 10, 1e-6)"


def _edge(b, f, t):
    return f"{f}({b}_c0 + {b}_c1 * {t}, seg_no)"


def _edge_ndvi(f, t):
    n, r = _edge("nir", f, t), _edge("red", f, t)
    return f"({n} - {r}) / ({n} + {r} + 1e-6)"


_longterm("f38_longterm_trajectory", G.longterm_trajectory, f"""round(sum(vel * dur), 6) total_spectral_distance,
 round(sum(vel * dur) / {_SPAN}, 6) spectral_distance_per_decade, round(avg(vel), 6) mean_spectral_velocity,
 round({_edge_ndvi('max_by', 't_end')} - {_edge_ndvi('min_by', 't_start')}, 6) net_change_ndvi,
 round({_edge('nir', 'max_by', 't_end')} - {_edge('nir', 'min_by', 't_start')}, 6) net_change_nir,
 round(avg(greatest(nir_c1 - red_c1, 0)), 6) mean_recovery_rate, round(avg(abs(least(nir_c1 - red_c1, 0))), 6) mean_decline_rate""")
_longterm("f39_disturbance_metrics", G.disturbance_metrics, f"""cast(count(*) as int) num_segments, cast(count_if(t_break > 0) as int) break_count,
 round(count_if(t_break > 0) / {_SPAN}, 6) break_rate_per_decade, round(max_by(dur, seg_no), 6) years_since_last_break,
 round(avg(dur), 6) mean_segment_duration, round(max(dur), 6) max_segment_duration, round(min(dur), 6) min_segment_duration,
 round(avg(absmag), 6) mean_break_magnitude, round(max(absmag), 6) max_break_magnitude""")
_longterm("f40_variability_metrics", G.variability_metrics, f"""round(var_pop({_nd('nir', 'red')}), 6) variance_ndvi,
 round(var_pop(nir_mid), 6) variance_nir, round(stddev_pop(dur) / (avg(dur) + 1e-6), 6) cv_segment_duration,
 round(avg(joint), 6) mean_rmse_joint, round(max(joint), 6) max_rmse_joint""")
_LOSSY = "list_sort(list(t_break) filter (where is_loss), 'desc')"
_longterm("f41_rapid_loss", G.rapid_loss, f"""round(count_if(is_loss) / {_SPAN}, 6) rapid_loss_rate_per_decade,
 round(coalesce(avg(specmag) filter (where is_loss), 0), 6) rapid_loss_mean_magnitude, """ + ", ".join(
    f"round({_LOSSY}[{i}], 5) rapid_loss_year_{i}" for i in range(1, 5)),
    {"rapid_loss_rate_per_decade": 6, "rapid_loss_mean_magnitude": 6, **{f"rapid_loss_year_{i}": 5 for i in range(1, 5)}})


@query("f42_loss_recovery", _LT + """,
g as (select pixel, t_break - lag(t_break) over (partition by pixel order by seg_no) gap from l where is_loss),
h as (select pixel, count(*) n, avg(gap) m, stddev_pop(gap) s from g group by 1)
select p.pixel, round(case when n >= 2 then m end, 6) mean_loss_recovery_duration, round(case when n >= 4 then s end, 6) std_loss_recovery_duration
from (select distinct pixel from seg_rows) p left join h using (pixel)""")
def _(spark, d):
    return rounded(G.with_derived(_segs(spark, d)).select("pixel", *[v.alias(k) for k, v in G.loss_recovery("segs", "_derived").items()]), 6)


@query("n14_nth_recent", _LT + f"select pixel, round({_LOSSY}[2], 5) second_recent from l group by 1")
def _(spark, d):
    years = F.transform(G.rapid_losses("segs"), lambda s: s["t_break"])
    return _segs(spark, d).select("pixel", R(G.nth_recent(years, 2), 5).alias("second_recent"))


@query("f43_all_segment_metrics", _LT + f"""
select pixel, cast(count(*) as int) num_segments, round(sum(nir_mid * dur) / (sum(dur) + 1e-6), 6) mean_nir, round(avg(vel), 6) mean_spectral_velocity,
 round(var_pop(nir_mid), 6) variance_nir, round(coalesce(max(case when t_start <= {SNAP_T} and t_end >= {SNAP_T} then {_val('nir')} end), -9999), 6) snap_mid_nir
from l group by 1""")
def _(spark, d):
    out = G.all_segment_metrics(_segs(spark, d), {"mid": SNAP_T})
    out = G.with_sentinel(out, ["snap_mid_nir"])
    return rounded(out.select("pixel", "num_segments", "mean_nir", "mean_spectral_velocity", "variance_nir", "snap_mid_nir"), 6)
