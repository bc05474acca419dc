"""Statistics, evaluation and agreement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import features as X
from ..operators import stats as T
from ..operators.quantiles import exact_quantiles
from ..session import cut_lineage
from .fixtures import ctes, fx, read
from .registry import R, query, rounded, rounds

CH = ["quantity", "price", "discount", "tax"]
PATCH = ["patch_row", "patch_col"]
_LONG = ctes("px") + ", lng as (" + " union all ".join(f"select patch_row, patch_col, '{c}' as channel, {c} as value from px where valid" for c in CH) + ") "
_QC = "round(quantile_cont(value, {p}), 5) {n}"
_Q7 = ", ".join(_QC.format(p=p, n=n) for p, n in ((.02, "q02"), (.05, "q05"), (.25, "q25"), (.5, "q50"), (.75, "q75"), (.95, "q95"), (.98, "q98")))


@query("a10_channel_stats", _LONG + f"""
select channel, count(*) n, round(avg(value), 5) mean, round(stddev_pop(value), 5) sd, round(min(value), 5) "min", round(max(value), 5) "max", {_Q7}
from lng group by 1""")
def _(spark, d):
    return rounded(T.channel_stats(fx(spark, d, "px"), CH, F.col("valid")), 5)


@query("a10_tidy_stats", _LONG + """, s as (select channel, count(*)::double n, avg(value) mean, max(value) mx from lng group by 1)
select 'px' as feature, channel, 'n' as stat, round(n, 5) as value from s union all select 'px', channel, 'mean', round(mean, 5) from s
union all select 'px', channel, 'max', round(mx, 5) from s""")
def _(spark, d):
    wide = T.channel_stats(fx(spark, d, "px"), CH, F.col("valid"), probs=[]).select("channel", "n", "mean", "max")
    return rounded(T.tidy_stats(wide, "px"), 5)


@query("a11_class_stats", ctes("px") + "select code, count(*) n, round(100 * count(*) / (select count(*) from px), 4) percent from px group by 1")
def _(spark, d):
    return T.class_stats(fx(spark, d, "px"), "code")


@query("a12_variable_stats", ctes("static_px") + """, a as (select cast(evt as double) as value, aoi from static_px)
select 'categorical' as kind, evt as code, count(*) n, cast((select count(distinct evt) from static_px where evt <> -1) as bigint) extra from static_px where evt <> -1 group by 2
union all select 'mask', null, count_if(aoi = 1), count_if(aoi = 0) from static_px
union all select 'continuous', null, count(elevation), cast(round(quantile_cont(elevation, 0.5) * 1000, 0) as bigint) from static_px""")
def _(spark, d):
    px = fx(spark, d, "static_px")
    cat = T.variable_stats(px, "evt", "categorical").select(F.lit("categorical").alias("kind"), F.col("evt").alias("code"), "n", F.col("num_classes").alias("extra"))
    mask = T.variable_stats(px, "aoi", "mask").select(F.lit("mask"), F.lit(None).cast("int"), "n_true", "n_false")
    cont = T.variable_stats(px, "elevation", "continuous").select(
        F.lit("continuous"), F.lit(None).cast("int"), "n", R(F.col("q50") * 1000, 0).cast("long"))
    return cat.union(mask).union(cont)


@query("a13_legacy_stats", _LONG.replace(" where valid", "") + """
select channel, count(*) n, round(avg(value), 5) mean, round(stddev_pop(value), 5) sd, round(min(value), 5) "min", round(max(value), 5) "max",
 round(quantile_cont(value, 0.01), 5) q01, round(quantile_cont(value, 0.25), 5) q25, round(quantile_cont(value, 0.5), 5) q50,
 round(quantile_cont(value, 0.75), 5) q75, round(quantile_cont(value, 0.99), 5) q99 from lng group by 1""")
def _(spark, d):
    return rounded(T.legacy_stats(fx(spark, d, "px"), CH), 5)


@query("a13_legacy_class_table", ctes("px") + "select cast(i as int) code, count(p.code) n from range(255) t(i) left join px p on p.code = t.i group by 1")
def _(spark, d):
    return T.legacy_class_table(fx(spark, d, "px"), "code")


@query("a13_band_patch_quantiles", _LONG.replace(" where valid", "") + """
select patch_row, patch_col, channel, round(quantile_cont(value, 0.25), 5) q25, round(quantile_cont(value, 0.75), 5) q75 from lng group by 1, 2, 3""")
def _(spark, d):
    return rounded(T.band_patch_quantiles(fx(spark, d, "px"), PATCH, CH, [0.25, 0.75]), 5)


def _cov_sql(agg, inner_keys, outer):
    pairs = " union all ".join(f"select {inner_keys}'{a}' ci, '{b}' cj, {agg.format(a=a, b=b)} as value from px group by {outer}" if outer
                               else f"select '{a}' ci, '{b}' cj, {agg.format(a=a, b=b)} as value from px" for a in CH for b in CH)
    return pairs


_PER = ", per as (" + _cov_sql("covar_samp({a}, {b})", "patch_row, patch_col, count(*) n, ", "patch_row, patch_col") + ") "


@query("a14_patch_mean_covariance", ctes("px") + _PER + "select ci, cj, round(avg(value), 4) as value from per where n >= 2 group by 1, 2")
def _(spark, d):
    return rounded(T.patch_mean_covariance(fx(spark, d, "px"), PATCH, CH), 4)


@query("a15_global_covariance", ctes("px") + ", g as (" + _cov_sql("covar_samp({a}, {b})", "", "") + "), c as (" + _cov_sql("corr({a}, {b})", "", "") + """)
select g.ci, g.cj, round(g.value, 3) as value, round(c.value, 6) as corr from g join c using (ci, cj)""")
def _(spark, d):
    px = fx(spark, d, "px")
    cov = cut_lineage(T.global_covariance(px, CH).drop("n"))  # a row per channel pair
    return rounded(T.correlation_of(cov), {"value": 3, "corr": 6})


@query("a16_weighted_patch_covariance", ctes("px") + _PER + "select ci, cj, round(sum(n * value) / sum(n), 4) as value from per where n >= 2 group by 1, 2")
def _(spark, d):
    return rounded(T.weighted_patch_covariance(fx(spark, d, "px"), PATCH, CH), 4)


@query("a17_online_stats", _LONG.replace(" where valid", "") + """, m as (select channel, avg(value) mu from lng group by 1)
select channel, count(*) n, round(avg(value), 5) mean, round(var_samp(value), 4) var, round(stddev_samp(value), 5) sd, round(min(value), 5) "min", round(max(value), 5) "max",
 round(avg(abs(value - mu)), 5) mad, round(quantile_cont(value, 0.25), 5) q25, round(quantile_cont(value, 0.5), 5) q50, round(quantile_cont(value, 0.75), 5) q75
from lng join m using (channel) group by 1""")
def _(spark, d):
    out = T.online_stats(fx(spark, d, "px"), CH)
    return rounded(out, {c: 4 if c == "var" else 5 for c in out.columns if c not in ("channel", "n")})


@query("a19_distribution_summary", """
select round(avg(l_extendedprice), 4) mean, round(stddev_samp(l_extendedprice), 4) std, round(min(l_extendedprice), 4) "min", round(max(l_extendedprice), 4) "max",
 round(quantile_cont(l_extendedprice, 0.25), 4) q25, round(quantile_cont(l_extendedprice, 0.5), 4) q50, round(quantile_cont(l_extendedprice, 0.75), 4) q75 from lineitem""")
def _(spark, d):
    return rounded(T.distribution_summary(read(spark, d, "lineitem"), "l_extendedprice"), 4)


@query("a20_class_weights", ctes("px") + """, c as (select code, count(*) n from px group by 1),
w as (select code, n, case when code in (0, 1) then 0.0 else 1 / sqrt(n + 1e-6) end w from c)
select code, n, round(w / ((select avg(w) from w where w > 0) + 1e-6), 6) weight from w""")
def _(spark, d):
    return rounded(T.class_weights(fx(spark, d, "px"), "code"), 6)


@query("a21_median_frequency_weights", """
with c as (select l_suppkey, count(*) n from lineitem group by 1), f as (select l_suppkey, n, n / (select sum(n) from c) freq from c)
select l_suppkey, n, round(least(1.05, (select median(freq) from f where freq > 0) / freq), 6) weight from f""")
def _(spark, d):
    c = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return rounded(T.median_frequency_weights(c, "l_suppkey", "n", 1.05).drop("freq"), 6)


@query("s20_export_class_counts", ctes("static_px") + """, u as (select 'evt' feature, cast(evt as bigint) code from static_px union all select 'ysfc', ysfc from static_px)
select feature, code, count(*) n, round(count(*) / sum(count(*)) over (partition by feature), 6) proportion from u group by 1, 2""")
def _(spark, d):
    return rounded(T.class_counts_export(fx(spark, d, "static_px"), ["evt", "ysfc"]), 6)


# --- errors ----------------------------------------------------------------------------------
# prediction = l_quantity * 1500, observation = l_extendedprice, zeros where the flag is N

_PO = """with po as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 1500 as pred, case when l_returnflag = 'N' then 0 else l_extendedprice end as obs from lineitem) """


def _po(spark, d):
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * 1500).alias("pred"),
        F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.col("l_extendedprice")).alias("obs"))


_ERR = """count(*) n, round(avg((pred - obs) * (pred - obs)) / 1e6, 4) mse, round(avg(abs(pred - obs)), 4) mae, round(avg(pred - obs), 4) bias,
 round((avg((pred - obs) * (pred - obs)) - avg(pred - obs) * avg(pred - obs)) / 1e6, 4) variance, round(sqrt(avg((pred - obs) * (pred - obs))), 4) rmse,
 round(1 - sum((pred - obs) * (pred - obs)) / (var_pop(obs) * count(*)), 6) r2"""


@query("a32_error_metrics", _PO + f"select {_ERR} from po")
def _(spark, d):
    out = E.error_metrics(_po(spark, d), "pred", "obs").withColumns({"mse": F.col("mse") / 1e6, "variance": F.col("variance") / 1e6})
    return rounded(out, {"mse": 4, "mae": 4, "bias": 4, "variance": 4, "rmse": 4, "r2": 6})


@query("a33_stratum_errors", _PO + """,
e as (select distinct unnest(quantile_cont(obs, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) q from po),
ed as (select q, row_number() over (order by q) i, count(*) over () n from e where q > 0),
s as (select pred, obs, case when obs = 0 then 0 else 1 + (select count(*) from ed where i < n and q <= obs) end stratum from po)
select cast(stratum as int) stratum, count(*) n, round(avg(obs), 4) mean_y, round(sqrt(avg((pred - obs) * (pred - obs))), 4) rmse, round(avg(pred - obs), 4) bias
from s group by 1""")
def _(spark, d):
    return rounded(E.stratum_errors(_po(spark, d), "pred", "obs"), 4)


@query("a34_mse_r2_by_channel", _PO + """, l as (select 'price' channel, pred p, obs o from po union all select 'supp', cast(l_partkey as double), cast(l_suppkey as double) from po)
select channel, count(*) n, round(sum((p - o) * (p - o)) / count(*) / 1e6, 5) mse, round(1 - sum((p - o) * (p - o)) / (var_pop(o) * count(*)), 5) r2 from l group by 1""")
def _(spark, d):
    out = E.mse_r2_by_channel(_po(spark, d), {"price": ("pred", "obs"), "supp": ("l_partkey", "l_suppkey")}).withColumn("mse", F.col("mse") / 1e6)
    return rounded(out, 5)


@query("a56_split_population_errors", _PO + """, u as (select 'all' population, * from po union all select case when obs > 0 then 'positive' else 'zero' end, * from po)
select population, count(*) n, round(sqrt(avg((pred - obs) * (pred - obs))), 4) rmse, round(case when var_pop(obs) > 0 then 1 - sum((pred - obs) * (pred - obs)) / (var_pop(obs) * count(*)) end, 6) r2 from u group by 1""")
def _(spark, d):
    return rounded(E.split_population_errors(_po(spark, d), "pred", "obs"), {"rmse": 4, "r2": 6})


# --- temporal spread -------------------------------------------------------------------------


@query("a35_within_between_variance", ctes("annual") + """, p as (select pixel % 7 as cls, pixel, var_pop(nir) v, avg(nir) m, var_pop(red) v2, avg(red) m2 from annual where nir is not null group by 1, 2),
l as (select cls, 'nir' channel, v, m from p union all select cls, 'red', v2, m2 from p),
w as (select cls, channel, count(*) n_pixels, avg(v) w, var_pop(m) b from l group by 1, 2)
select cls, channel, n_pixels, round(w, 6) "within", round(b, 6) as between_, round(w / greatest(w + b, 1e-12), 6) temporal_fraction from w""")
def _(spark, d):
    a = fx(spark, d, "annual").filter("nir is not null").withColumn("cls", F.col("pixel") % 7)
    return rounded(E.within_between_variance(a, ["cls"], ["pixel"], ["nir", "red"]).withColumnRenamed("between", "between_"), 6)


@query("a36_class_accumulators", ctes("annual") + """
select pixel % 7 as cls, count(*) n, round(avg(swir1), 6) swir1_mean, round(avg(swir2), 6) swir2_mean, round(stddev_pop(swir1), 6) swir1_sd, round(stddev_pop(swir2), 6) swir2_sd,
 round(1 - sum((red - nir) * (red - nir)) / greatest(var_pop(nir) * count(nir), 1e-12), 6) probe_r2 from annual where nir is not null group by 1""")
def _(spark, d):
    a = fx(spark, d, "annual").filter("nir is not null").withColumn("cls", F.col("pixel") % 7)
    return rounded(E.class_accumulators(a, "cls", ["swir1", "swir2"], "red", "nir"), 6)


_PIXV = ctes("annual") + ", pv as (select pixel % 5 as cluster, pixel, var_samp(red) tv, avg(red) m from annual group by 1, 2 having count(red) > 1) "


@query("a37_variability_stats", _PIXV + """
select cluster, count(*) n, round(avg(tv), 6) mean_tv, round(var_samp(m), 6) spatial, round(quantile_cont(tv, 0.25), 6) q25, round(quantile_cont(tv, 0.5), 6) q50,
 round(quantile_cont(tv, 0.75), 6) q75, round(quantile_cont(tv, 0.9), 6) q90, round(avg(tv) / (avg(tv) + var_samp(m)), 6) fraction from pv group by 1""")
def _(spark, d):
    pv = fx(spark, d, "annual").groupBy((F.col("pixel") % 5).alias("cluster"), "pixel").agg(
        F.var_samp("red").alias("tv"), F.avg("red").alias("m"), F.count("red").alias("c")).filter("c > 1")
    return rounded(E.variability_stats(pv, "cluster", "tv", "m"), 6)


EDGES = [0, 2, 5, 10, 16, 31]
_BIN = "case when ysfc < 2 then 0 when ysfc < 5 then 1 when ysfc < 10 then 2 when ysfc < 16 then 3 when ysfc < 31 then 4 end"


@query("a38_recovery_curve", ctes("static_px") + f"""
select evt, cast({_BIN} as int) bin, count(*) n, round(quantile_cont(elevation, 0.25), 5) q25, round(quantile_cont(elevation, 0.5), 5) q50,
 round(quantile_cont(elevation, 0.75), 5) q75, round(quantile_cont(yr, 0.5), 5) obs_q50 from static_px group by 1, 2""")
def _(spark, d):
    return rounded(E.recovery_curve(fx(spark, d, "static_px"), "evt", "ysfc", EDGES, "elevation", "yr"), 5)


@query("a39_ysfc_histogram", ctes("static_px") + f""", t as (select evt, count(*) class_n, avg(ysfc) mean_ysfc, quantile_cont(ysfc, 0.5) median_ysfc from static_px group by 1),
h as (select evt, cast({_BIN} as int) bin, count(*) n from static_px group by 1, 2)
select evt, bin, n, class_n, round(mean_ysfc, 6) mean_ysfc, round(median_ysfc, 6) median_ysfc, round(n / class_n / [2, 3, 5, 6, 15][bin + 1], 6) density, round(n / class_n, 6) fraction
from h join t using (evt)""")
def _(spark, d):
    return rounded(E.ysfc_histogram(fx(spark, d, "static_px"), "evt", "ysfc", EDGES), 6)


@query("a55_response_by_class", ctes("static_px") + """, r as (select evt, case when forest = 0 then 0 else elevation end y from static_px),
b as (select evt, y, least(3, floor((greatest(0, least(400, y)) - 0) / 100)) b from r)
select evt, count(*) n, round(100 * avg(case when y = 0 then 1.0 else 0.0 end), 5) pct_zero, round(avg(y), 5) mean_y, count_if(b = 0) bin_0, count_if(b = 1) bin_1,
 count_if(b = 2) bin_2, count_if(b = 3) bin_3, round(quantile_cont(y, 0.5), 5) median_y from b group by 1""")
def _(spark, d):
    px = fx(spark, d, "static_px").withColumn("y", F.when(F.col("forest") == 0, 0.0).otherwise(F.col("elevation").cast("double")))
    return rounded(E.response_by_class(px, "evt", "y", 0, 400, 4), 5)


@query("a54_spread_diagnostics", ctes("annual") + """, a as (select cast(floor(pixel / 256) as bigint) patch, * from annual where nir is not null),
t as (select patch, 'nir' channel, avg(v) temporal_sd from (select patch, pixel, stddev_pop(nir) v from a group by 1, 2) group by 1),
t2 as (select patch, 'red' channel, avg(v) temporal_sd from (select patch, pixel, stddev_pop(red) v from a group by 1, 2) group by 1),
s as (select patch, 'nir' channel, avg(v) spatial_sd from (select patch, yr, stddev_pop(nir) v from a group by 1, 2) group by 1),
s2 as (select patch, 'red' channel, avg(v) spatial_sd from (select patch, yr, stddev_pop(red) v from a group by 1, 2) group by 1)
select patch, channel, round(temporal_sd, 6) temporal_sd, round(spatial_sd, 6) spatial_sd from (from t union all from t2) join (from s union all from s2) using (patch, channel)""")
def _(spark, d):
    a = fx(spark, d, "annual").filter("nir is not null").withColumn("patch", F.floor(F.col("pixel") / 256))
    return rounded(E.spread_diagnostics(a, ["patch"], ["pixel"], "yr", ["nir", "red"]), 6)


# --- clusters against classes ----------------------------------------------------------------
# cluster = argmax of the first ten elements, class = label

_CL = ctes("emb") + ", cl as (select id, evt, list_position(z[1:10], list_max(z[1:10])) - 1 as cluster from emb) "


def clusters(spark, d):
    first = F.slice("z", 1, 10)
    return fx(spark, d, "emb").select("id", "evt", (F.array_position(first, F.array_max(first)).cast("int") - 1).alias("cluster"))


@query("a40_contingency", _CL + """, top as (select evt from cl group by 1 order by count(*) desc, evt limit 5)
select cluster, evt, cast(count_if(c) as bigint) n from (select c1.cluster, t.evt, c1.evt = t.evt c from cl c1, top t) group by 1, 2""")
def _(spark, d):
    cl = clusters(spark, d)
    top = [r["evt"] for r in E.top_classes(cl, "evt", 5).collect()]  # five codes
    wide = E.contingency(cl, "cluster", "evt", top)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("evt"), F.col(f"class_{c}").alias("n")) for c in top]))
    return wide.select("cluster", pairs.alias("p")).select("cluster", "p.evt", "p.n")


_JC = _CL + """, j as (select cluster, evt, count(*)::double n from cl group by 1, 2), k as (select cluster, sum(n) nk, max(n) mk from j group by 1),
c as (select evt, sum(n) nc, max(n) mc from j group by 1), t as (select sum(n) tot from j) """


@query("a41_cluster_agreement", _JC + """,
mi as (select sum(n / tot * ln(n * tot / (nk * nc))) mi from j join k using (cluster) join c using (evt), t),
hk as (select -sum(nk / tot * ln(nk / tot)) hk, sum(mk) / max(tot) purity from k, t), hc as (select -sum(nc / tot * ln(nc / tot)) hc from c, t)
select round(2 * mi / (hk + hc), 6) nmi, round(mi / hc, 6) homogeneity, round(mi / hk, 6) completeness, round(2 * (mi / hc) * (mi / hk) / (mi / hc + mi / hk), 6) v_measure,
 round(purity, 6) purity from mi, hk, hc""")
def _(spark, d):
    return rounded(E.cluster_agreement(clusters(spark, d), "cluster", "evt"), 6)


@query("a42_class_cohesion", _JC + "select round(sum(mc) / sum(nc), 6) cohesion, count_if(mc = nc) n_whole, count(*) n_classes from c")
def _(spark, d):
    return rounded(E.class_cohesion(clusters(spark, d), "cluster", "evt"), 6)


@query("a43_cluster_composition", _JC + """, r as (select *, row_number() over (partition by cluster order by n desc, evt) rn from j)
select cluster, cast(sum(n) as bigint) n, count(*) n_classes, string_agg(evt::varchar, ',' order by rn) filter (where rn <= 3) top_classes from r group by 1""")
def _(spark, d):
    return E.cluster_composition(clusters(spark, d), "cluster", "evt")


@query("a43_modal_cluster", _JC + """, r as (select *, row_number() over (partition by evt order by n desc, cluster) rn from j)
select evt as cls, cluster, round(n / nc, 6) cohesion from r join c using (evt) where rn = 1""")
def _(spark, d):
    return rounded(E.modal_cluster(clusters(spark, d), "cluster", "evt"), 6)


@query("a45_macro_leakage", _CL + "select evt, count(*) n, round(avg(case when (cluster < 5) <> (evt < 5) then 1.0 else 0.0 end), 6) leakage from cl group by 1")
def _(spark, d):
    cl = clusters(spark, d).withColumns({"am": F.col("cluster") < 5, "om": F.col("evt") < 5})
    return rounded(E.macro_leakage(cl, "am", "om", "evt"), 6)


@query("a51_baselines", _CL + """, p as (select count(*) / (select count(*) from cl) p from cl group by evt)
select round(max(p), 6) majority_rate, round(sum(p * p), 6) random_purity, round(max(p), 6) no_information_rate from p""")
def _(spark, d):
    return rounded(E.baselines(clusters(spark, d), "evt"), 6)


@query("n12_top_classes", "select l_suppkey, count(*) n from lineitem group by 1 order by n desc, l_suppkey limit 20")
def _(spark, d):
    return E.top_classes(read(spark, d, "lineitem"), "l_suppkey", 20)


# --- detection and ranks ---------------------------------------------------------------------

_DET = ctes("frame") + ", det as (select cn, tcc, balive, case when balive < 10 then 1 else 0 end nonforest from frame) "


def detection(spark, d):
    return fx(spark, d, "frame").select("cn", "tcc", "balive", (F.col("balive") < 10).cast("int").alias("nonforest")).withColumn("score", 100 - F.col("tcc"))


@query("a48_detector_metrics", _DET + """,
cut as (select min(s) c from (select 100 - tcc s from det order by s desc, cn limit (select count(*) from det where tcc <= 10))),
f as (select 100 - tcc >= (select c from cut) p, nonforest = 1 y from det)
select round(count_if(p = y) / count(*), 6) accuracy, round(count_if(p and y) / count_if(y), 6) sensitivity, round(count_if(not p and not y) / count_if(not y), 6) specificity,
 round(count_if(p and y) / count_if(p), 6) "precision" from f""")
def _(spark, d):
    det = detection(spark, d)
    budget = det.filter("tcc <= 10").count()
    return rounded(E.detector_metrics(E.flag_top(det, "score", "cn", budget), "flag", "nonforest"), 6)


@query("a49_auc", _DET + """, r as (select nonforest, rank() over (order by 100 - tcc) + (count(*) over (partition by 100 - tcc) - 1) / 2 as rk from det)
select round((sum(case when nonforest = 1 then rk end) - count_if(nonforest = 1) * (count_if(nonforest = 1) + 1) / 2) / (count_if(nonforest = 1) * count_if(nonforest = 0)), 6) auc from r""")
def _(spark, d):
    return rounded(E.auc(detection(spark, d), "score", "nonforest"), 6)


@query("a50_spearman_rho2", ctes("frame") + """, r as (select row_number() over (order by tcc, cn) rx, row_number() over (order by balive, cn) ry from frame)
select round(corr(rx, ry) * corr(rx, ry), 8) rho2 from r""")
def _(spark, d):
    return rounded(E.spearman_rho2(fx(spark, d, "frame"), "tcc", "balive", "cn"), 8)


# --- features --------------------------------------------------------------------------------


@query("s18_stats_lookup", _LONG.replace(" where valid", "") + """
select channel, round(stddev_pop(value), 5) sd, round(quantile_cont(value, 0.5), 5) q50 from lng group by 1""")
def _(spark, d):
    from ..sources.stats_store import stats_lookup

    tidy = T.tidy_stats(T.channel_stats(fx(spark, d, "px"), CH, probs=[0.5]), "px")
    return rounded(stats_lookup(tidy, "px", ["std", "median"]).select("channel", "sd", "q50"), 5)


@query("f25_build_feature", ctes("px") + """,
t as (select cell, line_no, valid, ln(1 + price) lp, sqrt(quantity) sq, tax from px),
s as (select avg(lp) m1, stddev_pop(lp) s1, min(sq) lo, max(sq) hi from t)
select cell, line_no, valid and tax > 0 as ok, round(case when valid and tax > 0 then greatest(-6, least(6, (lp - m1) / s1)) else 0 end, 6) f0,
 round(case when valid and tax > 0 then (sq - lo) / (hi - lo) else 0 end, 6) f1 from t, s""")
def _(spark, d):
    from ..functions.transforms import Preset

    px = fx(spark, d, "px")
    tr = px.select(F.log1p("price").alias("price"), F.sqrt("quantity").alias("quantity"))
    st = {r["channel"]: r.asDict() for r in T.channel_stats(tr, ["price", "quantity"], probs=[]).collect()}  # two rows
    feat = X.Feature("f", (X.Channel("price", Preset("zscore", -6.0, 6.0), "log1p"), X.Channel("quantity", Preset("minmax"), "sqrt")), ("valid", "tax"))
    out = X.build_feature(px, feat, st)
    return out.select("cell", "line_no", F.col("f_valid").alias("ok"), R(F.col("f")[0], 6).alias("f0"), R(F.col("f")[1], 6).alias("f1"))


def _whitening(spark, d):
    px = fx(spark, d, "px")
    means = [r["mean"] for r in sorted(T.channel_stats(px, CH, probs=[]).collect(), key=lambda r: CH.index(r["channel"]))]
    cov = T.matrix(T.patch_mean_covariance(px, PATCH, CH), CH)
    return px, means, X.whitening_factor(cov)


@query("f23_whiten", ctes("px") + """, per as (select patch_row, patch_col, count(*) n, var_samp(quantity) a, covar_samp(quantity, price) b, var_samp(price) c from px group by 1, 2),
s as (select avg(a) + 1e-6 a, avg(b) b, avg(c) + 1e-6 c from per where n >= 2), m as (select avg(quantity) mq, avg(price) mp from px), t as (select a, b, c, a * c - b * b det from s),
l as (select sqrt(c / det) l11, -b / det / sqrt(c / det) l21, sqrt(a / det - pow(-b / det / sqrt(c / det), 2)) l22 from t)
select cell, line_no, round(greatest(-5, least(5, l11 * (quantity - mq) + l21 * (price - mp))), 5) w0, round(greatest(-5, least(5, l22 * (price - mp))), 5) w1 from px, l, m""")
def _(spark, d):
    px, ch = fx(spark, d, "px"), ["quantity", "price"]
    means = {r["channel"]: r["mean"] for r in T.channel_stats(px, ch, probs=[]).collect()}
    w = X.whitening_factor(T.matrix(T.patch_mean_covariance(px, PATCH, ch), ch))
    out = px.select("cell", "line_no", X.whiten([F.col(c) for c in ch], [means[c] for c in ch], w).alias("w"))
    return rounded(out.select("cell", "line_no", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1")), 5)


# the factor's inverse is the upper triangle M with M M' = covariance, found from the last channel up
_WHITE4 = ctes("px") + ", per as (select patch_row, patch_col, count(*) n, " + ", ".join(
    f"covar_samp({CH[i]}, {CH[j]}) s{i}{j}" for i in range(4) for j in range(i, 4)) + " from px group by 1, 2), s as (select " + ", ".join(
    f"avg(s{i}{j}){' + 1e-6' if i == j else ''} s{i}{j}" for i in range(4) for j in range(i, 4)) + " from per where n >= 2), m as (select " + ", ".join(
    f"avg({c}) a{i}" for i, c in enumerate(CH)) + """ from px),
c3 as (select *, sqrt(s33) m33 from s), d3 as (select *, s23 / m33 m23, s13 / m33 m13, s03 / m33 m03 from c3),
c2 as (select *, sqrt(s22 - m23 * m23) m22 from d3), d2 as (select *, (s12 - m13 * m23) / m22 m12, (s02 - m03 * m23) / m22 m02 from c2),
c1 as (select *, sqrt(s11 - m12 * m12 - m13 * m13) m11 from d2), d1 as (select *, (s01 - m02 * m12 - m03 * m13) / m11 m01 from c1),
f as (select *, sqrt(s00 - m01 * m01 - m02 * m02 - m03 * m03) m00 from d1),
y3 as (select cell, line_no, f.*, """ + ", ".join(f"{c} - a{i} x{i}" for i, c in enumerate(CH)) + """, x3 / m33 y3 from px, f, m),
y2 as (select *, (x2 - m23 * y3) / m22 y2 from y3), y1 as (select *, (x1 - m12 * y2 - m13 * y3) / m11 y1 from y2), y0 as (select *, (x0 - m01 * y1 - m02 * y2 - m03 * y3) / m00 y0 from y1)
select cell, line_no, """ + ", ".join(f"round(greatest(-5, least(5, y{i})), 5) w{i}" for i in range(4)) + " from y0"


@query("f23_whiten_all_channels", _WHITE4)
def _(spark, d):
    px, means, w = _whitening(spark, d)
    return rounded(px.select("cell", "line_no", X.whiten([F.col(c) for c in CH], means, w).alias("w")).select("cell", "line_no", *[F.col("w")[i].alias(f"w{i}") for i in range(4)]), 5)


@query("f24_unwhiten_to_original", ctes("px") + "select cell, line_no, " + rounds(["quantity", "price", "discount", "tax"], 4) + " from px")
def _(spark, d):
    px, means, w = _whitening(spark, d)
    vec = X.whiten([F.col(c) for c in CH], means, w, limit=None)
    back = X.unwhiten(F.col("_w"), means, w)
    return rounded(px.select("cell", "line_no", vec.alias("_w")).select("cell", "line_no", *[b.alias(c) for b, c in zip(back, CH)]), 4)


@query("f26_train_standardise", ctes("emb") + """, v as (select id, split, i - 1 as pos, z[i]::double x from emb, (select unnest(range(1, 9)) i)),
s as (select pos, avg(x) m, stddev_samp(x) sd from v where split = 'train' group by 1)
select id, pos, round((x - m) / sd, 5) val from v join s using (pos)""")
def _(spark, d):
    e = fx(spark, d, "emb").select("id", "split", F.slice("z", 1, 8).cast("array<double>").alias("z"))
    out = X.train_standardise(e, "z", 8, F.col("split") == "train")
    return out.select("id", F.posexplode("z").alias("pos", "val")).select("id", F.col("pos").cast("long").alias("pos"), R("val", 5).alias("val"))


@query("f46_variance_inflation", _PO + """, r as (select l_suppkey, 1 - sum((pred - obs) * (pred - obs)) / (var_pop(obs) * count(*)) r2 from po group by 1)
select l_suppkey, round(1 / greatest(sqrt(greatest(r2, 0)), 1e-3), 4) factor from r""")
def _(spark, d):
    out = E.error_metrics(_po(spark, d), "pred", "obs", ["l_suppkey"])
    return out.select("l_suppkey", R(X.variance_inflation("r2"), 4).alias("factor"))


@query("a13_quantiles_exact_by_class", """
select l_suppkey, round(quantile_cont(l_extendedprice, 0.05), 4) q05, round(quantile_cont(l_extendedprice, 0.5), 4) q50, round(quantile_cont(l_extendedprice, 0.95), 4) q95
from lineitem group by 1""")
def _(spark, d):
    return rounded(exact_quantiles(read(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", [0.05, 0.5, 0.95]), 4)

