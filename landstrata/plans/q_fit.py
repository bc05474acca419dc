"""Fit, clustering and stratification-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import fit as L
from ..operators import sample as N
from ..operators.features import train_standardise
from .fixtures import ctes, fx, read
from .q_pairs import emb
from .registry import R, query, rounded

# --- linear fits: price on quantity and discount ---------------------------------------------

def _x():
    return F.array("l_quantity", "l_discount")
_MOM = """with m as (select count(*) n, avg(l_quantity) mq, avg(l_discount) md, avg(l_extendedprice) my, var_pop(l_quantity) * count(*) sqq, var_pop(l_discount) * count(*) sdd,
 covar_pop(l_quantity, l_discount) * count(*) sqd, covar_pop(l_quantity, l_extendedprice) * count(*) sqy, covar_pop(l_discount, l_extendedprice) * count(*) sdy,
 var_pop(l_extendedprice) * count(*) syy from lineitem), w as (select *, ((sdd + {l}) * sqy - sqd * sdy) / ((sqq + {l}) * (sdd + {l}) - sqd * sqd) wq, ((sqq + {l}) * sdy - sqd * sqy) / ((sqq + {l}) * (sdd + {l}) - sqd * sqd) wd from m) """


@query("c1_ridge_fit", _MOM.format(l=0.5) + """
select 'quantity' term, round(wq, 4) coef from w union all select 'discount', round(wd, 3) from w union all select 'intercept', round(my - wq * mq - wd * md, 3) from w""")
def _(spark, d):
    f = L.ridge_fit(read(spark, d, "lineitem"), _x(), 2, ["l_extendedprice"], 0.5)
    rows = [("quantity", float(f.weights[0, 0]), 4), ("discount", float(f.weights[1, 0]), 3), ("intercept", float(f.bias[0]), 3)]
    return spark.createDataFrame([(t, round(v + 1e-9, k)) for t, v, k in rows], "term string, coef double")


@query("c2_ols_adj_r2", """
with s as (select count(*) n, pow(corr(l_quantity, l_extendedprice), 2) rq, pow(corr(l_discount, l_extendedprice), 2) rd,
 (pow(corr(l_quantity, l_extendedprice), 2) + pow(corr(l_discount, l_extendedprice), 2) - 2 * corr(l_quantity, l_extendedprice) * corr(l_discount, l_extendedprice) * corr(l_quantity, l_discount)) / (1 - pow(corr(l_quantity, l_discount), 2)) rb from lineitem)
select 'quantity' block, round(1 - (1 - rq) * (n - 1) / (n - 2), 8) adj_r2 from s union all select 'discount', round(1 - (1 - rd) * (n - 1) / (n - 2), 8) from s union all select 'both', round(1 - (1 - rb) * (n - 1) / (n - 3), 8) from s""")
def _(spark, d):
    li = read(spark, d, "lineitem").withColumn("x", _x())
    r = L.ols_adj_r2(li, "x", 2, "l_extendedprice", {"quantity": [0], "discount": [1], "both": [0, 1]})
    return rounded(spark.createDataFrame(list(r.items()), "block string, adj_r2 double"), 8)


@query("c3_predict_linear", _MOM.format(l=0.0) + "select l_orderkey, l_linenumber, l_quantity, l_discount, round(my + wq * (l_quantity - mq) + wd * (l_discount - md), 3) pred from lineitem, w")
def _(spark, d):
    li = read(spark, d, "lineitem")
    f = L.ridge_fit(li, _x(), 2, ["l_extendedprice"], 0.0)
    p = L.predict_linear(_x(), f, ["pred"])[0]
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", R(p, 3).alias("pred"))


@query("c4_interaction_pca", """
with x as (select l_quantity * l_discount a, l_quantity * l_tax b from lineitem), r as (select abs(corr(a, b)) r from x)
select 1 as component, round((1 + r) / 2, 8) explained from r union all select 2, round((1 - r) / 2, 8) from r""")
def _(spark, d):
    from ..functions.vectors import design_matrix

    li = read(spark, d, "lineitem")
    x = F.slice(design_matrix(F.array("l_quantity"), F.array("l_discount", "l_tax"), "full"), 5, 2)
    p = L.interaction_pca(li, x, 2, 2)
    return rounded(spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(p.explained)], "component int, explained double"), 8)


_MIXK = "((o_orderkey * 2654435761 + 1 * 40503) % 2147483647 * 48271) % 2147483647"
_OOF = f"""with f as (select o_orderkey, o_custkey, o_totalprice, ntile(5) over (order by {_MIXK}, o_orderkey) as fold, c_acctbal x from orders join customer on o_custkey = c_custkey),
g as (select v.fold, regr_slope(f.o_totalprice, f.x) b, regr_intercept(f.o_totalprice, f.x) a from f join (select unnest([1, 2, 3, 4, 5]) fold) v on f.fold <> v.fold group by 1) """


def _orders_x(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return N.fold_assign(o, 5, ["o_orderkey"], order=N.mixed("o_orderkey", 1))


@query("c5_oof_linear", _OOF + "select o_orderkey, cast(f.fold as int) fold, round(a + b * x, 3) score from f join g using (fold)")
def _(spark, d):
    out = L.oof_linear(_orders_x(spark, d), F.array("c_acctbal"), 1, "o_totalprice", "fold")
    return rounded(out.select("o_orderkey", "fold", "score"), 3)


def _labelled(spark, d):
    e = fx(spark, d, "emb").select("id", "split", "evt", F.slice("z", 57, 8).cast("array<double>").alias("z")).withColumn("y", (F.col("evt") < 3).cast("int"))
    return N.fold_assign(e, 5, ["id"], order=N.mixed("id", 1))


@query("c6_oof_logistic")
def _(spark, d):
    return rounded(L.oof_logistic(_labelled(spark, d), "z", "y", "fold", [1, 2, 3, 4, 5]).select("id", "fold", "y", "prob"), 3)


@query("c6_oof_logistic_by_group", f"""with f as (select o_orderkey, o_custkey % 3 as g,
 case when o_orderstatus = 'F' or o_custkey % 3 = 1 and o_orderkey % 5 = 0 then 1 else 0 end y, cast(ntile(5) over (order by {_MIXK}, o_orderkey) as int) fold from orders),
c as (select fold, g, sum(y) s, count(*) n from f group by 1, 2), r as (select v.fold, c.g, sum(s) / sum(n) p from c join (select unnest([1, 2, 3, 4, 5]) fold) v on c.fold <> v.fold group by 1, 2)
select o_orderkey, f.fold, round(p, 4) prob from f join r on r.fold = f.fold and r.g = f.g""")
def _(spark, d):
    # one indicator per group: the fit is the logit of the group's rate in the other folds
    o = read(spark, d, "orders")
    g, hit = F.col("o_custkey") % 3, (F.col("o_orderstatus") == "F") | ((F.col("o_custkey") % 3 == 1) & (F.col("o_orderkey") % 5 == 0))
    o = o.select("o_orderkey", F.array((g == 1).cast("double"), (g == 2).cast("double")).alias("x"), hit.cast("int").alias("y"))
    o = N.fold_assign(o, 5, ["o_orderkey"], order=N.mixed("o_orderkey", 1))
    return rounded(L.oof_logistic(o, "x", "y", "fold", [1, 2, 3, 4, 5]).select("o_orderkey", "fold", "prob"), 4)


@query("c7_multinomial_logit")
def _(spark, d):
    e = fx(spark, d, "emb").select("evt", "split", F.col("z").cast("array<double>").alias("z"))
    return rounded(L.multinomial_logit(e, "z", "evt", F.col("split") == "train"), 4)


@query("c8_oof_target_rate", f"""with f as (select o_orderkey, o_custkey % 50 as cluster, case when o_orderstatus = 'F' then 1 else 0 end y, cast(ntile(5) over (order by {_MIXK}, o_orderkey) as int) fold from orders),
r as (select a.fold, a.cluster, avg(b.y) r from (select distinct fold, cluster from f) a left join f b on a.cluster = b.cluster and a.fold <> b.fold group by 1, 2),
g as (select a.fold, avg(b.y) g from (select distinct fold from f) a join f b on a.fold <> b.fold group by 1)
select o_orderkey, cluster, fold, round(coalesce(r, g), 6) rate from f join r using (fold, cluster) join g using (fold)""")
def _(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("cluster"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    o = N.fold_assign(o, 5, ["o_orderkey"], order=N.mixed("o_orderkey", 1))
    return rounded(L.oof_target_rate(o, "cluster", "y", "fold").select("o_orderkey", "cluster", "fold", "rate"), 6)


def _units(spark, d):
    frame = N.fold_assign(fx(spark, d, "frame"), 5, ["cn"], order=F.substring("cn", -3, 3))
    return frame, sorted(r[0] for r in frame.select("unitcd").distinct().collect())  # survey units, a short list


@query("c9_calibration_spline")
def _(spark, d):
    frame, units = _units(spark, d)
    rows = [("spline_oof", L.calibration_variance(frame, "unitcd", units, "balive", "fold", spline="tcc")),
            ("spline_in_sample", L.calibration_variance(frame, "unitcd", units, "balive", None, spline="tcc"))]
    return rounded(spark.createDataFrame(rows, "model string, within_var double"), 4)


@query("c9_calibration_linear", ctes("frame") + """, f as (select unitcd u, tcc x, balive y, ntile(5) over (order by right(cn, 3), cn) as fold from frame),
t as (select v.fold o, f.* from f join (select unnest([1, 2, 3, 4, 5]) fold) v on f.fold <> v.fold), tm as (select o, u, avg(x) mx, avg(y) my, covar_pop(x, y) * count(*) sxy, var_pop(x) * count(*) sxx from t group by 1, 2),
tb as (select o, sum(sxy) / sum(sxx) b from tm group by 1), r as (select f.u, f.y - (tm.my + tb.b * (f.x - tm.mx)) e from f join tm on tm.o = f.fold and tm.u = f.u join tb on tb.o = f.fold),
g as (select u, count(*) n, var_pop(e) * count(*) ss from r group by 1), im as (select u, count(*) n, covar_pop(x, y) * count(*) sxy, var_pop(x) * count(*) sxx, var_pop(y) * count(*) syy from f group by 1)
select 'linear_oof' model, round(sum(ss) / (sum(n) - count(*)), 4) within_var from g union all select 'linear_in_sample', round((sum(syy) - sum(sxy) * sum(sxy) / sum(sxx)) / (sum(n) - count(*)), 4) from im""")
def _(spark, d):
    frame, units = _units(spark, d)
    rows = [("linear_oof", L.calibration_variance(frame, "unitcd", units, "balive", "fold", score=F.array("tcc"), score_dim=1)),
            ("linear_in_sample", L.calibration_variance(frame, "unitcd", units, "balive", None, score=F.array("tcc"), score_dim=1))]
    return rounded(spark.createDataFrame(rows, "model string, within_var double"), 4)


# --- clusters --------------------------------------------------------------------------------


def _phase(spark, d):
    """Phase block standardised on the training rows, with the pixel's annual series summary."""
    e = fx(spark, d, "emb").select("id", "split", "evt", "prow", "pcol", F.slice("z", 57, 8).cast("array<double>").alias("p"), F.slice("z", 1, 48).cast("array<double>").alias("t"))
    return train_standardise(e, "p", 8, F.col("split") == "train")


@query("c12_gmm_fit")
def _(spark, d):
    m = C.gmm_fit(_phase(spark, d), "p", 3, "diag")
    rows = [(i, float(m.weights[i]), float(m.means[i][0]), float(m.bic), float(m.aic)) for i in range(len(m.weights))]
    return rounded(spark.createDataFrame(rows, "component int, weight double, mean_0 double, bic double, aic double"), 2)


@query("c13_silhouette_sweep")
def _(spark, d):
    _, scores = C.silhouette_sweep(_phase(spark, d), "id", "p", [2, 3], n_init_final=1)
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in scores.items()], "k int, silhouette double"), 3)


@query("c13_silhouette", ctes("emb") + """, p as (select a.id i, a.evt own, b.evt lab, avg(list_distance(a.z[57:64]::double[], b.z[57:64]::double[])) m from emb a join emb b on a.id <> b.id group by 1, 2, 3),
s as (select i, max(m) filter (where own = lab) a, min(m) filter (where own <> lab) b from p group by 1) select round(avg((b - a) / greatest(a, b)), 5) silhouette from s""")
def _(spark, d):
    e = fx(spark, d, "emb").select("id", "evt", F.slice("z", 57, 8).cast("array<double>").alias("p"))
    return rounded(spark.createDataFrame([(C.silhouette_euclidean(e, "id", "p", "evt", None),)], "silhouette double"), 5)


@query("c13_silhouette_squared", ctes("emb") + """, v as (select id, evt, z[57:64]::double[] p from emb),
e as (select id, evt, i, p[i] x from v, (select unnest(range(1, 9)) i)), k as (select evt, count(*) n from v group by 1), m as (select evt, i, sum(x) s, sum(x * x) q from e group by 1, 2),
t as (select e.id, e.evt own, m.evt lab, sum(k.n * e.x * e.x + m.q - 2 * e.x * m.s) t, max(k.n) n from e join m using (i) join k on k.evt = m.evt group by 1, 2, 3),
s as (select id, max(t / greatest(n - 1, 1)) filter (where own = lab) a, max(n) filter (where own = lab) n, min(t / n) filter (where own <> lab) b from t group by 1)
select round(avg(case when n > 1 then (b - a) / greatest(a, b) else 0 end), 6) silhouette from s""")
def _(spark, d):
    e = fx(spark, d, "emb").select("id", "evt", F.slice("z", 57, 8).cast("array<double>").alias("p"))
    return rounded(spark.createDataFrame([(C.silhouette(e, "id", "p", "evt"),)], "silhouette double"), 6)


@query("c14_kmeans")
def _(spark, d):
    out, _, _ = C.kmeans(_phase(spark, d), "id", "p", 4, seed=1)
    return out.select("id", "cluster")


@query("a44_compactness", ctes("emb") + """, c as (select evt, i, var_pop(z[i]::double) * count(*) ss, count(*) n from emb, (select unnest(range(1, 65)) i) group by 1, 2)
select round(sum(ss) / (select count(*) from emb), 6) compactness from c""")
def _(spark, d):
    return rounded(C.compactness(emb(spark, d), "evt", "z", 64), 6)


@query("c16_landscape_taxonomy")
def _(spark, d):
    e = _phase(spark, d).withColumns({"tv": F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x) / 8, "pm": F.col("p")[0], "ysfc": (F.col("prow") * 7 + F.col("pcol")) % 31})
    rows, _, _ = C.landscape_taxonomy(e, "id", "p", "p", 8, "tv", "pm", [2], (2,), 0.25, 50)
    return rounded(C.sub_cluster_summary(rows, "ysfc"), 4)


@query("c17_ward_on_centroids")
def _(spark, d):
    e = _phase(spark, d)
    return C.ward_on_centroids(e, "id", "p", 8, "evt", 4, 20)[0].select("id", "segment")


@query("c17_assign_segments", ctes("emb") + """, x as (select id, evt % 3 + 1 as g, i, z[i]::double v from emb, (select unnest(range(57, 65)) i)), c as (select g, list(m order by i) m from (select g, i, avg(v) m from x group by 1, 2) group by 1),
p as (select id, c.g, list_distance(z[57:64]::double[], c.m) d from emb, c) select id, g as segment, round(d, 6) d from p qualify row_number() over (partition by id order by round (d * d, 9), g) = 1""")
def _(spark, d):
    e = fx(spark, d, "emb").select("id", "evt", F.slice("z", 57, 8).cast("array<double>").alias("p"))
    return rounded(C.assign_segments(e, "id", "p", 8, "evt", {c: c % 3 + 1 for c in range(10)}), 6)


@query("c18_cannot_link_ward")
def _(spark, d):
    e = _phase(spark, d).withColumn("macro", F.col("evt") < 4)
    _, group = C.ward_on_centroids(e, "id", "p", 8, "evt", 4, 20, "macro")
    return spark.createDataFrame([(int(k), int(v)) for k, v in sorted(group.items())], "evt int, grp int")


@query("c19_subdivide_by_phase")
def _(spark, d):
    return C.subdivide_by_phase(_phase(spark, d), "id", "evt", "p", 8, 0.3, 2).select("id", "evt", "phase_sub")


@query("c19_phase_variance", ctes("emb") + """, s as (select i, avg(z[i]::double) m, stddev_samp(z[i]::double) sd from emb, (select unnest(range(57, 65)) i) where split = 'train' group by 1),
v as (select evt, i, var_samp((z[i]::double - m) / sd) v, count(*) n from emb, s group by 1, 2) select evt, any_value(n) n, round(sum(v), 5) phase_var from v group by 1""")
def _(spark, d):
    return rounded(C.phase_variance(_phase(spark, d), "evt", "p", 8), 5)


def _binned(spark, d):
    f = fx(spark, d, "frame").withColumns({"fine_bin": F.floor(F.col("tcc") / 5).cast("int"), "macro": F.col("tcc") >= 40, "removal": F.col("n_cond") * 1.0})
    return f


@query("c20_aggregate_bins")
def _(spark, d):
    out = C.aggregate_bins(_binned(spark, d), "fine_bin", "balive", 4)
    return rounded(out.groupBy("stratum").agg(F.count("*").alias("n"), F.avg("balive").alias("mean_y"), F.countDistinct("fine_bin").alias("bins")), 4)


@query("c20_aggregate_bins_macro")
def _(spark, d):
    out = C.aggregate_bins_macro(_binned(spark, d), "fine_bin", "invyr", "macro", "balive", 3, 2)
    return rounded(out.groupBy("stratum").agg(F.count("*").alias("n"), F.avg("balive").alias("mean_y")), 4)


_DENSITY = "with recursive " + ctes("emb").removeprefix("with ") + """, s as (select i, avg(z[i]::double) m, stddev_samp(z[i]::double) sd from emb, (select unnest(range(57, 65)) i) where split = 'train' group by 1),
p as materialized (select id, list((z[i]::double - m) / sd order by i) p from emb, s group by id),
pairs as materialized (select a.id i, b.id j, round (list_distance(a.p, b.p), 9) d from p a join p b on a.id <> b.id),
nn as (select *, row_number() over (partition by i order by d, j) rk from pairs),
core as materialized (select i, mp, d core from nn join (values {mps}) t(mp) on rk = mp - 1),
lim as materialized (select mp, unnest({qs}) q, unnest(cuts) cut from (select mp, quantile_cont(core, {qs}) cuts from core group by mp)),
dense as materialized (select core.i, mp, q, cut from core join lim using (mp) where core <= cut),
e as materialized (select a.mp, a.q, a.i, b.i j from pairs join dense a on a.i = pairs.i join dense b on b.i = pairs.j and b.mp = a.mp and b.q = a.q where d <= a.cut),
reach as (select mp, q, i, i j from dense union select r.mp, r.q, r.i, e.j from reach r join e on e.mp = r.mp and e.q = r.q and e.i = r.j),
comp as materialized (select mp, q, i, min(j) c from reach group by 1, 2, 3), size as materialized (select mp, q, c, count(*) n from comp group by 1, 2, 3 having count(*) >= mp),
runs as (select mp, q, any_value(cut) cut, count(c) k, coalesce(sum(n), 0) n from lim left join size using (mp, q) group by mp, q) """


@query("c21_density_clusters", _DENSITY.format(mps="(4), (8)", qs="[0.5]") + """, best as (select mp from runs order by k = 0, abs(k - 5), mp limit 1),
nr as (select c, dense_rank() over (order by c) cluster from size where mp = (select mp from best)),
lab as (select comp.i, cluster from comp join nr using (c) where mp = (select mp from best)),
fill as (select pairs.i, cluster from pairs join lab on lab.i = pairs.j qualify row_number() over (partition by pairs.i order by d, j) = 1)
select id, cast(coalesce(lab.cluster, fill.cluster) as int) as cluster, lab.cluster is null as noise from p left join lab on lab.i = id left join fill on fill.i = id""")
def _(spark, d):
    out, _ = C.density_clusters(_phase(spark, d).select("id", "p"), "id", "p", [4, 8], 5)
    return out.select("id", "cluster", "noise")


@query("c21_density_grid", _DENSITY.format(mps="(3), (5), (9)", qs="[0.3, 0.6]") + "select mp min_pts, cast(q as double) cut_quantile, round(cut, 6) cut, k, round(1 - n / (select count(*) from p), 6) noise from runs")
def _(spark, d):
    return rounded(C.density_grid(_phase(spark, d).select("id", "p"), "id", "p", [3, 5, 9], [0.3, 0.6]), {"cut": 6, "noise": 6})


@query("c22_transfer_table")
def _(spark, d):
    return rounded(C.transfer_table(_binned(spark, d), "unitcd", ["fine_bin", "invyr"], "removal", "balive", 4), 4)

