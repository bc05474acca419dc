"""Code-graph and pair-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codegraph as C
from ..operators import pairmetrics as M
from ..operators import pairs as P
from ..operators.stats import median_frequency_weights
from ..session import cut_lineage
from .fixtures import ctes, fx, read
from .q_pairs import ALIGNED, _ALL, _knn, aligned, emb
from .q_series import CHANGE, change
from .registry import R, query, rounded

# --- confusion tables ------------------------------------------------------------------------

_CF = ctes("confusion") + ", cb as (select a, b, sum(n) n from confusion group by 1, 2) "


def combined(spark, d):
    c = cut_lineage(fx(spark, d, "confusion"))  # codes x codes x tables
    first = C.confusion_combine(c.filter("tbl = 'F'"), c.filter("tbl = 'O'"))
    return cut_lineage(C.confusion_combine(first, c.filter("tbl = 'P'")))


@query("a52_confusion_combine", _CF + "select a, b, n from cb")
def _(spark, d):
    return combined(spark, d)


@query("a53_confusion_summary", _CF + "select a, sum(n) row_total, round(100 * sum(case when a = b then n else 0 end) / sum(n), 6) pct_agreement from cb group by 1")
def _(spark, d):
    return rounded(C.confusion_summary(combined(spark, d)), {"pct_agreement": 6})


_KC = _CF + """, cc as (select c_nationkey as code, count(*) n from customer group by 1), mc as (select avg(n) * 0.95 m from cc),
kn as (select code, n from cc where n >= (select m from mc) and code in (select a from cb)),
ks as (select kn.code, kn.n, coalesce(sum(cb.n), 0) row_sum from kn left join cb on cb.a = kn.code and cb.b in (select code from kn) group by 1, 2),
codes as (select * from ks where row_sum >= (select avg(row_sum) * 0.6 from ks)) """


def _codes(spark, d):
    """Kept codes with thresholds relative to the table's own averages (two numbers reach the driver)."""
    conf = combined(spark, d)
    counts = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("code")).agg(F.count("*").alias("n"))
    min_count = counts.agg(F.avg("n") * 0.95).first()[0]
    first = C.filter_codes(conf, counts, "code", "n", min_count, 0)
    min_rows = first.agg(F.avg("row_sum") * 0.6).first()[0]
    return conf, C.filter_codes(conf, counts, "code", "n", min_count, min_rows)


@query("k1_filter_codes", _KC + "select code, n, row_sum from codes")
def _(spark, d):
    return _codes(spark, d)[1]


_P1 = _KC + """, kk as (select count(*) k from codes), ab as (select x.code a, y.code b from codes x cross join codes y),
sy as (select a, b, sum(n) / 2 n from (select a, b, n from cb union all select b, a, n from cb) group by 1, 2),
sm as (select ab.a, ab.b, coalesce(sy.n, 0) + 0.1 n from ab left join sy using (a, b)), p1 as (select a, b, n / sum(n) over (partition by a) p from sm),
p2 as (select x.a, y.b, sum(x.p * y.p) p from p1 x join p1 y on x.b = y.a group by 1, 2),
bi as (select a, b, case when p > 1.02 / (select k from kk) and a <> b then 1.0 else 0.0 end x from p2),
pb as (select a, b, case when sum(x) over (partition by a) > 0 then x / sum(x) over (partition by a) else 1.0 / (select k from kk) end p from bi) """


def graph(spark, d):
    conf, codes = _codes(spark, d)
    p1 = C.transition_matrix(conf, codes, "code", 0.1)
    p2 = C.diffuse(p1, 2)
    return conf, codes, p1, p2, C.binarise(p2, 1.02 / codes.count())


@query("k2_transition_matrix", _P1 + "select a, b, round(p, 8) p from p1")
def _(spark, d):
    return rounded(graph(spark, d)[2], 8)


@query("k3_diffuse", _P1 + ", p3 as (select x.a, y.b, sum(x.p * y.p) p from p2 x join p1 y on x.b = y.a group by 1, 2) select a, b, round(p, 8) p from p3")
def _(spark, d):
    return rounded(C.diffuse(graph(spark, d)[2], 3), 8)


@query("k4_binarise", _P1 + "select a, b, round(p, 8) p from pb")
def _(spark, d):
    return rounded(graph(spark, d)[4], 8)


@query("k5_reference_distance", _P1 + """
select o_orderkey, ci as code_i, cj as code_j, round(1 - coalesce(p, 0), 6) d_ref, p is not null valid_ref
from (select o_orderkey, c_nationkey ci, o_custkey % 25 cj from orders join customer on o_custkey = c_custkey) o left join pb on pb.a = ci and pb.b = cj""")
def _(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = o.select("o_orderkey", F.col("c_nationkey").alias("code_i"), (F.col("o_custkey") % 25).alias("code_j"))
    return rounded(C.reference_distance(pairs, graph(spark, d)[4]), {"d_ref": 6})


@query("k6_tau_sweep", _P1 + """, t as (select a, b, tau, -(1 - p) / tau z from p1 cross join (select unnest([0.01, 0.05, 0.1, 1.0]) tau) where a <> b),
r as (select tau, a, max(z) m, ln(sum(exp(z - mx))) l, sum(exp(z - mx) * z) / sum(exp(z - mx)) ez from (select *, max(z) over (partition by tau, a) mx from t) group by 1, 2),
h as (select tau::double tau, avg(m + l - ez) entropy from r group by 1)
select tau, round(entropy, 6) entropy, round(100 * entropy / ln((select k from kk) - 1), 4) pct_of_max, case when 100 * entropy / ln((select k from kk) - 1) < 20 then 'too peaked'
 when 100 * entropy / ln((select k from kk) - 1) < 35 then 'sharp' when 100 * entropy / ln((select k from kk) - 1) <= 65 then 'good range'
 when 100 * entropy / ln((select k from kk) - 1) <= 80 then 'soft' else 'too flat' end verdict from h""")
def _(spark, d):
    return rounded(C.tau_sweep(graph(spark, d)[2], [0.01, 0.05, 0.1, 1.0]), {"entropy": 6, "pct_of_max": 4})


@query("k7_graph_diagnostics", _P1 + """, i as (select * from cb where a in (select code from codes) and b in (select code from codes)),
r as (select code, count(*) filter (where a <> b and n > 0) confused, sum(case when a <> b then i.n else 0 end) / sum(i.n) off_mass from (select code from codes) c left join i on i.a = c.code group by 1)
select round(avg(confused), 6) mean_confused, round(avg(off_mass), 6) mean_off_mass, count(*) n_codes, round((select 100 * avg(case when p > 0 then 1.0 else 0.0 end) from p1 where a <> b), 4) pct_nonzero_1,
 round((select 100 * avg(case when p > 0 then 1.0 else 0.0 end) from pb where a <> b), 4) pct_nonzero_k from r""")
def _(spark, d):
    conf, _codes_, p1, _p2, pb = graph(spark, d)
    return rounded(C.graph_diagnostics(conf, p1, pb), {"mean_confused": 6, "mean_off_mass": 6, "pct_nonzero_1": 4, "pct_nonzero_k": 4})


@query("k7_row_sum_histogram", _CF + """, r as (select a, sum(n) s from cb group by 1), l as (select min(s) lo, max(s) hi from r)
select cast(least(4, floor((s - lo) / ((hi - lo) / 5))) as bigint) bin, count(*) n from r, l group by 1""")
def _(spark, d):
    return C.row_sum_histogram(combined(spark, d), 5)


# --- contrastive and neighbourhood metrics ---------------------------------------------------

_PN = _ALL + f", k as {_knn(12)}, pn as (select i, j, case when rk <= 4 then exp(-d) else 1.0 end w, rk <= 4 as positive from k) "


def _contrast_pairs(spark, d):
    p = P.knn_pairs(emb(spark, d), 12)
    return p.select("i", "j", F.when(F.col("rank") <= 4, F.exp(-F.col("d"))).otherwise(1.0).alias("w"), (F.col("rank") <= 4).alias("positive"))


_SIM = {
    "l2": "-pow(list_distance(a.z::double[], b.z::double[]), 2) / 64",
    "cosine": "list_cosine_similarity(a.z::double[], b.z::double[])",
    "dot": "list_inner_product(a.z::double[], b.z::double[])",
}


@query("m1_infonce", _PN + ", " + ", ".join(f"""z_{k} as (select i, positive, ln(w) + ({s}) / 0.1 z from pn join emb a on a.id = i join emb b on b.id = j),
 l_{k} as (select i, ln(sum(exp(z - m)) + 1e-8) - ln(sum(exp(z - m)) filter (where positive) + 1e-8) l from (select *, max(z) over (partition by i) m from z_{k}) group by 1)""" for k, s in _SIM.items())
       + " " + " union all ".join(f"select '{k}' similarity, round(avg(l), 6) loss, count(*) n_anchors from l_{k}" for k in _SIM))
def _(spark, d):
    e, p = emb(spark, d), cut_lineage(_contrast_pairs(spark, d))  # one search for all similarities
    out = None
    for kind in _SIM:
        r = M.infonce(p, e, "id", "z", 64, 0.1, kind).withColumn("similarity", F.lit(kind))
        out = r if out is None else out.unionByName(r)
    return rounded(out, {"loss": 6})


def _kl(name, ref, lrn, cond):
    return f""", {name}0 as (select i, j, w, a, {ref} dr, {lrn} dl from al where {cond}),
{name}1 as (select *, count(*) over p n, -dr / 0.1 - ln(sum(exp(-dr / 0.1)) over p) lp, -dl / 0.2 - ln(sum(exp(-dl / 0.2)) over p) lq from {name}0 window p as (partition by i, j, a)),
{name}2 as (select i, j, w, a, n, sum(exp(lp) * (lp - lq)) kl, -sum(exp(lp) * lp) hp, -sum(exp(lq) * lq) hq from {name}1 where n >= 2 group by 1, 2, 3, 4, 5),
{name}3 as (select i, j, w, avg(kl) kl, count(*) nr, sum(n) ov, sum(hp) hp, sum(hq) hq from {name}2 group by 1, 2, 3) """


@query("m2_soft_neighbourhood_kl", ALIGNED + _kl("s", "d_ref_self", "d_learned_self", "mask_self") + """
select round(sum(w * kl) / sum(w), 6) loss, count(*) n_pairs_active, cast(sum(nr) as bigint) n_rows_valid, round(sum(ov) / sum(nr), 6) mean_overlap, round(sum(hp) / sum(nr), 6) mean_entropy_ref,
 round(sum(hq) / sum(nr), 6) mean_entropy_learned from s3""")
def _(spark, d):
    out = M.soft_neighbourhood_kl(aligned(spark, d), ["i", "j"], "a", "d_ref_self", "d_learned_self", 0.1, 0.2, F.col("mask_self"), "w")
    return rounded(out, 6)


@query("m3_phase_neighbourhood", ALIGNED + _kl("s", "d_ref_self", "d_learned_self", "mask_self") + _kl("c", "d_ref_cross", "d_learned_cross", "true") + """
, x as (select sum(w * kl) / sum(w) loss_self, cast(sum(nr) as bigint) rows_self from s3), y as (select sum(w * kl) / sum(w) loss_cross, cast(sum(nr) as bigint) rows_cross from c3)
select round(loss_self, 6) loss_self, rows_self, round(loss_cross, 6) loss_cross, rows_cross, round(loss_self + 0.5 * loss_cross, 6) loss from x, y""")
def _(spark, d):
    return rounded(M.phase_neighbourhood(aligned(spark, d), 0.1, 0.2, "w", 1.0, 0.5), 6)


@query("m4_spread_ranking", ALIGNED + """, sp as (select i, j, coalesce(sum(d_learned_self) filter (where mask_self), 0) / greatest(count(*) filter (where mask_self), 1) si,
 coalesce(sum(d_learned_self_j) filter (where mask_self), 0) / greatest(count(*) filter (where mask_self), 1) sj from al group by 1, 2),
dy as (select pixel, avg(red) s from annual group by 1), q as (select si, sj, a.s - b.s diff from sp join dy a on a.pixel = i join dy b on b.pixel = j)
select round(avg(case when diff > 0.0123 then ln(1 + exp(sj - si + 0.1)) when diff < -0.0123 then ln(1 + exp(si - sj + 0.1)) else 0 end), 6) loss, count(*) n_pairs,
 count_if(diff > 0.0123) n_constrained_i, count_if(diff < -0.0123) n_constrained_j, round(count_if((diff > 0.0123 and si - sj > 0.1) or (diff < -0.0123 and sj - si > 0.1)) / count_if(abs(diff) > 0.0123), 6) frac_satisfied,
 round(avg(si), 6) mean_spread_i, round(avg(sj), 6) mean_spread_j, round(avg(abs(diff)), 6) mean_ref_diff from q""")
def _(spark, d):
    dyn = fx(spark, d, "annual").groupBy("pixel").agg(F.avg("red").alias("s"))
    return rounded(M.spread_ranking(aligned(spark, d), dyn, "pixel", "s", 0.1, 0.0123), 6)


_TR = CHANGE + """, fl as (select pixel, bool_or(yr in (1996, 1998, 2000) and ysfc = 0) atv, bool_or(yr > 1996 and yr < 1998 and ysfc = 0) d01, bool_or(yr > 1998 and yr < 2000 and ysfc = 0) d12 from cs group by 1),
cons as (select * from (values ('d01', 1, 2, 0, 1, true), ('d01', 1, 2, 0, 2, true), ('d01', 0, 2, 0, 1, false), ('d12', 0, 1, 1, 2, true), ('d12', 0, 1, 0, 2, true), ('d12', 0, 2, 1, 2, false),
 ('none', 0, 1, 0, 2, false), ('none', 1, 2, 0, 2, false)) v(c, closer_a, closer_b, farther_a, farther_b, "large")),
tc as (select pixel, closer_a, closer_b, farther_a, farther_b, "large" from fl join cons on c = case when d01 then 'd01' when d12 then 'd12' else 'none' end where not atv and not (d01 and d12)) """


@query("m5_triplet_constraints", _TR + 'select pixel, closer_a, closer_b, farther_a, farther_b, "large" from tc')
def _(spark, d):
    return M.triplet_constraints(change(spark, d), "pixel", "yr", "ysfc", 1996, 1998, 2000)


@query("m5_triplet_loss", _TR + """, sl as (select pixel, case yr when 1996 then 0 when 1998 then 1 else 2 end s, swir1, swir2 from cs where yr in (1996, 1998, 2000) qualify count(*) over (partition by pixel) = 3),
v as (select tc.pixel, "large", pow(a.swir1 - b.swir1, 2) + pow(a.swir2 - b.swir2, 2) - pow(x.swir1 - y.swir1, 2) - pow(x.swir2 - y.swir2, 2) + case when "large" then 1.0 else 0.3 end v
 from tc join sl a on a.pixel = tc.pixel and a.s = closer_a join sl b on b.pixel = tc.pixel and b.s = closer_b join sl x on x.pixel = tc.pixel and x.s = farther_a join sl y on y.pixel = tc.pixel and y.s = farther_b)
select round(avg(ln(1 + exp(v))), 6) loss, count(*) n_constraints, count_if("large") n_large, count_if(not "large") n_small, count(distinct pixel) n_pixels_valid, round(avg(case when v < 0 then 1.0 else 0.0 end), 6) frac_satisfied from v""")
def _(spark, d):
    c = change(spark, d)
    slots = c.groupBy("pixel").agg(*[F.max(F.when(F.col("yr") == y, F.struct("swir1", "swir2"))).alias(f"s{i}") for i, y in enumerate((1996, 1998, 2000))]).dropna()
    slots = slots.select("pixel", *[F.array(F.col(f"s{i}.swir1"), F.col(f"s{i}.swir2")).alias(f"z{i}") for i in range(3)])
    return rounded(M.triplet_loss(M.triplet_constraints(c, "pixel", "yr", "ysfc", 1996, 1998, 2000), slots, "pixel", ("z0", "z1", "z2")), {"loss": 6, "frac_satisfied": 6})


@query("m6_recovery_discrimination", CHANGE + """, p as (select a.pixel, sqrt(greatest(pow(a.swir1 - b.swir1, 2) + pow(a.swir2 - b.swir2, 2), 1e-12)) d from cs a join cs b on a.pixel = b.pixel and a.ysfc <= 1 and b.ysfc >= 5)
select round(coalesce(avg(ln(1 + exp(0.5 - d))), 0), 6) loss, count(*) n_pairs, count(distinct pixel) n_active_pixels from p""")
def _(spark, d):
    return rounded(M.recovery_discrimination(change(spark, d), "pixel", "ysfc", F.array("swir1", "swir2")), {"loss": 6})


@query("m7_variance_covariance", ctes("emb") + """, ij as (select a.i, b.j from (select unnest(range(57, 65)) i) a, (select unnest(range(57, 65)) j) b),
c as (select i, j, covar_samp(z[i]::double, z[j]::double) c from emb, ij group by 1, 2)
select round(avg(greatest(1 - sqrt(c + 1e-4), 0)) filter (where i = j), 6) variance_term, round(sum(c * c) filter (where i <> j) / 8, 10) covariance_term from c""")
def _(spark, d):
    v, c = M.variance_covariance(emb(spark, d).withColumn("p", F.slice("z", 57, 8)), "p", 8)
    return rounded(spark.createDataFrame([(v, c)], "variance_term double, covariance_term double"), {"variance_term": 6, "covariance_term": 10})


_M8 = _P1 + ", " + ctes("emb")[5:] + """, f as (select code, n / (select sum(n) from codes) fr from codes), cw as (select code, least(5, (select median(fr) from f) / fr) w from f),
va as (select id, z, evt from emb where evt in (select code from codes)),
ap as (select x.id i, x.evt own, 1 - pb.p dr, round (list_distance(x.z::double[], y.z::double[]), 9) dl from va x join va y on x.evt <> y.evt join pb on pb.a = x.evt and pb.b = y.evt),
l as (select *, count(*) over p n, -dr / 0.3 - ln(sum(exp(-dr / 0.3)) over p) lp, -dl / 0.2 - ln(sum(exp(-dl / 0.2)) over p) lq from ap window p as (partition by i)),
r as (select i, own, sum(exp(lp) * (lp - lq)) kl, -sum(exp(lp) * lp) h, count_if(dr < 1 - 1e-6) nc from l group by 1, 2)
select round(sum(w * kl) / sum(w), 5) loss, count(*) n_rows_active, round(avg(h), 5) mean_entropy_ref, round(exp(avg(h)), 4) eff_n_ref,
 round((select avg(dl) from ap where dr < 1 - 1e-6), 5) d_confused, round((select avg(dl) from ap where dr >= 1 - 1e-6), 5) d_other, round(avg(nc), 5) n_confused_pairs from r join cw on cw.code = r.own"""


def _code_kl(spark, d, within=()):
    _conf, codes, _p1, _p2, pb = graph(spark, d)
    w = median_frequency_weights(codes, "code", "n", 5.0)
    out = M.code_neighbourhood_kl(emb(spark, d).withColumnRenamed("evt", "code"), pb, w, "id", "z", "code", 0.3, 0.2, within)
    return rounded(out, {"loss": 5, "mean_entropy_ref": 5, "eff_n_ref": 4, "d_confused": 5, "d_other": 5, "n_confused_pairs": 5})


@query("m8_code_neighbourhood_kl", _M8)
def _(spark, d):
    return _code_kl(spark, d)


@query("m8_code_neighbourhood_kl_in_patch", _M8.replace("va as (select id, z, evt from", "va as (select id, z, evt, brow, bcol from").replace(
    "pb.b = y.evt)", "pb.b = y.evt where x.brow = y.brow and x.bcol = y.bcol qualify count(*) over (partition by x.id) >= 2)"))
def _(spark, d):
    return _code_kl(spark, d, ("brow", "bcol"))


# --- element losses --------------------------------------------------------------------------

_L9 = {"l1": "abs(e)", "l2": "e * e", "huber": "case when abs(e) < 0.2 then 0.5 * e * e else 0.2 * (abs(e) - 0.1) end", "smooth_l1": "case when abs(e) < 1 then 0.5 * e * e else abs(e) - 0.5 end"}


@query("m9_reconstruction_error", ctes("annual") + ", v as (select red - nir e, change <> 16 and nir is not null m from annual) " + " union all ".join(
    f"select '{k}' kind, round(avg(case when m then {x} end), 7) mean_loss, round(sum(case when m then {x} end), 4) sum_loss from v" for k, x in _L9.items()))
def _(spark, d):
    a = fx(spark, d, "annual")
    m = (F.col("change") != 16) & F.col("nir").isNotNull()
    loss = {k: F.when(m, M.reconstruction_error("red", "nir", k, 0.2)) for k in _L9}
    row = a.agg(*[f(x).alias(f"{k}_{n}") for k, x in loss.items() for n, f in (("mean", F.avg), ("sum", F.sum))])
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_mean").alias("mean_loss"), F.col(f"{k}_sum").alias("sum_loss")) for k in loss]))
    return rounded(row.select(parts.alias("p")).select("p.*"), {"mean_loss": 7, "sum_loss": 4})


@query("m10_count_nll", """with v as (select greatest(l_tax * 100, 1e-8) r, l_quantity y, l_discount > 0.01 m from lineitem)
select 'poisson' kind, round(avg(r - y * ln(r)) filter (where m), 5) loss from v union all select 'poisson_full', round(avg(r - y * ln(r) + lgamma(y + 1)) filter (where m), 5) from v
union all select 'negative_binomial', round(avg(-lgamma(y + 2.5) + lgamma(y + 1) + lgamma(2.5) - 2.5 * (ln(2.5) - ln(2.5 + r)) - y * (ln(r) - ln(2.5 + r))) filter (where m), 5) from v""")
def _(spark, d):
    li = read(spark, d, "lineitem").select((F.col("l_tax") * 100).alias("r"), F.col("l_quantity").alias("y"), (F.col("l_discount") > 0.01).alias("m"))
    kinds = {"poisson": M.count_nll("r", "y"), "poisson_full": M.count_nll("r", "y", full=True), "negative_binomial": M.count_nll("r", "y", "negative_binomial", 2.5)}
    row = li.agg(*[F.avg(F.when(F.col("m"), x)).alias(k) for k, x in kinds.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), R(k, 5).alias("loss")) for k in kinds]))
    return row.select(pairs.alias("p")).select("p.*")


@query("m11_categorical_ce", ctes("emb") + """, l as (select id, evt, list_transform(z[1:10], lambda x: x::double * 5) q, [1.0, 2.0, 1.0, 1.0, 0.5, 1.0, 1.0, 1.0, 3.0, 1.0]::double[] w from emb),
s as (select *, ln(list_sum(list_transform(q, lambda v: exp(v)))) lse from l),
c as (select id, evt, lse - q[evt + 1] h, w[evt + 1] wt, list_sum(list_transform(range(1, 11), lambda i: (lse - q[i]) * w[i])) ev from s)
select id, round(h, 6) ce, round(case when evt = 3 then 0 else 0.9 * h * wt + 0.1 * ev / 10 end, 6) weighted from c""")
def _(spark, d):
    q = F.transform(F.slice("z", 1, 10), lambda v: v * 5)
    w = [1.0, 2.0, 1.0, 1.0, 0.5, 1.0, 1.0, 1.0, 3.0, 1.0]
    e = emb(spark, d).withColumn("q", q)
    return e.select("id", R(M.categorical_ce("q", "evt"), 6).alias("ce"), R(M.categorical_ce("q", "evt", w, 0.1, 3), 6).alias("weighted"))


@query("m12_cross_covariance_norm", ctes("emb") + """, ij as (select a.i, b.j from (select unnest(range(57, 65)) i) a, (select unnest(range(1, 49)) j) b),
c as (select i, j, covar_samp(z[i]::double, z[j]::double) c from emb, ij group by 1, 2) select round(sqrt(sum(c * c)), 8) frobenius from c""")
def _(spark, d):
    e = emb(spark, d).withColumns({"h": F.slice("z", 57, 8), "t": F.slice("z", 1, 48)})
    return rounded(spark.createDataFrame([(M.cross_covariance_norm(e, "h", 8, "t", 48),)], "frobenius double"), 8)
