"""Neighbour-pair and kNN queries on the whole vector table.

``round (`` with a space in the SQL rounds without the comparison nudge: distances are rounded to nine
places before ties are broken by id, as in the library.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import knn as K
from ..operators import neighbors as NB
from ..operators import pairs as P
from ..operators import sample as N
from .fixtures import ctes, fx
from .q_series import CHANGE, RUNS, change
from .registry import R, query, rounded

_DIST = "round (list_distance(a.z::double[], b.z::double[]), 9)"
_E = ctes("emb")
_ALL = _E + f", ap as (select a.id i, b.id j, {_DIST} d, a.evt ei, b.evt ej from emb a join emb b on a.id <> b.id) "


def _knn(k, src="ap"):
    return f"(select i, j, d, row_number() over (partition by i order by d, j) as rk from {src} qualify rk <= {k})"


def emb(spark, d):
    return fx(spark, d, "emb").withColumn("z", V.doubles("z"))


@query("j06_pairwise_distance", _E + """, c as (select evt, i, avg(z[i]::double) v from emb, (select unnest(range(1, 65)) i) group by 1, 2),
cc as (select evt, list(v order by i) v from c group by 1)
select e.id as i, cc.evt as j, round(list_distance(e.z::double[], cc.v), 6) d from emb e, cc""")
def _(spark, d):
    e = emb(spark, d)
    return rounded(P.pairwise_distance(e, "id", "z", class_centroids(e, "evt"), "evt", "v"), 6)


def class_centroids(e, label):
    """Mean vector per class."""
    x = e.select(label, F.posexplode("z").alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("m"))
    return x.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))


@query("j07_knn_pairs", _ALL + f"select i, j, round(d, 6) d, cast(rk as int) as rank from {_knn(8)}")
def _(spark, d):
    return rounded(P.knn_pairs(emb(spark, d), 8), 6)


@query("j07_knn_pairs_cells", _ALL + f"select i, j, round(d, 6) d, cast(rk as int) as rank from {_knn(5)}")
def _(spark, d):
    # the path for tables beyond one block: pivot cells, split cells, pruned routing
    e = emb(spark, d)
    return rounded(NB.knn_join(e, e, 5, pivots=16, ref_block=64, query_block=128), 6)


@query("j07_knn_pairs_file", _ALL + f"select i, j, round(d, 6) d, cast(rk as int) as rank from {_knn(8)}")
def _(spark, d):
    # approximations of one byte a dimension meet the queries, whole vectors only the pairs they leave
    return rounded(P.knn_pairs(emb(spark, d), 8, bits=8, ref_block=128, query_block=128), 6)


@query("j08_mutual_knn_pairs", _ALL + f", k as {_knn(8)} select a.i, a.j, round(a.d, 6) d from k a join k b on a.i = b.j and a.j = b.i")
def _(spark, d):
    return rounded(P.mutual_knn_pairs(emb(spark, d), 8).select("i", "j", "d"), 6)


_SAME = _E + f", ap as (select a.id i, b.id j, {_DIST} d from emb a join emb b on a.id <> b.id and a.brow = b.brow and a.bcol = b.bcol) "
_KEY = ("brow", "bcol")  # a patch: only its own rows are neighbours


@query("j07_knn_pairs_in_patch", _SAME + f"select i, j, round(d, 6) d, cast(rk as int) as rank from {_knn(8)}")
def _(spark, d):
    return rounded(P.knn_pairs(emb(spark, d), 8, within=_KEY), 6)


@query("j08_mutual_knn_pairs_in_patch", _SAME + f", k as {_knn(8)} select a.i, a.j, round(a.d, 6) d from k a join k b on a.i = b.j and a.j = b.i")
def _(spark, d):
    return rounded(P.mutual_knn_pairs(emb(spark, d), 8, within=_KEY).select("i", "j", "d"), 6)


@query("j11_radius_pairs_in_patch", _SAME + "select i, j, round(d, 6) d from ap where d >= 1.1 and d < 1.25")
def _(spark, d):
    return rounded(P.radius_pairs(emb(spark, d), 1.1, 1.25, within=_KEY), 6)


@query("j10_quantile_pairs_in_patch", _SAME + ", q as (select quantile_cont(d, 0.5) lo, quantile_cont(d, 0.75) hi from ap) select i, j, round(d, 6) d from ap, q where d >= lo and d < hi")
def _(spark, d):
    # the band of all distances inside the patches, near and far; no other pair leaves a task
    return rounded(P.band_pairs(emb(spark, d), 0.5, 0.75, within=_KEY), 6)


@query("j10_quantile_pairs_all", _ALL + ", q as (select quantile_cont(d, 0.02) lo, quantile_cont(d, 0.06) hi from ap) select i, j, round(d, 6) d from ap, q where d >= lo and d < hi")
def _(spark, d):
    # all pairs of the table, in blocks; ranks found by cutting cells twice
    return rounded(P.band_pairs(emb(spark, d), 0.02, 0.06, ref_block=128, query_block=256, few=20), 6)


@query("j12_negatives_in_patch", _SAME + """, f as (select ap.* from ap join emb a on a.id = i join emb b on b.id = j
 where sqrt((a.prow - b.prow) * (a.prow - b.prow) + (a.pcol - b.pcol) * (a.pcol - b.pcol)) >= 3), q as (select quantile_cont(d, 0.5) lo, quantile_cont(d, 0.75) hi from f)
select i, j, round(d, 6) d from f, q where d >= lo and d < hi""")
def _(spark, d):
    _pos, neg = P.spatially_constrained_pairs(emb(spark, d), 8, row="prow", col="pcol", neg_min=3.0, within=_KEY)
    return rounded(neg, 6)


@query("j12_positives_in_patch", _SAME + f""", f as (select ap.* from ap join emb a on a.id = i join emb b on b.id = j
 where sqrt((a.prow - b.prow) * (a.prow - b.prow) + (a.pcol - b.pcol) * (a.pcol - b.pcol)) >= 2), k as {_knn(6, "f")}
select a.i, a.j, round(a.d, 6) d from k a join k b on a.i = b.j and a.j = b.i""")
def _(spark, d):
    pos, _neg = P.spatially_constrained_pairs(emb(spark, d), 6, row="prow", col="pcol", pos_min=2.0, neg_min=3.0, within=_KEY)
    return rounded(pos.select("i", "j", "d"), 6)


_SPAT = _E + f""", ap as (select a.id i, b.id j, {_DIST} d from emb a join emb b on a.id <> b.id
 where sqrt((a.prow - b.prow) * (a.prow - b.prow) + (a.pcol - b.pcol) * (a.pcol - b.pcol)) >= 4 """


@query("j09_mutual_knn_blocked", _SPAT + f" or a.brow * 1000 + a.bcol <> b.brow * 1000 + b.bcol), k as {_knn(8)} select a.i, a.j, round(a.d, 6) d from k a join k b on a.i = b.j and a.j = b.i")
def _(spark, d):
    e = emb(spark, d).withColumn("patch", F.col("brow") * 1000 + F.col("bcol"))
    return rounded(P.mutual_knn_blocked(e, 8, 4.0, "patch", row="prow", col="pcol").select("i", "j", "d"), 6)


@query("j09_mutual_knn_file", _SPAT + f" or a.brow * 1000 + a.bcol <> b.brow * 1000 + b.bcol), k as {_knn(8)} select a.i, a.j, round(a.d, 6) d from k a join k b on a.i = b.j and a.j = b.i")
def _(spark, d):
    e = emb(spark, d).withColumn("patch", F.col("brow") * 1000 + F.col("bcol"))
    return rounded(P.mutual_knn_blocked(e, 8, 4.0, "patch", row="prow", col="pcol", bits=8, ref_block=128, query_block=128).select("i", "j", "d"), 6)


@query("j12_spatially_constrained_pairs", _SPAT + f"), k as {_knn(8)} select a.i, a.j, round(a.d, 6) d from k a join k b on a.i = b.j and a.j = b.i")
def _(spark, d):
    e = emb(spark, d)
    pos, _neg = P.spatially_constrained_pairs(e, 8, P.knn_pairs(e, 8).select("i", "j"), row="prow", col="pcol")
    return rounded(pos.select("i", "j", "d"), 6)


@query("j12_constrained_negatives", _ALL + f""", k as {_knn(20)}, f as (select k.* from k join emb a on a.id = i join emb b on b.id = j
 where sqrt((a.prow - b.prow) * (a.prow - b.prow) + (a.pcol - b.pcol) * (a.pcol - b.pcol)) >= 8), q as (select quantile_cont(d, 0.5) lo, quantile_cont(d, 0.75) hi from f)
select i, j, round(d, 6) d from f, q where d >= lo and d < hi""")
def _(spark, d):
    e = emb(spark, d)
    _pos, neg = P.spatially_constrained_pairs(e, 8, P.knn_pairs(e, 20).select("i", "j"), row="prow", col="pcol")
    return rounded(neg, 6)


@query("j10_quantile_pairs", _ALL + f", k as {_knn(10)}, q as (select quantile_cont(d, 0.5) lo, quantile_cont(d, 0.75) hi from k) select i, j, round(d, 6) d from k, q where d >= lo and d < hi")
def _(spark, d):
    return rounded(P.quantile_pairs(P.knn_pairs(emb(spark, d), 10).select("i", "j", "d"), 0.5, 0.75), 6)


@query("j11_radius_pairs", _ALL + "select i, j, round(d, 6) d from ap where d >= 1.1 and d < 1.25")
def _(spark, d):
    return rounded(P.radius_pairs(emb(spark, d), 1.1, 1.25), 6)


@query("j11_radius_pairs_cells", _ALL + "select i, j, round(d, 6) d from ap where d >= 0 and d < 1.2")
def _(spark, d):
    return rounded(P.radius_pairs(emb(spark, d), 0.0, 1.2, pivots=16, ref_block=64, query_block=128), 6)


@query("j11_radius_pairs_file", _ALL + "select i, j, round(d, 6) d from ap where d >= 0.9 and d < 1.15")
def _(spark, d):
    return rounded(P.radius_pairs(emb(spark, d), 0.9, 1.15, bits=8, ref_block=128, query_block=128), 6)


@query("j13_symmetric_pairs", _ALL + f", k as {_knn(5)}, a as (select * from k where i in (select id from emb where split <> 'train')) select i, j from a union all select j, i from a where j in (select id from emb where split <> 'train')")
def _(spark, d):
    e = emb(spark, d)
    anchors = e.filter("split <> 'train'")
    return P.symmetric_pairs(P.knn_pairs(e, 5, anchors=anchors).select("i", "j"), anchors)


@query("j14_cap_pairs", _ALL + f", k as {_knn(5)} select i, j from k order by ((((i * 100000 + j) * 2654435761 + 11 * 40503) % 2147483647 * 48271) % 2147483647), i, j limit 300")
def _(spark, d):
    p = P.knn_pairs(emb(spark, d), 5).select("i", "j")
    return N.cap_pairs(p, 300, order=N.mixed(F.col("i") * 100000 + F.col("j"), 11))


@query("j21_pair_weights", _ALL + f"select i, j, round(greatest(0.05, least(1, exp(-d / 0.5))), 6) w_pos, round(greatest(0.05, least(1, 1 - exp(-d / 0.5))), 6) w_neg from {_knn(5)}")
def _(spark, d):
    p = P.knn_pairs(emb(spark, d), 5)
    return p.select("i", "j", R(P.pair_weights("d", 0.5, "positive"), 6).alias("w_pos"), R(P.pair_weights("d", 0.5, "negative"), 6).alias("w_neg"))


# --- ysfc pairs: vector id = pixel of the annual series --------------------------------------

_OV = CHANGE + f""", {_ALL[5:]}, ys as (select distinct pixel, ysfc from cs), k as {_knn(16)},
ov as (select k.i, k.j, k.d, count(*) as overlap, string_agg(a.ysfc::varchar, ',' order by a.ysfc) shared from k join ys a on a.pixel = k.i join ys b on b.pixel = k.j and a.ysfc = b.ysfc group by 1, 2, 3) """


@query("j19_ysfc_overlap", _OV + "select i, j, cast(overlap as int) overlap, shared from ov")
def _(spark, d):
    p = P.knn_pairs(emb(spark, d), 16).select("i", "j", "d")
    o = P.ysfc_overlap(p, change(spark, d), "pixel", "ysfc").filter("overlap > 0")
    return o.select("i", "j", "overlap", F.array_join(F.transform("shared", lambda x: x.cast("string")), ",").alias("shared"))


_PP = _OV + """, f as (select *, count(*) over (partition by i) n from ov where overlap >= 1), g as (select i, j, d, overlap, exp(-d / 5) w from f where n >= 3),
pp as (select i, j, d, overlap, w from g union all select distinct i, i, 0.0, null, 1.0 from g) """


@query("j18_phase_pairs", _PP + "select i, j, round(d, 6) d, cast(overlap as int) overlap, round(w, 6) w from pp")
def _(spark, d):
    c = change(spark, d).withColumnRenamed("pixel", "id")
    return rounded(P.phase_pairs(emb(spark, d), c, "id", "z", "ysfc", k=16, min_overlap=1, min_pairs=3), 6)


@query("j18_phase_pairs_in_patch", _PP.replace(_ALL[5:], _SAME[5:]) + "select i, j, round(d, 6) d, cast(overlap as int) overlap, round(w, 6) w from pp")
def _(spark, d):
    c = change(spark, d).withColumnRenamed("pixel", "id")
    return rounded(P.phase_pairs(emb(spark, d), c, "id", "z", "ysfc", k=16, min_overlap=1, min_pairs=3, within=_KEY), 6)


@query("j18_phase_pair_stats", _PP + """
select count(distinct i) n_anchors_surviving, count_if(i = j) n_self_pairs, count(*) n_total_pairs, round(avg(overlap), 6) overlap_mean, cast(min(overlap) as int) overlap_min,
 round(avg(w) filter (where i <> j), 6) weight_mean, round(stddev_samp(w) filter (where i <> j), 6) weight_std,
 round(quantile_cont(d, 0.25) filter (where i <> j), 6) q25, round(quantile_cont(d, 0.5) filter (where i <> j), 6) q50, round(quantile_cont(d, 0.75) filter (where i <> j), 6) q75 from pp""")
def _(spark, d):
    c = change(spark, d).withColumnRenamed("pixel", "id")
    return rounded(P.phase_pair_stats(P.phase_pairs(emb(spark, d), c, "id", "z", "ysfc", k=16, min_overlap=1, min_pairs=3)), 6)


def _steps(spark, d):
    from ..operators.timeseries import ysfc_runs

    runs = ysfc_runs(change(spark, d), ["pixel"], "yr").withColumn("nir0", F.coalesce("nir", F.lit(0.0)))
    return P.selected_steps(runs, "pixel", "yr", "ysfc", ["nir0", "red"], ["swir1", "swir2"])


def aligned(spark, d):
    return P.aligned_pair_distances(P.knn_pairs(emb(spark, d), 6).select("i", "j", F.exp(-F.col("d")).alias("w")), _steps(spark, d), "pixel", 2)


ALIGNED = RUNS + f""", {_ALL[5:]}, k as {_knn(6)}, best as (select pixel, ysfc, coalesce(nir, 0) nir0, red, swir1, swir2 from runs qualify row_number() over (partition by pixel, ysfc order by run_len desc, yr desc) = 1),
sh as (select k.i, k.j, exp(-k.d) w, p.ysfc y, p.nir0 in0, p.red ir, p.swir1 i1, p.swir2 i2, q.nir0 jn0, q.red jr, q.swir1 j1, q.swir2 j2 from k join best p on p.pixel = k.i join best q on q.pixel = k.j and p.ysfc = q.ysfc),
shn as (select *, count(*) over (partition by i, j) n_shared from sh qualify n_shared >= 2),
al as (select a.i, a.j, a.w, a.y as a, b.y as b, a.n_shared, a.y <> b.y mask_self, sqrt(pow(a.jn0 - b.jn0, 2) + pow(a.jr - b.jr, 2)) d_ref_self, sqrt(pow(a.i1 - b.i1, 2) + pow(a.i2 - b.i2, 2)) d_learned_self,
 sqrt(pow(a.j1 - b.j1, 2) + pow(a.j2 - b.j2, 2)) d_learned_self_j, sqrt(pow(a.in0 - b.jn0, 2) + pow(a.ir - b.jr, 2)) d_ref_cross, sqrt(pow(a.i1 - b.j1, 2) + pow(a.i2 - b.j2, 2)) d_learned_cross
 from shn a join shn b on a.i = b.i and a.j = b.j) """
_DS = ["d_ref_self", "d_learned_self", "d_learned_self_j", "d_ref_cross", "d_learned_cross"]


@query("j20_aligned_pair_distances", ALIGNED + "select i, j, a, b, cast(n_shared as int) n_shared, " + ", ".join(f"round({c}, 6) {c}" for c in _DS) + " from al")
def _(spark, d):
    return rounded(aligned(spark, d).select("i", "j", "a", "b", "n_shared", *_DS), 6)


# --- imputation ------------------------------------------------------------------------------

_TT = ctes("emb", "response") + f""", e as (select emb.*, y, y2 from emb join response using (id)),
tp as (select a.id i, b.id j, {_DIST} d from e a join e b on b.split = 'train' and a.id <> b.id where a.split <> 'train'), k as {_knn(10, 'tp')} """


def tables(spark, d):
    e = emb(spark, d).join(fx(spark, d, "response"), "id")
    return e.filter("split <> 'train'"), e.filter("split = 'train'")


def _nn(spark, d, k=10):
    q, r = tables(spark, d)
    return NB.knn_join(q, r, k), q, r


@query("j24_knn_regress", _TT + "select k.i, round(avg(e.y), 6) pred from k join e on e.id = k.j group by 1")
def _(spark, d):
    nn, _, r = _nn(spark, d)
    return rounded(K.knn_regress(nn, r, "id", "y"), 6)


@query("j25_knn_vote", _TT + ", c as (select k.i, e.evt, count(*) n from k join e on e.id = k.j group by 1, 2) select i, evt as vote from c qualify row_number() over (partition by i order by n desc, evt) = 1")
def _(spark, d):
    nn, _, r = _nn(spark, d)
    return K.knn_vote(nn, r, "id", "evt")


@query("j26_knn_purity", _TT + "select k.i, round(avg(case when e.evt = q.evt then 1.0 else 0.0 end), 6) purity from k join e on e.id = k.j join e q on q.id = k.i group by 1")
def _(spark, d):
    nn, q, r = _nn(spark, d)
    return rounded(K.knn_purity(nn, r, q, "id", "evt"), 6)


@query("j27_nearest_centroid", _E + """, c as (select evt, i, avg(z[i]::double) v from emb, (select unnest(range(1, 65)) i) group by 1, 2), cc as (select evt, list(v order by i) v from c group by 1),
p as (select e.id, cc.evt, list_distance(e.z::double[], cc.v) d from emb e, cc)
select id, evt as centroid, round(d, 6) d from p qualify row_number() over (partition by id order by round (d * d, 9), evt) = 1""")
def _(spark, d):
    e = emb(spark, d)
    return rounded(K.nearest_centroid(e, "id", "z", class_centroids(e, "evt"), "evt", "v"), 6)


@query("j27_nearest_centroid_same_macro", _E + """, c as (select evt, i, avg(z[i]::double) v from emb, (select unnest(range(1, 65)) i) group by 1, 2), cc as (select evt, list(v order by i) v from c group by 1),
p as (select e.id, cc.evt, list_distance(e.z::double[], cc.v) d from emb e join cc on (e.pcol < 12) = (cc.evt < 5))
select id, evt as centroid, round(d, 6) d from p qualify row_number() over (partition by id order by round (d * d, 9), evt) = 1""")
def _(spark, d):
    e = emb(spark, d)
    cents = class_centroids(e, "evt").withColumn("macro", F.col("evt") < 5)
    return rounded(K.nearest_centroid(e.withColumn("macro", F.col("pcol") < 12), "id", "z", cents, "evt", "v", "macro"), 6)


_NOISE = _ALL + """, l as (select id, case when prow % 3 = 0 then 0 else evt + 1 end lab from emb),
n as (select i, j from ap join l a on a.id = i and a.lab = 0 join l b on b.id = j and b.lab <> 0 qualify row_number() over (partition by i order by d, j) = 1)
select l.id, l.lab, coalesce(b.lab, l.lab) as label_filled from l left join n on n.i = l.id left join l b on b.id = n.j"""


def _noisy(spark, d):
    return emb(spark, d).withColumn("lab", F.when(F.col("prow") % 3 == 0, 0).otherwise(F.col("evt") + 1))


@query("j28_noise_to_nearest", _NOISE)
def _(spark, d):
    return K.noise_to_nearest(_noisy(spark, d), "id", "z", "lab").select("id", "lab", "label_filled")


@query("j28_noise_to_nearest_file", _NOISE)
def _(spark, d):
    return K.noise_to_nearest(_noisy(spark, d), "id", "z", "lab", bits=6, ref_block=128, query_block=128).select("id", "lab", "label_filled")


_W2 = ctes("emb", "response") + f""", e as (select emb.*, y, y2 from emb join response using (id)),
pa as (select a.id i, b.id j, {_DIST} d from e a join e b on b.split = 'train' where a.split <> 'train'), ka as {_knn(20, 'pa')},
pb as (select a.id i, b.id j, round (list_distance(a.z[57:64]::double[], b.z[57:64]::double[]), 9) d from e a join e b on b.split = 'train' where a.split <> 'train'), kb as {_knn(20, 'pb')},
ga as (select k.i, k.rk, abs(e.y - q.y) gap from ka k join e on e.id = k.j join e q on q.id = k.i), gb as (select k.i, k.rk, abs(e.y - q.y) gap from kb k join e on e.id = k.j join e q on q.id = k.i) """


def _gap(spark, d):
    q, r = tables(spark, d)
    return K.rank_gaps(NB.knn_join(q, r, 20), r, q, "id", "y")


def _gaps(spark, d):
    a = _gap(spark, d)
    q, r = tables(spark, d)
    ph = F.slice("z", 57, 8)
    b = K.rank_gaps(NB.knn_join(q.withColumn("z", ph), r.withColumn("z", ph), 20), r, q, "id", "y")
    return a, b


@query("w11_per_rank_profile", _W2 + """, a as (select rk, avg(gap) a from ga group by 1), b as (select rk, avg(gap) b from gb group by 1)
select cast(rk as int) as rank, round(a, 6) a, round(b, 6) b, round(b - a, 6) gap, round(100 * (a - b) / b, 5) delta_pct from a join b using (rk)""")
def _(spark, d):
    return rounded(K.per_rank_profile(*_gaps(spark, d)), {"a": 6, "b": 6, "gap": 6, "delta_pct": 5})


@query("w12_cumulative_rank_profile", _W2 + ", m as (select rk, avg(gap) over (partition by i order by rk rows unbounded preceding) m from ga) select cast(rk as int) as rank, round(avg(m), 6) cumulative from m group by 1")
def _(spark, d):
    return rounded(K.cumulative_rank_profile(_gap(spark, d)), 6)


@query("w13_banded_paired_gap", _W2 + """, p as (select i, cast(floor((rk - 1) / 5) + 1 as bigint) band, avg(gb.gap - ga.gap) g, avg(rk) mid from ga join gb using (i, rk) group by 1, 2)
select band, round(avg(mid), 4) mid, round(avg(g), 6) gap, round(stddev_samp(g) / sqrt(count(*)), 6) se, abs(avg(g)) > 2 * stddev_samp(g) / sqrt(count(*)) significant from p group by 1""")
def _(spark, d):
    return rounded(K.banded_paired_gap(*_gaps(spark, d)), {"mid": 4, "gap": 6, "se": 6})


@query("w14_rank_confused", _ALL + f""", k as (select i, j, ei, ej, row_number() over (partition by i order by d, j) rk from ap qualify rk <= 12),
r as (select i, j, (rk - 1) / greatest(count(*) over (partition by i) - 1, 1) rn, (ei + ej) % 3 = 0 c from k) select i, j, round(rn, 6) rank_norm from r where c""")
def _(spark, d):
    e = emb(spark, d)
    lab = e.select("id", "evt")
    p = P.knn_pairs(e, 12).join(lab.withColumnsRenamed({"id": "i", "evt": "ei"}), "i").join(lab.withColumnsRenamed({"id": "j", "evt": "ej"}), "j")
    return rounded(K.rank_confused(p.withColumn("c", (F.col("ei") + F.col("ej")) % 3 == 0), "c").select("i", "j", "rank_norm"), 6)


@query("a46_neighbour_crosstab", _TT + """, p as (select k.i, q.evt q, e.evt y, e.y v from k join e on e.id = k.j join e q on q.id = k.i), t as (select q, y, count(*) n from p group by 1, 2),
b as (select y, sum(n) / (select sum(n) from t) base from t group by 1), g as (select q, cast(sum(n) as bigint) n, sum(case when q = y then n else 0 end) / sum(n) purity from t group by 1),
s as (select q, avg(sd) neighbour_sd from (select i, q, stddev_samp(v) sd from p group by 1, 2) group by 1)
select g.q, n, round(purity, 6) purity, round(base, 6) base, round(purity / base, 6) lift, round(neighbour_sd, 6) neighbour_sd from g left join b on g.q = b.y join s on s.q = g.q""")
def _(spark, d):
    nn, q, r = _nn(spark, d)
    return rounded(K.neighbour_crosstab(nn, r, q, "id", "evt", "y"), 6)


@query("a47_neighbour_event_rate", _TT.replace("y, y2 from", "case when y < 20 then 0 else y end as y, y2 from") + """, f as (select k.i, any_value(q.y) q, avg(case when e.y > 0 then 1.0 else 0.0 end) frac from k join e on e.id = k.j join e q on q.id = k.i group by 1),
ed as (select distinct unnest(quantile_cont(q, [0, 0.2, 0.4, 0.6, 0.8, 1])) x from f where q > 0), en as (select x, row_number() over (order by x) rn, count(*) over () c from ed),
b as (select *, case when q > 0 then 1 + (select count(*) from en where rn > 1 and rn < c and q > x) else 0 end bin from f)
select cast(bin as int) bin, count(*) n, round(avg(q), 6) q_mean, round(avg(frac), 6) frac_mean, round(avg(frac) / (select avg(case when y > 0 then 1.0 else 0.0 end) from e where split = 'train'), 6) lift from b group by 1""")
def _(spark, d):
    q, r = tables(spark, d)
    ev = F.when(F.col("y") < 20, 0.0).otherwise(F.col("y"))
    q, r = q.withColumn("y", ev), r.withColumn("y", ev)
    return rounded(K.neighbour_event_rate(NB.knn_join(q, r, 10), r, q, "id", "y"), 6)


_TUNE = """, m as (select i, rk, avg(e.y) over (partition by i order by rk rows unbounded preceding) pred from {k} k join e on e.id = k.j),
s as (select rk, avg((pred - q.y) * (pred - q.y)) mse, 1 - sum((pred - q.y) * (pred - q.y)) / (var_pop(q.y) * count(*)) r2 from m join e q on q.id = m.i group by 1) """


@query("c10_tune_k", _W2 + _TUNE.format(k="ka") + "select cast(rk as int) k, round(mse, 5) mse, round(r2, 6) r2, rk = (select rk from s order by mse, rk limit 1) best from s")
def _(spark, d):
    q, r = tables(spark, d)
    s = K.score_by_k(NB.knn_join(q, r, 20), r, q, "id", "y")
    best = K.best_k(s, "mse", False).select("k").scalar()
    return rounded(s.withColumn("best", F.col("k") == best), {"mse": 5, "r2": 6})


@query("c10_tune_k_accuracy", _W2 + """, c as (select k.i, kk, e.evt, count(*) n from ka k join (select unnest([1, 5, 10, 20]) kk) on rk <= kk join e on e.id = k.j group by 1, 2, 3),
v as (select i, kk, evt from c qualify row_number() over (partition by i, kk order by n desc, evt) = 1)
select cast(kk as int) k, round(avg(case when v.evt = q.evt then 1.0 else 0.0 end), 6) accuracy from v join e q on q.id = v.i group by 1""")
def _(spark, d):
    q, r = tables(spark, d)
    return rounded(K.accuracy_by_k(NB.knn_join(q, r, 20), r, q, "id", "evt", [1, 5, 10, 20]), 6)


_WS = [0.0, 0.5, 2.0]
_TW = ctes("emb", "response") + """, e as (select emb.*, y from emb join response using (id)), ws as (select unnest([0.0, 0.5, 2.0]) w),
pp as (select w, a.id i, b.id j, round (sqrt(pow(list_distance(a.z[1:48]::double[], b.z[1:48]::double[]), 2) + w * w * pow(list_distance(a.z[57:64]::double[], b.z[57:64]::double[]), 2)), 9) d from e a join e b on b.split = 'train' cross join ws where a.split <> 'train'),
k as (select w, i, j, row_number() over (partition by w, i order by d, j) rk from pp qualify rk <= 10),
m as (select w, i, rk, avg(e.y) over (partition by w, i order by rk rows unbounded preceding) pred from k join e on e.id = k.j) """


@query("c11_tune_wk", _TW + "select w::double w, cast(rk as int) k, round(avg((pred - q.y) * (pred - q.y)), 5) mse from m join e q on q.id = m.i group by 1, 2")
def _(spark, d):
    q, r = tables(spark, d)
    cut = {"t": F.slice("z", 1, 48), "p": F.slice("z", 57, 8)}
    return rounded(K.tune_wk(q.withColumns(cut), r.withColumns(cut), _WS, 10, "id", "t", "p", "y").select("w", "k", "mse"), 5)


@query("j23_baseline_demean_by_neighbours")
def _(spark, d):
    e = emb(spark, d).join(fx(spark, d, "response"), "id")
    out = P.baseline_demean_by_neighbours(e, "id", "z", 64, ["y", "y2"])
    return rounded(out.select("id", "y_demeaned", "y2_demeaned"), 5)


_IP = ctes("emb", "response") + """, e as (select emb.*, y, y2 from emb join response using (id)),
ip as (select a.id i, b.id j, round (list_dot_product(list_transform(a.z[1:8], lambda x: x::double - 0.01), list_transform(b.z[1:8], lambda x: x::double - 0.01)), 9) s from e a join e b on a.id <> b.id),
k as (select i, j, s, row_number() over (partition by i order by s desc, j) rk from ip qualify rk <= 20) """


@query("j23_inner_product_neighbours", _IP + "select i, j, round(s, 6) score, cast(rk as int) as rank from k")
def _(spark, d):
    from ..operators.products import inner_product_join

    e = emb(spark, d).join(fx(spark, d, "response"), "id")
    e = e.withColumn("p", F.transform(F.slice("z", 1, 8), lambda x: x - F.lit(0.01)))
    return rounded(inner_product_join(e, e, 20, qvec="p", rvec="p", band=64, query_block=128), 6)


@query("j23_baseline_demean_given_projection", _IP + "select e.id, round(e.y - b.y, 5) y_demeaned, round(e.y2 - b.y2, 5) y2_demeaned from e join (select i, avg(e.y) y, avg(e.y2) y2 from k join e on e.id = k.j group by 1) b on b.i = e.id")
def _(spark, d):
    import numpy as np

    e = emb(spark, d).join(fx(spark, d, "response"), "id")
    out = P.baseline_demean_by_neighbours(e, "id", "z", 64, ["y", "y2"], projection=(np.full(64, 0.01), np.eye(64)[:, :8]))
    return rounded(out.select("id", "y_demeaned", "y2_demeaned"), 5)


@query("s23_write_embeddings", _E + "select id, prow as pixel_row, pcol as pixel_col, split, evt, round(z[1]::double, 6) z_type_0, round(z[48]::double, 6) z_type_47, round(z[64]::double, 6) z_phase_7 from emb")
def _(spark, d):
    from ..sources.sinks import embedding_rows

    out = embedding_rows(emb(spark, d).withColumnsRenamed({"prow": "row", "pcol": "col"}), {"z_type": (F.slice("z", 1, 48), 48), "z_phase": (F.slice("z", 57, 8), 8)}, ["id", "split", "evt"])
    return rounded(out.select("id", "pixel_row", "pixel_col", "split", "evt", "z_type_0", "z_type_47", "z_phase_7"), 6)

