"""Survey and stratification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import survey as S
from ..session import cut_lineage
from .fixtures import ctes, fx, read
from .registry import R, query

TCC_EDGES, TCC_LABELS = [10.0, 48.0, 85.0], ["0-10", "11-48", "49-85", "86-100"]
_TCC_SQL = "case when tcc <= 10 then '0-10' when tcc <= 48 then '11-48' when tcc <= 85 then '49-85' else '86-100' end"

# Dalenius-Hodges cuts of the frame's canopy cover, 5 strata, 100 bins.
_DH = """
lim as (select min(tcc) lo, max(tcc) hi from frame),
h as (select greatest(1, least(100, ceil((tcc - lo) / ((hi - lo) / 100)))) bin, count(*) n, min(lo) lo, min(hi) hi
      from frame, lim group by 1),
c as (select bin, lo, hi, sum(sqrt(n)) over (order by bin) run, sum(sqrt(n)) over () total from h),
cuts as (select distinct b from (
   select (select min(lo + (hi - lo) * bin / 100) from c where run >= total * t.k / 5 - 1e-9) b
   from (select unnest([1, 2, 3, 4]) k) t) u where b is not null)
"""
_STRATA = f"""{ctes('frame')}, {_DH},
st as (select f.*, {_TCC_SQL} as tcc_bin, ntile(4) over (order by tcc, cn) as tcc_q,
  1 + (select count(*) from cuts where b <= f.tcc) as tcc_dh from frame f)
"""


def strata_frame(spark, d):
    """The plot frame with fixed, quantile and Dalenius-Hodges strata of canopy cover."""
    frame = cut_lineage(fx(spark, d, "frame"))  # one row per plot, read by every scheme
    frame = S.quantile_bins(frame, "tcc", 4, "cn", "tcc_q")
    cuts = S.dh_breaks(frame, "tcc", 5)
    return frame.withColumn("tcc_bin", S.fixed_bins("tcc", TCC_EDGES, TCC_LABELS)).withColumn(
        "tcc_dh", S.dh_strata("tcc", cuts)
    )


@query("a22_area_weighted_mean", ctes("cond") + """
select plt_cn, round(sum(coalesce(balive, 0) * condprop) / sum(condprop), 6) as balive from cond group by 1""")
def _(spark, d):
    return S.area_weighted_mean(fx(spark, d, "cond"), "plt_cn", "balive", "condprop", "balive").withColumn(
        "balive", R("balive", 6)
    )


@query("a23_conditional_tree_sums", ctes("tree") + """
select plt_cn, round(sum(tpa), 4) tpa_live, round(sum(case when spcd >= 300 then tpa else 0 end), 4) tpa_hardwood,
  round(sum(case when spcd < 300 then tpa else 0 end), 4) tpa_softwood, round(sum(vol * tpa), 4) vol_live
from tree where statuscd = 1 group by 1""")
def _(spark, d):
    out = S.conditional_tree_sums(fx(spark, d, "tree"))
    return out.select("plt_cn", *[R(c, 4).alias(c) for c in out.columns[1:]])


@query("a24_removals", ctes("grm") + """
select plt_cn, round(sum(coalesce(remv, 0) * coalesce(tpa_remv, 0)), 3) removal from grm group by 1""")
def _(spark, d):
    return S.removals(fx(spark, d, "grm")).withColumn("removal", R("removal", 3))


@query("w09_dominant_condition", ctes("cond") + """
select plt_cn, condid, condprop, balive, fortypcd, owner from (
  select *, row_number() over (partition by plt_cn order by condprop desc, condid, fortypcd, owner, balive nulls last) rn
  from cond) where rn = 1""")
def _(spark, d):
    ties = [F.col("condid"), F.col("fortypcd"), F.col("owner"), F.col("balive").asc_nulls_last()]
    return S.dominant_condition(fx(spark, d, "cond"), "plt_cn", "condprop", ties)


@query("j04_semi_join_plots", ctes("plots", "cond") + """
select plt_cn, condid, condprop from cond where plt_cn in (select cn from plots where tcc > 50)""")
def _(spark, d):
    plots = fx(spark, d, "plots").filter("tcc > 50")
    return S.semi_join_plots(fx(spark, d, "cond"), plots, "plt_cn").select("plt_cn", "condid", "condprop")


@query("j05_assemble_frame", ctes("plots", "cond", "tree", "grm") + """,
b as (select plt_cn cn, sum(coalesce(balive, 0) * condprop) / sum(condprop) balive from cond group by 1),
t as (select plt_cn cn, sum(vol * tpa) vol_live from tree where statuscd = 1 group by 1),
g as (select plt_cn cn, sum(coalesce(remv, 0) * coalesce(tpa_remv, 0)) removal from grm group by 1)
select p.cn, p.unitcd, p.tcc, round(b.balive, 6) balive, round(coalesce(t.vol_live, 0), 3) vol_live,
  round(coalesce(g.removal, 0), 3) removal
from plots p join b using (cn) left join t using (cn) left join g using (cn)""")
def _(spark, d):
    plots = fx(spark, d, "plots").select("cn", "unitcd", "tcc")
    bal = S.area_weighted_mean(fx(spark, d, "cond"), "plt_cn", "balive", "condprop", "balive").withColumnRenamed("plt_cn", "cn")
    tree = S.conditional_tree_sums(fx(spark, d, "tree")).select(F.col("plt_cn").alias("cn"), "vol_live")
    rem = S.removals(fx(spark, d, "grm")).withColumnRenamed("plt_cn", "cn")
    out = S.assemble_frame(plots, [bal], [tree, rem], "cn", ["vol_live", "removal"])
    return out.withColumns({"balive": R("balive", 6), "vol_live": R("vol_live", 3), "removal": R("removal", 3)})


@query("p27_fixed_bins", ctes("plots") + f"select cn, tcc, {_TCC_SQL} as tcc_bin from plots")
def _(spark, d):
    return fx(spark, d, "plots").select("cn", "tcc", S.fixed_bins("tcc", TCC_EDGES, TCC_LABELS).alias("tcc_bin"))


@query("p28_class_bins", ctes("static_px") + """
select cell, ysfc, cast(case when ysfc < 2 then 0 when ysfc < 5 then 1 when ysfc < 10 then 2 when ysfc < 21 then 3 end as int) left_bin,
  cast(case when ysfc <= 0 then null when ysfc <= 2 then 0 when ysfc <= 5 then 1 when ysfc <= 10 then 2 when ysfc <= 21 then 3 end as int) right_bin
from static_px""")
def _(spark, d):
    edges = [0, 2, 5, 10, 21]
    return fx(spark, d, "static_px").select(
        "cell", "ysfc", S.class_bins("ysfc", edges).alias("left_bin"), S.class_bins("ysfc", edges, "right").alias("right_bin")
    )


@query("p25_complete_cases", ctes("cond", "plots") + """
select c.plt_cn, c.condid, c.balive, p.tcc from cond c join plots p on c.plt_cn = p.cn
where c.balive is not null and p.prev_plt_cn is not null and p.tcc between 0 and 100""")
def _(spark, d):
    joined = fx(spark, d, "cond").join(fx(spark, d, "plots"), F.col("plt_cn") == F.col("cn"))
    return joined.dropna(subset=["balive", "prev_plt_cn", "tcc"]).filter(F.col("tcc").between(0, 100)).select(
        "plt_cn", "condid", "balive", "tcc"
    )


@query("p26_nodata_tcc", """
select o_orderkey, case when try_cast(case when o_orderstatus = 'F' then 'nodata' else cast(o_custkey % 140 as string) end as double) <= 100
  then cast(o_custkey % 140 as double) end as tcc from orders""")
def _(spark, d):
    text = F.when(F.col("o_orderstatus") == "F", "nodata").otherwise((F.col("o_custkey") % 140).cast("string"))
    return read(spark, d, "orders").select("o_orderkey", S.valid_tcc(text).alias("tcc"))


@query("p31_remeasured_only", ctes("plots") + """
select cn, invyr, prev_plt_cn from plots where invyr between 1996 and 1999 and prev_plt_cn is not null""")
def _(spark, d):
    return S.remeasured_only(fx(spark, d, "plots"), 1996, 1999).select("cn", "invyr", "prev_plt_cn")


@query("w10_quantile_bins", _STRATA + "select cn, tcc, cast(tcc_q as int) tcc_q from st")
def _(spark, d):
    return S.quantile_bins(fx(spark, d, "frame"), "tcc", 4, "cn", "tcc_q").select("cn", "tcc", "tcc_q")


@query("a25_pooled_within", _STRATA + """
select cast(sum(n) as bigint) n, count(*) cells, round(sum(ss) / (sum(n) - count(*)), 4) within_var
from (select count(*) n, var_pop(balive) * count(*) ss from st group by unitcd, tcc_bin)""")
def _(spark, d):
    frame = fx(spark, d, "frame").withColumn("tcc_bin", S.fixed_bins("tcc", TCC_EDGES, TCC_LABELS))
    return S.pooled_within(frame, ["unitcd", "tcc_bin"], "balive").withColumn("within_var", R("within_var", 4))


@query("a26_dh_breaks", f"{ctes('frame')}, {_DH} select round(b, 6) as cut from cuts")
def _(spark, d):
    cuts = S.dh_breaks(cut_lineage(fx(spark, d, "frame")), "tcc", 5)
    return spark.createDataFrame([(round(c, 6),) for c in cuts], "cut double")


@query("a27_dh_strata", _STRATA + "select cn, cast(tcc_dh as int) tcc_dh from st")
def _(spark, d):
    frame = cut_lineage(fx(spark, d, "frame"))
    return frame.select("cn", S.dh_strata("tcc", S.dh_breaks(frame, "tcc", 5)).alias("tcc_dh"))


_POOL = ("select '{m}' scheme, sum(n) n, sum(ss) / (sum(n) - count(*)) v from "
         "(select count(*) n, var_pop(balive) * count(*) ss from st group by unitcd{c})")
_SCHEMES = {"tcc_fixed": "tcc_bin", "tcc_quartile": "tcc_q", "tcc_dh5": "tcc_dh"}


@query("a28_strata_efficiency", _STRATA + ", v as (" + " union all ".join(
    [_POOL.format(m="baseline", c="")] + [_POOL.format(m=m, c=", " + c) for m, c in _SCHEMES.items()]) + """)
select scheme, cast(n as bigint) n, round(v, 4) within_var, round(sqrt(v), 4) within_sd,
  round(100 * v / (select v from v where scheme = 'baseline'), 4) pct_of_baseline,
  round((select v from v where scheme = 'tcc_fixed') / v, 6) re_vs_ref,
  round(n * (select v from v where scheme = 'baseline') / v, 2) ess_unit from v""")
def _(spark, d):
    out = S.strata_efficiency(strata_frame(spark, d), "unitcd", _SCHEMES, "balive", "tcc_fixed")
    digits = {"within_var": 4, "within_sd": 4, "pct_of_baseline": 4, "re_vs_ref": 6, "ess_unit": 2}
    return out.select("scheme", "n", *[R(c, k).alias(c) for c, k in digits.items()])


_UV = ("(select unitcd, sum(ss) / (sum(n) - count(*)) v from (select unitcd, count(*) n, var_pop(balive) * count(*) ss "
       "from st group by unitcd, {c}) group by unitcd)")


@query("a29_per_unit_table", _STRATA + f"""
select t.unitcd, t.n, round(t.vt, 4) var_total, round(t.pp, 4) pct_positive, round(a.v, 4) var_fixed, round(b.v, 4) var_quartile,
  round(a.v / t.vt, 6) fixed_ratio, round(b.v / t.vt, 6) quartile_ratio, case when a.v <= b.v then 'fixed' else 'quartile' end winner
from (select unitcd, count(balive) n, var_samp(balive) vt, 100 * avg(case when balive > 0 then 1.0 else 0.0 end) pp from st group by 1) t
join {_UV.format(c='tcc_bin')} a using (unitcd) join {_UV.format(c='tcc_q')} b using (unitcd)""")
def _(spark, d):
    frame = S.quantile_bins(cut_lineage(fx(spark, d, "frame")), "tcc", 4, "cn", "tcc_q").withColumn(
        "tcc_bin", S.fixed_bins("tcc", TCC_EDGES, TCC_LABELS))
    out = S.per_unit_table(frame, "unitcd", {"fixed": "tcc_bin", "quartile": "tcc_q"}, "balive")
    digits = {"var_total": 4, "pct_positive": 4, "var_fixed": 4, "var_quartile": 4, "fixed_ratio": 6, "quartile_ratio": 6}
    return out.withColumns({c: R(c, k) for c, k in digits.items()})


@query("a30_cell_table", _STRATA + """
select unitcd, tcc_bin, count(*) n, round(avg(balive), 5) mean_y, round(var_samp(balive), 4) var_y, round(stddev_samp(balive), 5) sd_y
from st group by 1, 2""")
def _(spark, d):
    frame = fx(spark, d, "frame").withColumn("tcc_bin", S.fixed_bins("tcc", TCC_EDGES, TCC_LABELS))
    out = S.cell_table(frame, ["unitcd", "tcc_bin"], "balive")
    return out.withColumns({"mean_y": R("mean_y", 5), "var_y": R("var_y", 4), "sd_y": R("sd_y", 5)})


@query("a31_label_response_table", ctes("cond") + """
select fortypcd, count(*) n, round(avg(b), 5) b_mean, round(stddev_samp(b), 5) b_sd, round(quantile_cont(b, 0.75), 5) b_q75,
  round(avg(case when b = 0 then 1.0 else 0.0 end), 6) b_zero, round(avg(condprop), 6) condprop_mean, round(stddev_samp(condprop), 6) condprop_sd,
  round(quantile_cont(condprop, 0.75), 6) condprop_q75, round(avg(case when condprop = 0 then 1.0 else 0.0 end), 6) condprop_zero
from (select fortypcd, coalesce(balive, 0) b, condprop from cond) group by 1""")
def _(spark, d):
    out = S.label_response_table(fx(spark, d, "cond").withColumn("b", F.coalesce("balive", F.lit(0.0))), "fortypcd", ["b", "condprop"])
    return out.select("fortypcd", "n", *[R(c, 6 if c == "b_zero" or c.startswith("cond") else 5).alias(c) for c in out.columns[2:]])


@query("u05_schemes_long", _STRATA + """
select 'fixed' as method, tcc_bin as stratum, round(balive, 6) as value from st
union all select 'quartile', cast(tcc_q as string), round(balive, 6) from st""")
def _(spark, d):
    frame = S.quantile_bins(cut_lineage(fx(spark, d, "frame")), "tcc", 4, "cn", "tcc_q").withColumn(
        "tcc_bin", S.fixed_bins("tcc", TCC_EDGES, TCC_LABELS))
    return S.schemes_long(frame, {"fixed": "tcc_bin", "quartile": "tcc_q"}, "balive").withColumn("value", R("value", 6))


@query("j33_macro_flag", """
select s_suppkey, code as s_nationkey, coalesce(n_regionkey = 2, false) as is_tree
from (select s_suppkey, s_nationkey + case when s_suppkey % 4 = 0 then 100 else 0 end as code from supplier) left join nation on code = n_nationkey""")
def _(spark, d):
    lookup = read(spark, d, "nation").select(
        "n_nationkey", F.when(F.col("n_regionkey") == 2, "Tree").otherwise("Shrub").alias("life_form"))
    code = F.col("s_nationkey") + F.when(F.col("s_suppkey") % 4 == 0, 100).otherwise(0)  # codes that the lookup doesn't know
    return S.macro_flag(read(spark, d, "supplier").select("s_suppkey", code.alias("s_nationkey")), lookup, "s_nationkey", "n_nationkey", "life_form")
