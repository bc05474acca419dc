"""Source, sink and streaming queries: the tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as T
from ..operators.grid import SpatialWindow
from ..session import scratch_path
from ..sources import manifest as MF
from ..sources import scans as SC
from ..sources import sinks as SK
from ..sources import sketches as KS
from ..sources import stats_store as SS
from ..streaming import streams as ST
from .fixtures import ctes, fx, read
from .q_series import CHANGE
from .registry import R, query, rounded

RC = {"row": "prow", "col": "pcol"}
_SP, _AN = ctes("static_px"), ctes("annual")


def _annual(spark, d):
    return fx(spark, d, "annual").select(F.col("prow").alias("row"), F.col("pcol").alias("col"), "yr", "nir", "red", "change")


@query("s01_scan_static", _SP + "select prow, pcol, round(cast(elevation as float), 2) elevation, evt from static_px where prow >= 40 and prow < 90 and pcol >= 16 and pcol < 70")
def _(spark, d):
    path = scratch_path(spark, "static")
    SK.write_cube(fx(spark, d, "static_px").select("prow", "pcol", "elevation", "evt"), path, tile=32, **RC)
    out = SC.scan_static(spark, path, {"elevation": "continuous", "evt": "categorical"}, SpatialWindow(40, 16, 50, 54), 32, **RC)
    return out.withColumn("elevation", R(F.col("elevation").cast("double"), 2))


def _yearly(spark, d, years):
    base = scratch_path(spark, "yearly")
    a = _annual(spark, d)
    for y in years:
        a.filter(F.col("yr") == y).drop("yr").write.parquet(f"{base}/layer_{y}")
    return base + "/layer_{yyyy}"


@query("s02_scan_annual_per_year", _AN + "select prow as row_, pcol as col_, yr as year_, round(nir, 6) nir from annual where yr in (1996, 1997, 1998)")
def _(spark, d):
    out = SC.scan_annual_per_year(spark, _yearly(spark, d, [1996, 1997, 1998]), [1996, 1997, 1998], ["row", "col", "nir"])
    return rounded(out.select(F.col("row").alias("row_"), F.col("col").alias("col_"), F.col("year").alias("year_"), "nir"), 6)


@query("s03_scan_annual_multiband", _AN + """, k as (select distinct pixel from annual), y as (select unnest([1996, 1997, 1998]) yr)
select k.pixel, cast(y.yr as int) year_, a.change from k cross join y left join annual a on a.pixel = k.pixel and a.yr = y.yr""")
def _(spark, d):
    from ..operators.timeseries import years_to_columns

    wide = years_to_columns(fx(spark, d, "annual"), ["pixel"], "yr", "change", list(range(1995, 2002)), "x")
    wide = wide.withColumnsRenamed({f"x_{1994 + k}": f"b{k}" for k in range(1, 8)})
    out = SC.scan_annual_multiband(wide, ["pixel"], "b", 2, [1996, 1997, 1998], "change")
    return out.withColumnRenamed("year", "year_")


@query("s04_scan_irregular", _AN + "select pixel, yr, cast(case yr when 1996 then 0 when 1999 then 1 else 2 end as int) snapshot, yr as snapshot_year, change from annual where yr in (1996, 1999, 2001)")
def _(spark, d):
    return SC.scan_irregular(fx(spark, d, "annual"), "yr", [1996, 1999, 2001]).select("pixel", "yr", "snapshot", "snapshot_year", "change")


@query("s05_scan_sharded_max", ctes("px") + "select cell, patch_row as yr, round(max(price), 2) price, max(code) code from px group by 1, 2")
def _(spark, d):
    px = fx(spark, d, "px").withColumn("yr", F.col("patch_row"))
    return rounded(SC.scan_sharded_max([px.filter("valid"), px.filter("not valid")], ["cell"], "yr", ["price", "code"]), {"price": 2})


def _catalog(spark, d):
    static = scratch_path(spark, "terrain")
    fx(spark, d, "static_px").select(F.col("prow").alias("row"), F.col("pcol").alias("col"), "elevation", "aoi").write.parquet(static)
    return SC.parse_catalog({
        "window": [1996, 1998],
        "layers": {
            "annual": {"spectral": {"year_range": [1990, 1998], "data": {"nir": _yearly(spark, d, [1996, 1997, 1998])}, "fill": -5.0}},
            "static": {"terrain": {"data": {"elevation": static}, "mask": {"aoi": {"path": static}}}},
        },
    })


@query("s07_scan_catalog", _AN + ", " + _SP[5:] + """, k as (select distinct prow, pcol from annual where yr in (1996, 1997, 1998)), y as (select unnest([1996, 1997, 1998]) yr)
select 'nir' band, count(*) n, round(avg(coalesce(cast(a.nir as float), case when a.yr is null then -5.0 else -5.0 end)), 4) v from k cross join y left join annual a on a.prow = k.prow and a.pcol = k.pcol and a.yr = y.yr
union all select 'elevation', count(*), round(avg(cast(elevation as float)), 4) from static_px union all select 'aoi', count(*), round(avg(aoi), 4) from static_px""")
def _(spark, d):
    t = SC.scan_catalog(spark, _catalog(spark, d))
    rows = [("annual/spectral/data", "nir"), ("static/terrain/data", "elevation"), ("static/terrain/mask", "aoi")]
    out = None
    for p, b in rows:
        r = t[p].agg(F.lit(b).alias("band"), F.count("*").alias("n"), R(F.avg(F.col(b).cast("double")), 4).alias("v"))
        out = r if out is None else out.unionByName(r)
    return out


@query("s08_group_years", """with a as (select cast(min(year(o_orderdate)) as int) lo, cast(max(year(o_orderdate)) as int) hi from orders)
select 'annual' category, cast(y as int) as year_ from (select unnest(range(greatest(lo, 1996), least(hi, 1999) + 1)) y from a) union all select 'irregular', cast(y as int) from (select unnest(range(lo, hi + 1)) y from a)""")
def _(spark, d):
    lo, hi = read(spark, d, "orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    rows = [(c, y) for c in ("annual", "irregular", "static") for y in SC.group_years(SC.GroupSpec(c, "g", "data", (), (), (lo, hi)), (1996, 1999))]
    return spark.createDataFrame(rows, "category string, year_ int")


@query("s09_validate_catalog", "select 'annual/spectral/data' as path, 'nir' as band, cast(y as int) as year_, 'missing input' as problem from (select unnest(range(1999, (select 1 + cast(max(year(o_orderdate)) as int) from orders))) y)")
def _(spark, d):
    hi = read(spark, d, "orders").agg(F.max(F.year("o_orderdate"))).first()[0]
    cat = SC.parse_catalog({"window": [1996, hi], "layers": {"annual": {"spectral": {"year_range": [1996, hi], "data": {"nir": _yearly(spark, d, [1996, 1997, 1998])}}}}})
    return SC.validate_catalog(spark, cat).withColumnRenamed("year", "year_")


def _manifest(spark, d):
    path = scratch_path(spark, "manifest")
    read(spark, d, "part").select(
        (1995 + F.col("p_size") % 7).alias("Yr"), F.when(F.col("p_partkey") % 2 == 0, "int").otherwise("CAT").alias("type"),
        F.concat(F.lit("/store/"), F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".tif")).alias("file_path"),
    ).write.option("header", True).csv(path)
    return path


@query("s10_read_manifest", """select cast(1995 + p_size % 7 as int) as year_, replace(p_name, ' ', '_') || '_' || p_partkey as fid, case when p_partkey % 2 = 0 then 'int' else 'cat' end kind,
 '/store/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.tif' as path from part""")
def _(spark, d):
    return MF.read_manifest(spark, _manifest(spark, d)).withColumnRenamed("year", "year_")


@query("s11_check_consistent_features", "select cast(yr as int) as year_, cast(n as int) n from (select year(o_orderdate) yr, count(distinct o_orderpriority || case when year(o_orderdate) = 1998 and o_orderpriority = '2-HIGH' then 'x' else '' end) n from orders group by 1) where yr = 1998")
def _(spark, d):
    o = read(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority").distinct()
    odd = (F.col("year") == 1998) & (F.col("o_orderpriority") == "2-HIGH")
    m = o.select("year", F.concat("o_orderpriority", F.when(odd, "x").otherwise("")).alias("fid"), F.lit("cat").alias("kind"))
    return MF.check_consistent_features(m).select(F.col("year").alias("year_"), F.size("fids").alias("n"))


@query("s13_read_keyed_csv", "select cast(o_orderkey as string) cn, round(o_totalprice, 2) price from orders")
def _(spark, d):
    path = scratch_path(spark, "keyed")
    read(spark, d, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("cn"), F.col("o_totalprice").alias("price")).write.option("header", True).csv(path)
    return rounded(SC.read_keyed_csv(spark, path, ["cn"], {"price": "double"}), 2)


@query("s14_read_survey", ctes("plots") + "select cn, unitcd, tcc from plots where statecd = 7 and invyr between 1996 and 1999")
def _(spark, d):
    return SC.read_survey(fx(spark, d, "plots"), ["cn", "unitcd", "tcc"], statecd=7, invyr=(1996, 1999))


@query("s15_read_confusion", ctes("confusion") + "select a, b, sum(n) n from confusion group by 1, 2")
def _(spark, d):
    path = scratch_path(spark, "square")
    c = fx(spark, d, "confusion")
    codes = sorted(r[0] for r in read(spark, d, "nation").select("n_nationkey").collect())  # the code list
    wide = c.groupBy(F.col("a").cast("string").alias("code")).agg(*[F.coalesce(F.sum(F.when(F.col("b") == k, F.col("n"))), F.lit(0.0)).alias(str(k)) for k in codes], F.sum("n").alias("Row Totals"))
    total = wide.agg(F.lit("Column Totals").alias("code"), *[F.sum(str(k)).alias(str(k)) for k in codes], F.sum("Row Totals").alias("Row Totals"))
    wide.unionByName(total).write.option("header", True).csv(path)
    return SC.read_confusion(spark, path)


@query("s16_write_cube", _SP + """, t as (select cast(floor(prow / 32) as int) tile_row, cast(floor(pcol / 32) as int) tile_col, elevation from static_px)
select tile_row, tile_col, count(*) n, round(sum(elevation), 3) total from t group by 1, 2""")
def _(spark, d):
    path = SK.variable_path(scratch_path(spark, "cube"), "static", "terrain", "data", "elevation")
    px = fx(spark, d, "static_px").select("prow", "pcol", "elevation")
    SK.write_cube(px.filter("prow % 2 = 0"), path, "overwrite", tile=32, **RC)
    SK.write_cube(px.filter("prow % 2 <> 0"), path, "append", tile=32, **RC)
    return rounded(spark.read.parquet(path).groupBy("tile_row", "tile_col").agg(F.count("*").alias("n"), F.sum("elevation").alias("total")), {"total": 3})


def _tidy(spark, d):
    return T.tidy_stats(T.channel_stats(fx(spark, d, "px"), ["quantity", "price"], probs=[0.5]).select("channel", "n", "mean", "q50"), "px")


_TIDY_SQL = """select channel, round(avg(v), 5) mean, round(quantile_cont(v, 0.5), 5) q50 from (select 'quantity' channel, quantity v from px union all select 'price', price from px) group by 1"""


@query("s17_export_stats_json", ctes("px") + _TIDY_SQL)
def _(spark, d):
    path = scratch_path(spark, "stats-json")
    SS.write_stats_json(_tidy(spark, d), path)
    back = spark.read.schema("feature string, channels map<string, map<string, double>>").json(path)
    ex = back.select(F.explode("channels").alias("channel", "stats"))
    return ex.select("channel", R(F.col("stats")["mean"], 5).alias("mean"), R(F.col("stats")["q50"], 5).alias("q50"))


@query("s17_export_stats_csv", ctes("px") + f", t as ({_TIDY_SQL}) select channel, mean, q50, (select count(distinct code) from px) as n_codes from t")
def _(spark, d):
    path = scratch_path(spark, "stats-csv")
    h = T.class_counts_export(fx(spark, d, "px").withColumnRenamed("code", "px"), ["px"])
    SS.write_stats_csv(_tidy(spark, d), path, ["n", "mean", "q50"], h)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    n = F.size(F.map_keys(F.from_json("histogram", "map<string, bigint>"))).cast("long")
    return back.select("channel", R(F.col("mean").cast("double"), 5).alias("mean"), R(F.col("q50").cast("double"), 5).alias("q50"), n.alias("n_codes"))


@query("s19_compute_policy", ctes("px") + "select 'first' as run, count(*) n from px union all select 'kept', count(*) from px union all select 'again', 2 * count(*) from px")
def _(spark, d):
    path = scratch_path(spark, "policy")
    n = fx(spark, d, "px").agg(F.count("*").alias("n"))
    a = SS.compute_policy(spark, path, lambda: n).select(F.lit("first").alias("run"), "n")
    a = a.unionByName(SS.compute_policy(spark, path, lambda: n.select((F.col("n") * 2).alias("n"))).select(F.lit("kept").alias("run"), "n"))
    other = scratch_path(spark, "policy")
    return a.unionByName(SS.compute_policy(spark, other, lambda: n.select((F.col("n") * 2).alias("n")), "always").select(F.lit("again").alias("run"), "n"))


@query("s21_flatten_sequences", _AN + "select pixel, yr as year_, round(red, 6) red, round(swir1, 6) swir1 from annual qualify count(*) over (partition by pixel) = 7")
def _(spark, d):
    seq = fx(spark, d, "annual").groupBy("pixel").agg(F.array_sort(F.collect_list(F.struct("yr", F.array("red", "swir1").alias("v")))).alias("s")).filter(F.size("s") == 7)
    out = SC.flatten_sequences(seq.withColumn("s", F.transform("s", lambda x: x["v"])), "pixel", "s", ["red", "swir1"], 1995)
    return rounded(out.withColumnRenamed("year", "year_"), 6)


@query("s22_label_crosswalk", "select s_suppkey, code as s_nationkey, case when n_nationkey > 0 then n_name else 'EVT_' || code end as label from (select s_suppkey, s_nationkey + case when s_suppkey % 4 = 0 then 100 else 0 end as code from supplier) left join nation on code = n_nationkey")
def _(spark, d):
    lookup = read(spark, d, "nation").select(F.col("n_nationkey").alias("VALUE"), F.col("n_name").alias("EVT_NAME"))
    # every fourth supplier has a code that the lookup doesn't know
    code = F.col("s_nationkey") + F.when(F.col("s_suppkey") % 4 == 0, 100).otherwise(0)
    return SC.label_crosswalk(read(spark, d, "supplier").select("s_suppkey", code.alias("s_nationkey")), lookup, "s_nationkey")


@query("s24_read_aoi_strata", _SP + "select cell, cast(ysfc - 3 > 0 as int) aoi, evt as strata from static_px")
def _(spark, d):
    return SC.read_aoi_strata(fx(spark, d, "static_px").withColumn("a", F.col("ysfc") - 3), "a", "evt", ["cell"])


@query("s25_layer_metadata", ctes("px") + """select 'price' as "column", 'kind' as "key", 'continuous' as "value" union all select 'price', 'nodata', '-9999' union all select 'code', 'n_rows', cast(count(*) as string) from px""")
def _(spark, d):
    px = fx(spark, d, "px")
    px = SC.layer_metadata(px, "price", kind="continuous", nodata=-9999)
    return SC.metadata_rows(SC.layer_metadata(px, "code", n_rows=px.count()))


@query("udf_score_vectors", ctes("emb") + "select id, round(list_sum(list_transform(z, lambda x: x::double * x::double)), 5) energy from emb")
def _(spark, d):
    import numpy as np
    import pandas as pd

    e = fx(spark, d, "emb").select("id", F.col("z").cast("array<double>").alias("z"))
    out = SC.score_vectors(e, lambda p: pd.DataFrame({"energy": (np.stack(p["z"].to_numpy()) ** 2).sum(1)}), ["z"], "energy double", ["id"])
    return rounded(out, {"energy": 5})


@query("s19_stored_sketches", """with v as (select 'quantity' channel, l_quantity::double v from lineitem union all select 'price', l_extendedprice::double from lineitem)
select channel, count(*) n, round(avg(v), 4) mean, round(stddev_pop(v), 4) sd, min(v) "min", max(v) "max", true as ranks_hold from v group by 1""")
def _(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"), (F.col("l_suppkey") % 3).alias("tile"))
    folder = scratch_path(spark, "sketches")

    def tile(i, scale=1):
        rows = li.filter(F.col("tile") == i).withColumn("quantity", F.col("quantity") * scale)
        return lambda: KS.sketch_parts(rows, ["quantity", "price"])

    KS.stored_stats(spark, folder, {i: tile(i) for i in (0, 1)})
    # later tiles are added; what is stored is not computed again, so the other scale never shows
    stats = KS.stored_stats(spark, folder, {0: tile(0, 100), 1: tile(1, 100), 2: tile(2)})
    # share of rows below and up to each quantile, from the values themselves
    probs = {"q02": 0.02, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q98": 0.98}
    long = T.long_channels(li, ["quantity", "price"]).join(stats.select("channel", *probs), "channel")
    holds = F.lit(True)
    for name, p in probs.items():
        below, upto = F.avg((F.col("value") < F.col(name)).cast("int")), F.avg((F.col("value") <= F.col(name)).cast("int"))
        holds = holds & (below - 2 * KS.RANK_ERROR <= p) & (upto + 2 * KS.RANK_ERROR >= p)
    ranks = long.groupBy("channel").agg(holds.alias("ranks_hold"))
    return rounded(stats.join(ranks, "channel").select("channel", "n", "mean", "sd", "min", "max", "ranks_hold"), {"mean": 4, "sd": 4})


# --- streams ---------------------------------------------------------------------------------


@query("t1_stream_change_state", CHANGE + "select pixel, yr, last_fast_year, cast(cum_events as int) cum_events, ysfc, censored from cs")
def _(spark, d):
    path = scratch_path(spark, "changes")
    fx(spark, d, "annual").select("pixel", "yr", "change").write.parquet(path)
    recs = ST.read_table_stream(spark, path, "*.parquet")
    out = ST.run_to_table(ST.stream_change_state(recs, "pixel", "yr", "change"), "append", "change-state")
    return out.filter(~F.col("late")).drop("late")


@query("t2_stream_channel_moments", """select channel, count(*) n, round(avg(v), 5) mean, round(var_pop(v) * count(*) / 1e3, 4) m2, round(min(v), 5) "min", round(max(v), 5) "max"
from (select 'quantity' channel, l_quantity v from lineitem union all select 'tax', l_tax * 1000 from lineitem) group by 1""")
def _(spark, d):
    li = ST.read_table_stream(spark, d, "lineitem.parquet").select(F.col("l_quantity").alias("quantity"), (F.col("l_tax") * 1000).alias("tax"))
    out = ST.run_to_table(ST.stream_channel_moments(li, ["quantity", "tax"]), "complete", "moments")
    return rounded(out.withColumn("m2", F.col("m2") / 1e3), {"mean": 5, "m2": 4, "min": 5, "max": 5})


@query("t3_stream_class_contingency", "select cast(l_suppkey % 7 as bigint) as cluster, cast(l_linenumber as int) as cls, count(*) n from lineitem group by 1, 2")
def _(spark, d):
    li = ST.read_table_stream(spark, d, "lineitem.parquet").select((F.col("l_suppkey") % 7).alias("c"), "l_linenumber")
    return ST.run_to_table(ST.stream_class_contingency(li, "c", "l_linenumber"), "complete", "contingency")


@query("t4_stream_windowed_metrics", """with e as (select user_id, ts, value, time_bucket(interval '1 day', ts) s from events), m as (select max(ts) - interval '2 hours' wm from e)
select user_id, strftime(s, '%Y-%m-%d') as day, round(max(value), 4) value_max, round(min(value), 4) value_min, round(avg(value), 5) value_mean, count(value) n from e, m where s + interval '1 day' <= wm group by 1, 2""")
def _(spark, d):
    ev = ST.read_table_stream(spark, d, "events.parquet").select("user_id", ST.utc_clock("ts").alias("ts"), "value")
    out = ST.run_to_table(ST.stream_windowed_metrics(ev, "user_id", "ts", "value", "1 day", "2 hours"), "append", "windows")
    return out.select("user_id", F.date_format(ST.wall_clock("window_start"), "yyyy-MM-dd").alias("day"), R("value_max", 4).alias("value_max"), R("value_min", 4).alias("value_min"), R("value_mean", 5).alias("value_mean"), "n")

