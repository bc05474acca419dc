"""Mask, time-series and reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indices as I
from ..operators import masks as M
from ..operators import timeseries as W
from .fixtures import ctes, fx, read
from .registry import R, query, rounded
from .q_scalar import IDX_CTE

K = ["pixel"]

# --- masks -----------------------------------------------------------------------------------


@query("p07_fill_values", ctes("obs") + """
select pixel, day, round(case when nir is null then -1 else nir end, 6) nir_fill, cast(case when qa = 15 then 0 else qa end as int) qa_fill,
 case when fmask = 0 then null else fmask end fmask_na from obs""")
def _(spark, d):
    return fx(spark, d, "obs").select(
        "pixel", "day", R(M.fill_values("nir", "continuous", band_fill=-1.0), 6).alias("nir_fill"),
        M.fill_values("qa", "categorical", nodata=15).alias("qa_fill"), M.fill_values("fmask", "categorical", nodata=0, target="na").alias("fmask_na"))


@query("p08_year_extract", ctes("annual") + "select pixel, round(nir, 6) nir from annual where yr = 1998")
def _(spark, d):
    return rounded(M.year_extract(fx(spark, d, "annual"), K, "yr", "nir", 1998, 1995, 2001), 6)


@query("p09_threshold", ctes("px") + "select cell, line_no, cast(price >= 30000 as int) big, cast(discount <> 0.05 as int) other from px")
def _(spark, d):
    return fx(spark, d, "px").select("cell", "line_no", M.threshold("price", ">=", 30000).alias("big"), M.threshold("discount", "!=", 0.05).alias("other"))


@query("p10_temporal_position", ctes("annual") + "select pixel, yr, round((yr - 1995) / 6.0, 6) p, round(((yr - 1995) - 3.0) / 3.0, 6) c from annual")
def _(spark, d):
    return fx(spark, d, "annual").select("pixel", "yr", R(M.temporal_position("yr", 1995, 7), 6).alias("p"), R(M.temporal_position("yr", 1995, 7, True), 6).alias("c"))


@query("p11_combined_mask", ctes("annual") + "select pixel, yr, change > 0 and nir is not null and red is not null as valid from annual")
def _(spark, d):
    a = fx(spark, d, "annual")
    return a.select("pixel", "yr", M.combined_mask(a.columns, ["change", "not_there"], ["nir", "red"]).alias("valid"))


@query("p12_valid_mask_for_stats", ctes("annual") + "select yr, count_if(change <> 16 and nir is not null and red > 0.1) n_valid, count(*) n from annual group by 1")
def _(spark, d):
    a = fx(spark, d, "annual")
    v = M.valid_mask_for_stats([F.col("change") != 16], [F.col("nir"), F.when(F.col("red") > 0.1, F.ln(F.col("red") - 0.1)).otherwise(F.lit(float("-inf")))])
    return a.groupBy("yr").agg(F.count_if(v).alias("n_valid"), F.count("*").alias("n"))


@query("p13_mask_fill", ctes("px") + "select cell, line_no, round(case when valid then price else 0 end, 2) price from px")
def _(spark, d):
    return fx(spark, d, "px").select("cell", "line_no", R(M.mask_fill("price", "valid"), 2).alias("price"))


@query("p14_halo_filter", ctes("static_px") + "select cell, prow, pcol from static_px where prow % 16 between 3 and 12 and pcol % 16 between 3 and 12")
def _(spark, d):
    return M.halo_filter(fx(spark, d, "static_px"), "prow", "pcol", 16, 3).select("cell", "prow", "pcol")


@query("p15_npa_mask", ctes("annual") + "select pixel, yr, bool_or(change = 16) over (partition by pixel) npa from annual")
def _(spark, d):
    return M.npa_mask(fx(spark, d, "annual"), K, "change").select("pixel", "yr", "npa")


@query("p16_remap_codes", ctes("annual") + "select pixel, yr, cast(change between 1 and 9 as int) fast from annual")
def _(spark, d):
    return fx(spark, d, "annual").select("pixel", "yr", M.remap_codes("change", W.FAST_CODES).alias("fast"))


@query("p17_availability_mask", ctes("annual") + "select yr, bool_and(yr not in (1996, 1999)) available, count(*) n from annual group by 1")
def _(spark, d):
    return fx(spark, d, "annual").groupBy("yr").agg(F.bool_and(M.availability_mask("yr", [1996, 1999])).alias("available"), F.count("*").alias("n"))


@query("p18_range_validity", ctes("static_px") + """
select cell, cast(elevation * 20 - 300 between -200 and 6000 as int) dem_valid, cast(ysfc * 4 between 0 and 80 as int) slope_valid, cast(ysfc * 60 - 600 between -500 and 500 as int) tpi_valid from static_px""")
def _(spark, d):
    px = fx(spark, d, "static_px").withColumns({"dem": F.col("elevation") * 20 - 300, "slope": F.col("ysfc") * 4, "tpi": F.col("ysfc") * 60 - 600})
    return px.withColumns(M.range_validity(["dem", "slope", "tpi"])).select("cell", "dem_valid", "slope_valid", "tpi_valid")


@query("p19_reindex_years", ctes("annual") + """, k as (select distinct pixel from annual), y as (select unnest(range(1994, 2004)) yr)
select k.pixel, cast(y.yr as int) yr, round(a.nir, 6) nir, coalesce(a.change, -1) change from k cross join y left join annual a on a.pixel = k.pixel and a.yr = y.yr""")
def _(spark, d):
    a = fx(spark, d, "annual").select("pixel", "yr", "nir", "change")
    return rounded(M.reindex_years(a, K, "yr", 1994, 2003, {"change": -1}), 6)


@query("p29_append_derived", ctes("annual") + "select pixel, yr, round((yr - 1995) / 6.0, 6) temporal_position, round(nir - red, 6) gap from annual")
def _(spark, d):
    a = fx(spark, d, "annual")
    reg = {"temporal_position": M.temporal_position("yr", 1995, 7), "gap": F.col("nir") - F.col("red"), "unused": F.lit(1)}
    return rounded(M.append_derived(a, reg, ["temporal_position", "gap"]).select("pixel", "yr", "temporal_position", "gap"), 6)


@query("p30_cast_semantic", ctes("static_px") + "select cell, cast(floor(elevation) as int) as i, aoi <> 0 as m, cast(evt as bigint) as w from static_px")
def _(spark, d):
    return fx(spark, d, "static_px").select(
        "cell", M.cast_semantic(F.floor("elevation"), "categorical").alias("i"), M.cast_semantic("aoi", "mask").alias("m"),
        M.cast_semantic("evt", "categorical", "bigint").alias("w"))


# --- windows ---------------------------------------------------------------------------------

CHANGE = ctes("annual") + """, cs0 as (select *, coalesce(last_value(case when change between 1 and 9 then yr end ignore nulls) over
   (partition by pixel order by yr rows between unbounded preceding and current row), 1980) last_fast_year,
  sum(case when change between 1 and 9 then 1 else 0 end) over (partition by pixel order by yr rows between unbounded preceding and current row) cum_events from annual),
cs as (select *, yr - last_fast_year as ysfc, last_fast_year = 1980 as censored from cs0) """


def change(spark, d):
    return W.change_state(fx(spark, d, "annual"), K, "yr", "change")


@query("w01_last_fast_change_year", CHANGE + "select pixel, yr, last_fast_year from cs")
def _(spark, d):
    return change(spark, d).select("pixel", "yr", "last_fast_year")


@query("w02_cumulative_events", CHANGE + "select pixel, yr, cast(cum_events as bigint) cum_events from cs")
def _(spark, d):
    return change(spark, d).select("pixel", "yr", "cum_events")


@query("w03_ysfc", CHANGE + "select pixel, yr, ysfc, censored as ysfc_censored from cs")
def _(spark, d):
    return change(spark, d).select("pixel", "yr", "ysfc", "ysfc_censored")


RUNS = CHANGE + """, r0 as (select *, case when ysfc < lag(ysfc) over (partition by pixel order by yr) then 1 else 0 end f from cs),
r1 as (select *, cast(sum(f) over (partition by pixel order by yr rows unbounded preceding) as bigint) run_id from r0),
runs as (select *, count(*) over (partition by pixel, run_id) run_len from r1) """


@query("w04_ysfc_runs", RUNS + "select pixel, yr, ysfc, run_id, run_len from runs")
def _(spark, d):
    return W.ysfc_runs(change(spark, d), K, "yr").select("pixel", "yr", "ysfc", "run_id", "run_len")


@query("w05_best_step_per_ysfc", RUNS + """
select pixel, ysfc, yr, run_len from (select *, row_number() over (partition by pixel, ysfc order by run_len desc, yr desc) rn from runs) where rn = 1""")
def _(spark, d):
    return W.best_step_per_ysfc(W.ysfc_runs(change(spark, d), K, "yr"), K, "yr").select("pixel", "ysfc", "yr", "run_len")


@query("w06_temporal_delta", ctes("annual") + """, l as (select pixel, yr, nir - lag(nir) over w d, red - lag(red) over w e, change <> 16 and lag(change <> 16) over w m, row_number() over w rn
 from annual window w as (partition by pixel order by yr))
select pixel, yr, round(d, 6) d_nir, round(e, 6) d_red, m as d_ok from l where rn > 1""")
def _(spark, d):
    a = fx(spark, d, "annual").withColumn("ok", F.col("change") != 16)
    return rounded(W.temporal_delta(a, K, "yr", ["nir", "red"], mask="ok").select("pixel", "yr", "d_nir", "d_red", "d_ok"), 6)


@query("w07_demean_by_pixel", ctes("annual") + "select pixel, yr, round(red - avg(red) over (partition by pixel), 6) red_anom from annual")
def _(spark, d):
    return rounded(W.demean_by_pixel(fx(spark, d, "annual"), K, ["red"]).select("pixel", "yr", "red_anom"), 6)


@query("w08_temporal_r2", ctes("annual") + """, a as (select nir * 0.3 as p, red as o, pixel from annual where nir is not null),
m as (select p - avg(p) over (partition by pixel) pa, o - avg(o) over (partition by pixel) oa, o from a)
select round(1 - sum((pa - oa) * (pa - oa)) / sum(oa * oa), 6) temporal_r2, round(avg(oa * oa) / var_pop(o), 6) temporal_share from m""")
def _(spark, d):
    a = fx(spark, d, "annual").select("pixel", (F.col("nir") * 0.3).alias("p"), F.col("red").alias("o"))
    return rounded(W.temporal_r2(a, K, "p", "o"), 6)


# --- grouped series --------------------------------------------------------------------------


@query("a01_temporal_reduce", ctes("annual") + """
select pixel, round(min(nir), 6) nir_min, round(max(nir), 6) nir_max, round(avg(nir), 6) nir_mean, round(median(nir), 6) nir_median,
 round(stddev_pop(nir), 6) nir_std, round(coalesce(sum(nir), 0), 6) nir_sum from annual group by 1""")
def _(spark, d):
    return rounded(W.temporal_reduce(fx(spark, d, "annual"), K, "nir", ["min", "max", "mean", "median", "std", "sum"]), 6)


def indexed(spark, d):
    obs = I.add_indices(fx(spark, d, "obs")).filter(I.clear_land_fmask("fmask"))
    return obs.withColumns({"yr": F.year("ts"), "hydro_year": I.hydro_year("ts"), "season": I.season("ts")})


CLEAR = ctes("obs") + ", " + IDX_CTE + """, c as (select *, year(ts) yr, year(ts) + case when month(ts) >= 10 then 1 else 0 end hydro_year,
  case when month(ts) in (12, 1, 2) then 'winter' when month(ts) in (6, 7, 8) then 'summer' end season from idx where fmask & 63 = 0) """


def _am(i):
    return (f"round(max({i}), 6) {i}_max, cast(min(doy) filter (where {i} = m.{i}_mx) as int) {i}_max_doy, round(min({i}), 6) {i}_min, "
            f"cast(min(doy) filter (where {i} = m.{i}_mn) as int) {i}_min_doy, round(quantile_cont({i}, 0.05), 6) {i}_p05, round(quantile_cont({i}, 0.95), 6) {i}_p95")


@query("a02_hls_annual_metrics", CLEAR + f""", m as (select pixel, yr, max(ndvi) ndvi_mx, min(ndvi) ndvi_mn, max(nbr) nbr_mx, min(nbr) nbr_mn from c group by 1, 2)
select c.pixel, cast(c.yr as int) yr, {_am('ndvi')}, {_am('nbr')} from c join m on c.pixel = m.pixel and c.yr = m.yr group by 1, 2""")
def _(spark, d):
    return rounded(W.index_annual_metrics(indexed(spark, d), ["pixel", "yr"], ["ndvi", "nbr"]), 6)


_SEASON_SQL = """select pixel, cast(hydro_year as int) hydro_year, round(quantile_cont(ndvi, 0.95) filter (where season = 'summer'), 6) ndvi_summer_p95,
 round(max(ndvi) filter (where season = 'winter'), 6) ndvi_winter_max, round(min(nbr), 6) nbr_annual_min,
 round(quantile_cont(nbr, 0.95) filter (where season = 'summer'), 6) nbr_summer_p95, round(avg(ndmi) filter (where season = 'summer'), 6) ndmi_summer_mean,
 round(quantile_cont(evi2, 0.95) filter (where season = 'summer'), 6) evi2_summer_p95, count(ndvi) filter (where season = 'winter') winter_obs_count,
 count(ndvi) filter (where season = 'summer') summer_obs_count,
 round(quantile_cont(ndvi, 0.95) filter (where season = 'summer') - max(ndvi) filter (where season = 'winter'), 6) ndvi_amplitude from c group by 1, 2"""


@query("a03_seasonal_metrics", CLEAR + _SEASON_SQL)
def _(spark, d):
    return rounded(W.seasonal_metrics(indexed(spark, d), ["pixel", "hydro_year"]), 6)


@query("a04_placeholder_rows", CLEAR + """, s as (select pixel, cast(hydro_year as int) hydro_year, min(nbr) nbr_annual_min, count(ndvi) filter (where season = 'summer') n from c group by 1, 2),
k as (select distinct pixel from s), y as (select unnest(range(1994, 2005)) yr)
select k.pixel, cast(y.yr as int) hydro_year, round(nbr_annual_min, 6) nbr_annual_min, n as summer_obs_count from k cross join y left join s on s.pixel = k.pixel and s.hydro_year = y.yr""")
def _(spark, d):
    s = W.seasonal_metrics(indexed(spark, d), ["pixel", "hydro_year"]).select("pixel", "hydro_year", "nbr_annual_min", "summer_obs_count")
    return rounded(W.placeholder_rows(s, ["pixel"], "hydro_year", 1994, 2004), 6)


@query("a05_mosaic_latest", ctes("obs") + """
select pixel, cast(yr as int) yr, round(red, 6) red, round(green, 6) green, qa from (
 select *, year(ts) yr, row_number() over (partition by pixel, year(ts) order by ts desc, qa desc, red desc, green desc) rn from obs) where rn = 1""")
def _(spark, d):
    obs = fx(spark, d, "obs").withColumn("yr", F.year("ts"))
    return rounded(W.mosaic_latest(obs, ["pixel", "yr"], "ts", ["red", "green", "qa"], ["qa", "red", "green"]), 6)


@query("a06_downsample", ctes("static_px") + """
select cast(floor(prow / 4) as bigint) cell_row, cast(floor(pcol / 4) as bigint) cell_col, round(median(elevation), 6) elevation, max(coalesce(aoi, 0)) aoi from static_px group by 1, 2""")
def _(spark, d):
    return rounded(W.downsample(fx(spark, d, "static_px"), "prow", "pcol", 4, ["elevation"], ["aoi"]), {"elevation": 6})


@query("a07_change_histogram", ctes("annual") + """, h as (select yr, change, count(*) n from annual group by 1, 2)
select yr, change, n, change between 1 and 9 as fast, cast(coalesce(sum(case when change between 1 and 9 then n end) over (partition by yr), 0) as bigint) n_fast_year from h""")
def _(spark, d):
    return W.change_histogram(fx(spark, d, "annual"), "yr", "change")


@query("a07_updated_state_histogram", CHANGE + "select yr, count_if(last_fast_year = yr) n_updated, count_if(not censored) n_disturbed from cs group by 1")
def _(spark, d):
    return W.updated_state_histogram(fx(spark, d, "annual"), K, "yr", "change")


@query("c15_phase_summary", CHANGE + """
select pixel, round(avg(red), 6) red_all, round(coalesce(avg(red) filter (where ysfc <= 1), avg(red)), 6) red_low,
 round(coalesce(avg(red) filter (where ysfc >= 5), avg(red)), 6) red_high, round(var_samp(red), 6) red_var from cs group by 1""")
def _(spark, d):
    return rounded(W.phase_summary(change(spark, d), K, "ysfc", ["red"], 1, 5), 6)


# --- reshaping -------------------------------------------------------------------------------


@query("u01_merge_sensors", ctes("obs") + "select sensor, count(*) n, round(sum(red), 3) red from obs where ts is not null group by 1")
def _(spark, d):
    obs = fx(spark, d, "obs")
    merged = W.merge_sensors(obs.filter("sensor = 'L30'"), obs.filter("sensor = 'S30'"))
    return merged.groupBy("sensor").agg(F.count("*").alias("n"), R(F.sum("red"), 3).alias("red"))


@query("u02_harmonise_bands", ctes("obs") + "select pixel, day, sensor, round(nir, 6) nir, round(red, 6) red, round(swir1, 6) swir1 from obs")
def _(spark, d):
    obs = fx(spark, d, "obs")
    l30 = obs.filter("sensor = 'L30'").select("pixel", "day", "sensor", F.col("red").alias("B4"), F.col("nir").alias("B5"), F.col("swir1").alias("B6"))
    s30 = obs.filter("sensor = 'S30'").select("pixel", "day", "sensor", F.col("red").alias("B4"), F.col("nir").alias("B8A"), F.col("swir1").alias("B11"))
    return rounded(W.harmonise_bands(l30.unionByName(s30, allowMissingColumns=True)).select("pixel", "day", "sensor", "nir", "red", "swir1"), 6)


@query("u03_years_to_columns", ctes("annual") + "select pixel, " + ", ".join(f"max(change) filter (where yr = {y}) chg_{y}" for y in range(1995, 2002)) + " from annual group by 1")
def _(spark, d):
    return W.years_to_columns(fx(spark, d, "annual"), K, "yr", "change", list(range(1995, 2002)), "chg/")


@query("u04_stack_features_by_kind", ctes("annual") + """
select pixel, yr, 'continuous' as kind, fid, round(v, 6) as value from (select pixel, yr, 'nir' fid, nir v from annual union all select pixel, yr, 'red', red from annual)
union all select pixel, yr, 'categorical', 'change', change from annual""")
def _(spark, d):
    from ..sources.manifest import stack_features

    return rounded(stack_features(fx(spark, d, "annual"), ["pixel", "yr"], {"red": "continuous", "nir": "continuous", "change": "categorical"}), 6)


@query("u07_discover_years", ctes("annual") + "select distinct yr from annual")
def _(spark, d):
    return W.discover_years(fx(spark, d, "annual"), "yr")


@query("s12_select_years", "select distinct cast(y as int) as yr from (select unnest(range(e - 4, e + 1)) y from (select distinct year(o_orderdate) e from orders))")
def _(spark, d):
    from ..sources.manifest import select_years

    return select_years(read(spark, d, "orders").select(F.year("o_orderdate").alias("end_year")), "end_year", 5, "yr")
