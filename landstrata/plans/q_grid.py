"""Grid, neighbourhood, point and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import places as P
from ..operators import sample as N
from ..operators import stats as T
from .fixtures import ctes, fx, read
from .registry import R, query, rounded
from .q_series import CHANGE, change

RC = {"row": "prow", "col": "pcol"}
_SP = ctes("static_px")

# --- coordinates and windows -----------------------------------------------------------------


@query("p01_xy_to_pixel", """
select o_orderkey, cast(trunc((o_totalprice - 1000) / 3000) as int) as col, cast(trunc((o_custkey * 1.0 - 100000) / -30) as int) as row_ from orders
where trunc((o_totalprice - 1000) / 3000) between 0 and 149 and trunc((o_custkey * 1.0 - 100000) / -30) between 0 and 9999 and year(o_orderdate) between 1995 and 1998""")
def _(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"), F.year("o_orderdate").alias("yr"))
    g = G.Grid(1000.0, 100000.0, 3000.0, -30.0, 10000, 150)
    return G.xy_to_pixel(o, "x", "y", g, year="yr", years=(1995, 1998)).select("o_orderkey", "col", F.col("row").alias("row_"))


@query("p02_pixel_to_xy", _SP + "select cell, round(1000 + (pcol + 0.5) * 30, 3) x, round(5000 - (prow + 0.5) * 30, 3) y from static_px")
def _(spark, d):
    return rounded(G.pixel_to_xy(fx(spark, d, "static_px"), G.Grid(1000.0, 5000.0, 30.0, -30.0, 0, 0), **RC).select("cell", "x", "y"), 3)


@query("p03_clip_window", _SP + "select cell, prow, pcol from static_px where prow >= 10 and prow < 60 and pcol >= 20 and pcol < 90")
def _(spark, d):
    w = G.SpatialWindow(0, 20, 60, 100).intersection(G.SpatialWindow(10, 0, 200, 90))
    return G.clip_window(fx(spark, d, "static_px"), w, **RC).select("cell", "prow", "pcol")


@query("p04_year_window", ctes("annual") + "select pixel, yr, yr - 1996 as t, yr - 1985 as year_index from annual where yr between 1996 and 1999")
def _(spark, d):
    w = G.TemporalWindow(1998, 2).shift(1).expand(2)
    return G.year_window(fx(spark, d, "annual"), w, "yr", 1985).select("pixel", "yr", "t", "year_index")


# --- alignment: source cells are unit squares, target cells 1.5 wide -------------------------

_DST = G.Grid(0.0, 0.0, 1.5, 1.5, 10**7, 86)
_SRC = G.Grid(0.0, 0.0, 1.0, 1.0, 10**7, 128)
_TGT = _SP + """, tr as (select unnest(range(0, (select cast(max(prow) as bigint) + 3 from static_px))) r), tc as (select unnest(range(0, 86)) c),
t as (select r, c, (r + 0.5) * 1.5 - 0.5 ty, (c + 0.5) * 1.5 - 0.5 tx from tr, tc) """


def _align(name, method, sql, cols):
    @query(name, sql)
    def _(spark, d):
        out = G.align_to_grid(fx(spark, d, "static_px"), _SRC, _DST, method, cols, **RC)
        return rounded(out.select(F.col("prow").alias("r"), F.col("pcol").alias("c"), *cols), 5, *[c for c in cols if c == "elevation"])


_align("p05_align_nearest", "nearest", _TGT + """
select r, c, round(elevation, 5) elevation, evt from t join static_px s on s.prow = floor(ty + 0.5) and s.pcol = floor(tx + 0.5)""", ["elevation", "evt"])
_align("p05_align_average", "average", _SP + """
select cast(floor((prow + 0.5) / 1.5) as bigint) r, cast(floor((pcol + 0.5) / 1.5) as bigint) c, round(avg(elevation), 5) elevation from static_px group by 1, 2""", ["elevation"])
_align("p05_align_mode", "mode", _SP + """, k as (select cast(floor((prow + 0.5) / 1.5) as bigint) r, cast(floor((pcol + 0.5) / 1.5) as bigint) c, evt, count(*) n from static_px group by 1, 2, 3)
select r, c, evt from (select *, row_number() over (partition by r, c order by n desc, evt) rn from k) where rn = 1""", ["evt"])
_W = "greatest(1 - abs({t} - s.{c}), 0)"
_align("p05_align_bilinear", "bilinear", _TGT + """, o as (select a.v dr, b.v dc from (select unnest([0, 1]) v) a, (select unnest([0, 1]) v) b),
j as (select r, c, elevation e, greatest(1 - abs(ty - prow), 0) * greatest(1 - abs(tx - pcol), 0) w
 from t cross join o join static_px s on s.prow = floor(ty) + dr and s.pcol = floor(tx) + dc)
select r, c, round(sum(e * w) / sum(w), 5) elevation from j where w <> 0 group by 1, 2""", ["elevation"])
_K = "case when {d} <= 1 then 1.5 * {d} * {d} * {d} - 2.5 * {d} * {d} + 1 when {d} < 2 then -0.5 * {d} * {d} * {d} + 2.5 * {d} * {d} - 4 * {d} + 2 else 0 end"
_align("p05_align_cubic", "cubic", _TGT + f""", o as (select a.v dr, b.v dc from (select unnest([-1, 0, 1, 2]) v) a, (select unnest([-1, 0, 1, 2]) v) b),
j as (select r, c, elevation e, ({_K.format(d='abs(ty - prow)')}) * ({_K.format(d='abs(tx - pcol)')}) w
 from t cross join o join static_px s on s.prow = floor(ty) + dr and s.pcol = floor(tx) + dc)
select r, c, round(sum(e * w) / sum(w), 5) elevation from j where w <> 0 group by 1, 2""", ["elevation"])


@query("p06_boundless_window", _SP + """, c as (select r, k from (select unnest(range(-4, 60)) r) a, (select unnest(range(100, 140)) k) b)
select c.r, c.k, round(elevation, 5) elevation from c left join static_px on prow = r and pcol = k""")
def _(spark, d):
    out = G.boundless_window(fx(spark, d, "static_px"), G.SpatialWindow(-4, 100, 64, 40), ["elevation"], **RC)
    return rounded(out.select(F.col("prow").alias("r"), F.col("pcol").alias("k"), "elevation"), 5)


@query("p20_pad_patches", _SP + """, p as (select distinct cast(floor(prow / 50) as bigint) pr, cast(floor(pcol / 50) as bigint) pc from static_px),
c as (select pr, pc, pr * 50 + a.v as r, pc * 50 + b.v as k from p, (select unnest(range(0, 50)) v) a, (select unnest(range(0, 50)) v) b)
select pr, pc, r, k, round(coalesce(elevation, 0), 5) elevation from c left join static_px on prow = r and pcol = k""")
def _(spark, d):
    out = G.pad_patches(fx(spark, d, "static_px"), 50, ["elevation"], **RC)
    return rounded(out.select(F.col("patch_row").alias("pr"), F.col("patch_col").alias("pc"), F.col("prow").alias("r"), F.col("pcol").alias("k"), "elevation"), 5)


@query("p21_split_code", _SP + """, b as (select cell, aoi, cast(floor(prow / 16) as bigint) br, cast(floor(pcol / 16) as bigint) bc from static_px)
select cell, cast(case when aoi = 0 then 0 when (br // 2 + bc // 2) % 2 = 0 and (br + bc) % 4 = 0 then 3 when (br // 2 + bc // 2) % 2 = 0 and (br + bc) % 4 = 2 then 2 else 1 end as int) split from b""")
def _(spark, d):
    return fx(spark, d, "static_px").select("cell", G.split_code("prow", "pcol", 4, 4, 4, "aoi").alias("split"))


@query("p22_centre_window", _SP + """, w as (select cell, prow, pcol, greatest(0, least(prow - 4, 1000 - 9)) row0, greatest(0, least(pcol - 4, 128 - 9)) col0 from static_px)
select cell, row0, col0, prow - row0 as local_row, pcol - col0 as local_col from w""")
def _(spark, d):
    return G.centre_window(fx(spark, d, "static_px"), 9, 1000, 128, **RC).select("cell", "row0", "col0", "local_row", "local_col")


@query("p23_aligned_tiles", """
with b as (select min(o_custkey * 10.0) l, max(o_custkey * 10.0) r, min(o_totalprice) bt, max(o_totalprice) tp from orders),
g as (select floor((l - 15) / 30 / 60) c0, ceil((r - 15) / 30 / 60) c1, floor((tp - 600000) / -30 / 60) r0, ceil((bt - 600000) / -30 / 60) r1 from b),
t as (select unnest(range(cast(r0 as bigint), cast(r1 as bigint))) tr, c0, c1, r0 from g), u as (select tr, unnest(range(cast(c0 as bigint), cast(c1 as bigint))) tc, c0, c1, r0 from t)
select tr as tile_row, tc as tile_col, cast((tr - r0) * (c1 - c0) + (tc - c0) as bigint) tile_id, round(15 + tc * 1800, 3) "left", round(600000 - tr * 1800, 3) top from u""")
def _(spark, d):
    b = read(spark, d, "orders").agg(F.min(F.col("o_custkey") * 10.0), F.min("o_totalprice"), F.max(F.col("o_custkey") * 10.0), F.max("o_totalprice")).first()
    out = G.aligned_tiles(spark, G.Grid(15.0, 600000.0, 30.0, -30.0, 0, 0), tuple(b), 64, 4)
    return rounded(out.select("tile_row", "tile_col", "tile_id", "left", "top"), 3)


@query("p24_subpixel_patches", _SP + """
select cast(floor(prow / 3) as bigint) coarse_row, cast(floor(pcol / 3) as bigint) coarse_col, count(*) n, round(min_by(elevation, prow * 1000 + pcol), 5) first_v, round(max_by(elevation, prow * 1000 + pcol), 5) last_v
from static_px group by 1, 2""")
def _(spark, d):
    out = G.subpixel_patches(fx(spark, d, "static_px"), 3, 3, "elevation", **RC)
    return out.select("coarse_row", "coarse_col", F.size("cells").cast("long").alias("n"), R(F.element_at("cells", 1)["v"], 5).alias("first_v"), R(F.element_at("cells", -1)["v"], 5).alias("last_v"))


@query("a08_patch_list", _SP + """
select cast(floor(prow / 16) as bigint) patch_row, cast(floor(pcol / 16) as bigint) patch_col, round(avg(aoi), 6) aoi_fraction, count(*) n from static_px group by 1, 2 having avg(aoi) >= 0.9""")
def _(spark, d):
    return rounded(G.patch_list(fx(spark, d, "static_px"), 16, 0.9, "aoi", **RC), 6)


@query("a09_block_count", _SP + "select count(distinct (floor(floor(prow / 16) / 2), floor(floor(pcol / 16) / 2))) n_blocks from static_px")
def _(spark, d):
    return G.block_count(G.patch_list(fx(spark, d, "static_px"), 16, 0.0, "aoi", **RC), 2, 2)


# --- neighbourhoods --------------------------------------------------------------------------

_OFF = """, off as (select a.v dr, b.v dc from (select unnest([-2, -1, 0, 1, 2]) v) a, (select unnest([-2, -1, 0, 1, 2]) v) b where a.v * a.v + b.v * b.v <= 4),
nb as (select t.prow, t.pcol, t.elevation v, s.elevation n, s.evt from static_px t cross join off join static_px s on s.prow = t.prow + dr and s.pcol = t.pcol + dc) """


@query("j30_focal", _SP + _OFF + """
select prow, pcol, round(avg(n), 5) elevation_mean, round(sum(n), 4) elevation_sum, round(var_pop(n), 3) elevation_variance, round(max(v) - avg(n), 5) elevation_tpi from nb group by 1, 2""")
def _(spark, d):
    out = G.focal(fx(spark, d, "static_px"), "elevation", 2.0, ["mean", "sum", "variance", "tpi"], **RC)
    return rounded(out, {"elevation_mean": 5, "elevation_sum": 4, "elevation_variance": 3, "elevation_tpi": 5})


@query("j30_focal_entropy", _SP + _OFF + """, c as (select prow, pcol, evt, count(*) n from nb group by 1, 2, 3)
select prow, pcol, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 5) evt_entropy from c group by 1, 2""")
def _(spark, d):
    return rounded(G.focal(fx(spark, d, "static_px"), "evt", 2.0, ["entropy"], **RC), 5)


@query("j30_lacunarity", _SP + _OFF + """, f as (select prow, pcol, sum(n) s, avg(n) m from nb group by 1, 2),
g as (select t.prow, t.pcol, any_value(t.m) m, var_pop(s.s) v from f t cross join off join f s on s.prow = t.prow + dr and s.pcol = t.pcol + dc group by 1, 2)
select prow, pcol, round(v / (m * m) + 1, 4) elevation_lacunarity from g""")
def _(spark, d):
    return rounded(G.lacunarity(fx(spark, d, "static_px"), "elevation", 2.0, **RC), 4)


_SOB = """, off as (select a.v dr, b.v dc, b.v * (2 - abs(a.v)) wx, a.v * (2 - abs(b.v)) wy from (select unnest([-1, 0, 1]) v) a, (select unnest([-1, 0, 1]) v) b),
h as (select max(prow) mr from static_px),
g as (select t.prow, t.pcol, sum(s.elevation * wx) gx, sum(s.elevation * wy) gy from static_px t cross join off cross join h
 join static_px s on s.prow = greatest(0, least(t.prow + dr, mr)) and s.pcol = greatest(0, least(t.pcol + dc, 127)) group by 1, 2) """


@query("j31_sobel", _SP + ", full_rows as (select max(prow) mr from static_px)" + _SOB + """
select prow, pcol, round(abs(gx), 4) sobel_0, round(abs((gx + gy) / sqrt(2)), 4) sobel_45, round(abs(gy), 4) sobel_90, round(abs((gx - gy) / sqrt(2)), 4) sobel_135
from g where prow < (select mr from full_rows) - 1""")
def _(spark, d):
    # the last grid row of the stand-in is ragged; rows that touch it are left out on both sides
    px = fx(spark, d, "static_px")
    h = px.agg(F.max("prow")).first()[0] + 1
    return rounded(G.sobel(px, "elevation", h, 128, **RC).filter(F.col("prow") < h - 2), 4)


@query("j32_terrain", _SP + """
select cell, round(cos(radians(ysfc * 15)), 6) northness, round(sin(radians(ysfc * 15)), 6) eastness,
 round(ln((elevation + 1) * 900 / 30 / greatest(tan(greatest(radians(evt * 5), 1e-3)), 1e-3)), 6) twi from static_px""")
def _(spark, d):
    px = fx(spark, d, "static_px").withColumns({"slope": F.col("evt") * 5.0, "aspect": F.col("ysfc") * 15.0, "area": (F.col("elevation") + 1) * 900})
    return rounded(px.withColumns(G.terrain("slope", "aspect", "area", 30.0)).select("cell", "northness", "eastness", "twi"), 6)


@query("j32_slope_aspect", _SP + _SOB.replace("greatest(0, least(t.prow + dr, mr))", "t.prow + dr").replace("greatest(0, least(t.pcol + dc, 127))", "t.pcol + dc").replace(
    "sum(s.elevation * wy) gy", "sum(s.elevation * wy) gy, count(*) n") + """
select prow, pcol, round(atan(sqrt(gx * gx + gy * gy) / 240), 6) slope, round(case when atan2(-gx, gy) < 0 then atan2(-gx, gy) + 2 * pi() else atan2(-gx, gy) end, 6) aspect from g where n = 9""")
def _(spark, d):
    return rounded(G.slope_aspect(fx(spark, d, "static_px"), "elevation", 30.0, **RC), 6)


@query("j29_bundle_windows", ctes("annual") + """, w as (select * from (values ('t0', 1997), ('t2', 1999), ('t4', 2001)) v(label, end_year))
select pixel, yr, label, end_year, yr - (end_year - 2) as t, cast(yr = end_year as int) anchor from annual join w on yr between end_year - 2 and end_year""")
def _(spark, d):
    return G.bundle_windows(fx(spark, d, "annual"), {"t0": 1997, "t2": 1999, "t4": 2001}, 3, "yr").select("pixel", "yr", "label", "end_year", "t", "anchor")


# --- points ----------------------------------------------------------------------------------


@query("j01_extract_at_points", CHANGE + """, pts as (select p_partkey as id, p_partkey as pixel, cast(1995 + p_size % 7 as int) yr from part)
select pts.id, pts.pixel, pts.yr, cs.ysfc, cs.change from pts left join cs using (pixel, yr)""")
def _(spark, d):
    pts = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pixel"), (1995 + F.col("p_size") % 7).alias("yr"))
    return P.extract_at_points(pts, change(spark, d), ["pixel", "yr"], ["ysfc", "change"]).select("id", "pixel", "yr", "ysfc", "change")


@query("j02_features_at_locations", ctes("annual") + """, pts as (select s_suppkey as pixel from supplier)
select pixel, count(yr) n_years, round(min_by(nir, yr) filter (where yr is not null), 6) first_nir, round(max_by(red, yr), 6) last_red from pts left join annual using (pixel) group by 1""")
def _(spark, d):
    pts = read(spark, d, "supplier").select(F.col("s_suppkey").alias("pixel"))
    out = P.features_at_locations(pts, fx(spark, d, "annual"), ["pixel"], ["nir", "red"], "yr")
    f = F.col("features")
    # min_by in SQL skips rows whose value is missing
    nir = F.filter(F.transform(f, lambda s: s["v"][0]), lambda v: v.isNotNull())
    return out.select("pixel", F.coalesce(F.size(f), F.lit(0)).cast("long").alias("n_years"), R(F.try_element_at(nir, F.lit(1)), 6).alias("first_nir"),
                      R(F.try_element_at(f, F.lit(-1))["v"][1], 6).alias("last_red"))


@query("j03_anchor_index", """
with c as (select l_partkey p, l_suppkey s, min(l_orderkey) i from lineitem group by 1, 2)
select p_partkey, p_size, coalesce(i, -1) as index_ from part left join c on p = p_partkey and s = p_size""")
def _(spark, d):
    a = read(spark, d, "part").select("p_partkey", "p_size", F.col("p_partkey").alias("p"), F.col("p_size").cast("long").alias("s"))
    c = read(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), "l_orderkey")
    return P.anchor_index(a, c, ["p", "s"], "l_orderkey", "index_").select("p_partkey", "p_size", "index_")


_ANCH = _SP + ", anchors as (select * from static_px where aoi = 1 and prow % 8 = 3 and pcol % 8 = 3)"


def anchors(spark, d):
    px = fx(spark, d, "static_px")
    return N.grid_anchors(px, 8, 8, 3, 0, "aoi", **RC)


@query("j15_spatial_knn_pairs", _ANCH + """, off as (select * from (values (-1, 0, 1.0, 1), (0, -1, 1.0, 2), (0, 1, 1.0, 3), (1, 0, 1.0, 4), (-1, -1, sqrt(2), 5), (-1, 1, sqrt(2), 6)) v(dr, dc, d, rk))
select a.cell, s.prow as n_row, s.pcol as n_col, round(off.d, 6) d, cast(rk as int) as rank from anchors a cross join off join static_px s on s.prow = a.prow + dr and s.pcol = a.pcol + dc where s.forest = 1""")
def _(spark, d):
    out = P.spatial_knn_pairs(anchors(spark, d), fx(spark, d, "static_px").filter("forest = 1"), 6, 4.0, "cell", **RC)
    return rounded(out.select("cell", "n_row", "n_col", "d", "rank"), 6)


@query("j16_spatial_negative_pairs", _ANCH + """, p as (select a.cell i, s.cell j, sqrt((a.prow - s.prow) * (a.prow - s.prow) + (a.pcol - s.pcol) * (a.pcol - s.pcol)) d
 from anchors a join static_px s on floor(a.prow / 32) = floor(s.prow / 32) and floor(a.pcol / 32) = floor(s.pcol / 32) where s.forest = 1),
r as (select *, row_number() over (partition by i order by ((j * 48271 + i * 69621 + 7 * 40503) % 2147483647 * 16807) % 2147483647, j) rn from p where d >= 4 and d <= 12)
select i, j, round(d, 6) d from r where rn <= 5""")
def _(spark, d):
    keys = {"br": F.floor(F.col("prow") / 32), "bc": F.floor(F.col("pcol") / 32)}
    a = anchors(spark, d).withColumns(keys)
    v = fx(spark, d, "static_px").filter("forest = 1").withColumns(keys)
    return rounded(P.spatial_negative_pairs(a, v, ["br", "bc"], 4.0, 12.0, 5, "cell", "prow", "pcol", seed=7), 6)


_MIXJ = "((({k}) * 2654435761 + {s} * 40503) % 2147483647 * 48271) % 2147483647"


@query("j17_cross_patch_negatives", _ANCH + f""", a as (select cell, floor(prow / 32) * 100 + floor(pcol / 32) patch from anchors), n as (select patch, count(*) n, row_number() over (order by patch) - 1 p from a group by 1),
ix as (select p, cell, row_number() over (partition by p order by {_MIXJ.format(k='cell', s=3)}, cell) - 1 slot from a join n using (patch)), t as (select (select count(*) from n) np, (select count(*) from a) na),
g as (select np, greatest(1, (20 * na) // (np * (np - 1))) per from t where np >= 2), r as (select unnest(range(0, np * (np - 1) * per)) draw, np, per from g),
q as (select draw, (draw // per) // (np - 1) pi, case when (draw // per) % (np - 1) >= (draw // per) // (np - 1) then (draw // per) % (np - 1) + 1 else (draw // per) % (np - 1) end pj from r)
select x.cell i, y.cell j, q.pi as patch_i, q.pj as patch_j from q join n ni on ni.p = q.pi join n nj on nj.p = q.pj join ix x on x.p = q.pi and x.slot = ({_MIXJ.format(k='draw', s=0)}) % ni.n
 join ix y on y.p = q.pj and y.slot = ({_MIXJ.format(k='draw', s=1)}) % nj.n""")
def _(spark, d):
    a = anchors(spark, d).withColumn("patch", F.floor(F.col("prow") / 32) * 100 + F.floor(F.col("pcol") / 32))
    return P.cross_patch_negatives(a, "patch", "cell", 20, slot_order=N.mixed("cell", 3), draw=lambda s, c: N.mixed(c, s))


@query("j11_radius_pairs_2d", _ANCH + """
select a.cell i, b.cell j, round(sqrt((a.prow - b.prow) * (a.prow - b.prow) + (a.pcol - b.pcol) * (a.pcol - b.pcol)), 6) d from anchors a join anchors b
 on a.cell <> b.cell and abs(a.prow - b.prow) <= 16 and abs(a.pcol - b.pcol) <= 16
where sqrt((a.prow - b.prow) * (a.prow - b.prow) + (a.pcol - b.pcol) * (a.pcol - b.pcol)) >= 9 and sqrt((a.prow - b.prow) * (a.prow - b.prow) + (a.pcol - b.pcol) * (a.pcol - b.pcol)) < 16""")
def _(spark, d):
    return rounded(P.radius_pairs_2d(anchors(spark, d), "cell", "prow", "pcol", 9.0, 16.0), 6)


# --- samples ---------------------------------------------------------------------------------

_MIX = "((({k}) * 2654435761 + {s} * 40503) % 2147483647 * 48271) % 2147483647"


@query("n01_sample_patches", ctes("px") + f""", p as (select distinct patch_row, patch_col from px)
select patch_row, patch_col from p order by {_MIX.format(k='patch_row * 1000 + patch_col', s=42)}, patch_row, patch_col limit 20""")
def _(spark, d):
    p = fx(spark, d, "px").select("patch_row", "patch_col").distinct()
    return N.sample_patches(p, 20, ["patch_row", "patch_col"], order=N.mixed(F.col("patch_row") * 1000 + F.col("patch_col"), 42))


_PK = "patch_row * 1000 + patch_col"


@query("n01_random_windows", ctes("px") + f""", p as (select distinct patch_row, patch_col from px)
select patch_row, patch_col, ({_MIX.format(k=_PK, s=0)}) % 985 as row0, ({_MIX.format(k=_PK, s=1)}) % 49 as col0, cast([1998, 1999, 2000][({_MIX.format(k=_PK, s=2)}) % 3 + 1] as int) end_year from p""")
def _(spark, d):
    p = fx(spark, d, "px").select("patch_row", "patch_col").distinct()
    key = F.col("patch_row") * 1000 + F.col("patch_col")
    return N.random_windows(p, ["patch_row", "patch_col"], 1000, 64, 16, [1998, 1999, 2000], draw=lambda s: N.mixed(key, s))


@query("n02_epoch_sample", f"select o_orderkey from orders order by {_MIX.format(k='o_orderkey', s=3)}, o_orderkey limit (select cast(floor(count(*) * 0.25) as bigint) from orders)")
def _(spark, d):
    o = read(spark, d, "orders").select("o_orderkey")
    return N.epoch_sample(o, ["o_orderkey"], "frac", 0.25, order=N.mixed("o_orderkey", 3))


@query("n02_epoch_full", f"select o_orderkey, row_number() over (order by {_MIX.format(k='o_orderkey', s=3)}, o_orderkey) as position from orders")
def _(spark, d):
    return N.epoch_sample(read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "full", order=N.mixed("o_orderkey", 3))


@query("n03_reservoir", f"""select o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_orderstatus order by {_MIX.format(k='o_orderkey', s=5)}, o_orderkey) rn from orders) where rn <= 100""")
def _(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return N.reservoir(o, 100, ["o_orderkey"], ["o_orderstatus"], order=N.mixed("o_orderkey", 5))


@query("n04_grid_anchors", _SP + """, p as (select *, cast(floor(prow / 16) as bigint) pr, cast(floor(pcol / 16) as bigint) pc from static_px where aoi = 1),
j as (select *, (pr * 7 + pc * 3) % 5 - 2 as jr, (pr * 7 + pc * 3 + 1) % 5 - 2 as jc, prow % 16 lr, pcol % 16 lc from p)
select cell, pr as patch_row, pc as patch_col from j where lr >= 3 + jr and lr < 13 and (lr - 3 - jr) % 4 = 0 and lc >= 3 + jc and lc < 13 and (lc - 3 - jc) % 4 = 0""")
def _(spark, d):
    out = N.grid_anchors(fx(spark, d, "static_px"), 16, 4, 3, 2, "aoi", **RC, jitter_of=lambda a, b, which: (a * 7 + b * 3 + which) % 5)
    return out.select("cell", "patch_row", "patch_col")


_U = f"(({_MIX.format(k='cell', s=9)}) + 0.5) / 2147483647e0"


@query("n05_grid_plus_supplement", _SP + f""", v as (select *, cast(floor(prow / 16) as bigint) pr, cast(floor(pcol / 16) as bigint) pc, forest * (1 + ysfc) w, {_U} u from static_px where aoi = 1),
s as (select *, sum(w) over (partition by pr, pc) tw from v),
r as (select *, row_number() over (partition by pr, pc order by case when tw = 0 then u when w > 0 then -ln(u) / w else 'inf'::double end, cell) rn from s)
select cell, 'supplement' as origin from r where rn <= 10 union all
select cell, 'grid' from v where prow % 16 >= 3 and prow % 16 < 13 and (prow % 16 - 3) % 4 = 0 and pcol % 16 >= 3 and pcol % 16 < 13 and (pcol % 16 - 3) % 4 = 0""")
def _(spark, d):
    px = fx(spark, d, "static_px").withColumn("w", F.col("forest") * (1 + F.col("ysfc")))
    u = (N.mixed("cell", 9) + 0.5) / 2147483647.0
    return N.grid_plus_supplement(px, 16, 4, 3, 0, "aoi", 10, ["cell"], "w", **RC, u=u).select("cell", "origin")


@query("n06_supplement_weights", _SP + """, p as (select *, floor(prow / 16) pr, floor(pcol / 16) pc from static_px)
select cell, round(case when aoi * forest > 0 then 1.0 / sum(case when aoi * forest > 0 then 1 else 0 end) over (partition by pr, pc, evt) else 0 end, 6) weight from p""")
def _(spark, d):
    px = fx(spark, d, "static_px").withColumns({"pr": F.floor(F.col("prow") / 16), "pc": F.floor(F.col("pcol") / 16)})
    return rounded(N.supplement_weights(px, ["pr", "pc"], ["aoi", "forest"], ["evt"]).select("cell", "weight"), 6)


@query("n07_inverse_frequency_weight", _SP + """, p as (select *, floor(prow / 16) pr, floor(pcol / 16) pc, evt in (1, 2, 3) and aoi = 1 ok from static_px)
select cell, round(case when ok then 1.0 / sum(case when ok then 1 else 0 end) over (partition by pr, pc, evt) else 0 end, 6) weight from p""")
def _(spark, d):
    px = fx(spark, d, "static_px").withColumns({"pr": F.floor(F.col("prow") / 16), "pc": F.floor(F.col("pcol") / 16)})
    return rounded(px.select("cell", N.inverse_frequency_weight(px, ["pr", "pc"], "evt", F.col("aoi") == 1, [1, 2, 3]).alias("weight")), 6)


@query("n08_chunk_batches", _SP + f""", c as (select cell, cast(floor(prow / 16) as bigint) cr, row_number() over (partition by floor(prow / 16) order by {_MIX.format(k='cell', s=2)}, cell) rn,
 count(*) over (partition by floor(prow / 16)) n from static_px)
select cell, cr, cast(floor((rn - 1) / 100) as bigint) batch, cast((rn - 1) % 100 as int) as position from c where floor((rn - 1) / 100) < floor(n / 100)""")
def _(spark, d):
    px = fx(spark, d, "static_px").select("cell", F.floor(F.col("prow") / 16).alias("cr"))
    return N.chunk_batches(px, ["cr"], ["cell"], 100, drop_last=True, order=N.mixed("cell", 2))


@query("n08_chunk_batches_replacement", _SP + f""", c as (select cell, cast(floor(prow / 16) as bigint) cr, row_number() over (partition by floor(prow / 16) order by {_MIX.format(k='cell', s=2)}, cell) rn,
 count(*) over (partition by floor(prow / 16)) n from static_px), s as (select cr, n, unnest(range(0, cast(ceil(n / 100) * 100 as bigint))) slot from (select distinct cr, n from c))
select c.cell, c.cr, cast(floor(slot / 100) as bigint) batch, slot % 100 as position from s join c on c.cr = s.cr and c.rn = ({_MIX.format(k='slot', s=4)}) % s.n + 1""")
def _(spark, d):
    px = fx(spark, d, "static_px").select("cell", F.floor(F.col("prow") / 16).alias("cr"))
    return N.chunk_batches(px, ["cr"], ["cell"], 100, replacement=True, order=N.mixed("cell", 2), draw=lambda c: N.mixed(c, 4))


@query("n09_cap_per_batch", ctes("px") + """
select cell, line_no, price from (select *, row_number() over (partition by patch_row, patch_col order by price, cell, line_no, quantity, discount, tax) rn from px) where rn <= 50""")
def _(spark, d):
    px = fx(spark, d, "px")
    return N.cap_per_batch(px, 50, ["cell", "line_no", "quantity", "discount", "tax"], ["patch_row", "patch_col"], order=F.col("price")).select("cell", "line_no", "price")


@query("n10_weighted_bootstrap", """
with w as (select c_custkey k, cast(c_nationkey + 1 as double) w from customer), c as (select k, w, sum(w) over (order by k) hi from w),
t as (select sum(w) tot from w), d as (select i draw, ((i * 7919 + 13) % 100003 + 0.5) / 100003 * tot u from t, (select unnest(range(0, (select count(*) from customer))) i))
select draw, k as c_custkey from d join c on u >= hi - w and u < hi""")
def _(spark, d):
    c = read(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") + 1).alias("w"))
    out = N.weighted_bootstrap(c, ["c_custkey"], "w", c.count(), u=lambda i: ((i * 7919 + 13) % 100003 + 0.5) / 100003)
    return out.select("draw", "c_custkey")


@query("n11_fold_assign", f"select o_orderkey, cast(ntile(5) over (order by {_MIX.format(k='o_orderkey', s=1)}, o_orderkey) as int) fold from orders")
def _(spark, d):
    return N.fold_assign(read(spark, d, "orders").select("o_orderkey"), 5, ["o_orderkey"], order=N.mixed("o_orderkey", 1))


@query("n13_rank_patches", _SP + """
select cast(floor(prow / 16) as bigint) patch_row, cast(floor(pcol / 16) as bigint) patch_col, count_if(aoi = 1 and forest = 1 and ysfc < 10) n from static_px group by 1, 2""")
def _(spark, d):
    return N.rank_patches(fx(spark, d, "static_px"), 16, "ysfc", (F.col("aoi") == 1) & (F.col("forest") == 1), **RC)


@query("n15_distinct_first", ctes("cond") + """
select plt_cn, condid, owner from (select *, row_number() over (partition by plt_cn order by condid, owner, condprop, fortypcd) rn from cond) where rn = 1""")
def _(spark, d):
    return N.distinct_first(fx(spark, d, "cond"), "plt_cn", [F.col("condid"), F.col("owner"), F.col("condprop"), F.col("fortypcd")]).select("plt_cn", "condid", "owner")


@query("n16_spread_channels", ctes("px") + """, l as (select 'quantity' channel, stddev_pop(quantity) sd from px union all select 'price', stddev_pop(price) from px union all select 'discount', stddev_pop(discount) from px
 union all select 'code', stddev_pop(code) from px union all select 'line_no', stddev_pop(line_no) from px),
r as (select *, row_number() over (order by sd, channel) - 1 i, count(*) over () n from l where sd >= 0.1)
select channel, round(sd, 5) sd from r where i in (select floor(q * (n - 1) / 2) from r, (select unnest([0, 1, 2]) q))""")
def _(spark, d):
    st = T.channel_stats(fx(spark, d, "px"), ["quantity", "price", "discount", "code", "line_no"], probs=[])
    return rounded(N.spread_channels(st, 3), 5)


@query("a18_derived_feature_stats", ctes("annual") + """, p as (select *, cast(floor(prow / 8) as bigint) patch from annual), ch as (select patch from (select distinct patch from p) order by ((patch * 2654435761 + 18 * 40503) % 2147483647 * 48271) % 2147483647, patch limit 3),
i as (select * from p where change <> 16 and patch in (select patch from ch)), c as (select *, row_number() over (partition by patch order by pixel, yr) rn from i),
l as (select 'temporal_position' channel, (yr - 1995) / 6.0 as value from c where rn <= 10000 union all select 'yr', yr from c where rn <= 10000), m as (select channel, avg(value) mu from l group by 1)
select channel, count(*) n, round(avg(value), 5) mean, round(var_samp(value), 5) var, round(avg(abs(value - mu)), 5) mad, round(quantile_cont(value, 0.5), 5) q50 from l join m using (channel) group by 1""")
def _(spark, d):
    from ..operators.masks import temporal_position

    a = fx(spark, d, "annual").withColumns({"patch": F.floor(F.col("prow") / 8), "aoi": (F.col("change") != 16).cast("int")})
    s = N.derived_feature_sample(a, 3, 10000, ["patch"], ["pixel", "yr"], "aoi", order=N.mixed("patch", 18), pixel_order=F.col("pixel"))
    out = T.online_stats(s.withColumn("temporal_position", temporal_position("yr", 1995, 7)), ["temporal_position", "yr"])
    return rounded(out.select("channel", "n", "mean", "var", "mad", "q50"), 5)


@query("u06_anchors_union", _ANCH + ", r as (select prow, pcol from static_px where evt = 2) select prow, pcol from anchors union select prow, pcol from r")
def _(spark, d):
    return N.anchors_union(anchors(spark, d), fx(spark, d, "static_px").filter("evt = 2"), cols=["prow", "pcol"])


@query("j22_compact_coords", _ANCH + """, r as (select prow, pcol from static_px where evt = 2), u as (select prow, pcol from anchors union select prow, pcol from r),
i as (select prow, pcol, row_number() over (order by prow, pcol) - 1 as idx from u)
select 'anchor' as list, prow, pcol, idx from anchors join i using (prow, pcol) union all select 'other', prow, pcol, idx from r join i using (prow, pcol)""")
def _(spark, d):
    _, lists = N.compact_coords({"anchor": anchors(spark, d).select("prow", "pcol"), "other": fx(spark, d, "static_px").filter("evt = 2").select("prow", "pcol")}, ["prow", "pcol"])
    return lists["anchor"].withColumn("list", F.lit("anchor")).unionByName(lists["other"].withColumn("list", F.lit("other")))


@query("s06_merge_shards_as_bands", """
with p as (select distinct o_orderstatus shard, o_orderpriority band from orders), r as (select *, dense_rank() over (order by shard, band) band_no from p)
select o_orderstatus, o_orderpriority, cast(band_no as int) band_no, count(*) n from orders join r on shard = o_orderstatus and band = o_orderpriority group by 1, 2, 3""")
def _(spark, d):
    return G.dense_bands(read(spark, d, "orders"), "o_orderstatus", "o_orderpriority").groupBy("o_orderstatus", "o_orderpriority", "band_no").agg(F.count("*").alias("n"))
