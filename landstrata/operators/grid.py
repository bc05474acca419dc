"""Pixel grids: coordinates, windows, alignment, tiles, splits, neighbourhoods."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import global_rank


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Grid:
    """Affine grid: x = x0 + col*pw, y = y0 + row*ph (ph < 0 for north-up)."""

    x0: float
    y0: float
    pw: float
    ph: float
    height: int
    width: int
    crs: str = ""

    @classmethod
    def from_bounds(cls, left: float, bottom: float, right: float, top: float, res: float, crs: str = "") -> "Grid":
        return cls(left, top, res, -res, int(round((top - bottom) / res)), int(round((right - left) / res)), crs)

    def same_as(self, other: "Grid", tol: float = 1.0) -> bool:
        return (abs(self.pw - other.pw) < 1e-9 and abs(self.ph - other.ph) < 1e-9 and abs(self.x0 - other.x0) <= tol
                and abs(self.y0 - other.y0) <= tol and (self.height, self.width) == (other.height, other.width))


@dataclass(frozen=True)
class SpatialWindow:
    """Half-open rows [row, row+height) and columns [col, col+width)."""

    row: int
    col: int
    height: int
    width: int

    def intersects(self, o: "SpatialWindow") -> bool:
        return self.row < o.row + o.height and o.row < self.row + self.height and self.col < o.col + o.width and o.col < self.col + self.width

    def intersection(self, o: "SpatialWindow") -> "SpatialWindow | None":
        if not self.intersects(o):
            return None
        r, c = max(self.row, o.row), max(self.col, o.col)
        return SpatialWindow(r, c, min(self.row + self.height, o.row + o.height) - r, min(self.col + self.width, o.col + o.width) - c)


@dataclass(frozen=True)
class TemporalWindow:
    """The ``length`` years up to and including ``end_year``."""

    end_year: int
    length: int

    @property
    def start_year(self) -> int:
        return self.end_year - self.length + 1

    def years(self) -> list[int]:
        return list(range(self.start_year, self.end_year + 1))

    def contains(self, year: int) -> bool:
        return self.start_year <= year <= self.end_year

    def overlaps(self, o: "TemporalWindow") -> bool:
        return self.start_year <= o.end_year and o.start_year <= self.end_year

    def shift(self, n: int) -> "TemporalWindow":
        return TemporalWindow(self.end_year + n, self.length)

    def expand(self, n: int) -> "TemporalWindow":
        """Further into the past; the end stays."""
        return TemporalWindow(self.end_year, self.length + n)

    def index_range(self, base_year: int) -> tuple[int, int]:
        return self.start_year - base_year, self.end_year - base_year + 1


def xy_to_pixel(df: DataFrame, x: str, y: str, grid: Grid, row: str = "row", col: str = "col",
                year: str | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """Truncated cell index; points outside the grid (or the years) are dropped."""
    out = df.withColumns({col: ((F.col(x) - grid.x0) / grid.pw).cast("int"), row: ((F.col(y) - grid.y0) / grid.ph).cast("int")})
    out = out.filter(F.col(row).between(0, grid.height - 1) & F.col(col).between(0, grid.width - 1))
    return out.filter(F.col(year).between(*years)) if year and years else out


def pixel_to_xy(df: DataFrame, grid: Grid, row: str = "row", col: str = "col", x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({x: grid.x0 + (F.col(col) + 0.5) * grid.pw, y: grid.y0 + (F.col(row) + 0.5) * grid.ph})


def clip_window(df: DataFrame, w: SpatialWindow, row: str = "row", col: str = "col") -> DataFrame:
    return df.filter((F.col(row) >= w.row) & (F.col(row) < w.row + w.height) & (F.col(col) >= w.col) & (F.col(col) < w.col + w.width))


def year_window(df: DataFrame, w: TemporalWindow, year: str = "year", base_year: int | None = None) -> DataFrame:
    """Rows inside the window, with the 0-based position and optional index from a base year."""
    out = df.filter(F.col(year).between(w.start_year, w.end_year)).withColumn("t", F.col(year) - w.start_year)
    return out.withColumn("year_index", F.col(year) - base_year) if base_year is not None else out


def tiles(row, col, size: int = 256) -> tuple[Column, Column]:
    return F.floor(_c(row) / size), F.floor(_c(col) / size)


def align_to_grid(df: DataFrame, src: Grid, dst: Grid, method: str, values: list[str], row: str = "row", col: str = "col") -> DataFrame:
    """Resample values onto ``dst``; equal grids return the input unchanged.

    nearest, bilinear and cubic push each source cell to the target cells it can touch, so the work is one
    explode of a bounded fan-out and one aggregation by target cell.  average and mode reduce the source
    cells that fall into a target cell.
    """
    if src.same_as(dst, 0.0):
        return df
    sx, sy = src.x0 + (F.col(col) + 0.5) * src.pw, src.y0 + (F.col(row) + 0.5) * src.ph
    # position of the source centre in target cell units, measured between target centres
    px, py = (sx - dst.x0) / dst.pw, (sy - dst.y0) / dst.ph
    inside = F.col("_r").between(0, dst.height - 1) & F.col("_k").between(0, dst.width - 1)
    if method in ("average", "mode"):
        cell = df.withColumns({"_r": F.floor(py).cast("long"), "_k": F.floor(px).cast("long")}).filter(inside)
        if method == "average":
            out = cell.groupBy("_r", "_k").agg(*[F.avg(v).alias(v) for v in values])
        else:
            out = None
            for v in values:
                c = cell.filter(F.col(v).isNotNull()).groupBy("_r", "_k", v).agg(F.count("*").alias("_n"))
                m = c.groupBy("_r", "_k").agg(F.min_by(v, F.struct(-F.col("_n"), F.col(v))).alias(v))
                out = m if out is None else out.join(m, ["_r", "_k"], "full")
        return out.select(F.col("_r").alias(row), F.col("_k").alias(col), *values)
    reach = {"nearest": 0.5, "bilinear": 1.0, "cubic": 2.0}[method]
    # source grid position of each target centre = (target centre - src origin)/src step - 0.5
    fx, fy = abs(src.pw / dst.pw), abs(src.ph / dst.ph)
    spread_x, spread_y = math.ceil(reach * fx) + 1, math.ceil(reach * fy) + 1
    cand = df.withColumns({"_k": F.explode(F.sequence(F.floor(px) - spread_x, F.floor(px) + spread_x))})
    cand = cand.withColumn("_r", F.explode(F.sequence(F.floor(py) - spread_y, F.floor(py) + spread_y))).filter(inside)
    tx = (dst.x0 + (F.col("_k") + 0.5) * dst.pw - src.x0) / src.pw - 0.5
    ty = (dst.y0 + (F.col("_r") + 0.5) * dst.ph - src.y0) / src.ph - 0.5
    dx, dy = tx - F.col(col), ty - F.col(row)
    if method == "nearest":
        # the target centre lies in exactly one source cell
        hit = (F.floor(tx + 0.5) == F.col(col)) & (F.floor(ty + 0.5) == F.col(row))
        return cand.filter(hit).select(F.col("_r").alias(row), F.col("_k").alias(col), *values)
    kernel = _linear_weight if method == "bilinear" else _cubic_weight
    w = kernel(F.abs(dx)) * kernel(F.abs(dy))
    cand = cand.withColumn("_w", w).filter("_w <> 0")
    aggs = []
    for v in values:
        ok = F.col(v).isNotNull()
        aggs.append(F.try_divide(F.sum(F.when(ok, F.col(v) * F.col("_w"))), F.sum(F.when(ok, F.col("_w")))).alias(v))
    return cand.groupBy(F.col("_r").alias(row), F.col("_k").alias(col)).agg(*aggs)


def _linear_weight(d: Column) -> Column:
    return F.greatest(1 - d, F.lit(0.0))


def _cubic_weight(d: Column, a: float = -0.5) -> Column:
    near = (a + 2) * d * d * d - (a + 3) * d * d + 1
    far = a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a
    return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)


def scaffold(spark, row0: int, col0: int, height: int, width: int, row: str = "row", col: str = "col") -> DataFrame:
    """Every cell of a window as rows, generated in parallel."""
    i = F.col("id")
    return spark.range(height * width).select((F.floor(i / width) + row0).alias(row), (i % width + col0).alias(col))


def boundless_window(df: DataFrame, w: SpatialWindow, values: list[str], row: str = "row", col: str = "col") -> DataFrame:
    """A window that may reach beyond the data; cells without data are NULL."""
    cells = scaffold(df.sparkSession, w.row, w.col, w.height, w.width, row, col)
    return cells.join(clip_window(df, w, row, col).select(row, col, *values), [row, col], "left")


def pad_patches(df: DataFrame, ps: int, values: list[str], row: str = "row", col: str = "col", fill: float = 0) -> DataFrame:
    """Every patch that holds data as full ps x ps cells, missing cells filled.

    The cells of a patch are generated from the distinct patch keys, then joined on the cell.
    """
    d = df.withColumns({"patch_row": F.floor(F.col(row) / ps), "patch_col": F.floor(F.col(col) / ps)})
    p = d.select("patch_row", "patch_col").distinct()
    cells = p.withColumn(row, F.explode(F.sequence(F.col("patch_row") * ps, F.col("patch_row") * ps + (ps - 1))))
    cells = cells.withColumn(col, F.explode(F.sequence(F.col("patch_col") * ps, F.col("patch_col") * ps + (ps - 1))))
    out = cells.join(d.select(row, col, *values), [row, col], "left")
    return out.select("patch_row", "patch_col", row, col, *[F.coalesce(F.col(v), F.lit(fill)).alias(v) for v in values])


def split_code(row, col, ps: int = 256, bh: int = 7, bw: int = 7, mask=None) -> Column:
    """1 train, 2 val, 3 test from a checkerboard of blocks of bh x bw patches of ps pixels; masked -> 0."""
    br, bc = F.floor(_c(row) / (ps * bh)), F.floor(_c(col) / (ps * bw))
    a = (F.floor(br / 2) + F.floor(bc / 2)) % 2
    b = (br + bc) % 4
    code = F.when((a == 0) & (b == 0), 3).when((a == 0) & (b == 2), 2).otherwise(1)
    return F.when(~F.coalesce(_c(mask).cast("boolean"), F.lit(False)), 0).otherwise(code) if mask is not None else code


def centre_window(df: DataFrame, side: int, height: int, width: int, row: str = "row", col: str = "col") -> DataFrame:
    """Window of the given side around each pixel, clamped to the grid, with local offsets."""
    half = side // 2
    r0 = F.greatest(F.lit(0), F.least(F.col(row) - half, F.lit(height - side)))
    c0 = F.greatest(F.lit(0), F.least(F.col(col) - half, F.lit(width - side)))
    return df.withColumns({"row0": r0, "col0": c0}).withColumns({"local_row": F.col(row) - F.col("row0"), "local_col": F.col(col) - F.col("col0")})


def aligned_tiles(spark, grid: Grid, region: tuple[float, float, float, float], tile: int, overlap: int = 0,
                  shear: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Tiles of ``tile`` pixels snapped to the grid origin, row-major from the top left."""
    if any(shear):
        raise ValueError("sheared grids are not supported")
    left, bottom, right, top = region
    step = tile - overlap
    c0, c1 = math.floor((left - grid.x0) / grid.pw / step), math.ceil((right - grid.x0) / grid.pw / step)
    r0, r1 = math.floor((top - grid.y0) / grid.ph / step), math.ceil((bottom - grid.y0) / grid.ph / step)
    t = scaffold(spark, r0, c0, r1 - r0, c1 - c0, "tile_row", "tile_col")
    return t.withColumns({
        "tile_id": (F.col("tile_row") - r0) * (c1 - c0) + (F.col("tile_col") - c0),
        "left": grid.x0 + F.col("tile_col") * (step * grid.pw), "top": grid.y0 + F.col("tile_row") * (step * grid.ph),
        "right": grid.x0 + F.col("tile_col") * (step * grid.pw) + tile * grid.pw, "bottom": grid.y0 + F.col("tile_row") * (step * grid.ph) + tile * grid.ph,
    })


def subpixel_patches(df: DataFrame, k_row: int, k_col: int, value: str, row: str = "row", col: str = "col") -> DataFrame:
    """Fine cells gathered under each coarse pixel in row-major order (k_row x k_col at most per group)."""
    d = df.withColumns({"coarse_row": F.floor(F.col(row) / k_row), "coarse_col": F.floor(F.col(col) / k_col)})
    item = F.struct((F.col(row) % k_row).alias("i"), (F.col(col) % k_col).alias("j"), F.col(value).alias("v"))
    return d.groupBy("coarse_row", "coarse_col").agg(F.array_sort(F.collect_list(item)).alias("cells"))


def patch_list(df: DataFrame, ps: int, min_aoi: float, aoi: str, row: str = "row", col: str = "col") -> DataFrame:
    """Patches whose AOI share (of the cells present) reaches the threshold."""
    keys = [F.floor(F.col(row) / ps).alias("patch_row"), F.floor(F.col(col) / ps).alias("patch_col")]
    return df.groupBy(*keys).agg(F.avg((F.col(aoi) > 0).cast("double")).alias("aoi_fraction"), F.count("*").alias("n")).filter(F.col("aoi_fraction") >= min_aoi)


def block_count(patches: DataFrame, bh: int, bw: int) -> DataFrame:
    return patches.agg(F.countDistinct(F.floor(F.col("patch_row") / bh), F.floor(F.col("patch_col") / bw)).alias("n_blocks"))


# neighbourhoods ------------------------------------------------------------------------------


def circle_offsets(radius: float, centre: bool = True) -> list[tuple[int, int]]:
    r = int(math.floor(radius))
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= radius * radius and (centre or i or j)]


def _spread(df: DataFrame, offsets: list[tuple[int, int]], extra: list[Column], row: str, col: str, weights: list[list[float]] | None = None) -> DataFrame:
    """Each cell copied to the targets it is a neighbour of: target = cell - offset."""
    items = []
    for k, (i, j) in enumerate(offsets):
        ws = [F.lit(float(w[k])).alias(f"w{n}") for n, w in enumerate(weights or [])]
        items.append(F.struct((F.col(row) - i).alias("_r"), (F.col(col) - j).alias("_k"), *ws))
    return df.select(*extra, F.explode(F.array(*items)).alias("_t")).select("*", "_t.*").drop("_t")


def focal(df: DataFrame, value: str, radius: float, stats: list[str], row: str = "row", col: str = "col") -> DataFrame:
    """Circle-kernel statistics around every cell that holds data; missing neighbours are skipped.

    mean, sum, count, variance (population) and tpi: a circle is a stack of 2r+1 row segments.  Every grid
    row gets running sums once (one sort per row), a segment is the difference of two of them, and only the
    2r+1 segment sums of a column are shuffled to their target row.  entropy counts values and needs the
    cell-wise fan-out.
    """
    d = df.filter(F.col(value).isNotNull()).select(F.col(row).cast("long").alias(row), F.col(col).cast("long").alias(col), F.col(value).cast("double").alias("v"))
    out = None
    if set(stats) & {"mean", "sum", "variance", "tpi", "count"}:
        r = int(math.floor(radius))
        half = {i: int(math.floor(math.sqrt(radius * radius - i * i))) for i in range(-r, r + 1)}
        # centring keeps sums of squares accurate
        base = d.withColumn("_mu", d.agg(F.avg("v")).scalar()).withColumn("u", F.col("v") - F.col("_mu"))
        # a target column must exist in the neighbouring rows even where they hold no data
        slots = base.select(F.explode(F.array(*[F.col(row) + i for i in range(-r, r + 1)])).alias(row), col)
        dense = base.select(row, col, "u").unionByName(slots.withColumn("u", F.lit(None).cast("double"))).groupBy(row, col).agg(F.max("u").alias("u"))
        w = Window.partitionBy(row).orderBy(col)

        def upto(x: Column, end: int) -> Column:
            return F.coalesce(F.sum(x).over(w.rangeBetween(Window.unboundedPreceding, end)), F.lit(0.0))

        terms = {"s": F.col("u"), "q": F.col("u") * F.col("u"), "c": F.col("u").isNotNull().cast("double")}
        seg = dense.withColumns({f"{n}{h}": upto(x, h) - upto(x, -h - 1) for h in set(half.values()) for n, x in terms.items()})
        items = F.explode(F.array(*[
            F.struct((F.col(row) - i).alias("_r"), *[F.col(f"{n}{h}").alias(n) for n in terms]) for i, h in half.items()]))
        tot = seg.select(col, items.alias("t")).select(col, F.col("t._r").alias(row), "t.s", "t.q", "t.c").groupBy(row, col).agg(
            *[F.sum(n).alias(n) for n in terms])
        j = base.join(tot, [row, col])
        mean = F.col("s") / F.col("c")
        cols = {
            "mean": mean + F.col("_mu"), "sum": F.col("s") + F.col("c") * F.col("_mu"), "count": F.col("c"),
            "variance": F.greatest(F.col("q") / F.col("c") - mean * mean, F.lit(0.0)), "tpi": F.col("v") - (mean + F.col("_mu")),
        }
        out = j.select(row, col, *[cols[s].alias(f"{value}_{s}") for s in stats if s in cols])
    if "entropy" in stats:
        hit = _spread(d, circle_offsets(radius), [F.col("v")], row, col)
        c = hit.groupBy("_r", "_k", "v").agg(F.count("*").alias("n"))
        e = c.groupBy(F.col("_r").alias(row), F.col("_k").alias(col)).agg(
            (F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias(f"{value}_entropy"))
        e = e.join(d.select(row, col), [row, col], "left_semi")
        out = e if out is None else out.join(e, [row, col])
    return out


def lacunarity(df: DataFrame, value: str, radius: float, row: str = "row", col: str = "col") -> DataFrame:
    """Kernel variance of the kernel sums over the squared kernel mean, plus 1."""
    first = focal(df, value, radius, ["sum", "mean"], row, col)
    var = focal(first.select(row, col, F.col(f"{value}_sum").alias("_s")), "_s", radius, ["variance"], row, col)
    m = F.col(f"{value}_mean")
    return first.join(var, [row, col]).select(row, col, (F.try_divide(F.col("_s_variance"), m * m) + 1).alias(f"{value}_lacunarity"))


# 3x3 Sobel kernels, row-major from the top left.
_SOBEL_X = (-1, 0, 1, -2, 0, 2, -1, 0, 1)
_SOBEL_Y = (-1, -2, -1, 0, 0, 0, 1, 2, 1)


def sobel(df: DataFrame, value: str, height: int, width: int, row: str = "row", col: str = "col") -> DataFrame:
    """Absolute Sobel response at 0, 45, 90 and 135 degrees with reflected edges.

    Reflection adds the mirrored border cells first; then nine weighted contributions per cell are summed.
    """
    d = df.select(F.col(row).cast("long").alias(row), F.col(col).cast("long").alias(col), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))

    def mirrored(axis: str, n: int, x: DataFrame) -> DataFrame:
        # the edge cell is repeated once outside the grid
        copies = F.filter(F.array(F.col(axis), F.when(F.col(axis) == 0, F.lit(-1).cast("long")),
                                  F.when(F.col(axis) == n - 1, F.lit(n).cast("long"))), lambda a: a.isNotNull())
        return x.withColumn(axis, F.explode(copies))

    d = mirrored(col, width, mirrored(row, height, d))
    offsets = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    hit = _spread(d, offsets, [F.col("v")], row, col, [_SOBEL_X, _SOBEL_Y])
    g = hit.groupBy("_r", "_k").agg(F.sum(F.col("v") * F.col("w0")).alias("gx"), F.sum(F.col("v") * F.col("w1")).alias("gy"))
    g = g.filter(F.col("_r").between(0, height - 1) & F.col("_k").between(0, width - 1))
    s2 = math.sqrt(2)
    return g.select(
        F.col("_r").alias(row), F.col("_k").alias(col), F.abs("gx").alias("sobel_0"), F.abs((F.col("gx") + F.col("gy")) / s2).alias("sobel_45"),
        F.abs("gy").alias("sobel_90"), F.abs((F.col("gx") - F.col("gy")) / s2).alias("sobel_135"))


def slope_aspect(df: DataFrame, dem: str, cell: float, row: str = "row", col: str = "col") -> DataFrame:
    """Slope and aspect (radians, aspect clockwise from north) by Horn's eight-neighbour differences.

    Cells without all eight neighbours are dropped.
    """
    d = df.filter(F.col(dem).isNotNull()).select(F.col(row).cast("long").alias(row), F.col(col).cast("long").alias(col), F.col(dem).cast("double").alias("v"))
    offsets = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    hit = _spread(d, offsets, [F.col("v")], row, col, [_SOBEL_X, _SOBEL_Y])
    g = hit.groupBy(F.col("_r").alias(row), F.col("_k").alias(col)).agg(
        (F.sum(F.col("v") * F.col("w0")) / (8 * cell)).alias("gx"), (F.sum(F.col("v") * F.col("w1")) / (8 * cell)).alias("gy"), F.count("*").alias("n")).filter("n = 9")
    slope = F.atan(F.hypot("gx", "gy"))
    # rows grow southwards: downslope direction is (-gx, +gy) in (east, north)
    aspect = F.pmod(F.atan2(-F.col("gx"), F.col("gy")), F.lit(2 * math.pi))
    return g.select(row, col, slope.alias("slope"), aspect.alias("aspect"))


def terrain(slope_deg, aspect_deg, flow_area, cell: float, eps: float = 1e-3, min_tan: float = 1e-3) -> dict[str, Column]:
    """Northness, eastness and topographic wetness from slope, aspect (degrees) and upstream area."""
    a = F.radians(_c(aspect_deg))
    tan = F.greatest(F.tan(F.greatest(F.radians(_c(slope_deg)), F.lit(eps))), F.lit(min_tan))
    return {"northness": F.cos(a), "eastness": F.sin(a), "twi": F.ln(_c(flow_area) / cell / tan)}


def bundle_windows(df: DataFrame, end_years: dict[str, int], length: int, year: str = "year", anchor: int | None = None) -> DataFrame:
    """For each labelled end year the trailing window of rows; a row joins every window that holds its year."""
    items = [
        F.when(F.col(year).between(e - length + 1, e),
               F.struct(F.lit(k).alias("label"), F.lit(e).alias("end_year"), (F.col(year) - (e - length + 1)).alias("t"),
                        (F.col(year) == (anchor if anchor is not None else e)).cast("int").alias("anchor")))
        for k, e in end_years.items()
    ]
    out = df.withColumn("_w", F.explode(F.filter(F.array(*items), lambda w: w.isNotNull())))
    return out.select("*", "_w.*").drop("_w")


def dense_bands(df: DataFrame, shard: str, band: str, out: str = "band_no") -> DataFrame:
    """Consecutive 1-based numbers over (shard, band); the distinct pairs are ranked apart and joined back."""
    ranked = global_rank(df.select(shard, band).distinct(), [F.col(shard), F.col(band)], out)
    return df.join(ranked.withColumn(out, F.col(out).cast("int")), [shard, band])
