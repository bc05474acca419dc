"""Scans of raster-derived tables: static, annual, irregular and sharded layers, and the catalog above them.

A layer is a Parquet table with one row per cell (``row``, ``col``), as ``write_cube`` leaves it: partitioned
by ``tile_row``/``tile_col`` and sorted inside a file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Grid, SpatialWindow
from ..operators.masks import SEMANTIC_TYPES, YEAR_FILLS, cast_semantic, reindex_years
from .sinks import TILE
from .stats_store import exists

CATEGORIES = ("annual", "irregular", "static")
SUBSECTIONS = ("data", "quality", "mask")
_YEAR = re.compile(r"\{(yyyy|year)\}")


def scan_static(spark: SparkSession, path: str, bands: dict[str, str] | list[str], bounds: SpatialWindow | None = None, tile: int = TILE,
                row: str = "row", col: str = "col") -> DataFrame:
    """Bands cast to their semantic type; bounds become partition filters on tiles plus row/col filters."""
    kinds = bands if isinstance(bands, dict) else {b: None for b in bands}
    df = spark.read.parquet(path)
    if bounds is not None:
        if {"tile_row", "tile_col"} <= set(df.columns):
            df = df.filter(
                F.col("tile_row").between(bounds.row // tile, (bounds.row + bounds.height - 1) // tile)
                & F.col("tile_col").between(bounds.col // tile, (bounds.col + bounds.width - 1) // tile))
        df = df.filter((F.col(row) >= bounds.row) & (F.col(row) < bounds.row + bounds.height) & (F.col(col) >= bounds.col) & (F.col(col) < bounds.col + bounds.width))
    return df.select(row, col, *[(cast_semantic(b, k) if k else F.col(b)).alias(b) for b, k in kinds.items()])


def year_path(pattern: str, year: int) -> str:
    if not _YEAR.search(pattern):
        raise ValueError(f"pattern {pattern!r} needs {{yyyy}} or {{year}}")
    return _YEAR.sub(str(year), pattern)


def scan_annual_per_year(spark: SparkSession, pattern: str, years: list[int], columns: list[str] | None = None, out: str = "year") -> DataFrame:
    """One input per year; a missing one is an error before any data is read."""
    paths = {y: year_path(pattern, y) for y in years}
    missing = [p for p in paths.values() if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing yearly inputs: {missing}")
    parts = [(spark.read.parquet(p).select(*columns) if columns else spark.read.parquet(p)).withColumn(out, F.lit(int(y))) for y, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def scan_annual_multiband(df: DataFrame, key: list[str], prefix: str, band_start: int, years: list[int], value: str = "value", out: str = "year") -> DataFrame:
    """Band columns ``{prefix}{k}`` to rows; band k is year years[0] + (k - band_start)."""
    have = sorted(int(c[len(prefix):]) for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit() and int(c[len(prefix):]) >= band_start)
    if len(have) < len(years):
        raise ValueError(f"{len(have)} bands for {len(years)} years")
    items = F.explode(F.array(*[F.struct(F.lit(int(y)).alias(out), F.col(f"{prefix}{band_start + (y - years[0])}").alias(value)) for y in years]))
    return df.select(*key, items.alias("_b")).select(*key, f"_b.{out}", f"_b.{value}")


def scan_irregular(df: DataFrame, year: str, years: list[int]) -> DataFrame:
    """Listed years only, with the 0-based ``snapshot`` index and ``snapshot_year``."""
    idx = F.array_position(F.array(*[F.lit(int(y)) for y in years]), F.col(year).cast("int")) - 1
    return df.filter(F.col(year).isin(*years)).withColumns({"snapshot": idx.cast("int"), "snapshot_year": F.col(year)})


def scan_sharded_max(shards: list[DataFrame], key: list[str], year: str, values: list[str]) -> DataFrame:
    """Shards of one year mosaicked with the maximum."""
    both = reduce(lambda a, b: a.unionByName(b), [s.select(*key, year, *values) for s in shards])
    return both.groupBy(*key, year).agg(*[F.max(v).alias(v) for v in values])


def read_aoi_strata(df: DataFrame, aoi: str, strata: str, key: list[str]) -> DataFrame:
    """AOI > 0 as 0/1 and strata as integer on the grid."""
    return df.select(*key, F.coalesce((F.col(aoi) > 0).cast("int"), F.lit(0)).alias("aoi"), F.col(strata).cast("int").alias("strata"))


def layer_metadata(df: DataFrame, column: str, **meta) -> DataFrame:
    """Keep id, kind, normalisation, nodata, semantic type and time window with a column."""
    return df.withColumn(column, F.col(column).alias(column, metadata={"layer": meta}))


def metadata_rows(df: DataFrame) -> DataFrame:
    """(column, key, value) rows of all layer metadata."""
    rows = [(f.name, k, str(v)) for f in df.schema.fields for k, v in f.metadata.get("layer", {}).items()]
    return df.sparkSession.createDataFrame(rows, "column string, key string, value string")


# catalog -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class BandSpec:
    name: str
    path: str
    kind: str = "continuous"
    column: str | None = None
    band_start: int = 1
    fill: object = None


@dataclass(frozen=True)
class GroupSpec:
    category: str
    group: str
    subsection: str
    bands: tuple[BandSpec, ...]
    years: tuple[int, ...] = ()
    year_range: tuple[int, int] | None = None
    fill: object = None


@dataclass(frozen=True)
class Catalog:
    groups: tuple[GroupSpec, ...]
    window: tuple[int, int] | None = None
    grid: Grid | None = None
    extras: dict = field(default_factory=dict)


def parse_catalog(cfg: dict) -> Catalog:
    """Nested dictionary category -> group -> subsection -> bands to a checked catalog."""
    groups = []
    for cat, by_group in cfg.get("layers", {}).items():
        if cat not in CATEGORIES:
            raise ValueError(f"unknown category {cat!r}")
        for name, g in by_group.items():
            for sub, bands in ((s, b) for s, b in g.items() if s in SUBSECTIONS):
                default = "mask" if sub == "mask" else "continuous"
                specs = []
                for b, v in bands.items():
                    v = {"path": v} if isinstance(v, str) else dict(v)
                    kind = v.pop("kind", default)
                    if kind not in SEMANTIC_TYPES:
                        raise ValueError(f"unknown kind {kind!r} for {cat}/{name}/{sub}/{b}")
                    specs.append(BandSpec(b, kind=kind, **v))
                rng = g.get("year_range")
                groups.append(GroupSpec(cat, name, sub, tuple(specs), tuple(g.get("years", ())), tuple(rng) if rng else None, g.get("fill")))
            unknown = set(g) - set(SUBSECTIONS) - {"years", "year_range", "fill"}
            if unknown:
                raise ValueError(f"unknown keys {sorted(unknown)} in {cat}/{name}")
    return Catalog(tuple(groups), tuple(cfg["window"]) if cfg.get("window") else None, cfg.get("grid"))


def group_years(spec: GroupSpec, window: tuple[int, int] | None) -> list[int]:
    """Explicit years sorted; a range clipped to the window for annual groups only; static has none."""
    if spec.category == "static":
        return []
    if spec.years:
        return sorted(spec.years)
    if spec.year_range is None:
        return list(range(window[0], window[1] + 1)) if window else []
    lo, hi = spec.year_range
    if spec.category == "annual" and window:
        lo, hi = max(lo, window[0]), min(hi, window[1])
    return list(range(lo, hi + 1))


def band_pattern(band: BandSpec) -> str:
    """per_year (year in the path), multiband (``column`` ends in *), or per_band (one column with a year)."""
    if _YEAR.search(band.path):
        return "per_year"
    return "multiband" if (band.column or "").endswith("*") else "per_band"


def scan_band(spark: SparkSession, spec: GroupSpec, band: BandSpec, window: tuple[int, int] | None, key: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """(key[, year], band) of one band, cast, on its full year axis."""
    years, keys, name = group_years(spec, window), list(key), band.name
    column = band.column or name
    if spec.category == "static":
        return spark.read.parquet(band.path).select(*keys, cast_semantic(column, band.kind).alias(name))
    how = band_pattern(band)
    if how == "per_year":
        df = scan_annual_per_year(spark, band.path, years, [*keys, column]).select(*keys, "year", F.col(column).alias(name))
    elif how == "multiband":
        df = scan_annual_multiband(spark.read.parquet(band.path), keys, column[:-1], band.band_start, years, name)
    else:
        df = spark.read.parquet(band.path).filter(F.col("year").isin(*years)).select(*keys, "year", F.col(column).alias(name))
    df = df.withColumn(name, cast_semantic(name, band.kind))
    if spec.category == "irregular":
        return scan_irregular(df, "year", years)
    lo, hi = (window or (years[0], years[-1]))
    fill = next((f for f in (band.fill, spec.fill, YEAR_FILLS[band.kind]) if f is not None), None)
    return reindex_years(df, keys, "year", lo, hi, {name: fill})


def scan_group(spark: SparkSession, spec: GroupSpec, window: tuple[int, int] | None, key: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """All bands of a group side by side."""
    on = list(key) + ([] if spec.category == "static" else ["year"] if spec.category == "annual" else ["year", "snapshot", "snapshot_year"])
    parts = [scan_band(spark, spec, b, window, key) for b in spec.bands]
    return reduce(lambda a, b: a.join(b, on, "full"), parts)


def scan_catalog(spark: SparkSession, catalog: Catalog, key: tuple[str, ...] = ("row", "col")) -> dict[str, DataFrame]:
    """A lazy DataFrame per category/group/subsection; nothing is read until used."""
    return {f"{g.category}/{g.group}/{g.subsection}": scan_group(spark, g, catalog.window, key) for g in catalog.groups}


def validate_catalog(spark: SparkSession, catalog: Catalog, grids: dict[str, Grid] | None = None, tol: float = 1.0) -> DataFrame:
    """(group, band, year, problem) rows; empty when every input is there and fits."""
    rows = []
    for g in catalog.groups:
        path = f"{g.category}/{g.group}/{g.subsection}"
        years = group_years(g, catalog.window)
        if g.category != "static" and not years:
            rows.append((path, None, None, "no years"))
        for b in g.bands:
            how = band_pattern(b) if g.category != "static" else "per_band"
            if how == "per_year":
                rows += [(path, b.name, y, "missing input") for y in years if not exists(spark, year_path(b.path, y))]
                continue
            if not exists(spark, b.path):
                rows.append((path, b.name, None, "missing input"))
                continue
            cols = spark.read.parquet(b.path).columns
            if how == "multiband":
                prefix = b.column[:-1]
                n = sum(1 for c in cols if c.startswith(prefix) and c[len(prefix):].isdigit() and int(c[len(prefix):]) >= b.band_start)
                if n < len(years):
                    rows.append((path, b.name, None, f"{n} bands for {len(years)} years"))
            elif (b.column or b.name) not in cols:
                rows.append((path, b.name, None, f"no column {b.column or b.name}"))
            if grids and catalog.grid and b.path in grids and not catalog.grid.same_as(grids[b.path], tol):
                rows.append((path, b.name, None, "grid mismatch"))
    return spark.createDataFrame(rows, "path string, band string, year int, problem string")


# other inputs --------------------------------------------------------------------------------


def strip_key(c: Column) -> Column:
    """Control numbers stay text; a trailing .0 from a spreadsheet is dropped."""
    return F.regexp_replace(F.trim(c), r"\.0$", "")


def read_keyed_csv(spark: SparkSession, path: str, keys: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Every column read as text, keys cleaned, the named columns cast."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = df.withColumns({k: strip_key(F.col(k)) for k in keys})
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in (types or {}).items()})


def read_survey(df: DataFrame, columns: list[str], statecd=None, state_col: str = "statecd", evalid=None, evalid_col: str = "evalid",
                invyr: tuple[int, int] | None = None, invyr_col: str = "invyr") -> DataFrame:
    """Columns of a survey table for a state, evaluation or inventory range; the filters reach the scan."""
    if statecd is not None:
        df = df.filter(F.col(state_col) == statecd)
    if evalid is not None:
        df = df.filter(F.col(evalid_col) == evalid)
    if invyr is not None:
        df = df.filter(F.col(invyr_col).between(*invyr))
    return df.select(*columns)


def read_survey_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None) -> DataFrame:
    """A survey table behind JDBC; ``read_survey`` filters are pushed into the database."""
    return spark.read.jdbc(url, table, properties=properties or {})


def read_confusion(spark: SparkSession, path: str, index: str | None = None, drop: tuple[str, ...] = ("Row Totals", "Percent Row Agreement", "Column Totals", "Percent Column Agreement")) -> DataFrame:
    """Square CSV with integer codes on both axes to (a, b, n); summary rows and columns are dropped."""
    return confusion_from_square(spark.read.option("header", True).csv(path), index, drop)


def confusion_from_square(df: DataFrame, index: str | None, drop: tuple[str, ...]) -> DataFrame:
    idx = index or df.columns[0]
    codes = [c for c in df.columns if c != idx and c not in drop]
    df = df.filter(F.col(idx).isNotNull() & ~F.col(idx).isin(*drop))
    items = F.explode(F.array(*[F.struct(F.lit(int(float(c))).alias("b"), F.col(c).cast("double").alias("n")) for c in codes]))
    return df.select(F.col(idx).cast("double").cast("int").alias("a"), items.alias("i")).select("a", "i.b", "i.n").filter("n <> 0")


def flatten_sequences(df: DataFrame, key: str, seq: str, channels: list[str], first_year: int) -> DataFrame:
    """(T x C) arrays to one row per year with a column per channel."""
    return df.select(key, F.posexplode(seq).alias("_t", "_v")).select(
        key, (F.col("_t") + first_year).alias("year"), *[F.col("_v")[i].alias(c) for i, c in enumerate(channels)])


# Accepted column names of code lookups.
CODE_NAMES, LABEL_NAMES = ("VALUE", "Value", "value"), ("EVT_NAME", "Description", "name")


def label_crosswalk(df: DataFrame, lookup: DataFrame, code: str, out: str = "label", prefix: str = "EVT_") -> DataFrame:
    """Code to name; unknown codes become ``EVT_<code>``; only positive lookup codes count."""
    vc = next(c for c in CODE_NAMES if c in lookup.columns)
    nc = next(c for c in LABEL_NAMES if c in lookup.columns)
    names = lookup.filter(F.col(vc) > 0).groupBy(F.col(vc).alias("_code")).agg(F.min(nc).alias("_name"))
    return df.join(names, F.col(code) == F.col("_code"), "left").withColumn(
        out, F.coalesce("_name", F.concat(F.lit(prefix), F.col(code).cast("string")))).drop("_code", "_name")


def score_vectors(df: DataFrame, fn, inputs: list[str], schema: str, keep: list[str]) -> DataFrame:
    """Batch scoring hook: ``fn(pandas inputs) -> pandas columns`` runs on Arrow batches; ``schema`` names its output."""
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                out = fn(pdf[inputs])
                for c in keep:
                    out[c] = pdf[c].to_numpy()
                yield out

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(run, f"{schema}, {kept}" if kept else schema)
