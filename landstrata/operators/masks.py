"""Masks, fills, year axes and semantic types."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Plausible ranges of terrain layers.
TERRAIN_RANGES = {
    "dem": (-200.0, 6000.0), "slope": (0.0, 80.0), "tpi": (-500.0, 500.0),
    "hand": (-5.0, 200.0), "twi": (-50.0, 50.0), "ksat": (-6.0, 3.0),
}

_OPS: dict[str, Callable[[Column, float], Column]] = {
    ">=": lambda c, v: c >= v, ">": lambda c, v: c > v, "<=": lambda c, v: c <= v,
    "<": lambda c, v: c < v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v,
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fill_values(x, kind: str, nodata=None, band_fill=None, group_fill=None, target=None) -> Column:
    """Replace the source no-data value; the target is band fill, then group fill, then by kind.

    Continuous layers become NULL, categorical 0, masks False; ``target='na'`` forces NULL.
    """
    x = _c(x)
    if target == "na":
        to = F.lit(None)
    else:
        chosen = next((v for v in (target, band_fill, group_fill) if v is not None), None)
        to = F.lit(chosen) if chosen is not None else {
            "continuous": F.lit(None), "categorical": F.lit(0), "mask": F.lit(False)
        }[kind]
    if nodata is None:
        return F.coalesce(x, to) if kind != "continuous" or target != "na" else x
    return F.when(x.isNull() | (x == nodata), to).otherwise(x)


def threshold(x, op: str, value: float) -> Column:
    """0/1 from a comparison; unknown values are 0."""
    if op not in _OPS:
        raise ValueError(f"unknown comparison {op!r}")
    return F.coalesce(_OPS[op](_c(x), value).cast("int"), F.lit(0))


def year_extract(df: DataFrame, key: list[str], year_col: str, channel: str, year: int, first: int, last: int) -> DataFrame:
    """Static channel from one year of an annual table."""
    if not first <= year <= last:
        raise ValueError(f"year {year} outside {first}..{last}")
    return df.filter(F.col(year_col) == year).select(*key, channel)


def temporal_position(year, first: int, n: int, centred: bool = False) -> Column:
    """t/(T-1), or (t-(T-1)/2)/((T-1)/2) when centred; a single step is 0."""
    if n == 1:
        return F.lit(0.0)
    t = (_c(year) - first).cast("double")
    half = (n - 1) / 2.0
    return (t - half) / half if centred else t / (n - 1)


def combined_mask(df_columns: list[str], masks: list[str], channels: list[str]) -> Column:
    """AND of masks (> 0 is true) and of every channel being present; unknown masks are ignored."""
    known = [m for m in masks if m in df_columns]
    tests = [F.coalesce(F.col(m).cast("double") > 0, F.lit(False)) for m in known]
    tests += [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in channels]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def valid_mask_for_stats(masks: list[Column], channels: list[Column]) -> Column:
    """Global masks and all (transformed) channels finite."""
    tests = [F.coalesce(m, F.lit(False)) for m in masks]
    for ch in channels:
        ch = ch.cast("double")
        tests.append(ch.isNotNull() & ~F.isnan(ch) & (F.abs(ch) != float("inf")))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def mask_fill(x, mask, fill: float = 0.0) -> Column:
    return F.when(_c(mask), F.coalesce(_c(x), F.lit(fill))).otherwise(F.lit(fill))


def halo_filter(df: DataFrame, row: str, col: str, patch: int, halo: int) -> DataFrame:
    """Drop a border of ``halo`` pixels inside each patch."""
    lr, lc = F.col(row) % patch, F.col(col) % patch
    return df.filter(lr.between(halo, patch - 1 - halo) & lc.between(halo, patch - 1 - halo))


def npa_mask(df: DataFrame, key: list[str], change: str, code: int = 16, out: str = "npa") -> DataFrame:
    """True for every year of a pixel that carries the code in any year."""
    return df.withColumn(out, F.bool_or(F.col(change) == code).over(Window.partitionBy(*key)))


def remap_codes(x, codes: list[int]) -> Column:
    return F.coalesce(_c(x).isin(*codes).cast("int"), F.lit(0))


def availability_mask(year, missing: list[int]) -> Column:
    return ~_c(year).isin(*missing) if missing else F.lit(True)


def range_validity(layers: list[str], ranges: dict[str, tuple[float, float]] = TERRAIN_RANGES) -> dict[str, Column]:
    """0/1 columns ``{layer}_valid``."""
    return {f"{c}_valid": F.coalesce(F.col(c).between(*ranges[c]).cast("int"), F.lit(0)) for c in layers}


def reindex_years(df: DataFrame, key: list[str], year: str, first: int, last: int,
                  fills: dict[str, object] | None = None) -> DataFrame:
    """Every key on the full year axis; missing values take the given fill (NULL by default).

    One scan and one shuffle by key: the rows of a key are gathered (at most one per year) and expanded inside
    the group; rows outside the axis only keep their key.
    """
    values = [c for c in df.columns if c not in (*key, year)]
    entry = F.when(F.col(year).between(first, last), F.struct(F.col(year).cast("int"), F.struct(*values)))
    packed = df.groupBy(*key).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    out = packed.withColumn(year, F.explode(F.sequence(F.lit(first), F.lit(last))))
    cell = F.try_element_at(F.col("_m"), F.col(year))
    cols = []
    for c in values:
        v = cell[c]
        if fills and fills.get(c) is not None:
            v = F.coalesce(v, F.lit(fills[c]))
        cols.append(v.alias(c))
    return out.select(*key, year, *cols)


# storage types per semantic kind
SEMANTIC_TYPES = {"continuous": "float", "categorical": "int", "mask": "boolean"}
YEAR_FILLS = {"continuous": None, "categorical": -1, "mask": False}


def cast_semantic(x, kind: str, override: str | None = None) -> Column:
    if kind not in SEMANTIC_TYPES:
        raise ValueError(f"unknown kind {kind!r}")
    return _c(x).cast(override or SEMANTIC_TYPES[kind])


def append_derived(df: DataFrame, registry: dict[str, Column], enabled: list[str]) -> DataFrame:
    """Append enabled derived channels, each with its name in the column metadata."""
    unknown = [n for n in enabled if n not in registry]
    if unknown:
        raise ValueError(f"unknown derived channels {unknown}")
    return df.select("*", *[registry[n].alias(n, metadata={"derived": True, "channel": n}) for n in enabled])
