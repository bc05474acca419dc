"""Per-pixel time series: change state, runs, anomalies, annual and seasonal metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.transforms import REDUCERS

# Codes of fast change, and the year that stands for "never".
FAST_CODES = [1, 2, 3, 4, 5, 6, 7, 8, 9]
BASE_YEAR = 1980


def change_state(df: DataFrame, key: list[str], year: str, change: str,
                 fast_codes: list[int] = FAST_CODES, base: int = BASE_YEAR) -> DataFrame:
    """Append last_fast_year, cum_events, ysfc and ysfc_censored; one shuffle by pixel for all four."""
    w = Window.partitionBy(*key).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    fast = F.col(change).isin(*fast_codes)
    out = df.withColumns({
        "last_fast_year": F.coalesce(F.last(F.when(fast, F.col(year)), ignorenulls=True).over(w), F.lit(base)),
        "cum_events": F.sum(fast.cast("int")).over(w),
    })
    return out.withColumns({
        "ysfc": F.col(year) - F.col("last_fast_year"),
        "ysfc_censored": F.col("last_fast_year") == base,
    })


def ysfc_runs(df: DataFrame, key: list[str], year: str, ysfc: str = "ysfc") -> DataFrame:
    """A run starts where ysfc falls; append run_id (from 0) and run_len."""
    w = Window.partitionBy(*key).orderBy(year)
    falls = (F.col(ysfc) < F.lag(ysfc).over(w)).cast("int")
    out = df.withColumn("_f", F.coalesce(falls, F.lit(0)))
    out = out.withColumn("run_id", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")
    return out.withColumn("run_len", F.count("*").over(Window.partitionBy(*key, "run_id")))


def best_step_per_ysfc(df: DataFrame, key: list[str], year: str, ysfc: str = "ysfc") -> DataFrame:
    """One time step per (pixel, ysfc): longest run, then latest."""
    w = Window.partitionBy(*key, ysfc).orderBy(F.col("run_len").desc(), F.col(year).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def temporal_delta(df: DataFrame, key: list[str], year: str, channels: list[str], mask: str | None = None,
                   quality: str | None = None, pad: float | None = None) -> DataFrame:
    """First difference per channel; without ``pad`` the first step is dropped."""
    w = Window.partitionBy(*key).orderBy(year)
    cols: dict[str, Column] = {}
    for c in channels:
        d = F.col(c) - F.lag(c).over(w)
        cols[f"d_{c}"] = d
    first = F.lag(F.lit(True)).over(w).isNull()
    if mask:
        cols[f"d_{mask}"] = F.col(mask) & F.coalesce(F.lag(mask).over(w), F.lit(False))
    if quality:
        cols[f"d_{quality}"] = F.col(quality) * F.lag(quality).over(w)
    out = df.withColumns({**cols, "_first": first})
    if pad is None:
        return out.filter(~F.col("_first")).drop("_first")
    return out.withColumns({f"d_{c}": F.when(F.col("_first"), F.lit(float(pad))).otherwise(F.col(f"d_{c}")) for c in channels}).drop("_first")


def demean_by_pixel(df: DataFrame, key: list[str], channels: list[str]) -> DataFrame:
    """Append the anomaly ``{channel}_anom`` from the pixel's mean."""
    w = Window.partitionBy(*key)
    return df.withColumns({f"{c}_anom": F.col(c) - F.avg(c).over(w) for c in channels})


def temporal_r2(df: DataFrame, key: list[str], pred: str, obs: str) -> DataFrame:
    """R2 of anomalies and the temporal share of the observed variance, one row."""
    d = demean_by_pixel(df.filter(F.col(pred).isNotNull() & F.col(obs).isNotNull()), key, [pred, obs])
    err = F.col(f"{pred}_anom") - F.col(f"{obs}_anom")
    return d.agg(
        (1 - F.try_divide(F.sum(err * err), F.sum(F.col(f"{obs}_anom") * F.col(f"{obs}_anom")))).alias("temporal_r2"),
        F.try_divide(F.avg(F.col(f"{obs}_anom") * F.col(f"{obs}_anom")), F.var_pop(obs)).alias("temporal_share"),
    )


def temporal_reduce(df: DataFrame, key: list[str], channel: str, how: list[str]) -> DataFrame:
    """Annual channel to static, missing values ignored."""
    unknown = [h for h in how if h not in REDUCERS]
    if unknown:
        raise ValueError(f"unknown reducers {unknown}")
    return df.groupBy(*key).agg(*[REDUCERS[h](F.col(channel)).alias(f"{channel}_{h}") for h in how])


def index_annual_metrics(df: DataFrame, key: list[str], indices: list[str], doy: str = "doy") -> DataFrame:
    """max, doy of max, min, doy of min, p05 and p95 of each index per key (earliest day on ties)."""
    aggs = []
    for i in indices:
        v = F.col(i)
        # an observation without the index must not decide the day
        at = F.when(v.isNotNull(), F.col(doy))
        aggs += [
            F.max(i).alias(f"{i}_max"),
            F.max_by(at, F.when(v.isNotNull(), F.struct(v, -F.col(doy)))).alias(f"{i}_max_doy"),
            F.min(i).alias(f"{i}_min"),
            F.min_by(at, F.when(v.isNotNull(), F.struct(v, F.col(doy)))).alias(f"{i}_min_doy"),
            F.percentile(i, F.array(F.lit(0.05), F.lit(0.95))).alias(f"_{i}_p"),  # one buffer for both
        ]
    out = df.groupBy(*key).agg(*aggs)
    names = [n for i in indices for n in (f"{i}_max", f"{i}_max_doy", f"{i}_min", f"{i}_min_doy", F.col(f"_{i}_p")[0].alias(f"{i}_p05"), F.col(f"_{i}_p")[1].alias(f"{i}_p95"))]
    return out.select(*key, *names)


def seasonal_metrics(df: DataFrame, key: list[str], season: str = "season") -> DataFrame:
    """Summer and winter statistics of ndvi, nbr, ndmi and evi2 per key (key holds the hydrological year)."""
    summer, winter = F.col(season) == "summer", F.col(season) == "winter"

    def p95(i):
        return F.percentile(F.when(summer, F.col(i)), F.lit(0.95))

    out = df.groupBy(*key).agg(
        p95("ndvi").alias("ndvi_summer_p95"),
        F.max(F.when(winter, F.col("ndvi"))).alias("ndvi_winter_max"),
        F.min("nbr").alias("nbr_annual_min"),
        p95("nbr").alias("nbr_summer_p95"),
        F.avg(F.when(summer, F.col("ndmi"))).alias("ndmi_summer_mean"),
        p95("evi2").alias("evi2_summer_p95"),
        F.count(F.when(winter, F.col("ndvi"))).alias("winter_obs_count"),
        F.count(F.when(summer, F.col("ndvi"))).alias("summer_obs_count"),
    )
    return out.withColumn("ndvi_amplitude", F.col("ndvi_summer_p95") - F.col("ndvi_winter_max"))


def placeholder_rows(metrics: DataFrame, key: list[str], year: str, first: int, last: int) -> DataFrame:
    """Pixel-years without observations as rows of NULLs."""
    from .masks import reindex_years

    return reindex_years(metrics, key, year, first, last)


def mosaic_latest(df: DataFrame, key: list[str], ts: str, values: list[str], ties: list[str] = ()) -> DataFrame:
    """Values of the last image per key; equal times fall back to the largest tie columns."""
    order = F.struct(F.col(ts), *[F.col(t) for t in ties])
    return df.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*key, "_v.*")


def downsample(df: DataFrame, row: str, col: str, factor: int, features: list[str], masks: list[str]) -> DataFrame:
    """Coarse cells: median of features, maximum of masks (missing = 0)."""
    cell = {"cell_row": F.floor(F.col(row) / factor), "cell_col": F.floor(F.col(col) / factor)}
    return df.withColumns(cell).groupBy("cell_row", "cell_col").agg(
        *[F.median(f).alias(f) for f in features], *[F.max(F.coalesce(F.col(m).cast("int"), F.lit(0))).alias(m) for m in masks]
    )


def change_histogram(df: DataFrame, year: str, change: str, fast_codes: list[int] = FAST_CODES) -> DataFrame:
    """Per year and code: count, whether the code is fast, fast pixels of the year."""
    counts = df.groupBy(year, change).agg(F.count("*").alias("n"))
    fast = F.col(change).isin(*fast_codes)
    w = Window.partitionBy(year)
    return counts.withColumns({"fast": fast, "n_fast_year": F.coalesce(F.sum(F.when(fast, F.col("n"))).over(w), F.lit(0))})


def updated_state_histogram(df: DataFrame, key: list[str], year: str, change: str) -> DataFrame:
    """Per year: pixels whose state was updated that year and pixels ever disturbed so far."""
    s = change_state(df, key, year, change)
    return s.groupBy(year).agg(
        F.count_if(F.col("last_fast_year") == F.col(year)).alias("n_updated"),
        F.count_if(~F.col("ysfc_censored")).alias("n_disturbed"),
    )


def phase_summary(df: DataFrame, key: list[str], ysfc: str, dims: list[str], low: int, high: int) -> DataFrame:
    """Per pixel and dimension: mean over low-ysfc, high-ysfc and all years (fallback all), temporal variance."""
    aggs = []
    for d in dims:
        all_mean = F.avg(d)
        aggs += [
            all_mean.alias(f"{d}_all"),
            F.coalesce(F.avg(F.when(F.col(ysfc) <= low, F.col(d))), all_mean).alias(f"{d}_low"),
            F.coalesce(F.avg(F.when(F.col(ysfc) >= high, F.col(d))), all_mean).alias(f"{d}_high"),
            F.var_samp(d).alias(f"{d}_var"),
        ]
    return df.groupBy(*key).agg(*aggs)


def years_to_columns(df: DataFrame, key: list[str], year: str, value: str, years: list[int], prefix: str) -> DataFrame:
    """One column per year, named from the cleaned prefix."""
    import re

    clean = re.sub(r"[^0-9A-Za-z_]+", "_", prefix).strip("_")
    # conditional aggregates: one pass, column list fixed, no first() order question
    return df.groupBy(*key).agg(*[F.max(F.when(F.col(year) == y, F.col(value))).alias(f"{clean}_{y}") for y in years])


def merge_sensors(*sensors: DataFrame, ts: str = "ts") -> DataFrame:
    """Union of sensors by name, rows without time dropped.  Order is a property of the reader's window."""
    out = sensors[0]
    for s in sensors[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.filter(F.col(ts).isNotNull())


# Sensor band numbers of the harmonised product, in order of preference.
HLS_FALLBACK = {
    "blue": ("B2",), "green": ("B3",), "red": ("B4",),
    "nir": ("B5", "B8A", "B8"), "swir1": ("B6", "B11"), "swir2": ("B7", "B12"),
}


def harmonise_bands(df: DataFrame, fallback: dict[str, tuple[str, ...]] = HLS_FALLBACK) -> DataFrame:
    """Sensor band names to common names, first available band wins."""
    drop = [b for names in fallback.values() for b in names if b in df.columns]
    cols = {}
    for name, choices in fallback.items():
        present = [F.col(b) for b in choices if b in df.columns]
        if present:
            cols[name] = F.coalesce(*present)
    return df.withColumns(cols).drop(*drop)


def discover_years(df: DataFrame, year: str) -> DataFrame:
    return df.select(year).distinct().orderBy(year)
