"""Metrics of a pixel's segment history, computed inside the row.

``segs`` is an array of structs ordered by time: t_start, t_end, t_break and one struct per band
(green, red, nir, swir1, swir2) with ``coefs`` (intercept, slope, cos, sin, ...), ``rmse`` and ``mag``.
Missing results are NULL; ``with_sentinel`` turns them into -9999 for export.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indices import EPS, index_derivative, ndvi, nbr, ndmi, normalized_difference, tasseled_cap

BANDS = ("green", "red", "nir", "swir1", "swir2")
HARMONIC_BANDS = ("red", "nir", "swir1", "swir2")
SENTINEL = -9999.0

Seg = Callable[[Column], Column]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def coef(s: Column, band: str, i: int) -> Column:
    return s[band]["coefs"][i]


def duration(s: Column) -> Column:
    return s["t_end"] - s["t_start"]


def amplitude(band: str) -> Seg:
    return lambda s: F.hypot(coef(s, band, 2), coef(s, band, 3))


def _mid(s: Column, band: str) -> Column:
    return coef(s, band, 0) + coef(s, band, 1) * (s["t_start"] + s["t_end"]) / 2


def _add(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


# array reductions ---------------------------------------------------------------------------


def _population_variance(values: Column) -> Column:
    """One pass over the array: running count, mean and sum of squared deviations."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(acc, v):
        n = acc["n"] + 1
        mean = acc["mean"] + (v - acc["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + (v - acc["mean"]) * (v - mean)).alias("m2"))

    return F.aggregate(values, zero, step, lambda acc: F.when(acc["n"] > 0, F.try_divide(acc["m2"], acc["n"])))


def array_reduce(values: Column, how: str) -> Column:
    """first, last, sum, mean, max, min, variance or stddev (population) of an array; empty -> NULL."""
    n = F.size(values)
    if how == "first":
        return F.try_element_at(values, F.lit(1))
    if how == "last":
        return F.try_element_at(values, F.lit(-1))
    if how == "max":
        return F.array_max(values)
    if how == "min":
        return F.array_min(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    if how == "sum":
        return F.when(n > 0, total)
    mean = F.when(n > 0, total / n)
    if how == "mean":
        return mean
    var = _population_variance(values)
    if how == "variance":
        return var
    if how == "stddev":
        return F.sqrt(var)
    raise ValueError(f"unknown reducer {how!r}")


def derive(segs) -> Column:
    """Per segment the quantities the long-term metrics share, computed once."""
    nd = {"ndvi": ("nir", "red"), "nbr": ("nir", "swir2"), "ndmi": ("nir", "swir1")}

    def one(s: Column) -> Column:
        f = {"t_start": s["t_start"], "t_end": s["t_end"], "t_break": s["t_break"], "dur": duration(s), "vel": _velocity(s)}
        f |= {f"mid_{b}": _mid(s, b) for b in BANDS}
        f |= {f"amp_{b}": amplitude(b)(s) for b in HARMONIC_BANDS}
        f |= {f"rmse_{b}": s[b]["rmse"] for b in HARMONIC_BANDS}
        f |= {f"mid_{n}": normalized_difference(_mid(s, x), _mid(s, y)) for n, (x, y) in nd.items()}
        f |= {"joint": _add([s[b]["rmse"] for b in BANDS]) / len(BANDS), "slope": coef(s, "nir", 1) - coef(s, "red", 1)}
        f |= {"absmag": _add([F.abs(s[b]["mag"]) for b in BANDS]) / len(BANDS), "specmag": _spectral_mag(s), "nir_mag": s["nir"]["mag"]}
        return F.struct(*[c.alias(n) for n, c in f.items()])

    return F.transform(_c(segs), one)


def with_derived(df: DataFrame, segs: str = "segs", out: str = "_derived") -> DataFrame:
    return df.withColumn(out, derive(segs))


def _d(segs, derived) -> Column:
    return derive(segs) if derived is None else _c(derived)


def _over(d: Column, name: str, how: str) -> Column:
    return array_reduce(d[name], how)


def _weighted(d: Column, name: str) -> Column:
    num = F.aggregate(d, F.lit(0.0), lambda acc, s: acc + s[name] * s["dur"])
    return num / (array_reduce(d["dur"], "sum") + EPS)


def _decades(d: Column) -> Column:
    return F.greatest((F.array_max(d["t_end"]) - F.array_min(d["t_start"])) / 10, F.lit(EPS))


def segment_at(segs, t) -> Column:
    """The segment with t_start <= t <= t_end, NULL when there is none."""
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    return F.try_element_at(F.filter(_c(segs), lambda s: (s["t_start"] <= t) & (s["t_end"] >= t)), F.lit(1))


# snapshots -----------------------------------------------------------------------------------


def snapshot_state(seg: Column, t) -> dict[str, Column]:
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    v = {b: coef(seg, b, 0) + coef(seg, b, 1) * t for b in BANDS}
    out = dict(v)
    out["ndvi"] = ndvi(v["nir"], v["red"])
    out["nbr"] = nbr(v["nir"], v["swir2"])
    out["ndmi"] = ndmi(v["nir"], v["swir1"])
    out.update(tasseled_cap(*[v[b] for b in BANDS]))
    return out


def snapshot_harmonic(seg: Column) -> dict[str, Column]:
    return {f"seasonal_amp_{b}": amplitude(b)(seg) for b in HARMONIC_BANDS}


def snapshot_trajectory(seg: Column, t) -> dict[str, Column]:
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    at = {b: coef(seg, b, 0) + coef(seg, b, 1) * t for b in BANDS}
    slope = {b: coef(seg, b, 1) for b in BANDS}
    return {
        "spectral_velocity": F.sqrt(_add([slope[b] * slope[b] for b in BANDS])),
        "segment_duration": duration(seg),
        "rmse_mean": _add([seg[b]["rmse"] for b in BANDS]) / len(BANDS),
        "dndvi_dt": index_derivative(at["nir"], at["red"], slope["nir"], slope["red"]),
        "dndmi_dt": index_derivative(at["nir"], at["swir1"], slope["nir"], slope["swir1"]),
        "dnbr_dt": index_derivative(at["nir"], at["swir2"], slope["nir"], slope["swir2"]),
    }


def snapshot(df: DataFrame, t, segs: str = "segs", prefix: str = "") -> DataFrame:
    """All snapshot metrics at one instant."""
    df = df.withColumn("_seg", segment_at(segs, t))
    seg = F.col("_seg")
    cols = {**snapshot_state(seg, t), **snapshot_harmonic(seg), **snapshot_trajectory(seg, t)}
    return df.withColumns({prefix + k: v for k, v in cols.items()}).drop("_seg")


def annual_snapshots(df: DataFrame, years: range | list[int], month: int, day: int, segs: str = "segs") -> DataFrame:
    """Snapshot metrics on one calendar date of every year; one output row per (input row, year)."""
    from .indices import frac_year, safe_date

    out = df.withColumn("year", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    out = out.withColumn("t_snap", frac_year(safe_date(F.col("year"), F.lit(month), F.lit(day))).cast("double"))
    return snapshot(out, F.col("t_snap"), segs)


# long-term metrics ---------------------------------------------------------------------------


# each group takes the segment array, or the column made by ``with_derived`` when several groups are wanted


def longterm_state(segs, derived=None) -> dict[str, Column]:
    """Duration-weighted mean of mid-segment reflectance and indices."""
    d = _d(segs, derived)
    return {f"mean_{n}": _weighted(d, f"mid_{n}") for n in (*BANDS, "ndvi", "nbr", "ndmi")}


def longterm_harmonic(segs, derived=None) -> dict[str, Column]:
    d = _d(segs, derived)
    out: dict[str, Column] = {}
    for b in HARMONIC_BANDS:
        mean_amp = _weighted(d, f"amp_{b}")
        out[f"mean_seasonal_amp_{b}"] = mean_amp
        out[f"mean_seasonal_snr_{b}"] = mean_amp / (_over(d, f"rmse_{b}", "mean") + EPS)
        out[f"variance_seasonal_amp_{b}"] = _over(d, f"amp_{b}", "variance")
    for b in ("nir", "swir1"):
        out[f"max_seasonal_amp_{b}"] = _over(d, f"amp_{b}", "max")
        out[f"net_change_seasonal_amp_{b}"] = _over(d, f"amp_{b}", "last") - _over(d, f"amp_{b}", "first")
    return out


def _velocity(s: Column) -> Column:
    return F.sqrt(_add([coef(s, b, 1) * coef(s, b, 1) for b in BANDS]))


def longterm_trajectory(segs, derived=None) -> dict[str, Column]:
    d, segs = _d(segs, derived), _c(segs)
    distance = F.aggregate(d, F.lit(0.0), lambda acc, s: acc + s["vel"] * s["dur"])
    distance = F.when(F.size(d) > 0, distance)
    first, last = F.try_element_at(segs, F.lit(1)), F.try_element_at(segs, F.lit(-1))
    start = {b: coef(first, b, 0) + coef(first, b, 1) * first["t_start"] for b in ("nir", "red")}
    end = {b: coef(last, b, 0) + coef(last, b, 1) * last["t_end"] for b in ("nir", "red")}
    return {
        "total_spectral_distance": distance,
        "spectral_distance_per_decade": distance / _decades(d),
        "mean_spectral_velocity": _over(d, "vel", "mean"),
        "net_change_ndvi": ndvi(end["nir"], end["red"]) - ndvi(start["nir"], start["red"]),
        "net_change_nir": end["nir"] - start["nir"],
        "mean_recovery_rate": array_reduce(F.transform(d["slope"], lambda x: F.greatest(x, F.lit(0.0))), "mean"),
        "mean_decline_rate": array_reduce(F.transform(d["slope"], lambda x: F.abs(F.least(x, F.lit(0.0)))), "mean"),
    }


def disturbance_metrics(segs, derived=None) -> dict[str, Column]:
    """``years_since_last_break`` is the duration of the last segment."""
    d = _d(segs, derived)
    breaks = F.size(F.filter(d["t_break"], lambda x: x > 0))
    return {
        "num_segments": F.size(d),
        "break_count": breaks,
        "break_rate_per_decade": breaks / _decades(d),
        "years_since_last_break": _over(d, "dur", "last"),
        "mean_segment_duration": _over(d, "dur", "mean"),
        "max_segment_duration": _over(d, "dur", "max"),
        "min_segment_duration": _over(d, "dur", "min"),
        "mean_break_magnitude": _over(d, "absmag", "mean"),
        "max_break_magnitude": _over(d, "absmag", "max"),
    }


def variability_metrics(segs, derived=None) -> dict[str, Column]:
    d = _d(segs, derived)
    return {
        "variance_ndvi": _over(d, "mid_ndvi", "variance"),
        "variance_nir": _over(d, "mid_nir", "variance"),
        "cv_segment_duration": _over(d, "dur", "stddev") / (_over(d, "dur", "mean") + EPS),
        "mean_rmse_joint": _over(d, "joint", "mean"),
        "max_rmse_joint": _over(d, "joint", "max"),
    }


def _spectral_mag(s: Column) -> Column:
    return F.sqrt(_add([s[b]["mag"] * s[b]["mag"] for b in BANDS]))


def rapid_losses(segs, derived=None, max_duration=1.5, min_magnitude=0.10) -> Column:
    """Short segments that end in a large drop of near-infrared, with their derived quantities."""
    return F.filter(_d(segs, derived), lambda s: (s["dur"] < max_duration) & (s["specmag"] > min_magnitude) & (s["nir_mag"] < 0))


def nth_recent(values: Column, n: int) -> Column:
    """n-th most recent of an array of times, NULL with fewer."""
    return F.try_element_at(F.sort_array(values, asc=False), F.lit(n))


def rapid_loss(segs, derived=None, n_recent: int = 4) -> dict[str, Column]:
    d = _d(segs, derived)
    losses = rapid_losses(segs, derived)
    out = {
        "rapid_loss_rate_per_decade": F.size(losses) / _decades(d),
        "rapid_loss_mean_magnitude": F.coalesce(_over(losses, "specmag", "mean"), F.lit(0.0)),
    }
    for i in range(1, n_recent + 1):
        out[f"rapid_loss_year_{i}"] = nth_recent(losses["t_break"], i)
    return out


def loss_recovery(segs, derived=None) -> dict[str, Column]:
    """Mean gap between losses (two or more) and its sd (four or more)."""
    years = rapid_losses(segs, derived)["t_break"]
    n = F.size(years)
    gaps = F.zip_with(
        F.slice(years, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(years, F.lit(1), F.greatest(n - 1, F.lit(0))),
        lambda b, a: b - a,
    )
    return {
        "mean_loss_recovery_duration": F.when(n >= 2, array_reduce(gaps, "mean")),
        "std_loss_recovery_duration": F.when(n >= 4, array_reduce(gaps, "stddev")),
    }


LONGTERM_GROUPS = {
    "state": longterm_state, "harmonic": longterm_harmonic, "trajectory": longterm_trajectory,
    "disturbance": disturbance_metrics, "variability": variability_metrics, "rapid_loss": rapid_loss,
    "loss_recovery": loss_recovery,
}


def all_segment_metrics(df: DataFrame, snapshots: dict[str, float], segs: str = "segs",
                        skip: tuple[str, ...] = ()) -> DataFrame:
    """One wide row per input row: every snapshot and every long-term group not skipped."""
    out = df
    for name, t in snapshots.items():
        out = snapshot(out, t, segs, f"snap_{name}_")
    cols: dict[str, Column] = {}
    for name, fn in LONGTERM_GROUPS.items():
        if name not in skip:
            cols.update(fn(segs, "_derived"))
    return with_derived(out, segs).withColumns(cols).drop("_derived")


def with_sentinel(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(SENTINEL, subset=columns)


def segments_from_rows(rows: DataFrame, key: str = "pixel", order: str = "seg_no", columns: dict[str, str] | None = None) -> DataFrame:
    """Flat segment rows ({band}_c0, _c1, _cos, _sin, _rmse, _mag) to one array per pixel.

    ``columns`` gives columns that the rows lack as SQL over a row ``s``. They are made inside the array, so what is
    grouped, sorted and spilled are the rows' own columns and not some 30 numbers a segment.
    """
    columns = columns or {}

    def num(name: str) -> str:
        return f"cast({columns.get(name, f's.`{name}`')} as double)"

    bands = [f"""'{b}', named_struct('coefs', array({", ".join(num(f"{b}_{c}") for c in ("c0", "c1", "cos", "sin"))}),
        'rmse', {num(f"{b}_rmse")}, 'mag', {num(f"{b}_mag")})""" for b in BANDS]
    times = [f"'{c}', {num(c)}" for c in ("t_start", "t_end", "t_break")]
    seg = f"""named_struct('{order}', s.`{order}`, {", ".join(times + bands)})"""
    own = F.struct(order, *[c for c in rows.columns if c not in (key, order)])
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(own)).alias("_rows")).select(key, F.expr(f"transform(_rows, s -> {seg})").alias("segs"))


def assert_disjoint(segs) -> Column:
    """True when no segment starts before the previous one ends."""
    segs = _c(segs)
    n = F.size(segs)
    bad = F.zip_with(F.slice(segs, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(segs, F.lit(1), F.greatest(n - 1, F.lit(0))),
                     lambda b, a: b["t_start"] < a["t_end"])
    return ~F.exists(bad, lambda x: x)
