"""Spectral indices, QA bits and calendar helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6

# Five-band tasseled-cap weights (Zhai et al. 2022), order green red nir swir1 swir2.
TASSELED_CAP = {
    "tcb": (0.4596, 0.5046, 0.5458, 0.4114, 0.2589),
    "tcg": (-0.3374, -0.4901, 0.7909, 0.0177, -0.1416),
    "tcw": (0.2254, 0.3681, 0.2250, -0.6053, -0.6298),
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bit(qa, b: int) -> Column:
    return F.getbit(_c(qa), F.lit(b)).cast("int")


def clear_land_fmask(fmask) -> Column:
    """True when cirrus, cloud, adjacent, shadow, snow and water bits (0-5) are all zero."""
    return _c(fmask).bitwiseAND(0b111111) == 0


def clear_landsat(qa, radsat) -> Column:
    """Bits 0-5 and 7 zero and no radiometric saturation."""
    return (_c(qa).bitwiseAND(0b10111111) == 0) & (_c(radsat) == 0)


def qa_interp(qa) -> Column:
    return _c(qa).bitwiseAND(1)


def scale_sr(dn) -> Column:
    """Surface-reflectance digital number to reflectance."""
    return _c(dn) * 0.0000275 - 0.2


def _bounded(expr: Column, ok: Column, limit: float) -> Column:
    return F.when(ok & (F.abs(expr) <= limit), expr)


def safe_ndvi(nir, red) -> Column:
    n, r = _c(nir), _c(red)
    return _bounded(F.try_divide(n - r, n + r), (n > 0) & (n + r > 0.02), 1.0)


def _safe_nd(a, b) -> Column:
    a, b = _c(a), _c(b)
    return _bounded(F.try_divide(a - b, a + b), (a > 0) & (b > 0) & (a + b > 0.02), 1.0)


def safe_nbr(nir, swir2) -> Column:
    return _safe_nd(nir, swir2)


def safe_ndmi(nir, swir1) -> Column:
    return _safe_nd(nir, swir1)


def safe_evi(nir, red, blue) -> Column:
    n, r, b = _c(nir), _c(red), _c(blue)
    den = n + 6 * r - 7.5 * b + 1
    return _bounded(F.try_divide((n - r) * 2.5, den), (den > 0.02) & (n > 0), 2.5)


def safe_evi2(nir, red) -> Column:
    n, r = _c(nir), _c(red)
    den = n + 2.4 * r + 1
    return _bounded(F.try_divide((n - r) * 2.5, den), (den > 0.02) & (n > 0), 2.5)


def normalized_difference(a, b, eps: float = EPS) -> Column:
    a, b = _c(a), _c(b)
    return (a - b) / (a + b + eps)


def ndvi(nir, red) -> Column:
    return normalized_difference(nir, red)


def nbr(nir, swir2) -> Column:
    return normalized_difference(nir, swir2)


def ndmi(nir, swir1) -> Column:
    return normalized_difference(nir, swir1)


def index_derivative(a, b, da, db, eps: float = EPS) -> Column:
    """Time derivative of (a-b)/(a+b)."""
    a, b = _c(a), _c(b)
    den = a + b + eps
    return (b * _c(da) - a * _c(db)) * 2.0 / (den * den + eps)


def tasseled_cap(green, red, nir, swir1, swir2) -> dict[str, Column]:
    bands = [_c(x) for x in (green, red, nir, swir1, swir2)]
    out = {}
    for name, weights in TASSELED_CAP.items():
        expr = bands[0] * weights[0]
        for band, w in zip(bands[1:], weights[1:]):
            expr = expr + band * w
        out[name] = expr
    return out


def forest_index(nir, swir1, swir2) -> Column:
    return (_c(nir) + _c(swir1) + _c(swir2)) / 3.0


def ndvi_positive_sum(nir, red) -> Column:
    n, r = _c(nir), _c(red)
    return F.when(n + r > 0, F.try_divide(n - r, n + r))


def add_indices(df, blue="blue", red="red", nir="nir", swir1="swir1", swir2="swir2", ts="ts", doy_base=0):
    """Append ndvi, evi, evi2, fi, nbr, ndmi and doy."""
    return df.withColumns({
        "ndvi": safe_ndvi(nir, red),
        "evi": safe_evi(nir, red, blue),
        "evi2": safe_evi2(nir, red),
        "fi": forest_index(nir, swir1, swir2),
        "nbr": safe_nbr(nir, swir2),
        "ndmi": safe_ndmi(nir, swir1),
        "doy": doy(ts, doy_base),
    })


def doy(ts, base: int = 0) -> Column:
    """Day of year counted from ``base`` (0 or 1)."""
    return F.dayofyear(_c(ts)) - (1 - base)


def frac_year(ts) -> Column:
    ts = _c(ts)
    y = F.year(ts)
    return y + (F.dayofyear(ts) - 1) / F.dayofyear(F.make_date(y, F.lit(12), F.lit(31)))


def safe_date(year, month, day) -> Column:
    """Date with the day clamped to the month's end."""
    y, m, d = _c(year), _c(month), _c(day)
    first = F.make_date(y, m, F.lit(1))
    return F.make_date(y, m, F.least(d, F.day(F.last_day(first))))


def hydro_year(ts) -> Column:
    """October of the previous year to September."""
    ts = _c(ts)
    return F.year(ts) + F.when(F.month(ts) >= 10, 1).otherwise(0)


def season(ts) -> Column:
    """winter = December to February, summer = June to August, else NULL."""
    m = F.month(_c(ts))
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(6, 7, 8), "summer")
