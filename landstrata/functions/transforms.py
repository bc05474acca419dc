"""Element transforms, normalisers and the open registries."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

GUARD = 1e-8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NULL for NaN and infinities."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


TRANSFORMS: dict[str, Callable[..., Column]] = {
    "identity": lambda x: x,
    "log1p": lambda x: F.when(x > -1, F.log1p(x)),
    "log10": lambda x: F.when(x > 0, F.log10(x)),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "cbrt": lambda x: F.cbrt(x),
    "log": lambda x, eps=1.0: F.when(x + eps > 0, F.log(x + eps)),
}

INVERSE_TRANSFORMS: dict[str, Callable[..., Column]] = {
    "identity": lambda x: x,
    "log1p": lambda x: F.expm1(x),
    "log10": lambda x: F.pow(F.lit(10.0), x),
    "sqrt": lambda x: x * x,
    "cbrt": lambda x: x * x * x,
    "log": lambda x, eps=1.0: F.exp(x) - eps,
}

REDUCERS: dict[str, Callable[[Column], Column]] = {
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "median": F.median,
    "std": F.stddev_pop,
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0)),
}


def register_transform(name: str, fn: Callable[..., Column], inverse: Callable[..., Column] | None = None) -> None:
    TRANSFORMS[name] = fn
    if inverse is not None:
        INVERSE_TRANSFORMS[name] = inverse


def register_reducer(name: str, fn: Callable[[Column], Column]) -> None:
    REDUCERS[name] = fn


def transform(x, name: str, **kw) -> Column:
    """Named element transform; outside its domain the result is NULL."""
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name!r}; known: {sorted(TRANSFORMS)}")
    return TRANSFORMS[name](_c(x), **kw)


def inverse_transform(x, name: str, **kw) -> Column:
    if name not in INVERSE_TRANSFORMS:
        raise ValueError(f"no inverse for {name!r}")
    return INVERSE_TRANSFORMS[name](_c(x), **kw)


def guard(scale) -> Column:
    """Scales below 1e-8 become 1."""
    s = _c(scale)
    return F.when(s < GUARD, 1.0).otherwise(s)


def zscore(x, mean, sd) -> Column:
    return (_c(x) - _c(mean)) / guard(sd)


def robust_iqr(x, q25, q50, q75) -> Column:
    return (_c(x) - _c(q50)) / guard(_c(q75) - _c(q25))


def minmax(x, lo, hi) -> Column:
    return (_c(x) - _c(lo)) / guard(_c(hi) - _c(lo))


def linear_rescale(x, in_min: float, in_max: float, out_min: float, out_max: float) -> Column:
    return (_c(x) - in_min) / (in_max - in_min) * (out_max - out_min) + out_min


def clamp(x, lo: float | None, hi: float | None) -> Column:
    x = _c(x)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def inverse_zscore(x, mean, sd) -> Column:
    return _c(x) * guard(sd) + _c(mean)


def inverse_robust_iqr(x, q25, q50, q75) -> Column:
    return _c(x) * guard(_c(q75) - _c(q25)) + _c(q50)


def inverse_minmax(x, lo, hi) -> Column:
    return _c(x) * guard(_c(hi) - _c(lo)) + _c(lo)


# statistics each normaliser needs
REQUIRED_STATS = {
    "identity": (), "clamp": (), "linear_rescale": (),
    "zscore": ("mean", "sd"), "robust_iqr": ("q25", "q50", "q75"), "minmax": ("min", "max"),
}


@dataclass(frozen=True)
class Preset:
    """A named normalisation: kind, optional clamp, optional fixed range."""

    kind: str
    clamp_min: float | None = None
    clamp_max: float | None = None
    in_min: float | None = None
    in_max: float | None = None
    out_min: float = 0.0
    out_max: float = 1.0

    def apply(self, x, stats: dict[str, Column | float] | None = None) -> Column:
        given = stats or {}
        missing = [k for k in REQUIRED_STATS[self.kind] if given.get(k) is None]
        s = {k: given[k] if isinstance(given[k], Column) else F.lit(float(given[k])) for k in REQUIRED_STATS[self.kind] if k not in missing}
        if self.kind == "minmax" and self.in_min is not None:
            s, missing = {"min": F.lit(self.in_min), "max": F.lit(self.in_max)}, []
        if missing:
            raise ValueError(f"{self.kind} needs statistics {missing}")
        x = _c(x)
        if self.kind == "zscore":
            out = zscore(x, s["mean"], s["sd"])
        elif self.kind == "robust_iqr":
            out = robust_iqr(x, s["q25"], s["q50"], s["q75"])
        elif self.kind == "minmax":
            out = minmax(x, s["min"], s["max"])
        elif self.kind == "linear_rescale":
            out = linear_rescale(x, self.in_min, self.in_max, self.out_min, self.out_max)
        else:
            out = x
        return clamp(out, self.clamp_min, self.clamp_max)


def ramp_weight(epoch, start: float, length: float) -> Column:
    """0 before ``start``, linear over ``length``, then 1."""
    e = _c(epoch)
    if length <= 0:
        return F.when(e < start, 0.0).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (e - start) / length))


def rate_schedule(epoch, kind: str, first: float, last: float, total: float) -> Column:
    """constant, linear or cosine change from ``first`` to ``last`` over ``total`` epochs."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(epoch) / total))
    if kind == "constant":
        return F.lit(float(first))
    if kind == "linear":
        return first + (last - first) * p
    if kind == "cosine":
        return last + (first - last) * 0.5 * (1 + F.cos(p * math.pi))
    raise ValueError(f"unknown schedule {kind!r}")
