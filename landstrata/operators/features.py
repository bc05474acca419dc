"""Feature building: statistics join, standardising, whitening and masked feature vectors."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.transforms import Preset, finite, inverse_transform, transform
from .masks import combined_mask

MAX_CHANNELS = 512  # channel-by-channel matrices beyond this do not belong on the driver


def block_l2_normalise(df: DataFrame, vec: str, train: Column) -> DataFrame:
    """Divide a block by its mean training norm, then scale each row to length 1."""
    mean_norm = df.filter(train).agg(F.avg(V.norm(F.col(vec)))).scalar()
    out = df.withColumn("_m", mean_norm)
    scaled = V.scale(vec, 1.0 / F.col("_m"))
    return out.withColumn(vec, V.row_normalise(scaled)).drop("_m")


def vector_moments(df: DataFrame, vec: str, dim: int, train: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample sd per position (2 x dim numbers reach the driver)."""
    src = df.filter(train) if train is not None else df
    x = F.col(vec)
    row = src.agg(*[F.avg(x[i]).alias(f"m{i}") for i in range(dim)], *[F.stddev_samp(x[i]).alias(f"s{i}") for i in range(dim)]).first()
    mean = np.array([row[f"m{i}"] for i in range(dim)], dtype=float)
    sd = np.array([row[f"s{i}"] or 0.0 for i in range(dim)], dtype=float)
    return mean, sd


def train_standardise(df: DataFrame, vec: str, dim: int, train: Column | None = None, out: str | None = None) -> DataFrame:
    """Centre and scale by the training rows; sd 0 becomes 1."""
    mean, sd = vector_moments(df, vec, dim, train)
    sd = np.where(sd > 0, sd, 1.0)
    z = F.zip_with(F.col(vec), V.literal_vector(mean), lambda x, m: x - m)
    z = F.zip_with(z, V.literal_vector(sd), lambda x, s: x / s)
    return df.withColumn(out or vec, z)


def whitening_factor(cov: np.ndarray, ridge: float = 1e-6, factor: str = "mahalanobis") -> np.ndarray:
    """Matrix W with |W x|^2 = x' (cov + ridge I)^-1 x; ``factor='lower'`` is its transpose."""
    if cov.shape[0] > MAX_CHANNELS:
        raise ValueError(f"{cov.shape[0]} channels; at most {MAX_CHANNELS}")
    lower = np.linalg.cholesky(np.linalg.inv(cov + ridge * np.eye(cov.shape[0])))
    return lower if factor == "lower" else lower.T


def whiten(channels: list[Column], means, factor: np.ndarray, limit: float | None = 5.0) -> Column:
    """Centred channels (missing -> 0) times the factor, clamped."""
    centred = F.array(*[F.coalesce(finite(c) - float(m), F.lit(0.0)) for c, m in zip(channels, means)])
    out = V.linear_map(centred, factor)
    if limit is not None:
        out = F.transform(out, lambda v: F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), v)))
    return out


def unwhiten(vec, means, factor: np.ndarray, transforms: list[str] | None = None, inflate: float | None = None, centre=None) -> list[Column]:
    """Back to channel units: optional spread about a centre, inverse factor, means, inverse transform."""
    x = F.col(vec) if isinstance(vec, str) else vec
    if inflate is not None:
        c = V.literal_vector(centre if centre is not None else np.zeros(len(means)))
        x = F.zip_with(x, c, lambda v, m: m + (v - m) * inflate)
    back = V.linear_map(x, np.linalg.inv(factor), bias=means)
    names = transforms or ["identity"] * len(means)
    return [inverse_transform(back[i], n) for i, n in enumerate(names)]


def variance_inflation(r2) -> Column:
    """1 / max(sqrt(max(R2, 0)), 1e-3)."""
    r2 = F.col(r2) if isinstance(r2, str) else r2
    return 1.0 / F.greatest(F.sqrt(F.greatest(r2, F.lit(0.0))), F.lit(1e-3))


@dataclass(frozen=True)
class Channel:
    """One channel of a feature: source column, element transform, normalisation."""

    source: str
    preset: Preset = field(default_factory=lambda: Preset("identity"))
    transform: str = "identity"


@dataclass(frozen=True)
class Feature:
    """Ordered channels plus masks; with ``covariance`` the channels are whitened instead of scaled."""

    name: str
    channels: tuple[Channel, ...]
    masks: tuple[str, ...] = ()
    covariance: bool = False
    fill: float = 0.0


def transformed(ch: Channel) -> Column:
    return finite(transform(F.col(ch.source).cast("double"), ch.transform))


def build_feature(df: DataFrame, feature: Feature, stats: dict[str, dict[str, float]] | None = None,
                  cov: np.ndarray | None = None) -> DataFrame:
    """Append ``{name}`` (vector, masked rows filled) and ``{name}_valid``; one projection, no shuffle.

    Normalisation uses the transformed value.
    """
    stats = stats or {}
    chans = [transformed(c) for c in feature.channels]
    tmp = {f"_{feature.name}_{i}": c for i, c in enumerate(chans)}
    df2 = df.withColumns(tmp)
    valid = combined_mask(df2.columns, list(feature.masks), list(tmp))
    if feature.covariance:
        means = [stats[c.source]["mean"] for c in feature.channels]
        vec = whiten([F.col(n) for n in tmp], means, whitening_factor(cov))
    else:
        vec = F.array(*[c.preset.apply(n, stats.get(c.source)) for n, c in zip(tmp, feature.channels)])
    empty = F.array(*[F.lit(float(feature.fill))] * len(chans))
    # stored per element so a masked pixel carries the fill, never NULL
    out = df2.withColumn(f"{feature.name}_valid", valid)
    return out.withColumn(feature.name, F.when(F.col(f"{feature.name}_valid"), vec).otherwise(empty)).drop(*tmp)


def build_all_features(df: DataFrame, features: list[Feature], stats=None, covs: dict[str, np.ndarray] | None = None) -> DataFrame:
    for f in features:
        df = build_feature(df, f, stats, (covs or {}).get(f.name))
    return df
