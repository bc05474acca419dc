"""Channel, class and covariance statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import MAX_CHANNELS
from .quantiles import exact_quantiles, q_name

CHANNEL_PROBS = [0.02, 0.05, 0.25, 0.5, 0.75, 0.95, 0.98]
LEGACY_PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]


def long_channels(df: DataFrame, channels: list[str], keep: list[str] = (), mask: Column | None = None) -> DataFrame:
    """(keep..., channel, value) rows of finite values."""
    src = df.filter(mask) if mask is not None else df
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels]))
    out = src.select(*keep, pairs.alias("_p")).select(*keep, "_p.channel", "_p.value")
    return out.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def channel_stats(df: DataFrame, channels: list[str], mask: Column | None = None, probs: list[float] = CHANNEL_PROBS,
                  method: str = "exact") -> DataFrame:
    """Per channel n, mean, sd (population), min, max and quantiles over valid values; two scans, one without ``probs``."""
    long = long_channels(df, channels, mask=mask)
    out = exact_quantiles(long, ["channel"], "value", probs, method, _moments())
    return out.select("channel", *_moments(), *[q_name(p) for p in probs])


def _moments() -> dict:
    return {"n": (F.count("_v"), "bigint"), "mean": (F.avg("_v"), "double"), "sd": (F.stddev_pop("_v"), "double"),
            "min": (F.min("_v"), "double"), "max": (F.max("_v"), "double")}


def tidy_stats(wide: DataFrame, feature: str, key: str = "channel") -> DataFrame:
    """(feature, channel, stat, value) rows."""
    stats = [c for c in wide.columns if c != key]
    s = F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in stats]))
    return wide.select(F.lit(feature).alias("feature"), F.col(key).alias("channel"), s.alias("s")).select(
        "feature", "channel", "s.stat", "s.value"
    )


def class_stats(df: DataFrame, code: str) -> DataFrame:
    """Count and percent (4 places) per code."""
    c = df.filter(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n")).scalar()
    return c.withColumn("percent", F.round(F.lit(1e-9) + 100 * F.col("n") / total, 4))


def class_counts_export(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, code, n, proportion for several categorical features in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("long").alias("code")) for f in features]))
    c = df.select(pairs.alias("p")).select("p.*").filter("code is not null").groupBy("feature", "code").agg(F.count("*").alias("n"))
    return c.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy("feature")))


def variable_stats(df: DataFrame, variable: str, kind: str, missing_code: int = -1) -> DataFrame:
    """continuous: moments and quantiles; categorical: histogram and num_classes; mask: counts and fraction."""
    if kind == "continuous":
        out = channel_stats(df, [variable])
        # no valid data: one zero row
        zero = df.sparkSession.createDataFrame([(variable,)], "channel string")
        out = zero.join(out, "channel", "left")
        return out.fillna(0).withColumn("n", F.coalesce("n", F.lit(0)))
    if kind == "categorical":
        h = df.filter(F.col(variable).isNotNull() & (F.col(variable) != missing_code)).groupBy(variable).agg(F.count("*").alias("n"))
        return h.withColumn("num_classes", h.agg(F.count("*")).scalar())
    if kind == "mask":
        t = F.coalesce(F.col(variable).cast("boolean"), F.lit(False))
        return df.agg(
            F.count_if(t).alias("n_true"), F.count_if(~t).alias("n_false"),
            F.try_divide(F.count_if(t), F.count("*")).alias("fraction"),
        )
    raise ValueError(f"unknown kind {kind!r}")


def legacy_stats(df: DataFrame, channels: list[str], method: str = "exact") -> DataFrame:
    return channel_stats(df, channels, probs=LEGACY_PROBS, method=method)


def legacy_class_table(df: DataFrame, code: str, n_codes: int = 255) -> DataFrame:
    """Counts for every code 0..n_codes-1, absent codes as 0; other codes and nulls, if any, have their own rows."""
    codes = df.sparkSession.range(n_codes).select(F.col("id").cast("int").alias("_c"))
    c = df.groupBy(F.col(code).cast("int").alias(code)).agg(F.count("*").alias("n"))
    both = codes.join(c, F.col("_c") == F.col(code), "full")
    return both.select(F.coalesce(code, "_c").alias(code), F.coalesce("n", F.lit(0)).alias("n"))


def band_patch_quantiles(df: DataFrame, patch: list[str], channels: list[str], probs: list[float]) -> DataFrame:
    """Quantiles per patch and channel; a patch has a bounded number of pixels."""
    long = long_channels(df, channels, patch)
    out = long.groupBy(*patch, "channel").agg(F.percentile("value", F.array(*[F.lit(p) for p in probs])).alias("_q"))
    return out.select(*patch, "channel", *[F.col("_q")[i].alias(q_name(p)) for i, p in enumerate(probs)])


# covariance ----------------------------------------------------------------------------------


def _pairs(channels: list[str]) -> list[tuple[str, str]]:
    if len(channels) > MAX_CHANNELS:
        raise ValueError(f"{len(channels)} channels; at most {MAX_CHANNELS}")
    return [(a, b) for i, a in enumerate(channels) for b in channels[i:]]


def _complete(df: DataFrame, channels: list[str]) -> DataFrame:
    out = df
    for c in channels:
        out = out.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return out


def _symmetric(wide: DataFrame, channels: list[str], prefix: str, keep: list[str]) -> DataFrame:
    items = []
    for i, (a, b) in enumerate(_pairs(channels)):
        items.append(F.struct(F.lit(a).alias("ci"), F.lit(b).alias("cj"), F.col(f"{prefix}{i}").alias("value")))
        if a != b:
            items.append(F.struct(F.lit(b).alias("ci"), F.lit(a).alias("cj"), F.col(f"{prefix}{i}").alias("value")))
    return wide.select(*keep, F.explode(F.array(*items)).alias("e")).select(*keep, "e.ci", "e.cj", "e.value")


def group_covariance(df: DataFrame, group: list[str], channels: list[str]) -> DataFrame:
    """(group, n, ci, cj, value): sample covariance of complete rows, all pairs in one aggregation."""
    aggs = [F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_c{i}") for i, (a, b) in enumerate(_pairs(channels))]
    wide = _complete(df, channels).groupBy(*group).agg(F.count("*").alias("n"), *aggs)
    return _symmetric(wide, channels, "_c", [*group, "n"])


def global_covariance(df: DataFrame, channels: list[str]) -> DataFrame:
    return group_covariance(df, [], channels)


def global_correlation(df: DataFrame, channels: list[str]) -> DataFrame:
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_c{i}") for i, (a, b) in enumerate(_pairs(channels))]
    wide = _complete(df, channels).agg(F.count("*").alias("n"), *aggs)
    return _symmetric(wide, channels, "_c", ["n"])


def correlation_of(covariance: DataFrame) -> DataFrame:
    """(ci, cj, value, corr) from a symmetric covariance table, one row per channel pair."""
    own = covariance.filter(F.col("ci") == F.col("cj")).select(F.col("ci").alias("c"), F.col("value").alias("v"))
    both = covariance.join(own.withColumnsRenamed({"c": "ci", "v": "_vi"}), "ci").join(own.withColumnsRenamed({"c": "cj", "v": "_vj"}), "cj")
    return both.select("ci", "cj", "value", F.try_divide(F.col("value"), F.sqrt(F.col("_vi") * F.col("_vj"))).alias("corr"))


def patch_mean_covariance(df: DataFrame, patch: list[str], channels: list[str]) -> DataFrame:
    """Unweighted mean of per-patch covariance matrices; identity when no patch has two rows."""
    per = group_covariance(df, patch, channels).filter("n >= 2")
    mean = per.groupBy("ci", "cj").agg(F.avg("value").alias("value"))
    return _or_identity(mean, channels)


def weighted_patch_covariance(df: DataFrame, patch: list[str], channels: list[str]) -> DataFrame:
    """Per-patch covariance averaged with the patch row counts."""
    per = group_covariance(df, patch, channels).filter("n >= 2")
    mean = per.groupBy("ci", "cj").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("value"))
    return _or_identity(mean, channels)


def _or_identity(mean: DataFrame, channels: list[str]) -> DataFrame:
    rows = [(a, b, 1.0 if a == b else 0.0) for a in channels for b in channels]
    base = mean.sparkSession.createDataFrame(rows, "ci string, cj string, _i double")
    return base.join(mean, ["ci", "cj"], "left").select("ci", "cj", F.coalesce("value", "_i").alias("value"))


def matrix(cov: DataFrame, channels: list[str]) -> np.ndarray:
    """C x C table to an array; C is checked, so the driver holds a bounded matrix."""
    _pairs(channels)
    at = {c: i for i, c in enumerate(channels)}
    out = np.zeros((len(channels), len(channels)))
    for r in cov.select("ci", "cj", "value").collect():
        out[at[r["ci"]], at[r["cj"]]] = r["value"]
    return out


def inverse_covariance(cov: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    return np.linalg.inv(cov + ridge * np.eye(cov.shape[0]))


# one-pass statistics -------------------------------------------------------------------------


def online_stats(df: DataFrame, channels: list[str], probs: list[float] = (0.25, 0.5, 0.75), method: str = "exact") -> DataFrame:
    """Rows with any missing channel are dropped; var and sd use n-1; mad is the mean absolute deviation."""
    long = long_channels(_complete(df, channels), channels)
    extra = _moments()
    extra.pop("sd")
    extra |= {"var": (F.var_samp("_v"), "double"), "sd": (F.stddev_samp("_v"), "double")}
    base = exact_quantiles(long, ["channel"], "value", list(probs), method, extra)
    dev = long.join(base.select("channel", "mean"), "channel").groupBy("channel").agg(
        F.avg(F.abs(F.col("value") - F.col("mean"))).alias("mad"))
    return base.join(dev, "channel")


def distribution_summary(df: DataFrame, x: str) -> DataFrame:
    base = df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return with_row(base, exact_quantiles(df, [], x, [0.25, 0.5, 0.75]))


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Append the columns of a one-row table as a scalar subquery."""
    return df.withColumn("_row", row.select(F.struct("*")).scalar()).select("*", "_row.*").drop("_row")


def change_moments(df: DataFrame, channels: list[str]) -> DataFrame:
    """Mergeable n, mean, M2, min and max per channel."""
    long = long_channels(df, channels)
    return long.groupBy("channel").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("m2"),
        F.min("value").alias("min"), F.max("value").alias("max"))


# weights -------------------------------------------------------------------------------------


def class_weights(df: DataFrame, code: str, mode: str = "sqrt_inv", missing: list[int] = (0, 1), eps: float = 1e-6) -> DataFrame:
    """Weight per class, 0 for missing/unknown ids, mean 1 over the nonzero ones."""
    c = df.groupBy(code).agg(F.count("*").alias("n"))
    raw = {"uniform": F.lit(1.0), "inv": 1.0 / (F.col("n") + eps), "sqrt_inv": 1.0 / F.sqrt(F.col("n") + eps)}
    if mode not in raw:
        raise ValueError(f"unknown mode {mode!r}")
    w = c.withColumn("_w", F.when(F.col(code).isin(*missing), 0.0).otherwise(raw[mode]))
    mean = w.agg(F.avg(F.when(F.col("_w") > 0, F.col("_w")))).scalar()
    return w.withColumn("weight", F.col("_w") / (mean + eps)).drop("_w")


def median_frequency_weights(counts: DataFrame, code: str, n: str, cap: float) -> DataFrame:
    """median(freq)/freq clipped at ``cap``; codes without rows weigh 0."""
    total = counts.agg(F.sum(n)).scalar()
    f = counts.withColumn("freq", F.col(n) / total)
    med = f.filter("freq > 0").agg(F.median("freq")).scalar()
    w = F.when(F.col("freq") > 0, F.least(F.lit(float(cap)), med / F.col("freq"))).otherwise(0.0)
    return f.withColumn("weight", w)
