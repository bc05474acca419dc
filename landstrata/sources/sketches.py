"""Channel statistics stored per tile as mergeable parts: moments and a quantile sketch.

Exact quantiles need the values again; a table that grows by tiles needs statistics that later tiles can add to. Each
tile stores n, mean, sum of squared deviations, extremes and a KLL sketch per channel, and merging parts never reads a value again.
A sketch's quantile lies within ``RANK_ERROR`` of the wanted rank (as a share of the rows) at the default size with a
probability of 0.99, however many parts are merged; moments and extremes are exact.

Nulls, NaN and infinite values are left out; a tile without valid values stores no row for the channel and counts as stored.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import q_name
from ..operators.stats import CHANNEL_PROBS, long_channels
from .stats_store import compute_policy

SIZE = 200  # of a sketch, from 8 to 65535
RANK_ERROR = 0.0133  # at that size
PARTS = ["n", "mean", "m2", "min", "max", "sketch"]


def sketch_parts(df: DataFrame, channels: list[str], group: list[str] = (), mask: Column | None = None, size: int = SIZE) -> DataFrame:
    """(group..., channel, n, mean, m2, min, max, sketch) in one scan with partial aggregation."""
    v = F.col("value")
    return long_channels(df, channels, list(group), mask).groupBy(*group, "channel").agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count("*")).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.kll_sketch_agg_double(v, size).alias("sketch"))


def merge_parts(parts: DataFrame, group: list[str] = ()) -> DataFrame:
    """Parts of one group and channel as one part; squared deviations are taken about the common mean, so nothing cancels."""
    keys = [*group, "channel"]
    whole = parts.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean")).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return parts.join(whole, same).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.any_value("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2).alias("m2"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("sketch"))


def part_stats(parts: DataFrame, group: list[str] = (), probs: list[float] = CHANNEL_PROBS) -> DataFrame:
    """(group..., channel, n, mean, sd, min, max, quantiles) of merged parts, columns as in ``channel_stats``."""
    quantiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(q_name(p)) for p in probs]
    return parts.select(*group, "channel", "n", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("sd"), "min", "max", *quantiles)


def stored_stats(spark: SparkSession, folder: str, tiles: dict[Hashable, Callable[[], DataFrame]], policy: str = "if-not-exists",
                 probs: list[float] = CHANNEL_PROBS) -> DataFrame:
    """Statistics of all named tiles; each is computed (a function that gives ``sketch_parts``) and stored by ``policy``.

    Under if-not-exists only tiles that the folder does not hold are scanned, under never a missing one is an error.
    """
    if not tiles:
        raise ValueError("no tiles")
    out = None
    for name, compute in tiles.items():
        part = compute_policy(spark, f"{folder.rstrip('/')}/tile={name}", lambda compute=compute: compute().select("channel", *PARTS), policy)
        out = part if out is None else out.unionByName(part)
    return part_stats(merge_parts(out), probs=probs)
