"""Statistics tables: storing, exporting, looking up, deciding whether to compute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names used by older statistics files.
STAT_ALIASES = {"std": "sd", "stddev": "sd", "median": "q50", "p02": "q02", "p25": "q25", "p75": "q75", "p98": "q98"}


def stats_lookup(tidy: DataFrame, feature: str, stats: list[str]) -> DataFrame:
    """One row per channel with the requested statistics; a missing one is an error at run time."""
    names = [STAT_ALIASES.get(s, s) for s in stats]
    stat = F.col("stat")
    for old, new in STAT_ALIASES.items():
        stat = F.when(F.col("stat") == old, new).otherwise(stat)
    wide = tidy.filter(F.col("feature") == feature).withColumn("stat", stat).groupBy("channel").agg(
        *[F.max(F.when(F.col("stat") == n, F.col("value"))).alias(n) for n in names])
    checked = [
        F.when(F.col(n).isNull(), F.raise_error(F.concat(F.lit(f"missing statistic {feature}."), F.col("channel"), F.lit(f".{n}"))).cast("double"))
        .otherwise(F.col(n)).alias(n) for n in names
    ]
    return wide.select("channel", *checked)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def compute_policy(spark: SparkSession, path: str, compute: Callable[[], DataFrame], policy: str = "if-not-exists") -> DataFrame:
    """never: read what is stored (error when absent); if-not-exists; always."""
    if policy not in ("never", "if-not-exists", "always"):
        raise ValueError(f"unknown policy {policy!r}")
    present = exists(spark, path)
    if policy == "never" and not present:
        raise FileNotFoundError(path)
    if policy == "always" or (policy == "if-not-exists" and not present):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_stats_json(tidy: DataFrame, path: str) -> None:
    """One JSON line per feature: channel -> stat -> value."""
    per = tidy.groupBy("feature", "channel").agg(F.map_from_entries(F.collect_list(F.struct("stat", "value"))).alias("stats"))
    out = per.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("channel", "stats"))).alias("channels"))
    out.write.mode("overwrite").json(path)


def write_stats_csv(tidy: DataFrame, path: str, stats: list[str], histogram: DataFrame | None = None) -> None:
    """Flat CSV: one row per channel, union of statistics as columns, histogram as a JSON string."""
    flat = tidy.groupBy("feature", "channel").agg(*[F.max(F.when(F.col("stat") == s, F.col("value"))).alias(s) for s in stats])
    if histogram is not None:
        h = histogram.groupBy("feature").agg(
            F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("code").cast("string"), "n"))))).alias("histogram"))
        flat = flat.join(h, "feature", "full")
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
