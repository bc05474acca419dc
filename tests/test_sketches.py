"""Stored statistics that later tiles add to, against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landstrata.sources import sketches as SK


def values(n=20_000, seed=3):
    """A third of the rows hold one value; some are missing or not finite."""
    rng = np.random.default_rng(seed)
    v = rng.normal(1e6, 3.0, n)
    v[: n // 3] = 1e6 + 1.5
    v[5], v[6] = np.nan, np.inf
    return rng.permutation(v)


def test_merged_parts_equal_the_whole(spark):
    v = values()
    df = spark.createDataFrame(pd.DataFrame({"v": v, "tile": np.arange(len(v)) % 7})).withColumn("v", F.when(F.col("v") > 1e6 + 11, None).otherwise(F.col("v")))
    fine = v[np.isfinite(v) & ~(v > 1e6 + 11)]
    parts = SK.sketch_parts(df, ["v"], ["tile"])
    assert parts.count() == 7
    got = SK.part_stats(SK.merge_parts(parts.drop("tile"))).first()
    assert got["n"] == len(fine) and got["min"] == fine.min() and got["max"] == fine.max()
    assert got["mean"] == pytest.approx(fine.mean(), abs=1e-8) and got["sd"] == pytest.approx(fine.std(), rel=1e-8)
    for name, p in (("q02", 0.02), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q98", 0.98)):
        assert (fine < got[name]).mean() - 2 * SK.RANK_ERROR <= p <= (fine <= got[name]).mean() + 2 * SK.RANK_ERROR


def test_stored_tiles_are_not_computed_again(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    calls = []

    def tile(name, rows):
        def compute():
            calls.append(name)
            return SK.sketch_parts(rows, ["v"])
        return compute

    folder = str(tmp_path / "stats")
    low, high, none = df.filter("v < 50"), df.filter("v >= 50"), df.limit(0)
    assert SK.stored_stats(spark, folder, {"a": tile("a", low), "empty": tile("empty", none)}).select("n", "max").first() == (50, 49.0)
    both = SK.stored_stats(spark, folder, {"a": tile("a", low), "empty": tile("empty", none), "b": tile("b", high)}).first()
    assert (both["n"], both["min"], both["max"], both["mean"]) == (100, 0.0, 99.0, 49.5) and calls == ["a", "empty", "b"]
    assert SK.stored_stats(spark, folder, {"a": tile("a", high)}, "never").select("n", "max").first() == (50, 49.0)
    with pytest.raises(FileNotFoundError):
        SK.stored_stats(spark, folder, {"c": tile("c", low)}, "never")
    assert SK.stored_stats(spark, folder, {"empty": tile("empty", none)}).count() == 0
    with pytest.raises(ValueError):
        SK.stored_stats(spark, folder, {})
