"""Connected components by contraction: each node goes to its smallest neighbour until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landstrata.session import scratch_path


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` of every node of the edges (a, b); the root is a node of the same component, one for each."""
    spark = edges.sparkSession
    steps = []
    while True:
        path = scratch_path(spark, "edges")
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().write.parquet(path)
        edges = spark.read.parquet(path)
        if edges.isEmpty():
            break
        path = scratch_path(spark, "parents")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root")).write.parquet(path)
        step = spark.read.parquet(path)
        steps.append(step)
        edges = (
            edges.join(step.withColumnsRenamed({"id": "a", "root": "ra"}), "a")
            .join(step.withColumnsRenamed({"id": "b", "root": "rb"}), "b")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        )
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = steps[0]
    for step in steps[1:]:
        after = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
        out = out.join(after, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return out
