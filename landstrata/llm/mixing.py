"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Each source has a target in words: its weight's share of all words, at most ``most`` times what the source holds; what a
full source leaves is shared again by weight. A target of several times the source first takes every document that many
times (complete epochs). The remaining words are drawn without replacement: a document's key is an exponential number
divided by its quality weight, documents are put in the order of their keys within the source, and running sums of their
sizes are cut at the words that remain. The document at the cut gives its first words up to the budget, so a source
gives exactly its rounded target.

Sources are ranked and documents sorted by range partitions over the whole table, so a source that holds most of the rows
is spread like any other; running sums are shifted by the totals of the partitions before. The keys are hashes of the
seed and the id, so reruns agree.

Defined cases: a null text holds no words, is given back with size 0 and takes nothing; a null source is one source, last
in the order; a row without id is told apart by its text; repeated rows are drawn one by one; where keys tie the smaller id
comes first; a weight that is null or not above 0 counts as the smallest, ``LEAST``; if no text has words all targets are 0;
other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landstrata.operators.ranks import global_prefix_sum, global_rank
from landstrata.session import scratch_path

from ._joins import shipped_if_small

LEAST = 0.05  # smallest quality weight
DIGITS = 13  # hexadecimal digits of a hash that make a key


def n_words(text: Column) -> Column:
    """Number of runs of other characters than the space, the tab and line breaks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def prose_share(text: Column) -> Column:
    """Share of a text's characters that are neither ASCII digits nor ASCII punctuation, a plain measure of quality; null without text."""
    return F.length(F.regexp_replace(text, r"[!-@\[-`{-~]+", "")) / F.nullif(F.length(text), F.lit(0))


def key(name: Column, weight: Column, seed: int) -> Column:
    """Exponential key of a document; the smallest keys are drawn first, heavier documents rather than lighter ones."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, DIGITS), 16, 10).cast("bigint")
    return -F.log((h + F.lit(0.5)) / F.lit(float(16**DIGITS))) / F.greatest(F.coalesce(weight, F.lit(LEAST)), F.lit(LEAST))


def targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``source, source_size, target``: weights repeat over the sources by code point, null last.

    The level is the target of weight 1. It rises as full sources leave words over, so the sources that are full at a
    level stay so, and each round needs two sums over the sources only.
    """
    ranked = global_rank(sizes, [F.col("source").isNull(), F.col("source")], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    rest, share, n_full = total, None, -1
    while True:
        full = F.lit(False) if share is None else F.col("cap") < F.col("weight") * F.lit(rest) / F.lit(share)
        held, open_weight, n = ranked.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if not open_weight or n == n_full:
            break
        rest, share, n_full = total - (held or 0.0), open_weight, n
    if share is None:  # no sources
        return ranked.select("source", "source_size", F.col("cap").alias("target"))
    level = F.col("weight") * F.lit(rest) / F.lit(share)
    return ranked.select("source", "source_size", F.least("cap", level).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, quality: Column | None = None, seed: int = 1,
        doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row; ``taken`` counts words, repeats included.

    ``quality`` is a weight over the columns of ``docs``; without it all documents are drawn alike.
    """
    spark = docs.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    name = F.coalesce(F.col(doc).cast("string"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    weight = F.lit(1.0) if quality is None else quality.cast("double")
    rows = stored(docs.select(
        F.col(doc).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
        key(name, weight, seed).alias("key"), F.xxhash64(text).alias("text_key")), "sizes")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    run = global_prefix_sum(rows, [F.col(c) for c in ("source", "key", "doc_id", "size", "text_key")], "size", "upto")
    run = stored(run, "running")
    first = run.groupBy("source").agg(F.min(F.col("upto") - F.col("size")).alias("before"))
    named = stored(goals.join(first, goals["source"].eqNullSafe(first["source"])).select(goals["source"].alias("of"), "source_size", "target", "before"), "targets")
    words = F.round("target").cast("bigint")
    out = run.join(shipped_if_small(named), F.col("source").eqNullSafe(F.col("of")))
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("bigint")
    left = words - epochs * F.col("source_size") - (F.col("upto") - F.col("before") - F.col("size"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))
