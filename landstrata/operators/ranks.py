"""Whole-table ranks without a single-task sort."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def global_rank(df: DataFrame, order: list[Column], rank: str, total: str | None = None) -> DataFrame:
    """1-based rank over the whole table by ``order`` (must be unique for a stable answer).

    Rows are range-partitioned by the order; each partition is numbered on its own and shifted by the
    row count of the partitions before it.  The partitioning is materialised once, so the counting job
    and the ranking job see the same rows in the same partitions even after a lost executor.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    offsets, run = _offsets(parts, F.count("*"), "bigint")
    w = Window.partitionBy("_part").orderBy(*order)
    out = parts.withColumn("_rn", F.row_number().over(w)).join(offsets, "_part").withColumn(rank, (F.col("_rn") + F.col("_base")).cast("long"))
    if total:
        out = out.withColumn(total, F.lit(run).cast("long"))
    return out.drop("_part", "_base", "_rn")


def _offsets(parts: DataFrame, measure: Column, kind: str) -> tuple[DataFrame, float]:
    """(``_part``, ``_base``): what the partitions before each one add up to, and the sum of all; a row per partition."""
    rows, run = [], 0.0 if kind == "double" else Decimal(0) if kind.startswith("decimal") else 0
    for r in sorted(parts.groupBy("_part").agg(measure.alias("n")).collect()):
        rows.append((r["_part"], run))
        run += r["n"] or 0
    return parts.sparkSession.createDataFrame(rows, f"_part int, _base {kind}"), run


def group_average_rank(df: DataFrame, value: str, rank: str) -> DataFrame:
    """Average rank (ties share the mean of their positions) over the whole table.

    Equal values collapse to one row with a count first, so a value holding a third of the rows is one
    row in the ranking; ranks are prefix sums of the counts.
    """
    groups = df.groupBy(value).agg(F.count("*").alias("_n"))
    cum = global_prefix_sum(groups, [F.col(value)], "_n", "_cum")
    ranks = cum.select(value, (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias(rank))
    return df.join(ranks, value)


def global_prefix_sum(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Running total of ``value`` over the whole table by ``order``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    total = parts.select(F.sum(value).alias("s")).schema["s"].dataType.simpleString()
    offsets, _ = _offsets(parts, F.sum(value), total)
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("_run", F.sum(value).over(w)).join(offsets, "_part").withColumn(out, F.col("_run") + F.col("_base")).drop("_part", "_base", "_run")


def rank_cuts(df: DataFrame, cols: list[str], n: int) -> list[tuple]:
    """Last row of each of the first n-1 equal-count tiles in the order of ``cols`` (unique rows).

    Only the order columns are ranked and only n-1 rows reach the driver, so tiles of a wide table cost one
    narrow sort; the table itself is neither sorted nor copied.
    """
    ranked = global_rank(df.select(*cols), [F.col(c) for c in cols], "_rank", "_total")
    q, rem = F.floor(F.col("_total") / n), F.col("_total") % n
    ends = [(q * i + F.least(rem, F.lit(i))) for i in range(1, n)]
    hit = ranked.filter(F.array_contains(F.array(*ends), F.col("_rank"))).orderBy("_rank")
    rows = [tuple(r[c] for c in cols) for r in hit.collect()]
    return list(dict.fromkeys(rows))


def tile_of(cols: list[str], cuts: list[tuple]) -> Column:
    """1 + number of cut rows before this row in the order of ``cols``."""
    out = F.lit(1)
    for cut in cuts:
        after, equal = F.lit(False), F.lit(True)
        for c, v in zip(cols, cut):
            after = after | (equal & (F.col(c) > F.lit(v)))
            equal = equal & (F.col(c) == F.lit(v))
        out = out + F.when(after, 1).otherwise(0)
    return out


def first_rows(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    """The n first rows in the order of ``cols`` (unique rows), by the rank-n row as a cut: no task gathers the n rows."""
    if n <= 0:
        return df.limit(0)
    ranked = global_rank(df.select(*cols), [F.col(c) for c in cols], "_rank")
    last = ranked.filter(F.col("_rank") == n).first()
    if last is None:
        return df
    before, equal = F.lit(False), F.lit(True)
    for c in cols:
        before = before | (equal & (F.col(c) < F.lit(last[c])))
        equal = equal & (F.col(c) == F.lit(last[c]))
    return df.filter(before | equal)


SALTS = 32  # parts of a partial sum
GROUP_LIMIT = 1000  # Spark trims row_number groups before the shuffle up to this k

def top_per_group(df: DataFrame, k: int, group: list[str], order: list[str]) -> DataFrame:
    """The k first rows of every group.

    Up to ``GROUP_LIMIT`` Spark cuts each task's rows to k per group before shuffling.  For larger k the k-th row of each
    group is found from the range-sorted keys of all groups, so no task gathers a group or k of its rows.
    """
    rn = F.row_number()
    if k > GROUP_LIMIT:
        return _top_of_large_groups(df, k, group, order)
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", rn.over(w)).filter(F.col("_rn") <= k).drop("_rn")


def _top_of_large_groups(df: DataFrame, k: int, group: list[str], order: list[str]) -> DataFrame:
    """Rows of small groups stay; of larger ones those up to the group's k-th row in a global sort by group and order."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("_size"))
    same = [F.col(f"_g{i}").eqNullSafe(F.col(g)) for i, g in enumerate(group)]
    names = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    large = sizes.filter(F.col("_size") > k).select(*names)
    keys = df.select(*group, *order).join(large, condition, "left_semi")
    ranked = global_rank(keys, [F.col(c) for c in [*group, *order]], "_rank")
    first = cut_lineage(ranked.groupBy(*names).agg((F.min("_rank") + k - 1).alias("_last")))
    cut = ranked.join(first, condition).filter(F.col("_rank") == F.col("_last"))
    cut = cut.select(*[f"_g{i}" for i in range(len(group))], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    before, equal = F.lit(False), F.lit(True)
    for i, c in enumerate(order):
        before = before | (equal & (F.col(c) < F.col(f"_o{i}")))
        equal = equal & (F.col(c) == F.col(f"_o{i}"))
    # a row per large group is joined; small groups find none and stay whole
    joined = df.join(cut.withColumn("_cut", F.lit(True)), condition, "left")
    return joined.filter(F.col("_cut").isNull() | before | equal).select(*df.columns)
