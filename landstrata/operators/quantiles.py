"""Exact and sketch quantiles for groups that may hold most of the table.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer.  That is right
for many small groups (a pixel, a plot) and wrong for a channel or class with billions of rows.
``exact_quantiles`` takes two scans instead and shuffles next to nothing: a sketch brackets every wanted
rank, then one aggregation counts rows between the brackets and keeps values only inside them.  Each bracket
is cut into CELLS equal widths; counts say which cell holds the rank, and only that cell's values are sorted.
The counts prove whether the bracket holds the rank; when one does not, or when there are too many groups, the
values are ranked by a distributed sort (``rank_quantiles``).  No task ever holds a whole group or bracket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Quantile names used by the statistics tables.
Q_NAMES = {0.02: "q02", 0.05: "q05", 0.25: "q25", 0.5: "q50", 0.75: "q75", 0.95: "q95", 0.98: "q98"}


def q_name(p: float) -> str:
    return Q_NAMES.get(p, f"q{round(p * 100):02d}")


def rank_ranges(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, _n, _cum): distinct values with counts and running counts inside the group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(g) for g in group] + [F.col(value)]
    parts = cut_lineage(counts.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = parts.withColumn("_cum", F.sum("_n").over(local))
    # partitions x groups, at most shuffle partitions + number of groups rows
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part", *group).agg(F.sum("_n").alias("_s")).withColumn(
        "_off", F.coalesce(F.sum("_s").over(before), F.lit(0))
    ).drop("_s")
    out = _join_null_safe(run, offsets, ["_part", *group])
    return out.select(*group, value, "_n", (F.col("_cum") + F.col("_off")).alias("_cum"))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be NULL; the right side's keys are dropped."""
    right = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    cond = [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys]
    return left.join(right, cond, "inner").drop(*[f"{k}__r" for k in keys])


def rank_quantiles(df: DataFrame, group: list[str], value: str, probs: list[float]) -> DataFrame:
    """Quantiles from the rank range of every distinct value."""
    ranks = rank_ranges(df, group, value)
    totals = ranks.groupBy(*group).agg(F.max("_cum").alias("_total"))
    r = _join_null_safe(ranks, totals, group).withColumn("_v", F.col(value).cast("double"))

    def at(pos: Column) -> Column:
        return F.max(F.when((F.col("_cum") - F.col("_n") <= pos) & (pos < F.col("_cum")), F.col("_v")))

    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("_total") - 1) * F.lit(float(p))
        aggs += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}")]
    out = r.groupBy(*group).agg(F.max("_total").alias("_total"), *aggs)
    cols = []
    for i, p in enumerate(probs):
        h = (F.col("_total") - 1) * F.lit(float(p))
        frac = h - F.floor(h)
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(q_name(p)))
    return out.select(*group, *cols)


ACCURACY = 10_000  # the sketch's rank error is 1/ACCURACY of the group
CELLS = 4096  # of a bracket
MARGIN = 4.0 / ACCURACY
MAX_GROUPS = 20_000


def _brackets(values: list[float], n_probs: int) -> tuple[list[float], list[float]]:
    """Overlapping [lo, hi] pairs merged to disjoint intervals."""
    pairs = sorted((values[2 * i], values[2 * i + 1]) for i in range(n_probs))
    los, his = [pairs[0][0]], [pairs[0][1]]
    for lo, hi in pairs[1:]:
        if lo <= his[-1]:
            his[-1] = max(his[-1], hi)
        else:
            los.append(lo)
            his.append(hi)
    return los, his


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: list[float], method: str = "exact",
                    extra: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Linear-interpolated quantiles (type 7) per group: one row per group, columns q02, q25, ...

    ``extra`` names further aggregates of the value (column ``_v``) with their types; they ride along with the
    first scan.  ``method='approx'`` returns the sketch's own answer after that scan.
    """
    if not group:
        return exact_quantiles(df.withColumn("_g", F.lit(0)), ["_g"], value, probs, method, extra).drop("_g")
    extra = extra or {}
    spark = df.sparkSession
    v = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    riders = [c.alias(n) for n, (c, _) in extra.items()]
    if not probs:
        return v.groupBy(*group).agg(*riders) if riders else v.select(*group).distinct()
    if method == "approx":
        out = v.groupBy(*group).agg(F.percentile_approx("_v", [float(p) for p in probs], 10000).alias("_q"), *riders)
        return out.select(*group, *[F.col("_q")[i].alias(q_name(p)) for i, p in enumerate(probs)], *extra)
    wanted = [x for p in probs for x in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]
    sketch = v.groupBy(*group).agg(F.percentile_approx("_v", wanted, ACCURACY).alias("_q"), F.count("*").alias("_n"), *riders)
    rows = sketch.limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        out = rank_quantiles(df, group, value, probs)
        return _join_null_safe(out, v.groupBy(*group).agg(*riders), group) if riders else out
    fields = [df.schema[g] for g in group]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema = types + "".join(f", {q_name(p)} double" for p in probs) + "".join(f", `{n}` {t}" for n, (_, t) in extra.items())
    if not rows:
        return spark.createDataFrame([], schema)
    plan, ranks = [], {}
    for r in rows:
        key = tuple(r[g] for g in group)
        h = [(r["_n"] - 1) * float(p) for p in probs]
        ranks[key] = [(math.floor(x), math.ceil(x), x - math.floor(x)) for x in h]
        los, his = _brackets(list(r["_q"]), len(probs))
        plan.append((*key, los, his, sorted({i for lo, hi, _ in ranks[key] for i in (lo, hi)})))
    # at most MAX_GROUPS short rows; Spark does not know the size of rows that Python made, so without the hint all values
    # would be shuffled to a task per group
    small = spark.createDataFrame(plan, types + ", _los array<double>, _his array<double>, _ranks array<bigint>")
    j = _join_null_safe(v, F.broadcast(small.drop("_ranks")), group)
    # brackets passed and bracket hit, as plain comparisons that stay inside generated code
    most = max(len(p[-3]) for p in plan)
    past = [F.coalesce((F.get("_his", F.lit(i)) < F.col("_v")).cast("int"), F.lit(0)) for i in range(most)]
    k = sum(past[1:], past[0])
    hit = [F.coalesce(F.col("_v").between(F.get("_los", F.lit(i)), F.get("_his", F.lit(i))), F.lit(False)) for i in range(most)]
    inside = hit[0]
    for h in hit[1:]:
        inside = inside | h
    t = j.select(*group, "_v", "_los", "_his", k.alias("_k"), inside.alias("_in"))
    low, high = F.get("_los", F.col("_k")), F.get("_his", F.col("_k"))
    at = F.coalesce(F.floor(F.try_divide(F.col("_v") - low, high - low) * CELLS), F.lit(0))
    t = t.select(*group, "_k", "_in", F.when(F.col("_in"), F.least(at, F.lit(CELLS - 1))).otherwise(-1).alias("_b"), F.when(F.col("_in"), F.col("_v")).alias("_v"))
    t = cut_lineage(t.groupBy(*group, "_k", "_in", "_b", "_v").agg(F.count("*").alias("_n")))  # a small share of the rows
    # rows before each cell: at most CELLS + 1 cells per group and bracket
    before = Window.partitionBy(*group).orderBy("_k", "_in", "_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = t.groupBy(*group, "_k", "_in", "_b").agg(F.sum("_n").alias("_s")).withColumn("_off", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    cells = _join_null_safe(cells, small.select(*group, "_ranks"), group)
    cells = cells.filter(F.col("_in") & F.exists("_ranks", lambda x: (x >= F.col("_off")) & (x < F.col("_off") + F.col("_s"))))
    inside_cell = Window.partitionBy(*group, "_k", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    t = _join_null_safe(t.filter("_in"), cells.select(*group, "_k", "_b", "_off", "_ranks"), [*group, "_k", "_b"])
    t = t.withColumn("_cum", F.col("_off") + F.sum("_n").over(inside_cell))
    hits = t.filter(F.exists("_ranks", lambda x: (x < F.col("_cum")) & (x >= F.col("_cum") - F.col("_n"))))
    found: dict[tuple, list] = {}
    for r in hits.select(*group, "_v", "_n", "_cum").collect():  # at most two rows per group and probability
        found.setdefault(tuple(r[g] for g in group), []).append((r["_cum"] - r["_n"], r["_cum"], r["_v"]))

    def value_at(key: tuple, i: int) -> float:
        return next(x for lo, hi, x in found[key] if lo <= i < hi)

    out = []
    try:
        for r in rows:
            key = tuple(r[g] for g in group)
            qs = []
            for lo, hi, frac in ranks[key]:
                a, b = value_at(key, lo), value_at(key, hi)
                qs.append(a + (b - a) * frac)
            out.append((*key, *qs, *[r[n] for n in extra]))
    except (StopIteration, KeyError):
        # a bracket missed its rank
        out = rank_quantiles(df, group, value, probs)
        return _join_null_safe(out, v.groupBy(*group).agg(*riders), group) if riders else out
    return spark.createDataFrame(out, schema)
