"""Code-confusion graph as coordinate tables (a, b, n).

A code list has at most a few hundred entries, so every table here is small; results that later steps read
several times are materialised once, which keeps the scans behind the confusion counts from running again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_CODES = 2000


def confusion_combine(x: DataFrame, y: DataFrame) -> DataFrame:
    """Sum of two tables over the union of their codes; missing cells are 0 (absent)."""
    return x.select("a", "b", "n").unionByName(y.select("a", "b", "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def confusion_summary(c: DataFrame) -> DataFrame:
    """Row totals and % agreement per row (0 for an empty row)."""
    t = F.sum("n")
    agree = F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0))
    return c.groupBy("a").agg(t.alias("row_total"), F.when(t == 0, 0.0).otherwise(F.try_divide(100 * agree, t)).alias("pct_agreement"))


def filter_codes(conf: DataFrame, counts: DataFrame, code: str, n: str, min_count: float, min_samples: float) -> DataFrame:
    """Codes of the confusion table with enough pixels and a large enough row among the kept codes."""
    known = conf.select(F.col("a").alias(code)).distinct().join(counts.filter(F.col(n) >= min_count).select(code, n), code)
    inside = conf.join(known.select(F.col(code).alias("a")), "a", "left_semi").join(known.select(F.col(code).alias("b")), "b", "left_semi")
    rows = inside.groupBy(F.col("a").alias(code)).agg(F.sum("n").alias("row_sum"))
    out = cut_lineage(known.join(rows, code, "left").fillna(0.0, subset=["row_sum"]).filter(F.col("row_sum") >= min_samples))
    k = out.count()
    if k < 2:
        raise ValueError(f"fewer than 2 codes survive (min_count={min_count}, min_samples={min_samples})")
    if k > MAX_CODES:
        raise ValueError(f"{k} codes; at most {MAX_CODES}")
    return out


def _all_cells(codes: DataFrame, code: str) -> DataFrame:
    """Every (a, b) of the checked code list."""
    listed = codes.agg(F.array_sort(F.collect_set(code))).scalar()
    return codes.select(F.col(code).alias("a")).distinct().withColumn("b", F.explode(listed))


def _row_normalise(cells: DataFrame, value: str, n_codes: Column) -> DataFrame:
    """Rows sum to 1; an empty row becomes uniform."""
    t = F.sum(value).over(Window.partitionBy("a"))
    return cells.withColumn("p", F.when(t > 0, F.try_divide(F.col(value), t)).otherwise(1.0 / n_codes)).select("a", "b", "p")


def transition_matrix(conf: DataFrame, codes: DataFrame, code: str, laplace: float = 0.0) -> DataFrame:
    """(a, b, p) for every pair of codes: symmetrised counts plus smoothing, row-normalised."""
    cells = _all_cells(codes, code)
    sym = conf.select("a", "b", "n").unionByName(conf.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    sym = sym.groupBy("a", "b").agg((F.sum("n") / 2.0).alias("n"))
    c = cells.join(sym, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)) + laplace)
    return cut_lineage(_row_normalise(c, "n", codes.agg(F.countDistinct(code)).scalar()))


def diffuse(p: DataFrame, k: int) -> DataFrame:
    """P^k by k-1 sparse products; each is an equi-join on the middle code."""
    out, base = p, p.filter("p <> 0")
    for _ in range(k - 1):
        left = out.filter("p <> 0").select("a", F.col("b").alias("m"), F.col("p").alias("x"))
        right = base.select(F.col("a").alias("m"), "b", F.col("p").alias("y"))
        prod = left.join(right, "m").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("p"))
        out = cut_lineage(p.select("a", "b").join(prod, ["a", "b"], "left").fillna(0.0, subset=["p"]))
    return out


def binarise(p: DataFrame, threshold: float) -> DataFrame:
    """Entries above the threshold share their row equally; the diagonal is dropped; empty rows are uniform."""
    b = p.withColumn("_x", F.when((F.col("p") > threshold) & (F.col("a") != F.col("b")), 1.0).otherwise(0.0))
    return _row_normalise(b, "_x", p.agg(F.countDistinct("a")).scalar())


def reference_distance(pairs: DataFrame, sim: DataFrame, code_i: str = "code_i", code_j: str = "code_j") -> DataFrame:
    """1 - S for the codes of each pair, 1 for unknown codes, plus ``valid_ref``."""
    s = sim.select(F.col("a").alias(code_i), F.col("b").alias(code_j), F.col("p").alias("_s"))
    out = pairs.join(s, [code_i, code_j], "left")
    return out.withColumns({"d_ref": 1.0 - F.coalesce("_s", F.lit(0.0)), "valid_ref": F.col("_s").isNotNull()}).drop("_s")


#: Upper ends of the shares of log(K-1), and what a sharpness below them is called; the last has none.
VERDICTS = ((20.0, "too peaked"), (35.0, "sharp"), (65.0, "good range"), (80.0, "soft"), (None, "too flat"))


def tau_sweep(sim: DataFrame, taus: list[float], verdicts: tuple = VERDICTS) -> DataFrame:
    """Per tau the mean entropy of softmax(-(1-S)/tau) over other codes, its % of log(K-1) and a verdict."""
    t = sim.filter(F.col("a") != F.col("b")).withColumn("tau", F.explode(F.array(*[F.lit(float(x)) for x in taus])))
    t = t.withColumn("z", -(1 - F.col("p")) / F.col("tau"))
    w = Window.partitionBy("tau", "a")
    t = t.withColumn("m", F.max("z").over(w))
    row = t.groupBy("tau", "a").agg(F.first("m").alias("m"), F.sum(F.exp(F.col("z") - F.col("m"))).alias("s"),
                                    F.sum(F.exp(F.col("z") - F.col("m")) * F.col("z")).alias("sz"))
    h = row.withColumn("h", F.col("m") + F.ln("s") - F.col("sz") / F.col("s"))
    k = sim.agg(F.countDistinct("a")).scalar()
    out = h.groupBy("tau").agg(F.avg("h").alias("entropy")).withColumn("pct_of_max", 100 * F.col("entropy") / F.ln(k - 1))
    below = [F.when(F.col("pct_of_max") <= end, name) for end, name in verdicts if end is not None]
    return out.withColumn("verdict", F.coalesce(*below, F.lit(verdicts[-1][1])))


def graph_diagnostics(conf: DataFrame, p1: DataFrame, pk: DataFrame) -> DataFrame:
    """One row: off-diagonal non-zero share of P and P^k, mean confused codes per row, mean off-diagonal mass of the counts."""
    def share(p: DataFrame) -> Column:
        off = p.filter(F.col("a") != F.col("b"))
        return off.agg((100 * F.avg((F.col("p") > 0).cast("double")))).scalar()

    codes = p1.select("a").distinct()
    inside = conf.join(codes, "a", "left_semi").join(codes.withColumnRenamed("a", "b"), "b", "left_semi")
    off = (F.col("a") != F.col("b")) & (F.col("n") > 0)
    per = inside.groupBy("a").agg(F.count_if(off).alias("confused"), F.try_divide(F.sum(F.when(off, F.col("n")).otherwise(0.0)), F.sum("n")).alias("off_mass"))
    return codes.join(per, "a", "left").agg(
        F.avg(F.coalesce("confused", F.lit(0))).alias("mean_confused"), F.avg("off_mass").alias("mean_off_mass"), F.count("*").alias("n_codes"),
    ).withColumns({"pct_nonzero_1": share(p1), "pct_nonzero_k": share(pk)})


def row_sum_histogram(conf: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width histogram of the row sums (one number per code)."""
    r = conf.groupBy("a").agg(F.sum("n").alias("s"))
    lim = r.agg(F.struct(F.min("s").alias("lo"), F.max("s").alias("hi"))).scalar()
    width = (F.col("_l.hi") - F.col("_l.lo")) / bins
    b = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("s") - F.col("_l.lo"), width)), F.lit(0)))
    return r.withColumn("_l", lim).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
