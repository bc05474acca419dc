"""Error, agreement and detection metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, q_name
from .ranks import global_rank, group_average_rank
from .survey import class_bins


def _errors(pred: Column, obs: Column) -> list[Column]:
    e = pred - obs
    mse, bias = F.avg(e * e), F.avg(e)
    sst = F.var_pop(obs) * F.count(obs)
    return [
        F.count(e).alias("n"), mse.alias("mse"), F.avg(F.abs(e)).alias("mae"), bias.alias("bias"),
        (mse - bias * bias).alias("variance"), F.sqrt(mse).alias("rmse"), (1 - F.try_divide(F.sum(e * e), sst)).alias("r2"),
    ]


def error_metrics(df: DataFrame, pred: str, obs: str, group: list[str] = ()) -> DataFrame:
    ok = df.filter(F.col(pred).isNotNull() & F.col(obs).isNotNull())
    return ok.groupBy(*group).agg(*_errors(F.col(pred), F.col(obs))) if group else ok.agg(*_errors(F.col(pred), F.col(obs)))


def split_population_errors(df: DataFrame, pred: str, obs: str) -> DataFrame:
    """RMSE and R2 over all, positive and zero rows."""
    parts = F.explode(F.array(F.lit("all"), F.when(F.col(obs) > 0, "positive").otherwise("zero")))
    return error_metrics(df.withColumn("population", parts), pred, obs, ["population"]).select("population", "n", "rmse", "r2")


def stratum_errors(df: DataFrame, pred: str, obs: str, n_bins: int = 10) -> DataFrame:
    """Zero class (0) and deciles of the observed values: mean, rmse, bias, n.

    Edges are the positive deciles of all rows (at most ``n_bins`` numbers).
    """
    probs = [i / n_bins for i in range(n_bins + 1)]
    row = exact_quantiles(df, [], obs, probs).first()
    edges = [0.0] + sorted({row[q_name(p)] for p in probs if row[q_name(p)] > 0})
    y = F.col(obs)
    # findInterval with the last interval closed and everything inside
    idx = F.lit(1)
    for e in edges[1:-1]:
        idx = idx + F.when(y >= e, 1).otherwise(0)
    e = F.col(pred) - y
    return df.withColumn("stratum", F.when(y == 0, 0).otherwise(idx)).groupBy("stratum").agg(
        F.count("*").alias("n"), F.avg(obs).alias("mean_y"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def mse_r2_by_channel(df: DataFrame, pairs: dict[str, tuple[str, str]], group: list[str] = ()) -> DataFrame:
    """Per channel mse and R2 from sums; R2 is 0 when SST <= 1e-8."""
    s = F.explode(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(p).cast("double").alias("p"), F.col(o).cast("double").alias("o")) for c, (p, o) in pairs.items()
    ]))
    long = df.select(*group, s.alias("s")).select(*group, "s.*").filter("p is not null and o is not null")
    e = F.col("p") - F.col("o")
    out = long.groupBy(*group, "channel").agg(
        F.count("*").alias("n"), F.sum(e * e).alias("sse"), (F.var_pop("o") * F.count("o")).alias("sst"))
    return out.select(*group, "channel", "n", (F.col("sse") / F.col("n")).alias("mse"),
                      F.when(F.col("sst") <= 1e-8, 0.0).otherwise(1 - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2"))


def within_between_variance(df: DataFrame, cls: list[str], pixel: list[str], channels: list[str]) -> DataFrame:
    """Mean temporal variance, variance of pixel means and the temporal fraction per class and channel."""
    per = df.groupBy(*cls, *pixel).agg(*[F.var_pop(c).alias(f"_v{i}") for i, c in enumerate(channels)],
                                       *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(channels)])
    s = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"_v{i}").alias("v"), F.col(f"_m{i}").alias("m")) for i, c in enumerate(channels)]))
    out = per.select(*cls, s.alias("s")).select(*cls, "s.*").groupBy(*cls, "channel").agg(
        F.count("*").alias("n_pixels"), F.avg("v").alias("within"), F.var_pop("m").alias("between"))
    tot = F.greatest(F.col("within") + F.col("between"), F.lit(1e-12))
    return out.withColumn("temporal_fraction", F.col("within") / tot)


def class_accumulators(df: DataFrame, cls: str, gain: list[str], pred: str, obs: str) -> DataFrame:
    """Per class n, mean and population sd of each gain dimension and the probe R2."""
    e = F.col(pred) - F.col(obs)
    sst = F.greatest(F.var_pop(obs) * F.count(obs), F.lit(1e-12))
    return df.groupBy(cls).agg(
        F.count("*").alias("n"), *[F.avg(g).alias(f"{g}_mean") for g in gain], *[F.stddev_pop(g).alias(f"{g}_sd") for g in gain],
        (1 - F.sum(e * e) / sst).alias("probe_r2"))


def variability_stats(df: DataFrame, cluster: str, temporal_var: str, mean_value: str) -> DataFrame:
    """Per cluster n, mean and quantiles of temporal variance, spatial spread and the temporal fraction."""
    base = df.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(temporal_var).alias("mean_tv"), F.var_samp(mean_value).alias("spatial"))
    q = exact_quantiles(df, [cluster], temporal_var, [0.25, 0.5, 0.75, 0.9])
    out = base.join(q, cluster)
    return out.withColumn("fraction", F.try_divide(F.col("mean_tv"), F.col("mean_tv") + F.col("spatial")))


def recovery_curve(df: DataFrame, cls: str, ysfc: str, edges: list[float], pred: str, obs: str) -> DataFrame:
    """Per class and ysfc bin: n, quartiles of the prediction, median observation."""
    b = df.withColumn("bin", class_bins(ysfc, edges)).filter("bin is not null")
    n = b.groupBy(cls, "bin").agg(F.count("*").alias("n"))
    p = exact_quantiles(b, [cls, "bin"], pred, [0.25, 0.5, 0.75])
    o = exact_quantiles(b, [cls, "bin"], obs, [0.5]).withColumnRenamed("q50", "obs_q50")
    return n.join(p, [cls, "bin"]).join(o, [cls, "bin"])


def ysfc_histogram(df: DataFrame, cls: str, ysfc: str, edges: list[float]) -> DataFrame:
    """Per class and bin: count, density per year, fraction, with the class mean and median."""
    b = df.withColumn("bin", class_bins(ysfc, edges)).filter("bin is not null")
    width = F.element_at(F.array(*[F.lit(float(hi - lo)) for lo, hi in zip(edges[:-1], edges[1:])]), F.col("bin") + 1)
    h = b.groupBy(cls, "bin").agg(F.count("*").alias("n"))
    tot = b.groupBy(cls).agg(F.count("*").alias("class_n"), F.avg(ysfc).alias("mean_ysfc"))
    med = exact_quantiles(b, [cls], ysfc, [0.5]).withColumnRenamed("q50", "median_ysfc")
    out = h.join(tot, cls).join(med, cls)
    return out.withColumns({"density": F.col("n") / F.col("class_n") / width, "fraction": F.col("n") / F.col("class_n")})


def top_classes(df: DataFrame, code: str, k: int) -> DataFrame:
    return df.groupBy(code).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), code).limit(k)


def contingency(df: DataFrame, cluster: str, cls: str, classes: list) -> DataFrame:
    """Cluster x class counts for the named classes, zero-filled."""
    return df.groupBy(cluster).agg(*[F.count_if(F.col(cls) == c).alias(f"class_{c}") for c in classes])


def joint_counts(df: DataFrame, cluster: str, cls: str) -> DataFrame:
    return df.groupBy(F.col(cluster).alias("cluster"), F.col(cls).alias("cls")).agg(F.count("*").cast("double").alias("n"))


def cluster_agreement(df: DataFrame, cluster: str, cls: str) -> DataFrame:
    """NMI (arithmetic mean), homogeneity, completeness, V and purity from the joint counts."""
    j = joint_counts(df, cluster, cls)
    j = j.withColumns({
        "nk": F.sum("n").over(Window.partitionBy("cluster")), "nc": F.sum("n").over(Window.partitionBy("cls")),
        "mk": F.max("n").over(Window.partitionBy("cluster")), "tot": j.agg(F.sum("n")).scalar(),
    })
    # a row (cluster, class) carries its share n/nk of the cluster's entropy term
    s = j.agg(
        F.sum(F.col("n") / F.col("tot") * F.ln(F.col("n") * F.col("tot") / (F.col("nk") * F.col("nc")))).alias("mi"),
        F.sum(-F.col("n") / F.col("tot") * F.ln(F.col("nk") / F.col("tot"))).alias("hk"),
        F.sum(-F.col("n") / F.col("tot") * F.ln(F.col("nc") / F.col("tot"))).alias("hc"),
        F.sum(F.col("n") * F.col("mk") / F.col("nk") / F.col("tot")).alias("purity"),
    )
    hom = F.when(F.col("hc") == 0, 1.0).otherwise(F.try_divide(F.col("mi"), F.col("hc")))
    com = F.when(F.col("hk") == 0, 1.0).otherwise(F.try_divide(F.col("mi"), F.col("hk")))
    s = s.select("purity", "mi", "hk", "hc", hom.alias("homogeneity"), com.alias("completeness"))
    return s.select(
        F.when(F.col("hk") + F.col("hc") == 0, 1.0).otherwise(F.try_divide(2 * F.col("mi"), F.col("hk") + F.col("hc"))).alias("nmi"),
        "homogeneity", "completeness",
        F.coalesce(F.try_divide(2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness")), F.lit(0.0)).alias("v_measure"),
        "purity",
    )


def class_cohesion(df: DataFrame, cluster: str, cls: str) -> DataFrame:
    """One row: share of rows in their class's modal cluster and number of classes in a single cluster."""
    per = joint_counts(df, cluster, cls).groupBy("cls").agg(F.max("n").alias("m"), F.sum("n").alias("t"))
    return per.agg((F.sum("m") / F.sum("t")).alias("cohesion"), F.count_if(F.col("m") == F.col("t")).alias("n_whole"), F.count("*").alias("n_classes"))


def cluster_composition(df: DataFrame, cluster: str, cls: str, top: int = 3) -> DataFrame:
    """Per cluster: n, distinct classes and the names of its ``top`` classes."""
    j = joint_counts(df, cluster, cls)
    r = j.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("n").desc(), "cls")))
    return r.groupBy("cluster").agg(
        F.sum("n").cast("long").alias("n"), F.count("*").alias("n_classes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= top, F.struct("rn", "cls")))), lambda s: s["cls"].cast("string")), ",").alias("top_classes"))


def modal_cluster(df: DataFrame, cluster: str, cls: str) -> DataFrame:
    """Class -> modal cluster with its cohesion."""
    j = joint_counts(df, cluster, cls)
    return j.groupBy("cls").agg(
        F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).alias("cluster"), (F.max("n") / F.sum("n")).alias("cohesion"))


def macro_leakage(df: DataFrame, assigned: str, own: str, group: str | None = None) -> DataFrame:
    leak = F.avg((F.col(assigned) != F.col(own)).cast("double")).alias("leakage")
    return df.groupBy(group).agg(F.count("*").alias("n"), leak) if group else df.agg(F.count("*").alias("n"), leak)


def flag_top(df: DataFrame, score: str, key: str, budget: int, out: str = "flag") -> DataFrame:
    """True for rows scoring at least the ``budget``-th largest score."""
    cut = global_rank(df.select(key, score), [F.col(score).desc(), F.col(key)], "_r").filter(F.col("_r") == budget).select(score).scalar()
    return df.withColumn(out, F.col(score) >= cut)


def detector_metrics(df: DataFrame, flag: str, label: str) -> DataFrame:
    p, y = F.col(flag), F.col(label) == 1
    tp, fp = F.count_if(p & y), F.count_if(p & ~y)
    fn, tn = F.count_if(~p & y), F.count_if(~p & ~y)
    return df.agg(
        F.try_divide(tp + tn, F.count("*")).alias("accuracy"), F.try_divide(tp, tp + fn).alias("sensitivity"),
        F.try_divide(tn, tn + fp).alias("specificity"), F.try_divide(tp, tp + fp).alias("precision"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney AUC from average ranks, one row.

    Scores collapse to (score, positives, total) first, so ties cost one row.
    """
    g = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count("*").alias("_n"))
    from .ranks import global_prefix_sum

    r = global_prefix_sum(g, [F.col(score)], "_n", "_cum")
    rank = F.col("_cum") - (F.col("_n") - 1) / 2.0
    n1, n0 = F.sum("pos"), F.sum(F.col("_n") - F.col("pos"))
    return r.agg(F.try_divide(F.sum(rank * F.col("pos")) - n1 * (n1 + 1) / 2.0, n1 * n0).alias("auc"))


def spearman_rho2(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Squared correlation of positions (ties by key), one row."""
    a = global_rank(df.select(key, x), [F.col(x), F.col(key)], "_rx").select(key, "_rx")
    b = global_rank(df.select(key, y), [F.col(y), F.col(key)], "_ry").select(key, "_ry")
    rho = F.corr(F.col("_rx").cast("double"), F.col("_ry").cast("double"))
    return a.join(b, key).agg((rho * rho).alias("rho2"))


def baselines(df: DataFrame, label: str) -> DataFrame:
    """Majority-class rate, random-neighbour purity and the no-information rate (largest share)."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    tot = c.agg(F.sum("n")).scalar()
    p = F.col("n") / tot
    return c.agg(F.max(p).alias("majority_rate"), F.sum(p * p).alias("random_purity"), F.max(p).alias("no_information_rate"))


def spread_diagnostics(df: DataFrame, patch: list[str], pixel: list[str], year: str, channels: list[str]) -> DataFrame:
    """Per patch and channel: mean temporal sd over pixels and mean spatial sd over years."""
    out = None
    for how, keys in (("temporal", pixel), ("spatial", [year])):
        per = df.groupBy(*patch, *keys).agg(*[F.stddev_pop(c).alias(c) for c in channels])
        s = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels]))
        m = per.select(*patch, s.alias("s")).select(*patch, "s.*").groupBy(*patch, "channel").agg(F.avg("v").alias(f"{how}_sd"))
        out = m if out is None else out.join(m, [*patch, "channel"])
    return out


def response_by_class(df: DataFrame, cls: str, y: str, lo: float, hi: float, nbins: int) -> DataFrame:
    """Per class n, % zero, mean, median and a histogram of the clipped response (bins as columns)."""
    clipped = F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(y)))
    b = F.least(F.lit(nbins - 1), F.floor((clipped - lo) / ((hi - lo) / nbins))).cast("int")
    base = df.withColumn("_b", b).groupBy(cls).agg(
        F.count("*").alias("n"), (100 * F.avg((F.col(y) == 0).cast("double"))).alias("pct_zero"), F.avg(y).alias("mean_y"),
        *[F.count_if(F.col("_b") == i).alias(f"bin_{i}") for i in range(nbins)])
    return base.join(exact_quantiles(df, [cls], y, [0.5]).withColumnRenamed("q50", "median_y"), cls)


def average_rank(df: DataFrame, value: str, rank: str) -> DataFrame:
    return group_average_rank(df, value, rank)
