"""Imputation, voting and profiles on neighbour lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .neighbors import knn_join
from .quantiles import exact_quantiles, q_name

MAX_CENTROIDS = 2000


def with_response(pairs: DataFrame, refs: DataFrame, key: str, y: str, out: str = "y") -> DataFrame:
    return pairs.join(refs.select(F.col(key).alias("j"), F.col(y).alias(out)), "j")


def knn_regress(pairs: DataFrame, refs: DataFrame, key: str, y: str, k: int | None = None) -> DataFrame:
    """Mean response of the neighbours per query."""
    p = pairs if k is None else pairs.filter(F.col("rank") <= k)
    return with_response(p, refs, key, y).groupBy("i").agg(F.avg("y").alias("pred"))


def knn_vote(pairs: DataFrame, refs: DataFrame, key: str, label: str) -> DataFrame:
    """Majority label per query, smallest label on ties."""
    c = with_response(pairs, refs, key, label).filter("y is not null").groupBy("i", "y").agg(F.count("*").alias("n"))
    return c.groupBy("i").agg(F.min_by("y", F.struct(-F.col("n"), F.col("y"))).alias("vote"))


def knn_purity(pairs: DataFrame, refs: DataFrame, queries: DataFrame, key: str, label: str) -> DataFrame:
    """Share of neighbours with the query's label."""
    p = with_response(pairs, refs, key, label).join(queries.select(F.col(key).alias("i"), F.col(label).alias("q")), "i")
    return p.groupBy("i").agg(F.avg((F.col("y") == F.col("q")).cast("double")).alias("purity"))


def nearest_centroid(df: DataFrame, key: str, vec: str, centroids: DataFrame, ckey: str, cvec: str, same: str | None = None) -> DataFrame:
    """Closest centroid per row, first id on ties; with ``same`` only centroids of the row's own group.

    Up to MAX_CENTROIDS centroids are shipped with the function and rows never shuffle; more are searched like neighbours.
    """
    cols = [ckey, cvec] + ([same] if same else [])
    rows = sorted(centroids.select(*cols).limit(MAX_CENTROIDS + 1).collect(), key=lambda r: r[0])
    if len(rows) > MAX_CENTROIDS:
        near = knn_join(df, centroids, 1, qid=key, rid=ckey, qvec=vec, rvec=cvec, exclude_self=False, within=(same,) if same else ())
        return near.select(F.col("i").alias(key), F.col("j").alias("centroid"), "d")
    ids = np.array([r[0] for r in rows])
    mat = np.array([r[1] for r in rows], dtype=np.float64)
    grp = np.array([r[2] for r in rows]) if same else None
    schema = T.StructType([df.schema[key], T.StructField("centroid", centroids.schema[ckey].dataType), T.StructField("d", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack(pdf["_v"].to_numpy()).astype(np.float64)
            for s in range(0, len(v), 4096):
                part = v[s : s + 4096]
                d2 = np.stack([((part - m) ** 2).sum(1) for m in mat], axis=1)
                if same:
                    d2[pdf["_g"].to_numpy()[s : s + 4096][:, None] != grp[None]] = np.inf
                at = np.round(d2, 9).argmin(1)
                yield pd.DataFrame({key: pdf[key].to_numpy()[s : s + 4096], "centroid": ids[at], "d": np.sqrt(d2[np.arange(len(part)), at])})

    src = df.select(key, F.col(vec).cast("array<double>").alias("_v"), *([F.col(same).alias("_g")] if same else []))
    return src.mapInPandas(run, schema)


def noise_to_nearest(df: DataFrame, key: str, vec: str, label: str, noise: int = 0, out: str = "label_filled", **kw) -> DataFrame:
    """Rows labelled ``noise`` take the label of their nearest labelled row; further arguments go to the search."""
    good, bad = df.filter(F.col(label) != noise), df.filter(F.col(label) == noise)
    nn = knn_join(bad, good, 1, qid=key, rid=key, qvec=vec, rvec=vec, exclude_self=False, **kw)
    filled = nn.join(good.select(F.col(key).alias("j"), F.col(label).alias(out)), "j").select(F.col("i").alias(key), out)
    return df.join(filled, key, "left").withColumn(out, F.coalesce(F.col(out), F.col(label)))


# profiles ------------------------------------------------------------------------------------


def rank_gaps(pairs: DataFrame, refs: DataFrame, queries: DataFrame, key: str, y: str) -> DataFrame:
    """(i, rank, gap): absolute response difference to each neighbour."""
    p = with_response(pairs, refs, key, y).join(queries.select(F.col(key).alias("i"), F.col(y).alias("q")), "i")
    return p.select("i", "rank", F.abs(F.col("y") - F.col("q")).alias("gap"))


def per_rank_profile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean gap per rank of two metrics, their difference and the relative difference of a to b."""
    x = a.groupBy("rank").agg(F.avg("gap").alias("a"))
    y = b.groupBy("rank").agg(F.avg("gap").alias("b"))
    return x.join(y, "rank").withColumns({"gap": F.col("b") - F.col("a"), "delta_pct": F.try_divide(100 * (F.col("a") - F.col("b")), F.col("b"))})


def cumulative_rank_profile(gaps: DataFrame) -> DataFrame:
    """Mean over queries of the running mean over the first r neighbours."""
    w = Window.partitionBy("i").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return gaps.withColumn("_m", F.avg("gap").over(w)).groupBy("rank").agg(F.avg("_m").alias("cumulative"))


def banded_paired_gap(a: DataFrame, b: DataFrame, width: int = 5) -> DataFrame:
    """Per band of ranks the mean paired gap (b - a), its standard error and a 2-SE flag."""
    d = a.withColumnRenamed("gap", "ga").join(b.withColumnRenamed("gap", "gb"), ["i", "rank"])
    d = d.withColumn("band", F.floor((F.col("rank") - 1) / width) + 1)
    per = d.groupBy("i", "band").agg(F.avg(F.col("gb") - F.col("ga")).alias("g"), F.avg("rank").alias("mid"))
    out = per.groupBy("band").agg(F.avg("mid").alias("mid"), F.avg("g").alias("gap"), (F.stddev_samp("g") / F.sqrt(F.count("g"))).alias("se"))
    return out.withColumn("significant", F.abs("gap") > 2 * F.col("se"))


def rank_confused(pairs: DataFrame, confused: str) -> DataFrame:
    """Normalised rank (0 nearest, 1 farthest) of the confused neighbours inside each row of a pair table."""
    n = F.count("*").over(Window.partitionBy("i"))
    r = (F.row_number().over(Window.partitionBy("i").orderBy("d", "j")) - 1) / F.greatest(n - 1, F.lit(1))
    return pairs.withColumn("rank_norm", r).filter(F.col(confused))


def neighbour_crosstab(pairs: DataFrame, refs: DataFrame, queries: DataFrame, key: str, label: str, value: str | None = None) -> DataFrame:
    """Per query class: neighbours, diagonal share, lift over the base share and mean neighbour sd of a value."""
    p = with_response(pairs, refs, key, label).join(queries.select(F.col(key).alias("i"), F.col(label).alias("q")), "i")
    tab = p.groupBy("q", "y").agg(F.count("*").alias("n"))
    tot = tab.agg(F.sum("n")).scalar()
    base = tab.groupBy("y").agg((F.sum("n") / tot).alias("base"))
    diag = tab.groupBy("q").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("q") == F.col("y"), F.col("n")).otherwise(0)) / F.sum("n")).alias("purity"))
    out = diag.join(base.withColumnRenamed("y", "q"), "q", "left").withColumn("lift", F.try_divide(F.col("purity"), F.col("base")))
    if value:
        sd = with_response(pairs, refs, key, value, "v").groupBy("i").agg(F.stddev_samp("v").alias("sd"))
        sd = sd.join(queries.select(F.col(key).alias("i"), F.col(label).alias("q")), "i").groupBy("q").agg(F.avg("sd").alias("neighbour_sd"))
        out = out.join(sd, "q")
    return out


def crosstab_table(pairs: DataFrame, refs: DataFrame, queries: DataFrame, key: str, label: str) -> DataFrame:
    p = with_response(pairs, refs, key, label).join(queries.select(F.col(key).alias("i"), F.col(label).alias("q")), "i")
    return p.groupBy("q", "y").agg(F.count("*").alias("n"))


def neighbour_event_rate(pairs: DataFrame, refs: DataFrame, queries: DataFrame, key: str, y: str, bins: int = 5) -> DataFrame:
    """Mean share of neighbours with y > 0 by bin of the query's own value (0 = zero class), with the lift over the base rate."""
    frac = with_response(pairs, refs, key, y).groupBy("i").agg(F.avg((F.col("y") > 0).cast("double")).alias("frac"))
    base = refs.agg(F.avg((F.col(y) > 0).cast("double"))).scalar()
    q = cut_lineage(queries.select(F.col(key).alias("i"), F.col(y).alias("q")).join(frac, "i"))
    probs = [b / bins for b in range(bins + 1)]
    row = exact_quantiles(q.filter("q > 0"), [], "q", probs).first()
    edges = sorted({row[q_name(p)] for p in probs}) if row else []
    idx = F.lit(1)
    for e in edges[1:-1]:
        idx = idx + F.when(F.col("q") > e, 1).otherwise(0)
    out = q.withColumn("bin", F.when(F.col("q") > 0, idx).otherwise(0)).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("q").alias("q_mean"), F.avg("frac").alias("frac_mean"))
    return out.withColumn("lift", F.col("frac_mean") / base)


# tuning --------------------------------------------------------------------------------------


def predictions_by_k(pairs: DataFrame, refs: DataFrame, key: str, y: str) -> DataFrame:
    """(i, k, pred) for every k up to the largest rank: running means of one neighbour list."""
    w = Window.partitionBy("i").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return with_response(pairs, refs, key, y).select("i", F.col("rank").alias("k"), F.avg("y").over(w).alias("pred"))


def score_by_k(pairs: DataFrame, refs: DataFrame, queries: DataFrame, key: str, y: str, group: list[str] = ()) -> DataFrame:
    """mse and R2 per k from one neighbour search at the largest k."""
    w = Window.partitionBy(*group, "i").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    p = with_response(pairs, refs, key, y).select(*group, "i", F.col("rank").alias("k"), F.avg("y").over(w).alias("pred"))
    p = p.join(queries.select(F.col(key).alias("i"), F.col(y).alias("obs")), "i")
    e = F.col("pred") - F.col("obs")
    return p.groupBy(*group, "k").agg(F.avg(e * e).alias("mse"), (1 - F.try_divide(F.sum(e * e), F.var_pop("obs") * F.count("obs"))).alias("r2"))


def accuracy_by_k(pairs: DataFrame, refs: DataFrame, queries: DataFrame, key: str, label: str, ks: list[int]) -> DataFrame:
    """Vote accuracy for the listed k; one neighbour list is exploded to the k that include each rank."""
    p = with_response(pairs, refs, key, label).withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))))
    c = p.groupBy("i", "k", "y").agg(F.count("*").alias("n"))
    v = c.groupBy("i", "k").agg(F.min_by("y", F.struct(-F.col("n"), F.col("y"))).alias("vote"))
    v = v.join(queries.select(F.col(key).alias("i"), F.col(label).alias("q")), "i")
    return v.groupBy("k").agg(F.avg((F.col("vote") == F.col("q")).cast("double")).alias("accuracy"))


def best_k(scores: DataFrame, metric: str, largest: bool) -> DataFrame:
    o = F.col(metric).desc() if largest else F.col(metric).asc()
    return scores.orderBy(o, "k").limit(1)


def tune_wk(queries: DataFrame, refs: DataFrame, weights: list[float], k: int, key: str, first: str, second: str, y: str, **kw) -> DataFrame:
    """(w, k, mse, r2) for every block weight: one exact neighbour search per weight at the largest k."""
    from ..functions.vectors import weighted_concat

    out = None
    for w in weights:
        vec = weighted_concat(F.col(first), F.col(second), float(w))
        nn = knn_join(queries.withColumn("_v", vec), refs.withColumn("_v", vec), k, qid=key, rid=key, qvec="_v", rvec="_v", exclude_self=False, **kw)
        s = score_by_k(nn, refs, queries, key, y).withColumn("w", F.lit(float(w)))
        out = s if out is None else out.unionByName(s)
    return out
