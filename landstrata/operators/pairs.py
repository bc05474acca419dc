"""Neighbour pairs and what is built from them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut_lineage
from .bands import band_pairs
from .neighbors import DIGITS, block_product, finite_vectors, knn_join, radius_join
from .products import inner_product_join
from .quantiles import exact_quantiles, q_name
from .stats import with_row

LANDMARKS = 1000  # so many are shipped with the function; more meet the rows in blocks


def _distances(v: np.ndarray, mat: np.ndarray, metric: str) -> np.ndarray:
    """Rectangular distances by one formula, in slices of bounded size."""
    if metric == "cosine":
        return 1 - (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (mat / np.linalg.norm(mat, axis=1, keepdims=True)).T
    if metric not in ("l1", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    out = np.empty((len(v), len(mat)))
    step = max(1, 4_000_000 // max(1, mat.size))
    for s in range(0, len(v), step):
        diff = v[s : s + step, None, :] - mat[None]
        out[s : s + step] = np.sqrt((diff * diff).sum(2)) if metric == "l2" else np.abs(diff).sum(2)
    return out


def pairwise_distance(df: DataFrame, key: str, vec: str, landmarks: DataFrame, lkey: str, lvec: str, metric: str = "l2",
                      shipped: int = LANDMARKS) -> DataFrame:
    """Rectangular distance table of all rows against a list of landmarks (centroids, codes, reference series).

    Up to ``shipped`` landmarks go with the function and the rows don't shuffle; more of them meet the rows in blocks.
    Its size is rows times landmarks, as asked; for nearest ones only use ``knn_join`` or ``radius_join``.
    """
    if metric not in ("l1", "l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    rows = landmarks.select(lkey, F.col(lvec).cast("array<double>")).limit(shipped + 1).collect()
    ltype = landmarks.schema[lkey].dataType.simpleString()
    ktype = df.schema[key].dataType.simpleString()
    src = finite_vectors(df.select(F.col(key).alias("_q"), F.col(vec).cast("array<double>").alias("_qv")), "_qv")
    schema = f"i {ktype}, j {ltype}, d double"

    def table(ids, v, names, mat):
        return pd.DataFrame({"i": np.repeat(ids, len(names)), "j": np.tile(names, len(ids)), "d": _distances(v, mat, metric).ravel()})

    if len(rows) > shipped:
        refs = finite_vectors(landmarks.select(F.col(lkey).alias("_r"), F.col(lvec).cast("array<double>").alias("_rv")), "_rv")

        def kernel(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(r):
                return pd.DataFrame({"i": q["_q"].iloc[:0], "j": r["_r"].iloc[:0], "d": np.array([], dtype=float)})
            return table(q["_q"].to_numpy(), np.stack(q["_qv"].to_numpy()), r["_r"].to_numpy(), np.stack(r["_rv"].to_numpy()))

        return block_product(src, refs, kernel, schema, refs.count(), shipped, shipped, 0)  # a block returns all its pairs, so none grows
    ids, mat = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)

    def run(batches):
        for pdf in batches:
            if len(pdf) and len(ids):
                yield table(pdf["_q"].to_numpy(), np.stack(pdf["_qv"].to_numpy()).astype(np.float64), ids, mat)

    return src.mapInPandas(run, schema)


def pair_distance(pairs: DataFrame, vectors: DataFrame, key: str, vec: str, out: str = "d") -> DataFrame:
    """Distance of listed pairs: two equi-joins, then an expression."""
    v = vectors.select(F.col(key).alias("_k"), F.col(vec).cast("array<double>").alias("_v"))
    p = pairs.join(v.withColumnsRenamed({"_k": "i", "_v": "_vi"}), "i").join(v.withColumnsRenamed({"_k": "j", "_v": "_vj"}), "j")
    return p.withColumn(out, F.round(V.l2_distance("_vi", "_vj"), DIGITS)).drop("_vi", "_vj")


def knn_pairs(df: DataFrame, k: int, key: str = "id", vec: str = "z", anchors: DataFrame | None = None, **kw) -> DataFrame:
    """k nearest targets per anchor, self excluded; ``anchors`` may be a subset or another table."""
    return knn_join(anchors if anchors is not None else df, df, k, qid=key, rid=key, qvec=vec, rvec=vec, **kw)


def mutual(pairs: DataFrame) -> DataFrame:
    """Pairs present in both directions.  One shuffle on the unordered pair instead of a self join."""
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    both = pairs.filter(F.col("i") != F.col("j")).groupBy(lo.alias("_a"), hi.alias("_b")).agg(F.collect_set(F.struct("i", "j", "d", "rank")).alias("_s"))
    return both.filter(F.size("_s") == 2).select(F.explode("_s").alias("p")).select("p.*")


def mutual_knn_pairs(df: DataFrame, k: int, key: str = "id", vec: str = "z", **kw) -> DataFrame:
    return mutual(knn_pairs(df, k, key, vec, **kw))


def _far_enough(min_spatial: float, same_patch_only: bool):
    def far(q, r) -> np.ndarray:
        d = np.hypot(q("q_row", float) - r("r_row", float), q("q_col", float) - r("r_col", float))
        ok = d >= min_spatial
        if same_patch_only:
            ok |= q("q_patch") != r("r_patch")
        return ok

    def allow(q: pd.DataFrame, r: pd.DataFrame) -> np.ndarray:
        return far(lambda c, kind=None: q[c].to_numpy(kind)[:, None], lambda c, kind=None: r[c].to_numpy(kind)[None])

    allow.listed = lambda q, r: far(lambda c, kind=None: q[c].to_numpy(kind), lambda c, kind=None: r[c].to_numpy(kind))
    return allow


def _cells_within(radius: float) -> int:
    """Grid cells closer than ``radius`` to a cell, itself included."""
    r = int(math.ceil(radius))
    return sum(1 for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b < radius * radius)


def knn_pairs_spatial(df: DataFrame, k: int, min_spatial: float, key: str = "id", vec: str = "z", row: str = "row", col: str = "col",
                      patch: str | None = None, **kw) -> DataFrame:
    """kNN among pixels at least ``min_spatial`` apart; with ``patch`` only pairs of one patch are restricted.

    On a grid a pixel can lose at most the cells inside the circle, times the most vectors that share a cell (counted
    once), which keeps pruning exact.
    """
    most = df.groupBy(row, col).count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    d = df.withColumns({"row": F.col(row), "col": F.col(col)})
    extra = ("row", "col")
    if patch is not None:
        d, extra = d.withColumn("patch", F.col(patch)), ("row", "col", "patch")
    return knn_join(d, d, k, qid=key, rid=key, qvec=vec, rvec=vec, q_extra=extra, r_extra=extra, allow=_far_enough(min_spatial, patch is not None),
                    max_excluded=_cells_within(min_spatial) * most, **kw)


def mutual_knn_blocked(df: DataFrame, k: int, min_spatial: float, patch: str, key: str = "id", vec: str = "z", row: str = "row", col: str = "col", **kw) -> DataFrame:
    return mutual(knn_pairs_spatial(df, k, min_spatial, key, vec, row, col, patch, **kw))


def quantile_pairs(pairs: DataFrame, low: float, high: float, d: str = "d") -> DataFrame:
    """Pairs with q_low <= d < q_high over all distances of the given pairs."""
    pairs = cut_lineage(pairs)  # read for the quantiles and again for the filter
    q = exact_quantiles(pairs, [], d, [low, high])
    lim = q.select(F.struct(F.col(q_name(low)).alias("lo"), F.col(q_name(high)).alias("hi"))).scalar()
    return pairs.withColumn("_q", lim).filter((F.col(d) >= F.col("_q.lo")) & (F.col(d) < F.col("_q.hi"))).drop("_q")


def radius_pairs(df: DataFrame, min_d: float, max_d: float, key: str = "id", vec: str = "z", **kw) -> DataFrame:
    return radius_join(df, df, min_d, max_d, qid=key, rid=key, qvec=vec, rvec=vec, **kw)


def spatially_constrained_pairs(df: DataFrame, k: int, candidates: DataFrame | None = None, key: str = "id", vec: str = "z", row: str = "row", col: str = "col",
                                strategy: str = "mutual-knn", pos_min: float = 4.0, neg_min: float = 8.0, low: float = 0.5, high: float = 0.75,
                                within: tuple[str, ...] = (), **kw) -> tuple[DataFrame, DataFrame]:
    """Positives: (mutual) kNN at least ``pos_min`` apart.  Negatives: the quantile band of all pairs at least
    ``neg_min`` apart, or of the ``candidates`` (i, j) among them.  ``within`` keeps both to pairs of one key."""
    pos = knn_pairs_spatial(df, k, pos_min, key, vec, row, col, within=within, **kw)
    if strategy == "mutual-knn":
        pos = mutual(pos)
    elif strategy != "knn":
        raise ValueError(f"unknown strategy {strategy!r}")
    if candidates is None:
        d = df.withColumns({"row": F.col(row), "col": F.col(col)})
        return pos, band_pairs(d, low, high, key, vec, within, ("row", "col"), _far_enough(neg_min, False))
    at = df.select(F.col(key).alias("_k"), F.col(row).cast("double").alias("_r"), F.col(col).cast("double").alias("_c"))
    c = pair_distance(candidates.select("i", "j"), df, key, vec)
    c = c.join(at.withColumnsRenamed({"_k": "i", "_r": "ri", "_c": "ci"}), "i").join(at.withColumnsRenamed({"_k": "j", "_r": "rj", "_c": "cj"}), "j")
    c = c.filter(F.hypot(F.col("ri") - F.col("rj"), F.col("ci") - F.col("cj")) >= neg_min).select("i", "j", "d")
    return pos, quantile_pairs(c, low, high)


def symmetric_pairs(pairs: DataFrame, anchors: DataFrame, key: str = "id") -> DataFrame:
    """Add the reverse of pairs whose target is an anchor; duplicates stay."""
    a = anchors.select(F.col(key).alias("j")).distinct()
    back = pairs.join(a, "j", "left_semi")
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    return pairs.select("i", "j", *rest).unionByName(back.select(F.col("j").alias("i"), F.col("i").alias("j"), *rest))


def pair_weights(d, tau: float, kind: str, min_w: float = 0.05) -> Column:
    """exp(-d/tau) for positives, 1 - exp(-d/tau) for negatives, clamped to [min_w, 1]."""
    d = F.col(d) if isinstance(d, str) else d
    w = F.exp(-d / tau) if kind == "positive" else 1.0 - F.exp(-d / tau)
    return F.greatest(F.lit(min_w), F.least(F.lit(1.0), w))


# ysfc ----------------------------------------------------------------------------------------


def ysfc_sets(series: DataFrame, key: str, ysfc: str) -> DataFrame:
    """Sorted distinct ysfc values per pixel (at most one per year)."""
    return series.filter(F.col(ysfc).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(ysfc)).alias("_set"))


def ysfc_overlap(pairs: DataFrame, series: DataFrame, key: str, ysfc: str) -> DataFrame:
    """Shared distinct ysfc values of each pair: ``shared`` (sorted) and ``overlap`` (their number)."""
    s = ysfc_sets(series, key, ysfc)
    p = pairs.join(s.withColumnsRenamed({key: "i", "_set": "_si"}), "i").join(s.withColumnsRenamed({key: "j", "_set": "_sj"}), "j")
    return p.withColumn("shared", F.array_sort(F.array_intersect("_si", "_sj"))).withColumn("overlap", F.size("shared")).drop("_si", "_sj")


def phase_pairs(df: DataFrame, series: DataFrame, key: str, vec: str, ysfc: str, k: int = 16, min_overlap: int = 3, min_pairs: int = 5,
                include_self: bool = True, sigma: float = 5.0, self_weight: float = 1.0, **kw) -> DataFrame:
    """(i, j, d, overlap, w): kNN pairs with enough shared ysfc values, anchors with enough pairs, self pairs.

    Further arguments go to the search: ``within=("patch",)`` pairs rows of one patch only."""
    cand = knn_pairs(df, k, key, vec, **kw).select("i", "j", "d")
    ok = ysfc_overlap(cand, series, key, ysfc).filter(F.col("overlap") >= min_overlap).drop("shared")
    kept = ok.withColumn("_n", F.count("*").over(Window.partitionBy("i"))).filter(F.col("_n") >= min_pairs).drop("_n")
    cross = kept.withColumn("w", F.exp(-F.col("d") / sigma)).select("i", "j", "d", "overlap", "w")
    if not include_self:
        return cross
    # one self pair per surviving anchor comes from its own rows, no second pass over the pairs
    first = F.row_number().over(Window.partitionBy("i").orderBy("j")) == 1
    items = F.when(first, F.array(F.struct("j", "d", "overlap", "w"), F.struct(
        F.col("i").alias("j"), F.lit(0.0).alias("d"), F.lit(None).cast("int").alias("overlap"), F.lit(float(self_weight)).alias("w")))).otherwise(
        F.array(F.struct("j", "d", "overlap", "w")))
    return cross.withColumn("_x", items).select("i", F.explode("_x").alias("x")).select("i", "x.*")


def phase_pair_stats(pairs: DataFrame) -> DataFrame:
    """Counts and distribution of the surviving pairs, one row."""
    pairs = cut_lineage(pairs)
    cross = pairs.filter(F.col("i") != F.col("j"))
    base = pairs.agg(
        F.countDistinct("i").alias("n_anchors_surviving"), F.count_if(F.col("i") == F.col("j")).alias("n_self_pairs"), F.count("*").alias("n_total_pairs"),
        F.avg("overlap").alias("overlap_mean"), F.min("overlap").alias("overlap_min"),
        F.avg(F.when(F.col("i") != F.col("j"), F.col("w"))).alias("weight_mean"), F.stddev_samp(F.when(F.col("i") != F.col("j"), F.col("w"))).alias("weight_std"),
    )
    return with_row(base, exact_quantiles(cross, [], "d", [0.25, 0.5, 0.75]))


def selected_steps(runs: DataFrame, key: str, year: str, ysfc: str, spec: list[str], phase: list[str]) -> DataFrame:
    """One row per pixel: map from ysfc to the vectors of its selected step (longest run, then latest)."""
    from .timeseries import best_step_per_ysfc

    best = best_step_per_ysfc(runs, [key], year, ysfc)
    entry = F.struct(F.col(ysfc), F.struct(F.array(*[F.col(c).cast("double") for c in spec]).alias("spec"), F.array(*[F.col(c).cast("double") for c in phase]).alias("phase")))
    return best.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("steps"))


def aligned_pair_distances(pairs: DataFrame, steps: DataFrame, key: str, min_overlap: int = 3) -> DataFrame:
    """One row per (pair, a, b) of shared ysfc values with all five distances.

    ref_self is measured on j, learned_self on i, learned_self_j on j, and the cross distances between i and
    j; a pair has at most one entry per year on each axis.
    """
    s = steps.select(F.col(key).alias("_k"), "steps")
    p = pairs.join(s.withColumnsRenamed({"_k": "i", "steps": "_mi"}), "i").join(s.withColumnsRenamed({"_k": "j", "steps": "_mj"}), "j")
    p = p.withColumn("_sh", F.array_sort(F.array_intersect(F.map_keys("_mi"), F.map_keys("_mj")))).filter(F.size("_sh") >= min_overlap)
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    p = p.withColumn("a", F.explode("_sh")).withColumn("b", F.explode("_sh"))

    def at(m: str, y: str, f: str) -> Column:
        return F.element_at(F.col(m), F.col(y))[f]

    return p.select(
        "i", "j", *rest, "a", "b", F.size("_sh").alias("n_shared"), (F.col("a") != F.col("b")).alias("mask_self"),
        V.l2_distance(at("_mj", "a", "spec"), at("_mj", "b", "spec")).alias("d_ref_self"),
        V.l2_distance(at("_mi", "a", "phase"), at("_mi", "b", "phase")).alias("d_learned_self"),
        V.l2_distance(at("_mj", "a", "phase"), at("_mj", "b", "phase")).alias("d_learned_self_j"),
        V.l2_distance(at("_mi", "a", "spec"), at("_mj", "b", "spec")).alias("d_ref_cross"),
        V.l2_distance(at("_mi", "a", "phase"), at("_mj", "b", "phase")).alias("d_learned_cross"),
    )


# projections ---------------------------------------------------------------------------------


def top_projection(df: DataFrame, vec: str, dim: int, rank: int) -> np.ndarray:
    """Mean and scaled principal directions: rows of X_centred @ P are the leading left singular vectors."""
    from .fit import moment_matrix

    n, mean, cov = moment_matrix(df, vec, dim)
    val, eig = np.linalg.eigh(cov)
    order = np.argsort(val)[::-1][:rank]
    top = eig[:, order]
    # a fixed sign makes the projection reproducible
    top = top * np.where(top[np.abs(top).argmax(0), np.arange(rank)] < 0, -1.0, 1.0)
    return mean, top / np.sqrt(np.maximum(val[order] * (n - 1), 1e-300))


def baseline_demean_by_neighbours(df: DataFrame, key: str, vec: str, dim: int, channels: list[str], rank: int = 8, k: int = 20,
                                  projection: tuple[np.ndarray, np.ndarray] | None = None, **kw) -> DataFrame:
    """Channels minus their mean over the k rows most similar (inner product) in a rank-K projection.

    ``projection`` is (mean, matrix of one column a component); by default the leading principal directions of the rows.
    """
    mean, proj = projection if projection is not None else top_projection(df, vec, dim, rank)
    p = df.withColumn("_p", V.linear_map(F.zip_with(F.col(vec).cast("array<double>"), V.literal_vector(mean), lambda x, m: x - m), proj.T))
    p = cut_lineage(p.select(key, "_p"))
    nn = inner_product_join(p, p, k, qid=key, rid=key, qvec="_p", rvec="_p", **kw)
    vals = df.select(F.col(key).alias("j"), *channels)
    base = nn.join(vals, "j").groupBy(F.col("i").alias(key)).agg(*[F.avg(c).alias(f"{c}_base") for c in channels])
    return df.join(base, key).withColumns({f"{c}_demeaned": F.col(c) - F.col(f"{c}_base") for c in channels})
