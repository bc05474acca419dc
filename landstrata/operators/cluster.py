"""Mixtures, k-means, silhouettes, Ward cuts of centroids, density clusters and strata built from them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .knn import nearest_centroid, noise_to_nearest
from .neighbors import _exact, _pair_schema, _side, _stack, _cell_join, block_product, knn_join, MAX_PIVOTS, QUERY_BLOCK, REF_BLOCK
from .pairmetrics import class_distance_profile
from .quantiles import exact_quantiles, q_name
from .ranks import global_rank
from .sample import reservoir, seeded
from .spanning import connected_components, density_components, density_links  # noqa: F401
from .survey import pooled_within

MAX_CLASSES = 2000


def group_means(df: DataFrame, group: str, vec: str, dim: int) -> DataFrame:
    """(group, n, v): mean vector per group."""
    x = F.col(vec)
    g = df.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(x[i]).alias(f"_m{i}") for i in range(dim)])
    return g.select(group, "n", F.array(*[f"_m{i}" for i in range(dim)]).alias("v"))


def _bounded_rows(df: DataFrame, what: str) -> list:
    rows = df.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} {what}")
    return rows


def compactness(df: DataFrame, label: str, vec: str, dim: int, reference: float | None = None) -> DataFrame:
    """Mean squared distance to the own cluster's centroid, and its ratio to a reference value."""
    x = F.col(vec)
    per = df.groupBy(label).agg(F.count("*").alias("n"), *[F.var_pop(x[i]).alias(f"_v{i}") for i in range(dim)])
    total = sum((F.col(f"_v{i}") for i in range(1, dim)), F.col("_v0"))
    out = per.agg((F.sum(F.col("n") * total) / F.sum("n")).alias("compactness"))
    return out.withColumn("ratio", F.col("compactness") / F.lit(reference)) if reference else out


# k-means -------------------------------------------------------------------------------------


def kmeans(df: DataFrame, key: str, vec: str, k: int, seed: int = 1, n_init: int = 1, max_iter: int = 50, out: str = "cluster") -> tuple[DataFrame, np.ndarray, float]:
    """Lloyd from k-means|| starts; clusters are numbered by their first coordinate.  Returns rows, centres, cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    src = df.select(key, F.col(vec).cast("array<double>").alias("_x")).withColumn("_f", array_to_vector("_x"))
    best = None
    for i in range(n_init):
        m = KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="_f").fit(src)
        if best is None or m.summary.trainingCost < best.summary.trainingCost:
            best = m
    centres = np.array(best.clusterCenters())
    order = np.lexsort(centres.T[::-1])
    rank = F.array(*[F.lit(int(np.flatnonzero(order == c)[0])) for c in range(len(centres))])
    lab = best.transform(src).select(key, F.element_at(rank, F.col("prediction") + 1).alias(out))
    return df.join(lab, key), centres[order], float(best.summary.trainingCost)


# mixtures ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mixture:
    """Gaussian mixture; ``cov`` has shape (k, d), (k, d, d), (d, d) or (k,) by kind."""

    kind: str
    weights: np.ndarray
    means: np.ndarray
    cov: np.ndarray
    loglik: float
    n: float
    n_iter: int
    converged: bool

    @property
    def n_parameters(self) -> int:
        k, d = self.means.shape
        c = {"diag": k * d, "full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "spherical": k}[self.kind]
        return k - 1 + k * d + c

    @property
    def bic(self) -> float:
        return -2 * self.loglik + self.n_parameters * math.log(self.n)

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.n_parameters


def _log_prob(x: np.ndarray, kind: str, weights: np.ndarray, means: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Weighted log density per row and component."""
    k, d = means.shape
    out = np.empty((len(x), k))
    for j in range(k):
        c = x - means[j]
        if kind in ("diag", "spherical"):
            v = cov[j] if kind == "diag" else np.full(d, cov[j])
            out[:, j] = -0.5 * ((c * c / v).sum(1) + np.log(v).sum())
        else:
            low = np.linalg.cholesky(cov if kind == "tied" else cov[j])
            s = np.linalg.solve(low, c.T)
            out[:, j] = -0.5 * (s * s).sum(0) - np.log(np.diag(low)).sum()
    return out - 0.5 * d * math.log(2 * math.pi) + np.log(np.maximum(weights, 1e-300))


def _sum_parts(part: DataFrame) -> np.ndarray:
    """Element-wise sum of one array column."""
    s = part.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).toPandas()
    return s.sort_values("pos")["x"].to_numpy()


def _em_step(src: DataFrame, kind: str, weights, means, cov, hard: bool) -> tuple:
    k, d = means.shape
    wide = kind in ("full", "tied")

    def task(batches):
        tot = None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy()).astype(np.float64)
            if hard:
                r = np.zeros((len(x), k))
                r[np.arange(len(x)), ((x[:, None, :] - means[None]) ** 2).sum(2).argmin(1)] = 1.0
                ll = 0.0
            else:
                lp = _log_prob(x, kind, weights, means, cov)
                m = lp.max(1, keepdims=True)
                lse = m[:, 0] + np.log(np.exp(lp - m).sum(1))
                r, ll = np.exp(lp - lse[:, None]), float(lse.sum())
            # second moments about the current means keep the variances accurate
            if wide:
                q = np.concatenate([(((x - means[j]) * r[:, [j]]).T @ (x - means[j])).ravel() for j in range(k)])
            else:
                q = np.concatenate([(r[:, j] @ (x - means[j]) ** 2) for j in range(k)])
            s = np.concatenate([r[:, j] @ (x - means[j]) for j in range(k)])
            v = np.concatenate([[ll, len(x)], r.sum(0), s, q])
            tot = v if tot is None else tot + v
        if tot is not None:
            yield pd.DataFrame({"v": [tot]})

    v = _sum_parts(src.mapInPandas(task, "v array<double>"))
    ll, n, nk = v[0], v[1], np.maximum(v[2 : 2 + k], 1e-10)
    s = v[2 + k : 2 + k + k * d].reshape(k, d)
    q = v[2 + k + k * d :].reshape((k, d, d) if wide else (k, d))
    shift = s / nk[:, None]
    return ll, n, nk, means + shift, shift, q


def gmm_fit(df: DataFrame, vec: str, k: int, kind: str = "diag", n_init: int = 1, max_iter: int = 100, tol: float = 1e-3, reg: float = 1e-6, seed: int = 0) -> Mixture:
    """EM with one Spark job per iteration; tasks send responsibilities' sums, the driver updates k components."""
    if kind not in ("diag", "full", "tied", "spherical"):
        raise ValueError(f"unknown covariance kind {kind!r}")
    src = cut_lineage(df.select(F.col(vec).cast("array<double>").alias("x")).filter("x is not null"))
    best = None
    for init in range(n_init):
        _, means, _ = kmeans(src.withColumn("id", F.monotonically_increasing_id()), "id", "x", k, seed + init, 1, 20)
        kk, d = means.shape  # fewer than k where the rows have fewer distinct values; another start may still find k
        weights, cov = np.full(kk, 1.0 / kk), np.ones((kk, d))
        prev, converged, hard = -np.inf, False, True
        for it in range(1, max_iter + 1):
            ll, n, nk, new_means, shift, q = _em_step(src, kind, weights, means, cov, hard)
            if not hard:
                converged = abs(ll / n - prev) < tol
                prev = ll / n
            weights = nk / n
            if kind in ("full", "tied"):
                full = q / nk[:, None, None] - shift[:, :, None] * shift[:, None, :]
                cov = (full if kind == "full" else (full * weights[:, None, None]).sum(0)) + reg * np.eye(d)
            else:
                diag = np.maximum(q / nk[:, None] - shift**2, 0) + reg
                cov = diag if kind == "diag" else diag.mean(1)
            fit = Mixture(kind, weights, new_means, cov, prev * n if not hard else -np.inf, n, it, converged)
            means, hard = new_means, False
            if converged:
                break
        if best is None or (len(fit.weights), fit.loglik) > (len(best.weights), best.loglik):
            best = fit
    return best


def gmm_predict(df: DataFrame, key: str, vec: str, fit: Mixture, out: str = "cluster") -> DataFrame:
    """(key, cluster, probability of the chosen component)."""
    ktype = df.schema[key].dataType.simpleString()

    def task(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            lp = _log_prob(np.stack(pdf["_x"].to_numpy()).astype(np.float64), fit.kind, fit.weights, fit.means, fit.cov)
            lp = np.exp(lp - lp.max(1, keepdims=True))
            p = lp / lp.sum(1, keepdims=True)
            yield pd.DataFrame({key: pdf[key].to_numpy(), out: p.argmax(1).astype("int32"), "prob": p.max(1)})

    return df.select(key, F.col(vec).cast("array<double>").alias("_x")).mapInPandas(task, f"`{key}` {ktype}, {out} int, prob double")


def bic_sweep(df: DataFrame, vec: str, ks: list[int], kind: str = "diag", n_init_final: int = 3, **kw) -> tuple[Mixture, dict[int, float]]:
    scores = {k: gmm_fit(df, vec, k, kind, **kw).bic for k in ks}
    best = min(scores, key=scores.get)
    return gmm_fit(df, vec, best, kind, n_init=n_init_final, **kw), scores


def silhouette(df: DataFrame, key: str, vec: str, label: str) -> float:
    """Mean silhouette on squared distances, of all rows; one label gives -1, one-row clusters 0.

    The mean squared distance of a row to a cluster needs only the cluster's n, sum of x and sum of |x|^2, so the
    score takes two scans, whatever the number of rows.
    """
    x = df.filter(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("own"), F.col(vec).cast("array<double>").alias("v"))
    dim = x.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return -1.0
    square = F.aggregate("v", F.lit(0.0), lambda acc, e: acc + e * e)
    sums = x.groupBy("own").agg(F.count("*").alias("n"), F.sum(square).alias("q"), F.array(*[F.sum(F.col("v")[i]) for i in range(dim)]).alias("s"))
    rows = sorted(_bounded_rows(sums, "clusters"), key=lambda r: r["own"])
    if len(rows) < 2:
        return -1.0
    place = {r["own"]: i for i, r in enumerate(rows)}
    n, q, s = np.array([r["n"] for r in rows], float), np.array([r["q"] for r in rows]), np.array([r["s"] for r in rows])

    def task(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v, own = np.stack(pdf["v"].to_numpy()).astype(np.float64), pdf["own"].map(place).to_numpy()
            at = np.arange(len(v))
            total = np.maximum(n[None] * (v * v).sum(1)[:, None] + q[None] - 2 * v @ s.T, 0)
            a = total[at, own] / np.maximum(n[own] - 1, 1)
            other = total / n[None]
            other[at, own] = np.inf
            b = other.min(1)
            most = np.maximum(a, b)
            yield pd.DataFrame({"s": [float(np.where((n[own] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1), 0.0).sum())], "n": [len(v)]})

    total = x.mapInPandas(task, "s double, n bigint").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    return float(total["s"] / total["n"])


def silhouette_euclidean(df: DataFrame, key: str, vec: str, label: str, sample: int | None, seed: int = 0) -> float:
    """Mean silhouette on plain distances; one label gives -1, one-row clusters 0.

    This score compares all pairs of the rows it is given, so the caller says how many: ``sample`` rows by a hash of the
    key, or None for all. Distances are summed per row and cluster inside the tasks.
    """
    rows = df.select(key, vec, label)
    if sample is not None:
        rows = reservoir(rows, sample, [key], seed=seed)
    rows = cut_lineage(rows)
    if rows.select(label).distinct().count() < 2:
        return -1.0
    prof = class_distance_profile(rows, rows, key, vec, label, 1.0, shares=False)
    own = rows.select(F.col(key).alias("i"), F.col(label).alias("own"))
    mean = F.col("s") / F.col("n")
    per = own.join(prof, "i").groupBy("i").agg(
        F.max(F.when(F.col("label") == F.col("own"), mean)).alias("a"), F.min(F.when(F.col("label") != F.col("own"), mean)).alias("b"))
    sil = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return float(per.agg(F.avg(sil)).first()[0])


def silhouette_sweep(df: DataFrame, key: str, vec: str, ks: list[int], kind: str = "diag", weight: str | None = None, n_init_final: int = 3, seed: int = 0, **kw) -> tuple[Mixture, dict[int, float]]:
    """Mixture with the largest silhouette; with ``weight`` the fits see a weighted bootstrap of the rows."""
    fit_rows = df
    if weight is not None:
        from .sample import weighted_bootstrap

        fit_rows = weighted_bootstrap(df.select(key, vec, weight), [key], weight, df.count(), seed)
    fit_rows = cut_lineage(fit_rows.select(vec))
    scores = {}
    for k in ks:
        m = gmm_fit(fit_rows, vec, k, kind, seed=seed, **kw)
        scores[k] = silhouette(df.select(key, vec).join(gmm_predict(df, key, vec, m, "_c"), key), key, vec, "_c")
    best = max(scores, key=scores.get)
    return gmm_fit(fit_rows, vec, best, kind, n_init=n_init_final, seed=seed, **kw), scores


# Ward on bounded lists -----------------------------------------------------------------------


def ward_merges(dist: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges of Ward.D2 as (squared height, row, row), a row of each side, from low to high.

    A chain of nearest neighbours ends in a pair that are each other's nearest; Ward's heights never fall, so such
    pairs may be merged at once and the order is restored by sorting. That takes time quadratic in the rows.
    """
    n = len(dist)
    d2 = dist.astype(float) ** 2
    np.fill_diagonal(d2, np.inf)
    size, active, chain, out = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(active.argmax())]
        while True:
            x = chain[-1]
            y = int(d2[x].argmin())
            if len(chain) > 1 and d2[x, chain[-2]] <= d2[x, y]:
                break
            chain.append(y)
        x, y = chain.pop(), chain.pop()
        i, j = min(x, y), max(x, y)
        height = float(d2[i, j])
        out.append((height, i, j))
        active[j] = False
        others = active.copy()
        others[i] = False
        row = np.full(n, np.inf)
        row[others] = ((size[i] + size[others]) * d2[i, others] + (size[j] + size[others]) * d2[j, others] - size[others] * height) / (size[i] + size[j] + size[others])
        d2[i], d2[:, i], d2[j], d2[:, j] = row, row, np.inf, np.inf
        size[i] += size[j]
    return sorted(out, key=lambda m: m[0])


def ward_labels(dist: np.ndarray, k: int) -> np.ndarray:
    """Ward.D2 cut of a distance matrix; labels 1..k in order of first appearance."""
    n = len(dist)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, i, j in ward_merges(dist)[: max(0, n - max(k, 1))]:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    names: dict[int, int] = {}
    return np.array([names.setdefault(find(i), len(names) + 1) for i in range(n)], dtype=int)


def _distances(x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(2))


def ward_on_centroids(df: DataFrame, key: str, vec: str, dim: int, cls: str, k: int, min_n: int, macro: str | None = None) -> tuple[DataFrame, dict]:
    """Ward over the centroids of classes with enough rows; rare classes join the nearest cluster; rows go to the
    nearest group centroid.  With ``macro`` (a boolean per row, constant per class) clusters never mix macros:
    cross-macro distances are inflated a thousandfold and rare classes only join clusters of their own macro.

    Returns (key, segment, d) and the class -> group map.
    """
    means = group_means(df, cls, vec, dim)
    if macro:
        means = means.join(df.groupBy(cls).agg(F.bool_or(macro).alias("_macro")), cls)
    rows = sorted(_bounded_rows(means, "classes"), key=lambda r: r[cls])
    big = [r for r in rows if r["n"] >= min_n]
    if not big:
        raise ValueError(f"no class has {min_n} rows")
    x = np.array([r["v"] for r in big])
    dist = _distances(x)
    if macro:
        side = np.array([bool(r["_macro"]) for r in big])
        dist[side[:, None] != side[None]] = dist.max() * 1000
    lab = ward_labels(dist, min(k, len(big)))
    centre = {c: x[lab == c].mean(0) for c in sorted(set(lab))}
    side_of = {c: (np.mean(side[lab == c]) >= 0.5) if macro else None for c in centre}
    group = {r[cls]: int(c) for r, c in zip(big, lab)}
    for r in rows:
        if r[cls] not in group:
            pick = [c for c in centre if not macro or side_of[c] == bool(r["_macro"])] or list(centre)
            group[r[cls]] = int(min(pick, key=lambda c: (((centre[c] - np.array(r["v"])) ** 2).sum(), c)))
    return assign_segments(df, key, vec, dim, cls, group), group


def assign_segments(df: DataFrame, key: str, vec: str, dim: int, cls: str, group: dict) -> DataFrame:
    """Group centroids from the rows, then every row to its nearest one."""
    pairs = [x for c, g in group.items() for x in (F.lit(c), F.lit(int(g)))]
    grp = df.withColumn("_g", F.element_at(F.create_map(*pairs), F.col(cls)))
    cent = group_means(grp, "_g", vec, dim).withColumnRenamed("_g", "segment")
    return nearest_centroid(df, key, vec, cent, "segment", "v").withColumnRenamed("centroid", "segment")


# strata --------------------------------------------------------------------------------------


def phase_variance(df: DataFrame, bin_: str, vec: str, dim: int) -> DataFrame:
    """Per bin n and the total sample variance of a vector."""
    x = F.col(vec)
    per = df.groupBy(bin_).agg(F.count("*").alias("n"), *[F.var_samp(x[i]).alias(f"_v{i}") for i in range(dim)])
    return per.select(bin_, "n", sum((F.col(f"_v{i}") for i in range(1, dim)), F.col("_v0")).alias("phase_var"))


def subdivide_by_phase(df: DataFrame, key: str, bin_: str, vec: str, dim: int, frac: float, k: int, max_iter: int = 15, seed: int = 1) -> DataFrame:
    """Append ``phase_sub``: the most variable bins with at least 10k rows split into k groups by k-means.

    All chosen bins iterate together: a row only sees the centres of its own bin, so one job per iteration
    serves every bin.
    """
    pv = sorted(_bounded_rows(phase_variance(df, bin_, vec, dim), "bins"), key=lambda r: (-(r["phase_var"] or 0.0), str(r[bin_])))
    n_sub = max(1, round(frac * len(pv)))
    chosen = [r[bin_] for r in pv[:n_sub] if r["n"] >= 10 * k]
    if not chosen or k < 2:
        return df.withColumn("phase_sub", F.lit(1))
    rows = cut_lineage(df.filter(F.col(bin_).isin(chosen)).select(key, F.col(bin_).alias("_b"), F.col(vec).cast("array<double>").alias("_x")))
    w = Window.partitionBy("_b").orderBy(seeded(seed, key), key)
    start = rows.withColumn("_s", F.row_number().over(w)).filter(F.col("_s") <= k)
    cent = start.select("_b", F.col("_s").alias("_sub"), F.col("_x").alias("v"))
    for _ in range(max_iter):
        lab = _nearest_in_group(rows, key, cent)
        new = lab.join(rows.drop("_b"), key).groupBy("_b", "_sub").agg(F.count("*").alias("n"), *[F.avg(F.col("_x")[i]).alias(f"_m{i}") for i in range(dim)])
        new = cut_lineage(new.select("_b", "_sub", F.array(*[f"_m{i}" for i in range(dim)]).alias("v")))
        moved = new.join(cent.select("_b", "_sub", F.col("v").alias("_o")), ["_b", "_sub"]).agg(
            F.max(F.aggregate(F.zip_with("v", "_o", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: F.greatest(acc, x)))).first()[0]
        cent = new
        if moved is not None and moved < 1e-9:
            break
    lab = _nearest_in_group(rows, key, cent)
    return df.join(lab.select(key, F.col("_sub").cast("int").alias("phase_sub")), key, "left").fillna(1, subset=["phase_sub"])


def _nearest_in_group(rows: DataFrame, key: str, cent: DataFrame) -> DataFrame:
    """(key, _b, _sub): nearest centre among those of the row's own bin; the centres of a bin join as one array."""
    per = cent.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_sub", "v"))).alias("_c"))
    from ..functions.vectors import sq_distance

    j = rows.join(per, "_b")
    best = F.array_min(F.transform("_c", lambda c: F.struct(F.round(sq_distance(c["v"], F.col("_x")), 9).alias("d"), c["_sub"].alias("s"))))
    return j.select(key, "_b", best["s"].alias("_sub"))


def bin_strata(df: DataFrame, bin_: str, y: str, k: int, prefix: str = "") -> dict:
    """Ward on the standardised bin means of a response: bin -> stratum label."""
    rows = sorted(_bounded_rows(df.groupBy(bin_).agg(F.avg(y).alias("m")), "bins"), key=lambda r: str(r[bin_]))
    rows = [r for r in rows if r["m"] is not None]
    m = np.array([r["m"] for r in rows], dtype=float)
    if len(rows) <= 1:
        return {r[bin_]: f"{prefix}1" for r in rows}
    sd = m.std(ddof=1)
    z = (m - m.mean()) / (sd if sd > 0 else 1.0)
    lab = ward_labels(np.abs(z[:, None] - z[None]), min(k, len(rows)))
    return {r[bin_]: f"{prefix}{c}" for r, c in zip(rows, lab)}


def apply_bins(df: DataFrame, bin_: str, mapping: dict, out: str = "stratum") -> DataFrame:
    """Stratum of each row's bin (a small literal map)."""
    pairs = [x for b, s in mapping.items() for x in (F.lit(b), F.lit(s))]
    return df.withColumn(out, F.element_at(F.create_map(*pairs), F.col(bin_)))


def aggregate_bins(df: DataFrame, bin_: str, y: str, k: int, out: str = "stratum") -> DataFrame:
    return apply_bins(df, bin_, bin_strata(df, bin_, y, k), out)


def aggregate_bins_macro(df: DataFrame, tree_bin: str, other_bin: str, macro: str, y: str, k_tree: int, k_other: int, fit_on: DataFrame | None = None, out: str = "stratum") -> DataFrame:
    """Separate maps for tree and non-tree rows, strata prefixed T and N."""
    src = fit_on if fit_on is not None else df
    t = bin_strata(src.filter(F.col(macro)), tree_bin, y, k_tree, "T")
    n = bin_strata(src.filter(~F.col(macro)), other_bin, y, k_other, "N")
    none = F.lit(None).cast("string")
    d = apply_bins(df, tree_bin, t, "_t") if t else df.withColumn("_t", none)
    d = apply_bins(d, other_bin, n, "_n") if n else d.withColumn("_n", none)
    return d.withColumn(out, F.when(F.col(macro), F.col("_t")).otherwise(F.col("_n"))).drop("_t", "_n")


def transfer_table(df: DataFrame, unit: str, bins: list[str], train_y: str, y: str, k: int) -> DataFrame:
    """Within-unit variance of ``y`` for strata trained on ``y`` itself and on another response."""
    base = pooled_within(df, [unit], y).select(F.lit("baseline").alias("scheme"), "within_var")
    out = base
    for b in bins:
        for name, src in (("self", y), ("transfer", train_y)):
            s = apply_bins(df, b, bin_strata(df, b, src, k), "_s")
            out = out.unionByName(pooled_within(s, [unit, "_s"], y).select(F.lit(f"{b}:{name}").alias("scheme"), "within_var"))
    ref = base.select("within_var").scalar()
    return out.withColumn("pct_of_baseline", 100 * F.col("within_var") / ref)


# density clusters ----------------------------------------------------------------------------


def _star_kernel(cut: float):
    """Components of the block's pairs within ``cut`` as (node, smallest id) edges: at most one edge per node."""

    def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"_q": qp["_q"].iloc[:0], "_r": rp["_r"].iloc[:0], "d": np.array([], float)})
        if not len(qp) or not len(rp):
            return empty
        qv, rv = _stack(qp["_qv"]), _stack(rp["_rv"])
        ids = np.array(sorted(set(qp["_q"]) | set(rp["_r"])))
        at_q, at_r = np.searchsorted(ids, qp["_q"].to_numpy()), np.searchsorted(ids, rp["_r"].to_numpy())
        near = np.empty((len(qv), len(rv)), dtype=bool)
        for s in range(0, len(qv), 256):
            part = qv[s : s + 256]
            qi, ri = np.divmod(np.arange(len(part) * len(rv)), len(rv))
            near[s : s + 256] = (_exact(part, rv, qi, ri) <= cut).reshape(len(part), len(rv))
        lab = np.arange(len(ids))
        while True:
            before = lab.copy()
            lr = lab[at_r]
            for s in range(0, len(qv), 256):
                low = np.where(near[s : s + 256], lr[None], len(ids)).min(1)
                np.minimum.at(lab, at_q[s : s + 256], low)
            lq = lab[at_q]
            low_r = np.full(len(rv), len(ids))
            for s in range(0, len(qv), 256):
                low_r = np.minimum(low_r, np.where(near[s : s + 256], lq[s : s + 256, None], len(ids)).min(0))
            np.minimum.at(lab, at_r, low_r)
            if (lab == before).all():
                break
        moved = np.flatnonzero(lab != np.arange(len(ids)))
        return pd.DataFrame({"_q": ids[moved], "_r": ids[lab[moved]], "d": np.zeros(len(moved))})

    return kernel


def link_within(df: DataFrame, key: str, vec: str, cut: float, ref_block: int = REF_BLOCK, query_block: int = QUERY_BLOCK, pivots: int | None = None) -> DataFrame:
    """(i, j) edges that connect exactly what pairs at distance <= cut connect, far fewer than those pairs."""
    q, r = _side(df, key, vec, (), "q"), _side(df, key, vec, (), "r")
    r = cut_lineage(r)
    n = r.count()
    if n <= ref_block and pivots is None:
        parts = block_product(q, r, _star_kernel(cut), _pair_schema(q, r), max(n, 1), ref_block, query_block)
    else:
        parts = _cell_join(q, r, _star_kernel(cut), _pair_schema(q, r), n, None, cut, pivots or min(MAX_PIVOTS, max(2, math.ceil(math.sqrt(n)))), ref_block, query_block)
    return parts.select(F.col("_q").alias("i"), F.col("_r").alias("j")).distinct()


def _density_runs(df: DataFrame, key: str, vec: str, min_pts: list[int], cut_quantiles: list[float], cut: float | None, **kw) -> tuple[list, DataFrame, DataFrame]:
    """Runs (minPts, quantile, cut), their components of minPts rows or more, and the rows of each run and component."""
    top = max(min_pts)
    nn = cut_lineage(knn_join(df, df, max(top - 1, 1), qid=key, rid=key, qvec=vec, rvec=vec))
    if cut is not None:
        runs = [(mp, None, float(cut)) for mp in min_pts]
    else:
        ranks = nn.filter(F.col("rank").isin(*{max(mp - 1, 1) for mp in min_pts}))
        at = {r["rank"]: r for r in exact_quantiles(ranks, ["rank"], "d", cut_quantiles).collect()}  # a row per minPts
        runs = [(mp, p, at[max(mp - 1, 1)][q_name(p)]) for mp in min_pts for p in cut_quantiles if max(mp - 1, 1) in at]
    if not runs:
        return [], None, None
    links = density_links(df, key, vec, nn, top, max(c for _, _, c in runs), **kw)
    comp = cut_lineage(density_components(links, nn, key, [(mp, c) for mp, _, c in runs]))
    least = F.element_at(F.array(*[F.lit(mp) for mp, _, _ in runs]), F.col("run") + 1)
    size = cut_lineage(comp.groupBy("run", "component").agg(F.count("*").alias("n")).filter(F.col("n") >= least))
    return runs, size, comp


def density_grid(df: DataFrame, key: str, vec: str, min_pts: list[int], cut_quantiles: list[float] = (0.5,), cut: float | None = None, **kw) -> DataFrame:
    """(min_pts, cut_quantile, cut, k, noise): clusters and share of noise for each minPts and cut, from one set of spanning links.

    A cut is a quantile of the core distances of its minPts, or ``cut`` for all. Noise are rows in no component of minPts rows.
    An empty table, or one without neighbours of the wanted ranks, gives no rows.
    """
    runs, size, _ = _density_runs(df, key, vec, list(min_pts), list(cut_quantiles), cut, **kw)
    schema = "run int, min_pts int, cut_quantile double, cut double"
    grid = df.sparkSession.createDataFrame([(i, mp, p, float(c)) for i, (mp, p, c) in enumerate(runs)], schema)
    if not runs:
        return grid.select("min_pts", "cut_quantile", "cut", F.lit(0).cast("bigint").alias("k"), F.lit(0.0).alias("noise"))
    per = size.groupBy("run").agg(F.count("*").alias("k"), F.sum("n").alias("rows"))
    share = F.lit(1.0) - F.coalesce("rows", F.lit(0)) / F.lit(max(df.count(), 1))
    return grid.join(per, "run", "left").select("min_pts", "cut_quantile", "cut", F.coalesce("k", F.lit(0)).alias("k"), share.alias("noise"))


def density_clusters(df: DataFrame, key: str, vec: str, min_pts: list[int], k_target: int, cut_quantile: float = 0.5, cut: float | None = None, **kw) -> tuple[DataFrame, list[dict]]:
    """Density clustering at one mutual-reachability cut, minPts chosen to come closest to ``k_target`` clusters.

    One neighbour search and one set of spanning links serve every minPts.  Rows whose core distance exceeds the cut
    are noise; the others connect when closer than the cut; components smaller than minPts are noise too; noise
    joins its nearest labelled row.  Returns (key, cluster from 1, noise) and one record per minPts.
    """
    runs, size, comp = _density_runs(df, key, vec, list(min_pts), [cut_quantile], cut, **kw)
    if not runs:
        return df.withColumns({"cluster": F.lit(0), "noise": F.lit(True)}), []
    n_rows = max(df.count(), 1)
    per = {r["run"]: r for r in size.groupBy("run").agg(F.count("*").alias("k"), F.sum("n").alias("rows")).collect()}  # a row per run
    records = [{"min_pts": mp, "cut": c, "k": per[i]["k"] if i in per else 0, "noise": 1 - (per[i]["rows"] if i in per else 0) / n_rows} for i, (mp, _, c) in enumerate(runs)]
    order = [i for i in range(len(runs)) if records[i]["k"] >= 1] or list(range(len(runs)))
    best = min(order, key=lambda i: (abs(records[i]["k"] - k_target), records[i]["min_pts"]))
    # numbered by the smallest member
    ids = global_rank(size.filter(F.col("run") == best).select("component"), [F.col("component")], "_c")
    lab = comp.filter(F.col("run") == best).join(ids, "component").select(key, F.col("_c").cast("int").alias("_c"))
    d = cut_lineage(df.join(lab, key, "left").fillna(0, subset=["_c"]))
    out = noise_to_nearest(d, key, vec, "_c", 0, "cluster") if records[best]["k"] else d.withColumn("cluster", F.lit(0))
    return out.withColumn("noise", F.col("_c") == 0).drop("_c"), records


# taxonomy ------------------------------------------------------------------------------------


def landscape_taxonomy(df: DataFrame, key: str, type_vec: str, phase_vec: str, phase_dim: int, temporal_var: str, phase_mean: str, type_ks: list[int],
                       sub_ks: tuple[int, ...] = (2, 3, 4), q90_limit: float = 0.25, min_n: int = 1000, kind: str = "diag", seed: int = 0, max_iter: int = 30) -> tuple[DataFrame, DataFrame, list]:
    """Type clusters; those whose 90th percentile of temporal variance is high get phase sub-clusters.

    Returns rows with type_cluster and sub_cluster (0 = not split), the variability table and the dynamic clusters.
    """
    from .evaluate import variability_stats

    m, _ = silhouette_sweep(df, key, type_vec, type_ks, kind, n_init_final=1, seed=seed, max_iter=max_iter)
    lab = cut_lineage(df.join(gmm_predict(df, key, type_vec, m, "type_cluster").drop("prob"), key))
    stats = variability_stats(lab, "type_cluster", temporal_var, phase_mean)
    dynamic = sorted(r["type_cluster"] for r in _bounded_rows(stats.filter((F.col("q90") > q90_limit) & (F.col("n") >= min_n)).select("type_cluster"), "clusters"))
    sub = None
    for c in dynamic:
        part = lab.filter(F.col("type_cluster") == c)
        fit, _ = silhouette_sweep(part, key, phase_vec, list(sub_ks), kind, weight=temporal_var, n_init_final=1, seed=seed, max_iter=max_iter)
        p = gmm_predict(part, key, phase_vec, fit, "_s").select(key, (F.col("_s") + 1).alias("sub_cluster"))
        sub = p if sub is None else sub.unionByName(p)
    out = lab.join(sub, key, "left").fillna(0, subset=["sub_cluster"]) if sub is not None else lab.withColumn("sub_cluster", F.lit(0))
    return out, stats, dynamic


def sub_cluster_summary(rows: DataFrame, ysfc: str) -> DataFrame:
    """n, mean and quartiles of ysfc per (type, sub) cluster."""
    keys = ["type_cluster", "sub_cluster"]
    base = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(ysfc).alias("mean_ysfc"))
    return base.join(exact_quantiles(rows, keys, ysfc, [0.25, 0.5, 0.75]), keys)

