"""Linear, logistic and spline fits from distributed sufficient statistics.

Each task reduces its rows to one count, one sum vector and one scatter matrix per group; Spark adds these
up element by element.  The driver holds D x D numbers, D checked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut_lineage
from .quantiles import exact_quantiles, q_name
from .sample import fold_assign

MAX_DIM = 1024


@dataclass(frozen=True)
class Moments:
    """n, mean vector and centred scatter matrix."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray


def moments(df: DataFrame, vec: Column | str, dim: int, group: str | None = None) -> dict:
    """Moments per group value (or {None: Moments})."""
    if dim > MAX_DIM:
        raise ValueError(f"dimension {dim} above {MAX_DIM}")
    x = (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")
    src = df.select((F.col(group).cast("string") if group else F.lit("")).alias("g"), x.alias("x"))
    # any complete row serves as a rough centre: it keeps the products small and does not change the answer
    seen = [np.array(r["x"], dtype=float) for r in src.limit(16).collect() if r["x"] is not None]
    shift = next((v for v in seen if np.isfinite(v).all()), np.zeros(dim))
    iu = np.triu_indices(dim)

    def reduce_task(batches):
        acc: dict[str, list] = {}
        for pdf in batches:
            pdf = pdf[pdf["x"].notna()]
            for g, part in pdf.groupby("g"):
                a = np.stack(part["x"].to_numpy()).astype(np.float64) - shift
                a = a[np.isfinite(a).all(1)]
                s = acc.setdefault(g, [0.0, np.zeros(dim), np.zeros((dim, dim))])
                s[0] += len(a)
                s[1] += a.sum(0)
                s[2] += a.T @ a
        for g, (n, s, m) in acc.items():
            yield pd.DataFrame({"g": [g], "v": [np.concatenate([[n], s, m[iu]])]})

    part = src.mapInPandas(reduce_task, "g string, v array<double>")
    tot = part.select("g", F.posexplode("v").alias("pos", "x")).groupBy("g", "pos").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for g, p in tot.groupby("g"):
        v = p.sort_values("pos")["x"].to_numpy()
        n, s = v[0], v[1 : dim + 1]
        m = np.zeros((dim, dim))
        m[iu] = v[dim + 1 :]
        m = m + np.triu(m, 1).T
        out[g if group else None] = Moments(n, s / n + shift, m - np.outer(s, s) / n)
    return out


def moment_matrix(df: DataFrame, vec: str, dim: int) -> tuple[float, np.ndarray, np.ndarray]:
    """n, mean and sample covariance of a vector column."""
    m = moments(df, vec, dim)[None]
    return m.n, m.mean, m.scatter / max(m.n - 1, 1)


@dataclass(frozen=True)
class LinearFit:
    """Weights (D x T), intercepts (T) and the moments they come from."""

    weights: np.ndarray
    bias: np.ndarray
    r2: np.ndarray
    adj_r2: np.ndarray
    n: float


def _solve(m: Moments, dx: int, lam: float, cols: list[int] | None = None) -> LinearFit:
    keep = list(range(dx)) if cols is None else cols
    ys = list(range(dx, len(m.mean)))
    g = m.scatter[np.ix_(keep, keep)] + lam * np.eye(len(keep))
    xy = m.scatter[np.ix_(keep, ys)]
    w = np.linalg.lstsq(g, xy, rcond=None)[0] if lam == 0 else np.linalg.solve(g, xy)
    b = m.mean[ys] - m.mean[keep] @ w
    syy = np.diag(m.scatter)[ys]
    sse = syy - 2 * (w * xy).sum(0) + np.einsum("it,ij,jt->t", w, m.scatter[np.ix_(keep, keep)], w)
    r2 = 1 - sse / np.where(syy > 0, syy, np.nan)
    p = np.linalg.matrix_rank(m.scatter[np.ix_(keep, keep)]) if lam == 0 else len(keep)
    adj = 1 - (1 - r2) * (m.n - 1) / (m.n - p - 1)
    return LinearFit(w, b, r2, adj, m.n)


def _joint(x: Column | str, ys: list[str]) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.concat(x.cast("array<double>"), F.array(*[F.col(y).cast("double") for y in ys]))


def ridge_fit(df: DataFrame, x: Column | str, dim: int, ys: list[str], lam: float = 1e-3) -> LinearFit:
    """Closed form (X'X + lam I)^-1 X'Y with an unpenalised intercept, many targets."""
    return _solve(moments(df, _joint(x, ys), dim + len(ys))[None], dim, lam)


def ols_adj_r2(df: DataFrame, x: str, dim: int, y: str, blocks: dict[str, list[int]]) -> dict[str, float]:
    """Adjusted R2 of the response on each block of columns, all from one Gram matrix."""
    m = moments(df, _joint(x, [y]), dim + 1)[None]
    return {name: float(_solve(m, dim, 0.0, cols).adj_r2[0]) for name, cols in blocks.items()}


def predict_linear(x: Column | str, fit: LinearFit, names: list[str]) -> list[Column]:
    x = F.col(x) if isinstance(x, str) else x
    return [(V.dot(x, V.literal_vector(fit.weights[:, t])) + float(fit.bias[t])).alias(n) for t, n in enumerate(names)]


def oof_linear(df: DataFrame, x: Column | str, dim: int, y: str, fold: str, out: str = "score", lam: float = 0.0) -> DataFrame:
    """Out-of-fold predictions: the Gram matrix of a training set is the total minus the fold's."""
    per = moments(df, _joint(x, [y]), dim + 1, fold)
    x = F.col(x) if isinstance(x, str) else x
    pred = None
    for f in per:
        rest = None
        for g, m in per.items():
            if g != f:
                rest = m if rest is None else _plus(rest, m)
        fit = _solve(rest, dim, lam)
        p = V.dot(x, V.literal_vector(fit.weights[:, 0])) + float(fit.bias[0])
        hit = F.col(fold).cast("string") == f
        pred = F.when(hit, p) if pred is None else pred.when(hit, p)
    return df.withColumn(out, pred)


def _plus(a: Moments, b: Moments) -> Moments:
    n = a.n + b.n
    d = b.mean - a.mean
    return Moments(n, a.mean + d * (b.n / n), a.scatter + b.scatter + np.outer(d, d) * (a.n * b.n / n))


# interaction PCA -----------------------------------------------------------------------------


@dataclass(frozen=True)
class InteractionPca:
    mean: np.ndarray
    sd: np.ndarray
    components: np.ndarray  # D x k, scaled so that scores have variance 1
    explained: np.ndarray

    def scores(self, x: Column | str) -> Column:
        proj = (self.components / self.sd[:, None]).T
        return V.linear_map(x, proj, bias=-(proj @ self.mean))


def interaction_pca(df: DataFrame, x: Column | str, dim: int, k: int) -> InteractionPca:
    """Eigenvectors of the correlation matrix of a design block, whitened, with explained shares."""
    m = moments(df, x, dim)[None]
    cov = m.scatter / m.n
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-16))
    val, vec = np.linalg.eigh(cov / np.outer(sd, sd))
    top = np.argsort(val)[::-1][:k]
    v = vec[:, top]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(len(top))] < 0, -1.0, 1.0)
    return InteractionPca(m.mean, sd, v / np.sqrt(np.maximum(val[top], 1e-12)), np.maximum(val[top], 0) / np.maximum(val, 0).sum())


# logistic ------------------------------------------------------------------------------------


def _with_features(df: DataFrame, x: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_features", array_to_vector(F.col(x).cast("array<double>")))


def oof_logistic(df: DataFrame, x: str, label: str, fold: str, folds: list[int], out: str = "prob") -> DataFrame:
    """Out-of-fold P(label = 1), one distributed fit per fold."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    src = _with_features(df, x).withColumn("_y", F.col(label).cast("double"))
    parts = None
    for f in folds:
        model = LogisticRegression(featuresCol="_features", labelCol="_y", maxIter=100, tol=1e-9, family="binomial").fit(src.filter(F.col(fold) != f))
        p = model.transform(src.filter(F.col(fold) == f)).withColumn(out, vector_to_array("probability")[1])
        p = p.drop("_features", "_y", "rawPrediction", "probability", "prediction")
        parts = p if parts is None else parts.unionByName(p)
    return parts


def multinomial_logit(df: DataFrame, x: str, label: str, train: Column, min_rows: int = 10) -> DataFrame:
    """(n, accuracy) of a multinomial fit on classes with more than ``min_rows`` training rows, scored on the rest."""
    from pyspark.ml.classification import LogisticRegression

    big = df.filter(train).groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") > min_rows).select(label)
    classes = sorted(r[0] for r in big.collect())  # class codes, a bounded list
    idx = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    src = _with_features(df.filter(F.col(label).isin(classes)), x).withColumn("_y", idx.cast("double"))
    model = LogisticRegression(featuresCol="_features", labelCol="_y", maxIter=100, regParam=1e-4, family="multinomial").fit(src.filter(train))
    return model.transform(src.filter(~train)).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("accuracy"))


def oof_target_rate(df: DataFrame, cluster: str, label: str, fold: str, out: str = "rate") -> DataFrame:
    """Class rate of the row's cluster over the other folds; unseen clusters get the other folds' mean."""
    cells = df.groupBy(cluster, fold).agg(F.sum(label).alias("s"), F.count(label).alias("n"))
    tot_c = cells.groupBy(cluster).agg(F.sum("s").alias("cs"), F.sum("n").alias("cn"))
    folds = cells.groupBy(fold).agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    tot = cells.agg(F.struct(F.sum("s").alias("s"), F.sum("n").alias("n"))).scalar()
    r = cells.join(tot_c, cluster).join(folds, fold).withColumn("_t", tot)
    rate = F.coalesce(F.try_divide(F.col("cs") - F.col("s"), F.col("cn") - F.col("n")), F.try_divide(F.col("_t.s") - F.col("fs"), F.col("_t.n") - F.col("fn")))
    return df.join(r.select(cluster, fold, rate.alias(out)), [cluster, fold])


# calibration ---------------------------------------------------------------------------------


def natural_spline(x: Column, knots: list[float]) -> Column:
    """Natural cubic spline columns for the given knots (first and last are the boundary)."""
    last, prev = knots[-1], knots[-2]

    def cube(k: float) -> Column:
        d = F.greatest(x - k, F.lit(0.0))
        return d * d * d

    def bend(k: float) -> Column:
        return (cube(k) - cube(last)) / (last - k)

    return F.array(x, *[bend(k) - bend(prev) for k in knots[:-2]])


def calibration_variance(df: DataFrame, unit: str, units: list, y: str, fold: str | None, score: Column | None = None, score_dim: int = 0,
                         spline: str | None = None, df_spline: int = 4) -> float:
    """Within-unit residual variance of y on factor(unit) plus a spline or a linear score.

    With ``fold`` the predictions are out of fold and spline knots come from each training set: a row is sent
    to every training set it belongs to, so the knots of all folds are one quantile job and the Gram matrices
    one pass.
    """
    from .survey import pooled_within

    dummies = F.array(*[(F.col(unit) == u).cast("double") for u in units[1:]])
    if spline is None:
        vec, dim = F.concat(dummies, score), len(units) - 1 + score_dim
        if fold:
            out = oof_linear(df, vec, dim, y, fold, "_pred")
        else:
            out = df.withColumn("_pred", predict_linear(vec, ridge_fit(df, vec, dim, [y], 0.0), ["p"])[0])
    else:
        df = cut_lineage(df.select(unit, y, spline, *([fold] if fold else [])))
        held = F.col(fold).cast("string") if fold else F.lit("all")
        names = sorted(r[0] for r in df.select(held.alias("f")).distinct().collect()) if fold else ["none"]
        sets = F.filter(F.array(*[F.lit(f) for f in names]), lambda f: f != held)
        train = df.withColumn("_out", F.explode(sets))
        probs = [0.0, *[i / df_spline for i in range(1, df_spline)], 1.0]
        knots = {r["_out"]: [r[q_name(p)] for p in probs] for r in exact_quantiles(train, ["_out"], spline, probs).collect()}

        def design(f: str) -> Column:
            lo, width = knots[f][0], knots[f][-1] - knots[f][0]
            return F.concat(dummies, natural_spline((F.col(spline) - lo) / width, [(k - lo) / width for k in knots[f]]))

        dim, vec = len(units) - 1 + df_spline, None
        for f in names:
            vec = F.when(F.col("_out") == f, design(f)) if vec is None else vec.when(F.col("_out") == f, design(f))
        per = moments(train.withColumn("_v", _joint(vec, [y])), "_v", dim + 1, "_out")
        pred = None
        for f in names:
            p = predict_linear(design(f), _solve(per[f], dim, 0.0), ["p"])[0]
            pred = p if not fold else (F.when(held == f, p) if pred is None else pred.when(held == f, p))
        out = df.withColumn("_pred", pred)
    return pooled_within(out.withColumn("_res", F.col(y) - F.col("_pred")), [unit], "_res").first()["within_var"]


def folds(df: DataFrame, k: int, key: str, seed: int = 1, order: Column | None = None) -> DataFrame:
    return fold_assign(df, k, [key], seed, order)
