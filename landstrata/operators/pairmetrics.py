"""Values of the pair objectives as evaluation aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..functions.special import log_gamma, log_softmax_pick, softplus
from .ranks import SALTS
from .stats import with_row
from .neighbors import QUERY_BLOCK, REF_BLOCK, _exact, _Same, _scoped_join, _stack, _Tiles, block_product, finite_vectors

# Ordering constraints of three sampled years (closer pair, farther pair, large margin).
TRIPLET_CASES = {
    "d01": [((1, 2), (0, 1), True), ((1, 2), (0, 2), True), ((0, 2), (0, 1), False)],
    "d12": [((0, 1), (1, 2), True), ((0, 1), (0, 2), True), ((0, 2), (1, 2), False)],
    "none": [((0, 1), (0, 2), False), ((1, 2), (0, 2), False)],
}


# contrastive ---------------------------------------------------------------------------------


def similarity(a, b, kind: str, dim: int) -> Column:
    if kind == "l2":
        return -V.sq_distance(a, b) / dim
    if kind == "cosine":
        return V.dot(V.row_normalise(a), V.row_normalise(b))
    if kind == "dot":
        return V.dot(a, b)
    raise ValueError(f"unknown similarity {kind!r}")


def infonce(pairs: DataFrame, vectors: DataFrame, key: str, vec: str, dim: int, tau: float, kind: str = "l2", eps: float = 1e-8) -> DataFrame:
    """One row (loss, n_anchors); ``pairs`` has i, j, w and ``positive``; anchors without positives drop out.

    log-sum-exp in two levels: pairs are summed per (anchor, salt) around their own maximum, then at most
    ``SALTS`` rows per anchor are brought to a common maximum, so an anchor may own any share of the pairs.
    """
    v = vectors.select(F.col(key).alias("_k"), F.col(vec).cast("array<double>").alias("_v"))
    p = pairs.join(v.withColumnsRenamed({"_k": "i", "_v": "_a"}), "i").join(v.withColumnsRenamed({"_k": "j", "_v": "_b"}), "j")
    p = p.select("i", F.pmod(F.xxhash64("j", "positive"), F.lit(SALTS)).alias("_salt"), "positive", (F.ln("w") + similarity("_a", "_b", kind, dim) / tau).alias("z"))
    p = p.withColumn("m", F.max("z").over(Window.partitionBy("i", "_salt")))
    e = F.exp(F.col("z") - F.col("m"))
    part = p.groupBy("i", "_salt").agg(F.first("m").alias("m"), F.sum(e).alias("all"), F.sum(F.when(F.col("positive"), e)).alias("pos"))
    part = part.withColumn("top", F.max("m").over(Window.partitionBy("i")))
    shift = F.exp(F.col("m") - F.col("top"))
    per = part.groupBy("i").agg(F.sum(F.col("all") * shift).alias("all"), F.sum(F.col("pos") * shift).alias("pos"))
    per = per.filter(F.col("pos").isNotNull())
    return per.agg(F.avg(F.ln(F.col("all") + eps) - F.ln(F.col("pos") + eps)).alias("loss"), F.count("*").alias("n_anchors"))


# soft neighbourhoods -------------------------------------------------------------------------


def row_kl(df: DataFrame, pair: list[str], row: str, d_ref: str, d_learned: str, tau_ref: float, tau_learned: float, mask: Column | None = None) -> DataFrame:
    """Per (pair, row): n, KL of softmax(-d_ref/tau) against softmax(-d/tau) and both entropies.

    Everything is a sum once the row minima are known, and the minima and sums share one shuffle.
    """
    d = df.filter(mask) if mask is not None else df
    w = Window.partitionBy(*pair, row)
    d = d.withColumns({"_mr": F.min(d_ref).over(w), "_ml": F.min(d_learned).over(w)})
    er = F.exp(-(F.col(d_ref) - F.col("_mr")) / tau_ref)
    el = F.exp(-(F.col(d_learned) - F.col("_ml")) / tau_learned)
    s = d.groupBy(*pair, row).agg(
        F.count("*").alias("n"), F.first("_mr").alias("mr"), F.first("_ml").alias("ml"), F.sum(er).alias("zr"), F.sum(el).alias("zl"),
        F.sum(er * F.col(d_ref)).alias("rr"), F.sum(er * F.col(d_learned)).alias("rl"), F.sum(el * F.col(d_learned)).alias("ll"))
    lse_r = F.ln("zr") - F.col("mr") / tau_ref
    lse_l = F.ln("zl") - F.col("ml") / tau_learned
    return s.select(
        *pair, row, "n", (F.col("rl") / F.col("zr") / tau_learned - F.col("rr") / F.col("zr") / tau_ref - lse_r + lse_l).alias("kl"),
        (lse_r + F.col("rr") / F.col("zr") / tau_ref).alias("entropy_ref"), (lse_l + F.col("ll") / F.col("zl") / tau_learned).alias("entropy_learned"))


def soft_neighbourhood_kl(df: DataFrame, pair: list[str], row: str, d_ref: str, d_learned: str, tau_ref: float, tau_learned: float,
                          mask: Column | None = None, weight: str | None = None, min_valid: int = 2) -> DataFrame:
    """One row: weighted mean over pairs of the mean KL of valid rows, counts, overlap and entropies."""
    if min_valid < 2:
        raise ValueError("min_valid must be at least 2")
    src = df.withColumn("_w", F.col(weight)) if weight else df.withColumn("_w", F.lit(1.0))
    keys = [*pair, "_w"]
    rows = row_kl(src, keys, row, d_ref, d_learned, tau_ref, tau_learned, mask).filter(F.col("n") >= min_valid)
    per = rows.groupBy(*keys).agg(
        F.avg("kl").alias("kl"), F.count("*").alias("rows"), F.sum("n").alias("overlap"), F.sum("entropy_ref").alias("er"), F.sum("entropy_learned").alias("el"))
    n = F.sum("rows")
    return per.agg(
        F.coalesce(F.try_divide(F.sum(F.col("_w") * F.col("kl")), F.sum("_w")), F.lit(0.0)).alias("loss"), F.count("*").alias("n_pairs_active"),
        F.coalesce(n, F.lit(0)).alias("n_rows_valid"), (F.sum("overlap") / n).alias("mean_overlap"), (F.sum("er") / n).alias("mean_entropy_ref"), (F.sum("el") / n).alias("mean_entropy_learned"))


def phase_neighbourhood(aligned: DataFrame, tau_ref: float, tau_learned: float, weight: str | None = None, self_weight: float = 1.0, cross_weight: float = 1.0) -> DataFrame:
    """Self-similarity and cross-pixel terms on aligned distances and their weighted sum, one row."""
    s = soft_neighbourhood_kl(aligned, ["i", "j"], "a", "d_ref_self", "d_learned_self", tau_ref, tau_learned, F.col("mask_self"), weight)
    c = soft_neighbourhood_kl(aligned, ["i", "j"], "a", "d_ref_cross", "d_learned_cross", tau_ref, tau_learned, None, weight)
    s = s.select(F.col("loss").alias("loss_self"), F.col("n_rows_valid").alias("rows_self"))
    out = with_row(s, c.select(F.col("loss").alias("loss_cross"), F.col("n_rows_valid").alias("rows_cross")))
    return out.withColumn("loss", self_weight * F.col("loss_self") + cross_weight * F.col("loss_cross"))


def spread_ranking(aligned: DataFrame, dynamism: DataFrame, key: str, score: str, margin: float = 0.1, delta: float = 0.5) -> DataFrame:
    """The more dynamic pixel of a pair should spread more over the shared stages: mean softplus over pairs."""
    m = F.col("mask_self")
    n = F.greatest(F.count_if(m), F.lit(1))
    sp = aligned.groupBy("i", "j").agg(
        (F.sum(F.when(m, F.col("d_learned_self")).otherwise(0.0)) / n).alias("si"), (F.sum(F.when(m, F.col("d_learned_self_j")).otherwise(0.0)) / n).alias("sj"))
    d = dynamism.select(F.col(key).alias("_k"), F.col(score).alias("_s"))
    p = sp.join(d.withColumnsRenamed({"_k": "i", "_s": "di"}), "i").join(d.withColumnsRenamed({"_k": "j", "_s": "dj"}), "j")
    diff, gap = F.col("di") - F.col("dj"), F.col("sj") - F.col("si")
    loss = F.when(diff > delta, softplus(gap + margin)).when(diff < -delta, softplus(-gap + margin)).otherwise(0.0)
    ci, cj = F.count_if(diff > delta), F.count_if(diff < -delta)
    ok = F.count_if(((diff > delta) & (-gap > margin)) | ((diff < -delta) & (gap > margin)))
    return p.agg(F.avg(loss).alias("loss"), F.count("*").alias("n_pairs"), ci.alias("n_constrained_i"), cj.alias("n_constrained_j"),
                 F.coalesce(F.try_divide(ok, ci + cj), F.lit(1.0)).alias("frac_satisfied"), F.avg("si").alias("mean_spread_i"),
                 F.avg("sj").alias("mean_spread_j"), F.avg(F.abs(diff)).alias("mean_ref_diff"))


# triplets ------------------------------------------------------------------------------------


def triplet_constraints(series: DataFrame, key: str, t: str, ysfc: str, t0: int, t1: int, t2: int) -> DataFrame:
    """(key, closer_a, closer_b, farther_a, farther_b, large): constraints from disturbances strictly between the years."""
    zero = F.col(ysfc) == 0

    def any_zero(cond: Column) -> Column:
        return F.coalesce(F.bool_or(F.when(cond, zero)), F.lit(False))

    f = series.groupBy(key).agg(
        any_zero(F.col(t).isin(t0, t1, t2)).alias("at"), any_zero((F.col(t) > t0) & (F.col(t) < t1)).alias("d01"), any_zero((F.col(t) > t1) & (F.col(t) < t2)).alias("d12"))
    f = f.filter(~F.col("at") & ~(F.col("d01") & F.col("d12")))

    def listed(case: str) -> Column:
        return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((c[0], c[1], r[0], r[1], big), ("closer_a", "closer_b", "farther_a", "farther_b", "large"))])
                         for c, r, big in TRIPLET_CASES[case]])

    cases = F.when(F.col("d01"), listed("d01")).when(F.col("d12"), listed("d12")).otherwise(listed("none"))
    return f.select(key, F.explode(cases).alias("c")).select(key, "c.*")


def triplet_loss(constraints: DataFrame, slots: DataFrame, key: str, vecs: tuple[str, str, str], large: float = 1.0, small: float = 0.3) -> DataFrame:
    """One row: mean softplus(d_close - d_far + margin) on squared distances, counts, satisfied share."""
    z = slots.select(key, F.array(*[F.col(v).cast("array<double>") for v in vecs]).alias("_z"))
    c = constraints.join(z, key)

    def d(a: str, b: str) -> Column:
        return V.sq_distance(F.col("_z")[F.col(a)], F.col("_z")[F.col(b)])

    v = d("closer_a", "closer_b") - d("farther_a", "farther_b") + F.when(F.col("large"), large).otherwise(small)
    c = c.select(key, "large", v.alias("v"))
    return c.agg(F.coalesce(F.avg(softplus(F.col("v"))), F.lit(0.0)).alias("loss"), F.count("*").alias("n_constraints"), F.count_if("large").alias("n_large"),
                 F.count_if(~F.col("large")).alias("n_small"), F.countDistinct(key).alias("n_pixels_valid"),
                 F.coalesce(F.avg((F.col("v") < 0).cast("double")), F.lit(1.0)).alias("frac_satisfied"))


def recovery_discrimination(series: DataFrame, key: str, ysfc: str, vec: Column | str, margin: float = 0.5, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """Mean softplus(margin - distance) over (disturbed, recovered) steps of a pixel; a pixel has one row per year."""
    v = (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")
    y = F.col(ysfc)
    s = series.filter(y >= 0).select(key, y.alias("y"), v.alias("v")).groupBy(key).agg(
        F.collect_list(F.when(F.col("y") <= low, F.col("v"))).alias("lo"), F.collect_list(F.when(F.col("y") >= high, F.col("v"))).alias("hi"))
    s = s.filter((F.size("lo") > 0) & (F.size("hi") > 0))

    def term(a, b):
        return softplus(margin - F.sqrt(F.greatest(V.sq_distance(a, b), F.lit(1e-12))))

    total = F.aggregate("lo", F.lit(0.0), lambda acc, a: acc + F.aggregate("hi", F.lit(0.0), lambda x, b: x + term(a, b)))
    n = F.size("lo") * F.size("hi")
    return s.agg(F.coalesce(F.try_divide(F.sum(total), F.sum(n)), F.lit(0.0)).alias("loss"), F.coalesce(F.sum(n), F.lit(0)).alias("n_pairs"), F.count("*").alias("n_active_pixels"))


# covariance terms ----------------------------------------------------------------------------


def variance_covariance(df: DataFrame, vec: str, dim: int, target: float = 1.0, eps: float = 1e-4) -> tuple[float, float]:
    """mean relu(target - sqrt(var + eps)) and sum of squared off-diagonal covariances over D."""
    from .fit import moment_matrix

    n, _, cov = moment_matrix(df, vec, dim)
    if n < 2:
        return 0.0, 0.0
    var = np.maximum(target - np.sqrt(np.diag(cov) + eps), 0).mean()
    off = cov - np.diag(np.diag(cov))
    return float(var), float((off**2).sum() / dim)


def cross_covariance_norm(df: DataFrame, left: str, n_left: int, right: str, n_right: int) -> float:
    """Frobenius norm of the sample covariance between two vector blocks."""
    from .fit import moment_matrix

    both = df.withColumn("_lr", F.concat(F.col(left).cast("array<double>"), F.col(right).cast("array<double>")))
    _, _, cov = moment_matrix(both, "_lr", n_left + n_right)
    return float(np.sqrt((cov[:n_left, n_left:] ** 2).sum()))


# element losses ------------------------------------------------------------------------------


def reconstruction_error(pred, obs, kind: str = "l1", delta: float = 1.0) -> Column:
    e = (F.col(pred) if isinstance(pred, str) else pred) - (F.col(obs) if isinstance(obs, str) else obs)
    a = F.abs(e)
    if kind == "l1":
        return a
    if kind in ("l2", "mse"):
        return e * e
    if kind == "huber":
        return F.when(a < delta, 0.5 * e * e).otherwise(delta * (a - 0.5 * delta))
    if kind == "smooth_l1":
        return F.when(a < 1, 0.5 * e * e).otherwise(a - 0.5)
    raise ValueError(f"unknown loss {kind!r}")


def count_nll(rate, target, kind: str = "poisson", dispersion: float = 1.0, full: bool = False, eps: float = 1e-8) -> Column:
    r = F.greatest(F.col(rate) if isinstance(rate, str) else rate, F.lit(eps))
    y = F.col(target) if isinstance(target, str) else target
    if kind == "poisson":
        out = r - y * F.ln(r)
        return out + log_gamma(y + 1.0) if full else out
    if kind == "negative_binomial":
        k = F.lit(float(dispersion))
        return -log_gamma(y + k) + log_gamma(y + 1.0) + log_gamma(k) - k * (F.ln(k) - F.ln(k + r)) - y * (F.ln(r) - F.ln(k + r))
    raise ValueError(f"unknown loss {kind!r}")


def categorical_ce(logits, target, class_weights: list[float] | None = None, smoothing: float = 0.0, ignore: int = -100) -> Column:
    """Per-row cross entropy; ignored targets give 0."""
    z = F.col(logits) if isinstance(logits, str) else logits
    t = F.col(target) if isinstance(target, str) else target
    w = F.array(*[F.lit(float(x)) for x in class_weights]) if class_weights else None
    hit = -log_softmax_pick(z, t)
    if w is not None:
        hit = hit * F.try_element_at(w, t.cast("int") + 1)
    if smoothing:
        m = F.array_max(z)
        lse = m + F.ln(F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - m)))
        every = F.zip_with(z, w, lambda v, c: (lse - v) * c) if w is not None else F.transform(z, lambda v: lse - v)
        hit = (1 - smoothing) * hit + smoothing * V.vsum(every) / F.size(z)
    return F.when(t == ignore, 0.0).otherwise(hit)


def reduced(df: DataFrame, loss: Column, mask: Column | None, how: str, out: str = "loss") -> DataFrame:
    """mean or sum over valid rows (0 when there are none) or the masked value per row."""
    if how == "none":
        return df.withColumn(out, F.when(mask, loss).otherwise(0.0) if mask is not None else loss)
    x = F.when(mask, loss) if mask is not None else loss
    return df.agg(F.coalesce(F.avg(x) if how == "mean" else F.sum(x), F.lit(0.0)).alias(out))


# code neighbourhoods -------------------------------------------------------------------------


def class_distance_profile(queries: DataFrame, refs: DataFrame, key: str, vec: str, label: str, tau: float, exclude_self: bool = True,
                           ref_block: int = REF_BLOCK, query_block: int = QUERY_BLOCK, within: tuple[str, ...] = (), shares: bool = True) -> DataFrame:
    """(i, label, n, s, lo, e): per query and class of references the number, sum and minimum of the distances and
    sum exp(-(d - lo)/tau), which is 0 without ``shares``.

    Pairs exist only inside a task, in slices; what leaves it is one row per query, class and block, and
    blocks merge by shifting the exponentials to the common minimum. ``within`` names key columns (a batch, a patch): only
    rows of one key are compared.
    """
    scope = [F.col(c).alias(f"_w{i}") for i, c in enumerate(within)]
    lt = refs.schema[label].dataType
    q = finite_vectors(queries.select(F.col(key).alias("_q"), F.col(vec).cast("array<double>").alias("_qv"), *scope), "_qv")
    r = finite_vectors(refs.filter(F.col(label).isNotNull()).select(F.col(key).alias("_r"), F.col(vec).cast("array<double>").alias("_rv"), F.col(label).alias("_l"), *scope), "_rv")
    schema = T.StructType([T.StructField("i", q.schema["_q"].dataType), T.StructField("label", lt), T.StructField("n", T.LongType()),
                           T.StructField("s", T.DoubleType()), T.StructField("lo", T.DoubleType()), T.StructField("e", T.DoubleType())])

    def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"i": qp["_q"].iloc[:0], "label": rp["_l"].iloc[:0], "n": np.array([], dtype="int64"), "s": np.array([], float),
                              "lo": np.array([], float), "e": np.array([], float)})
        if not len(qp) or not len(rp):
            return empty
        qv, rv, lab = _stack(qp["_qv"]), _stack(rp["_rv"]), rp["_l"].to_numpy()
        qid, rid = qp["_q"].to_numpy(), rp["_r"].to_numpy()
        codes, inv = np.unique(lab, return_inverse=True)
        order = np.argsort(inv, kind="stable")  # the columns of a class lie side by side
        rv, rid = rv[order], rid[order]
        sorted_codes = inv[order]
        starts = np.searchsorted(sorted_codes, np.arange(len(codes) + 1))
        tiles, same = _Tiles(qv, rv), _Same(qid, rid)
        every = (len(qv), len(codes))
        n, total, low, share = np.zeros(every, np.int64), np.zeros(every), np.full(every, np.inf), np.zeros(every)
        for at, cols, d in tiles:
            near = np.flatnonzero(d.ravel() <= 1e4 * tiles.error)  # too short for what a square may be off
            np.sqrt(np.maximum(d, 0.0, out=d), out=d)
            if len(near):
                d.ravel()[near] = _exact(qv[at], rv[cols], *np.divmod(near, d.shape[1]))
            if exclude_self:
                same.forbid(d, at, cols)
            whole = not exclude_self or not np.isinf(d.max())
            for c in range(sorted_codes[cols.start], sorted_codes[cols.stop - 1] + 1):
                block = d[:, max(starts[c] - cols.start, 0) : starts[c + 1] - cols.start]
                lo = block.min(1)
                ok = None if whole else np.isfinite(block)
                n[at, c] += block.shape[1] if whole else ok.sum(1)
                total[at, c] += block.sum(1) if whole or ok.all() else np.where(ok, block, 0.0).sum(1)
                if shares:
                    # nothing for an excluded row, and what is there moves to the smaller minimum
                    least = np.minimum(low[at, c], lo)
                    shift = np.where(np.isfinite(least), least, 0.0)
                    block -= shift[:, None]
                    block *= -1.0 / tau
                    share[at, c] = share[at, c] * np.exp((shift - low[at, c]) / tau) + np.exp(block, out=block).sum(1)
                low[at, c] = np.minimum(low[at, c], lo)
        at, c = np.nonzero(n)
        return pd.DataFrame({"i": qid[at], "label": codes[c], "n": n[at, c], "s": total[at, c], "lo": low[at, c], "e": share[at, c]})

    if within:
        parts = _scoped_join(q, r, kernel, schema, [f"_w{i}" for i in range(len(within))], ref_block, query_block)
    else:
        parts = block_product(q, r, kernel, schema, max(r.count(), 1), ref_block, query_block)
    parts = parts.withColumn("m", F.min("lo").over(Window.partitionBy("i", "label")))
    return parts.groupBy("i", "label").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"),
                                           F.sum(F.col("e") * F.exp(-(F.col("lo") - F.col("m")) / tau)).alias("e"))


def code_neighbourhood_kl(df: DataFrame, sim: DataFrame, weights: DataFrame, key: str, vec: str, code: str, tau_ref: float, tau_learned: float,
                          within: tuple[str, ...] = ()) -> DataFrame:
    """KL between the code graph's and the embedding's neighbour distribution over rows of other codes, one row.

    Reference distances depend on the two codes only, so a row needs its distance profile per code: N x codes
    numbers instead of N x N. ``within`` keeps rows to those of their own key, a batch say.
    """
    known = sim.select(F.col("a").alias(code)).distinct()
    valid = df.join(known, code, "left_semi")
    prof = class_distance_profile(valid, valid, key, vec, code, tau_learned, within=within)
    own = valid.select(F.col(key).alias("i"), F.col(code).alias("own"))
    p = prof.join(own, "i").filter(F.col("label") != F.col("own"))
    p = p.join(sim.select(F.col("a").alias("own"), F.col("b").alias("label"), (1 - F.col("p")).alias("dr")), ["own", "label"])
    w = Window.partitionBy("i")
    p = p.withColumns({"mr": F.min("dr").over(w), "ml": F.min("lo").over(w)})
    er = F.exp(-(F.col("dr") - F.col("mr")) / tau_ref)
    rows = p.groupBy("i", "own").agg(
        F.sum("n").alias("n"), F.first("mr").alias("mr"), F.first("ml").alias("ml"), F.sum(er * F.col("n")).alias("zr"), F.sum(er * F.col("n") * F.col("dr")).alias("rr"),
        F.sum(er * F.col("s")).alias("rl"), F.sum(F.col("e") * F.exp(-(F.col("lo") - F.col("ml")) / tau_learned)).alias("zl"),
        F.sum(F.when(F.col("dr") < 1 - 1e-6, F.col("n")).otherwise(0)).alias("n_conf"), F.sum(F.when(F.col("dr") < 1 - 1e-6, F.col("s")).otherwise(0.0)).alias("s_conf"),
        F.sum("s").alias("s_all")).filter("n >= 2")
    lse_r, lse_l = F.ln("zr") - F.col("mr") / tau_ref, F.ln("zl") - F.col("ml") / tau_learned
    kl = F.col("rl") / F.col("zr") / tau_learned - F.col("rr") / F.col("zr") / tau_ref - lse_r + lse_l
    rows = rows.withColumns({"kl": kl, "h": lse_r + F.col("rr") / F.col("zr") / tau_ref}).join(weights.select(F.col(code).alias("own"), F.col("weight").alias("w")), "own", "left")
    return rows.agg(
        F.try_divide(F.sum(F.col("w") * F.col("kl")), F.sum("w")).alias("loss"), F.count("*").alias("n_rows_active"), F.avg("h").alias("mean_entropy_ref"),
        F.exp(F.avg("h")).alias("eff_n_ref"), F.try_divide(F.sum("s_conf"), F.sum("n_conf")).alias("d_confused"),
        F.try_divide(F.sum(F.col("s_all") - F.col("s_conf")), F.sum(F.col("n") - F.col("n_conf"))).alias("d_other"), F.avg("n_conf").alias("n_confused_pairs"))
