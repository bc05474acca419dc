"""Exact search for the largest inner products, by bands of the references' norms.

By the Cauchy-Schwarz inequality no reference of a band scores more than |q| times the band's largest norm. Each query
first meets the bands of the largest norms that hold enough references; its k-th best score there tells which other
bands can still matter, and the query is sent to these only. Bands come from a sketch of the norms; any cuts are right, the
largest norm of each band is exact. A band with many rows, of equal norms say, is split by a hash of the id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .neighbors import DIGITS, QUERY_BLOCK, REF_BLOCK, _kth_or_more, _pair_schema, _Same, _side, _slice_rows, _stack, grown, size_and_width

MAX_BANDS = 256


def _kernel(k: int, exclude_self: bool):
    def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"_q": qp["_q"].iloc[:0], "_r": rp["_r"].iloc[:0], "d": np.array([], float)})
        if not len(qp) or not len(rp):
            return empty
        q, r = _stack(qp["_qv"]), _stack(rp["_rv"])
        qid, rid = qp["_q"].to_numpy(), rp["_r"].to_numpy()
        out, same, rows = [empty], _Same(qid, rid), _slice_rows(len(r))
        for s in range(0, len(q), rows):
            less = -np.round(q[s : s + rows] @ r.T, DIGITS)
            if exclude_self:
                same.forbid(less, slice(s, s + rows))
            kth = _kth_or_more(less, min(k, less.shape[1]))
            hit = np.flatnonzero((less <= kth[:, None]).ravel())
            hit = hit[np.isfinite(less.ravel()[hit])]
            qi, ri = np.divmod(hit, len(r))
            best = pd.DataFrame({"qi": qi, "_r": rid[ri], "d": 0.0 - less.ravel()[hit]}).sort_values(["qi", "d", "_r"], ascending=[True, False, True], kind="stable").groupby("qi").head(k)
            out.append(pd.DataFrame({"_q": qid[s : s + rows][best["qi"].to_numpy()], "_r": best["_r"].to_numpy(), "d": best["d"].to_numpy()}))
        return pd.concat(out[1:] or out, ignore_index=True)

    return kernel


def norm_bands(refs: DataFrame, n: int, band: int) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """References with ``_band``, largest norms first, and (band, rows, largest norm) of each."""
    bands = max(1, min(MAX_BANDS, math.ceil(n / band)))
    cuts = refs.agg(F.percentile_approx("_norm", [1 - (i + 1) / bands for i in range(bands - 1)], 10_000)).first()[0] if bands > 1 else []
    at = F.lit(0)
    for c in sorted(set(cuts), reverse=True):
        at = at + F.when(F.col("_norm") < c, 1).otherwise(0)
    banded = cut_lineage(refs.withColumn("_band", at))
    stats = banded.groupBy("_band").agg(F.count("*").alias("n"), F.max("_norm").alias("top")).collect()  # one row a band
    return banded, sorted((r["_band"], r["n"], r["top"]) for r in stats)


def route(queries: DataFrame, stats: list[tuple[int, int, float]], least: DataFrame, seeds: list[int]) -> DataFrame:
    """Queries with ``_band`` for each band besides the seeds that may hold one of their best; ``least``: _q, _least."""
    tops = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(float(top)).alias("top")) for b, _, top in stats if b not in seeds])
    reach = F.col("_least") - F.lit(1e-8) * (1 + F.abs("_least"))
    near = F.filter(tops, lambda x: F.col("_least").isNull() | (x["top"] * F.col("_qn") >= reach))
    return queries.join(least, "_q", "left").withColumn("_band", F.explode(F.transform(near, lambda x: x["b"]))).drop("_least")


def inner_product_join(queries: DataFrame, refs: DataFrame, k: int, *, qid: str = "id", rid: str = "id", qvec: str = "z", rvec: str = "z",
                       exclude_self: bool = True, band: int = REF_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(i, j, score, rank): the k references with the largest inner product of every query, ties by smaller id."""
    if k < 1:
        raise ValueError("k must be at least 1")

    def norm(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))

    q = _side(queries, qid, qvec, (), "q").withColumn("_qn", norm("_qv"))
    r = cut_lineage(_side(refs, rid, rvec, (), "r").withColumn("_norm", norm("_rv")))
    schema = _pair_schema(q, r)
    n, dim = size_and_width(r, "_rv")
    band = grown(band, n, dim)
    if not n:
        return queries.sparkSession.createDataFrame([], T.StructType(schema.fields[:2] + [T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])).toDF("i", "j", "score", "rank")
    banded, stats = norm_bands(r.select("_r", "_rv", "_norm"), n, band)
    seeds, held = [], 0
    for b, rows, _ in stats:
        if held >= k + exclude_self:
            break
        seeds.append(b)
        held += rows
    q = cut_lineage(q)
    n_queries = q.count()
    chunks = max(1, math.ceil(n_queries / grown(query_block, n_queries, dim)))
    subs = F.element_at(F.create_map(*[x for b, rows, _ in stats for x in (F.lit(b), F.lit(math.ceil(rows / band)))]), F.col("_band"))

    def meet(sent: DataFrame, bands: list[int]) -> DataFrame:
        qb = sent.withColumns({"_qc": F.pmod(F.xxhash64("_q"), F.lit(chunks)), "_sub": F.explode(F.sequence(F.lit(0), subs - 1))}).drop("_qn")
        rb = banded.filter(F.col("_band").isin(bands)).drop("_norm").withColumns({
            "_sub": F.pmod(F.xxhash64("_r"), subs).cast("int"), "_qc": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))})
        keys = ["_band", "_sub", "_qc"]
        return qb.groupBy(*keys).cogroup(rb.groupBy(*keys)).applyInPandas(_kernel(k, exclude_self), schema)

    def ranked(parts: DataFrame) -> DataFrame:
        order = Window.partitionBy("_q").orderBy(F.desc("d"), "_r")
        return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    best = cut_lineage(ranked(meet(q.withColumn("_band", F.explode(F.array(*[F.lit(b) for b in seeds]))), seeds)))
    others = [b for b, _, _ in stats if b not in seeds]
    if others:
        least = best.filter(F.col("rank") == k).select("_q", F.col("d").alias("_least"))
        best = ranked(best.drop("rank").unionByName(meet(route(q, stats, least, seeds), others)))
    return best.select(F.col("_q").alias("i"), F.col("_r").alias("j"), F.col("d").alias("score"), "rank")
