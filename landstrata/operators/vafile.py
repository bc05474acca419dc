"""Exact neighbour searches on a vector-approximation file.

The file holds two bytes a dimension for each reference, its cell among 2^bits equal ones and its place in the cell
(``Grid.finer``), and the length of what the rounding left over. The place costs a second byte, but without it the bounds
leave a share of all pairs, whose vectors would have to be joined; with it they leave little more than the answers. With the cell centre c and the rest e of a reference, its distance to a query lies between |q - c| - e and
|q - c| + e. Only the file meets the queries, a quarter of the vectors' size, and a block of it may hold that many more
references. A block returns the references whose lower bound does not exceed the k-th upper bound; the k-th upper
bound over all blocks then cuts them to little more than k a query, and only these are joined with their vectors
for the exact distance. Bounds hold for every reference, so the answer is exact; dimensions of like weight, where the
triangle inequality over pivots leaves out nothing, do not matter.

The grid comes from the exact smallest and largest value of each dimension, 2 numbers a dimension on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 8
SLACK = 1e-8  # more than rounding distances to nine digits can move them


class Grid:
    """Equal cells between the extremes of each dimension."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int = BITS):
        if not 1 <= bits <= 8:
            raise ValueError("a code has 1 to 8 bits")
        self._cut(low, high, 1 << bits)

    def _cut(self, low: np.ndarray, high: np.ndarray, cells: int) -> None:
        self.low, self.high, self.cells, self.kind = low, high, cells, np.uint8 if cells <= 256 else np.uint16
        self.step = np.where(high > low, (high - low) / self.cells, 1.0)

    def finer(self) -> Grid:
        """Each cell cut into 256, which are named by two bytes."""
        out = Grid(self.low, self.high)
        out._cut(self.low, self.high, self.cells << 8)
        return out

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and upper bounds of what they leave over."""
        codes = np.clip(np.floor((v - self.low) / self.step), 0, self.cells - 1).astype(self.kind)
        rest = v - self.centres(codes)
        return codes, np.sqrt((rest * rest).sum(1)) * (1 + 1e-12) + 1e-12

    def centres(self, codes: np.ndarray) -> np.ndarray:
        return self.low + (codes + 0.5) * self.step


def learn_grid(refs: DataFrame, vec: str, bits: int = BITS) -> Grid | None:
    """The grid of a column of finite vectors of one length; None without rows."""
    x = F.col(vec)
    dim = refs.agg(F.max(F.size(x))).first()[0]
    if dim is None:
        return None
    ends = refs.agg(F.array(*[F.min(x[i]) for i in range(dim)]), F.array(*[F.max(x[i]) for i in range(dim)])).first()
    return Grid(np.array(ends[0], float), np.array(ends[1], float), bits)


def approximate(refs: DataFrame, vec: str, grid: Grid, whole: bool = False) -> DataFrame:
    """``vec`` replaced by ``_code`` and ``_rest``; with ``whole`` it stays beside them."""
    kept = [f for f in refs.schema.fields if whole or f.name != vec]
    schema = T.StructType(kept + [T.StructField("_code", T.BinaryType()), T.StructField("_rest", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            out = pdf if whole else pdf.drop(columns=[vec])
            if len(pdf):
                codes, rest = grid.encode(np.stack(pdf[vec].to_numpy()).astype(np.float64))
                yield out.assign(_code=[c.tobytes() for c in codes], _rest=rest)
            else:
                yield out.assign(_code=pd.Series([], dtype=object), _rest=np.array([], float))

    return refs.mapInPandas(run, schema)


def _bounds(part: np.ndarray, centres: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of all queries to all references."""
    a, b = (part * part).sum(1)[:, None], (centres * centres).sum(1)[None]
    d2 = a + b - 2.0 * part @ centres.T
    slip = 1e-13 * (a + b)  # of the product's rounding
    return np.sqrt(np.maximum(d2 - slip, 0.0)) - rest[None], np.sqrt(np.maximum(d2, 0.0) + slip) + rest[None]


def _screened(q: np.ndarray, centres: np.ndarray, rest: np.ndarray):
    """``part(at)``: approximate squared distances of a slice of queries, and ``least(at, x)``, ``most(at, x)``: squares below or above
    which no such number lies whose bounds reach the distances ``x`` of the queries."""
    from .neighbors import _Squares

    squares, far = _Squares(q, centres), rest.max()
    error = lambda at: squares.error[at] * (1 + 1e-6)

    def most(at: slice, x):
        return ((x + far + SLACK) ** 2 + error(at)) * (1 + 1e-6)

    def least(at: slice, x):
        return (np.maximum(x - far - SLACK, 0.0) ** 2 - error(at)) * (1 - 1e-6)

    def reached(at: slice, d2: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(d2 + error(at), 0.0)) + far

    return squares.part, least, most, reached


def _pair_bounds(q: np.ndarray, centres: np.ndarray, rest: np.ndarray, qi: np.ndarray, ri: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of listed pairs."""
    d = np.empty(len(qi))
    for s in range(0, len(qi), step):
        diff = q[qi[s : s + step]] - centres[ri[s : s + step]]
        d[s : s + step] = np.sqrt((diff * diff).sum(1))
    return d * (1 - 1e-12) - rest[ri], d * (1 + 1e-12) + rest[ri]


def _codes(rp: pd.DataFrame, grid: Grid) -> np.ndarray:
    return grid.centres(np.frombuffer(b"".join(rp["_code"]), grid.kind).reshape(len(rp), -1))


def candidate_kernel(grid: Grid, k: int, exclude_self: bool, allow, same_ids, excluded: int | None = None, rows: int | None = None):
    """Pairs of a block of queries and a block of the file that may be among the k nearest.

    A product in four bytes screens the pairs, and bounds are taken of those it leaves. ``excluded``: how many references ``allow``
    can forbid to a query, if that is known.
    """
    listed = getattr(allow, "listed", None) if excluded is not None else None

    def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        from .neighbors import _kth_or_more

        empty = pd.DataFrame({"_q": qp["_q"].iloc[:0], "_r": rp["_r"].iloc[:0], "lo": np.array([], float), "up": np.array([], float)})
        if not len(qp) or not len(rp):
            return empty
        q = np.stack(qp["_qv"].to_numpy()).astype(np.float64)
        qid, rid, rest, centres = qp["_q"].to_numpy(), rp["_r"].to_numpy(), rp["_rest"].to_numpy(), _codes(rp, grid)
        part, _, most, reached = _screened(q, centres, rest)
        out, same = [empty], same_ids(qid, rid)
        want = min(k + (excluded if listed else 0), len(rp))
        step = rows or max(16, (1 << 21) // len(rp))
        for s in range(0, len(q), step):
            at = slice(s, s + step)
            d2 = part(at)
            if exclude_self:
                same.forbid(d2, at)
            if allow is not None and listed is None:
                d2[~allow(qp.iloc[at], rp)] = np.inf
            limit = most(at, reached(at, _kth_or_more(d2, want).astype(np.float64)))
            hit = np.flatnonzero((d2 <= limit.astype(d2.dtype)[:, None]).ravel())
            hit = hit[np.isfinite(d2.ravel()[hit])]
            qi, ri = np.divmod(hit, len(rp))
            if listed is not None:
                ok = listed(qp.iloc[s + qi], rp.iloc[ri])
                qi, ri = qi[ok], ri[ok]
            lo, up = _pair_bounds(q[at], centres, rest, qi, ri)
            # places of a query lie side by side; its k-th smallest upper bound cuts its list
            order = np.lexsort((up, qi))
            starts = np.searchsorted(qi, np.arange(len(d2)))
            kth = np.minimum(starts + k, np.append(starts[1:], len(qi))) - 1
            keep = lo <= (up[order][kth] if len(qi) else np.zeros(len(d2)))[qi] + SLACK
            out.append(pd.DataFrame({"_q": qid[at][qi[keep]], "_r": rid[ri[keep]], "lo": lo[keep], "up": up[keep]}))
        return pd.concat(out[1:] or out, ignore_index=True)

    return kernel


def radius_kernel(grid: Grid, low: float, high: float, exclude_self: bool, same_ids, listed: bool = False):
    """The pairs of a block of queries and a block of the file, with its vectors, whose distance lies within [low, high).

    A radius may hold a share of all pairs, and a list of them would cost two vectors each. So whole vectors come with the block,
    and the distance is taken of the pairs that the bounds leave. With ``listed`` these pairs come back without one.
    """
    def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        from .neighbors import _exact

        empty = pd.DataFrame({"_q": qp["_q"].iloc[:0], "_r": rp["_r"].iloc[:0], "d": np.array([], float)})
        if not len(qp) or not len(rp):
            return empty
        q, r = (np.stack(p[c].to_numpy()).astype(np.float64) for p, c in ((qp, "_qv"), (rp, "_rv")))
        qid, rid = qp["_q"].to_numpy(), rp["_r"].to_numpy()
        centres, rest = _codes(rp, grid), rp["_rest"].to_numpy()
        part, least, most, _ = _screened(q, centres, rest)
        out, same = [empty], same_ids(qid, rid)
        step = max(16, (1 << 20) // len(rp))
        for s in range(0, len(q), step):
            at = slice(s, s + step)
            d2 = part(at)
            if exclude_self:
                same.forbid(d2, at)
            near = d2 <= most(at, high).astype(d2.dtype)[:, None]
            if low > 0:
                near &= d2 >= least(at, low).astype(d2.dtype)[:, None]
            hit = np.flatnonzero(near.ravel())
            qi, ri = np.divmod(hit[np.isfinite(d2.ravel()[hit])], len(rp))
            if listed:
                lo, up = _pair_bounds(q[at], centres, rest, qi, ri)
                d, ok = np.full(len(qi), np.nan), (lo < high + SLACK) & (up >= low - SLACK)
            else:
                d = _exact(q[at], r, qi, ri)
                ok = (d >= low) & (d < high)
            out.append(pd.DataFrame({"_q": qid[at][qi[ok]], "_r": rid[ri[ok]], "d": d[ok]}))
        return pd.concat(out[1:] or out, ignore_index=True)

    return kernel


def nearest_candidates(parts: DataFrame, k: int) -> DataFrame:
    """Candidates of all blocks cut by the k-th smallest upper bound of their query."""
    every = Window.partitionBy("_q").orderBy("up", "_r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.nth_value("up", k).over(every)
    return parts.withColumn("_lim", limit).filter(F.col("_lim").isNull() | (F.col("lo") <= F.col("_lim") + SLACK)).select("_q", "_r")


def exact_distances(pairs: DataFrame, q: DataFrame, r: DataFrame, digits: int) -> DataFrame:
    """``_q, _r, d`` of listed pairs from the vectors of both sides."""
    schema = T.StructType([pairs.schema["_q"], pairs.schema["_r"], T.StructField("d", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            d = np.array([], float)
            if len(pdf):
                diff = np.stack(pdf["_qv"].to_numpy()).astype(np.float64) - np.stack(pdf["_rv"].to_numpy()).astype(np.float64)
                d = np.round(np.sqrt((diff * diff).sum(1)), digits)
            yield pd.DataFrame({"_q": pdf["_q"], "_r": pdf["_r"], "d": d})

    both = pairs.join(r.select("_r", "_rv"), "_r").join(q.select("_q", "_qv"), "_q")
    return both.select("_q", "_r", "_qv", "_rv").mapInPandas(run, schema)
