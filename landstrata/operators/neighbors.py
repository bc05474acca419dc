"""Exact nearest neighbours and radius joins on vectors.

Plan, for n reference vectors:

1. Copies of one vector beyond the few smallest ids can never be returned, so they are dropped first
   (row_number per vector, which Spark cuts inside each task before the shuffle).
2. With more than one block of references, a bounded number of pivots splits them into cells.  Distances
   to pivots bound the distance to every member of a cell (triangle inequality): a query is sent only to
   cells that may hold one of its k nearest.  The bound is exact, nothing is approximated.
3. Cells larger than one block are split by a hash of the id, and the queries of a cell are split the
   same way, so a task sees at most one block of references and one block of queries, whatever the skew.
4. A task returns the best k per query; a window merges the partial lists.
5. Blocks grow with the table up to a bounded size, so a row is copied about ``BLOCKS`` times and not in proportion to the
   table; on request the references that travel are their approximations (``vafile``): two bytes a dimension with bounds on
   the distance, and whole vectors are joined for the few pairs that the bounds leave.

The pivots and the per-cell bounds (a few numbers per pivot) are all that reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import vafile

REF_BLOCK = 4096
QUERY_BLOCK = 8192
MAX_PIVOTS = 256
DIGITS = 9  # distances are rounded before ties are broken by id
BLOCKS = 16  # of larger tables; blocks grow with the table up to so many numbers each
MOST_VALUES = 1 << 21
MOST_LISTED = 3 << 18  # where a block may return a share of all its pairs
TILE = (64, 2048)  # queries and references that are compared at once
MOST_PARTS = 256  # of a side's packed blocks
TASK_PAIRS = 1 << 26  # that are worth a task of their own
MOST_SENT = 1 << 18  # rows that a block returns at once

Allow = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def finite_vectors(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector has no missing, NaN or infinite element."""
    ok = F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.filter(F.col(vec).isNotNull() & ok)


def _side(df: DataFrame, key: str, vec: str, extra: tuple[str, ...], tag: str, within: tuple[str, ...] = ()) -> DataFrame:
    v = df.select(F.col(key).alias(f"_{tag}"), F.col(vec).cast("array<double>").alias(f"_{tag}v"), *[F.col(c).alias(f"{tag}_{c}") for c in extra],
                  *[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)])
    return finite_vectors(v, f"_{tag}v")


def _stack(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.zeros((0, 0))


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * a @ b.T, 0.0)


def _exact(q: np.ndarray, r: np.ndarray, qi: np.ndarray, ri: np.ndarray, step: int = 1024) -> np.ndarray:
    out = np.empty(len(qi))
    for s in range(0, len(qi), step):
        diff = q[qi[s : s + step]] - r[ri[s : s + step]]
        out[s : s + step] = np.sqrt((diff * diff).sum(1))
    return np.round(out, DIGITS)


def square_error(dim: int, unit: float) -> float:
    """Times |q|^2 + |r|^2: what a product in numbers of rounding ``unit`` may be off a squared distance."""
    return (2 * dim + 8) * unit


class _Squares:
    """Squared distances of a block by one matrix product, in four bytes where their range allows it, with an error bound."""

    def __init__(self, q: np.ndarray, r: np.ndarray):
        at = r.mean(0)
        self.q, r = q - at, r - at
        a, b = (self.q * self.q).sum(1), (r * r).sum(1)
        top = a.max() + b.max()
        self.kind = np.float32 if 1e-20 < top < 1e30 else np.float64
        self.error = square_error(q.shape[1], np.finfo(self.kind).eps / 2) * (a + b.max())
        self.q = np.hstack([-2 * self.q, a[:, None], np.ones((len(a), 1))]).astype(self.kind)
        self.r = np.ascontiguousarray(np.hstack([r, np.ones((len(b), 1)), b[:, None]]).astype(self.kind).T)

    def part(self, at: slice) -> np.ndarray:
        return self.q[at] @ self.r


class _Tiles:
    """Squared distances of a block in eight bytes, in tiles (queries, references, squares) that stay in the cache.

    The squares of a tile are overwritten by the next one; ``error`` bounds what they are off.
    """

    def __init__(self, q: np.ndarray, r: np.ndarray):
        a, b = (q * q).sum(1)[:, None], (r * r).sum(1)[:, None]
        self.q, r = np.hstack([-2 * q, a, np.ones_like(a)]), np.hstack([r, np.ones_like(b), b])
        self.r = [(slice(s, min(s + TILE[1], len(r))), np.ascontiguousarray(r[s : s + TILE[1]].T)) for s in range(0, len(r), TILE[1])]
        self.error = 2 * square_error(q.shape[1], np.finfo(float).eps / 2) * (a.max() + b.max())

    def __iter__(self):
        room = np.empty(TILE)
        for s in range(0, len(self.q), TILE[0]):
            part = self.q[s : s + TILE[0]]
            for cols, r in self.r:
                out = room.ravel()[: len(part) * r.shape[1]].reshape(len(part), r.shape[1])
                yield slice(s, s + len(part)), cols, np.matmul(part, r, out=out)


class _Same:
    """Places of equal ids in a block, for slices of its queries."""

    def __init__(self, qid: np.ndarray, rid: np.ndarray):
        index = pd.Index(rid)
        self.qid, self.rid = qid, rid
        self.at = index.get_indexer_for(qid) if index.is_unique else None

    def forbid(self, d2: np.ndarray, rows: slice, cols: slice = slice(0, None)) -> None:
        if self.at is not None:
            at = self.at[rows] - cols.start
            hit = np.flatnonzero((at >= 0) & (at < d2.shape[1]))
            d2[hit, at[hit]] = np.inf
        else:
            d2[self.qid[rows][:, None] == self.rid[cols][None, :]] = np.inf


def _kth_or_more(d2: np.ndarray, k: int) -> np.ndarray:
    """A value of each row that at least k of its entries do not exceed, close to the k-th smallest."""
    groups = d2.shape[1] // 32
    if groups >= 2 * k:
        # k groups have a minimum up to the k-th smallest minimum, so at least k entries have
        d2, k = d2[:, : groups * 32].reshape(len(d2), 32, groups).min(1), min(k, groups)
    return np.partition(d2, k - 1, axis=1)[:, k - 1]


def _slice_rows(n_refs: int) -> int:
    return max(16, (1 << 21) // n_refs)


def _topk_kernel(k: int, exclude_self: bool, allow: Allow | None, excluded: int | None = None):
    """The k nearest of a block. ``excluded``: how many of them ``allow`` can forbid to a query, if that is known."""
    listed = getattr(allow, "listed", None) if excluded is not None else None

    def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"_q": qp["_q"].iloc[:0], "_r": rp["_r"].iloc[:0], "d": np.array([], dtype=float)})
        if not len(qp) or not len(rp):
            return empty
        q, r = _stack(qp["_qv"]), _stack(rp["_rv"])
        qid, rid = qp["_q"].to_numpy(), rp["_r"].to_numpy()
        out = [empty]
        rmax = (r * r).sum(1).max()
        squares, same = _Squares(q, r), _Same(qid, rid)
        want = min(k + (excluded if listed else 0), len(r))
        rows = _slice_rows(len(r))
        for s in range(0, len(q), rows):
            at = slice(s, s + rows)
            part = q[at]
            tol = 1e-8 * (1.0 + (part * part).sum(1) + rmax)

            def close(d2: np.ndarray, slack: np.ndarray, kth) -> np.ndarray:
                if exclude_self:
                    same.forbid(d2, at)
                if allow is not None and listed is None:
                    d2[~allow(qp.iloc[at], rp)] = np.inf
                hit = np.flatnonzero((d2 <= (kth(d2) + slack).astype(d2.dtype)[:, None]).ravel())
                return hit[np.isfinite(d2.ravel()[hit])]

            hit = close(squares.part(at), (tol + 2 * squares.error[at]) * (1 + 1e-6), lambda x: _kth_or_more(x, want))
            if len(hit) > 8 * want * len(part):  # many rows closer than the short product tells apart
                hit = close(_sq(part, r), tol, lambda x: np.partition(x, want - 1, axis=1)[:, want - 1])
            qi, ri = np.divmod(hit, len(r))
            if listed is not None:
                ok = listed(qp.iloc[s + qi], rp.iloc[ri])
                qi, ri = qi[ok], ri[ok]
            d = _exact(part, r, qi, ri)
            best = pd.DataFrame({"qi": qi, "_r": rid[ri], "d": d}).sort_values(["qi", "d", "_r"], kind="stable").groupby("qi").head(k)
            out.append(pd.DataFrame({"_q": qid[at][best["qi"].to_numpy()], "_r": best["_r"].to_numpy(), "d": best["d"].to_numpy()}))
        return pd.concat(out[1:] or out, ignore_index=True)

    return kernel


def rounded_distances(d2: np.ndarray, most: float, q: np.ndarray, r: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The distances ``_exact`` gives of the pairs at the places ``hit`` of all pairs, from squares that are off by ``most`` at most.

    Only pairs whose square is too small for that error, or whose distance lies at a rounding edge, are computed again.
    """
    d = np.sqrt(np.maximum(d2, 0.0))
    x = d * 10.0**DIGITS
    out = np.rint(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        again = np.flatnonzero((np.abs(x - out) >= 0.5 - (most / d + 1e-14 * (1.0 + d)) * 10.0**DIGITS) | ~(d2 > 1e4 * most))
    out /= 10.0**DIGITS
    if len(again):
        out[again] = _exact(q, r, *np.divmod(hit[again], len(r)))
    return out


def _radius_kernel(lo: float, hi: float, exclude_self: bool, allow: Allow | None):
    def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"_q": qp["_q"].iloc[:0], "_r": rp["_r"].iloc[:0], "d": np.array([], dtype=float)})
        if not len(qp) or not len(rp):
            return empty
        q, r = _stack(qp["_qv"]), _stack(rp["_rv"])
        qid, rid = qp["_q"].to_numpy(), rp["_r"].to_numpy()
        found: list[tuple] = []
        tiles, same = _Tiles(q, r), _Same(qid, rid)
        tol = 1e-8 * (1.0 + hi * hi) + tiles.error
        for at, cols, d2 in tiles:
            if exclude_self:
                same.forbid(d2, at, cols)
            if allow is not None:
                d2[~allow(qp.iloc[at], rp.iloc[cols])] = np.inf
            near = d2 <= hi * hi + tol
            if lo > 0:
                near &= d2 >= lo * lo - tol
            hit = np.flatnonzero(near.ravel())
            squares = d2.ravel()[hit]
            hit, squares = hit[np.isfinite(squares)], squares[np.isfinite(squares)]
            d = rounded_distances(squares, tiles.error, q[at], r[cols], hit)
            ok = (d >= lo) & (d < hi)
            qi, ri = np.divmod(hit[ok], d2.shape[1])
            found.append((qid[at][qi], rid[cols][ri], d[ok]))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("_q", "_r", "d"), zip(*found))})

    return kernel


def grown(block: int, n: int, dim: int | None, most: int = MOST_VALUES) -> int:
    """A block of ``block`` rows or more: so many that ``n`` rows make about BLOCKS blocks, within ``most`` numbers.

    Every row is copied once per block of the other side; with blocks of a fixed size the copies grow with the square of the table.
    """
    return max(block, min(math.ceil(n / BLOCKS), most // max(1, dim or 1)))


def size_and_width(df: DataFrame, vec: str) -> tuple[int, int]:
    """Rows, and the numbers of a vector."""
    n, dim = df.agg(F.count("*"), F.max(F.size(vec))).first()
    return n, dim or 0


def block_product(q: DataFrame, r: DataFrame, kernel, schema: str | T.StructType, n_refs: int, ref_block: int, query_block: int,
                  most: int = MOST_VALUES) -> DataFrame:
    """Apply ``kernel(query rows, reference rows)`` to every pair of blocks without pruning; ``most`` numbers in a grown block.

    Blocks are packed once and read by the tasks of their pairs, so nothing is shuffled in proportion to the number of blocks.
    """
    n_queries, dim = size_and_width(q, "_qv")
    ref_block, query_block = grown(ref_block, n_refs, dim, most), grown(query_block, n_queries, dim, most)
    subs = max(1, math.ceil(n_refs / ref_block))
    chunks = max(1, math.ceil(n_queries / query_block), min(q.sparkSession.sparkContext.defaultParallelism, math.ceil(n_queries / 64)))
    tasks = max(q.sparkSession.sparkContext.defaultParallelism, math.ceil(n_queries * n_refs / TASK_PAIRS))
    return _meet(_packed(q, "_q", chunks), _packed(r, "_r", subs), kernel, schema, tasks)


def _packed(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """``_data``: a row for each of ``blocks`` blocks, dealt by a hash of ``key``, which holds the block's rows as an Arrow stream."""
    parts = min(blocks, MOST_PARTS)

    def pack(batches):
        rows = [x for x in batches if x.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        place = table.column("_b").to_numpy()
        for b in np.unique(place):
            block = (table if blocks == parts else table.filter(pa.array(place == b))).drop_columns(["_b"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema) as out:
                out.write_table(block)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["_data"])

    dealt = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return cut_lineage(dealt.repartitionById(parts, F.pmod("_b", F.lit(parts))).mapInArrow(pack, "_data binary"))


def _meet(q: DataFrame, r: DataFrame, kernel, schema, tasks: int) -> DataFrame:
    """``kernel`` on every pair of packed blocks, in up to ``tasks`` tasks, which read the blocks where they are stored: no row is copied."""
    def run(batches):
        for pdf in batches:
            for a, b in zip(pdf["_qdata"], pdf["_data"]):
                out = kernel(*[pa.ipc.open_stream(x).read_pandas() for x in (a, b)])
                for at in range(0, len(out), MOST_SENT):
                    yield out.iloc[at : at + MOST_SENT]

    return q.withColumnRenamed("_data", "_qdata").hint("shuffle_replicate_nl").crossJoin(r).coalesce(tasks).mapInPandas(run, schema)


def scoped_blocks(q: DataFrame, r: DataFrame, scope: list[str], ref_block: int, query_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_sub`` and ``_qc``: rows of one scope key meet, in blocks of bounded size, and no others.

    A query is copied once per block of its own key's references, a reference once per block of its key's queries.
    """
    sizes = r.groupBy(*scope).agg(F.count("*").alias("_nr")).join(q.groupBy(*scope).agg(F.count("*").alias("_nq")), scope).select(
        *scope, F.ceil(F.col("_nr") / ref_block).alias("_subs"), F.ceil(F.col("_nq") / query_block).alias("_chunks"))
    qb, rb = q.join(sizes, scope), r.join(sizes, scope)
    zero = F.lit(0).cast("long")
    qb = qb.withColumns({"_qc": F.pmod(F.xxhash64("_q"), F.col("_chunks")), "_sub": F.explode(F.sequence(zero, F.col("_subs") - 1))})
    rb = rb.withColumns({"_sub": F.pmod(F.xxhash64("_r"), F.col("_subs")), "_qc": F.explode(F.sequence(zero, F.col("_chunks") - 1))})
    return qb.drop("_subs", "_chunks"), rb.drop("_subs", "_chunks")


def _scoped_join(q: DataFrame, r: DataFrame, kernel, schema, scope: list[str], ref_block: int, query_block: int) -> DataFrame:
    qb, rb = scoped_blocks(q, r, scope, ref_block, query_block)
    keys = [*scope, "_sub", "_qc"]
    return qb.groupBy(*keys).cogroup(rb.groupBy(*keys)).applyInPandas(kernel, schema)


def _assign_cells(df: DataFrame, vec: str, pivots: np.ndarray) -> DataFrame:
    """Append the nearest pivot and the distance to it."""
    schema = T.StructType(df.schema.fields + [T.StructField("_cell", T.IntegerType()), T.StructField("_dp", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            d2 = _sq(_stack(pdf[vec]), pivots) if len(pdf) else np.zeros((0, len(pivots)))
            cell = d2.argmin(1) if len(pdf) else np.array([], dtype=int)
            # exact distance to the chosen pivot keeps the bounds sound
            dp = np.sqrt(((_stack(pdf[vec]) - pivots[cell]) ** 2).sum(1)) if len(pdf) else np.array([])
            yield pdf.assign(_cell=cell.astype("int32"), _dp=dp)

    return df.mapInPandas(run, schema)


def _route(df: DataFrame, pivots: np.ndarray, cells: dict[int, tuple], need: int | None, radius: float | None) -> DataFrame:
    """Append the cells that may hold an answer of each query."""
    schema = T.StructType(df.schema.fields + [T.StructField("_cells", T.ArrayType(T.IntegerType()))])
    ids = np.array(sorted(cells))
    count = np.array([cells[c][0] for c in ids], dtype=float)
    rmin, rmax = np.array([cells[c][1] for c in ids]), np.array([cells[c][2] for c in ids])
    rk = np.array([cells[c][3] if cells[c][3] is not None else np.inf for c in ids])
    centres = pivots[ids]

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                yield pdf.assign(_cells=pd.Series([], dtype=object))
                continue
            v = _stack(pdf["_qv"])
            d = np.sqrt(_sq(v, centres))
            slack = 1e-6 * (1.0 + d)
            if radius is not None:
                bound = np.full(len(v), radius)
            elif need is None:
                bound = np.full(len(v), np.inf)
            else:
                # one cell alone holds enough members, or several together do
                bound = (d + rk[None]).min(1)
                far = d + rmax[None]
                order = np.argsort(far, axis=1)
                enough = np.cumsum(count[order], axis=1) >= need
                first = enough.argmax(1)
                several = np.where(enough.any(1), np.take_along_axis(far, order, 1)[np.arange(len(v)), first], np.inf)
                bound = np.minimum(bound, several)
            low = np.maximum(d - rmax[None], rmin[None] - d)
            hit = low - slack <= bound[:, None] * (1 + 1e-9) + 1e-9
            yield pdf.assign(_cells=[ids[h].astype("int32") for h in hit])

    return df.mapInPandas(run, schema)


def _lookup(values: dict[int, int], key: Column) -> Column:
    items = [x for c, n in sorted(values.items()) for x in (F.lit(int(c)), F.lit(int(n)))]
    return F.element_at(F.create_map(*items), key)


def _cell_join(q: DataFrame, r: DataFrame, kernel, schema, n_refs: int, need: int | None, radius: float | None,
               n_pivots: int, ref_block: int, query_block: int, grid: vafile.Grid | None = None, most: int = MOST_VALUES,
               whole: bool = False) -> DataFrame:
    """Pairs of blocks whose cells may hold an answer; with ``grid`` the references' approximations meet the queries.

    Where many cells leave out little, queries would only be copied to all of them, so BLOCKS cells do instead.
    """
    n_queries, dim = size_and_width(q, "_qv")
    ref_block, query_block = grown(ref_block, n_refs, dim, most), grown(query_block, n_queries, dim, most)
    # pivots: a bounded, seeded sample of the references
    sample = np.array([row[0] for row in r.select("_rv").orderBy(F.xxhash64("_rv"), "_rv").limit(n_pivots).collect()], dtype=np.float64)
    tries = [sample[:n] for n in sorted({n_pivots, min(n_pivots, BLOCKS)}, reverse=True)]
    for chosen in tries:
        pivots = np.unique(chosen, axis=0)
        ra = cut_lineage(_assign_cells(r, "_rv", pivots))
        stats = ra.groupBy("_cell").agg(F.count("*").alias("n"), F.min("_dp").alias("lo"), F.max("_dp").alias("hi"))
        if need is not None:
            w = Window.partitionBy("_cell").orderBy("_dp", "_r")
            kth = ra.select("_cell", "_dp", "_r").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= need)
            kth = kth.filter(F.col("_rn") == need).select("_cell", F.col("_dp").alias("rk"))
            stats = stats.join(kth, "_cell", "left")
        else:
            stats = stats.withColumn("rk", F.lit(None).cast("double"))
        cells = {s["_cell"]: (s["n"], s["lo"], s["hi"], s["rk"]) for s in stats.collect()}  # one row per pivot
        routed = cut_lineage(_route(q, pivots, cells, need, radius))
        load = {s["_cell"]: s["n"] for s in routed.select(F.explode("_cells").alias("_cell")).groupBy("_cell").agg(F.count("*").alias("n")).collect()}
        copies, met = sum(load.values()), sum(x * cells[c][0] for c, x in load.items())
        if copies <= BLOCKS * n_queries or copies <= 4 * BLOCKS * n_queries and 4 * met <= n_queries * n_refs:
            break
    if 2 * met > n_queries * n_refs:  # cells leave out too little to pay for the copies
        r = r if grid is None else vafile.approximate(r, "_rv", grid, whole)
        return block_product(q, r, kernel, schema, n_refs, ref_block, query_block, most)
    routed = routed.withColumn("_cell", F.explode("_cells")).drop("_cells")
    subs = {c: max(1, math.ceil(v[0] / ref_block)) for c, v in cells.items()}
    chunks = {c: max(1, math.ceil(load.get(c, 0) / query_block)) for c in cells}
    qb = routed.withColumn("_qc", F.pmod(F.xxhash64("_q"), _lookup(chunks, F.col("_cell"))))
    qb = qb.withColumn("_sub", F.explode(F.sequence(F.lit(0), _lookup(subs, F.col("_cell")) - 1)))
    rb = ra.filter(F.col("_cell").isin(*load) if load else F.lit(False))
    rb = rb if grid is None else vafile.approximate(rb, "_rv", grid, whole)
    rb = rb.withColumn("_sub", F.pmod(F.xxhash64("_r"), _lookup(subs, F.col("_cell"))).cast("int"))
    rb = rb.withColumn("_qc", F.explode(F.sequence(F.lit(0).cast("long"), (_lookup(chunks, F.col("_cell")) - 1).cast("long"))))
    keys = ["_cell", "_sub", "_qc"]
    return qb.groupBy(*keys).cogroup(rb.groupBy(*keys)).applyInPandas(kernel, schema)


def _pair_schema(q: DataFrame, r: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("_q", q.schema["_q"].dataType), T.StructField("_r", r.schema["_r"].dataType), T.StructField("d", T.DoubleType())])


def knn_join(queries: DataFrame, refs: DataFrame, k: int, *, qid: str = "id", rid: str = "id", qvec: str = "z", rvec: str = "z",
             exclude_self: bool = True, q_extra: tuple[str, ...] = (), r_extra: tuple[str, ...] = (), allow: Allow | None = None,
             max_excluded: int | None = 0, ref_block: int = REF_BLOCK, query_block: int = QUERY_BLOCK, pivots: int | None = None,
             within: tuple[str, ...] = (), bits: int | None = None) -> DataFrame:
    """(i, j, d, rank): the k nearest references of every query by Euclidean distance, ties by smaller id.

    ``within`` names key columns of both sides (a batch, a patch): only rows of one key are compared, a null key
    matches none, and no row is copied beyond its key.  Without it the whole table is searched; where vectors have many
    dimensions of like weight, pivots exclude little and that search compares nearly all blocks. With ``bits`` a dimension
    approximations of the references meet the queries, and whole vectors the pairs that their bounds leave.

    ``allow`` is a vectorised pair predicate on the extra columns (``q_*`` and ``r_*``).  ``max_excluded``
    says how many references it can forbid to one query; with None no pruning and no de-duplication happen.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    q, r = _side(queries, qid, qvec, q_extra, "q", within), _side(refs, rid, rvec, r_extra, "r", within)
    scope = [f"_w{i}" for i in range(len(within))]
    need = None if (allow is not None and max_excluded is None) else k + int(exclude_self) + (max_excluded or 0 if allow is not None else 0)
    if need is not None:
        # the hash comes first, so vectors are compared only where hashes are equal
        r = r.withColumn("_rh", F.xxhash64("_rv"))
        w = Window.partitionBy(*scope, "_rh", "_rv").orderBy("_r")
        r = r.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= need).drop("_rn", "_rh")
    kernel = _topk_kernel(k, exclude_self, allow, max_excluded)
    schema = _pair_schema(q, r)
    if scope:
        return _ranked(_scoped_join(q, cut_lineage(r), kernel, schema, scope, ref_block, query_block), k)
    r = cut_lineage(r)  # counted, sampled for pivots and joined: computed once
    n = r.count()
    if n == 0:
        return q.sparkSession.createDataFrame([], T.StructType([
            T.StructField("i", schema[0].dataType), T.StructField("j", schema[1].dataType), T.StructField("d", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    if n <= ref_block and pivots is None and bits is None:
        return _ranked(block_product(q, r, kernel, schema, n, ref_block, query_block), k)
    n_pivots = pivots or min(MAX_PIVOTS, max(2, math.ceil(n / ref_block)))
    if bits is None:
        return _ranked(_cell_join(q, r, kernel, schema, n, need, None, n_pivots, ref_block, query_block), k)
    grid = vafile.learn_grid(r, "_rv", bits).finer()
    kernel = vafile.candidate_kernel(grid, k, exclude_self, allow, _Same, max_excluded)
    parts = _cell_join(q, r, kernel, _bound_schema(q, r), n, need, None, n_pivots, ref_block, query_block, grid)
    return _ranked(vafile.exact_distances(vafile.nearest_candidates(parts, k), q, r, DIGITS), k)


def _bound_schema(q: DataFrame, r: DataFrame) -> T.StructType:
    return T.StructType([*_pair_schema(q, r).fields[:2], T.StructField("lo", T.DoubleType()), T.StructField("up", T.DoubleType())])


def _ranked(parts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("_q").orderBy("d", "_r")
    best = parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select(F.col("_q").alias("i"), F.col("_r").alias("j"), "d", "rank")


def radius_join(queries: DataFrame, refs: DataFrame, min_d: float, max_d: float, *, qid: str = "id", rid: str = "id", qvec: str = "z",
                rvec: str = "z", exclude_self: bool = True, ref_block: int = REF_BLOCK, query_block: int = QUERY_BLOCK,
                pivots: int | None = None, within: tuple[str, ...] = (), bits: int | None = None) -> DataFrame:
    """(i, j, d) with min_d <= d < max_d; cells farther than ``max_d`` are never visited, nor rows of another ``within`` key.

    With ``bits`` the distance is taken of the pairs that the bounds of the references' approximations allow.
    """
    q, r = _side(queries, qid, qvec, (), "q", within), _side(refs, rid, rvec, (), "r", within)
    kernel, schema = _radius_kernel(min_d, max_d, exclude_self, None), _pair_schema(q, r)
    if within:
        parts = _scoped_join(q, r, kernel, schema, [f"_w{i}" for i in range(len(within))], ref_block, query_block)
        return parts.select(F.col("_q").alias("i"), F.col("_r").alias("j"), "d")
    if bits is not None:
        q, r = q.filter(F.col("_q").isNotNull()), r.filter(F.col("_r").isNotNull())
    r = cut_lineage(r)
    n = r.count()
    if bits is not None and n:
        grid = vafile.learn_grid(r, "_rv", bits).finer()
        cells = pivots or min(MAX_PIVOTS, max(2, math.ceil(math.sqrt(n))))

        def found(q: DataFrame, r: DataFrame, listed: bool) -> DataFrame:
            kernel = vafile.radius_kernel(grid, min_d, max_d, exclude_self, _Same, listed)
            return _cell_join(q, r, kernel, schema, n, None, max_d, cells, ref_block, query_block, grid, MOST_LISTED, True)

        # a listed pair stands for all rows of its two ids, which only matters where an id comes more than once
        many = {c: cut_lineage(x.groupBy(c).agg(F.count("*").alias("_n")).filter("_n > 1").select(c)) for c, x in (("_q", q), ("_r", r))}
        if many["_q"].isEmpty() and many["_r"].isEmpty():
            parts = found(q, r, False)
        else:
            (q1, q2), (r1, r2) = ([cut_lineage(x.join(many[c], c, how)) for how in ("left_anti", "left_semi")] for c, x in (("_q", q), ("_r", r)))
            sides = [(a, b) for a, b in ((q2, r), (q1, r2)) if not a.isEmpty() and not b.isEmpty()]
            lists = [vafile.exact_distances(found(a, b, True).select("_q", "_r"), q, r, DIGITS).filter((F.col("d") >= min_d) & (F.col("d") < max_d)) for a, b in sides]
            once = [] if q1.isEmpty() or r1.isEmpty() else [found(q1, r1, False)]
            parts = reduce(DataFrame.unionByName, [*once, *lists], q.sparkSession.createDataFrame([], schema))
    elif n <= ref_block and pivots is None:
        parts = block_product(q, r, kernel, schema, max(n, 1), ref_block, query_block, MOST_LISTED)
    else:
        parts = _cell_join(q, r, kernel, schema, n, None, max_d, pivots or min(MAX_PIVOTS, max(2, math.ceil(math.sqrt(n)))), ref_block, query_block, most=MOST_LISTED)
    return parts.select(F.col("_q").alias("i"), F.col("_r").alias("j"), "d")
