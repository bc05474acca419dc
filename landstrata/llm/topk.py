"""Exact top-k inner products through a bit-sliced index.

Components become integers ``floor(scale * x)``. The rows are dealt into blocks by a hash of their id; a block stores, per
component, the slices of its values in coarse steps: bit i of every row's step as one bitmap. For a query, weights in
coarse steps multiply the slices by shifting, and bitmap adders sum them to the slices of a coarse score per row. The
k best coarse scores are selected from the most significant slice downward. What the steps leave out of a score is at
most ``|w| * |r| + |e| * |v|`` (query steps, row remainder, query remainder, row; Cauchy-Schwarz), so every row whose
coarse score comes within twice that bound of the k-th may be among the best; those rows are scored exactly.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do null ids; vectors of
different lengths have no common score; rows that repeat an id are candidates each, but none for their own id's query;
queries that repeat id and vector count once; equal scores go to the smaller id; other columns are ignored.
Components have to stay below 2**24 once scaled, so that scores are exact; a larger one fails the job.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landstrata.session import scratch_path

BLOCK = 16_384  # rows of a block
QUERIES = 256  # queries that meet a block at once
LARGEST = 1 << 24  # scaled components stay below it
STEPS = 4  # bits of a coarse value and of a coarse weight, besides the sign


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def quantised(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id, v``: whole numbers; one of LARGEST or more fails the job, since scores would no longer be exact."""
    def step(x):
        scaled = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(scaled) < LARGEST, F.floor(scaled)).otherwise(F.raise_error(F.concat(F.lit("component too large for exact scores: "), x.cast("string"))).cast("bigint"))

    whole = F.transform(F.col(vector), step)
    return df.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), whole.alias("v"))


def _coarse(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Values in steps of a power of two, at most STEPS bits besides the sign, and the exponent of the step."""
    top = int(np.abs(values).max(initial=0))
    shift = max(0, top.bit_length() - STEPS)
    half = (1 << shift) >> 1
    return (values + half) >> shift, shift


def _pack(flags: np.ndarray) -> np.ndarray:
    """Bitmaps of the rows, one per column of ``flags``, in 64-bit words."""
    rows = -len(flags) % 64
    return np.ascontiguousarray(np.packbits(np.pad(flags, ((0, rows), (0, 0))).T, axis=1, bitorder="little")).view(np.uint64)


def build_index(vectors: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """One row per block: ids, values, and the slices of the coarse values (offset to be unsigned)."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        values = np.stack(pdf["v"].to_numpy()).astype(np.int64).reshape(len(pdf), -1)
        coarse, shift = _coarse(values)
        low = coarse.min(initial=0)
        steps = coarse - low
        bits = max(1, int(steps.max(initial=0)).bit_length())
        slices = np.stack([_pack((steps >> i & 1).astype(np.uint8)) for i in range(bits)], axis=1)  # component, bit, words
        rest = values - (coarse << shift)
        return pd.DataFrame({
            "dim": [key[0]], "block": [key[1]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "values": [values.tobytes()],
            "slices": [slices.tobytes()], "bits": [bits], "shift": [shift],
            "rest": [float(np.sqrt((rest.astype(float) ** 2).sum(axis=1).max(initial=0)))],
            "norm": [float(np.sqrt((values.astype(float) ** 2).sum(axis=1).max(initial=0)))],
        })

    sizes = F.create_map(*[F.lit(x) for pair in sorted(blocks.items()) for x in pair]) if blocks else None
    dealt = vectors.withColumn("dim", F.size("v"))
    number = F.pmod(F.xxhash64("id"), F.element_at(sizes, F.col("dim"))) if blocks else F.lit(0)
    return dealt.withColumn("block", number.cast("int")).groupBy("dim", "block").applyInPandas(
        run, "dim int, block int, ids binary, values binary, slices binary, bits int, shift int, rest double, norm double")


def _add_columns(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Sum of weighted bitmaps as slices: three bitmaps of one weight become one of it and one of the next."""
    out, weight = [], 0
    while columns:
        stack = columns.pop(weight, [])
        maps = np.concatenate(stack) if stack else None
        while maps is not None and len(maps) > 1:
            if len(maps) == 2:
                a, b = maps[:1], maps[1:]
                total, carry, left = a ^ b, a & b, maps[:0]
            else:
                m = len(maps) // 3
                a, b, c = maps[:m], maps[m : 2 * m], maps[2 * m : 3 * m]
                half = a ^ b
                total, carry, left = half ^ c, (a & b) | (half & c), maps[3 * m :]
            columns.setdefault(weight + 1, []).append(carry)
            maps = np.concatenate([total, left])
        out.append(maps[0] if maps is not None else None)
        weight += 1
    zero = next((np.zeros_like(x) for x in out if x is not None), None)
    return [x if x is not None else zero for x in out]


def _top(slices: list[np.ndarray], alive: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of the rows in ``alive`` whose sum is at least the k-th largest, from the highest slice downward."""
    sure, open_ = np.zeros_like(alive), alive
    for s in reversed(slices):
        both = open_ & s
        n = int(np.bitwise_count(sure).sum() + np.bitwise_count(both).sum())
        if n > k:
            open_ = both
        elif n < k:
            sure, open_ = sure | both, open_ & ~s
        else:
            return sure | both
    return sure | open_


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _value(slices: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sums of the given rows."""
    out = np.zeros(len(rows), np.int64)
    for i, s in enumerate(slices):
        out += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << i
    return out


def _at_least(slices: list[np.ndarray], alive: np.ndarray, limit: int) -> np.ndarray:
    """Bitmap of the rows whose sum is ``limit`` or more."""
    if limit <= 0:
        return alive
    if limit >> len(slices):
        return np.zeros_like(alive)
    more, equal = np.zeros_like(alive), alive
    for i in range(len(slices) - 1, -1, -1):
        if limit >> i & 1:
            equal = equal & slices[i]
        else:
            more, equal = more | (equal & slices[i]), equal & ~slices[i]
    return more | equal


def search_block(block, query_ids: np.ndarray, query_values: np.ndarray, k: int):
    """(query position, id, score) of the k best rows of the block for each query, its own id left out."""
    ids = np.frombuffer(block.ids, np.int64)
    values = np.frombuffer(block.values, np.int64).reshape(len(ids), -1)
    dim, words = values.shape[1], -(-len(ids) // 64)
    slices = np.frombuffer(block.slices, np.uint64).reshape(dim, block.bits, words)
    present = _pack(np.ones((len(ids), 1), np.uint8))[0]
    found = []
    for at, (own, q) in enumerate(zip(query_ids, query_values)):
        weights, shift = _coarse(q)
        columns: dict[int, list[np.ndarray]] = {}
        for negative in (False, True):  # -w * x is w * (full - x) less a constant: inverted slices
            for bit in range(STEPS + 1):
                use = ((weights < 0) == negative) & ((np.abs(weights) >> bit & 1) == 1)
                if use.any():
                    for i in range(block.bits):
                        part = slices[use, i]
                        columns.setdefault(bit + i, []).append(~part if negative else part)
        sums = _add_columns(columns) or [np.zeros_like(present)]
        alive = present.copy()
        for i in np.arange(np.searchsorted(ids, own), np.searchsorted(ids, own, "right")):
            alive[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        best = _rows(_top(sums, alive, k))
        if not len(best):
            continue
        # coarse sum * 2**(both shifts) + constant differs from the score by at most err
        w = weights.astype(float)
        e = (q - (weights << shift)).astype(float)
        err = math.sqrt((w**2).sum()) * 2.0**shift * block.rest + math.sqrt((e**2).sum()) * block.norm
        step = 2.0 ** (shift + block.shift)
        if len(best) > k or len(best) == int(np.bitwise_count(alive).sum()):
            kth = int(np.sort(_value(sums, best))[-min(k, len(best))])
        else:
            kth = int(_value(sums, best).min())
        limit = kth - math.ceil(2 * err / step + 1e-6) if len(best) >= k else 0
        rows = _rows(_at_least(sums, alive, limit))
        scores = values[rows] @ q
        if len(rows) > k:
            order = np.lexsort((ids[rows], -scores))[:k]
            rows, scores = rows[order], scores[order]
        found.append((np.full(len(rows), at), ids[rows], scores))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id, rank, id, score``: the k rows of ``vectors`` with the highest integer inner product, per query."""
    spark = vectors.sparkSession
    rows = quantised(vectors, key, vector, scale)
    counts = {r["dim"]: r["n"] for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    blocks = {dim: -(-n // BLOCK) for dim, n in counts.items()}
    path = scratch_path(spark, "bit-sliced")
    build_index(rows, blocks).write.parquet(path)
    index = spark.read.parquet(path)

    asked = quantised(queries, key, vector, scale).distinct().withColumn("dim", F.size("v"))
    # queries in groups of about QUERIES; the groups meet every block of their length
    total = asked.count()
    grouped = (
        asked.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(max(1, -(-total // QUERIES)))).cast("int"))
        .groupBy("dim", "part").agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    )
    sizes = F.create_map(*[F.lit(x) for pair in sorted(blocks.items()) for x in pair]) if blocks else F.create_map().cast("map<int,int>")
    to_blocks = grouped.withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(sizes, F.col("dim")) - 1)))

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                ids = np.array([q["id"] for q in row.queries], np.int64)
                values = np.array([q["v"] for q in row.queries], np.int64).reshape(len(ids), -1)
                at, found, score = search_block(row, ids, values, k)
                if len(at):
                    yield pd.DataFrame({"query_id": ids[at], "query": row.part * 1_000_000 + at, "id": found, "score": score})

    hits = to_blocks.join(index, ["dim", "block"]).mapInPandas(run, "query_id bigint, query bigint, id bigint, score bigint")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
