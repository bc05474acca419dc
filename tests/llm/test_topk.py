import math

import numpy as np
import pytest

from landstrata.llm import topk


def brute(vectors, queries, k):
    out = []
    rows = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in {(i, tuple(v)) for i, v in rows if i in queries}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id bigint, embedding array<float>, block int, dim string")


def run(spark, vectors, queries, k):
    df = frame(spark, vectors)
    got = topk.top_k(df, df.filter(df.vec_id.isin(list(queries))), k)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "id", "score").collect())


def vectors(n, dim, seed, scale=0.12):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.float32(rng.normal(0, scale, dim))]) for i in range(n)]


@pytest.mark.parametrize("block, queries", [(16_384, 256), (64, 3)])
def test_equals_brute_force(spark, monkeypatch, block, queries):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rows = vectors(700, 16, 1) + [(1000 + i, [0.25] * 16) for i in range(60)]
    assert run(spark, rows, set(range(0, 700, 70)) | {1005}, 10) == brute(rows, set(range(0, 700, 70)) | {1005}, 10)


def test_nulls_ties_repeats_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(40, 5, 2) + [(100, None), (101, [0.1, None, 0.1, 0.1, 0.1]), (102, [nan] * 5), (103, [inf, 0.0, 0.0, 0.0, 0.0]), (None, [0.5] * 5),
                                (104, [0.0] * 5), (105, [0.0] * 5), (105, [0.0] * 5), (106, [1.0, 2.0]), (107, [1.0, 2.0]), (3, [0.3] * 5), (108, []), (109, [9.0] * 5)]
    asked = {0, 3, 100, 101, 102, 103, 104, 105, 106, 109}
    assert run(spark, rows, asked, 7) == brute(rows, asked, 7)


def test_fewer_rows_than_k_and_no_rows(spark):
    rows = vectors(4, 3, 3)
    assert run(spark, rows, {0, 1}, 10) == brute(rows, {0, 1}, 10) and len(run(spark, rows, {0, 1}, 10)) == 6
    assert run(spark, [], {0}, 10) == [] and run(spark, rows, {77}, 10) == []


def test_bitmap_sums_and_selection():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 50, (6, 333))
    columns = {}
    for v in values:
        for bit in range(6):
            columns.setdefault(bit, []).append(topk._pack((v >> bit & 1).astype(np.uint8)[:, None]))
    slices, total = topk._add_columns(columns), values.sum(axis=0)
    rows = np.arange(333)
    assert (topk._value(slices, rows) == total).all()
    alive = topk._pack(np.ones((333, 1), np.uint8))[0]
    kth = np.sort(total)[-20]
    assert set(topk._rows(topk._top(slices, alive, 20))) == set(np.flatnonzero(total >= kth))
    for limit in (-5, 0, int(kth), int(total.max()), int(total.max()) + 1, 10**6):
        assert set(topk._rows(topk._at_least(slices, alive, limit))) == set(np.flatnonzero(total >= limit))


def test_components_too_large_for_exact_scores_fail(spark):
    rows = [(0, [0.5, 1.0]), (1, [1e15, 0.0])]
    with pytest.raises(Exception, match="component too large"):
        run(spark, rows, {0}, 3)
    rows[1] = (1, [16383.5, 0.0])
    assert run(spark, rows, {0}, 3) == brute(rows, {0}, 3)
