"""Work, copies and state of large runs, each beside a plain version of the result."""

import numpy as np


def plain_change_state(batches, fast, base):
    state, out = {}, []
    for rows in batches:
        for pixel in {r[0] for r in rows}:
            last, events, seen = state.get(pixel, (base, 0, -1))
            for _, yr, code in sorted((r for r in rows if r[0] == pixel), key=lambda r: (r[1], r[2] is None, r[2] or 0)):
                if yr <= seen:
                    out.append((pixel, yr, None, None, None, None, True))
                    continue
                seen = yr
                if code in fast:
                    last, events = max(last, yr), events + 1
                out.append((pixel, yr, last, events, yr - last, last == base, False))
            state[pixel] = last, events, seen
    return sorted(out, key=str)


def test_stream_state_is_kept_by_bucket(spark, tmp_path):
    from landstrata.operators.timeseries import BASE_YEAR, FAST_CODES
    from landstrata.streaming import streams as ST

    rng = np.random.default_rng(4)
    pixels, codes = [None, *range(200), 2**60 + 1, 2**60 + 2], [None, 11, *FAST_CODES[:2]]
    batches = [[(pixels[rng.integers(len(pixels))], int(rng.integers(2000, 2004 + 2 * b)), codes[rng.integers(len(codes))]) for _ in range(900)] for b in range(3)]
    src = str(tmp_path / "in")
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, "pixel long, yr int, change int").coalesce(1).write.parquet(f"{src}/{b}")
    recs = spark.readStream.schema("pixel long, yr int, change int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    stream = ST.stream_change_state(recs, "pixel", "yr", "change", buckets=5)
    q = stream.writeStream.outputMode("append").format("memory").queryName("by_bucket").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((tuple(r) for r in spark.table("by_bucket").collect()), key=str)
    assert got == plain_change_state(batches, set(FAST_CODES), BASE_YEAR)
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 6  # five buckets and the one of the null pixel


def vectors(spark, v, label=None):
    rows = [(i, [float(x) for x in row], int(label[i]) if label is not None else 0) for i, row in enumerate(v)]
    return spark.createDataFrame(rows, "id bigint, z array<double>, label int")


def test_blocks_meet_without_a_shuffle_of_copies(spark):
    from landstrata.operators import neighbors

    v = np.random.default_rng(1).normal(size=(300, 5))
    t = vectors(spark, v)
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 9)
    got = neighbors.radius_join(t, t, 0.5, 6.0, pivots=30, ref_block=20, query_block=30)  # a radius that leaves out no cell
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["i"], r["j"], r["d"]) for r in got.collect()) == [(i, j, d[i, j]) for i in range(300) for j in range(300) if i != j and 0.5 <= d[i, j] < 6.0]


def test_more_blocks_than_parts(spark, monkeypatch):
    import pandas as pd

    from landstrata.operators import neighbors

    monkeypatch.setattr(neighbors, "MOST_PARTS", 3)
    monkeypatch.setattr(neighbors, "BLOCKS", 10**6)
    t = vectors(spark, np.random.default_rng(2).normal(size=(80, 2)))
    q, r = neighbors._side(t, "id", "z", (), "q"), neighbors._side(t, "id", "z", (), "r")
    kernel = lambda a, b: pd.DataFrame({"_q": np.repeat(a["_q"].to_numpy(), len(b)), "_r": np.tile(b["_r"].to_numpy(), len(a)), "d": 0.0})
    got = neighbors.block_product(q, r, kernel, neighbors._pair_schema(q, r), 80, 7, 9, 0).collect()
    assert sorted((x["_q"], x["_r"]) for x in got) == [(i, j) for i in range(80) for j in range(80)]


def test_file_radius_lists_no_pairs_for_a_join(spark, monkeypatch):
    from landstrata.operators import neighbors, vafile

    monkeypatch.setattr(vafile, "exact_distances", lambda *a: 1 / 0)  # joins two vectors to each listed pair
    v = np.random.default_rng(3).normal(size=(200, 8))
    v[9], v[11] = v[10], v[10] + 1e-8
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 9)
    got = neighbors.radius_join(vectors(spark, v), vectors(spark, v), 0.0, 4.0, bits=8, ref_block=30, query_block=40).collect()
    assert sorted((r["i"], r["j"], r["d"]) for r in got) == [(i, j, d[i, j]) for i in range(200) for j in range(200) if i != j and d[i, j] < 4.0]


def test_file_radius_with_ids_that_repeat(spark):
    """A listed pair stands for every row of its two ids, as before."""
    from landstrata.operators import neighbors

    v = np.random.default_rng(5).normal(size=(60, 3))
    ids = [0, 0, 0, *range(1, 58)]
    t = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in zip(ids, v)], "id bigint, z array<double>")
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 9)
    inside = [(a, b) for a in range(60) for b in range(60) if ids[a] != ids[b] and d[a, b] < 1.5]
    want = [(ids[a], ids[b], d[c, e]) for a, b in inside for c in range(60) for e in range(60) if ids[c] == ids[a] and ids[e] == ids[b] and d[c, e] < 1.5]
    for bits in (8, 6):
        got = neighbors.radius_join(t, t, 0.0, 1.5, bits=bits, ref_block=20, query_block=20).collect()
        assert sorted((r["i"], r["j"], r["d"]) for r in got) == sorted(want)
    none = t.filter("id < 0")
    assert neighbors.radius_join(none, t, 0.0, 1.5, bits=8).count() == neighbors.radius_join(t, t.selectExpr("cast(null as bigint) id", "z"), 0.0, 1.5, bits=8).count() == 0


def test_file_takes_few_bounds():
    """Bounds in eight bytes are taken of the pairs that a shorter product leaves; a predicate is asked of these only."""
    import pandas as pd

    from landstrata.operators import neighbors, vafile

    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 24))
    v[5] = v[6]
    grid = vafile.Grid(v.min(0), v.max(0), 8).finer()
    codes, rest = grid.encode(v)
    ids, asked = np.arange(len(v)), []

    def allow(q, r):
        return (q["_q"].to_numpy()[:, None] - r["_r"].to_numpy()[None]) % 100 != 1

    def listed(q, r):
        asked.append(len(q))
        return (q["_q"].to_numpy() - r["_r"].to_numpy()) % 100 != 1

    allow.listed = listed
    qp = pd.DataFrame({"_q": ids, "_qv": list(v)})
    rp = pd.DataFrame({"_r": ids, "_code": [c.tobytes() for c in codes], "_rest": rest})
    got = vafile.candidate_kernel(grid, 4, True, allow, neighbors._Same, 15, 500)(qp, rp)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    assert (got["lo"] <= d[got["_q"], got["_r"]] + 1e-9).all() and (got["up"] >= d[got["_q"], got["_r"]] - 1e-9).all()
    d[ids, ids] = np.inf
    d[(ids[:, None] - ids[None]) % 100 == 1] = np.inf
    best = {(i, j) for i in ids for j in np.argsort(d[i], kind="stable")[:4]}
    found = set(zip(got["_q"], got["_r"]))
    assert best <= found and len(found) < 1.05 * len(best) and 0 < sum(asked) < 0.05 * 1500**2


def test_tiles_equal_plain_distances(monkeypatch):
    import pandas as pd

    from landstrata.operators import bands, neighbors

    monkeypatch.setattr(neighbors, "TILE", (7, 11))
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(60, 3)), 1)
    frame = [pd.DataFrame({f"_{c}": np.arange(60), f"_{c}v": list(v)}) for c in "qr"]
    d = neighbors._exact(v, v, *np.divmod(np.arange(3600), 60)).reshape(60, 60)
    got = neighbors._radius_kernel(0.3, 1.5, True, None)(*frame)
    assert sorted(zip(got["_q"], got["_r"], got["d"])) == [(i, j, d[i, j]) for i in range(60) for j in range(60) if i != j and 0.3 <= d[i, j] < 1.5]
    places, dist = (np.concatenate(x) for x in zip(*bands._block_distances(*frame, None)))
    assert sorted(places) == [p for p in range(3600) if p // 60 != p % 60] and (dist == d.ravel()[places]).all()


def test_class_profile_over_many_tiles(spark):
    from landstrata.operators import neighbors, pairmetrics

    n = neighbors.TILE[1] + 300
    rng = np.random.default_rng(7)
    v, label = rng.normal(size=(n, 3)), rng.integers(0, 4, n)
    v[3], v[4] = v[2], v[2] + 1e-9
    t = vectors(spark, v, label)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    for shares in (True, False):
        got = pairmetrics.class_distance_profile(t, t, "id", "z", "label", 0.3, shares=shares).collect()
        assert len(got) == len({(r["i"], r["label"]) for r in got}) == 4 * n
        for r in got[::7]:
            x = d[r["i"], (label == r["label"]) & (np.arange(n) != r["i"])]
            assert r["n"] == len(x) and abs(r["s"] - x.sum()) < 1e-6 and abs(r["lo"] - x.min()) < 1e-8
            assert abs(r["e"] - (np.exp((x.min() - x) / 0.3).sum() if shares else 0.0)) < 1e-6
