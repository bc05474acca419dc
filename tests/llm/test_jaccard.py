import random

import numpy as np
import pytest
from helpers import docs, groups, shingle_set

from landstrata.llm import _joins, _text, jaccard


def run(spark, rows, k, percent):
    return jaccard.link_documents(docs(spark, rows), k=k, percent=percent).collect()


def families(seed, n, vocabulary=400):
    """Texts in families: a base and copies with some words changed, some families shared by a common passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    common = rng.choices(words, k=60)
    out = []
    for _ in range(n):
        base = rng.choices(words, k=rng.choice([3, 4, 5, 9, 12, 30, 80, 200]))
        if rng.random() < 0.3:
            base += common
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randint(0, 1)] = [rng.choice(words)]
            out.append(rng.choice([" ", "  ", "\n"]).join(copy))
    return out


def check(rows, got, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    group = groups(sets, percent)
    name = {}
    for (i, _), s, g in zip(rows, sets, group):
        if s and i is not None:
            name[g] = min(name.get(g, i), i)
    want = sorted(((i, len(s), name.get(g) if s else i) for (i, _), s, g in zip(rows, sets, group)), key=repr)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want


@pytest.mark.parametrize("k, percent, block, shipped", [(4, 85, 2048, 500_000), (5, 80, 4, 3), (3, 60, 8, 500_000)])
def test_equals_comparing_all(spark, monkeypatch, k, percent, block, shipped):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(_joins, "SHIPPED", shipped)
    rows = list(enumerate(families(k, 90)))
    check(rows, run(spark, rows, k, percent), k, percent)


def test_large_group_of_near_copies_at_all_distances(spark, monkeypatch):
    """Copies around the limit: a star on the pivot finds some links only, the rest come from the blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(9)
    words = [f"v{i}" for i in range(300)]
    base = rng.choices(words, k=110)
    rows = []
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(110), rng.choice([0, 1, 2, 3, 4, 5, 8, 12])):
            copy[at] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    check(rows, run(spark, rows, 4, 85), 4, 85)


def test_nulls_repeats_empty_and_long(spark):
    long = " ".join(f"x{i % 9973}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  b"), (6, "a b c d"), (None, "a b c d"), (None, "only without id"), (9, long), (8, long + " end"),
            (7, "a b c d"), (7, "a b c d"), (10, "é b c d É"), (11, "É b c d É"), (12, "a b"), (12, "other text with this id")]
    check(rows, run(spark, rows, 4, 85), 4, 85)


def test_empty_table(spark):
    assert run(spark, [], 5, 80) == []


def test_sketches_are_sound():
    """Hamming distance never exceeds the symmetric difference, and linked sets share a part."""
    rng = np.random.default_rng(4)
    for n in (6, 7, 20, 150, 900):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = 0
            while 100 * (n - most - 1) >= 85 * (n + most + 1):
                most += 1
            b = np.unique(np.concatenate([a[most:], rng.integers(0, 2**63, most).astype(np.uint64)]))
            both, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            x, y = (np.frombuffer(s, np.uint64) for s in jaccard._sketches(both, bounds))
            if len(x) == len(y):
                assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b)) <= jaccard.bound(len(a), len(b), 85)
            # they share a part even after each has left out the worst ones it may leave out
            key, owner = jaccard._part_keys(both, bounds, 85)
            may = jaccard._allowances(np.diff(bounds), 85)
            for parity in (0, 1):
                own = [set(key[(owner == i) & (key & 1 == parity)].tolist()) for i in (0, 1)]
                if own[0] & own[1]:
                    assert len(own[0] & own[1]) > max(may[parity])
                    break
            else:
                raise AssertionError("no part is shared")


def test_orders_are_reversible():
    rng = np.random.default_rng(1)
    key, fp = (rng.integers(-(2**63), 2**63 - 1, 1000) for _ in range(2))
    assert (jaccard._class(key, jaccard._place(key, fp)) == fp).all()


def test_word_hashes_do_not_depend_on_the_slice(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a b c d e", None, "", "x", "é ü  ß\nq w" * 50, "long" * 400 + " tail"])
    whole = [(h.tolist(), b.tolist()) for _, h, b in _text.word_sets(texts, 3)]
    monkeypatch.setattr(_text, "SLICE", 16)
    monkeypatch.setattr(_text, "_powers", {})
    parts = list(_text.word_sets(texts, 3))
    joined = [h for _, h, _ in parts]
    assert np.concatenate(joined).tolist() == whole[0][0] and len(parts) > 1


def test_sampled_sketches_keep_linked_sets_of_any_size():
    """Sets at the limit stay within the sampled limit, also where their sizes lie on two levels; unlike ones do not."""
    rng = np.random.default_rng(8)
    for n in (300, 511, 512, 513, 600, 1100, 5000, 40_000):
        most = 0
        while 100 * (n - most - 1) >= 80 * (n + most + 1):
            most += 1
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for cut, linked in ((0, True), (most, True), (n * 9 // 10, False)):
            fresh = np.unique(rng.integers(0, 2**63, cut).astype(np.uint64))
            for b in (np.unique(np.concatenate([a[cut:], fresh])), a[:len(a) - min(cut, n // 5)]):
                both, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
                x, y = (jaccard._stack([s]) for s in jaccard._sketches(both, bounds, True))
                assert x.nbytes <= jaccard.SAMPLED // 2
                p, q = jaccard._level(np.diff(bounds)).tolist()
                x, y = jaccard._lift(x, max(p, q) - p), jaccard._lift(y, max(p, q) - q)
                words = min(x.shape[1], y.shape[1])
                far = int(np.bitwise_count(jaccard._fold(x, words) ^ jaccard._fold(y, words)).sum())
                if linked:
                    assert far <= jaccard._limit(jaccard.bound(len(a), len(b), 80), max(p, q))
                elif len(b) > 0.85 * n:
                    assert far > jaccard._limit(jaccard.bound(len(a), len(b), 80), max(p, q))


@pytest.mark.parametrize("held, size", [(4, 3), (4, 50), (1 << 16, 7)])
def test_buckets_stream_in_batches_of_any_size(spark, monkeypatch, held, size):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "HELD", held)
    rng = np.random.default_rng(held + size)
    key = np.sort(rng.choice([2, 3, 8, 9, 10, 41, 42], 90, p=[.5, .3, .04, .04, .04, .04, .04]))
    place = rng.integers(-40, 40, 90)
    order = np.lexsort([place, key])
    key, place = key[order], place[order]
    caught = {}

    class Keys:  # stands for the sorted rows of one task
        def repartition(self, *_): return self
        def sortWithinPartitions(self, *_): return self
        def mapInArrow(self, run, schema): caught["run"] = run

    jaccard._shared_buckets(Keys())
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a:a + size]), pa.array(place[a:a + size])], ["key", "place"]) for a in range(0, 90, size)]
    got = sorted(tuple(r.values()) for b in caught["run"](iter(batches)) for r in b.to_pylist())
    want = []
    for k in np.unique(key):
        p = np.unique(place[key == k])
        fp = jaccard._class(np.full(len(p), k), p)
        want += [(int(k), int(f), int(fp[0]), min(len(p), held)) for f in fp] if len(p) > 1 else []
    assert got == sorted(want)


def test_links_span_the_components(spark):
    rows = list(enumerate(families(11, 60)))
    links = jaccard.verified_links(docs(spark, rows), k=4, percent=85).collect()
    sets = {i: shingle_set(t, 4) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sets[a], sets[b]
        assert 100 * len(x & y) >= 85 * len(x | y) and x != y
        root[max(find(a), find(b))] = min(find(a), find(b))
    first = {}
    for i, s in sets.items():
        if s:
            first.setdefault(s, i)
    whole = groups(list(sets.values()), 85)
    name = {}
    for i, s in sets.items():
        if s:
            name.setdefault(whole[i], i)
    assert {i: find(first[s]) for i, s in sets.items() if s} == {i: find(first[sets[name[whole[i]]]]) for i, s in sets.items() if s}
    assert len({find(first[s]) for s in sets.values() if s}) == len(name)


def test_a_passage_in_all_documents_and_long_texts(spark):
    """Documents that are alike only by a common passage, and long families just below and above the limit."""
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [f"d{i}x{rng.randrange(10**6)}" for _ in range(rng.choice([10, 30, 90]))]
        rows.append((len(rows), " ".join(own[:5] + passage + own[5:])))
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(3000)]
        for changes in (0, 40, 80, 100, 120, 160, 200):
            copy = list(base)
            for at in rng.sample(range(3000), changes):
                copy[at] = f"n{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(copy)))
    check(rows, run(spark, rows, 4, 85), 4, 85)


def test_blocks_give_a_forest_and_not_all_near_pairs(spark, monkeypatch):
    """Classes of one bucket that are all near each other, each a component of its own, and two that are near nothing."""
    rng = np.random.default_rng(5)
    base, far = (np.unique(rng.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(2))

    def pairs(size):
        rows = []
        for fp, x in [*((i, base) for i in range(size)), (size, far), (size + 1, far ^ np.uint64(1 << 40))]:
            sketch = jaccard._sketches(x, np.array([0, len(x)]), True)[0]
            rows.append((7, fp, fp, len(x), bytearray(sketch), size + 2))
        table = spark.createDataFrame(rows, "key long, fp long, comp long, n long, sampled binary, size long")
        return {(r["a"], r["b"]) for r in jaccard._block_pairs(table, 85).collect()}

    for size in (20, 80):
        got = pairs(size)
        assert len(got) == size - 1 and {x for p in got for x in p} == set(range(size))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = pairs(80)
    assert {x for p in got for x in p} == set(range(80)) and len(got) < 80 * 79 // 8


@pytest.mark.parametrize("elements", [1 << 19, 700])
def test_a_family_just_below_the_limit(spark, monkeypatch, elements):
    """Copies of one base that are near each other but seldom linked, and a few linked ones far from the family's pivots."""
    monkeypatch.setattr(jaccard, "ELEMENTS", elements, raising=False)
    rng = random.Random(31)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(140), 3):
            copy[at] = f"c{i}x{at}"
        rows.append((len(rows), " ".join(copy)))
        if i % 9 == 0:  # shares the copy's changes
            copy[rng.randrange(140)] = f"e{i}"
            rows.append((len(rows), " ".join(copy)))
    sets = [shingle_set(t, 4) for _, t in rows]
    assert 5 < len(set(groups(sets, 85))) < len(rows) and len({frozenset(s) for s in sets}) == len(rows)
    check(rows, run(spark, rows, 4, 85), 4, 85)


def test_family_links_join_components_once(spark):
    """Eight equal-sized sets in three linked groups, of which two are partly joined before; one more set is far from all."""
    bases = [np.arange(100 * g, 100 * g + 100, dtype=np.uint64) for g in range(3)]
    rows = []
    for i in range(8):
        x = bases[i % 3].copy()
        x[i] = 10_000 + i
        rows.append((1, i, {3: 0, 4: 1}.get(i, i), 100, bytearray(np.sort(x).tobytes())))
    rows.append((1, 8, 8, 100, bytearray(np.arange(5000, 5100, dtype=np.uint64).tobytes())))
    got = [(r["a"], r["b"]) for r in jaccard._family_links(spark.createDataFrame(rows, "key long, fp long, comp long, n long, elements binary"), 85).collect()]
    assert all(a % 3 == b % 3 and b < 8 for a, b in got)
    root = {i: c for _, i, c, _, _ in rows}
    for a, b in got:
        assert root[a] != root[b]  # none is superfluous
        old, new = root[a], root[b]
        root = {i: new if c == old else c for i, c in root.items()}
    assert len(set(root.values())) == 4
