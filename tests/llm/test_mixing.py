import random

import pytest
from helpers import WORD, docs
from pyspark.sql import functions as F

from landstrata.llm import mixing


def level_targets(sizes, weights, most):
    """Targets by raising full sources out of the sharing, one round after the other."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, full = {}, set()
    while len(full) < len(names):
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else weight[s] * rest / share for s in names}
        over = {s for s in names if out[s] > most * sizes[s]}
        if not over:
            break
        full |= over
    return out


def corpus(spark, rows):
    """``rows``: (id, source, text)."""
    return docs(spark, [(i, t) for i, _, t in rows], "size int, key string, target double, upto int").drop("source").join(
        spark.createDataFrame([(i, s) for i, s, _ in rows], "doc_id bigint, source string"), "doc_id")


def check(rows, got, weights=(5, 2, 1), most=3):
    size = {i: len(WORD.findall(t or "")) for i, _, t in rows}
    sizes, taken = {}, {}
    for i, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    want = level_targets(sizes, weights, most)
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        epochs = round(r["target"]) // r["source_size"] if r["source_size"] else 0
        assert epochs * r["size"] <= r["taken"] <= min(most, epochs + 1) * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    for s in sizes:  # at most one document of a source is cut
        cut = [r for r in got if r["source"] == s and r["size"] and r["taken"] % r["size"]]
        assert len(cut) <= 1
    return {r["doc_id"]: r["taken"] for r in got}


def made(seed, n):
    rng = random.Random(seed)
    sources = [None, "a", "b", "B", "é", "z", "tiny"]
    out = []
    for i in range(n):
        source = "tiny" if i == 0 else rng.choices(sources, [1, 30, 5, 2, 1, 3, 0])[0]
        words = 3000 if i == 7 else rng.choice([0, 1, 5, 20, 60])
        out.append((i, source, None if i % 31 == 5 else " ".join(rng.choice(["oak", "elm,", "7%"]) for _ in range(words))))
    return out


@pytest.mark.parametrize("seed, weights, most", [(1, (5, 2, 1), 3), (2, (1,), 1), (3, (1, 50), 2)])
def test_targets_and_budgets(spark, seed, weights, most):
    rows = made(seed, 200)
    got = mixing.mix(corpus(spark, rows), weights, most, quality=mixing.prose_share(F.col("text"))).collect()
    first = check(rows, got, weights, most)
    again = mixing.mix(corpus(spark, rows).repartition(5), weights, most, quality=mixing.prose_share(F.col("text"))).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == first


def test_heavier_documents_are_drawn_more_often(spark):
    rows = [(i, "big", "w " * 10 + ("good" if i % 2 else "poor")) for i in range(3000)] + [(10_000 + i, "another", "y " * 11) for i in range(3000)]
    weight = F.when(F.col("text").endswith("good"), 4.0).otherwise(1.0)
    got = mixing.mix(corpus(spark, rows), (3, 1), 3, quality=weight).collect()
    good, poor = (sum(r["taken"] for r in got if r["source"] == "big" and r["doc_id"] % 2 == p) for p in (1, 0))
    assert good + poor == 16_500 and good > 2 * poor


def test_nulls_repeats_and_no_words(spark):
    rows = [(None, "some text without id"), (None, "some text without id"), (None, None), (4, ""), (5, " \n\t"), (6, "one"), (6, "one"), (7, "x" * 100_000)]
    frame = docs(spark, rows)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows) and sum(r["taken"] for r in got) == sum(r["size"] for r in got) == 11
    assert all(r["target"] == 11 for r in got)
    assert [r["taken"] for r in mixing.mix(frame.filter("doc_id IN (4, 5)")).collect()] == [0, 0]
    assert [r["target"] for r in mixing.mix(frame.filter("doc_id IN (4, 5)")).collect()] == [0, 0]


def test_empty_table(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
