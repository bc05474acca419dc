import random

from landstrata.llm._components import components


def test_chains_stars_and_cliques(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(400, 300 + i) for i in range(50)]
    edges += [(i, j) for i in range(500, 510) for j in range(500, i)] + [(900, 900), (7, 3), (3, 7)]
    names = list(range(1000))
    rng.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got.keys() == linked
    for x in linked:
        for y in linked:
            assert (find(x) == find(y)) == (got[x] == got[y])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
