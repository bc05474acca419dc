"""One structure for density clusters at every cut and every minPts: spanning links of mutual reachability.

The mutual reachability of two rows is the largest of their distance and their core distances. A pair of blocks keeps the
smallest spanning forest of the links between them, fewer links than it has rows: a link left out there joins nothing that
shorter links do not join. The forests of all pairs of blocks are then thinned to the forest of the table: tasks thin parts of
a bounded number of links to their own forests, and while links fill more than one part, Boruvka rounds follow: each
component picks its smallest link, picked links merge components by pointer jumping, and of the links between two components
only the smallest goes on, so components at least halve in a round. Components of links are found in the same parts.

The forest of the largest minPts, joined by the neighbour lists, serves every smaller minPts too. Rows that are in neither
one's list are at least as far apart as both core distances of the largest minPts, so their reachability is their
distance for each smaller one as well, and the forest holds a path of links no longer than that. Pairs in the lists are
there with their own distance.

Rows without a finite vector, and rows with fewer than minPts - 1 neighbours, are in no component; an empty table has no links.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .neighbors import DIGITS, MAX_PIVOTS, REF_BLOCK, _cell_join, _side, _stack, block_product

MOST_LINKS = 1 << 19  # in a part that one task thins


def _forest_kernel(cut: float):
    """Smallest spanning forest of the links between a block of queries and a block of references (Prim's algorithm).

    A row that is in both blocks is one node: its two copies hang together by a link below all others, which is not returned.
    """
    def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(qp) or not len(rp):
            return pd.DataFrame({"_q": qp["_q"].iloc[:0], "_r": rp["_r"].iloc[:0], "w": np.array([], float)})
        qp, rp = qp.sort_values("_q"), rp.sort_values("_r")
        ids = (qp["_q"].to_numpy(), rp["_r"].to_numpy())
        vecs, cores = (_stack(qp["_qv"]), _stack(rp["_rv"])), (qp["q_core"].to_numpy(), rp["r_core"].to_numpy())
        sizes = (len(ids[0]), len(ids[1]))
        base = (0, sizes[0])
        twin = (pd.Index(ids[1]).get_indexer(ids[0]), pd.Index(ids[0]).get_indexer(ids[1]))
        n = sum(sizes)
        near, parent, open_ = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
        found = []
        for _ in range(n):
            at = int(near.argmin())
            if near[at] == np.inf:  # the next tree starts at the first row left
                at = int(open_.argmax())
            elif near[at] >= 0:
                found.append((at, int(parent[at]), float(near[at])))
            open_[at], near[at] = False, np.inf
            side = int(at >= sizes[0])
            own, other = at - base[side], 1 - side
            left = np.flatnonzero(open_[base[other] : base[other] + sizes[other]])
            if not len(left):
                continue
            diff = vecs[other][left] - vecs[side][own]
            w = np.round(np.sqrt((diff * diff).sum(1)), DIGITS)
            w = np.maximum(np.maximum(w, cores[other][left]), cores[side][own])
            w[w > cut] = np.inf
            w[left == twin[side][own]] = -1.0
            there = base[other] + left
            nearer = w < near[there]
            near[there[nearer]], parent[there[nearer]] = w[nearer], at
        all_ids = np.concatenate(ids)
        a, b = [all_ids[x[0]] for x in found], [all_ids[x[1]] for x in found]
        return pd.DataFrame({"_q": np.array(a, dtype=ids[0].dtype), "_r": np.array(b, dtype=ids[0].dtype), "w": np.array([x[2] for x in found], float)})

    return kernel


def _merged(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Boruvka's rounds on links between nodes 0..n-1, shortest first: places of the forest's links, and a node of each one's component."""
    lab, left, found = np.arange(n), np.arange(len(a)), []
    while True:
        x, y = lab[a[left]], lab[b[left]]
        left, x, y = (v[x != y] for v in (left, x, y))
        if not len(left):
            return np.sort(np.concatenate(found)) if found else left, lab
        best = np.full(n, len(a))
        best[x[::-1]] = left[::-1]  # the last one written is the shortest
        other = np.full(n, len(a))
        other[y[::-1]] = left[::-1]
        best = np.minimum(best, other)
        at = np.flatnonzero(best < len(a))
        link = best[at]
        to = np.arange(n)
        to[at] = lab[a[link]] + lab[b[link]] - at
        root = at[(to[to[at]] == at) & (at < to[at])]
        to[root] = root
        while (to != to[to]).any():
            to = to[to]
        lab = to[lab]
        found.append(np.unique(link))


def _forest_of_part(batches):
    """The smallest forest of a part's links (a, b, w, i, j)."""
    pdf = pd.concat(list(batches), ignore_index=True)
    if not len(pdf):
        return
    pdf = pdf.sort_values(["w", "i", "j"], kind="stable", ignore_index=True)
    code, names = pd.factorize(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]))
    yield pdf.iloc[_merged(code[: len(pdf)], code[len(pdf) :], len(names))[0]]


def spanning_forest(links: DataFrame) -> DataFrame:
    """The smallest spanning forest of links (i, j, w), by Boruvka rounds; equal weights are ordered by the ends.

    Before a round the links are dealt to parts of about MOST_LINKS, and of a part only its own forest goes on; links that
    fit into one part need no round.
    """
    left = links.filter("i <> j").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min("w").alias("w"))
    left = cut_lineage(left.select(F.col("i").alias("a"), F.col("j").alias("b"), "w", "i", "j"))
    out = left.select("i", "j", "w").limit(0)
    while True:
        parts = math.ceil(left.count() / MOST_LINKS)
        if not parts:
            break
        left = cut_lineage(left.repartition(parts, "i", "j").mapInPandas(_forest_of_part, left.schema))
        if parts == 1:
            out = out.unionByName(left.select("i", "j", "w"))
            break
        ends = left.select(F.col("a").alias("c"), F.col("b").alias("o"), "w", "i", "j").unionByName(left.select(F.col("b").alias("c"), F.col("a").alias("o"), "w", "i", "j"))
        pick = cut_lineage(ends.groupBy("c").agg(F.min(F.struct("w", "i", "j", "o")).alias("m")).select("c", "m.*"))
        out = out.unionByName(pick.select("i", "j", "w").distinct())
        # links are in one order, so the only circles are two components that pick each other: the smaller is the root
        back = pick.select(F.col("c").alias("o"), F.col("o").alias("c2"))
        root = cut_lineage(pick.join(back, "o").select("c", F.when((F.col("c2") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("p")))
        while True:
            step = cut_lineage(root.join(root.select(F.col("c").alias("p"), F.col("p").alias("pp")), "p").select("c", "p", "pp"))
            root = step.select("c", F.col("pp").alias("p"))
            if step.filter("p <> pp").isEmpty():
                break
        left = left.join(root.withColumnsRenamed({"c": "a", "p": "ra"}), "a").join(root.withColumnsRenamed({"c": "b", "p": "rb"}), "b").filter("ra <> rb")
        left = left.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min(F.struct("w", "i", "j")).alias("m"))
        left = cut_lineage(left.select("a", "b", "m.*"))
    return out


def _stars_of_part(batches):
    """A link (a, b) from each node of a part to the smallest node of its component there, itself included."""
    table = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := [x for x in batches if x.num_rows]) else None
    if table is None:
        return
    ends = pa.concat_arrays([c for k in (0, 1) for c in table.column(k).chunks])
    fields = ends.flatten() if pa.types.is_struct(ends.type) else [ends]
    frame = pd.DataFrame({str(k): x.to_pandas() for k, x in enumerate(fields)})
    code = frame.groupby(list(frame), sort=True, dropna=False).ngroup().to_numpy()
    first = np.empty(code.max() + 1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    lab = _merged(code[: len(table)], code[len(table) :], len(first))[1]
    least = np.full(len(first), len(first))
    np.minimum.at(least, lab, np.arange(len(first)))
    nodes = ends.take(pa.array(first))
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(least[lab]))], ["a", "b"])


def connected_components(nodes: DataFrame, edges: DataFrame, key: str, out: str = "component", max_rounds: int = 64) -> DataFrame:
    """Smallest reachable id per node; edges (i, j) count where both ends are nodes.

    Edges are dealt to parts of about MOST_LINKS and each part's components become stars, so edges that fit into one part
    are done at once. Else each node goes to its neighbour that comes first in a scrambled order, and from there to that
    one's, until no edge is left.
    """
    names = cut_lineage(nodes.select(F.col(key).alias("v")))
    left = edges.filter("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    for c in "ab":
        left = left.join(names.withColumnRenamed("v", c), c, "left_semi")
    left, home = cut_lineage(left.select("a", "b").distinct()), None
    for _ in range(max_rounds):
        parts = math.ceil(left.count() / MOST_LINKS)
        if not parts:
            break
        left = cut_lineage(left.repartition(parts, "a", "b").mapInArrow(_stars_of_part, left.schema))
        if parts == 1:
            step = left.select(F.col("a").alias("v"), F.col("b").alias("to"))
        else:
            both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
            hop = cut_lineage(both.groupBy("a").agg(F.min(place("b")).alias("m")).select(F.col("a").alias("v"), F.least("m", place("a"))["v"].alias("to")))
            step = cut_lineage(hop.join(hop.select(F.col("v").alias("to"), F.col("to").alias("next")), "to").select("v", F.col("next").alias("to")))
        after = step.select(F.col("v").alias("to"), F.col("to").alias("next"))
        home = step if home is None else cut_lineage(home.join(after, "to", "left").select("v", F.coalesce("next", "to").alias("to")))
        if parts == 1:
            break
        for c in "ab":
            left = left.join(step.withColumnsRenamed({"v": c, "to": f"r{c}"}), c)
        left = cut_lineage(left.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    if home is None:
        return names.select(F.col("v").alias(key), F.col("v").alias(out))
    least = home.groupBy("to").agg(F.min("v").alias("least"))
    home = home.join(least, "to").select("v", "least")
    return names.join(home, "v", "left").select(F.col("v").alias(key), F.coalesce("least", "v").alias(out))


def core_distances(nn: DataFrame, key: str, min_pts: int) -> DataFrame:
    """``key, core``: distance to the (minPts - 1)-th neighbour, from neighbour lists (i, j, d, rank)."""
    return nn.filter(F.col("rank") == max(min_pts - 1, 1)).select(F.col("i").alias(key), F.col("d").alias("core"))


def reachability_forest(df: DataFrame, key: str, vec: str, core: DataFrame, cut: float | None = None, block: int = REF_BLOCK, pivots: int | None = None) -> DataFrame:
    """``i, j, w``: the smallest spanning forest of mutual reachability, up to ``cut``.

    Rows whose core distance exceeds ``cut`` take no part, and cells farther than ``cut`` do not meet.
    """
    most = math.inf if cut is None else float(cut)
    rows = df.join(core.filter(F.col("core") <= most), key)
    q = _side(rows, key, vec, ("core",), "q")
    r = cut_lineage(_side(rows, key, vec, ("core",), "r"))
    n, kind = r.count(), r.schema["_r"].dataType
    schema = T.StructType([T.StructField("_q", kind), T.StructField("_r", kind), T.StructField("w", T.DoubleType())])
    if math.isinf(most) or (n <= block and pivots is None):
        found = block_product(q, r, _forest_kernel(most), schema, max(n, 1), block, block)
    else:
        found = _cell_join(q, r, _forest_kernel(most), schema, n, None, most, pivots or min(MAX_PIVOTS, max(2, math.ceil(math.sqrt(n)))), block, block)
    return spanning_forest(found.select(F.col("_q").alias("i"), F.col("_r").alias("j"), "w"))


def density_links(df: DataFrame, key: str, vec: str, nn: DataFrame, max_pts: int, cut: float | None = None, **kw) -> DataFrame:
    """``i, j, d``: links that give the density components of every minPts up to ``max_pts`` and every cut up to ``cut``.

    ``nn`` are the neighbour lists (i, j, d, rank) up to rank ``max_pts - 1``; further arguments go to the forest's search.
    """
    forest = reachability_forest(df, key, vec, core_distances(nn, key, max_pts), cut, **kw)
    near = nn.filter(F.col("rank") <= max(max_pts - 1, 1))
    both = near.select("i", "j", "d").unionByName(forest.select("i", "j", F.col("w").alias("d")))
    both = both if cut is None else both.filter(F.col("d") <= float(cut))
    # the distance of a pair in the lists is not above its reachability, so the smaller one counts
    return cut_lineage(both.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min("d").alias("d")))


def density_components(links: DataFrame, nn: DataFrame, key: str, runs: list[tuple[int, float]]) -> DataFrame:
    """``run, key, component`` for each (minPts, cut) of ``runs``, all found together; ``run`` is the place in the list.

    A component is named by its smallest key. Rows whose core distance exceeds the run's cut are in none.
    """
    if not runs:
        raise ValueError("no runs")
    wanted = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(max(mp - 1, 1)).alias("rank"), F.lit(float(c)).alias("cut")) for i, (mp, c) in enumerate(runs)])
    dense = nn.withColumn("w", F.explode(F.filter(wanted, lambda x: (x["rank"] == F.col("rank")) & (F.col("d") <= x["cut"]))))
    dense = cut_lineage(dense.select(F.struct(F.col("w.run").alias("run"), F.col("i").alias("id")).alias("v")))
    each = links.withColumn("w", F.explode(F.filter(wanted, lambda x: F.col("d") <= x["cut"])))
    each = each.select(*[F.struct(F.col("w.run").alias("run"), F.col(c).alias("id")).alias(c) for c in "ij"])
    out = connected_components(dense, each, "v")
    return out.select("v.run", F.col("v.id").alias(key), F.col("component.id").alias("component"))
