"""Values at points, spatial neighbour pairs and negatives."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import global_rank
from .sample import seeded


def extract_at_points(points: DataFrame, layer: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Layer values at the points' cells (and year); points outside get NULL."""
    return points.join(layer.select(*on, *values), on, "left")


def features_at_locations(points: DataFrame, layer: DataFrame, key: list[str], channels: list[str], year: str | None = None,
                          out: str = "features") -> DataFrame:
    """Static vector per point, or with ``year`` an array of {year, vector} ordered by year."""
    vec = F.array(*[F.col(c).cast("double") for c in channels])
    if year is None:
        return points.join(layer.select(*key, vec.alias(out)), key, "left")
    series = layer.join(points.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(year).alias("year"), vec.alias("v")))).alias(out))
    return points.join(series, key, "left")


def anchor_index(anchors: DataFrame, candidates: DataFrame, coords: list[str], idx: str, out: str = "index") -> DataFrame:
    """Smallest index of each anchor in the candidate list, -1 when absent."""
    first = candidates.groupBy(*coords).agg(F.min(idx).alias("_i"))
    return anchors.join(first, coords, "left").withColumn(out, F.coalesce("_i", F.lit(-1))).drop("_i")


def nearest_offsets(k: int, radius: float) -> list[tuple[int, int, float]]:
    """The k closest non-zero offsets, ordered by distance, then row, then column."""
    r = int(math.floor(radius))
    cand = [(math.hypot(i, j), i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if 0 < i * i + j * j <= radius * radius]
    return [(i, j, d) for d, i, j in sorted(cand)[:k]]


def spatial_knn_pairs(anchors: DataFrame, valid: DataFrame, k: int, radius: float, key: str, row: str = "row", col: str = "col") -> DataFrame:
    """Anchor x fixed offset template, kept where the neighbour cell is valid."""
    items = F.explode(F.array(*[
        F.struct((F.col(row) + i).alias("n_row"), (F.col(col) + j).alias("n_col"), F.lit(d).alias("d"), F.lit(n + 1).alias("rank"))
        for n, (i, j, d) in enumerate(nearest_offsets(k, radius))]))
    cand = anchors.select(key, row, col, items.alias("o")).select(key, row, col, "o.*")
    cells = valid.select(F.col(row).alias("n_row"), F.col(col).alias("n_col")).distinct()
    return cand.join(cells, ["n_row", "n_col"], "left_semi")


_M = 2147483647


def negative_order(anchor, pixel, seed: int):
    """Arithmetic mix of two integer keys (numpy or plain integers)."""
    return ((pixel * 48271 + anchor * 69621 + seed * 40503) % _M * 16807) % _M


def spatial_negative_pairs(anchors: DataFrame, valid: DataFrame, patch: list[str], min_d: float, max_d: float | None, n: int,
                           key: str, row: str = "row", col: str = "col", seed: int = 0, chunk: int = 256) -> DataFrame:
    """n pseudo-random valid pixels per anchor inside its patch and distance range.

    Patches meet by co-grouping; a patch holds at most ps x ps pixels, so the group is bounded by geometry,
    distances stay inside the task in slices of ``chunk`` anchors and only n rows per anchor leave it.
    Pixel ids must be integers.
    """
    a = anchors.select(*patch, F.col(key).cast("long").alias("i"), F.col(row).cast("double").alias("ar"), F.col(col).cast("double").alias("ac"))
    v = valid.select(*patch, F.col(key).cast("long").alias("j"), F.col(row).cast("double").alias("vr"), F.col(col).cast("double").alias("vc"))

    def pick(ap: pd.DataFrame, vp: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"i": np.array([], dtype="int64"), "j": np.array([], dtype="int64"), "d": np.array([], dtype="float64")})]
        vj, vr, vc = vp["j"].to_numpy(), vp["vr"].to_numpy(), vp["vc"].to_numpy()
        for s in range(0, len(ap), chunk):
            part = ap.iloc[s : s + chunk]
            ai = part["i"].to_numpy()
            d = np.hypot(part["ar"].to_numpy()[:, None] - vr[None], part["ac"].to_numpy()[:, None] - vc[None])
            ok = d >= min_d
            if max_d is not None:
                ok &= d <= max_d
            order = np.where(ok, negative_order(ai[:, None], vj[None], seed), np.iinfo(np.int64).max)
            m = min(n, len(vj))
            if m == 0:
                continue
            # ties of the mix fall back to the pixel id
            pos = np.argsort(vj, kind="stable")
            top = pos[np.argsort(order[:, pos], axis=1, kind="stable")[:, :m]]
            r = np.repeat(np.arange(len(ai)), m)
            c = top.ravel()
            keep = ok[r, c]
            out.append(pd.DataFrame({"i": ai[r][keep], "j": vj[c][keep], "d": d[r, c][keep]}))
        return pd.concat(out, ignore_index=True)

    return a.groupBy(*patch).cogroup(v.groupBy(*patch)).applyInPandas(pick, "i long, j long, d double")


def cross_patch_negatives(anchors: DataFrame, patch: str, key: str, per_anchor: int, seed: int = 0, slot_order: Column | None = None, draw=None) -> DataFrame:
    """``per_anchor`` random anchor pairs per anchor, from two different patches.

    Where that is enough for every ordered patch pair, all get equally many; otherwise each draw picks its patch pair.
    Pairs are generated, not joined: each output row is a counter from which the patch pair and the two draws
    follow; two equi-joins on (patch number, draw) look the anchors up.
    """
    counts = anchors.groupBy(patch).agg(F.count("*").alias("n"))
    numbered = global_rank(counts, [F.col(patch)], "p").withColumn("p", F.col("p") - 1)
    total = anchors.count()
    n_patches = counts.count()
    if n_patches < 2:
        return anchors.sparkSession.createDataFrame([], "i long, j long, patch_i long, patch_j long")
    n_pairs = n_patches * (n_patches - 1)
    per = per_anchor * total // n_pairs
    idx = anchors.join(numbered, patch).select(
        "p", F.col(key).alias("a"), (F.row_number().over(Window.partitionBy("p").orderBy(slot_order if slot_order is not None else seeded(seed, key), key)).cast("long") - 1).alias("slot"))
    c = F.col("id")
    draw = draw or (lambda stream, c: seeded(seed, F.lit(stream), c))
    if per:
        pair = F.floor(c / per)
        pi, q = F.floor(pair / (n_patches - 1)), pair % (n_patches - 1)
    else:  # fewer draws than patch pairs
        pi, q = F.pmod(draw(2, c), F.lit(n_patches)), F.pmod(draw(3, c), F.lit(n_patches - 1))
    rows = anchors.sparkSession.range(n_pairs * per or per_anchor * total).select(
        c.alias("draw"), pi.alias("pi"), F.when(q >= pi, q + 1).otherwise(q).alias("pj"))
    sizes = numbered.select(F.col("p"), F.col("n"))
    rows = rows.join(sizes.withColumnsRenamed({"p": "pi", "n": "ni"}), "pi").join(sizes.withColumnsRenamed({"p": "pj", "n": "nj"}), "pj")
    rows = rows.withColumns({"si": F.pmod(draw(0, F.col("draw")), F.col("ni")), "sj": F.pmod(draw(1, F.col("draw")), F.col("nj"))})
    left = idx.withColumnsRenamed({"p": "pi", "slot": "si", "a": "i"})
    right = idx.withColumnsRenamed({"p": "pj", "slot": "sj", "a": "j"})
    return rows.join(left, ["pi", "si"]).join(right, ["pj", "sj"]).select("i", "j", F.col("pi").alias("patch_i"), F.col("pj").alias("patch_j"))


def radius_pairs_2d(points: DataFrame, key: str, x: str, y: str, min_d: float, max_d: float) -> DataFrame:
    """Ordered pairs with min <= distance < max in the plane, found through square cells of side ``max_d``.

    Points are grid cells, at most one per integer coordinate, so a square holds at most max_d^2 of them.
    """
    p = points.select(F.col(key).alias("i"), F.col(x).cast("double").alias("xi"), F.col(y).cast("double").alias("yi"))
    p = p.withColumns({"cx": F.floor(F.col("xi") / max_d), "cy": F.floor(F.col("yi") / max_d)})
    around = F.explode(F.array(*[F.struct((F.col("cx") + a).alias("cx"), (F.col("cy") + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    left = p.select("i", "xi", "yi", around.alias("c")).select("i", "xi", "yi", "c.cx", "c.cy")
    right = p.select(F.col("i").alias("j"), F.col("xi").alias("xj"), F.col("yi").alias("yj"), "cx", "cy")
    d = F.hypot(F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj"))
    out = left.join(right, ["cx", "cy"]).filter(F.col("i") != F.col("j")).withColumn("d", d)
    return out.filter((F.col("d") >= min_d) & (F.col("d") < max_d)).select("i", "j", "d")
