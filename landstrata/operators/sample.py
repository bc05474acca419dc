"""Seeded samples.  Every choice is a hash of the row key, so a recomputed task picks the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranks import first_rows, global_prefix_sum, global_rank, rank_cuts, tile_of, top_per_group

_M = 2147483647  # 2^31 - 1


def seeded(seed: int, *keys) -> Column:
    """64-bit hash of the key columns."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.xxhash64(F.lit(seed), *cols)


def mixed(key, seed: int = 0) -> Column:
    """Small arithmetic mix of an integer key into 0 .. 2^31-2; the same in any SQL engine."""
    k = (F.col(key) if isinstance(key, str) else key).cast("bigint")
    # the product is taken of remainders, so that a large key does not overflow; below zero a remainder keeps its sign
    low = F.pmod(F.pmod(k, F.lit(_M)) * (2654435761 % _M) + seed * 40503 % _M, F.lit(_M))
    below = k < -(seed * 40503 // 2654435761)
    return (F.when(below & (low > 0), low - _M).otherwise(low) * 48271) % _M


def uniform(h: Column) -> Column:
    """Hash to (0, 1)."""
    return (F.pmod(h, F.lit(2**53)) + 0.5) / float(2**53)


def take(df: DataFrame, n: int, order: Column, *tie: str) -> DataFrame:
    """The n rows smallest in ``order``, ties by key: rows up to the n-th, which a range sort of the keys finds."""
    return first_rows(df.withColumn("_h", order), ["_h", *tie], n).drop("_h")


def sample_patches(patches: DataFrame, n: int, keys: list[str], seed: int = 42, order: Column | None = None) -> DataFrame:
    return take(patches, n, order if order is not None else seeded(seed, *keys), *keys)


def random_windows(patches: DataFrame, keys: list[str], height: int, width: int, side: int, end_years: list[int], seed: int = 42, draw=None) -> DataFrame:
    """A random window origin and end year for each sampled patch row; ``draw(stream)`` replaces the hash."""
    years = F.array(*[F.lit(int(y)) for y in end_years])
    draw = draw or (lambda stream: seeded(seed, F.lit(stream), *keys))
    return patches.withColumns({
        "row0": F.pmod(draw(0), F.lit(max(height - side + 1, 1))),
        "col0": F.pmod(draw(1), F.lit(max(width - side + 1, 1))),
        "end_year": F.element_at(years, (F.pmod(draw(2), F.lit(len(end_years))) + 1).cast("int")),
    })


def epoch_sample(df: DataFrame, keys: list[str], mode: str, value: float | None = None, seed: int = 0, order: Column | None = None) -> DataFrame:
    """full: every row with its shuffled position; frac or number: that many rows of the shuffled order."""
    h = order if order is not None else seeded(seed, *keys)
    if mode == "full":
        return global_rank(df.withColumn("_h", h), [F.col("_h"), *[F.col(k) for k in keys]], "position").drop("_h")
    if mode == "frac":
        return take(df, int(value * df.count()), h, *keys)
    if mode == "number":
        return take(df, int(value), h, *keys)
    raise ValueError(f"unknown mode {mode!r}")


def reservoir(df: DataFrame, k: int, keys: list[str], group: list[str] = (), seed: int = 0, order: Column | None = None) -> DataFrame:
    """Uniform sample of at most k rows, globally or per group; a group that holds most of the table never
    reaches one task (see ``top_per_group``)."""
    h = order if order is not None else seeded(seed, *keys)
    if not group:
        return take(df, k, h, *keys)
    return top_per_group(df.withColumn("_h", h), k, list(group), ["_h", *keys]).drop("_h")


def cap_per_batch(df: DataFrame, n: int, keys: list[str], batch: list[str], seed: int = 0, order: Column | None = None) -> DataFrame:
    return reservoir(df, n, keys, batch, seed, order)


def cap_pairs(pairs: DataFrame, limit: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """Random subset of at most ``limit`` pairs (a requested cap, not a guard)."""
    return take(pairs, limit, order if order is not None else seeded(seed, "i", "j"), "i", "j")


# anchors -------------------------------------------------------------------------------------


def grid_anchors(df: DataFrame, ps: int, stride: int, border: int, jitter: int, mask: str, row: str = "row", col: str = "col",
                 seed: int = 0, jitter_of=None) -> DataFrame:
    """Valid pixels on a regular grid inside each patch; one origin shift per patch."""
    pr, pc = F.floor(F.col(row) / ps), F.floor(F.col(col) / ps)
    if jitter:
        make = jitter_of or (lambda a, b, which: F.pmod(seeded(seed, a, b, F.lit(which)), F.lit(2 * jitter + 1)))
        jr, jc = make(pr, pc, 0) - jitter, make(pr, pc, 1) - jitter
    else:
        jr = jc = F.lit(0)
    lr, lc = F.col(row) % ps, F.col(col) % ps

    def on(local: Column, j: Column) -> Column:
        return (local >= border + j) & (local < ps - border) & ((local - border - j) % stride == 0)

    out = df.filter(F.col(mask).cast("boolean")).withColumns({"patch_row": pr, "patch_col": pc})
    return out.filter(on(lr, jr) & on(lc, jc))


def supplement(df: DataFrame, n: int, patch: list[str], keys: list[str], weight: str | None = None, seed: int = 0, u: Column | None = None) -> DataFrame:
    """n pixels per patch without replacement, uniform or in proportion to a weight.

    Keys -ln(u)/w give an exact weighted sample (Efraimidis-Spirakis); a patch whose weights sum to 0 is
    sampled uniformly.
    """
    u = u if u is not None else uniform(seeded(seed, *keys))
    if weight is None:
        key, out = u, df
    else:
        w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
        total = df.groupBy(*patch).agg(F.sum(w).alias("_tw"))
        out = df.join(total, patch)
        key = F.when(F.col("_tw") == 0, u).when(w > 0, -F.ln(u) / w).otherwise(F.lit(float("inf")))
    return top_per_group(out.withColumn("_k", key), n, patch, ["_k", *keys]).drop("_k", "_tw")


def grid_plus_supplement(df: DataFrame, ps: int, stride: int, border: int, jitter: int, mask: str, n: int, keys: list[str],
                         weight: str | None = None, row: str = "row", col: str = "col", seed: int = 0, u: Column | None = None) -> DataFrame:
    """Grid anchors and the supplement; a pixel may appear in both."""
    grid = grid_anchors(df, ps, stride, border, jitter, mask, row, col, seed)
    valid = df.filter(F.col(mask).cast("boolean")).withColumns({"patch_row": F.floor(F.col(row) / ps), "patch_col": F.floor(F.col(col) / ps)})
    extra = supplement(valid, n, ["patch_row", "patch_col"], keys, weight, seed, u)
    return grid.withColumn("origin", F.lit("grid")).unionByName(extra.withColumn("origin", F.lit("supplement")))


def inverse_frequency_weight(df: DataFrame, patch: list[str], value: str, eligible: Column, valid_values: list | None = None) -> Column:
    """1 / number of eligible pixels of the patch that share the value, else 0."""
    ok = F.coalesce(eligible, F.lit(False)) & F.col(value).isNotNull()
    if valid_values is not None:
        ok = ok & F.round(F.col(value)).isin(*valid_values)
    n = F.sum(ok.cast("int")).over(Window.partitionBy(*patch, value))
    return F.when(ok, 1.0 / n).otherwise(0.0)


def supplement_weights(df: DataFrame, patch: list[str], masks: list[str], inverse_frequency: list[str] = (),
                       valid_values: dict[str, list] | None = None, out: str = "weight") -> DataFrame:
    """Product of the mask channels and of the transformed channels, counted inside the masks."""
    m = F.lit(1.0)
    for c in masks:
        m = m * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    df = df.withColumn("_m", m)
    w = F.col("_m")
    for c in inverse_frequency:
        w = w * inverse_frequency_weight(df, patch, c, F.col("_m") > 0, (valid_values or {}).get(c))
    return df.withColumn(out, w).drop("_m")


def anchors_union(*parts: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct coordinates over all parts."""
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    return out.distinct()


def compact_coords(lists: dict[str, DataFrame], coords: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Unique coordinates numbered from 0, and every list re-indexed to those numbers."""
    unique = anchors_union(*lists.values(), cols=coords)
    index = global_rank(unique, [F.col(c) for c in coords], "idx").withColumn("idx", F.col("idx") - 1)
    return index, {k: v.join(index, coords) for k, v in lists.items()}


# batches and bootstraps ----------------------------------------------------------------------


def chunk_batches(df: DataFrame, chunk: list[str], keys: list[str], size: int, drop_last: bool = False, replacement: bool = False,
                  seed: int = 0, order: Column | None = None, draw=None) -> DataFrame:
    """Batch number and position inside a chunk; with replacement each slot draws a row of the chunk.

    A chunk is a storage tile, so its row count is bounded by the tile area.
    """
    h = order if order is not None else seeded(seed, *keys)
    ranked = df.withColumn("_h", h).withColumns({
        "_rn": F.row_number().over(Window.partitionBy(*chunk).orderBy("_h", *keys)), "_n": F.count("*").over(Window.partitionBy(*chunk))})
    if replacement:
        slots = ranked.filter("_rn = 1").select(*chunk, F.col("_n").alias("_cn"))
        total = (F.ceil(F.col("_cn") / size) * size).cast("long")
        slots = slots.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)))
        slots = slots.withColumn("_pick", F.pmod(draw(F.col("slot")) if draw else seeded(seed + 1, *chunk, "slot"), F.col("_cn")) + 1)
        out = slots.join(ranked.withColumnRenamed("_rn", "_pick"), [*chunk, "_pick"])
        out = out.withColumns({"batch": F.floor(F.col("slot") / size), "position": F.col("slot") % size})
        return out.drop("_h", "_n", "_cn", "_pick", "slot")
    out = ranked.withColumns({"batch": F.floor((F.col("_rn") - 1) / size), "position": (F.col("_rn") - 1) % size})
    if drop_last:
        out = out.filter(F.col("batch") < F.floor(F.col("_n") / size))
    return out.drop("_h", "_rn", "_n")


def weighted_bootstrap(df: DataFrame, keys: list[str], weight: str, n: int, seed: int = 0, u=None) -> DataFrame:
    """n draws with replacement in proportion to a weight (negative -> 0).

    Each row owns an interval of the running weight. Interval starts and draws are sorted together by their place in
    range partitions; a draw takes the last start before it, from an earlier partition where its own has none. The work
    grows with rows plus draws.
    """
    w = df.withColumn("_w", F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))).filter("_w > 0")
    cum = global_prefix_sum(w, [F.col(k) for k in keys], "_w", "_hi")
    total = w.agg(F.sum("_w")).first()[0]
    if not total:
        raise ValueError("all weights are zero")
    spans = cum.select((F.col("_hi") - F.col("_w")).alias("_at"), F.struct(*df.columns).alias("_row"), F.lit(None).cast("long").alias("draw"))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    draws = draws.select(((u(F.col("draw")) if u else uniform(seeded(seed, "draw"))) * total).alias("_at"), F.lit(None).cast(spans.schema["_row"].dataType).alias("_row"), "draw")
    order = [F.col("_at"), F.col("draw").asc_nulls_first()]  # an interval starts before the draws at its place
    both = cut_lineage(spans.unionByName(draws).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    # the last start of each partition, carried over partitions without one; a row per partition
    ends = both.groupBy("_part").agg(F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col("_at"))).alias("_end"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    so_far = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_own", F.last("_row", ignorenulls=True).over(so_far)).filter(F.col("draw").isNotNull()).join(carried, "_part")
    return hit.select("draw", F.coalesce("_own", "_carried").alias("_row")).select("draw", "_row.*")


def fold_assign(df: DataFrame, k: int, keys: list[str], seed: int = 0, order: Column | None = None, out: str = "fold") -> DataFrame:
    """Balanced random folds 1..k: equal-count tiles of the hash order."""
    d = df.withColumn("_h", order if order is not None else seeded(seed, *keys))
    return d.withColumn(out, tile_of(["_h", *keys], rank_cuts(d, ["_h", *keys], k))).drop("_h")


def rank_patches(df: DataFrame, ps: int, ysfc: str, valid: Column, below: float = 10, row: str = "row", col: str = "col") -> DataFrame:
    """Patches by number of valid recently disturbed pixels."""
    keys = [F.floor(F.col(row) / ps).alias("patch_row"), F.floor(F.col(col) / ps).alias("patch_col")]
    n = F.count_if(F.coalesce(valid, F.lit(False)) & F.coalesce(F.col(ysfc) < below, F.lit(False)))
    return df.groupBy(*keys).agg(n.alias("n")).orderBy(F.col("n").desc(), "patch_row", "patch_col")


def spread_channels(stats: DataFrame, n: int, channel: str = "channel", sd: str = "sd", floor: float = 0.1) -> DataFrame:
    """n channels from the lowest to the highest variance among those with sd >= floor.

    The input holds one row per channel, a bounded list.
    """
    e = stats.filter(F.col(sd) >= floor).select(channel, sd)
    w = Window.orderBy(sd, channel)
    r = e.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy())})
    m = F.least(F.lit(n), F.col("_n"))
    picks = F.transform(F.sequence(F.lit(0), (m - 1).cast("int")), lambda q: F.floor(q * (F.col("_n") - 1) / F.greatest(m - 1, F.lit(1))))
    return r.filter(F.array_contains(picks, F.col("_i").cast("long"))).select(channel, sd)


def distinct_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def derived_feature_sample(df: DataFrame, patches: int, per_patch: int, patch: list[str], keys: list[str], aoi: str, seed: int = 42,
                           order: Column | None = None, pixel_order: Column | None = None) -> DataFrame:
    """Random patches, pixels inside the AOI, at most ``per_patch`` pixels each: the input of derived statistics."""
    chosen = sample_patches(df.select(*patch).distinct(), patches, patch, seed, order)
    inside = df.filter(F.col(aoi) > 0).join(chosen, patch, "left_semi")
    return cap_per_batch(inside, per_patch, keys, patch, seed, pixel_order)
