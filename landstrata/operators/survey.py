"""Survey-plot aggregates, stratification schemes and their efficiency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ss(y: str) -> Column:
    """Within-group sum of squares; a one-row group contributes 0."""
    return F.var_pop(y) * F.count(y)


def area_weighted_mean(df: DataFrame, key: str, x: str, weight: str, out: str) -> DataFrame:
    """Sum(x*w)/sum(w) per plot, NULL x counted as 0."""
    return df.groupBy(key).agg(
        F.try_divide(F.sum(F.coalesce(F.col(x), F.lit(0.0)) * F.col(weight)), F.sum(weight)).alias(out)
    )


def conditional_tree_sums(tree: DataFrame, key="plt_cn", status="statuscd", species="spcd", tpa="tpa", vol="vol",
                          live_status: int = 1, hardwood_from: int = 300) -> DataFrame:
    """Live trees per acre (all, hardwood, softwood) and live volume, one row per plot."""
    t, s = F.col(tpa), F.col(species)
    return tree.filter(F.col(status) == live_status).groupBy(key).agg(
        F.sum(t).alias("tpa_live"),
        F.sum(F.when(s >= hardwood_from, t).otherwise(0.0)).alias("tpa_hardwood"),
        F.sum(F.when(s < hardwood_from, t).otherwise(0.0)).alias("tpa_softwood"),
        F.sum(F.col(vol) * t).alias("vol_live"),
    )


def removals(grm: DataFrame, key="plt_cn", volume="remv", tpa="tpa_remv", out="removal") -> DataFrame:
    """Removed volume per plot; a remeasured plot without cuts is 0, not NULL."""
    zero = F.lit(0.0)
    return grm.groupBy(key).agg(F.sum(F.coalesce(F.col(volume), zero) * F.coalesce(F.col(tpa), zero)).alias(out))


def semi_join_plots(df: DataFrame, plots: DataFrame, key: str, plot_key: str = "cn") -> DataFrame:
    """Rows of ``df`` whose plot is known."""
    return df.join(plots.select(F.col(plot_key).alias(key)), key, "left_semi")


def dominant_condition(df: DataFrame, key: str, prop: str, ties: list[Column]) -> DataFrame:
    """The row with the largest proportion per plot."""
    w = Window.partitionBy(key).orderBy(F.col(prop).desc(), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def assemble_frame(base: DataFrame, inner: list[DataFrame] = (), left: list[DataFrame] = (), on: str = "cn",
                   zero_fill: list[str] = ()) -> DataFrame:
    """Inner joins, then left joins, then NULL -> 0 on the named columns."""
    out = reduce(lambda a, b: a.join(b, on, "inner"), inner, base)
    out = reduce(lambda a, b: a.join(b, on, "left"), left, out)
    return out.fillna(0, subset=list(zero_fill)) if zero_fill else out


def fixed_bins(x, edges: list[float], labels: list[str], closed: str = "right") -> Column:
    """Label of the bin holding ``x``; bins run (-inf, e0], (e0, e1], ... or left-closed."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label more than edges")
    x = F.col(x) if isinstance(x, str) else x
    out = F.when(x.isNull(), F.lit(None))
    for edge, label in zip(edges, labels):
        out = out.when(x <= edge if closed == "right" else x < edge, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def class_bins(x, edges: list[float], closed: str = "left") -> Column:
    """0-based bin of ``x`` in [e0,e1), [e1,e2), ... (or right-closed); outside -> NULL."""
    x = F.col(x) if isinstance(x, str) else x
    out = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        inside = (x >= lo) & (x < hi) if closed == "left" else (x > lo) & (x <= hi)
        out = F.when(inside, F.lit(i)) if out is None else out.when(inside, F.lit(i))
    return out


def dh_histogram(df: DataFrame, x: str, nbins: int = 100) -> DataFrame:
    """Equal-width histogram of ``x`` over its range, right-closed bins, at most ``nbins`` rows."""
    lim = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    d = df.filter(F.col(x).isNotNull()).select(F.col(x).alias("x")).withColumn("lim", lim)
    width = (F.col("lim.hi") - F.col("lim.lo")) / nbins
    b = F.ceil(F.try_divide(F.col("x") - F.col("lim.lo"), width))
    return (
        d.withColumn("bin", F.greatest(F.lit(1), F.least(F.lit(nbins), F.coalesce(b, F.lit(1)))).cast("int"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.first("lim.lo").alias("lo"), F.first("lim.hi").alias("hi"))
    )


def dh_breaks(df: DataFrame, x: str, k: int, nbins: int = 100) -> list[float]:
    """Dalenius-Hodges cuts: upper edge of the first bin whose running sum of sqrt(n) reaches each target.

    Only the histogram (at most ``nbins`` rows) reaches the driver.
    """
    rows = sorted(dh_histogram(df, x, nbins).collect())
    if not rows or rows[0]["lo"] == rows[0]["hi"]:
        return []
    lo, hi = rows[0]["lo"], rows[0]["hi"]
    total = sum(r["n"] ** 0.5 for r in rows)
    cuts, run, targets = [], 0.0, [total * i / k for i in range(1, k)]
    for r in rows:
        run += r["n"] ** 0.5
        while targets and run >= targets[0] - 1e-9:
            targets.pop(0)
            cuts.append(lo + (hi - lo) * r["bin"] / nbins)
    return sorted(set(cuts))


def dh_strata(x, breaks: list[float]) -> Column:
    """1 + number of cuts <= x (left-closed intervals); no cuts -> 1."""
    x = F.col(x) if isinstance(x, str) else x
    out = F.lit(1)
    for b in breaks:
        out = out + F.when(x >= b, 1).otherwise(0)
    return F.when(x.isNotNull(), out)


def quantile_bins(df: DataFrame, x: str, n: int, key: str, out: str) -> DataFrame:
    """Equal-count bins over the whole table, ties by key; the first bins are one larger when they must be.

    ``ntile`` would sort the table in one task.  The n-1 boundary rows come from a distributed rank of the two
    order columns and every row is then compared with them.
    """
    from .ranks import rank_cuts, tile_of

    cuts = rank_cuts(df.filter(F.col(x).isNotNull()), [x, key], n)
    return df.withColumn(out, F.when(F.col(x).isNotNull(), tile_of([x, key], cuts)).cast("int"))


def pooled_within(df: DataFrame, groups: list[str], y: str) -> DataFrame:
    """SS_within / (N - H), one row: n, cells, within_var."""
    g = df.filter(F.col(y).isNotNull()).groupBy(*groups).agg(F.count(y).alias("n"), _ss(y).alias("ss"))
    return g.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("cells"),
        F.try_divide(F.sum("ss"), F.sum("n") - F.count("*")).alias("within_var"),
    )


def strata_efficiency(df: DataFrame, unit: str, schemes: dict[str, str], y: str, reference: str) -> DataFrame:
    """Within variance of every scheme crossed with ``unit``.

    All schemes come from one scan: rows are pre-aggregated on (unit, every stratum column) — the
    partial aggregate carries n, mean and M2 — and the small cube is then regrouped per scheme.
    """
    names = list(schemes)
    labels = [F.struct(F.lit("baseline").alias("scheme"), F.lit("all").alias("stratum"))] + [
        F.struct(F.lit(m).alias("scheme"), F.col(schemes[m]).cast("string").alias("stratum")) for m in names
    ]
    cells = df.filter(F.col(y).isNotNull()).groupBy(unit, *dict.fromkeys(schemes.values())).agg(
        F.count(y).alias("n"), F.avg(y).alias("mu"), _ss(y).alias("ss")
    )
    long = cells.withColumn("s", F.explode(F.array(*labels))).select(unit, "s.scheme", "s.stratum", "n", "mu", "ss")
    # combine cells by sums of n, n*e and n*e*e, where e is the cell's mean less the mean of all rows, so that no stratum's
    # cells are gathered in one place and the squares stay of the size of the spread
    centre = cells.agg(F.sum(F.col("n") * F.col("mu")) / F.sum("n")).scalar()
    e = F.col("mu") - centre
    per = long.groupBy("scheme", unit, "stratum").agg(
        F.sum("n").alias("n_cell"), F.sum("ss").alias("ss_in"), F.sum(F.col("n") * e).alias("s1"), F.sum(F.col("n") * e * e).alias("s2"))
    between = F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * F.col("s1") / F.col("n_cell"))
    v = per.groupBy("scheme").agg(
        F.sum("n_cell").alias("n"),
        F.try_divide(F.sum(F.col("ss_in") + between), F.sum("n_cell") - F.count("*")).alias("within_var"),
    )
    ref = v.agg(
        F.struct(
            F.max(F.when(F.col("scheme") == "baseline", F.col("within_var"))).alias("base"),
            F.max(F.when(F.col("scheme") == reference, F.col("within_var"))).alias("ref"),
        )
    ).scalar()
    v = v.withColumn("_r", ref)
    return v.select(
        "scheme",
        "n",
        "within_var",
        F.sqrt("within_var").alias("within_sd"),
        (100 * F.col("within_var") / F.col("_r.base")).alias("pct_of_baseline"),
        (F.col("_r.ref") / F.col("within_var")).alias("re_vs_ref"),
        (F.col("n") * F.col("_r.base") / F.col("within_var")).alias("ess_unit"),
    )


def per_unit_table(df: DataFrame, unit: str, schemes: dict[str, str], y: str) -> DataFrame:
    """Per unit: n, total variance, within variance and ratio per scheme, best scheme, share of y > 0."""
    # one scan: every row counts for the whole unit (scheme 0) and for its stratum of each scheme
    names = list(schemes)
    strata = [F.lit(None).cast("string"), *[F.col(schemes[n]).cast("string") for n in names]]
    long = df.select(F.col(unit), F.col(y), F.posexplode(F.array(*strata)).alias("_scheme", "_stratum"))
    cells = long.groupBy(unit, "_scheme", "_stratum").agg(F.count(y).alias("n_"), _ss(y).alias("ss_"), F.count_if(F.col(y) > 0).alias("pos_"))

    def of(i: int, c: str) -> Column:
        return F.sum(F.when(F.col("_scheme") == i, F.col(c)))

    within = [F.try_divide(of(i, "ss_"), of(i, "n_") - F.count_if(F.col("_scheme") == i)).alias(f"var_{n}") for i, n in enumerate(names, 1)]
    out = cells.groupBy(unit).agg(
        of(0, "n_").alias("n"), F.try_divide(of(0, "ss_"), of(0, "n_") - 1).alias("var_total"),
        F.try_divide(100.0 * of(0, "pos_"), of(0, "n_")).alias("pct_positive"), *within)
    best = F.least(*[F.col(f"var_{n}") for n in names]) if len(names) > 1 else F.col(f"var_{names[0]}")
    winner = F.coalesce(*[F.when(F.col(f"var_{n}") == best, F.lit(n)) for n in names])
    return out.withColumns(
        {f"{n}_ratio": F.try_divide(F.col(f"var_{n}"), F.col("var_total")) for n in names} | {"winner": winner}
    )


def cell_table(df: DataFrame, groups: list[str], y: str) -> DataFrame:
    """n, mean, variance and sd per cell."""
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(y).alias("mean_y"), F.var_samp(y).alias("var_y"), F.stddev_samp(y).alias("sd_y")
    )


def schemes_long(df: DataFrame, schemes: dict[str, str], y: str) -> DataFrame:
    """(method, stratum, value) rows for every scheme."""
    s = F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(c).cast("string").alias("stratum")) for m, c in schemes.items()
    ]))
    return df.select(s.alias("s"), F.col(y).alias("value")).select("s.method", "s.stratum", "value")


def label_response_table(df: DataFrame, label: str, responses: list[str]) -> DataFrame:
    """n plus mean, sd, q75 and zero share of each response per class."""
    from .quantiles import exact_quantiles

    aggs = [F.count("*").alias("n")]
    for y in responses:
        aggs += [
            F.avg(y).alias(f"{y}_mean"),
            F.stddev_samp(y).alias(f"{y}_sd"),
            F.avg((F.col(y) == 0).cast("double")).alias(f"{y}_zero"),
        ]
    out = df.groupBy(label).agg(*aggs)
    # all responses in one long table, so the quantiles take two scans in all
    long = df.select(F.col(label), F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.col(y).cast("double").alias("v")) for y in responses])).alias("_r"))
    q = exact_quantiles(long.select(label, "_r.y", "_r.v"), [label, "y"], "v", [0.75])
    return out.join(q.groupBy(label).agg(*[F.max(F.when(F.col("y") == y, F.col("q75"))).alias(f"{y}_q75") for y in responses]), label, "left")


def remeasured_only(plot: DataFrame, first: int, last: int, invyr="invyr", prev="prev_plt_cn") -> DataFrame:
    return plot.filter(F.col(invyr).between(first, last) & F.col(prev).isNotNull())


def valid_tcc(x) -> Column:
    """Text canopy cover to a number; above 100 means no data."""
    x = F.col(x) if isinstance(x, str) else x
    v = x.try_cast("double")
    return F.when(v <= 100, v)


def macro_flag(df: DataFrame, lookup: DataFrame, code: str, lookup_code: str, life_form: str) -> DataFrame:
    """Boolean ``is_tree`` from the lookup's life form; unknown codes are False."""
    lf = lookup.select(F.col(lookup_code).alias(code), F.col(life_form).alias("_lf"))
    return df.join(lf, code, "left").withColumn("is_tree", F.coalesce(F.col("_lf") == "Tree", F.lit(False))).drop("_lf")
