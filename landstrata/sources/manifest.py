"""Feature manifests and year axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted header spellings.
HEADER_ALIASES = {
    "year": ("year", "yr"), "kind": ("kind", "type"), "path": ("path", "file", "file_path", "filepath", "filename"),
    "fid": ("fid", "id", "feature", "feature_id", "name"),
}
KINDS = ("int", "cat")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(year, fid, kind, path): loose headers, kind int or cat, id defaults to the file stem."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return normalise_manifest(raw)


def normalise_manifest(raw: DataFrame) -> DataFrame:
    names = {c.strip().lower(): c for c in raw.columns}
    found = {k: next((names[a] for a in al if a in names), None) for k, al in HEADER_ALIASES.items()}
    missing = [k for k in ("year", "kind", "path") if found[k] is None]
    if missing:
        raise ValueError(f"manifest lacks columns for {missing}; has {raw.columns}")
    stem = F.regexp_extract(F.col(found["path"]), r"([^/\\]+?)(\.[^./\\]*)?$", 1)
    fid = F.coalesce(F.nullif(F.trim(F.col(found["fid"])), F.lit("")), stem) if found["fid"] else stem
    kind = F.lower(F.trim(F.col(found["kind"])))
    bad = F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("NULL")))).cast("string")
    return raw.select(
        F.col(found["year"]).cast("int").alias("year"), fid.alias("fid"),
        F.when(kind.isin(*KINDS), kind).otherwise(bad).alias("kind"), F.col(found["path"]).alias("path"))


def check_consistent_features(manifest: DataFrame) -> DataFrame:
    """Years whose ordered (fid, kind) list differs from the most common one; empty means consistent."""
    # a year lists the features of one store, so the list is short
    per = manifest.groupBy("year").agg(F.array_sort(F.collect_list(F.struct("fid", "kind"))).alias("features"))
    sets = per.groupBy("features").agg(F.count("*").alias("n"))
    main = sets.agg(F.max_by("features", F.struct("n", F.size("features")))).scalar()
    return per.filter(F.col("features") != main).select("year", F.transform("features", lambda s: s["fid"]).alias("fids"))


def select_years(end_years: DataFrame, end_year: str, window: int, out: str = "year") -> DataFrame:
    """Union of the trailing windows, distinct and sorted."""
    y = F.explode(F.sequence(F.col(end_year) - (window - 1), F.col(end_year)))
    return end_years.select(end_year).distinct().select(y.alias(out)).distinct().orderBy(out)


def stack_features(df: DataFrame, key: list[str], kinds: dict[str, str]) -> DataFrame:
    """(key, kind, fid, value) rows, the feature axis sorted by id."""
    items = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(f).alias("fid"), F.col(f).cast("double").alias("value")) for f, k in sorted(kinds.items())]))
    return df.select(*key, items.alias("i")).select(*key, "i.*")
