"""Tiled store writes and wide exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import expand

TILE = 256


def variable_path(root: str, category: str, group: str, subsection: str, band: str) -> str:
    parts = (category, group, subsection, band)
    if any(not p or "/" in p for p in parts):
        raise ValueError(f"a variable needs exactly four path parts, got {parts}")
    return "/".join((root.rstrip("/"), *parts))


def write_cube(df: DataFrame, path: str, mode: str = "overwrite", row: str = "row", col: str = "col", year: str | None = None, tile: int = TILE,
               rows_per_file: int = 5_000_000) -> None:
    """One variable partitioned by tile (and year), rows sorted inside a file.

    Readers prune tiles through the partition columns and rows through the column statistics of the sorted
    files.  Tiles are spread by hash, so a file holds whole tiles; very large tiles are cut by row count.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    parts = ["tile_row", "tile_col"] + ([year] if year else [])
    out = df.withColumns({"tile_row": F.floor(F.col(row) / tile), "tile_col": F.floor(F.col(col) / tile)})
    out = out.repartition(*[F.col(p) for p in parts]).sortWithinPartitions(*parts, row, col)
    out.write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").partitionBy(*parts).parquet(path)


def embedding_rows(df: DataFrame, blocks: dict[str, tuple[Column, int]], keep: list[str], row: str = "row", col: str = "col") -> DataFrame:
    """Original columns, pixel_row, pixel_col and each vector block as numbered columns."""
    cols = [c for name, (vec, n) in blocks.items() for c in expand(vec, name, n)]
    return df.select(*keep, F.col(row).alias("pixel_row"), F.col(col).alias("pixel_col"), *cols)


def write_embeddings(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))
