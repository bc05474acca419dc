"""Registry that keeps each query beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Sums differ in their last bits between engines.  Both sides add this before rounding, so a value
# that sits exactly on a half step rounds the same way.
NUDGE = 1e-9


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as ``name``; ``sql`` is the DuckDB equivalent."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            # count_if gives HUGEINT in DuckDB; a filtered count gives BIGINT
            ORACLE[name] = sql.replace("round(", f"round({NUDGE!r} + ").replace("count_if(", "count(*) filter (where ")
        return fn

    return register


def R(col, k: int) -> Column:
    """Round for comparison with the SQL side."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(F.lit(NUDGE) + c, k)


def rounded(df: DataFrame, digits: int | dict[str, int], *names: str) -> DataFrame:
    """Round the named columns (all double columns when none are named)."""
    if isinstance(digits, dict):
        return df.withColumns({c: R(c, k) for c, k in digits.items()})
    cols = names or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: R(c, digits) for c in cols})


def rounds(names: list[str], k: int, sep: str = ", ") -> str:
    """SQL text rounding each named column to itself."""
    return sep.join(f"round({n}, {k}) as {n}" for n in names)
