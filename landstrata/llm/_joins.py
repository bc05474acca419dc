"""Joins of wide texts with narrow lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHIPPED = 500_000  # rows of a narrow list that go to every executor, a few tens of megabytes at most


def shipped_if_small(keys: DataFrame, most: int | None = None) -> DataFrame:
    """The list with a broadcast hint if it is counted to have at most ``most`` rows, so texts need no shuffle;
    a longer list stays as it is and both sides are shuffled. ``keys`` is a stored table of a few numbers a row."""
    return F.broadcast(keys) if keys.count() <= (SHIPPED if most is None else most) else keys
