"""Joins of sides whose size Spark cannot tell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def meet(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join by sorting, never by broadcast.

    Spark takes a side that was exploded to be as large as before, so it would send sides of any size through the driver.
    """
    return left.join(right.hint("merge"), on if isinstance(on, str) else list(on), how)
