"""Evaluate a costly expression once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    A column expression that mentions another expression several times repeats it; inside a lambda
    the value is a variable instead.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
