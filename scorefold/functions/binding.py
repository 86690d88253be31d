"""Evaluate an expression once where it is used several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column that a lambda refers to is otherwise computed again for every
    element, because the optimizer merges single-use projections.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
