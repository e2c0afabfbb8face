"""Helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    Projections are merged into the lambdas that use them, where an expression would be computed
    again for every element. A lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), 0)
