"""Small helpers over Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: an expression that stands in a lambda is computed again at each of its steps."""
    return F.transform(F.array(value), body)[0]
