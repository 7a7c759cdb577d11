"""Small helpers over columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(v) with v bound to value, computed once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
