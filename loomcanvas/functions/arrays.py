"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once: a lambda variable is not expanded into its uses as an expression is."""
    return F.transform(F.array(value), body)[0]


def joined(ids: Column) -> Column:
    """An id array as text, so that any engine compares it the same way."""
    return F.array_join(F.transform(ids, lambda t: t.cast("string")), " ")
