"""Null and truthiness rules of document queries, which differ from SQL's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column) -> Column:
    """Null counts as zero in arithmetic."""
    return F.coalesce(x, F.lit(0.0))


def truthy_or(x: Column, default) -> Column:
    """The first truthy operand: null, zero, the empty text and false fall through."""
    d = default if isinstance(default, Column) else F.lit(default)
    text = x.cast("string")
    return F.when(x.isNull() | text.isin("0", "0.0", "", "false"), d).otherwise(x)


def at_most(x: Column, limit) -> Column:
    """Null sorts before every number, so it is at most any of them."""
    return x.isNull() | (x <= limit)


def below(x: Column, limit) -> Column:
    return x.isNull() | (x < limit)
