"""Total order with nulls last, and predicates that treat nulls as values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def isless(a: Column, b: Column) -> Column:
    """a < b where null is the largest value."""
    return a.isNotNull() & (b.isNull() | F.coalesce(a < b, F.lit(False)))


def isle(a: Column, b: Column) -> Column:
    return ~isless(b, a)


def sort_key(c: Column | str, desc: bool = False) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.desc_nulls_first() if desc else c.asc_nulls_last()


def truth(pred: Column, missings: bool | None) -> Column:
    """Null results replaced, unless missings is None."""
    return pred if missings is None else F.coalesce(pred, F.lit(missings))


def both(conds) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def either(conds) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def matches(pattern):
    """Predicate maker: a callable stays, a value means null-safe equality."""
    return pattern if callable(pattern) else (lambda c: c.eqNullSafe(F.lit(pattern)))
