"""Analytic functions over a group in a stated row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Whole(tuple):
    """The empty group of a whole table. Functions leave what they need here and name the column it will be in; ``sets.carried`` makes it."""

    def __init__(self, *_):
        self.asked: list[tuple] = []

    def ask(self, how: str, c, k: int = 1, default=None) -> Column:
        self.asked.append((f"_whole{len(self.asked)}", how, F.col(c) if isinstance(c, str) else c, k, default))
        return F.col(self.asked[-1][0])


def _ranged(group, order) -> bool:
    """Names as an order can be cut into ranges."""
    return isinstance(group, Whole) and bool(order) and all(isinstance(o, str) for o in order)


def over(group, order):
    """(whole group, group up to the row, group from the row, plain order)."""
    p = W.partitionBy(*group)
    o = p.orderBy(*order) if order else p
    return p, o.rowsBetween(W.unboundedPreceding, 0), o.rowsBetween(0, W.unboundedFollowing), o


def lag(c, k=1, default=None, group=(), order=()):
    if _ranged(group, order):
        return group.ask("lag" if k >= 0 else "lead", c, abs(k), default)
    return F.lag(c, k, default).over(over(group, order)[3])


def lead(c, k=1, default=None, group=(), order=()):
    if _ranged(group, order):
        return group.ask("lead" if k >= 0 else "lag", c, abs(k), default)
    return F.lead(c, k, default).over(over(group, order)[3])


def _running(how, c, missings, group, order) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    f = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max}[how]
    out = group.ask(how, x) if _ranged(group, order) else f(x).over(over(group, order)[1])
    return out if missings == "ignore" else F.when(x.isNotNull(), out)


def cumsum(c, missings="ignore", group=(), order=()):
    return _running("sum", c, missings, group, order)


def cumprod(c, missings="ignore", group=(), order=()):
    return _running("prod", c, missings, group, order)


def cummin(c, missings="ignore", group=(), order=()):
    return _running("min", c, missings, group, order)


def cummax(c, missings="ignore", group=(), order=()):
    return _running("max", c, missings, group, order)


def ffill(c, by=None, group=(), order=()):
    x = F.col(c)
    hole = by(x) if by else x.isNull()
    if _ranged(group, order):
        return F.coalesce(group.ask("last", F.when(~hole, x)), x)
    return F.coalesce(F.last(F.when(~hole, x), True).over(over(group, order)[1]), x)


def bfill(c, by=None, group=(), order=()):
    x = F.col(c)
    hole = by(x) if by else x.isNull()
    if _ranged(group, order):
        return F.coalesce(group.ask("first", F.when(~hole, x)), x)
    return F.coalesce(F.first(F.when(~hole, x), True).over(over(group, order)[2]), x)


def _of_group(f, c, group) -> Column:
    return group.ask("all", f(c)) if isinstance(group, Whole) else f(c).over(over(group, ())[0])


def stdze(c, group=()):
    return (F.col(c) - _of_group(F.avg, c, group)) / F.nullif(_of_group(F.stddev_samp, c, group), F.lit(0.0))


def rescale(c, low=0.0, high=1.0, group=()):
    a, b = _of_group(F.min, c, group), _of_group(F.max, c, group)
    return (F.col(c) - a) / F.nullif(b - a, F.lit(0)) * (high - low) + low
