"""Aggregates that skip nulls; all null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.nulls import isle, isless


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum_(c):
    return F.sum(_c(c))


def mean(c):
    return F.avg(_c(c))


def maximum(c):
    return F.max(_c(c))


def minimum(c):
    return F.min(_c(c))


def var(c, dof=True):
    return F.var_samp(_c(c)) if dof else F.var_pop(_c(c))


def std(c, dof=True):
    return F.stddev_samp(_c(c)) if dof else F.stddev_pop(_c(c))


def median(c):
    """Exact; NaN if any value is NaN."""
    x = _c(c).cast("double")
    return F.when(F.max(F.isnan(x)), F.lit(float("nan"))).otherwise(F.median(x))


def extrema(c):
    return F.struct(F.min(_c(c)).alias("min"), F.max(_c(c)).alias("max"))


def argmax(c, idx):
    return F.max_by(_c(idx), F.when(_c(c).isNotNull(), F.struct(_c(c), -_c(idx))))


def argmin(c, idx):
    return F.min_by(_c(idx), F.when(_c(c).isNotNull(), F.struct(_c(c), _c(idx))))


def findmax(c, idx):
    return F.struct(F.max(_c(c)).alias("value"), argmax(c, idx).alias("index"))


def findmin(c, idx):
    return F.struct(F.min(_c(c)).alias("value"), argmin(c, idx).alias("index"))


def wsum(x, w):
    return F.sum(_c(x) * _c(w))


def wmean(x, w):
    ok = _c(x).isNotNull() & _c(w).isNotNull()
    return F.sum(_c(x) * _c(w)) / F.nullif(F.sum(F.when(ok, _c(w))), F.lit(0))


def n(c):
    return F.count(_c(c))


def nmissing(c):
    return F.count_if(_c(c).isNull())


def length(c=None):
    return F.count(F.lit(1))


def nunique(c):
    """Distinct values, null being one."""
    return F.countDistinct(_c(c)) + F.max(_c(c).isNull().cast("long"))


def search_first(c, x):
    """1-based place of the first value that is not below x, in the column's order (null last): a count, no sort."""
    return F.count_if(isless(_c(c), x)) + 1


def search_last(c, x):
    """1-based place of the last value that is not above x; 0 if there is none."""
    return F.count_if(isle(_c(c), x))


def cor(x, y):
    return F.corr(_c(x), _c(y))


def cov(x, y):
    return F.covar_samp(_c(x), _c(y))


def user(f, kind="double"):
    """A numpy function of one column as an aggregate: the slow path, one group at a time."""
    import pandas as pd

    def run(x):
        return f(x.dropna().to_numpy())

    run.__annotations__ = {"x": pd.Series, "return": float}
    run.__name__ = getattr(f, "__name__", "function")
    udf = F.pandas_udf(run, kind)
    return lambda c: udf(_c(c))


def topk(c, k, rev=False):
    """Up to k largest values of a group, descending, as a list (rev: smallest, ascending); all null: one null.

    The group's values are held at once; ``Frame.topk_groups`` cuts groups before they are exchanged.
    """
    got = F.array_sort(F.collect_list(_c(c)))
    return F.when(F.size(got) == 0, F.array(F.max(_c(c)))).otherwise(F.slice(got if rev else F.reverse(got), 1, k))


def topkperm(c, idx, k, rev=False):
    """The indices of the topk values, of any sortable type; ties by the smaller index; all null: one null."""
    x, i = _c(c), _c(idx)
    held = F.collect_list(F.when(x.isNotNull(), F.struct(x.alias("x"), i.alias("i"))))
    first = lambda a, b: (a["x"] < b["x"]) if rev else (a["x"] > b["x"])
    order = lambda a, b: F.when(first(a, b), -1).when(first(b, a), 1).when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)
    got = F.slice(F.transform(F.array_sort(held, order), lambda s: s["i"]), 1, k)
    return F.when(F.size(held) == 0, F.array(F.max(F.when(x.isNotNull(), i)))).otherwise(got)


#: Functions of numbers: Frame hands booleans over as 1 and 0.
NUMERIC = {sum_, mean, var, std, median, wsum, wmean, cor, cov}
