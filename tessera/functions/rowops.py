"""Row-wise operators over several columns, as plain expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.nulls import both, either, isle, isless, matches, truth


def _c(cols, by=None) -> list[Column]:
    out = [F.col(c) if isinstance(c, str) else c for c in cols]
    return [by(c) for c in out] if by else out


def _unless_all_null(cols: list[Column], value: Column) -> Column:
    return F.when(either(c.isNotNull() for c in cols), value)


def row_sum(cols, by=None) -> Column:
    cs = _c(cols, by)
    return _unless_all_null(cs, reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cs]))


def row_prod(cols, by=None) -> Column:
    cs = _c(cols, by)
    return _unless_all_null(cs, reduce(lambda a, b: a * b, [F.coalesce(c, F.lit(1)) for c in cs]))


def row_n(cols) -> Column:
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("long") for c in _c(cols)])


def row_count(cols, by=True) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(matches(by)(c), F.lit(False)).cast("long") for c in _c(cols)])


def _preds(cols, by, missings) -> list[Column]:
    bys = by if isinstance(by, (list, tuple)) else [by] * len(cols)
    return [truth(matches(p)(c), missings) for c, p in zip(_c(cols), bys, strict=True)]


def row_any(cols, by=True, missings=None) -> Column:
    return either(_preds(cols, by, missings))


def row_all(cols, by=True, missings=None) -> Column:
    return both(_preds(cols, by, missings))


def row_isequal(cols, with_=None) -> Column:
    cs = _c(cols)
    first = _c([with_])[0] if with_ is not None else cs[0]
    return both(first.eqNullSafe(c) for c in cs)


def row_isless(cols, with_, rev=False, lt=None) -> Column:
    """All below ``with_`` (rev: above). ``lt(a, b)`` replaces the order."""
    w = _c([with_])[0]
    if lt:
        return both(F.coalesce(lt(w, c) if rev else lt(c, w), F.lit(False)) for c in _c(cols))
    return both(isless(w, c) if rev else isless(c, w) for c in _c(cols))


def row_in(item, cols, eq=None) -> Column:
    x = _c([item])[0]
    return either(F.coalesce(eq(x, c), F.lit(False)) if eq else x.eqNullSafe(c) for c in _c(cols))


def row_findfirst(names, by=True, last=False, item=None, eq=None) -> Column:
    """Name of the first (last) column that ``by`` holds for, or that equals the column or value ``item`` (by ``eq``)."""
    x = None if item is None else _c([item])[0] if isinstance(item, (str, Column)) else F.lit(item)
    test = matches(by) if x is None else (lambda c: eq(c, x)) if eq else (lambda c: c.eqNullSafe(x))
    hits = [F.when(test(F.col(n)), F.lit(n)) for n in names]
    return F.coalesce(*(hits[::-1] if last else hits))


def row_select(names, with_) -> Column:
    """The value of the column that ``with_`` names or numbers (from 1)."""
    w = _c([with_])[0]
    return F.coalesce(*[F.when((w.cast("string") == n) | (w.cast("string") == str(i)), F.col(n)) for i, n in enumerate(names, 1)])


def row_fill(names, with_, by=None, rolling=False) -> dict[str, Column]:
    w, out = _c([with_])[0], {}
    for n in names:
        c = F.col(n)
        out[n] = F.when(by(c) if by else c.isNull(), w).otherwise(c)
        if rolling:
            w = out[n]
    return out


def row_coalesce(cols) -> Column:
    return F.coalesce(*_c(cols))


def row_mean(cols, by=None) -> Column:
    n = row_n(cols)
    return row_sum(cols, by).cast("double") / F.nullif(n, F.lit(0))


def row_max(cols, by=None) -> Column:
    cs = _c(cols, by)
    return F.greatest(*cs) if len(cs) > 1 else cs[0]


def row_min(cols, by=None) -> Column:
    cs = _c(cols, by)
    return F.least(*cs) if len(cs) > 1 else cs[0]


def row_argmax(names, by=None) -> Column:
    top = row_max(names, by)
    return F.coalesce(*[F.when(c == top, F.lit(n)) for n, c in zip(names, _c(names, by), strict=True)])


def row_argmin(names, by=None) -> Column:
    low = row_min(names, by)
    return F.coalesce(*[F.when(c == low, F.lit(n)) for n, c in zip(names, _c(names, by), strict=True)])


def _var(cols, dof, root) -> Column:
    cs, d = [c.cast("double") for c in _c(cols)], 1 if dof else 0
    n = row_n(cols)
    s, ss = (reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs]) for xs in (cs, [c * c for c in cs]))
    v = F.greatest((ss - s * s / n) / (n - d), F.lit(0.0))
    return F.when(n > d, F.sqrt(v) if root else v)


def row_var(cols, dof=True) -> Column:
    return _var(cols, dof, False)


def row_std(cols, dof=True) -> Column:
    return _var(cols, dof, True)


def row_nunique(cols, by=None, count_missing=True) -> Column:
    arr = F.array(*_c(cols, by))
    return F.size(F.array_distinct(arr if count_missing else F.array_compact(arr))).cast("long")


def row_cum(names, op, missings="ignore") -> dict[str, Column]:
    """Running value across columns. ignore: a null takes the value so far; skip: a null stays null."""
    out, acc = {}, None
    for n in names:
        c = F.col(n)
        acc = c if acc is None else F.when(acc.isNull(), c).when(c.isNull(), acc).otherwise(op(acc, c))
        out[n] = acc if missings == "ignore" else F.when(c.isNotNull(), acc)
    return out


def row_cumsum(names, missings="ignore"):
    return row_cum(names, lambda a, b: a + b, missings)


def row_cumprod(names, missings="ignore"):
    return row_cum(names, lambda a, b: a * b, missings)


def row_cummin(names, missings="ignore"):
    return row_cum(names, F.least, missings)


def row_cummax(names, missings="ignore"):
    return row_cum(names, F.greatest, missings)


def row_sort(names, rev=False) -> dict[str, Column]:
    arr = F.array(*_c(names))
    key = F.reverse(F.array_sort(arr)) if rev else F.array_sort(arr)
    return {n: F.get(key, F.lit(i)) for i, n in enumerate(names)}


def row_issorted(cols, rev=False) -> Column:
    cs = _c(cols)
    return both(isle(b, a) if rev else isle(a, b) for a, b in zip(cs, cs[1:], strict=False))


def row_stdze(names) -> dict[str, Column]:
    m, s = row_mean(names), row_std(names)
    return {n: (F.col(n) - m) / F.nullif(s, F.lit(0.0)) for n in names}


def row_hash(cols, by=None) -> Column:
    """64-bit hash that tells a null from its place: the function itself skips nulls."""
    return F.xxhash64(*[F.struct(c.isNull(), c) for c in _c(cols, by)])


def _text(c: Column) -> Column:
    """Value as text; booleans, whose type only the plan knows, as 1 and 0."""
    flag = F.when(c.cast("string") == "true", "1").otherwise("0")
    return F.when(F.typeof(c) == "boolean", F.when(c.isNotNull(), flag)).otherwise(c.cast("string"))


def row_join(cols, delim="", last=None) -> Column:
    """Values as text: null is empty, true and false are 1 and 0; ``last`` replaces the last delimiter."""
    parts = [F.coalesce(_text(c), F.lit("")) for c in _c(cols)]
    if last is None or len(parts) < 2:
        return F.concat_ws(delim, *parts)
    return F.concat(F.concat_ws(delim, *parts[:-1]), F.lit(last), parts[-1])


def row_mapreduce(cols, f, op, init=None) -> Column:
    xs = _c(cols, f)
    return reduce(op, xs, init) if init is not None else reduce(op, xs)


def row_call(f, cols) -> Column:
    """f(c1, c2, ...) of the columns."""
    return f(*_c(cols))


def row_cast(cols, kind: str, strict: bool = True) -> dict[str, Column]:
    """Columns (by name) in another type; what can't be cast raises, or is null unless ``strict``."""
    return {c: F.col(c).cast(kind) if strict else F.col(c).try_cast(kind) for c in cols}


def row_apply(cols, f, kind: str = "double") -> Column:
    """f(list of the row's values) by Python, in Arrow batches: for functions that columns can't express."""
    import pandas as pd

    def run(rows):
        clean = rows.astype(object).where(rows.notna(), None)
        return pd.Series([f(list(r)) for r in clean.itertuples(index=False, name=None)])

    run.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(run, kind)(F.struct(*_c(cols)))
