"""Transpose (stack, pivot, group rows to columns), flatten, split, repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.sets import row_ids
from tessera.selectors import make_unique


def stack(df: DataFrame, ids: list[str], cols: list[str], variable="_variables_", value="_c1") -> DataFrame:
    """Long form: a row for each id row and column."""
    return df.unpivot(ids, cols, variable, value)


#: Most columns that gathered ids may become.
MOST = 10_000


def _ids(df: DataFrame, id_, order=None, values=None) -> tuple[DataFrame, list[tuple[tuple, str]]]:
    """df with _id, the ids as a struct of texts, and (values, name) of each id, in order of first appearance by ``order``, else sorted.

    Several ids are named like (a, b); different tuples stay different columns, nulls too.
    """
    ids = [id_] if isinstance(id_, str) else list(id_)
    df = df.withColumn("_id", F.struct(*[F.col(c).cast("string").alias(f"i{k}") for k, c in enumerate(ids)]))
    if values is None:
        first = F.min(F.struct(*order)) if order else F.min("_id")
        got = df.groupBy("_id").agg(first.alias("f")).orderBy("f").limit(MOST + 1).collect()
        if len(got) > MOST:
            raise ValueError(f"more than {MOST} columns")
        found = [tuple(r["_id"]) for r in got]
    else:
        found = [v if isinstance(v, tuple) else (v,) for v in values]
        found = [tuple(None if x is None else str(x) for x in v) for v in found]
    text = lambda v: "missing" if v is None else v
    names = make_unique([text(v[0]) if len(v) == 1 else f"({', '.join(map(text, v))})" for v in found])
    return df, list(zip(found, names, strict=True))


def _is(value: tuple) -> Column:
    return F.col("_id").eqNullSafe(F.struct(*[F.lit(x).cast("string").alias(f"i{k}") for k, x in enumerate(value)]))


def _cells(df: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """One row for each group and id; a second row for a cell is an error."""
    cell = df.groupBy(*group, "_id").agg(F.first(F.struct(*cols)).alias("_v"), F.count("*").alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("several values for one cell"))).otherwise(F.lit(1))
    return cell.where(checked == 1)


def pivot(df: DataFrame, group: list[str], id_: str | list[str], value: str, values=None, default=None, rename=str, order=None) -> DataFrame:
    """Wide form: ids become columns. A second row for a cell is an error; ``default`` fills absent cells only.

    Without ``values`` the ids are gathered (they become columns, so they are few).
    """
    return pivot_many(df, group, id_, [value], values, default, rename, order)


def pivot_many(df: DataFrame, group: list[str], id_: str | list[str], cols: list[str], values=None, default=None, rename=str, order=None) -> DataFrame:
    """Wide form of several value columns: id names for the first, name_1, name_2, ... for the next. Cells as in ``pivot``."""
    df, ids = _ids(df, id_, order, values)
    aggs, place = [], make_unique([rename(name) for _ in cols for _, name in ids])
    for k, c in enumerate(cols):
        for i, (v, _) in enumerate(ids):
            x = F.max_by("_v", F.when(_is(v), F.lit(1)))  # a struct tells an absent cell from a null value
            got = x[c]
            aggs.append((F.when(x.isNotNull(), got).otherwise(F.lit(default)) if default is not None else got).alias(place[k * len(ids) + i]))
    cells = _cells(df, group, cols)
    return cells.groupBy(*group).agg(*aggs) if group else cells.agg(*aggs)


def rows_to_columns(df: DataFrame, group: list[str], cols: list[str], order: list, width: int | None = None, variable="_variables_", default=None, rename=None) -> DataFrame:
    """The k-th row of a group becomes column _ck; a row for each group and column of ``cols``.

    As many columns as the largest group has rows, or ``width``: then a larger group is an error. ``default`` fills up shorter groups.
    """
    most = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if most > (width or MOST):
        raise ValueError(f"a group has {most} rows, more than {width or MOST}")
    width = width or most
    rename = rename or (lambda k: f"_c{k}")
    rn = df.withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    long = rn.unpivot([*group, "_rn"], cols, variable, "_v")
    cell = lambda k: F.max_by(F.struct("_v"), F.when(F.col("_rn") == k, F.lit(1)))
    fill = lambda x: x["_v"] if default is None else F.when(x.isNotNull(), x["_v"]).otherwise(F.lit(default))
    return long.groupBy(*group, variable).agg(*[fill(cell(k)).alias(rename(k)) for k in range(1, width + 1)])


def flatten(df: DataFrame, cols: list[str]) -> DataFrame:
    """Explode list columns in lockstep: a null counts as one null, an empty list drops the row, unequal lengths raise."""
    arrs = {c: F.coalesce(F.col(c), F.array(F.lit(None))) for c in cols}
    sizes = [F.size(a) for a in arrs.values()]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    zipped = F.when(same, F.arrays_zip(*[a.alias(c) for c, a in arrs.items()])).otherwise(F.raise_error(F.lit("lists of unequal length")))
    out = df.withColumn("_z", F.explode(zipped))
    return out.select(*[F.col("_z").getField(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def split_into(df: DataFrame, col: str, names: list[str]) -> DataFrame:
    """Elements of a list column as columns; missing ones are null."""
    return df.select("*", *[F.get(F.col(col), F.lit(i)).alias(n) for i, n in enumerate(names)])


def repeat(df: DataFrame, inner: int = 1, outer: int = 1, freq=None) -> DataFrame:
    """Each row ``inner`` x ``outer`` times, or as often as ``freq`` says (0 or null drops it)."""
    n = (F.col(freq) if isinstance(freq, str) else freq) if freq is not None else F.lit(inner * outer)
    return df.where(n > 0).withColumn("_r", F.explode(F.sequence(F.lit(1), n.cast("int")))).drop("_r")


def transpose(df: DataFrame, cols: list[str], id_: str | list[str] | None = None, values=None, variable="_variables_", order=None, rename=str, rename_row=None) -> DataFrame:
    """Rows become columns, named by ``id_``, or _c1, _c2, ... by their place in ``order``; a row for each column of ``cols``.

    rename makes column names of ids, rename_row values of the variable column. Repeated ids are an error.
    """
    if id_ is None:
        df, id_ = row_ids(df, order, "_place"), "_place"
        n = df.count()
        if n > MOST:
            raise ValueError(f"more than {MOST} columns")
        values, rename = list(range(1, n + 1)), (lambda k, f=rename: f(f"_c{k}"))
    ids = [id_] if isinstance(id_, str) else list(id_)
    out = pivot(df.unpivot(ids, cols, variable, "_value"), [variable], ids, "_value", values, rename=rename)
    if rename_row:
        names = F.create_map(*[F.lit(x) for c in cols for x in (c, rename_row(c))])
        out = out.withColumn(variable, F.element_at(names, F.col(variable)))
    return out
