"""Constructors, readers, writers and display."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.frame import Frame
from tessera.functions.rowops import _text


def from_columns(spark: SparkSession, **cols) -> Frame:
    """Named lists of one length; scalars repeat."""
    n = max([len(v) for v in cols.values() if isinstance(v, (list, tuple, np.ndarray))], default=1)
    full = {k: list(v) if isinstance(v, (list, tuple, np.ndarray)) else [v] * n for k, v in cols.items()}
    if any(len(v) != n for v in full.values()):
        raise ValueError("columns differ in length")
    return Frame(spark.createDataFrame(list(zip(*full.values(), strict=True)), list(full)))


def from_dict(spark: SparkSession, cols: dict) -> Frame:
    """As from_columns; columns in the order of their sorted names."""
    return from_columns(spark, **dict(sorted(cols.items())))


def from_lists(spark: SparkSession, lists, names="auto") -> Frame:
    """Columns as lists; names, or x1, x2, ..."""
    return from_columns(spark, **dict(zip([f"x{i}" for i in range(1, len(lists) + 1)] if names == "auto" else names, lists, strict=True)))


def from_matrix(spark: SparkSession, m, names=None) -> Frame:
    m = np.asarray(m)
    return Frame(spark.createDataFrame(m.tolist(), list(names) if names is not None and names != "auto" else [f"x{i}" for i in range(1, m.shape[1] + 1)]))


def from_table(spark: SparkSession, table, schema=None) -> Frame:
    """A Frame of a DataFrame, a pandas or Arrow table, or rows (dicts, named tuples or tuples)."""
    if isinstance(table, Frame):
        return table
    if isinstance(table, DataFrame):
        return Frame(table)
    if isinstance(table, dict):
        return from_dict(spark, table)
    if hasattr(table, "to_batches") or hasattr(table, "iloc"):
        return Frame(spark.createDataFrame(table, schema) if schema else spark.createDataFrame(table))
    rows = [r._asdict() if hasattr(r, "_asdict") else r for r in table]
    if rows and isinstance(rows[0], dict):
        names = list(dict.fromkeys(k for r in rows for k in r))
        rows = [tuple(r.get(n) for n in names) for r in rows]
        return Frame(spark.createDataFrame(rows, schema or names))
    return Frame(spark.createDataFrame(rows, schema))


def schema_of(frame: Frame) -> list[tuple[str, str]]:
    return frame.df.dtypes


def columns_of(frame: Frame):
    """All columns as one Arrow table on the driver: for results, not for tables."""
    return frame.df.toArrow()


def rows_of(frame: Frame):
    """Rows as dicts, one partition at a time."""
    return (r.asDict() for r in frame.eachrow())


def as_array(frame: Frame, name: str = "row", cols=None) -> Frame:
    """The columns as one list column, promoted to their common type: the distributed form of ``to_matrix``."""
    from tessera.selectors import resolve

    names = resolve(frame.columns, cols)
    return Frame(frame.df.withColumn(name, F.array(*names)))


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> Frame:
    r = spark.read.format(fmt).options(**options)
    return Frame((r.schema(schema) if schema else r).load(path))


def write(frame: Frame, path: str, fmt: str = "parquet", formatted: bool = False, mode: str = "error", partition_by=(), **options) -> None:
    df = frame.df.select(*[frame.key(c, formatted).alias(c) for c in frame.columns])
    w = df.write.format(fmt).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def text_rows(frame: Frame, delim=",", quote='"', formatted=False) -> DataFrame:
    """One text column: the row's values, null as nothing, booleans as 1 and 0, quoted where needed."""

    def cell(c):
        s = _text(frame.key(c, formatted))
        special = s.contains(delim) | s.contains(quote) | s.contains("\n") | s.contains("\r")
        return F.coalesce(F.when(special, F.concat(F.lit(quote), F.replace(s, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(s), F.lit(""))

    return frame.df.select(F.concat_ws(delim, *[cell(c) for c in frame.columns]).alias("line"))


def to_matrix(frame: Frame) -> np.ndarray:
    """All values on the driver: for results, not for tables."""
    return frame.df.toPandas().to_numpy()


def show(frame: Frame, n: int = 20, mime: str = "text") -> str:
    """The first n rows with formats applied, as text, html, latex, csv or tsv."""
    pdf = frame.df.select(*[frame.key(c).alias(c) for c in frame.columns]).limit(n).toPandas()
    return {"text": pdf.to_string, "html": pdf.to_html, "csv": lambda: pdf.to_csv(index=False), "tsv": lambda: pdf.to_csv(index=False, sep="\t"), "latex": lambda: _latex(pdf)}[mime]()


def _latex(pdf) -> str:
    """A tabular environment with escaped cells; missing ones are empty."""
    marks = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"} | {c: "\\" + c for c in "&%$#_{}"}
    cell = lambda v: "" if v is None or v != v else "".join(marks.get(c, c) for c in str(v))
    lines = [" & ".join(map(cell, r)) + r" \\" for r in [pdf.columns, *pdf.itertuples(index=False, name=None)]]
    return "\n".join([f"\\begin{{tabular}}{{{'l' * len(pdf.columns)}}}", lines[0], r"\hline", *lines[1:], r"\end{tabular}"])


def fixed_width(c, n: int | None = None):
    """Text of a bounded width: cut, trailing blanks dropped, empty is null."""
    s = F.substring(c, 1, n) if n else c
    return F.nullif(F.rtrim(s), F.lit(""))
