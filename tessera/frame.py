"""Frame: a DataFrame with column formats, a row order and a grouping.

A format is a Column function that sorting, grouping, joins and masks see instead of the stored value.
Grouping by a formatted column gives the actual value of the group's first row in the order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import aggs, windows
from tessera.functions.nulls import both, either, matches, sort_key, truth
from tessera.operators import sets
from tessera.selectors import Not, make_unique, resolve


@dataclass(frozen=True)
class ByRow:
    """A row function over columns that are already made: f(list of names) -> Column."""

    f: Callable
    name: str = "row"


def byrow(f, name=None) -> ByRow:
    return ByRow(f, name or getattr(f, "__name__", "function").removeprefix("row_"))


def fname(f) -> str:
    n = getattr(f, "__name__", "function").rstrip("_")
    return "function" if n == "<lambda>" else n


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    formats: dict = field(default_factory=dict)
    order: tuple = ()
    group: tuple = ()
    kind: str = ""
    info: str = ""
    rev: tuple = ()

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    names = columns

    @property
    def ncol(self) -> int:
        return len(self.columns)

    @property
    def nrow(self) -> int:
        return self.df.count()

    @property
    def size(self) -> tuple[int, int]:
        return self.nrow, self.ncol

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def similar(self, n: int | None = None) -> Frame:
        """As many rows of nulls with the same columns; n = 0: ``empty``."""
        n = self.nrow if n is None else n
        return self._new(self.df.sparkSession.range(n).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.df.schema]))

    def empty(self) -> Frame:
        return self._new(self.df.limit(0))

    def copy(self) -> Frame:
        return replace(self)

    # iteration: rows come to the driver one partition at a time
    def eachrow(self):
        return self.df.orderBy(*self.order).toLocalIterator() if self.order else self.df.toLocalIterator()

    def eachcol(self):
        return [F.col(c) for c in self.columns]

    def pairs(self):
        return [(c, F.col(c)) for c in self.columns]

    def find_column(self, test) -> str | None:
        """Name of the first column whose (name, type) the test holds for."""
        return next((c for c, t in self.df.dtypes if test(c, t)), None)

    def eachgroup(self):
        """(key values, Frame of the group) for each group: one query a group, so for few groups; ``apply_groups`` is the distributed form."""
        keys = [self.key(g, not self.kind.endswith("raw")) for g in self.group]
        for r in self.df.select(*[k.alias(f"_g{i}") for i, k in enumerate(keys)]).distinct().orderBy(*[sort_key(f"_g{i}") for i in range(len(keys))]).toLocalIterator():
            yield tuple(r), replace(self, df=self.df.where(both(k.eqNullSafe(F.lit(v)) for k, v in zip(keys, r, strict=True))), group=(), kind="")

    def stat(self, f, *cols):
        """One value: an aggregate of columns."""
        return self.df.agg(f(*[self._arg(c, f) for c in cols])).first()[0]

    def _arg(self, c: str, f):
        """A column for f: booleans count as 1 and 0 in functions of numbers."""
        return F.col(c).cast("int") if f in aggs.NUMERIC and self.df.schema[c].dataType.typeName() == "boolean" else c

    def _new(self, df: DataFrame, **kw) -> Frame:
        return replace(self, df=df, formats={c: f for c, f in self.formats.items() if c in df.columns}, **kw)

    def key(self, c: str, mapformats: bool = True) -> Column:
        return self.formats[c](F.col(c)) if mapformats and c in self.formats else F.col(c)

    def set_format(self, **formats) -> Frame:
        return replace(self, formats=self.formats | formats)

    def remove_format(self, *cols) -> Frame:
        return replace(self, formats={c: f for c, f in self.formats.items() if c not in cols})

    def with_order(self, *cols) -> Frame:
        return replace(self, order=cols)

    def set_info(self, text: str) -> Frame:
        return replace(self, info=text)

    def content(self) -> list[tuple[str, str, str]]:
        """(column, type, format) of each column."""
        return [(n, t, fname(self.formats[n]) if n in self.formats else "identity") for n, t in self.df.dtypes]

    # projection
    def select(self, *sels) -> Frame:
        plus, minus = [s for s in sels if not isinstance(s, Not)], [s for s in sels if isinstance(s, Not)]
        names = list(dict.fromkeys(c for s in (plus or [None]) for c in resolve(self.columns, s)))
        gone = {c for s in minus for c in resolve(self.columns, s.inner)}
        return self._new(self.df.select(*[c for c in names if c not in gone]))

    def rename(self, mapping=None, makeunique=False) -> Frame:
        if callable(mapping):
            names = [mapping(c) for c in self.columns]
        elif isinstance(mapping, list):
            names = mapping
        else:
            names = [mapping.get(c, c) for c in self.columns]
        names = make_unique(names, allow=makeunique)
        back = dict(zip(self.columns, names, strict=True))
        return replace(self, df=self.df.toDF(*names), formats={back[c]: f for c, f in self.formats.items()})

    def insert_cols(self, pos: int, makeunique=False, **values) -> Frame:
        names = make_unique(list(values), self.columns, makeunique)
        for n, v in zip(names, list(values.values()), strict=True):
            if isinstance(v, (list, tuple)):  # a value for each row, in the stated order
                more = replace(self, df=sets.set_column(self.df, list(self.order), n, list(v)))
                rest = {k: x for k, x in zip(names, values.values(), strict=True) if k != n}
                own = self.columns[: pos - 1] + names + self.columns[pos - 1 :]
                return self._new(more.insert_cols(len(more.columns) + 1, **rest).df.select(*own))
        cols = [(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, values.values(), strict=True)]
        own = [F.col(c) for c in self.columns]
        return self._new(self.df.select(*own[: pos - 1], *cols, *own[pos - 1 :]))

    def map(self, fs, cols=None) -> Frame:
        names = resolve(self.columns, cols)
        fs = fs if isinstance(fs, list) else [fs] * len(names)
        out = self.df.withColumns({c: f(F.col(c)) for c, f in zip(names, fs, strict=True)})
        return replace(self, df=out, formats={c: f for c, f in self.formats.items() if c not in names})

    def map_same_type(self, f, cols=None) -> Frame:
        """As map, but columns whose type would change stay, and formats too."""
        names = resolve(self.columns, cols)
        new = self.df.select(*[f(F.col(c)).alias(c) for c in names]).schema
        ok = [c for c in names if new[c].dataType == self.df.schema[c].dataType]
        return self._new(self.df.withColumns({c: f(F.col(c)) for c in ok}))

    def map_cols(self, fs, cols=None, scalar: bool = True) -> Frame:
        """One row: an aggregate of each column. Not ``scalar``: f(column) -> column, a row for each row."""
        names = resolve(self.columns, cols)
        fs = fs if isinstance(fs, list) else [fs] * len(names)
        if not scalar:
            return Frame(self.df.select(*[f(F.col(c)).alias(c) for c, f in zip(names, fs, strict=True)]))
        return Frame(self.df.agg(*[f(self._arg(c, f)).alias(c) for c, f in zip(names, fs, strict=True)]))

    def broadcast(self, op, other) -> Frame:
        """op(cell, cell) of this table and a value, a list with a value for each column, or a Frame of as many columns whose rows are paired by place."""
        if isinstance(other, Frame):
            a, b = sets.row_ids(self.df, list(self.order), "_row"), sets.row_ids(other.df, list(other.order), "_row2")
            b = b.toDF(*[f"_o{i}" for i in range(other.ncol)], "_row2")
            both_ = a.join(b, F.col("_row") == F.col("_row2"))
            return self._new(both_.select(*[op(F.col(c), F.col(f"_o{i}")).alias(c) for i, c in enumerate(self.columns)]))
        vals = other if isinstance(other, (list, tuple)) else [other] * self.ncol
        return self._new(self.df.select(*[op(F.col(c), v if isinstance(v, Column) else F.lit(v)).alias(c) for c, v in zip(self.columns, vals, strict=True)]))

    def allow_missing(self, cols=None) -> Frame:
        """The same rows; these columns may hold nulls from here on."""
        names = resolve(self.columns, cols)
        return self._new(self.df.withColumns({c: F.when(F.lit(True), F.col(c)) for c in names}))

    def cast(self, kind: str, cols=None, strict: bool = True) -> Frame:
        names = resolve(self.columns, cols)
        return self._new(self.df.withColumns({c: F.col(c).cast(kind) if strict else F.col(c).try_cast(kind) for c in names}))

    def byrow(self, f, cols=None, name: str | None = None) -> Frame:
        """A row function of ``functions.rowops`` as a new column (or columns, where it gives several); booleans count as 1 and 0 in sums and the like."""
        names, base = resolve(self.columns, cols), fname(f).removeprefix("row_")
        number = base in ("sum", "prod", "mean", "var", "std", "cumsum", "cumprod", "stdze")
        flags = [c for c in names if self.df.schema[c].dataType.typeName() == "boolean"] if number else []
        out = f(names) if not flags else f([F.col(c).cast("int") if c in flags else F.col(c) for c in names])
        return self._new(self.df.withColumns(out) if isinstance(out, dict) else self.df.withColumn(name or f"row_{base}", out))

    def disallow_missing(self, cols=None) -> Frame:
        """The same rows; a null in these columns raises when they are read."""
        names = resolve(self.columns, cols)
        return self._new(self.df.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(f"null in {c}")).cast(self.df.schema[c].dataType)) for c in names}))

    def mask(self, by, cols=None, mapformats=True, missings=False) -> Frame:
        names = resolve(self.columns, cols)
        bys = by if isinstance(by, list) else [by] * len(names)
        return Frame(self.df.select(*[truth(matches(p)(self.key(c, mapformats)), missings).alias(c) for c, p in zip(names, bys, strict=True)]))

    # filters
    def _pred(self, cols, by, type_, missings, mapformats) -> Column:
        names = resolve(self.columns, cols)
        if callable(type_):
            return truth(type_(names), missings)
        bys = by if isinstance(by, list) else [by] * len(names)
        ps = [truth(matches(p)(self.key(c, mapformats)), missings) for c, p in zip(names, bys, strict=True)]
        return either(ps) if type_ == "any" else both(ps)

    def filter(self, cols, by=True, type="all", missings=None, mapformats=False) -> Frame:  # noqa: A002
        """Rows that the predicates hold for. A null result is what ``missings`` says; without it, it is an error when the rows are read."""
        pred = self._pred(cols, by, type, missings or None, mapformats)
        if missings is None:
            pred = F.coalesce(pred, F.raise_error(F.lit("a predicate is null: say missings=True or False")).cast("boolean"))
        return self._new(self.df.where(pred))  # a null result drops a row by itself, so false needs no wrapping and reaches the scan

    def delete(self, cols, by=True, type="all", missings=None, mapformats=False) -> Frame:  # noqa: A002
        return self._new(self.df.where(~F.coalesce(self._pred(cols, by, type, missings, mapformats), F.lit(False))))

    def complete_cases(self, cols=None, name="complete") -> Frame:
        return self._new(self.df.withColumn(name, both(F.col(c).isNotNull() for c in resolve(self.columns, cols))))

    def drop_missing(self, cols=None) -> Frame:
        return self._new(self.df.where(both(F.col(c).isNotNull() for c in resolve(self.columns, cols))))

    # order
    def sort(self, cols, rev=False, mapformats=True) -> Frame:
        names = resolve(self.columns, cols)
        revs = rev if isinstance(rev, list) else [rev] * len(names)
        keys = [sort_key(self.key(c, mapformats), r) for c, r in zip(names, revs, strict=True)]
        return self._new(self.df.orderBy(*keys, *self.order))

    def is_sorted(self, cols, rev=False) -> bool:
        """Whether the rows, in the stated order, are sorted by these columns."""
        names = resolve(self.columns, cols)
        rank = F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")) for c in names])
        return sets.is_sorted(self.df, rank, self.order[0], self.order[1:], rev)

    def head(self, n: int) -> Frame:
        return self._new(self.df.orderBy(*self.order).limit(n))

    def tail(self, n: int) -> Frame:
        """The last n rows in the stated order, in that order."""
        last = self.df.orderBy(*[F.col(c).desc() for c in self.order]).limit(n)
        return self._new(last.orderBy(*self.order))

    def unsort(self) -> Frame:
        """Rows back in the stated order."""
        return self._new(self.df.orderBy(*self.order))

    def reverse(self) -> Frame:
        return self._new(self.df.orderBy(*[F.col(c).desc() for c in self.order]))

    def only(self):
        """The single row; an error unless there is exactly one."""
        rows = self.df.limit(2).collect()
        if len(rows) != 1:
            raise ValueError("not exactly one row")
        return rows[0]

    def topk(self, col: str, k: int, rev=False) -> Frame:
        c = F.col(col)
        return self._new(self.df.where(c.isNotNull()).orderBy(c.asc() if rev else c.desc(), *self.order).limit(k))

    def topk_groups(self, col: str, k: int, rev=False) -> Frame:
        """The rows of each group with its k largest (rev: smallest) values, ties by the order; a group of nulls keeps one row."""
        return self._new(sets.top_rows(self.df, list(self.group), col, k, self.order, rev, all_null=True))

    # grouping
    def groupby(self, cols, mapformats=True, rev=False) -> Frame:
        """Groups by sorted keys; ``rev`` (one or one for each) turns their order. On a grouped table whose keys come first, only the rest is new."""
        names = resolve(self.columns, cols)
        revs = tuple(rev) if isinstance(rev, (list, tuple)) else (rev,) * len(names)
        return replace(self, group=tuple(names), kind="sorted" if mapformats else "sorted-raw", rev=revs)

    def then_by(self, cols, rev=False) -> Frame:
        """A finer grouping: the keys so far, then these."""
        more = [c for c in resolve(self.columns, cols) if c not in self.group]
        out = self.groupby([*self.group, *more], not self.kind.endswith("raw"), [*self.rev, *([rev] * len(more))])
        return replace(out, kind=self.kind)

    def arranged(self) -> Frame:
        """Rows by group: sorted keys (null last), or groups in order of first appearance; inside a group by the stated order."""
        keys = [self.key(g, not self.kind.endswith("raw")) for g in self.group]
        if self.kind.startswith("sorted"):
            return self._new(self.df.orderBy(*[sort_key(k, r) for k, r in zip(keys, self.rev, strict=True)], *self.order))
        first = F.min(F.struct(*self.order)).over(W.partitionBy(*keys))
        return self._new(self.df.withColumn("_first", first).orderBy("_first", *self.order).drop("_first"))

    def gatherby(self, cols=None, mapformats=True, isgathered=False, eachrow=False) -> Frame:
        """Groups by hash, in order of first appearance. isgathered: runs of equal keys are groups; eachrow: each row is one (run_id is its place)."""
        if eachrow:
            return self._new(sets.row_ids(self.df, list(self.order), "run_id"), group=("run_id",), kind="hash-raw")
        names = resolve(self.columns, cols)
        if not isgathered:
            return replace(self, group=tuple(names), kind="hash" if mapformats else "hash-raw")
        df = sets.runs(self.df, [self.key(c, mapformats) for c in names], self.order[0], "run_id", self.order[1:])
        return self._new(df, group=("run_id",), kind="hash-raw")

    def ungroup(self) -> Frame:
        return replace(self, group=(), kind="", rev=())

    def combine(self, *specs, dropgroupcols=False, arrange=False) -> Frame:
        """Specs: (cols, f or [f, ...][, name]); cols in a tuple are arguments of one function; f may be byrow(...).

        arrange: the result is sorted by the keys, or by first appearance of the groups.
        """
        raw = self.kind.endswith("raw")
        keys = [self.key(g, not raw) for g in self.group]
        out: list[Column] = []
        later: list[tuple[str, Column]] = []
        made: list[str] = []
        for spec in specs:
            sel, f, name = (*spec, None)[:3]
            if isinstance(f, ByRow):
                names = resolve(made, sel)
                later.append((name or f"row_{f.name}", f.f(names)))
                made.append(name or f"row_{f.name}")
                continue
            for g in f if isinstance(f, list) else [f]:
                if isinstance(sel, tuple):
                    names = [c for s in sel for c in resolve(self.columns, s)]
                    new = name or f"{fname(g)}_{'_'.join(names[:2])}" + "_etc" * (len(names) > 2)
                    out.append(g(*[self._arg(c, g) for c in names]).alias(new))
                    made.append(new)
                else:
                    cols = resolve(self.columns, sel)
                    for c in cols:
                        new = (name if len(cols) == 1 and name else None) or f"{fname(g)}_{c}"
                        out.append(g(self._arg(c, g)).alias(new))
                        made.append(new)
        if set(made) & set(self.group):
            raise ValueError("an output would overwrite a grouping column")
        if not self.group:
            df = self.df.agg(*out)
        else:
            named = [k.alias(f"_g{i}") for i, k in enumerate(keys)]
            fmt = [g in self.formats and not raw for g in self.group]
            if any(fmt) and not self.order:
                raise ValueError("a group by a formatted column shows its first row's value: state an order with with_order")
            first = [F.min_by(F.struct(*self.group), F.struct(*self.order)).alias("_first")] if any(fmt) else []
            seen = [F.min(F.struct(*self.order)).alias("_seen")] if arrange and not self.kind.startswith("sorted") else []
            df = self.df.groupBy(*named).agg(*first, *seen, *out)
            if arrange:
                df = df.orderBy("_seen") if seen else df.orderBy(*[sort_key(f"_g{i}", r) for i, r in enumerate(self.rev)])
            show = [(F.col(f"_first.{g}") if any(fmt) else F.col(f"_g{i}")).alias(g) for i, g in enumerate(self.group)]
            df = df.select(*([] if dropgroupcols else show), *[F.col(f"`{m}`") for m in made if m not in [n for n, _ in later]])
        for n, c in later:
            df = df.withColumn(n, c)
        return Frame(df, {c: f for c, f in self.formats.items() if c in self.group and c in df.columns}, ())

    def combine_rows(self, *specs) -> Frame:
        """Specs (col or cols, f, name) of which one or more f give a list for each group: k-th elements make the k-th row, shorter lists end in null.

        Other results are repeated on each row of their group; byrow(...) specs then see the rows.
        """
        keys = [self.key(g, not self.kind.endswith("raw")).alias(g) for g in self.group]
        plain = [s for s in specs if not isinstance(s[1], ByRow)]
        args = lambda c, f: [self._arg(x, f) for x in (c if isinstance(c, tuple) else (c,))]
        lists = self.df.groupBy(*keys).agg(*[f(*args(c, f)).alias(n) for c, f, n in plain])
        kinds = {f.name: f.dataType.typeName() for f in lists.schema}
        many = [n for _, _, n in plain if kinds[n] == "array"]
        out = lists
        if many:
            out = lists.withColumn("_z", F.explode(F.arrays_zip(*many)))
            out = out.select(*self.group, *[F.col(f"_z.{n}").alias(n) if n in many else F.col(n) for _, _, n in plain])
        for sel, f, n in (s for s in specs if isinstance(s[1], ByRow)):
            out = out.withColumn(n, f.f(resolve(out.columns, sel)))
        return Frame(out)

    def apply_groups(self, f, schema) -> Frame:
        """f(pandas frame of a group) -> pandas frame: for functions that columns can't express. A group is held by one task."""
        return Frame(self.df.groupBy(*self.group).applyInPandas(f, schema))

    def modify(self, *specs, **exprs) -> Frame:
        """New columns, left to right; a callable gets (group, order) and gives a window expression.

        Specs come first: (cols, f) replaces each column by f(name); (cols, f, name) gives it another name, a callable one being
        name(column); (cols, f, [names]) splits the list that f(name) gives into columns. What f gives may again be a callable.
        Without a group, the functions of ``windows`` are worked out in ranges of the order, so no task holds all rows.
        """
        df = self.df
        todo: list[tuple[str, object]] = []
        for sel, f, *rest in specs:
            for c in resolve(self.columns, sel):
                name = rest[0] if rest else c
                if isinstance(name, list):
                    todo += [(n, lambda g, o, f=f, c=c, i=i: F.get(f(c)(g, o) if callable(f(c)) and not isinstance(f(c), Column) else f(c), F.lit(i))) for i, n in enumerate(name)]
                else:
                    todo.append((name(c) if callable(name) else name, f(c)))
        whole, batch = windows.Whole(), []

        def flush(df: DataFrame) -> DataFrame:
            """One pass in ranges for all of a batch."""
            df = sets.carried(df, list(self.order), whole.asked) if whole.asked else df
            for n, made in batch:
                df = df.withColumn(n, made)
            return df.drop(*[x[0] for x in whole.asked])

        for n, e in [*todo, *exprs.items()]:
            if n in self.group:
                raise ValueError("a grouping column can't be modified")
            called = callable(e) and not isinstance(e, Column)
            had = len(whole.asked)
            made = e(self.group or whole, self.order) if called else e
            if any(m in str(x[2]) for x in whole.asked[had:] for m, _ in batch):  # it may read what this batch makes
                del whole.asked[had:]
                df = flush(df)
                whole, batch = windows.Whole(), []
                made = e(whole, self.order)
            batch.append((n, made))
        return self._new(flush(df))

    def sum_all(self, cols=None) -> Frame:
        """Sums of columns, a row for each: (column, sum)."""
        names = resolve(self.columns, cols)
        one = self.df.agg(*[aggs.sum_(self._arg(c, aggs.sum_)).cast("double").alias(c) for c in names])
        return Frame(one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("sum")) for c in names])).alias("x")).select("x.*"))

    def describe(self, cols=None, fns=None) -> Frame:
        """One row for each column: n, nmissing, mean, std, minimum, maximum. A statistic that a column's type doesn't have is null;
        minimum and maximum are text where a column isn't a number."""
        names, fns = resolve(self.columns, cols), fns or [aggs.n, aggs.nmissing, aggs.mean, aggs.std, aggs.minimum, aggs.maximum]
        kinds = {f.name: f.dataType for f in self.df.schema}
        number = {c: isinstance(kinds[c], (T.NumericType, T.BooleanType)) for c in names}
        mixed = not all(number.values())

        def cell(c: str, f) -> Column:
            plain = f in (aggs.n, aggs.nmissing, aggs.length)
            ranked = f in (aggs.minimum, aggs.maximum)
            if not (plain or number[c] or (ranked and isinstance(kinds[c], (T.StringType, T.DatetimeType)))):
                return F.lit(None).cast("string" if ranked and mixed else "double")
            x = f(F.col(c).cast("int") if number[c] and isinstance(kinds[c], T.BooleanType) else c)
            return x.cast("string" if ranked and mixed else "double")

        one = self.df.agg(*[F.struct(*[cell(c, f).alias(fname(f)) for f in fns]).alias(c) for c in names])
        return Frame(one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in names])).alias("x")).select("x.column", "x.s.*"))
