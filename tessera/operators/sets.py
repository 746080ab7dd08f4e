"""Row identity, duplicates, unions, positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.nulls import isless
from tessera.selectors import Not

#: Rows of a bucket at least, and rows of the sample for each bucket.
ROWS, SAMPLED = 100_000, 50


def order_keys(order, desc: bool = False) -> list[tuple[Column, bool]]:
    """(column, descending) of an order: a name or Column, (name or Column, descending), or a list of such. ``desc`` turns all round."""
    items = order if isinstance(order, list) else [order]
    pairs = [x if isinstance(x, tuple) else (x, False) for x in items]
    return [(F.col(c) if isinstance(c, str) else c, bool(d) != desc) for c, d in pairs]


def _bucket(after, cuts: list, first: int = 0) -> Column:
    """How many cuts lie before the row: a balanced tree of comparisons."""
    if not cuts:
        return F.lit(first)
    m = len(cuts) // 2
    return F.when(after(cuts[m]), _bucket(after, cuts[m + 1 :], first + m + 1)).otherwise(_bucket(after, cuts[:m], first))


def bucketed(df: DataFrame, order, name: str = "_b", buckets: int | None = None, desc: bool = False) -> DataFrame:
    """Rows dealt into ranges of an order of columns of any sortable type: all of bucket i come before those of i + 1; null is the largest value.

    The cuts are taken from a sample (SAMPLED rows a bucket), for as many buckets as there are shuffle partitions (64 at least) if
    the table has ROWS for each, so no task gets a share that grows with the table; rows of one and the same key stay together.
    Whole-table operators work inside buckets and then carry over one row for each bucket.
    """
    keys = order_keys(order, desc)
    named = df.select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(keys)])
    total = named.count()
    n = buckets or min(max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), total // ROWS)
    if n <= 1:
        return df.withColumn(name, F.lit(0))
    down = [d for _, d in keys]
    some = named.sample(fraction=min(1.0, SAMPLED * n / max(1, total)), seed=7) if total > SAMPLED * n else named
    some = some.orderBy(*[F.col(c).desc_nulls_first() if d else F.col(c).asc_nulls_last() for c, d in zip(named.columns, down, strict=True)]).limit(4 * SAMPLED * n)
    rows = [tuple(r) for r in some.select(*[F.col(c).cast("string") for c in named.columns]).collect()]
    cuts = list(dict.fromkeys(rows[i * len(rows) // n] for i in range(1, n))) if rows else []

    def after(cut) -> Column:
        """The cut comes before the row."""
        out, same = F.lit(False), F.lit(True)
        for (c, d), text, f in zip(keys, cut, named.schema, strict=True):
            v = F.lit(text).cast(f.dataType)
            out = out | (same & (isless(c, v) if d else isless(v, c)))
            same = same & c.eqNullSafe(v)
        return out

    return df.withColumn(name, _bucket(after, cuts))


def _keys(order, more=(), desc: bool = False) -> list[Column]:
    return [c.desc_nulls_first() if d else c.asc_nulls_last() for c, d in order_keys(order, desc)] + list(more)


def row_ids(df: DataFrame, order, name: str = "row_id", more=(), desc: bool = False) -> DataFrame:
    """1-based positions in an order (see order_keys) without putting all rows into one task.

    A row's id is the rows of the buckets before plus its rank in its own. ``desc`` turns the order round (nulls first).
    """
    df = bucketed(df, order, desc=desc)
    sizes = dict(df.groupBy("_b").count().collect())
    before, total = {}, 0
    for b in sorted(sizes):
        before[b], total = total, total + sizes[b]
    base = F.element_at(F.create_map(*[F.lit(v) for kv in before.items() for v in kv]), F.col("_b")) if before else F.lit(0)
    rank = F.row_number().over(W.partitionBy("_b").orderBy(*_keys(order, more, desc)))
    return df.withColumn(name, (base + rank).cast("long")).drop("_b")


def running(df: DataFrame, col: str, order, how: str = "sum", name: str | None = None, more=()) -> DataFrame:
    """Cumulative sum, min or max over the whole table, in buckets; nulls carry the value before (leading ones stay null)."""
    return carried(df, order, [(name or f"cum{how}_{col}", how, F.col(col), 1, None)], more)


_FOLDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "prod": (F.product, lambda a, b: F.coalesce(a * b, a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def carried(df: DataFrame, order, asked, more=()) -> DataFrame:
    """df plus a column for each (name, how, value, k, default): a function over the whole table in the order, worked out in buckets.

    how: sum, prod, min, max of the values so far; last of them (first of those to come) that is no null; lag or lead by k rows;
    all: an aggregate of the table. Each bucket takes over what those before (behind) it hold: one value, or k for lag and lead.
    Rows that tie in the order and in ``more`` come in any order.
    """
    own = df.columns
    for name, how, value, *_ in asked:
        if how == "all":
            df = df.withColumn(name, df.agg(value).scalar())
    names, asked = own + [x[0] for x in asked], [x for x in asked if x[1] != "all"]
    if not asked:
        return df.select(*names)
    at = W.partitionBy("_b").orderBy(*_keys(order, more))
    upto, rest = at.rowsBetween(W.unboundedPreceding, 0), at.rowsBetween(0, W.unboundedFollowing)
    df = bucketed(df, order).withColumns({f"_x{i}": value for i, (_, _, value, _, _) in enumerate(asked)})
    df = df.withColumns({"_r": F.row_number().over(at), "_n": F.count("*").over(W.partitionBy("_b"))})
    seq = W.orderBy("_b")  # one row for each bucket: its number is bounded by the number of cuts
    before, behind = seq.rowsBetween(W.unboundedPreceding, -1), seq.rowsBetween(1, W.unboundedFollowing)
    ends, carry, out = [], [], []
    r, n = F.col("_r"), F.col("_n")
    for i, (name, how, _, k, default) in enumerate(asked):
        x, e, c = F.col(f"_x{i}"), F.col(f"_e{i}"), F.col(f"_c{i}")
        some = lambda near, x=x: F.transform(F.array_sort(F.collect_list(F.when(near, F.struct("_r", x.alias("x"))))), lambda s: s["x"])
        if how in _FOLDS:
            f, join = _FOLDS[how]
            end, taken, got = f(x), f(e).over(before), join(c, f(x).over(upto))
        elif how == "last":
            end, taken, got = F.max_by(x, F.when(x.isNotNull(), r)), F.last(e, True).over(before), F.coalesce(F.last(x, True).over(upto), c)
        elif how == "first":
            end, taken, got = F.min_by(x, F.when(x.isNotNull(), r)), F.first(e, True).over(behind), F.coalesce(F.first(x, True).over(rest), c)
        elif how == "lag":  # every bucket here has a row, so the k buckets next to one hold the k rows next to it
            end, taken = some(r > n - k), F.flatten(F.collect_list(e).over(seq.rowsBetween(-max(k, 1), -1)))
            got = F.when(r > k, F.lag(x, k).over(at)).when(F.size(c) > k - r, F.try_element_at(c, r - 1 - k)).otherwise(F.lit(default))
        else:
            end, taken = some(r <= k), F.flatten(F.collect_list(e).over(seq.rowsBetween(1, max(k, 1))))
            got = F.when(n - r >= k, F.lead(x, k).over(at)).when(F.size(c) >= k - n + r, F.try_element_at(c, (k - n + r).cast("int"))).otherwise(F.lit(default))
        ends.append(end.alias(f"_e{i}"))
        carry.append(taken.alias(f"_c{i}"))
        out.append(got.alias(name))
    ends = df.groupBy("_b").agg(*ends).select(F.col("_b").alias("_b2"), *carry)
    joined = df.join(ends, F.col("_b") == F.col("_b2"))
    return joined.select(*own, *[F.col(f"`{x}`") for x in names if x not in own and x not in {a[0] for a in asked}], *out).select(*names)


def runs(df: DataFrame, keys: list[Column], order, name: str = "run_id", more=()) -> DataFrame:
    """1-based number of the run of equal keys (null equals null) that a row belongs to, in the order, in buckets."""
    k = F.struct(*[x.alias(f"k{i}") for i, x in enumerate(keys)])
    df = bucketed(df, order).withColumn("_k", k)
    at = W.partitionBy("_b").orderBy(*_keys(order, more))
    df = df.withColumn("_change", F.coalesce((~F.col("_k").eqNullSafe(F.lag("_k").over(at))).cast("long"), F.lit(0)))
    df = df.withColumn("_pos", F.row_number().over(at))
    df = df.withColumn("_change", F.when(F.col("_pos") == 1, 0).otherwise(F.col("_change")))
    ends = df.groupBy("_b").agg(F.sum("_change").alias("_n"), F.min_by("_k", "_pos").alias("_first"), F.max_by("_k", "_pos").alias("_last"))
    seq = W.orderBy("_b")
    new = (~F.col("_first").eqNullSafe(F.lag("_last").over(seq))).cast("long")
    ends = ends.withColumn("_new", F.when(F.row_number().over(seq) == 1, 1).otherwise(new))
    start = F.sum(F.col("_new")).over(seq.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum("_n").over(seq.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(F.col("_b").alias("_b2"), start.alias("_start"))
    own = F.sum("_change").over(at.rowsBetween(W.unboundedPreceding, 0))
    out = df.withColumn("_own", own).join(ends, F.col("_b") == F.col("_b2"))
    return out.select(*[c for c in df.columns if c not in ("_b", "_k", "_change", "_pos")], (F.col("_start") + F.col("_own")).alias(name))


def is_sorted(df: DataFrame, rank: Column, order, more=(), rev: bool = False) -> bool:
    """Whether ``rank`` never falls (rises with ``rev``) along the order: inside buckets, then between one row of each."""
    df = bucketed(df, order).withColumn("_k", rank)
    at = W.partitionBy("_b").orderBy(*_keys(order, more))
    falls = lambda prev, cur: (prev < cur) if rev else (prev > cur)
    df = df.withColumn("_bad", falls(F.lag("_k").over(at), F.col("_k"))).withColumn("_pos", F.row_number().over(at))
    ends = df.groupBy("_b").agg(F.max("_bad").alias("_bad"), F.min_by("_k", "_pos").alias("_first"), F.max_by("_k", "_pos").alias("_last"))
    gap = falls(F.lag("_last").over(W.orderBy("_b")), F.col("_first"))
    return ends.withColumn("_gap", gap).where("_bad or _gap").isEmpty()


def top_rows(df: DataFrame, group: list[str], col: str, k: int, order=(), rev: bool = False, all_null: bool = False) -> DataFrame:
    """Up to k rows with the largest (rev: smallest) non-null values of each group; groups are cut before they are exchanged.

    ``all_null`` keeps one row of a group that has nulls only.
    """
    c = F.col(col)
    rank = F.row_number().over(W.partitionBy(*group).orderBy(c.asc_nulls_last() if rev else c.desc_nulls_last(), *order))
    some = df if all_null else df.where(c.isNotNull())
    return some.withColumn("_n", rank).where(F.col("_n") <= k).where(c.isNotNull() | (F.col("_n") == 1)).drop("_n")


def slice_rows(df: DataFrame, order, first: int, last: int) -> DataFrame:
    """Rows at the 1-based positions first..last of the order."""
    return row_ids(df, order, "_row").where(F.col("_row").between(first, last)).drop("_row")


def set_at(df: DataFrame, order, positions: list[int], **values) -> DataFrame:
    """New values for cells of the rows at the 1-based positions of the order; types stay."""
    hit = F.col("_row").isin(positions)
    new = {c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
    return row_ids(df, order, "_row").withColumns(new).drop("_row")


def pop(df: DataFrame, order, first: bool = False) -> DataFrame:
    """The table without its last (or first) row in the order."""
    ids = row_ids(df, order, "_row", desc=not first)
    return ids.where("_row > 1").drop("_row")


def table_hash(df: DataFrame) -> int:
    """A number that equal multisets of rows share, whatever their order."""
    h = F.xxhash64(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in df.columns]).cast("decimal(38,0)")  # a hash skips nulls: their places count
    return int(df.agg(F.coalesce(F.sum(h) % F.lit(2**62), F.lit(0))).first()[0])


def unique(df: DataFrame, cols: list[str], order: list, keep: str = "first") -> DataFrame:
    """keep: first, last, none (rows without a twin), only (rows with one) or random."""
    p = W.partitionBy(*cols)
    if keep in ("none", "only"):
        n = df.withColumn("_n", F.count("*").over(p))
        return n.where("_n = 1" if keep == "none" else "_n > 1").drop("_n")
    by = {"first": order, "last": [F.col(o).desc() if isinstance(o, str) else o for o in order], "random": [F.rand()]}[keep]
    return df.withColumn("_n", F.row_number().over(p.orderBy(*by))).where("_n = 1").drop("_n")


def duplicates(df: DataFrame, cols: list[str], order: list[str], leave: str = "first", name: str = "duplicate") -> DataFrame:
    """Flag of repeated rows; ``leave`` says which one of a group isn't flagged."""
    p = W.partitionBy(*cols)
    a, b = F.row_number().over(p.orderBy(*order)) > 1, F.row_number().over(p.orderBy(*[F.col(o).desc() for o in order])) > 1
    flag = {"first": a, "last": b, "none": F.count("*").over(p) > 1, "and": a & b, "or": a | b, "xor": a != b, "nand": ~(a & b), "nor": ~(a | b), "random": F.row_number().over(p.orderBy(F.rand())) > 1}[leave]
    return df.withColumn(name, flag)


def vcat(dfs: list[DataFrame], cols="setequal", source: str | None = None) -> DataFrame:
    """Union by name. cols: setequal, orderequal, intersect, union or a list of names."""
    names = [d.columns for d in dfs]
    if cols == "orderequal" and any(n != names[0] for n in names) or cols == "setequal" and any(set(n) != set(names[0]) for n in names):
        raise ValueError("columns differ")
    if cols == "intersect":
        keep = [c for c in names[0] if all(c in n for n in names)]
    elif cols == "union":
        keep = list(dict.fromkeys(c for n in names for c in n))
    else:
        keep = cols if isinstance(cols, list) else names[0]
    parts = [d.select(*[c for c in keep if c in d.columns], *([F.lit(i).alias(source)] if source else [])) for i, d in enumerate(dfs, 1)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*keep, *([source] if source else []))


def hcat(a: DataFrame, b: DataFrame, order_a, order_b) -> DataFrame:
    """Columns side by side by position."""
    from tessera.selectors import make_unique

    new = make_unique(b.columns, a.columns)
    right = row_ids(b, order_b, "_row").toDF(*new, "_row")
    return row_ids(a, order_a, "_row").join(right, "_row").drop("_row")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def _at(positions) -> Column:
    """Whether a row (by _row) is at the positions: numbers from 1, one bool for each row, or Not of either."""
    if isinstance(positions, Not):
        return ~_at(positions.inner)
    if isinstance(positions, range) and positions.step == 1:
        return F.col("_row").between(positions.start, positions.stop - 1)
    if positions and all(isinstance(x, bool) for x in positions):
        positions = [i for i, x in enumerate(positions, 1) if x]
    return F.col("_row").isin(list(positions))


def delete_at(df: DataFrame, order, positions) -> DataFrame:
    """Rows but those at the positions (numbers, bools, a range, or Not of these)."""
    return row_ids(df, order, "_row").where(~_at(positions)).drop("_row")


def take_rows(df: DataFrame, order, positions: list[int], name: str | None = None) -> DataFrame:
    """The rows at these positions, once for each time they are named; ``name`` holds the place in the list."""
    want = df.sparkSession.createDataFrame(list(enumerate(positions, 1)), "_place long, _at long")
    got = row_ids(df, order, "_row").join(want, F.col("_row") == F.col("_at"))
    return got.select(*df.columns, *([F.col("_place").alias(name)] if name else []))


def set_block(df: DataFrame, order, positions, block: DataFrame, block_order) -> DataFrame:
    """Cells of the rows at the positions taken from a block of as many rows, column by column of the same name; types stay."""
    ids = row_ids(df, order, "_row").withColumn("_hit", _at(positions))
    place = row_ids(ids.where("_hit").select("_row"), "_row", "_k")
    new = row_ids(block.select(*[F.col(c).alias(f"_n_{c}") for c in block.columns]), [(f"_n_{c}", d) for c, d in _named(block_order)], "_k2")
    new = place.join(new, F.col("_k") == F.col("_k2"), "left").withColumnRenamed("_row", "_row2").withColumn("_there", F.lit(True))
    out = ids.join(new, F.col("_row") == F.col("_row2"), "left")
    return out.select(*[F.when(F.col("_there"), F.col(f"_n_{f.name}").cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in block.columns else F.col(f.name) for f in df.schema])


def set_column(df: DataFrame, order, name: str, values: list) -> DataFrame:
    """A column, new or replaced, from one value for each row in the order."""
    if df.count() != len(values):
        raise ValueError("as many values as rows are needed")
    got = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values, 1)], ["_at", "_value"])
    out = row_ids(df, order, "_row").join(got, F.col("_row") == F.col("_at"), "left")
    return out.select(*[F.col("_value").alias(name) if c == name else F.col(c) for c in df.columns], *([F.col("_value").alias(name)] * (name not in df.columns)))


def _named(order) -> list[tuple[str, bool]]:
    return [x if isinstance(x, tuple) else (x, False) for x in (order if isinstance(order, list) else [order])]


def append(df: DataFrame, rows: DataFrame, cols="setequal", promote: bool = False) -> DataFrame:
    """Rows added below. cols: setequal, orderequal, intersect (df's other columns go), subset (missing ones become null), union, or a list.

    Types follow df, and a value that doesn't fit raises; with ``promote`` they are the common type of both.
    """
    have, names = dict(rows.dtypes), df.columns
    if cols == "setequal" and set(have) != set(names) or cols == "orderequal" and rows.columns != names:
        raise ValueError("columns differ")
    if isinstance(cols, list) and not set(cols) <= set(names) & set(have):
        raise ValueError("columns differ")
    keep = {"intersect": [c for c in names if c in have], "union": [*names, *(c for c in rows.columns if c not in names)]}.get(cols, names) if isinstance(cols, str) else names
    kinds = dict(df.dtypes)
    cell = lambda own, c: F.col(c) if c in own else F.lit(None)
    typed = lambda c: cell(have, c).cast(kinds[c]) if c in kinds and not promote else cell(have, c)
    return df.select(*[cell(kinds, c).alias(c) for c in keep]).unionByName(rows.select(*[typed(c).alias(c) for c in keep]))


def resize(df: DataFrame, order, n: int) -> DataFrame:
    """The first n rows in the order; rows of nulls make up for what is missing."""
    got = df.orderBy(*_keys(order)).limit(n)
    short = n - got.count()
    if short <= 0:
        return got
    nulls = df.sparkSession.range(short).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in df.schema])
    return got.unionByName(nulls)


def push(df: DataFrame, row, first: str | None = None) -> DataFrame:
    """One row (dict, tuple or list) more. ``first`` names a numeric order column that gets a value below all others: the row comes first."""
    row = row if isinstance(row, dict) else dict(zip(df.columns, row, strict=True))
    if first:
        low = df.agg(F.min(first)).first()[0]
        row = row | {first: 0 if low is None else low - 1}
    one = df.sparkSession.createDataFrame([tuple(row.get(c) for c in df.columns)], df.schema)
    return df.unionByName(one)


def sort_permutation(df: DataFrame, key, row_id: str, name: str = "position", more=(), desc: bool = False) -> DataFrame:
    """Row ids with their positions in an order (see order_keys), ties by ``more`` and the row id."""
    return row_ids(df, key, name, [*more, row_id], desc).select(row_id, name)


def approx_equal(a: DataFrame, b: DataFrame, key: str, cols: list[str], tol: float = 1e-9) -> bool:
    """Whether two tables agree on numeric columns by key."""
    j = a.alias("a").join(b.alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full")
    bad = reduce(lambda x, y: x | y, [~(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) | F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tol, F.lit(False))) for c in cols])
    return j.where(bad).isEmpty()
