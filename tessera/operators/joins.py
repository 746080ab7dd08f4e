"""Joins. Keys that are null match null keys. No data side is broadcast by hint: sizes decide at run time.

``on`` is a name, a list of names, or a list of names and (left, right) pairs.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.nulls import both, isle, isless
from tessera.operators import sets
from tessera.selectors import make_unique

#: Rows of a group of equal as-of keys above which it is dealt into ranges.
HOT = 1 << 20
#: Pairs that a task of a dealt join makes, about; pairs of a key from which it is dealt; such keys, the largest, at most; and its tasks at most.
PAIRS, DEALT, MOST, TASKS = 1 << 22, 1 << 19, 1 << 17, 10_000
#: Right rows of each key up to which a join that isn't full has few pairs for each left row, and its left side isn't counted.
FEW = 64


def keys_of(on) -> list[tuple[str, str]]:
    on = [on] if isinstance(on, str) or (isinstance(on, tuple) and len(on) == 2) else on
    return [(k, k) if isinstance(k, str) else tuple(k) for k in on]


def _prepared(left: DataFrame, right: DataFrame, keys, formats=None):
    """Both sides with names that don't clash; right keys are _k0, _k1, ..."""
    formats = formats or {}
    l_fmt, r_fmt = formats.get("left", {}), formats.get("right", {})
    right_keys = [r for _, r in keys]
    rest = [c for c in right.columns if c not in right_keys]
    new = make_unique(rest, left.columns)
    r = right.select(*[r_fmt.get(k, lambda c: c)(F.col(k)).alias(f"_k{i}") for i, k in enumerate(right_keys)], *[F.col(k).alias(f"_v{i}") for i, k in enumerate(right_keys)], *[F.col(a).alias(b) for a, b in zip(rest, new, strict=True)])
    cond = both(l_fmt.get(a, lambda c: c)(left[a]).eqNullSafe(r[f"_k{i}"]) for i, (a, _) in enumerate(keys))
    helper = [c for c in r.columns if c[:2] in ("_k", "_v")]
    return r, cond, new, helper


def _hot(left: DataFrame, r: DataFrame, ls: list[Column], rs: list[Column], how: str):
    """The keys that both sides share with DEALT pairs or more, as _hot_k0, _hot_k1, ... and their rows on either side, _hot_n and _hot_m; None without any."""
    a, b = left.groupBy(*[c.alias(f"_hot_k{i}") for i, c in enumerate(ls)]).agg(F.count("*").alias("_hot_n")), r.groupBy(*[c.alias(f"_hot_r{i}") for i, c in enumerate(rs)]).agg(F.count("*").alias("_hot_m"))
    kinds = [(a.schema[f"_hot_k{i}"].dataType, b.schema[f"_hot_r{i}"].dataType) for i in range(len(ls))]
    if left.isStreaming or r.isStreaming or any(isinstance(x, T.YearMonthIntervalType) or x != y and not {x.typeName(), y.typeName()} <= {"byte", "short", "integer", "long"} for x, y in kinds):
        return None
    if how != "full" and (b.agg(F.max("_hot_m")).first()[0] or 0) <= FEW:
        return None
    hot = a.join(b, both(a[f"_hot_k{i}"].eqNullSafe(b[f"_hot_r{i}"]) for i in range(len(ls)))).where(F.col("_hot_n") * F.col("_hot_m").cast("decimal(20,0)") >= DEALT)
    got = hot.orderBy(F.desc(F.col("_hot_n") * F.col("_hot_m").cast("double"))).limit(MOST).select(*[f"_hot_k{i}" for i in range(len(ls))], "_hot_n", "_hot_m")
    table = got.toArrow()
    return (table, got.schema) if table.num_rows else None


def _grid(n: int, m: int) -> tuple[int, int]:
    """Pieces of the n left and of the m right rows of a key: each pair of pieces has about PAIRS pairs, and copies are few beside the pairs."""
    side = math.isqrt(PAIRS)
    x, y = (PAIRS // m, m) if m <= side else (n, PAIRS // n) if n <= side else (side, side)
    return -(-n // max(1, x)), -(-m // max(1, y))


def _meet(left: DataFrame, r: DataFrame, ls: list[Column], rs: list[Column], cond: Column, how: str, cols: list, more: Column | None = None) -> DataFrame:
    """``cols`` of left joined with r on equal keys ls and rs (``cond`` says the same), and on ``more`` if how is inner.

    The tasks follow the pairs, not the bytes that are read: keys of many pairs (``_hot``) are cut into a grid of pieces of both sides, whose
    pairs of pieces are dealt out over as many tasks as the pairs need. Such keys are on both sides, so no row of theirs is without
    a match; other keys are joined as they are. The hot keys are counted when the join is called.
    """
    full = cond if more is None else cond & more
    found = _hot(left, r, ls, rs, how) if more is None or how == "inner" else None
    if not found:
        return left.join(r, full, how).select(*cols)
    table, schema = found
    ns, ms = table["_hot_n"].to_pylist(), table["_hot_m"].to_pylist()
    cuts = [_grid(n, m) for n, m in zip(ns, ms, strict=True)]
    firsts = list(accumulate((a * b for a, b in cuts), initial=0))[:-1]
    for name, values in (("_hot_first", firsts), ("_hot_a", [a for a, _ in cuts]), ("_hot_b", [b for _, b in cuts])):
        table, schema = table.append_column(name, [values]), T.StructType(schema.fields + [T.StructField(name, T.LongType())])
    tasks = min(TASKS, -(-sum(n * m for n, m in zip(ns, ms, strict=True)) // PAIRS))
    spark = left.sparkSession
    known = [F.broadcast(spark.createDataFrame(table, schema)) for _ in range(2)]  # MOST rows at most; each side has its own
    same = [both(c.eqNullSafe(k[f"_hot_k{i}"]) for i, c in enumerate(side)) for side, k in zip((ls, rs), known, strict=True)]
    cold = left.join(known[0], same[0], "left_anti").join(r.join(known[1], same[1], "left_anti"), full, how).select(*cols)
    piece = lambda n: F.pmod(F.xxhash64("_hot_id"), F.col(n))
    lp = left.withColumn("_hot_id", F.monotonically_increasing_id()).join(known[0], same[0]).withColumn("_hot_at", F.col("_hot_first") + piece("_hot_a") * F.col("_hot_b"))
    rp = r.withColumn("_hot_id", F.monotonically_increasing_id()).join(known[1], same[1]).withColumn("_hot_at", F.col("_hot_first") + piece("_hot_b"))
    lp = lp.select(*[left[c] for c in left.columns], F.explode(F.sequence("_hot_at", F.col("_hot_at") + F.col("_hot_b") - 1)).alias("_hot_l"))
    rp = rp.select(*[r[c] for c in r.columns], F.explode(F.sequence("_hot_at", F.col("_hot_at") + (F.col("_hot_a") - 1) * F.col("_hot_b"), F.col("_hot_b"))).alias("_hot_r"))
    met = F.col("_hot_l") == F.col("_hot_r")
    hot = lp.repartition(tasks, "_hot_l").join(rp.repartition(tasks, "_hot_r"), met if more is None else met & more, "inner").select(*cols)
    return cold.union(hot)


def left_join(left, right, on, formats=None) -> DataFrame:
    return _equi(left, right, on, formats, "left")


def left_join_matches(left, right, on, left_id: str, name="multiple_match", formats=None) -> DataFrame:
    """with_multiple_match of left_join, counted on the left before it is joined: the joined rows are not exchanged by their id."""
    ls, rs = _sided(keys_of(on), formats)
    met = right.groupBy(*[c.alias(f"_met{i}") for i, c in enumerate(rs)]).agg(F.count("*").alias("_times"))
    times = F.sum(F.coalesce("_times", F.lit(1))).over(W.partitionBy(left_id))
    flagged = left.join(met, both(c.eqNullSafe(F.col(f"_met{i}")) for i, c in enumerate(ls)), "left").select(*[left[c] for c in left.columns], (times > 1).alias(name))
    out = left_join(flagged, right, on, formats)
    return out.select(*[c for c in out.columns if c != name], name)


def _equi(left, right, on, formats, how) -> DataFrame:
    keys = keys_of(on)
    r, cond, new, _ = _prepared(left, right, keys, formats)
    return _meet(left, r, _sided(keys, formats)[0], [r[f"_k{i}"] for i in range(len(keys))], cond, how, [*[left[c] for c in left.columns], *new])


def _sided(keys, formats=None):
    """Makers of the key columns that joins see: (left's i-th, right's i-th) with formats."""
    l_fmt, r_fmt = (formats or {}).get("left", {}), (formats or {}).get("right", {})
    same = lambda c: c
    return [l_fmt.get(a, same)(F.col(a)) for a, _ in keys], [r_fmt.get(b, same)(F.col(b)) for _, b in keys]


def left_join_unique(left, right, on, formats=None) -> DataFrame:
    """As left_join, but more than one match of a left row raises at run time."""
    keys = keys_of(on)
    ls, rs = _sided(keys, formats)
    asked = left.select(*[c.alias(f"_u{i}") for i, c in enumerate(ls)]).distinct()
    used = right.join(asked, both(c.eqNullSafe(F.col(f"_u{i}")) for i, c in enumerate(rs)), "left_semi")
    w = W.partitionBy(*rs)
    one = used.withColumn("_n", F.count("*").over(w))
    one = one.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("a left row has several matches")).cast("long")).otherwise(F.col("_n"))).where("_n >= 0").drop("_n")
    r, cond, new, _ = _prepared(left, one, keys, formats)
    return left.join(r, cond, "left").select(*[left[c] for c in left.columns], *new)


def inner_join(left, right, on, formats=None) -> DataFrame:
    return _equi(left, right, on, formats, "inner")


def outer_join(left, right, on, source: str | None = None, formats=None) -> DataFrame:
    """Full outer with keys coalesced; ``source`` names a column that says left, right or both."""
    keys = keys_of(on)
    r, cond, new, _ = _prepared(left.withColumn("_in_l", F.lit(True)), right.withColumn("_in_r", F.lit(True)), keys, formats)
    tagged, l_fmt = left.withColumn("_in_l", F.lit(True)), (formats or {}).get("left", {})
    cond = both(l_fmt.get(a, lambda c: c)(tagged[a]).eqNullSafe(r[f"_k{i}"]) for i, (a, _) in enumerate(keys))
    place = {a: i for i, (a, _) in enumerate(keys)}
    cols = [F.when(F.col("_in_l"), tagged[c]).otherwise(F.col(f"_v{place[c]}")).alias(c) if c in place else tagged[c] for c in left.columns]
    src = F.when(F.col("_in_l") & F.col("_in_r"), "both").when(F.col("_in_l"), "left").otherwise("right")
    cols = [*cols, *[c for c in new if c != "_in_r"], *([src.alias(source)] if source else [])]
    return _meet(tagged, r, _sided(keys, formats)[0], [r[f"_k{i}"] for i in range(len(keys))], cond, "full", cols)


def range_condition(x, start, end, strict=(False, False)):
    """start <= x <= end, a bound left out being open; a null end of a two-sided range is +infinity."""
    conds = []
    if start is not None:
        conds.append(isless(start, x) if strict[0] else isle(start, x))
    if end is not None:
        conds.append(isless(x, end) if strict[1] else isle(x, end))
    return both(conds)


LEVEL = 32


def _axis(df: DataFrame, c: str) -> Column:
    """A numeric or time column as a number that keeps its order."""
    kind = df.schema[c].dataType.typeName()
    if kind in ("string", "binary", "boolean", "array", "struct", "map"):
        raise ValueError(f"ranges over {kind} need equal keys")
    return (F.col(c).cast("timestamp") if kind in ("timestamp_ntz", "date") else F.col(c)).cast("double")


def _binned(left: DataFrame, right: DataFrame, key: str, start: str | None, end: str | None, width: float | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with _lvl and _bin, on which pairs whose ranges may hold meet once: no cross join.

    The axis is cut into bins of several levels, each LEVEL times as wide as the one before; an interval goes to the bins it touches on
    the first level where these are few (LEVEL + 1 at most), a point to one bin of each level that any interval is on. An open
    end is the other side's extreme. The first width is the median length of the intervals unless given.
    """
    x = _axis(left, key)
    ends = left.agg(F.min(x), F.max(x)).first()
    low, high = (F.lit(v).cast("double") for v in ends)
    s = F.greatest(low, _axis(right, start)) if start else low
    e = F.least(high, F.coalesce(_axis(right, end), high)) if end else high
    rs = right.withColumn("_s", s if not start else F.when(F.col(start).isNotNull(), s)).withColumn("_e", e).where("_s <= _e")
    size = F.col("_e") - F.col("_s")
    if width is None:
        width = rs.agg(F.percentile_approx(size, 0.5)).first()[0] or 0.0
        width = max(float(width), ((ends[1] or 0.0) - (ends[0] or 0.0)) / 2**20) or 1.0
    level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(size / width, F.lit(1.0))) / math.log(LEVEL)) - 1).cast("int")
    rs = rs.withColumn("_lvl", level)
    levels = sorted(r["_lvl"] for r in rs.select("_lvl").distinct().collect())  # a handful: one for each power of LEVEL
    step = F.lit(float(width)) * F.pow(F.lit(float(LEVEL)), F.col("_lvl"))
    place = lambda c: F.floor(c / step).cast("long")
    rb = rs.withColumn("_bin", F.explode(F.sequence(place(F.col("_s")), place(F.col("_e"))))).drop("_s", "_e")
    lb = left.withColumn("_lvl", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("_bin", place(x))
    return lb, rb


def range_join(left, right, equal, key: str, start: str | None, end: str | None, strict=(False, False), how="inner", bin_width=None, formats=None, droprangecols=True) -> DataFrame:
    """Rows whose ``key`` lies in the right row's range, within equal keys. how: inner, left, left_semi or left_anti.

    Without equal keys the axis is cut into bins (``_binned``), so nothing is a cross join. A null end is open; of two-sided
    ranges, a null key or start matches nothing. ``droprangecols=False`` keeps the right side's start and end.
    """
    keys = keys_of(equal) if equal else []
    if how in ("left_semi", "left_anti"):
        flags = _range_flags(left, right, keys, key, start, end, strict, "_hit", bin_width, formats)
        return flags.where("_hit" if how == "left_semi" else "not _hit").drop("_hit")
    drop = [c for c in (start, end) if c] if droprangecols else []
    if keys:
        lb, rb, on = left, right, keys
    else:
        lb, rb = _binned(left, right, key, start, end, bin_width)
        on = [("_lvl", "_lvl"), ("_bin", "_bin")]
    r, cond, new, _ = _prepared(lb, rb, on, formats)
    rest = [c for c in rb.columns if c not in [b for _, b in on]]
    named = dict(zip(rest, new, strict=True))
    inside = range_condition(lb[key], r[named[start]] if start else None, r[named[end]] if end else None, strict)
    cols = [*[lb[c] for c in left.columns], *[F.col(named[c]) for c in rest if c not in drop]]
    hit = _meet(lb, r, _sided(on, formats)[0], [r[f"_k{i}"] for i in range(len(on))], cond, how if keys else "inner", cols, inside)
    if how == "left" and not keys:
        alone = range_join(left, right, None, key, start, end, strict, "left_anti", bin_width)
        hit = hit.unionByName(alone, allowMissingColumns=True)
    return hit


def _range_flags(left, right, keys, key, start, end, strict, name, bin_width=None, formats=None) -> DataFrame:
    """left plus whether any right row's range holds its key. One-sided ranges need the extreme bound of their equal keys only."""
    ls, rs = _sided(keys, formats)
    probe = [c.alias(f"_q{i}") for i, c in enumerate(ls)]
    asked = left.select(*probe, F.col(key).alias("_x")).distinct()
    if start is not None and end is not None:
        r = right.select(*[c.alias(f"_q{i}") for i, c in enumerate(rs)], F.col(start).alias("_from"), F.col(end).alias("_to"))
        met = range_join(asked, r, [f"_q{i}" for i in range(len(keys))], "_x", "_from", "_to", strict, "inner", bin_width).select(*asked.columns).distinct()
    else:
        bound = F.min(start) if start is not None else F.when(F.max(F.col(end).isNull()), None).otherwise(F.max(end))
        best = right.groupBy(*[c.alias(f"_r{i}") for i, c in enumerate(rs)]).agg(bound.alias("_best"), F.lit(True).alias("_any"))
        if keys:
            met = asked.join(best, both(asked[f"_q{i}"].eqNullSafe(best[f"_r{i}"]) for i in range(len(keys))))
            edge = F.col("_best")
        else:
            row = right.agg(bound.cast("string").alias("b"), F.count("*").alias("n")).first()
            met, edge = asked.where(F.lit(row["n"] > 0)), F.lit(row["b"]).cast(right.schema[start or end].dataType)
        met = met.where(range_condition(F.col("_x"), edge if start is not None else None, edge if end is not None else None, strict)).select(*asked.columns)
    met = met.toDF(*[f"_m{i}" for i in range(len(keys))], "_mx").withColumn(name, F.lit(True))
    cond = both([*[c.eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate(ls)], F.col(key).eqNullSafe(F.col("_mx"))])
    return left.join(met, cond, "left").select(*[left[c] for c in left.columns], F.coalesce(name, F.lit(False)).alias(name))


def semi_join(left, right, on, formats=None) -> DataFrame:
    r, cond, _, _ = _prepared(left, right, keys_of(on), formats)
    return left.join(r, cond, "left_semi")


def anti_join(left, right, on, formats=None) -> DataFrame:
    r, cond, _, _ = _prepared(left, right, keys_of(on), formats)
    return left.join(r, cond, "left_anti")


def contains(left, right, on, name="contains", strict=(False, False), formats=None) -> DataFrame:
    """left plus whether its key occurs on the right. The last of ``on`` may be (key, (start, end)): a range, either end may be None."""
    keys = keys_of(on)
    if isinstance(keys[-1][1], tuple):
        key, (start, end) = keys[-1]
        return _range_flags(left, right, keys[:-1], key, start, end, strict, name, None, formats)
    ls, rs = _sided(keys, formats)
    flags = right.select(*[c.alias(f"_c{i}") for i, c in enumerate(rs)]).distinct().withColumn(name, F.lit(True))
    out = left.join(flags, both(c.eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(ls)), "left")
    return out.select(*left.columns, F.coalesce(name, F.lit(False)).alias(name))


def with_multiple_match(joined: DataFrame, left_id: str, name="multiple_match") -> DataFrame:
    """Whether a left row (by its id) came out more than once."""
    return joined.withColumn(name, F.count("*").over(W.partitionBy(left_id)) > 1)


def update(main, trans, on, order, mode=None, op=None, allowmissing=False, formats=None) -> DataFrame:
    """Common columns of main overwritten by the last transaction of their key.

    mode: "missings" (default; "all" with op), or a predicate on the old value. op(old, new) combines.
    """
    keys = keys_of(on)
    mode = mode or ("all" if op else "missings")
    test = {"missings": lambda c: c.isNull(), "all": lambda c: F.lit(True)}.get(mode, mode) if isinstance(mode, str) else mode
    common = [c for c in main.columns if c in trans.columns and c not in [a for a, _ in keys]]
    order = [order] if isinstance(order, str) else order
    ls, rs = _sided(keys, formats)
    last = trans.groupBy(*[c.alias(f"_t{i}") for i, c in enumerate(rs)]).agg(F.max_by(F.struct(*common), F.struct(*order)).alias("_new"), F.lit(True).alias("_hit"))
    out = main.join(last, both(c.eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate(ls)), "left")
    cols = []
    for c in main.columns:
        if c not in common:
            cols.append(main[c])
            continue
        old, new = main[c], F.col(f"_new.{c}")
        can = F.coalesce(F.col("_hit"), F.lit(False)) & F.coalesce(test(old), F.lit(False)) & (F.lit(allowmissing) | new.isNotNull())
        cols.append(F.when(can, op(old, new) if op else new).otherwise(old).alias(c))
    return out.select(*cols)


def compare(left, right, on, cols, eq=None, formats=None, on_formats=None, obs_ids=None) -> DataFrame:
    """Columns side by side on keys: "a=>b" is eq(a, b), null if a side has no row.

    formats are applied to the compared columns, on_formats to the keys; obs_ids=(left id, right id) adds obs_id_left and obs_id_right.
    """
    keys = keys_of(on)
    eq = eq or (lambda a, b: a.eqNullSafe(b))
    pairs = [(c, c) if isinstance(c, str) else c for c in cols]
    (lk, rk), (lv, rv) = _sided(keys, on_formats), _sided(pairs, formats)
    ids = obs_ids or ()
    side = lambda df, keys, raw, vals, p, ids: df.select(*[c.alias(f"_{p[0]}{i}") for i, c in enumerate(keys)], *[F.col(c).alias(f"_{p[1]}{i}") for i, c in enumerate(raw)], *[c.alias(f"_{p[2]}{i}") for i, c in enumerate(vals)], *[F.col(c).alias(f"_{p[3]}") for c in ids], F.lit(True).alias(f"_in_{p[0]}"))
    ls, rs = side(left, lk, [a for a, _ in keys], lv, ("l", "u", "a", "li"), ids[:1]), side(right, rk, [b for _, b in keys], rv, ("r", "w", "b", "ri"), ids[1:])
    cond = both(ls[f"_l{i}"].eqNullSafe(rs[f"_r{i}"]) for i in range(len(keys)))
    there = F.col("_in_l") & F.col("_in_r")
    key = [F.when(F.col("_in_l"), F.col(f"_u{i}")).otherwise(F.col(f"_w{i}")).alias(a) for i, (a, _) in enumerate(keys)]
    seen = [F.col("_li").alias("obs_id_left"), F.col("_ri").alias("obs_id_right")] if ids else []
    cols = [*key, *seen, *[F.when(there, eq(F.col(f"_a{i}"), F.col(f"_b{i}"))).alias(f"{a}=>{b}") for i, (a, b) in enumerate(pairs)]]
    return _meet(ls, rs, [ls[f"_l{i}"] for i in range(len(keys))], [rs[f"_r{i}"] for i in range(len(keys))], cond, "full", cols)


def compare_rows(left, right, order_left, order_right, cols, eq=None, formats=None) -> DataFrame:
    """As compare, with rows paired by their place in the stated orders; obs_id is that place."""
    a, b = sets.row_ids(left, order_left, "obs_id"), sets.row_ids(right, order_right, "obs_id")
    return compare(a, b, "obs_id", cols, eq, formats)


def _largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group: a count by key, added up before it is exchanged."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def close_join(left, right, equal, key, order_left, order_right, direction="backward", border="missing", tol=None, allow_exact_match=True, right_key=None, op=None) -> DataFrame:
    """As-of join: each left row takes one right row, the nearest by ``key`` within equal keys.

    One union and one window pass for each direction that is needed; no pair is enumerated. Ties on the right: the last
    for backward, the first for forward. Without equal keys, or where one group of them has more than HOT rows, the rows are dealt
    into ranges of (equal keys, ``key``), and right rows are carried over the borders inside a group; rows of one and the same
    (equal keys, ``key``) stay together. nearest takes the upper one at equal distance. border: missing, nearest (the edge
    row) or none (nothing outside the right side's range). tol is strict; a candidate that is equal while
    ``allow_exact_match`` is false gives null.
    """
    keys, rk = keys_of(equal) if equal else [], right_key or key
    rest = [c for c in right.columns if c not in [b for _, b in keys] and c != rk]
    names = dict(zip(rest, make_unique(rest, left.columns), strict=True))
    body = F.struct(F.col("_k"), *[F.col(f"_p_{c}") for c in rest])
    ls = left.withColumn("_k", F.col(key)).withColumn("_side", F.lit(0))
    for i, (a, _) in enumerate(keys):
        ls = ls.withColumn(f"_e{i}", F.col(a))
    rs = right.select(*[F.col(b).alias(f"_e{i}") for i, (_, b) in enumerate(keys)], F.col(rk).alias("_k"), F.lit(1).alias("_side"), *[F.col(c).alias(f"_p_{c}") for c in rest], *[F.col(c).alias(f"_s{i}") for i, c in enumerate(order_right)])
    both_ = ls.unionByName(rs, allowMissingColumns=True).withColumn("_st", F.when(F.col("_side") == 1, body))
    es = [f"_e{i}" for i in range(len(keys))]
    ranged = not keys or _largest(both_, es) > HOT
    if ranged:
        both_ = sets.bucketed(both_, [*es, "_k"], "_range")
    part = W.partitionBy(*(["_range"] if ranged else []), *es)
    seconds = [f"_s{i}" for i in range(len(order_right))]
    ties = [F.col(c).asc_nulls_last() for c in seconds]
    back = F.last("_st", True).over(part.orderBy(F.col("_k").asc_nulls_last(), F.col("_side").desc(), *ties).rowsBetween(W.unboundedPreceding, 0))
    fwd = F.first("_st", True).over(part.orderBy(F.col("_k").asc_nulls_last(), F.col("_side").asc(), *ties).rowsBetween(0, W.unboundedFollowing))
    if ranged:  # groups that lie in several ranges: two rows at most for each range, so their broadcast is bounded
        first = F.when(F.col("_side") == 1, F.struct(F.col("_k").isNull(), "_k", *[F.col(c) for c in seconds]))
        edges = both_.groupBy("_range", *es).agg(F.max_by("_st", first).alias("_top"), F.min_by("_st", first).alias("_bottom"))
        group, seq = W.partitionBy(*es), W.partitionBy(*es).orderBy("_range")
        edges = edges.select(F.col("_range").alias("_range2"), *[F.col(e).alias(f"{e}2") for e in es], F.last("_top", True).over(seq.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.first("_bottom", True).over(seq.rowsBetween(1, W.unboundedFollowing)).alias("_after"), F.count("*").over(group).alias("_ranges")).where("_ranges > 1")
        same = both([F.col("_range") == F.col("_range2"), *[F.col(e).eqNullSafe(F.col(f"{e}2")) for e in es]])
        both_ = both_.join(F.broadcast(edges), same, "left")
        back, fwd = F.coalesce(back, "_before"), F.coalesce(fwd, "_after")
    need_f = direction != "backward" or border != "missing"
    need_b = direction != "forward" or border != "missing"
    out = both_.withColumn("_P", back if need_b else F.lit(None)).withColumn("_N", fwd if need_f else F.lit(None)).where("_side = 0")
    p, n = F.col("_P"), F.col("_N")
    k = F.col("_k")
    if direction == "nearest":
        dist = lambda s: F.abs(s["_k"].cast("double") - k.cast("double"))
        got = F.when(p.isNull(), n).when(n.isNull(), p).when(p["_k"].eqNullSafe(k), p).when(isless(dist(p), dist(n)), p).otherwise(n)
        if border == "none":
            got = F.when(p.isNotNull() & n.isNotNull(), got)
    else:
        a, b = (p, n) if direction == "backward" else (n, p)
        if border == "missing":
            got = a
        elif border == "nearest":
            got = F.coalesce(a, b)
        else:
            got = F.when(p.isNotNull() & n.isNotNull(), F.when(b["_k"].eqNullSafe(k), b).otherwise(a))
    out = out.withColumn("_got", got)
    if tol is not None:
        out = out.withColumn("_got", F.when(F.abs(F.col("_got._k").cast("double") - k.cast("double")) < tol, F.col("_got")))
    if not allow_exact_match:
        out = out.withColumn("_got", F.when(~F.col("_got._k").eqNullSafe(k), F.col("_got")))
    cols = [F.col(f"_got._p_{c}").alias(names[c]) for c in rest]
    if op:
        cols = [F.when(p.isNotNull() & n.isNotNull(), op(p[f"_p_{c}"], n[f"_p_{c}"])).alias(names[c]) for c in rest]
    return out.select(*left.columns, *cols)


def with_obs_ids(left: DataFrame, right: DataFrame, on, left_id: str, right_id: str, how: str = "left", name: str = "obs_id") -> DataFrame:
    """A join that keeps the row ids of both sides as <name>_left and <name>_right. how: left, inner, outer or close (on: arguments of close_join)."""
    ls, rs = left.withColumnRenamed(left_id, f"{name}_left"), right.withColumnRenamed(right_id, f"{name}_right")
    if how == "close":
        place = lambda order, old, new: [new if c == old else c for c in order]
        return close_join(ls, rs, **on | {"order_left": place(on["order_left"], left_id, f"{name}_left"), "order_right": place(on["order_right"], right_id, f"{name}_right")})
    return {"left": left_join, "inner": inner_join, "outer": outer_join}[how](ls, rs, on)


def exploding(left: DataFrame, right: DataFrame, on, times: int = 10) -> bool:
    """Whether a join would give more than ``times`` rows for each left row: one aggregation of keys a side."""
    keys = keys_of(on)
    a = left.groupBy(*[F.col(x).alias(f"k{i}") for i, (x, _) in enumerate(keys)]).agg(F.count("*").alias("n"))
    b = right.groupBy(*[F.col(y).alias(f"r{i}") for i, (_, y) in enumerate(keys)]).agg(F.count("*").alias("m"))
    got = a.join(b, both(a[f"k{i}"].eqNullSafe(b[f"r{i}"]) for i in range(len(keys)))).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    return got > times * max(1, left.count())
