"""Literal results and brute force for orders in ranges, binned joins, sources and the rest of the Frame."""

import random
from collections import namedtuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.frame import Frame, byrow
from tessera.functions import aggs as A
from tessera.functions import rowops as R
from tessera.functions import windows as V
from tessera.operators import joins as J
from tessera.operators import reshape as T
from tessera.operators import sets as S
from tessera.selectors import Not
from tessera.sources import io


def rows(df):
    return sorted((tuple(r) for r in (df.df if isinstance(df, Frame) else df).collect()), key=repr)


@pytest.fixture
def small(monkeypatch):
    """Ranges of a few rows, so that borders are crossed."""
    monkeypatch.setattr(S, "ROWS", 5)


def table(spark, n=120, seed=1):
    rng = random.Random(seed)
    data = [(i, rng.choice(["a", "b", "c", None, "dd"]), rng.choice([None, 1.5, 2.0, float("nan"), -3.0]), rng.randrange(9)) for i in range(n)]
    return spark.createDataFrame(data, "i long, s string, x double, k long"), data


def null_last(v):
    return (v is None, v if v is not None and v == v else 0, v is not None and v != v) if not isinstance(v, str) else (False, v, False)


def test_row_ids_by_text_and_several_columns(spark, small):
    df, data = table(spark)
    assert df.transform(lambda d: S.bucketed(d, ["s", "i"])).select("_b").distinct().count() > 4
    got = {r.i: r.n for r in S.row_ids(df, [("s", True), "x", "i"], "n").collect()}
    text = sorted({d[1] for d in data if d[1]}, reverse=True)
    rank = {None: -1} | {t: k for k, t in enumerate(text)}
    num = lambda v: (2, 0) if v is None else (1, 0) if v != v else (0, v)
    want = sorted(data, key=lambda d: (rank[d[1]], num(d[2]), d[0]))
    assert [got[d[0]] for d in want] == list(range(1, len(data) + 1))


def test_ranges_carry_over(spark, small):
    df, data = table(spark)
    want, total = {}, 0
    for d in data:
        total += d[3]
        want[d[0]] = total
    assert {r.i: r.t for r in S.running(df, "k", "i", name="t").collect()} == want
    run, prev, runs = 0, object(), {}
    for d in data:
        run += d[1] != prev
        prev = d[1]
        runs[d[0]] = run
    assert {r.i: r.run_id for r in S.runs(df, [F.col("s")], "i").collect()} == runs
    f = Frame(df).with_order("i")
    assert f.is_sorted("i") and not f.is_sorted("k") and Frame(df).with_order("s", "i").is_sorted("s")
    assert not Frame(df).with_order("i").is_sorted("i", rev=True)


WHOLE = {
    "sum": lambda g, o: V.cumsum("v", group=g, order=o),
    "kept": lambda g, o: V.cumsum("v", missings="skip", group=g, order=o),
    "low": lambda g, o: V.cummin("v", group=g, order=o),
    "high": lambda g, o: V.cummax("v", group=g, order=o) * 2 + V.cumsum("k", group=g, order=o),
    "prod": lambda g, o: V.cumprod(F.lit(1.0) + F.col("v") / 100, group=g, order=o),
    "fill": lambda g, o: V.ffill("s", group=g, order=o),
    "back": lambda g, o: V.bfill("s", group=g, order=o),
    "two": lambda g, o: V.bfill("v", by=lambda x: x.isNull() | (x < 3), group=g, order=o),
    "lag1": lambda g, o: V.lag("v", group=g, order=o),
    "lag9": lambda g, o: V.lag("v", 9, -1, group=g, order=o),
    "lead1": lambda g, o: V.lead("s", group=g, order=o),
    "lead9": lambda g, o: V.lead("v", 9, -1, group=g, order=o),
    "minus": lambda g, o: V.lag("v", -2, group=g, order=o),
    "same": lambda g, o: V.lag("v", 0, group=g, order=o),
    "std": lambda g, o: V.stdze("k", group=g),
    "scale": lambda g, o: V.rescale("k", group=g),
}


@pytest.mark.parametrize("n", [0, 1, 120])
def test_whole_tables_in_ranges(spark, small, n):
    """In ranges as in one window over all rows."""
    df = table(spark, 120)[0].where(F.col("i") < n).withColumn("v", F.when(F.col("i") % 4 != 0, F.col("k")))
    got = Frame(df).with_order("s", "i").modify(**WHOLE).df
    at = [F.col("s").asc_nulls_last(), F.col("i")]
    want = df.select("*", *[f((), at).alias(c) for c, f in WHOLE.items()])
    again = Frame(df).with_order("i").modify(w=lambda g, o: V.cumsum("k", group=g, order=o), z=lambda g, o: V.lag("w", group=g, order=o)).df
    assert [r.z for r in again.orderBy("i").collect()] == [None, *(r.w for r in again.orderBy("i").collect())][:n]
    assert got.columns == want.columns
    flat = lambda d: sorted([tuple(round(x, 6) if isinstance(x, float) and x == x else repr(x) for x in r) for r in d.collect()], key=repr)
    assert flat(got) == flat(want)


def test_as_of_without_equal_keys(spark, small):
    rng = random.Random(3)
    left, right = [(i, rng.randrange(200)) for i in range(80)], [(i, rng.randrange(200)) for i in range(60)]
    a, b = spark.createDataFrame(left, "l long, t long"), spark.createDataFrame(right, "r long, t long")
    get = lambda **k: {r.l: r.r for r in J.close_join(a, b, None, "t", ["l"], ["r"], **k).collect()}
    back = lambda t: max(((u, r) for r, u in right if u <= t), default=(None, None))
    fore = lambda t: min(((u, r) for r, u in right if u >= t), default=(None, None))
    assert get() == {x: back(t)[1] for x, t in left}
    assert get(direction="forward") == {x: fore(t)[1] for x, t in left}

    def nearest(t):
        p, n = back(t), fore(t)
        if p[0] is None or n[0] is None:
            return p[1] if n[0] is None else n[1]
        return p[1] if p[0] == t or t - p[0] < n[0] - t else n[1]

    assert get(direction="nearest") == {x: nearest(t) for x, t in left}


def test_as_of_with_a_hot_group(spark, small, monkeypatch):
    rng = random.Random(9)
    key = lambda: rng.choice(["a", "a", "a", "a", "b", None])
    left, right = ([(i, key(), rng.choice([None, *range(120)]) if i % 9 == 0 else rng.randrange(120)) for i in range(n)] for n in (150, 60))
    right = [(i, g, t) for i, g, t in right if t is not None]
    a, b = spark.createDataFrame(left, "l long, g string, t long"), spark.createDataFrame(right, "r long, g string, t long")
    got = {}
    for hot in (0, 1 << 20):
        monkeypatch.setattr(J, "HOT", hot)
        for k in ({}, {"direction": "forward"}, {"direction": "nearest", "tol": 5}, {"border": "none"}):
            out = J.close_join(a, b, "g", "t", ["l"], ["r"], **k)
            got[hot, str(k)] = sorted((r.l, r.r) for r in out.collect() if r.t is not None)
            assert out.columns == ["l", "g", "t", "r"]
    assert all(v == got[1 << 20, k] for (_, k), v in got.items())
    back = lambda g, t: max(((u, r) for r, h, u in right if h == g and u <= t), default=(None, None))[1]
    assert got[0, "{}"] == sorted((i, back(g, t)) for i, g, t in left if t is not None)


@pytest.mark.parametrize("strict", [(False, False), (True, True)])
def test_ranges_without_equal_keys(spark, strict):
    rng = random.Random(5)
    pts = [(i, rng.choice([None, *range(100)])) for i in range(90)]
    ends = []
    for i in range(60):
        lo = rng.choice([None, *range(-20, 110)])
        ends.append((i, lo, rng.choice([None, (lo or 0) + rng.choice([0, 1, 2, 5, 60, 500]), (lo or 0) - 1])))
    a, b = spark.createDataFrame(pts, "p long, t long"), spark.createDataFrame(ends, "r long, lo long, hi long")
    big = lambda v: (v is None, v or 0)

    def hit(t, lo, hi, start, end):
        ok = True
        if start:
            ok = ok and ((big(lo) < big(t)) if strict[0] else (big(lo) <= big(t)))
        if end:
            ok = ok and ((big(t) < big(hi)) if strict[1] else (big(t) <= big(hi)))
        return ok

    for start, end in (("lo", "hi"), ("lo", None), (None, "hi")):
        want = sorted(((p, r) for p, t in pts for r, lo, hi in ends if t is not None and (start is None or lo is not None) and hit(t, lo, hi, start, end)), key=repr)
        for width in (None, 7.0):
            got = J.range_join(a, b, None, "t", start, end, strict, bin_width=width)
            assert rows(got.select("p", "r")) == want
        assert not {"CartesianProduct", "BroadcastNestedLoopJoin"} & set(got._jdf.queryExecution().executedPlan().toString().replace("(", " ").split())
        if start and end:
            some = {p for p, _ in want}
            assert {r.p for r in J.range_join(a, b, None, "t", start, end, strict, how="left_semi").collect()} == some
            assert {r.p for r in J.range_join(a, b, None, "t", start, end, strict, how="left_anti").collect()} == {p for p, _ in pts} - some
            assert rows(J.range_join(a, b, None, "t", start, end, strict, how="left").select("p", "r")) == sorted([*want, *((p, None) for p, _ in pts if p not in some)], key=repr)
    kept = J.range_join(a, b, None, "t", "lo", "hi", strict, droprangecols=False)
    assert kept.columns == ["p", "t", "r", "lo", "hi"]
    with pytest.raises(ValueError, match="equal keys"):
        J.range_join(a.withColumn("t", F.col("t").cast("string")), b, None, "t", "lo", "hi")


def test_contains_ranges(spark):
    a = spark.createDataFrame([(1, -1.2), (2, -3.0), (1, 2.1), (3, -3.5)], "x1 long, y double")
    b = spark.createDataFrame([(1, 0.0, 3.0), (2, -3.0, 0.0), (3, 1.0, 2.0)], "x1 long, lower double, upper double")
    flag = lambda on, **k: [r.contains for r in J.contains(a, b, on, **k).orderBy("x1", "y").collect()]
    assert flag(["x1", ("y", ("lower", "upper"))], strict=(True, True)) == [False, True, False, False]
    assert flag(["x1", ("y", ("lower", None))]) == [False, True, True, False]
    assert flag(["x1", ("y", (None, "upper"))]) == [True, True, True, True]
    assert flag([("y", ("lower", None))], strict=(True, False)) == [True, True, False, False]
    assert flag([("y", ("lower", "upper"))]) == [True, True, True, False]


def test_joins_with_formats_and_compare_by_rows(spark):
    a = spark.createDataFrame([(11, "p"), (25, "q"), (39, "r")], "k long, v string")
    b = spark.createDataFrame([(1, "one"), (2, "two"), (7, "seven")], "k long, w string")
    f = {"left": {"k": lambda c: F.floor(c / 10)}}
    assert rows(J.semi_join(a, b, "k", f)) == [(11, "p"), (25, "q")] and rows(J.anti_join(a, b, "k", f)) == [(39, "r")]
    assert rows(J.outer_join(a, b, "k", "s", f)) == sorted([(11, "p", "one", "both"), (25, "q", "two", "both"), (39, "r", None, "left"), (7, None, "seven", "right")], key=repr)
    assert rows(J.left_join_unique(a, b, "k", f)) == sorted([(11, "p", "one"), (25, "q", "two"), (39, "r", None)], key=repr)
    t = spark.createDataFrame([(2, "new", 1)], "k long, v string, o int")
    assert rows(J.update(a, t, "k", "o", "all", formats=f)) == [(11, "p"), (25, "new"), (39, "r")]
    got = J.compare(a, b, "k", [("v", "w")], on_formats=f, obs_ids=("k", "k"), formats={"left": {"v": F.length}, "right": {"w": F.length}})
    assert rows(got) == sorted([(11, 11, 1, False), (25, 25, 2, False), (39, 39, None, None), (7, None, 7, None)], key=repr)
    assert rows(J.compare_rows(a, b, "k", ("k", True), [("v", "w")], lambda x, y: x < y)) == [(1, True), (2, True), (3, False)]


def test_filters_say_when_a_predicate_is_null(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x long")
    with pytest.raises(Exception, match="predicate is null"):
        Frame(df).filter("x", lambda c: c > 1).df.collect()
    assert rows(Frame(df).filter("x", lambda c: c > 1, missings=False)) == [(3,)]
    assert rows(Frame(df).filter("x", lambda c: c > 1, missings=True)) == [(3,), (None,)]
    assert rows(Frame(df.where("x is not null")).filter("x", lambda c: c > 1)) == [(3,)]


def test_sources(spark):
    assert io.from_dict(spark, {"b": [1, 2], "a": 0}).columns == ["a", "b"]
    assert io.from_lists(spark, [[1, 2], [3, 4]]).columns == ["x1", "x2"] and io.from_matrix(spark, np.eye(2), "auto").columns == ["x1", "x2"]
    point = namedtuple("point", "x y")
    for t in (pd.DataFrame({"x": [1], "y": [2.5]}), pa.table({"x": [1], "y": [2.5]}), [{"x": 1, "y": 2.5}], [point(1, 2.5)], {"x": [1], "y": [2.5]}, spark.createDataFrame([(1, 2.5)], "x long, y double")):
        assert rows(io.from_table(spark, t)) == [(1, 2.5)]
    assert rows(io.from_table(spark, [(1, 2.5)], "x long, y double")) == [(1, 2.5)]
    f = io.from_columns(spark, n=[1, 2], s=['a_"b', None], b=[True, None])
    assert io.schema_of(f) == [("n", "bigint"), ("s", "string"), ("b", "boolean")] and list(io.rows_of(f.with_order("n")))[0] == {"n": 1, "s": 'a_"b', "b": True}
    assert io.columns_of(f).num_rows == 2
    assert rows(io.text_rows(f)) == [('1,"a_""b",1',), ("2,,",)]
    assert rows(io.text_rows(io.from_columns(spark, s=["a\rb"]))) == [('"a\rb"',)]
    tex = io.show(f.with_order("n"), mime="latex")
    assert r'a\_"b' in tex and tex.startswith(r"\begin{tabular}{lll}") and tex.endswith(r"\end{tabular}")
    assert rows(io.as_array(io.from_columns(spark, a=[1, None], b=[2.5, 3.0])).df.select("row")) == [([1.0, 2.5],), ([None, 3.0],)]


def test_frame_surface(spark):
    f = io.from_columns(spark, g=["a", "b", "a"], x=[1, 2, 3]).with_order("x")
    assert f.names == ["g", "x"] and f.size == (3, 2) and not f.is_empty() and f.empty().is_empty()
    assert rows(f.similar(2)) == [(None, None)] * 2 and f.similar().df.dtypes == f.df.dtypes
    assert [r.x for r in f.eachrow()] == [1, 2, 3] and [n for n, _ in f.pairs()] == ["g", "x"] and f.find_column(lambda n, t: t == "bigint") == "x"
    assert [(k, g.nrow) for k, g in f.groupby("g").eachgroup()] == [(("a",), 2), (("b",), 1)]
    assert f.stat(A.sum_, "x") == 6
    assert [r.x for r in f.groupby("g", rev=True).arranged().df.collect()] == [2, 1, 3]
    assert [r.g for r in f.sort("x", rev=True).df.collect()] == ["a", "b", "a"]
    assert [r.g for r in io.from_columns(spark, g=["b", "a", "b"], x=[1, 2, 3]).with_order("x").gatherby("g").combine(("x", A.sum_), arrange=True).df.collect()] == ["b", "a"]
    assert rows(f.insert_cols(1, v=[7, 8, 9], w=0)) == [(7, 0, "a", 1), (8, 0, "b", 2), (9, 0, "a", 3)]
    assert f.disallow_missing("x").allow_missing("x").df.schema["x"].nullable
    with pytest.raises(ValueError, match="with_order"):
        io.from_columns(spark, x=[1]).set_format(x=lambda c: c % 2).groupby("x").combine(("x", A.sum_, "s"))
    assert rows(f.groupby("g").combine_rows(("x", lambda c: A.topk(c, 2), "t"), ("x", A.n, "n"), (["t", "n"], byrow(R.row_sum), "s"))) == [("a", 1, 2, 3), ("a", 3, 2, 5), ("b", 2, 1, 3)]
    null = io.from_columns(spark, g=[1, 1, 2], x=[None, 5, None]).groupby("g")
    assert rows(null.combine_rows(("x", lambda c: A.topk(c, 2), "t"))) == [(1, 5), (2, None)]
    assert rows(null.with_order("g").topk_groups("x", 2)) == [(1, 5), (2, None)]
    text = io.from_columns(spark, g=[1, 1, 1], s=["b", "c", "a"], i=[1, 2, 3]).groupby("g")
    assert rows(text.combine_rows(("s", lambda c: A.topkperm(c, "i", 2), "p"))) == [(1, 1), (1, 2)]


def test_positions(spark):
    df = spark.createDataFrame([(i, chr(97 + i)) for i in range(5)], "i long, s string")
    assert rows(S.delete_at(df, "i", [True, False, True, False, False])) == [(1, "b"), (3, "d"), (4, "e")]
    assert rows(S.delete_at(df, ("i", True), Not(range(1, 3)))) == [(3, "d"), (4, "e")]
    assert rows(S.take_rows(df, "s", [5, 5, 1], "n")) == [(0, "a", 3), (4, "e", 1), (4, "e", 2)]
    assert rows(S.set_column(df, "i", "s", list("vwxyz"))) == list(enumerate("vwxyz"))
    block = spark.createDataFrame([("Z",), ("Y",)], "s string")
    assert rows(S.set_block(df, "i", [2, 4], block, "s")) == [(0, "a"), (1, "Y"), (2, "c"), (3, "Z"), (4, "e")]
    with pytest.raises(ValueError):
        S.set_column(df, "i", "s", [1])
    assert rows(S.append(df.limit(0), df.limit(1).select("i"), "subset")) == [(0, None)] and S.append(df, df.select("i"), "intersect").columns == ["i"]
    with pytest.raises(ValueError):
        S.append(df, df.select("s", "i"), "orderequal")


def test_wide_forms(spark):
    df = spark.createDataFrame([(1, "a_b", "c", 1), (1, "a", "b_c", 2), (1, None, "x", 3)], "g long, p string, q string, v long")
    got = T.pivot(df, ["g"], ["p", "q"], "v")
    assert sorted(got.columns) == ["(a, b_c)", "(a_b, c)", "(missing, x)", "g"] and got.select("(a, b_c)", "(a_b, c)", "(missing, x)").collect()[0][:] == (2, 1, 3)
    twice = df.unionByName(df)
    for make in (lambda: T.pivot(twice, ["g"], ["p", "q"], "v"), lambda: T.pivot_many(twice, ["g"], "p", ["v", "q"], ["a"]), lambda: T.transpose(twice, ["v"], "q")):
        with pytest.raises(Exception, match="several values"):
            make().collect()
    assert rows(T.pivot_many(df, ["g"], "q", ["v"], ["c", "zz"], default=0)) == [(1, 1, 0)]
    flip = T.transpose(spark.createDataFrame([(1, 1), (2, 4), (3, 9), (4, 16)], "x1 long, x2 long"), ["x1", "x2"], order="x1")
    assert flip.columns == ["_variables_", "_c1", "_c2", "_c3", "_c4"] and rows(flip) == [("x1", 1, 2, 3, 4), ("x2", 1, 4, 9, 16)]
    long = spark.createDataFrame([("one", 1), ("one", 2), ("two", None)], "g string, v long")
    assert rows(T.rows_to_columns(long, ["g"], ["v"], ["v"], default=-1)) == [("one", "v", 1, 2), ("two", "v", None, -1)]
    with pytest.raises(ValueError, match="2 rows"):
        T.rows_to_columns(long, ["g"], ["v"], ["v"], 1)


def test_hashes_see_where_nulls_are(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, None)], "a long, b long")
    assert df.select(R.row_hash(["a", "b"]).alias("h")).distinct().count() == 3
    assert S.table_hash(df.limit(1)) != S.table_hash(df.where("a = 1"))
