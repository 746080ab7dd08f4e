"""Literal results for small inputs."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.frame import Frame, byrow
from tessera.functions import aggs as A
from tessera.functions import rowops as R
from tessera.functions import windows as W
from tessera.operators import joins as J
from tessera.operators import reshape as T
from tessera.operators import sets as S
from tessera.selectors import All, Between, Cols, Not, make_unique, resolve
from tessera.sources import io


def rows(df, *order):
    got = [tuple(r) for r in (df.df if isinstance(df, Frame) else df).collect()]
    return got if order else sorted(got, key=repr)


def same(df, want):
    assert rows(df) == sorted(want, key=repr)


def test_selectors():
    c = ["a", "b", "xa", "xb"]
    assert resolve(c, None) == resolve(c, All()) == c
    assert resolve(c, 2) == ["b"] and resolve(c, [True, False, False, True]) == ["a", "xb"]
    assert resolve(c, re.compile("^x")) == ["xa", "xb"] and resolve(c, Not("b")) == ["a", "xa", "xb"]
    assert resolve(c, Between("b", 4)) == ["b", "xa", "xb"] and resolve(c, Cols("a", re.compile("a"))) == ["a", "xa"]
    for bad in (["a", "a"], "zz", 9, [True]):
        with pytest.raises((KeyError, IndexError, ValueError, TypeError)):
            resolve(c, bad)
    assert make_unique(["a", "b", "b"], ["a"]) == ["a_1", "b", "b_1"]


def test_equi_joins(spark):
    name = spark.createDataFrame([(1, "John"), (2, "Jane"), (3, "Joe")], "id long, name string")
    job = spark.createDataFrame([(1, "Lawyer"), (2, "Doctor"), (2, "Florist"), (4, "Farmer")], "id long, job string")
    inner = [(1, "John", "Lawyer"), (2, "Jane", "Doctor"), (2, "Jane", "Florist")]
    same(J.inner_join(name, job, "id"), inner)
    same(J.left_join(name, job, "id"), [*inner, (3, "Joe", None)])
    same(J.outer_join(name, job, "id", source="s"), [*[(*r, "both") for r in inner], (3, "Joe", None, "left"), (4, None, "Farmer", "right")])
    same(J.semi_join(name, job, "id"), [(1, "John"), (2, "Jane")])
    same(J.anti_join(name, job, "id"), [(3, "Joe")])
    same(J.contains(name, job, "id"), [(1, "John", True), (2, "Jane", True), (3, "Joe", False)])
    with pytest.raises(Exception, match="several matches"):
        J.left_join_unique(name, job, "id").collect()
    same(J.left_join_unique(name, job.where("id != 2"), "id"), [(1, "John", "Lawyer"), (2, "Jane", None), (3, "Joe", None)])
    null = spark.createDataFrame([(None, "n")], "id long, name string")
    same(J.inner_join(null, null, "id"), [(None, "n", "n")])
    same(J.left_join(name.limit(0), job, "id"), [])


def test_formatted_join(spark):
    left = spark.sql("SELECT * FROM VALUES (date'2020-03-01', 1), (date'2021-10-21', 2), (date'2020-01-04', 3), (date'2012-12-11', 4) AS t(year, n)")
    right = spark.createDataFrame([(2020, "A"), (2021, "B")], "year int, event string")
    assert [r.event for r in J.left_join(left, right, "year", {"left": {"year": F.year}}).orderBy("n").collect()] == ["A", "B", "A", None]


def test_close_join(spark):
    a = spark.createDataFrame([("id1", 50.0), ("id2", 69.5), ("id3", 45.5), ("id4", 88.0), ("id5", 98.5)], "id string, mark double")
    g = spark.createDataFrame([(0.0, "F"), (49.5, "P"), (59.5, "C"), (69.5, "B"), (79.5, "A-"), (89.5, "A"), (95.5, "A+")], "mark double, grade string")
    get = lambda **k: [r.grade for r in J.close_join(a, g, None, "mark", ["id"], ["mark"], **k).orderBy("id").collect()]
    assert get() == ["P", "B", "F", "A-", "A+"]
    assert get(direction="forward") == ["C", "B", "P", "A", None]
    assert get(direction="forward", border="nearest")[-1] == "A+" and get(border="none")[-1] is None
    assert get(direction="nearest") == ["P", "B", "P", "A", "A+"]
    assert get(tol=1.0) == ["P", "B", None, None, None]
    assert get(allow_exact_match=False)[1] is None


def test_ranges(spark):
    left = spark.createDataFrame([(1, -1.2), (2, -3.0), (1, 2.1), (3, -3.5)], "x1 long, y double")
    right = spark.createDataFrame([(1, 0.0, 3.0), (2, -3.0, 0.0), (3, 1.0, 2.0)], "x1 long, lower double, upper double")
    same(J.range_join(left, right, "x1", "y", "lower", "upper", (True, True), how="left_semi"), [(1, 2.1)])
    same(J.range_join(left, right, "x1", "y", "lower", "upper", how="left_semi"), [(1, 2.1), (2, -3.0)])
    ends = spark.createDataFrame([(i, float(i), None if i % 4 == 0 else float(i + i % 5)) for i in range(30)], "r long, lo double, hi double")
    pts = spark.createDataFrame([(i, i * 0.7) for i in range(60)], "p long, t double")
    plain = J.range_join(pts, ends, None, "t", "lo", "hi")
    same(J.range_join(pts, ends, None, "t", "lo", "hi", bin_width=3.0), rows(plain))


def test_update_and_compare(spark):
    main = spark.createDataFrame([("G1", 1, 1.2, 5), ("G1", 1, 2.3, 4), ("G1", 2, None, 4), ("G1", 2, 2.3, 2), ("G2", 1, 1.3, 1), ("G2", 1, 2.1, None), ("G2", 2, 0.0, 2)], "g string, id long, x1 double, x2 long")
    t = spark.createDataFrame([("G1", 2, 2.5, None, 1), ("G2", 1, None, 3, 2)], "g string, id long, x1 double, x2 long, o int")
    get = lambda **k: [(r.x1, r.x2) for r in J.update(main, t, ["g", "id"], "o", **k).collect()]
    key = lambda v: sorted(v, key=repr)
    assert key(get()) == key([(1.2, 5), (2.3, 4), (2.5, 4), (2.3, 2), (1.3, 1), (2.1, 3), (0.0, 2)])
    assert key(get(mode="all")) == key([(1.2, 5), (2.3, 4), (2.5, 4), (2.5, 2), (1.3, 3), (2.1, 3), (0.0, 2)])
    add = lambda a, b: a + b
    assert key(get(op=add)) == key([(1.2, 5), (2.3, 4), (None, 4), (4.8, 2), (1.3, 4), (2.1, None), (0.0, 2)])
    assert key(get(op=add, allowmissing=True)) == key([(1.2, 5), (2.3, 4), (None, None), (4.8, None), (None, 4), (None, None), (0.0, 2)])
    old = spark.createDataFrame([(1, 100), (2, 200), (5, None)], "k long, a long")
    new = spark.createDataFrame([(1, 120), (2, 700), (4, 1)], "k long, b long")
    same(J.compare(old, new, "k", [("a", "b")], lambda a, b: F.abs(a - b) <= 50), [(1, True), (2, False), (4, None), (5, None)])


def test_row_operators(spark):
    df = spark.createDataFrame([(0, 3, 1.2, None, None), (0, 2, None, None, None), (1, 1, -1.0, 3.0, -1.4), (None, 3, 2.3, None, 3.0), (2, -2, 10.0, None, -100.0)], "a long, b long, x double, y double, z double").withColumn("i", F.monotonically_increasing_id())
    fl = ["x", "y", "z"]
    get = lambda c: [r[0] for r in df.orderBy("i").select(c).collect()]
    near = lambda v: [None if x is None else round(x, 6) for x in v]
    assert get(R.row_sum(["a", "b"])) == [3, 2, 2, 3, 0] and near(get(R.row_sum(fl))) == [1.2, None, 0.6, 5.3, -90]
    assert get(R.row_mean(["a", "b"])) == [1.5, 1, 1, 3, 0] and get(R.row_max(fl)) == [1.2, None, 3, 3, 10] and get(R.row_max(fl, F.abs)) == [1.2, None, 3, 3, 100]
    assert get(R.row_min(fl)) == [1.2, None, -1.4, 2.3, -100] and get(R.row_argmin(fl)) == ["x", None, "z", "x", "z"]
    assert near(get(R.row_var(fl))) == [None, None, 5.92, 0.245, 6050] and near(get(R.row_var(fl, False))) == [0, None, 3.946667, 0.1225, 3025]
    assert get(R.row_coalesce(["y", "x"])) == [1.2, None, 3, 2.3, 10] and get(R.row_count(["a", "b", *fl], lambda c: c.isNull())) == [2, 3, 0, 2, 1]
    cum = spark.createDataFrame([(1, 1, 1), (None, 2, None), (3, None, 3), (None, 4, 4)], "x long, y long, z long")
    same(cum.select(*[c.alias(n) for n, c in R.row_cumsum(["x", "y", "z"]).items()]), [(1, 2, 3), (None, 2, 2), (3, 3, 6), (None, 4, 8)])
    same(cum.select(*[c.alias(n) for n, c in R.row_cumsum(["x", "y", "z"], "skip").items()]), [(1, 2, 3), (None, 2, None), (3, None, 6), (None, 4, 8)])


def test_windows(spark):
    df = spark.createDataFrame(list(enumerate([None, 3, -9, 2, None])), "i long, v long")
    get = lambda c: [r[0] for r in df.select("i", c.alias("c")).orderBy("i").select("c").collect()]
    o = ["i"]
    assert get(W.cumsum("v", "ignore", [], o)) == [None, 3, -6, -4, -4] and get(W.cumsum("v", "skip", [], o)) == [None, 3, -6, -4, None]
    assert get(W.cumprod("v", "ignore", [], o)) == [None, 3, -27, -54, -54] and get(W.ffill("v", None, [], o)) == [None, 3, -9, 2, 2]
    assert get(W.bfill("v", None, [], o)) == [3, 3, -9, 2, None] and get(W.lag("v", 1, 0, [], o)) == [0, None, 3, -9, 2]


def test_frame(spark):
    f = Frame(spark.createDataFrame([(1, 3, "b"), (2, 1, "c"), (3, 2, "a"), (4, 1, "b")], "i long, x long, y string")).with_order("i")
    same(f.filter("x", by=lambda c: c > 1).select(["x", "y"]), [(3, "b"), (2, "a")])
    same(f.delete("x", by=lambda c: c > 1).select(["x", "y"]), [(1, "c"), (1, "b")])
    odd = f.set_format(x=lambda c: c % 2 == 1)
    same(odd.mask(True, "x"), [(True,), (True,), (False,), (True,)])
    assert rows(odd.groupby("x").combine(("y", A.length)).sort("x"), 1) == [(2, 1), (3, 3)] and odd.content()[1][0] == "x"
    same(f.groupby("x").combine(("i", [A.maximum, A.minimum]), (["maximum_i", "minimum_i"], byrow(lambda c: F.col(c[0]) - F.col(c[1])))), [(3, 1, 1, 0), (1, 4, 2, 2), (2, 3, 3, 0)])
    with pytest.raises(ValueError, match="grouping"):
        f.groupby("x").combine(("i", A.maximum, "x"))
    assert f.rename({"x": "y", "y": "x"}).columns == ["i", "y", "x"] and f.rename(str.upper).columns == ["I", "X", "Y"]
    assert f.insert_cols(1, x=5, makeunique=True).columns == ["x_1", "i", "x", "y"] and f.is_sorted("i") and not f.is_sorted("x")
    assert [r[0] for r in f.sort("x", rev=True).select("i").df.collect()] == [1, 3, 2, 4] and rows(f.head(1), 1) == [(1, 3, "b")]
    same(f.select("y").map_same_type(lambda c: c.cast("int")), [("b",), ("c",), ("a",), ("b",)])


def test_reshape(spark):
    df = spark.createDataFrame([("one", "A", 1), ("one", "B", 2), ("one", "C", 3), ("two", "A", 4), ("two", "B", None)], "foo string, bar string, baz long")
    same(T.pivot(df, ["foo"], "bar", "baz"), [("one", 1, 2, 3), ("two", 4, None, None)])
    same(T.pivot(df, ["foo"], "bar", "baz", default=-1), [("one", 1, 2, 3), ("two", 4, None, -1)])
    with pytest.raises(Exception, match="several values"):
        T.pivot(df.unionAll(df), ["foo"], "bar", "baz").collect()
    same(T.rows_to_columns(df, ["foo"], ["baz"], ["bar"], 3), [("one", "baz", 1, 2, 3), ("two", "baz", 4, None, None)])
    lists = spark.createDataFrame([(1, [1, 2], [5, 6]), (2, [3, 4], [7, 8]), (3, None, None), (4, [], [])], "a long, b array<long>, c array<long>")
    same(T.flatten(lists, ["b", "c"]), [(1, 1, 5), (1, 2, 6), (2, 3, 7), (2, 4, 8), (3, None, None)])
    with pytest.raises(Exception, match="unequal"):
        T.flatten(spark.createDataFrame([([1], [1, 2])], "a array<long>, b array<long>"), ["a", "b"]).collect()
    same(T.repeat(spark.createDataFrame([(0, 2), (1, 3), (2, 4)], "a long, b long"), freq="a"), [(1, 3), (2, 4), (2, 4)])


def test_sets(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 AS v", "id % 3 AS g")
    assert [r.row_id for r in S.row_ids(df, "v").orderBy("v").collect()] == list(range(1, 1001))
    assert S.unique(df, ["g"], ["id"], "last").count() == 3 and S.unique(df, ["g"], ["id"], "none").count() == 0
    assert S.duplicates(df, ["g"], ["id"]).where("duplicate").count() == 997
    small = spark.createDataFrame([(1, "a"), (2, "b")], "x long, y string")
    same(S.hcat(small, small.withColumn("x", F.col("x") * 10), "x", "x"), [(1, "a", 10, "a"), (2, "b", 20, "b")])
    same(S.vcat([small, small.select("x")], "intersect", "s"), [(1, 1), (2, 1), (1, 2), (2, 2)])
    with pytest.raises(ValueError, match="differ"):
        S.vcat([small, small.select("x")])
    assert S.same_rows(small, small) and not S.same_rows(small, small.limit(1))


def test_positions(spark):
    f = Frame(spark.createDataFrame([(i, 10 - i) for i in range(6)], "x int, y int")).with_order("x")
    assert [r.x for r in f.tail(2).df.collect()] == [4, 5]
    assert [r.x for r in f.reverse().df.collect()] == [5, 4, 3, 2, 1, 0]
    assert f.head(1).only().y == 10
    with pytest.raises(ValueError, match="exactly one"):
        f.only()
    same(S.resize(f.df, "x", 2), [(0, 10), (1, 9)])
    assert S.resize(f.df, "x", 8).where("x is null").count() == 2
    v = spark.createDataFrame([(1,), (3,), (3,), (None,)], "v int")
    got = v.agg(A.search_first("v", F.lit(3)), A.search_last("v", F.lit(3)), A.search_last("v", F.lit(None).cast("int")), A.search_first("v", F.lit(9))).first()
    assert tuple(got) == (2, 3, 4, 4)


def test_sources(spark, tmp_path):
    f = io.from_columns(spark, a=[1, 2], b="x")
    same(f, [(1, "x"), (2, "x")])
    assert io.from_matrix(spark, [[1.0, 2.0]]).columns == ["x1", "x2"] and io.to_matrix(f).shape == (2, 2)
    io.write(f.set_format(a=lambda c: c * 10), str(tmp_path / "t"), "csv", formatted=True, header=True)
    same(io.read(spark, str(tmp_path / "t"), "csv", header=True), [("10", "x"), ("20", "x")])
    same(io.text_rows(io.from_columns(spark, a=['q"', "p,"], b=[1, None])), [('"q""",1',), ('"p,",',)])
    assert "<table" in io.show(f, mime="html") and io.show(f, mime="csv").startswith("a,b")
    same(spark.sql("SELECT '12  ' a UNION ALL SELECT ''").select(io.fixed_width(F.col("a"))), [("12",), (None,)])


def test_whole_table_in_buckets(spark):
    """Positions, runs, running values and order over buckets, with ties, nulls and an empty table."""
    import random

    rng = random.Random(4)
    data = [(i, rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 5])) for i in range(500)]
    df = spark.createDataFrame(data, "i long, k string, v long")
    got = {r.i: r.run for r in S.runs(df, [F.col("k")], "i", "run").collect()}
    want, run = {}, 0
    for j, (i, k, _) in enumerate(data):
        run += j == 0 or k != data[j - 1][1]
        want[i] = run
    assert got == want
    got = {r.i: r.s for r in S.running(df, "v", "i", "sum", "s").collect()}
    total = None
    for i, _, v in data:
        total = total if v is None else (total or 0) + v
        assert got[i] == total
    assert S.is_sorted(df, F.col("i"), "i") and S.is_sorted(df, -F.col("i"), "i", rev=True) and not S.is_sorted(df, F.col("v"), "i")
    tied = df.select("v", "i")
    pos = [r.i for r in S.row_ids(tied, "v", "p", ["i"], desc=True).orderBy("p").collect()]
    assert pos == [i for i, _, v in sorted(data, key=lambda r: (r[2] is not None, -(r[2] or 0), r[0]))]
    empty = df.limit(0)
    assert S.runs(empty, [F.col("k")], "i").count() == 0 and S.running(empty, "v", "i").count() == 0 and S.is_sorted(empty, F.col("v"), "i")
    assert S.table_hash(df) == S.table_hash(df.orderBy(F.desc("i"))) != S.table_hash(df.where("i > 0"))


def test_binned_range_joins_with_open_ends(spark):
    pts = spark.createDataFrame([(i, None if i == 7 else i * 1.5) for i in range(12)], "id long, t double")
    r = spark.createDataFrame([("a", 1.0, 4.0), ("b", 9.0, None), ("c", None, 3.0), ("d", 5.0, 2.0)], "n string, lo double, hi double")
    hit = {i for i in range(12) if i != 7 and (1 <= i * 1.5 <= 4 or i * 1.5 >= 9)}
    for how, want in (("left_semi", hit), ("left_anti", set(range(12)) - hit)):
        got = [x.id for x in J.range_join(pts, r, None, "t", "lo", "hi", how=how, bin_width=2.0).collect()]
        assert sorted(got) == sorted(want)
    assert J.range_join(pts, r, None, "t", "lo", "hi", how="left", bin_width=2.0).count() == 12


def test_frame_columns(spark):
    f = Frame(spark.createDataFrame([(1, 2.0), (3, None)], "a long, b double"))
    assert tuple(f.map_cols([A.maximum, A.nmissing]).df.first()) == (3, 1)
    assert f.disallow_missing("a").df.count() == 2
    with pytest.raises(Exception, match="null in b"):
        f.disallow_missing("b").df.collect()
    got = f.groupby("a").apply_groups(lambda p: p.assign(b=p["b"].fillna(0) + 1), "a long, b double")
    assert sorted(map(tuple, got.df.collect())) == [(1, 3.0), (3, 1.0)]
