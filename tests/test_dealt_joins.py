"""Joins whose keys have many pairs: the same rows as by brute force, and more tasks as the pairs grow."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins as J


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("PAIRS", 64), ("DEALT", 32), ("FEW", 2)):
        monkeypatch.setattr(J, name, value)


@pytest.fixture
def sides(spark):
    """Keys null and 1 have many pairs, 2 has two, 3 and 4 are on one side; some rows are exact copies."""
    a = [(None, i // 2) for i in range(40)] + [(1, i) for i in range(30)] + [(2, 1), (3, 1)] + [(5, 0)]
    b = [(None, i) for i in range(25)] + [(1, i // 3) for i in range(9)] + [(2, 7), (2, 8), (4, 1)] + [(5, i) for i in range(70)]
    return a, b, spark.createDataFrame(a, "k int, x int"), spark.createDataFrame(b, "k int, y int")


def tasks(df):
    return df.rdd.getNumPartitions()


def test_dealt_equi_joins_match_brute_force(small, sides):
    a, b, left, right = sides
    inner = [(k, x, y) for k, x in a for h, y in b if k == h]
    alone, other = [(3, 1, None)], [(4, None, 1)]
    assert rows(J.inner_join(left, right, "k")) == sorted(inner, key=repr)
    assert rows(J.left_join(left, right, "k")) == sorted(inner + alone, key=repr)
    got = rows(J.outer_join(left, right, "k", source="s"))
    assert got == sorted([*[(*r, "both") for r in inner], *[(*r, "left") for r in alone], *[(*r, "right") for r in other]], key=repr)
    assert rows(J.with_obs_ids(left, right, "k", "x", "y")) == sorted(inner + alone, key=repr)
    assert len(rows(J.with_obs_ids(left, right, "k", "x", "y", "outer"))) == len(got)
    wide = right.withColumn("k", F.col("k").cast("long"))
    assert rows(J.inner_join(left, wide, "k")) == sorted(inner, key=repr)
    by = {"left": {"k": lambda c: c % 2}, "right": {"k": lambda c: c % 2}}
    odd = lambda k: None if k is None else k % 2
    assert len(rows(J.inner_join(left, right, "k", by))) == sum(odd(k) == odd(h) for k, _ in a for h, _ in b)
    got = rows(J.compare(left, right, "k", [("x", "y")]))
    assert got == sorted([*[(k, x == y) for k, x, y in inner], (3, None), (4, None)], key=repr)


def test_tasks_of_a_join_follow_its_pairs(small, sides):
    left, right = sides[2].coalesce(1), sides[3].coalesce(1)
    pairs = 40 * 25 + 30 * 9 + 70
    for how in (J.inner_join, J.left_join, J.outer_join):
        out = how(left, right, "k")
        sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert tasks(out) >= pairs // J.PAIRS and max(sizes) <= 6 * J.PAIRS


def test_ids_of_a_dealt_join(small, sides):
    a, b, left, right = sides
    out = J.with_obs_ids(left.coalesce(1), right.coalesce(1), "k", "x", "y")
    assert tasks(out) >= sum(k == h for k, _ in a for h, _ in b) // J.PAIRS
    assert rows(out.select("k", "obs_id_left", "obs_id_right")) == rows(J.left_join(left, right, "k"))


def test_flags_of_several_matches_without_exchanging_pairs(small, sides):
    left, right = sides[2], sides[3]
    assert rows(J.left_join_matches(left, right, "k", "x")) == rows(J.with_multiple_match(J.left_join(left, right, "k"), "x"))
    one = right.where("k = 2 and y = 7")
    assert rows(J.left_join_matches(left, one, "k", "x")) == rows(J.with_multiple_match(J.left_join(left, one, "k"), "x"))


@pytest.mark.parametrize("ends", [("lo", "hi"), (None, "hi"), ("lo", None)])
def test_dealt_range_joins_match_brute_force(spark, small, ends):
    pts, spans = [(i, float(i % 50)) for i in range(120)], [(i, float(i % 7), float(i % 7 + i % 30)) for i in range(60)]
    left, right = spark.createDataFrame(pts, "p int, t double").coalesce(1), spark.createDataFrame(spans, "r int, lo double, hi double").coalesce(1)
    start, end = ends
    want = sorted((p, r) for p, t in pts for r, lo, hi in spans if (not start or lo <= t) and (not end or t < hi))
    out = J.range_join(left, right, None, "t", start, end, (False, True)).select("p", "r")
    assert sorted(tuple(x) for x in out.collect()) == want
    sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= len(want) // J.PAIRS and max(sizes) <= 6 * J.PAIRS


def test_grid_pieces_keep_to_their_pairs():
    for n, m in ((1, 1 << 30), (1 << 30, 1), (3, 10**7), (10**7, 3), (10**6, 10**6), (2500, 2500), (900, 700)):
        a, b = J._grid(n, m)
        assert -(-n // a) * -(-m // b) <= 2 * J.PAIRS and n * b + m * a <= max(n + m, n * m // 200) * 2


@pytest.mark.parametrize("key", ["make_ym_interval(0, id div 50)", "make_dt_interval(0, 0, 0, id div 50)", "timestamp_seconds(id div 50)", "decimal(id div 50)", "named_struct('a', id div 50)", "cast(nullif(id div 50, 1) as double)"])
def test_dealt_keys_of_many_types(spark, small, key):
    left, right = spark.range(100).selectExpr(f"{key} as k", "id as x"), spark.range(100).selectExpr(f"{key} as k", "id as y")
    got = sorted(tuple(r) for r in J.inner_join(left, right, "k").select("x", "y").collect())
    assert got == sorted((x, y) for x in range(100) for y in range(100) if x // 50 == y // 50)
