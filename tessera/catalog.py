"""Registered queries over whole tables: name -> (callable, oracle SQL or None).

The tables hold no nulls, so queries on null semantics make some with nullif, in both languages alike.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.frame import Frame, byrow
from tessera.functions import aggs as A
from tessera.functions import rowops as R
from tessera.functions import windows as WN
from tessera.operators import joins as J
from tessera.operators import reshape as T
from tessera.operators import sets as S
from tessera.selectors import Between, Cols, Not
from tessera.sources import io
from tessera.streaming import windowed

QUERIES: dict = {}


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def _line(spark, d):
    """lineitem with nulls."""
    t = _table(spark, d, "lineitem")
    null = lambda c, v: F.nullif(F.col(c), F.lit(v))
    return t.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", null("l_quantity", 10.0).alias("q"), null("l_linenumber", 3).alias("ln"), F.round(F.col("l_discount") * 100).cast("int").alias("di"), null("l_tax", 0.02).alias("tax"), "l_returnflag", "l_linestatus", "l_extendedprice", "l_shipdate")


LINE = """line AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, nullif(l_quantity, 10.0) q, nullif(l_linenumber, 3) ln, CAST(round(l_discount * 100) AS INT) di,
 nullif(l_tax, 0.02) tax, l_returnflag, l_linestatus, l_extendedprice, l_shipdate FROM lineitem)"""
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
K = ", ".join(KEYS)


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) sum_qty, count(l_quantity) n_l_quantity, round(avg(l_quantity), 6) mean_qty,
 round(CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(l_quantity), 6) ratio FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def flagship(spark, d):
    f = Frame(_table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'").withColumn("qty", F.col("l_quantity").cast("long")))
    got = f.groupby(["l_returnflag", "l_linestatus"]).combine(("qty", A.sum_, "sum_qty"), ("l_quantity", A.n), ("l_quantity", A.mean, "mean_qty"), (["sum_qty", "n_l_quantity"], byrow(lambda c: F.round(F.col(c[0]).cast("double") / F.col(c[1]), 6)), "ratio"))
    return got.map(lambda c: F.round(c, 6), "mean_qty").sort(["l_returnflag", "l_linestatus"]).df


# projection, schema, filters
@query("SELECT o_orderkey AS key, o_totalprice, o_orderstatus FROM orders")
def select_rename(spark, d):
    return Frame(_table(spark, d, "orders")).select(re.compile("orderkey"), Cols("o_totalprice", "o_orderstatus"), Not("o_custkey")).rename({"o_orderkey": "key"}).df


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def select_between(spark, d):
    return Frame(_table(spark, d, "lineitem")).select(Between("l_orderkey", 3)).df


@query("SELECT o_orderkey, 1 AS one, o_totalprice * 2 AS twice, o_custkey, o_orderstatus FROM orders")
def insert_columns(spark, d):
    return Frame(_table(spark, d, "orders")).select(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]).insert_cols(2, one=1, twice=F.col("o_totalprice") * 2).select(Not("o_totalprice")).df


@query("SELECT c_custkey, abs(c_acctbal) AS c_acctbal, upper(c_mktsegment) AS c_mktsegment FROM customer")
def map_columns(spark, d):
    return Frame(_table(spark, d, "customer")).select(["c_custkey", "c_acctbal", "c_mktsegment"]).map([F.abs, F.upper], ["c_acctbal", "c_mktsegment"]).df


@query("SELECT c_custkey + 1 AS c_custkey, c_nationkey FROM customer")
def map_same_type(spark, d):
    return Frame(_table(spark, d, "customer")).select(["c_custkey", "c_nationkey"]).map_same_type(lambda c: c + F.lit(1).cast("long"), None).df


@query(f"WITH {LINE} SELECT {K}, q, di FROM line WHERE q > 20 AND di = 5")
def filter_all_by(spark, d):
    return Frame(_line(spark, d)).filter(["q", "di"], by=[lambda c: c > 20, 5], missings=False).select([*KEYS, "q", "di"]).df


@query(f"WITH {LINE} SELECT {K} FROM line WHERE coalesce(q > 45, true) OR coalesce(tax > 0.07, true)")
def filter_any_missings_true(spark, d):
    return Frame(_line(spark, d)).filter(["q", "tax"], by=[lambda c: c > 45, lambda c: c > 0.07], type="any", missings=True).select(KEYS).df


@query(f"WITH {LINE} SELECT {K} FROM line WHERE NOT coalesce(q > 20, false)")
def delete_rows(spark, d):
    return Frame(_line(spark, d)).delete("q", by=lambda c: c > 20).select(KEYS).df


@query(f"WITH {LINE} SELECT coalesce(q > 20, false) q, coalesce(tax > 0.04, false) tax FROM line")
def mask_bool(spark, d):
    return Frame(_line(spark, d)).mask([lambda c: c > 20, lambda c: c > 0.04], ["q", "tax"]).df


@query(f"WITH {LINE} SELECT {K}, q IS NOT NULL AND tax IS NOT NULL AS complete FROM line")
def complete_cases(spark, d):
    return Frame(_line(spark, d)).complete_cases(["q", "tax"]).select([*KEYS, "complete"]).df


@query(f"WITH {LINE} SELECT {K} FROM line WHERE q IS NOT NULL AND ln IS NOT NULL")
def drop_missing(spark, d):
    return Frame(_line(spark, d)).drop_missing(["q", "ln"]).select(KEYS).df


# row operators
def _rows(f):
    def run(spark, d):
        return _line(spark, d).select(*KEYS, *[c.alias(n) for n, c in f().items()])

    return run


def _row_query(name, cols, sql):
    QUERIES[name] = (_rows(cols), f"WITH {LINE} SELECT {K}, {sql} FROM line")


INTS = ["ln", "di", "l_linenumber"]
_row_query("byrow_sum_mean", lambda: {"s": R.row_sum(["ln", "di"]).cast("long"), "m": R.row_mean(INTS), "p": R.row_prod(INTS).cast("long")}, "CAST(coalesce(ln, 0) + di AS BIGINT) s, CAST(coalesce(ln, 0) + di + l_linenumber AS DOUBLE) / (2 + CAST(ln IS NOT NULL AS INT)) m, CAST(coalesce(ln, 1) * di * l_linenumber AS BIGINT) p")
_row_query("byrow_min_max", lambda: {"lo": R.row_min(INTS), "hi": R.row_max(INTS), "amin": R.row_argmin(INTS), "amax": R.row_argmax(INTS)}, "least(ln, di, l_linenumber) lo, greatest(ln, di, l_linenumber) hi, CASE least(ln, di, l_linenumber) WHEN ln THEN 'ln' WHEN di THEN 'di' ELSE 'l_linenumber' END amin, CASE greatest(ln, di, l_linenumber) WHEN ln THEN 'ln' WHEN di THEN 'di' ELSE 'l_linenumber' END amax")
_row_query("byrow_var_std", lambda: {"v": F.round(R.row_var(INTS), 6), "v0": F.round(R.row_var(INTS, False), 6), "s": F.round(R.row_std(INTS), 6)}, "round((SELECT var_samp(x) FROM unnest([ln, di, l_linenumber]) t(x)), 6) v, round((SELECT var_pop(x) FROM unnest([ln, di, l_linenumber]) t(x)), 6) v0, round((SELECT stddev_samp(x) FROM unnest([ln, di, l_linenumber]) t(x)), 6) s")
_row_query("byrow_count_any_all", lambda: {"c": R.row_count(INTS, 2), "a": R.row_any(INTS, 2), "l": R.row_all(INTS, lambda c: c > 1, False)}, "CAST(coalesce(ln = 2, false) AS BIGINT) + CAST(di = 2 AS BIGINT) + CAST(l_linenumber = 2 AS BIGINT) c, coalesce(ln = 2, false) OR di = 2 OR l_linenumber = 2 a, coalesce(ln > 1, false) AND di > 1 AND l_linenumber > 1 l")
_row_query("byrow_isequal_isless_in", lambda: {"e": R.row_isequal(["ln", "l_linenumber"]), "l": R.row_isless(["ln"], "di"), "r": R.row_isless(["ln"], "di", rev=True), "i": R.row_in("di", ["ln", "l_linenumber"])}, "ln IS NOT DISTINCT FROM l_linenumber e, ln IS NOT NULL AND ln < di l, ln IS NULL OR ln > di r, coalesce(di = ln, false) OR di = l_linenumber i")
_row_query("byrow_find_select", lambda: {"f": R.row_findfirst(INTS, 2), "z": R.row_findfirst(INTS, 2, last=True), "p": R.row_select(INTS, F.col("di"))}, "CASE WHEN ln = 2 THEN 'ln' WHEN di = 2 THEN 'di' WHEN l_linenumber = 2 THEN 'l_linenumber' END f, CASE WHEN l_linenumber = 2 THEN 'l_linenumber' WHEN di = 2 THEN 'di' WHEN ln = 2 THEN 'ln' END z, CASE di WHEN 1 THEN ln WHEN 2 THEN di WHEN 3 THEN l_linenumber END p")
_row_query("byrow_fill_coalesce", lambda: R.row_fill(["q", "tax"], F.lit(-1.0)) | {"c": R.row_coalesce(["ln", "di"])}, "coalesce(q, -1.0) q, coalesce(tax, -1.0) tax, coalesce(ln, di) c")
_row_query("byrow_fill_rolling", lambda: R.row_fill(["ln", "di"], F.col("l_linenumber"), by=lambda c: c.isNull() | (c == 0), rolling=True), "CASE WHEN ln IS NULL OR ln = 0 THEN l_linenumber ELSE ln END ln, CASE WHEN di = 0 THEN CASE WHEN ln IS NULL OR ln = 0 THEN l_linenumber ELSE ln END ELSE di END di")
_row_query("byrow_nunique", lambda: {"u": R.row_nunique(INTS), "v": R.row_nunique(INTS, count_missing=False)}, "CAST((SELECT count(DISTINCT x) FROM unnest([ln, di, l_linenumber]) t(x)) + CAST(ln IS NULL AS INT) AS BIGINT) u, CAST((SELECT count(DISTINCT x) FROM unnest([ln, di, l_linenumber]) t(x)) AS BIGINT) v")
_row_query("byrow_cumulative", lambda: {f"s_{n}": c for n, c in R.row_cumsum(["di", "ln", "l_linenumber"]).items()} | {f"k_{n}": c for n, c in R.row_cumsum(["di", "ln"], "skip").items()} | {f"x_{n}": c for n, c in R.row_cummax(["di", "ln"]).items()} | {f"n_{n}": c for n, c in R.row_cummin(["di", "ln"]).items()} | {f"p_{n}": c for n, c in R.row_cumprod(["di", "ln"]).items()}, "di s_di, di + coalesce(ln, 0) s_ln, di + coalesce(ln, 0) + l_linenumber s_l_linenumber, di k_di, di + ln k_ln, di x_di, greatest(di, ln) x_ln, di n_di, least(di, ln) n_ln, di p_di, di * coalesce(ln, 1) p_ln")
_row_query("byrow_sort", lambda: {f"s_{n}": c for n, c in R.row_sort(INTS).items()} | {"ok": R.row_issorted(INTS)}, "list_sort([ln, di, l_linenumber], 'ASC', 'NULLS LAST')[1] s_ln, list_sort([ln, di, l_linenumber], 'ASC', 'NULLS LAST')[2] s_di, list_sort([ln, di, l_linenumber], 'ASC', 'NULLS LAST')[3] s_l_linenumber, (ln IS NOT NULL AND ln <= di AND di <= l_linenumber) ok")
_row_query("byrow_stdze", lambda: {n: F.round(c, 6) for n, c in R.row_stdze(INTS).items()}, ", ".join(f"round(({c} - (SELECT avg(x) FROM unnest([ln, di, l_linenumber]) t(x))) / nullif((SELECT stddev_samp(x) FROM unnest([ln, di, l_linenumber]) t(x)), 0), 6) {'z_' if c == 'l_linenumber' else ''}{c}" for c in INTS))
QUERIES["byrow_stdze"] = (_rows(lambda: {("z_" if n == "l_linenumber" else "") + n: F.round(c, 6) for n, c in R.row_stdze(INTS).items()}), QUERIES["byrow_stdze"][1])
_row_query("byrow_join", lambda: {"j": R.row_join(["ln", "di", "l_returnflag"], ",", " and ")}, "coalesce(CAST(ln AS VARCHAR), '') || ',' || di || ' and ' || l_returnflag j")
_row_query("byrow_mapreduce", lambda: {"m": R.row_mapreduce(["di", "l_linenumber"], lambda c: c * c, lambda a, b: a + b)}, "di * di + l_linenumber * l_linenumber m")


# aggregates
@query(f"""WITH {LINE} SELECT l_suppkey, max(q) maximum_q, min(q) minimum_q, CAST(sum(di) AS BIGINT) sum_di, count(q) n_q, count(*) - count(q) nmissing_q, count(*) length_q,
 max(q) - min(q) AS range FROM line GROUP BY 1""")
def combine_basic(spark, d):
    return Frame(_line(spark, d)).groupby("l_suppkey").combine(("q", [A.maximum, A.minimum]), ("di", A.sum_), ("q", [A.n, A.nmissing, A.length]), (["maximum_q", "minimum_q"], byrow(lambda c: F.col(c[0]) - F.col(c[1])), "range")).df


@query(f"WITH {LINE} SELECT l_returnflag, round(corr(q, l_extendedprice), 6) cor_q_l_extendedprice, round(covar_samp(q, l_extendedprice), 2) cov_q_l_extendedprice FROM line GROUP BY 1")
def combine_multivariate(spark, d):
    got = Frame(_line(spark, d)).groupby("l_returnflag").combine((("q", "l_extendedprice"), [A.cor, A.cov]))
    return got.df.select("l_returnflag", F.round("cor_q_l_extendedprice", 6).alias("cor_q_l_extendedprice"), F.round("cov_q_l_extendedprice", 2).alias("cov_q_l_extendedprice"))


@query(f"WITH {LINE} SELECT l_suppkey, round(var_samp(q), 6) v, round(stddev_samp(q), 6) s, round(var_pop(q), 6) p, median(q) m, round(sum(q * di) / nullif(sum(CASE WHEN q IS NOT NULL THEN di END), 0), 6) w, count(DISTINCT q) + CAST(count(*) > count(q) AS INT) u FROM line GROUP BY 1")
def agg_statistics(spark, d):
    return _line(spark, d).groupBy("l_suppkey").agg(F.round(A.var("q"), 6).alias("v"), F.round(A.std("q"), 6).alias("s"), F.round(A.var("q", False), 6).alias("p"), A.median("q").alias("m"), F.round(A.wmean("q", "di"), 6).alias("w"), A.nunique("q").alias("u"))


@query("SELECT user_id, max(value) hi, arg_max(event_id, (value, -event_id)) amax, arg_min(event_id, (value, event_id)) amin FROM events GROUP BY 1")
def agg_argmax(spark, d):
    return _table(spark, d, "events").groupBy("user_id").agg(A.findmax("value", "event_id")["value"].alias("hi"), A.argmax("value", "event_id").alias("amax"), A.argmin("value", "event_id").alias("amin"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) n FROM events) WHERE n <= 3")
def agg_topk_group(spark, d):
    return Frame(_table(spark, d, "events")).with_order("event_id").groupby("user_id").topk_groups("value", 3).select(["user_id", "event_id", "value"]).df


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def topk_global(spark, d):
    return Frame(_table(spark, d, "events")).with_order("event_id").topk("value", 50).select(["event_id", "value"]).df


@query(f"""WITH {LINE} SELECT * FROM (SELECT 'q' AS "column", CAST(count(q) AS DOUBLE) n, CAST(count(*) - count(q) AS DOUBLE) nmissing, round(avg(q), 6) mean, round(stddev_samp(q), 6) std, min(q) minimum, max(q) maximum FROM line)
 UNION ALL SELECT 'di', count(di), count(*) - count(di), round(avg(di), 6), round(stddev_samp(di), 6), min(di), max(di) FROM line""")
def describe_stats(spark, d):
    got = Frame(_line(spark, d)).describe(["q", "di"]).df
    return got.select("column", "n", "nmissing", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "minimum", "maximum")


@query("""SELECT event_type, count(*) length_value, min(event_id) minimum_event_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY event_type ORDER BY event_id) run FROM events)
 GROUP BY event_type, run""")
def gatherby_runs(spark, d):
    f = Frame(_table(spark, d, "events")).with_order("event_id").gatherby("event_type", isgathered=True)
    return f.combine(("event_type", A.minimum, "event_type"), ("value", A.length), ("event_id", A.minimum)).select(Not("run_id")).df


@query("SELECT user_id, count(*) length_value, min(event_id) first_id FROM events GROUP BY 1 ORDER BY first_id")
def gatherby_appearance(spark, d):
    f = Frame(_table(spark, d, "events")).with_order("event_id").gatherby("user_id")
    return f.combine(("value", A.length), ("event_id", A.minimum, "first_id"), arrange=True).df


# windows
EV = "PARTITION BY user_id ORDER BY event_id"


def _events(spark, d):
    return Frame(_table(spark, d, "events").select("event_id", "user_id", "event_type", F.round("value").cast("long").alias("x"), F.nullif(F.round("value").cast("long") % 5, F.lit(0)).alias("v"))).with_order("event_id").groupby("user_id")


ESQL = "e AS (SELECT event_id, user_id, event_type, CAST(round(value) AS BIGINT) x, nullif(CAST(round(value) AS BIGINT) % 5, 0) v FROM events)"


def _win_query(name, cols, sql):
    def run(spark, d):
        return _events(spark, d).modify(**{n: f for n, f in cols.items()}).select(["event_id", *cols]).df

    QUERIES[name] = (run, f"WITH {ESQL} SELECT event_id, {sql} FROM e")


_win_query("lag_lead", {"a": lambda g, o: WN.lag("v", 1, None, g, o), "b": lambda g, o: WN.lead("x", 2, -1, g, o)}, f"lag(v) OVER ({EV}) a, lead(x, 2, -1) OVER ({EV}) b")
_win_query("cumsum_ignore_skip", {"a": lambda g, o: WN.cumsum("v", "ignore", g, o), "b": lambda g, o: WN.cumsum("v", "skip", g, o)}, f"CAST(sum(v) OVER ({EV}) AS BIGINT) a, CAST(CASE WHEN v IS NOT NULL THEN sum(v) OVER ({EV}) END AS BIGINT) b")
_win_query("cummin_cummax", {"a": lambda g, o: WN.cummin("v", "ignore", g, o), "b": lambda g, o: WN.cummax("v", "skip", g, o)}, f"min(v) OVER ({EV}) a, CASE WHEN v IS NOT NULL THEN max(v) OVER ({EV}) END b")
HALF = "CASE x % 4 WHEN 1 THEN -1.0 WHEN 2 THEN 2.0 WHEN 3 THEN 0.5 END"  # products of these are exact
_win_query("cumprod", {"a": lambda g, o: WN.cumprod(F.expr(HALF).cast("double"), "ignore", g, o), "b": lambda g, o: WN.cumprod(F.expr(HALF).cast("double"), "skip", g, o)}, f"CAST(product(({HALF})::DOUBLE) OVER ({EV}) AS DOUBLE) a, CASE WHEN {HALF} IS NOT NULL THEN CAST(product(({HALF})::DOUBLE) OVER ({EV}) AS DOUBLE) END b")
_win_query("ffill_bfill", {"a": lambda g, o: WN.ffill("v", None, g, o), "b": lambda g, o: WN.bfill("v", None, g, o), "c": lambda g, o: WN.ffill("x", lambda c: c % 2 == 1, g, o)}, f"coalesce(last_value(v IGNORE NULLS) OVER ({EV}), v) a, coalesce(first_value(v IGNORE NULLS) OVER ({EV} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), v) b, coalesce(last_value(CASE WHEN x % 2 = 1 THEN NULL ELSE x END IGNORE NULLS) OVER ({EV}), x) c")
_win_query("stdze_rescale", {"a": lambda g, o: F.round(WN.stdze("x", g), 6), "b": lambda g, o: F.round(WN.rescale("x", 0, 10, g), 6)}, "round((x - avg(x) OVER (PARTITION BY user_id)) / nullif(stddev_samp(x) OVER (PARTITION BY user_id), 0), 6) a, round(CAST(x - min(x) OVER (PARTITION BY user_id) AS DOUBLE) / nullif(max(x) OVER (PARTITION BY user_id) - min(x) OVER (PARTITION BY user_id), 0) * 10, 6) b")
_win_query("modify_share", {"t": lambda g, o: F.sum("x").over(WN.over(g, ())[0]), "s": lambda g, o: F.round(F.col("x") / F.nullif(F.col("t"), F.lit(0)), 6)}, "CAST(sum(x) OVER (PARTITION BY user_id) AS BIGINT) t, round(CAST(x AS DOUBLE) / nullif(sum(x) OVER (PARTITION BY user_id), 0), 6) s")


# joins
def _sides(spark, d):
    c = _table(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nk"), "c_mktsegment")
    s = _table(spark, d, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(7)).alias("nk"), "s_acctbal")  # keys 7 and 3 have one side only, null has both
    return c, s


CS = "c AS (SELECT c_custkey, nullif(c_nationkey, 3) nk, c_mktsegment FROM customer), s AS (SELECT s_suppkey, nullif(s_nationkey, 7) nk, s_acctbal FROM supplier)"


def _join_query(name, f, sql):
    QUERIES[name] = (lambda spark, d: f(*_sides(spark, d)), f"WITH {CS} {sql}")


ON = "c.nk IS NOT DISTINCT FROM s.nk"
_join_query("left_join", lambda c, s: J.left_join(c, s, "nk"), f"SELECT c.*, s_suppkey, s_acctbal FROM c LEFT JOIN s ON {ON}")
_join_query("inner_join", lambda c, s: J.inner_join(c, s, "nk"), f"SELECT c.*, s_suppkey, s_acctbal FROM c JOIN s ON {ON}")
_join_query("outer_join_source", lambda c, s: J.outer_join(c, s, "nk", source="src"), f"SELECT c_custkey, coalesce(c.nk, s.nk) nk, c_mktsegment, s_suppkey, s_acctbal, CASE WHEN s_suppkey IS NULL THEN 'left' WHEN c_custkey IS NULL THEN 'right' ELSE 'both' END src FROM c FULL JOIN s ON {ON}")
_join_query("semi_join", lambda c, s: J.semi_join(c, s, "nk"), f"SELECT * FROM c WHERE EXISTS (SELECT 1 FROM s WHERE {ON})")
_join_query("anti_join", lambda c, s: J.anti_join(c, s, "nk"), f"SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE {ON})")
_join_query("contains_flag", lambda c, s: J.contains(c, s, "nk"), f"SELECT *, EXISTS (SELECT 1 FROM s WHERE {ON}) AS contains FROM c")
_join_query("multiple_match", lambda c, s: J.left_join_matches(c, s, "nk", "c_custkey"), f"SELECT c.*, s_suppkey, s_acctbal, count(*) OVER (PARTITION BY c_custkey) > 1 multiple_match FROM c LEFT JOIN s ON {ON}")
_join_query("left_join_unique", lambda c, s: J.left_join_unique(c, s.groupBy("nk").agg(F.max("s_suppkey").alias("top")), "nk"), "SELECT c.*, top FROM c LEFT JOIN (SELECT nk, max(s_suppkey) top FROM s GROUP BY 1) s ON c.nk IS NOT DISTINCT FROM s.nk")


def _ranges(spark, d):
    """Orders as points, parts as ranges of up to three days; those of the last days have open ends."""
    o = _table(spark, d, "orders").select("o_orderkey", "o_custkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t"))
    day = F.col("p_partkey") % 1990
    r = _table(spark, d, "part").select("p_partkey", "p_size", (F.lit(694224000) + day * 86400).alias("lo"), F.when(day < 1988, F.lit(694224000) + (day + F.col("p_size") % 4) * 86400).alias("hi"))
    return o, r


RSQL = "o AS (SELECT o_orderkey, o_custkey, CAST(epoch(o_orderdate) AS BIGINT) t FROM orders), r AS (SELECT p_partkey, p_size, 694224000 + p_partkey % 1990 * 86400 lo, CASE WHEN p_partkey % 1990 < 1988 THEN 694224000 + (p_partkey % 1990 + p_size % 4) * 86400 END hi FROM part)"


@query(f"WITH {RSQL} SELECT o_orderkey, o_custkey, t, p_partkey, p_size FROM o JOIN r ON t >= lo AND t < coalesce(hi, 9999999999)")
def range_join(spark, d):
    o, r = _ranges(spark, d)
    return J.range_join(o, r, None, "t", "lo", "hi", (False, True))


@query(f"WITH {RSQL} SELECT o_orderkey, o_custkey, t, p_size FROM o JOIN (SELECT p_partkey k, p_size, lo, hi FROM r) r ON o_custkey = k AND t >= lo AND (t <= hi OR hi IS NULL)")
def range_join_equal(spark, d):
    o, r = _ranges(spark, d)
    return J.range_join(o, r, [("o_custkey", "p_partkey")], "t", "lo", "hi")


@query(f"WITH {RSQL} SELECT o_orderkey, o_custkey, t, p_size FROM o JOIN r ON o_custkey = p_partkey AND t > lo")
def inequality_join(spark, d):
    o, r = _ranges(spark, d)
    return J.range_join(o, r.drop("hi"), [("o_custkey", "p_partkey")], "t", "lo", None, (True, False))


@query(f"WITH {RSQL} SELECT * FROM o WHERE EXISTS (SELECT 1 FROM r WHERE o_custkey = p_partkey AND t >= lo AND (t <= hi OR hi IS NULL))")
def range_semi_join(spark, d):
    o, r = _ranges(spark, d)
    return J.range_join(o, r, [("o_custkey", "p_partkey")], "t", "lo", "hi", how="left_semi")


def _asof(spark, d):
    e = _table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "t"), e.where("event_type = 'view'").select(F.col("event_id").alias("vid"), "user_id", "t", F.col("value").alias("vv"))


ASQL = "p AS (SELECT event_id, user_id, epoch_us(ts) t FROM events WHERE event_type = 'purchase'), w AS (SELECT event_id vid, user_id, epoch_us(ts) t, value vv FROM events WHERE event_type = 'view')"


def _asof_query(name, sql, **kw):
    def run(spark, d):
        a, b = _asof(spark, d)
        return J.close_join(a, b, "user_id", "t", ["event_id"], ["vid"], **kw)

    QUERIES[name] = (run, f"WITH {ASQL}, b AS (SELECT p.*, vid, vv, w.t wt FROM p ASOF LEFT JOIN w ON p.user_id = w.user_id AND p.t >= w.t), f AS (SELECT p.event_id, w.vid, w.vv, w.t wt FROM p ASOF LEFT JOIN w ON p.user_id = w.user_id AND p.t <= w.t) {sql}")


_asof_query("asof_backward", "SELECT event_id, user_id, t, vid, vv FROM b")
_asof_query("asof_forward", "SELECT p.event_id, user_id, t, vid, vv FROM p JOIN f USING (event_id)", direction="forward")
_asof_query("asof_nearest", "SELECT b.event_id, user_id, t, CASE WHEN f.vid IS NULL OR t - b.wt < f.wt - t THEN b.vid ELSE f.vid END vid, CASE WHEN f.vid IS NULL OR t - b.wt < f.wt - t THEN b.vv ELSE f.vv END vv FROM b JOIN f USING (event_id)", direction="nearest")
_asof_query("asof_border_nearest", "SELECT b.event_id, user_id, t, coalesce(b.vid, f.vid) vid, coalesce(b.vv, f.vv) vv FROM b JOIN f USING (event_id)", border="nearest")
_asof_query("asof_border_none", "SELECT b.event_id, user_id, t, CASE WHEN f.vid IS NOT NULL THEN b.vid END vid, CASE WHEN f.vid IS NOT NULL THEN b.vv END vv FROM b JOIN f USING (event_id)", border="none")
_asof_query("asof_tolerance", "SELECT event_id, user_id, t, CASE WHEN t - wt < 36000000000 THEN vid END vid, CASE WHEN t - wt < 36000000000 THEN vv END vv FROM b", tol=36_000_000_000)
_asof_query("asof_no_exact", "SELECT event_id, user_id, t, CASE WHEN wt != t THEN vid END vid, CASE WHEN wt != t THEN vv END vv FROM b", allow_exact_match=False)


def _update(spark, d, **kw):
    m = _table(spark, d, "customer").select("c_custkey", "c_nationkey", F.nullif(F.col("c_custkey") % 4, F.lit(0)).alias("x"), F.nullif(F.col("c_custkey") % 3, F.lit(0)).alias("y"))
    t = _table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"), F.nullif(F.col("s_suppkey") % 5, F.lit(0)).alias("x"), F.nullif(F.col("s_suppkey") % 2, F.lit(0)).alias("y"))
    return J.update(m, t, "c_nationkey", "s_suppkey", **kw)


USQL = "m AS (SELECT c_custkey, c_nationkey, nullif(c_custkey % 4, 0) x, nullif(c_custkey % 3, 0) y FROM customer), u AS (SELECT s_nationkey, nullif(s_suppkey % 5, 0) nx, nullif(s_suppkey % 2, 0) ny FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) = 1)"
QUERIES["update_missings"] = (lambda s, d: _update(s, d), f"WITH {USQL} SELECT c_custkey, c_nationkey, coalesce(x, nx) x, coalesce(y, ny) y FROM m LEFT JOIN u ON c_nationkey = s_nationkey")
QUERIES["update_all"] = (lambda s, d: _update(s, d, mode="all"), f"WITH {USQL} SELECT c_custkey, c_nationkey, coalesce(nx, x) x, coalesce(ny, y) y FROM m LEFT JOIN u ON c_nationkey = s_nationkey")
QUERIES["update_op"] = (lambda s, d: _update(s, d, op=lambda a, b: a + b), f"WITH {USQL} SELECT c_custkey, c_nationkey, CASE WHEN nx IS NOT NULL THEN x + nx ELSE x END x, CASE WHEN ny IS NOT NULL THEN y + ny ELSE y END y FROM m LEFT JOIN u ON c_nationkey = s_nationkey")


@query("""SELECT coalesce(a.k, b.k) k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN a.x IS NOT DISTINCT FROM b.y END "x=>y" FROM (SELECT c_custkey k, c_nationkey x FROM customer) a
 FULL JOIN (SELECT c_custkey + 50 k, c_nationkey y FROM customer) b ON a.k = b.k""")
def compare_on(spark, d):
    c = _table(spark, d, "customer")
    a, b = c.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("x")), c.select((F.col("c_custkey") + 50).alias("k"), F.col("c_nationkey").alias("y"))
    return J.compare(a, b, "k", [("x", "y")])


@query("""SELECT coalesce(a.n, b.n) obs_id, CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN abs(a.x - b.y) <= 500 END "c_acctbal=>s_acctbal" FROM (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) n, c_acctbal x FROM customer) a
 FULL JOIN (SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) n, s_acctbal y FROM supplier) b USING (n)""")
def compare_rows(spark, d):
    c, s = _table(spark, d, "customer"), _table(spark, d, "supplier")
    return J.compare_rows(c, s, ["c_acctbal", "c_custkey"], [("s_acctbal", True), "s_suppkey"], [("c_acctbal", "s_acctbal")], lambda a, b: F.abs(a - b) <= 500)


# reshape
TYPES = ["view", "click", "purchase", "signup", "error"]


@query("SELECT c_custkey, v AS _variables_, x AS _c1 FROM (SELECT c_custkey, unnest(['a', 'b']) v, unnest([c_nationkey, c_nationkey * 2]) x FROM customer)")
def stack_long(spark, d):
    return T.stack(_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("a"), (F.col("c_nationkey") * 2).alias("b")), ["c_custkey"], ["a", "b"])


@query("SELECT user_id, " + ", ".join(f"coalesce(CAST(sum(CASE WHEN event_type = '{t}' THEN 1 END) AS BIGINT), -1) AS {t}" for t in TYPES) + " FROM events GROUP BY 1")
def pivot_default(spark, d):
    n = _table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return T.pivot(n, ["user_id"], "event_type", "n", TYPES, default=-1)


@query("SELECT n_regionkey, 'n_nationkey' AS _variables_, " + ", ".join(f"max(CASE WHEN n = {k} THEN n_nationkey END) _c{k}" for k in range(1, 6)) + " FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) n FROM nation) GROUP BY 1")
def transpose_group_rows(spark, d):
    return T.rows_to_columns(_table(spark, d, "nation").select("n_regionkey", "n_nationkey"), ["n_regionkey"], ["n_nationkey"], ["n_nationkey"])


@query("SELECT vec_id, unnest(range(1, 65)) pos, unnest(embedding) x FROM embeddings")
def flatten_lists(spark, d):
    e = _table(spark, d, "embeddings").select("vec_id", F.sequence(F.lit(1), F.size("embedding")).cast("array<bigint>").alias("pos"), F.col("embedding").alias("x"))
    return T.flatten(e, ["pos", "x"])


@query("SELECT event_id, split_part(event_type, 'i', 1) a, nullif(split_part(event_type, 'i', 2), '') b FROM events")
def split_columns(spark, d):
    e = _table(spark, d, "events").select("event_id", F.split("event_type", "i").alias("p"))
    return T.split_into(e, "p", ["a", "b"]).select("event_id", "a", F.nullif("b", F.lit("")).alias("b"))


@query("SELECT n_nationkey, n_regionkey FROM nation, range(5) t(i) WHERE i < n_regionkey")
def repeat_freq(spark, d):
    return T.repeat(_table(spark, d, "nation").select("n_nationkey", "n_regionkey"), freq="n_regionkey")


# sets and order
UNI = {"first": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1", "last": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1", "none": "SELECT event_id, user_id, event_type FROM events QUALIFY count(*) OVER (PARTITION BY user_id, event_type) = 1", "only": "SELECT event_id, user_id, event_type FROM events QUALIFY count(*) OVER (PARTITION BY user_id, event_type) > 1"}
for _k, _sql in UNI.items():
    QUERIES[f"unique_{_k}"] = (lambda s, d, k=_k: S.unique(_table(s, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"], k), _sql)


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 duplicate FROM events")
def duplicates_flag(spark, d):
    return S.duplicates(_table(spark, d, "events").select("event_id", "user_id"), ["user_id"], ["event_id"]).select("event_id", "duplicate")


@query("SELECT n_name AS name, n_nationkey AS nk, NULL::INT AS rk, 1 AS src FROM nation UNION ALL SELECT r_name, NULL, r_regionkey, 2 FROM region")
def vcat_union(spark, d):
    n = _table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nk"))
    r = _table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("rk"))
    return S.vcat([n, r], "union", "src")


@query("SELECT event_id, row_number() OVER (ORDER BY ts) row_id FROM events")
def row_positions(spark, d):
    return S.row_ids(_table(spark, d, "events").select("event_id", "ts"), "ts").select("event_id", "row_id")


@query(f"WITH {LINE} SELECT {K}, ln FROM line")
def sort_nulls_last(spark, d):
    return Frame(_line(spark, d)).sort(["ln", *KEYS], rev=[True] + [False] * 4).select([*KEYS, "ln"]).df


@query("SELECT count(*) c, event_id FROM events WHERE event_id > 100 GROUP BY 2")
def delete_positions(spark, d):
    return S.delete_at(_table(spark, d, "events").select("event_id"), "event_id", [i + 1 for i in range(101)]).groupBy("event_id").agg(F.count("*").alias("c"))


# formats
@query("SELECT min(o_orderdate) o_orderdate, count(*) length_o_totalprice, max(o_totalprice) maximum_o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) FROM orders) GROUP BY year(o_orderdate)")
def group_formatted(spark, d):
    f = Frame(_table(spark, d, "orders")).with_order("o_orderdate", "o_orderkey").set_format(o_orderdate=F.year).groupby("o_orderdate")
    return f.combine(("o_totalprice", [A.length, A.maximum])).df


@query("SELECT o_orderkey, o_orderdate, label FROM orders LEFT JOIN (SELECT 1995 y, 'mid' AS label UNION ALL SELECT 1997, 'late') t ON year(o_orderdate) = y")
def join_formatted(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    r = spark.sql("SELECT * FROM VALUES (1995, 'mid'), (1997, 'late') AS t(y, label)")
    return J.left_join(o, r, [("o_orderdate", "y")], formats={"left": {"o_orderdate": F.year}})


# more of the same surface
@query(f"WITH {CS} SELECT c_custkey obs_id_left, c.nk, c_mktsegment, s_suppkey obs_id_right, s_acctbal FROM c LEFT JOIN s ON {ON}")
def obs_ids(spark, d):
    c, s = _sides(spark, d)
    return J.with_obs_ids(c, s, "nk", "c_custkey", "s_suppkey")


@query("SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS position FROM events")
def sort_permutation(spark, d):
    return S.sort_permutation(_table(spark, d, "events"), "value", "event_id", desc=True)


@query("SELECT 'n_regionkey' AS _variables_, " + ", ".join(f'max(CASE WHEN n_nationkey = {k} THEN n_regionkey END) AS "{k}"' for k in range(25)) + " FROM nation UNION ALL SELECT 'size', " + ", ".join(f"max(CASE WHEN n_nationkey = {k} THEN length(n_name) END)" for k in range(25)) + " FROM nation")
def transpose_rows(spark, d):
    return T.transpose(_table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.length("n_name").alias("size")), ["n_regionkey", "size"], "n_nationkey")


@query("SELECT 'R_NAME' AS _variables_, " + ", ".join(f"max(CASE WHEN n = {k} THEN r_name END) AS col_c{k}" for k in range(1, 6)) + " FROM (SELECT r_name, row_number() OVER (ORDER BY r_name DESC) n FROM region)")
def transpose_places(spark, d):
    return T.transpose(_table(spark, d, "region").select("r_name"), ["r_name"], order=[("r_name", True)], rename=lambda n: f"col{n}", rename_row=str.upper)


@query("SELECT user_id, " + ", ".join(f"min(CASE WHEN event_type = '{t}' THEN event_id END) AS {t}, max(CASE WHEN event_type = '{t}' THEN value END) AS {t}_1" for t in TYPES) + " FROM events GROUP BY 1")
def pivot_many(spark, d):
    e = _table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"), F.max("value").alias("top"))
    return T.pivot_many(e, ["user_id"], "event_type", ["first", "top"], TYPES)


@query("SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{t}' THEN n END) AS {t}" for t in TYPES) + " FROM (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1, 2) GROUP BY 1")
def pivot_found_ids(spark, d):
    n = _table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return T.pivot(n, ["user_id"], "event_type", "n")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 100, NULL FROM region UNION ALL SELECT 999, 'extra'")
def append_rows(spark, d):
    n = _table(spark, d, "nation").select("n_nationkey", "n_name")
    r = _table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"))
    return S.push(S.append(n, r, "subset"), {"n_nationkey": 999, "n_name": "extra"})


@query("SELECT user_id, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) AS spread FROM events GROUP BY 1")
def agg_user_function(spark, d):
    import numpy as np

    f = A.user(lambda x: float(np.quantile(x, 0.9) - np.quantile(x, 0.1)))
    return _table(spark, d, "events").groupBy("user_id").agg(f("value").alias("s")).select("user_id", F.round("s", 6).alias("spread"))


@query("SELECT user_id, pos, value AS top FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) - 1 AS pos FROM events) WHERE pos < 4")
def combine_vector_result(spark, d):
    got = Frame(_table(spark, d, "events")).groupby("user_id").combine(("value", lambda c: A.topk(c, 4), "t"))
    return got.df.select("user_id", F.posexplode("t").alias("pos", "top")).select("user_id", F.col("pos").cast("long").alias("pos"), "top")


@query("SELECT l_returnflag, round(sum(q * di), 2) AS w, min(q) lo, max(q) hi FROM (SELECT l_returnflag, nullif(l_quantity, 10.0) q, CAST(round(l_discount * 100) AS INT) di FROM lineitem) GROUP BY 1")
def agg_wsum_extrema(spark, d):
    got = _line(spark, d).groupBy("l_returnflag").agg(F.round(A.wsum("q", "di"), 2).alias("w"), A.extrema("q").alias("e"))
    return got.select("l_returnflag", "w", F.col("e.min").alias("lo"), F.col("e.max").alias("hi"))


@query("SELECT max(c_acctbal) c_acctbal, CAST(sum(c_nationkey) AS BIGINT) c_nationkey FROM customer")
def mapcols_scalar(spark, d):
    return Frame(_table(spark, d, "customer")).map_cols([A.maximum, A.sum_], ["c_acctbal", "c_nationkey"]).df


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS start, count(*) n FROM events GROUP BY 1, 2")
def window_by_day(spark, d):
    e = _table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return windowed(e, "t", "1 day", "1 day", ["event_type"], F.count("*").alias("n")).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY c_custkey) = 5 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def set_cell(spark, d):
    c = S.row_ids(_table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "_row")
    return c.select("c_custkey", F.when(F.col("_row") == 5, 0.0).otherwise(F.col("c_acctbal")).alias("c_acctbal"))


@query("SELECT l_orderkey * 2 + 1 AS l_orderkey, l_partkey * 2 + 1 AS l_partkey FROM lineitem")
def broadcast_arithmetic(spark, d):
    return Frame(_table(spark, d, "lineitem").select("l_orderkey", "l_partkey")).map(lambda c: c * 2 + 1).df


@query("SELECT p_partkey, nullif(rtrim(substr(p_brand, 1, 6)), '') AS brand, rtrim(p_type) = rtrim(p_type || '  ') AS same FROM part")
def fixed_width_text(spark, d):
    from tessera.sources.io import fixed_width

    p = _table(spark, d, "part")
    return p.select("p_partkey", fixed_width(F.col("p_brand"), 6).alias("brand"), (fixed_width(F.col("p_type")) == fixed_width(F.concat("p_type", F.lit("  ")))).alias("same"))


@query("""SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice < 100000) + 1 AS first_at, count(*) FILTER (WHERE o_totalprice <= 100000) AS last_at
 FROM orders GROUP BY 1""")
def search_sorted(spark, d):
    x = F.lit(100000.0)
    at = [F.col("o_totalprice")]
    return _table(spark, d, "orders").groupBy("o_orderstatus").agg(A.search_first(*at, x).alias("first_at"), A.search_last(*at, x).alias("last_at"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def last_rows(spark, d):
    return Frame(_table(spark, d, "events")).with_order("ts", "event_id").tail(25).select(["event_id", "ts", "event_type"]).df


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT NULL, NULL FROM range(3)")
def resize_grow(spark, d):
    r = _table(spark, d, "region")
    return S.resize(r, "r_regionkey", 8).select("r_regionkey", "r_name")


# Ranges of one width: the nearest one that starts before a price ends last, so SQL needs one as-of match. Dear ones are open.
_HIGH = "(SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS lo, CASE WHEN o_totalprice <= 400000 THEN CAST(o_totalprice AS DOUBLE) + 5.0 END AS hi FROM orders)"
_IN_HIGH = f"coalesce(x < hi, lo IS NOT NULL) OR x >= coalesce((SELECT min(lo) FROM {_HIGH} WHERE hi IS NULL), 1e300)"
_LINES = "(SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem)"


def _price_ranges(spark, d):
    price = F.col("o_totalprice").cast("double")
    r = _table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), price.alias("lo"), F.when(price <= 400000, price + 5.0).alias("hi"))
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("x")), r


@query(f"SELECT l_orderkey, l_linenumber FROM {_LINES} l ASOF LEFT JOIN {_HIGH} r ON l.x >= r.lo WHERE {_IN_HIGH}")
def semi_join_range(spark, d):
    return J.range_join(*_price_ranges(spark, d), None, "x", "lo", "hi", (False, True), how="left_semi").select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber FROM {_LINES} l ASOF LEFT JOIN {_HIGH} r ON l.x >= r.lo WHERE NOT ({_IN_HIGH})")
def anti_join_range(spark, d):
    return J.range_join(*_price_ranges(spark, d), None, "x", "lo", "hi", (False, True), how="left_anti").select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber, {_IN_HIGH} AS cheap FROM {_LINES} l ASOF LEFT JOIN {_HIGH} r ON l.x >= r.lo")
def contains_range(spark, d):
    return J.contains(*_price_ranges(spark, d), [("x", ("lo", "hi"))], "cheap", (False, True)).select("l_orderkey", "l_linenumber", "cheap")


@query("SELECT c_custkey, c_acctbal > (SELECT min(s_acctbal) FROM supplier) AS above FROM customer")
def contains_one_sided(spark, d):
    c = _table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return J.contains(c, _table(spark, d, "supplier"), [("c_acctbal", ("s_acctbal", None))], "above", (True, False)).select("c_custkey", "above")


@query("SELECT c_custkey, s_suppkey, s_acctbal FROM customer JOIN supplier ON c_acctbal <= s_acctbal AND s_acctbal > 9900")
def inequality_join_keyless(spark, d):
    c, s = _table(spark, d, "customer").select("c_custkey", "c_acctbal"), _table(spark, d, "supplier").select("s_suppkey", "s_acctbal").where("s_acctbal > 9900")
    return J.range_join(c, s, None, "c_acctbal", None, "s_acctbal", droprangecols=False).drop("c_acctbal")


@query("""SELECT event_id, CAST(sum(user_id) OVER w AS BIGINT) AS s, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events
 WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_whole_table(spark, d):
    e = _table(spark, d, "events").select("event_id", "user_id", "value")
    for col, how, name in (("user_id", "sum", "s"), ("value", "min", "lo"), ("value", "max", "hi")):
        e = S.running(e, col, "event_id", how, name)
    return e.select("event_id", "s", "lo", "hi")


@query("""SELECT event_id, CAST(sum(c) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM
 (SELECT event_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AND row_number() OVER (ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS c FROM events)""")
def run_ids(spark, d):
    return S.runs(_table(spark, d, "events"), [F.col("event_type")], "event_id", "run").select("event_id", "run")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def topk_rows_of_groups(spark, d):
    return S.top_rows(_table(spark, d, "events"), ["user_id"], "value", 3, ["event_id"]).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events) WHERE n <= 2")
def topk_positions(spark, d):
    return Frame(_table(spark, d, "events")).groupby("user_id").combine_rows(("value", lambda c: A.topkperm(c, "event_id", 2, rev=True), "event_id")).df


@query("SELECT c_custkey, c_acctbal FROM (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) WHERE n BETWEEN 11 AND 30")
def slice_of_rows(spark, d):
    return S.slice_rows(_table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 11, 30)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT max(n_nationkey) FROM nation UNION ALL SELECT min(n_nationkey) FROM nation)")
def pop_both_ends(spark, d):
    n = _table(spark, d, "nation").select("n_nationkey", "n_name")
    return S.pop(S.pop(n, "n_nationkey"), "n_nationkey", first=True)


@query("SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY p_partkey) IN (1, 4) THEN 'none' ELSE p_name END AS p_name FROM part")
def set_cells_at(spark, d):
    return S.set_at(_table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", [1, 4], p_name="none")


# the rest of the surface, each on whole tables
@query("""SELECT 1 + i AS obs_id, o_orderkey, c_custkey FROM (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 i, o_orderkey FROM orders) JOIN (SELECT row_number() OVER (ORDER BY c_name DESC) - 1 i, c_custkey FROM customer) USING (i)""")
def hcat_by_place(spark, d):
    o, c = _table(spark, d, "orders").select("o_totalprice", "o_orderkey"), _table(spark, d, "customer").select("c_name", "c_custkey")
    got = S.hcat(o, c, ["o_totalprice", "o_orderkey"], ("c_name", True))
    return S.row_ids(got, ["o_totalprice", "o_orderkey"], "obs_id").select("obs_id", "o_orderkey", "c_custkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC, c_name) AS position FROM customer")
def sort_permutation_of_text(spark, d):
    return S.sort_permutation(_table(spark, d, "customer"), [("c_mktsegment", True), "c_name"], "c_custkey")


@query(f"WITH {LINE}, t AS (SELECT {K}, row_number() OVER (ORDER BY tax DESC NULLS FIRST, l_returnflag, {K}, l_extendedprice) n FROM line) SELECT {K} FROM t WHERE n BETWEEN 501 AND 900")
def slice_of_nullable_text_order(spark, d):
    return S.slice_rows(_line(spark, d), [("tax", True), "l_returnflag", *KEYS, "l_extendedprice"], 501, 900).select(*KEYS)


@query("SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name) n FROM customer) JOIN (SELECT unnest([3, 1, 3, 40]) n) USING (n)")
def take_rows(spark, d):
    return S.take_rows(_table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", [3, 1, 3, 40])


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) n FROM part) WHERE n IN (2, 5, 9)")
def delete_all_but(spark, d):
    return S.delete_at(_table(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], Not([2, 5, 9])).select("p_partkey")


@query("""SELECT (SELECT bool_and(coalesce(p <= s, true)) FROM (SELECT o_orderstatus s, lag(o_orderstatus) OVER (ORDER BY o_orderstatus, o_orderkey) p FROM orders)) AS by_status,
 (SELECT bool_and(coalesce(p <= s, true)) FROM (SELECT o_orderpriority s, lag(o_orderpriority) OVER (ORDER BY o_orderkey) p FROM orders)) AS by_priority""")
def is_sorted_text(spark, d):
    o = Frame(_table(spark, d, "orders"))
    return spark.createDataFrame([(o.with_order("o_orderstatus", "o_orderkey").is_sorted("o_orderstatus"), o.with_order("o_orderkey").is_sorted("o_orderpriority"))], "by_status boolean, by_priority boolean")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def unsort_rows(spark, d):
    return Frame(_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")).with_order("o_orderkey").sort("o_orderstatus", rev=True).unsort().df


@query("SELECT 'c_acctbal' AS \"column\", round(sum(c_acctbal), 2) AS \"sum\" FROM customer UNION ALL SELECT 'rich', sum(CAST(c_acctbal > 5000 AS INT)) FROM customer")
def sum_all_columns(spark, d):
    c = _table(spark, d, "customer").select("c_acctbal", (F.col("c_acctbal") > 5000).alias("rich"))
    return Frame(c).sum_all().map(lambda x: F.round(x, 2), "sum").df


@query(f"WITH {LINE} SELECT l_returnflag, CAST(sum(CAST(q > 20 AS INT)) AS BIGINT) AS sum_b, round(avg(CAST(q > 20 AS INT)), 6) AS mean_b FROM line GROUP BY 1")
def sum_of_booleans(spark, d):
    f = Frame(_line(spark, d).withColumn("b", F.col("q") > 20)).groupby("l_returnflag").combine(("b", [A.sum_, A.mean]))
    return f.map(lambda c: F.round(c, 6), "mean_b").df


@query(f"WITH {LINE} SELECT {K}, CAST(coalesce(CAST(q > 20 AS INT), 0) + coalesce(CAST(tax > 0.04 AS INT), 0) AS INT) AS s FROM line WHERE q IS NOT NULL OR tax IS NOT NULL")
def byrow_sum_of_booleans(spark, d):
    f = Frame(_line(spark, d).select(*KEYS, (F.col("q") > 20).alias("a"), (F.col("tax") > 0.04).alias("b")))
    return f.byrow(R.row_sum, ["a", "b"], "s").filter("s", lambda c: c.isNotNull()).select([*KEYS, "s"]).df


@query(f"WITH {LINE} SELECT {K}, coalesce(CAST(CAST(q > 20 AS INT) AS VARCHAR), '') || '|' || CAST(di = 5 AS INT) || '|' || l_returnflag AS j FROM line")
def byrow_join_of_booleans(spark, d):
    flags = [F.col("q") > 20, F.col("di") == 5, "l_returnflag"]
    return _line(spark, d).select(*KEYS, R.row_join(flags, "|").alias("j"))


@query(f"WITH {LINE} SELECT l_suppkey, count(DISTINCT (coalesce(ln, -1), coalesce(di, -1), coalesce(tax, -1))) AS n FROM line GROUP BY 1")
def row_hash_distinct(spark, d):
    """Rows that differ in the place of a null have different hashes."""
    return _line(spark, d).groupBy("l_suppkey").agg(F.countDistinct(R.row_hash(["ln", "di", "tax"])).alias("n"))


@query("SELECT true AS same, false AS other")
def table_hashes(spark, d):
    t = _table(spark, d, "customer")
    null = lambda a, b: t.select(F.when(F.col("c_custkey") > 0, F.lit(a)).cast("long").alias("x"), F.lit(b).cast("long").alias("y"))
    same = S.table_hash(t) == S.table_hash(t.orderBy(F.desc("c_name")))
    return spark.createDataFrame([(same, S.table_hash(null(None, 1)) == S.table_hash(null(1, None)))], "same boolean, other boolean")


@query(f"WITH {LINE} SELECT {K}, CAST(ln AS VARCHAR) ln, CAST(q AS BIGINT) q FROM line")
def cast_columns(spark, d):
    return Frame(_line(spark, d).select(*KEYS, "ln", "q")).cast("string", "ln").cast("long", "q").df


@query("SELECT l_orderkey, l_partkey, CAST(l_linenumber * 2 + CAST(l_quantity AS INT) AS DOUBLE) AS a, l_linenumber * l_quantity AS b FROM lineitem")
def byrow_any_function(spark, d):
    t = _table(spark, d, "lineitem")
    f = R.row_apply(["l_linenumber", "l_quantity"], lambda r: 2.0 * r[0] + r[1])
    return t.select("l_orderkey", "l_partkey", f.alias("a"), R.row_call(lambda a, b: a * b, ["l_linenumber", "l_quantity"]).alias("b"))


@query(f"WITH {LINE} SELECT {K} FROM line WHERE ln IS NOT NULL AND ln < di")
def filter_by_row_operator(spark, d):
    return Frame(_line(spark, d)).filter(["ln"], type=lambda c: R.row_isless(c, "di"), missings=False).select(KEYS).df


@query(f"WITH {LINE} SELECT {K}, CASE WHEN ln = di THEN 'ln' WHEN l_linenumber = di THEN 'l_linenumber' END AS f, coalesce(ln + 1 < di, false) AS l FROM line")
def byrow_find_item(spark, d):
    return _line(spark, d).select(*KEYS, R.row_findfirst(["ln", "l_linenumber"], item="di").alias("f"), R.row_isless(["ln"], "di", lt=lambda a, b: a + 1 < b).alias("l"))


@query("SELECT user_id, min(value) lo, arg_min(event_id, (value, event_id)) first_at FROM events GROUP BY 1")
def agg_findmin(spark, d):
    got = _table(spark, d, "events").groupBy("user_id").agg(A.findmin("value", "event_id").alias("f"))
    return got.select("user_id", F.col("f.value").alias("lo"), F.col("f.index").alias("first_at"))


@query("""WITH t AS (SELECT user_id, event_type, nullif(event_type, 'view') v FROM events), r AS (SELECT user_id, event_type, v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY v DESC) n FROM t)
 SELECT user_id, event_type, v AS top FROM r WHERE n <= 2 AND (v IS NOT NULL OR n = 1)""")
def topk_text_and_nulls(spark, d):
    """A group of nulls gives one null; text has an order too."""
    e = _table(spark, d, "events").withColumn("v", F.nullif("event_type", F.lit("view")))
    return Frame(e).groupby(["user_id", "event_type"]).combine_rows(("v", lambda c: A.topk(c, 2), "top")).df


@query("""SELECT user_id, hi, n, v, v * 2 AS twice FROM (SELECT user_id, value v, max(value) OVER (PARTITION BY user_id) hi, count(*) OVER (PARTITION BY user_id) n, row_number() OVER (PARTITION BY user_id ORDER BY value) k FROM events) WHERE k <= 3""")
def combine_mixed_results(spark, d):
    """Lists beside scalars, which repeat; a row function over the result."""
    f = Frame(_table(spark, d, "events")).groupby("user_id")
    return f.combine_rows(("value", A.maximum, "hi"), ("value", A.length, "n"), ("value", lambda c: A.topk(c, 3, rev=True), "v"), (["v"], byrow(lambda c: F.col(c[0]) * 2), "twice")).df


@query("SELECT user_id, event_type, count(*) n, max(value) hi FROM events GROUP BY 1, 2")
def groupby_then_by(spark, d):
    return Frame(_table(spark, d, "events")).groupby("user_id", rev=True).then_by("event_type").combine(("value", A.n, "n"), ("value", A.maximum, "hi"), arrange=True).df


@query("SELECT c_custkey, c_nationkey FROM customer")
def groupby_arranged(spark, d):
    return Frame(_table(spark, d, "customer").select("c_custkey", "c_nationkey")).with_order("c_custkey").groupby("c_nationkey", rev=True).arranged().df


@query("SELECT row_number() OVER (ORDER BY c_name) AS run_id, c_acctbal AS maximum_c_acctbal FROM customer")
def gatherby_each_row(spark, d):
    return Frame(_table(spark, d, "customer")).with_order("c_name").gatherby(eachrow=True).combine(("c_acctbal", A.maximum)).df


@query("SELECT user_id, event_type, count(*) n FROM events GROUP BY 1, 2")
def apply_to_groups(spark, d):
    import pandas as pd

    count = lambda p: pd.DataFrame({"user_id": [p.user_id.iloc[0]], "event_type": [p.event_type.iloc[0]], "n": [len(p)]})
    return Frame(_table(spark, d, "events").select("user_id", "event_type")).groupby(["user_id", "event_type"]).apply_groups(count, "user_id long, event_type string, n long").df


@query(f"WITH {ESQL} SELECT event_id, x + 1 AS x, CAST(sum(x) OVER ({EV}) AS BIGINT) AS sum_x, CAST(sum(v) OVER ({EV}) AS BIGINT) AS sum_v, split_part(event_type, 'i', 1) AS a, CASE WHEN contains(event_type, 'i') THEN split_part(event_type, 'i', 2) END AS b FROM e")
def modify_many(spark, d):
    """One function over several columns, and a list split into columns."""
    f = _events(spark, d)
    run = lambda c: lambda g, o: WN.cumsum(c, "ignore", g, o)
    got = f.modify((["x", "v"], run, lambda c: f"sum_{c}"), ("x", lambda c: F.col(c) + 1), ("event_type", lambda c: F.split(c, "i"), ["a", "b"]))
    return got.select(["event_id", "x", "sum_x", "sum_v", "a", "b"]).df


@query("""SELECT 'c_custkey' AS "column", CAST(count(c_custkey) AS DOUBLE) n, 0.0::DOUBLE nmissing, round(avg(c_custkey), 6) mean, CAST(min(c_custkey) AS VARCHAR) minimum, CAST(max(c_custkey) AS VARCHAR) maximum FROM customer
 UNION ALL SELECT 'seg', count(nullif(c_mktsegment, 'BUILDING')), count(*) - count(nullif(c_mktsegment, 'BUILDING')), NULL, min(nullif(c_mktsegment, 'BUILDING')), max(nullif(c_mktsegment, 'BUILDING')) FROM customer""")
def describe_text(spark, d):
    c = _table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    got = Frame(c).describe(fns=[A.n, A.nmissing, A.mean, A.minimum, A.maximum]).df
    return got.withColumn("mean", F.round("mean", 6))


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN y IS NULL THEN 'left' WHEN o_orderkey IS NULL THEN 'right' ELSE 'both' END AS src
 FROM orders FULL JOIN (SELECT unnest([1993, 1995, 1997, 1901]) AS y) ON year(o_orderdate) = y""")
def outer_join_formatted(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    r = spark.sql("SELECT * FROM VALUES (timestamp_ntz'1993-05-05'), (timestamp_ntz'1995-01-01'), (timestamp_ntz'1997-01-01'), (timestamp_ntz'1901-01-01') AS t(y)")
    got = J.outer_join(o, r, [("o_orderdate", "y")], "src", {"left": {"o_orderdate": F.year}, "right": {"y": F.year}})
    return got.select("o_orderkey", "o_orderstatus", "src")


@query("SELECT o_orderkey, year(o_orderdate) IN (1994, 1996) AS listed FROM orders WHERE year(o_orderdate) NOT IN (1995)")
def semi_anti_formatted(spark, d):
    o, f = _table(spark, d, "orders").select("o_orderkey", "o_orderdate"), {"left": {"o_orderdate": F.year}}
    year = lambda *ys: spark.createDataFrame([(y,) for y in ys], "o_orderdate int")
    left = J.anti_join(J.semi_join(o, year(*range(1980, 2010)), "o_orderdate", f), year(1995), "o_orderdate", f)
    return J.contains(left, year(1994, 1996), "o_orderdate", "listed", formats=f).select("o_orderkey", "listed")


@query("""SELECT c_custkey, s_suppkey, s_acctbal FROM (SELECT c_custkey, c_acctbal FROM customer) c ASOF LEFT JOIN (SELECT max(s_suppkey) s_suppkey, s_acctbal FROM supplier GROUP BY s_acctbal) s ON c_acctbal >= s_acctbal""")
def asof_without_equal_keys(spark, d):
    c, s = _table(spark, d, "customer").select("c_custkey", "c_acctbal"), _table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_acctbal").alias("at"))
    return J.close_join(c, s, None, "c_acctbal", ["c_custkey"], ["s_suppkey"], right_key="at").drop("c_acctbal")


@query(f"WITH {ASQL} SELECT p.event_id obs_id_left, user_id, t, vid obs_id_right FROM p ASOF LEFT JOIN w USING (user_id, t)".replace("ASOF LEFT JOIN w USING (user_id, t)", "ASOF LEFT JOIN (SELECT vid, user_id u, t wt FROM w) w ON user_id = u AND t >= wt"))
def asof_obs_ids(spark, d):
    a, b = _asof(spark, d)
    how = {"equal": "user_id", "key": "t", "order_left": ["event_id"], "order_right": ["vid"]}
    return J.with_obs_ids(a, b.drop("vv"), how, "event_id", "vid", "close")


@query("SELECT event_id, row_number() OVER w > 1 AS f, row_number() OVER z > 1 AS l, count(*) OVER (PARTITION BY user_id, event_type) > 1 AS n, (row_number() OVER w > 1) != (row_number() OVER z > 1) AS x FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id), z AS (PARTITION BY user_id, event_type ORDER BY event_id DESC)")
def duplicates_kinds(spark, d):
    e = _table(spark, d, "events").select("event_id", "user_id", "event_type")
    for leave, name in (("first", "f"), ("last", "l"), ("none", "n"), ("xor", "x")):
        e = S.duplicates(e, ["user_id", "event_type"], ["event_id"], leave, name)
    return e.drop("user_id", "event_type")


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def vcat_intersect(spark, d):
    n = _table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return S.vcat([n, _table(spark, d, "region").select(F.col("r_regionkey").alias("k"), "r_name")], "intersect")


@query("SELECT CAST(n_nationkey AS DOUBLE) AS k, n_name, NULL AS extra FROM nation UNION ALL SELECT s_acctbal, NULL, s_name FROM supplier")
def append_promoted(spark, d):
    n = _table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return S.append(n, _table(spark, d, "supplier").select(F.col("s_acctbal").alias("k"), F.col("s_name").alias("extra")), "union", promote=True)


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT min(r_regionkey) - 1, 'first' FROM region")
def push_first(spark, d):
    return S.push(_table(spark, d, "region").select("r_regionkey", "r_name"), (0, "first"), first="r_regionkey")


@query("SELECT n_nationkey FROM nation, range(6)")
def repeat_inner_outer(spark, d):
    return T.repeat(_table(spark, d, "nation").select("n_nationkey"), inner=2, outer=3)


@query("SELECT user_id, " + ", ".join(f"CAST(sum(CASE WHEN event_type = '{t}' AND value {op} 50 THEN 1 END) AS BIGINT) AS \"({t}, {v})\"" for t in ("click", "view") for op, v in ((">=", "true"), ("<", "false"))) + " FROM events GROUP BY 1")
def pivot_by_two_ids(spark, d):
    n = _table(spark, d, "events").withColumn("high", F.col("value") >= 50).groupBy("user_id", "event_type", "high").agg(F.count("*").alias("n"))
    return T.pivot(n, ["user_id"], ["event_type", "high"], "n", [(t, v) for t in ("click", "view") for v in ("true", "false")])


@query("SELECT s_suppkey, s_suppkey || ',\"' || replace(s_name || ' \"q\"', '\"', '\"\"') || '\",' || CAST(s_nationkey > 10 AS INT) AS line FROM supplier")
def text_of_rows(spark, d):
    s = _table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(' "q"')).alias("n"), (F.col("s_nationkey") > 10).alias("b"))
    return io.text_rows(Frame(s)).select(F.split("line", ",")[0].cast("long").alias("s_suppkey"), "line")


@query("SELECT n_nationkey, [CAST(n_nationkey AS DOUBLE), n_regionkey * 0.5] AS m FROM nation".replace("n_nationkey, [", "n_nationkey, list_sum(["). replace("0.5]", "0.5])"))
def columns_as_array(spark, d):
    n = _table(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") * 0.5).alias("h"))
    return io.as_array(Frame(n), "a").df.select("n_nationkey", F.aggregate("a", F.lit(0.0), lambda s, x: s + x).alias("m"))


@query("SELECT c_custkey + 1 AS c_custkey, c_acctbal - 0.5 AS c_acctbal FROM customer")
def broadcast_by_column(spark, d):
    return Frame(_table(spark, d, "customer").select("c_custkey", "c_acctbal")).broadcast(lambda a, b: a + b, [1, -0.5]).df


@query("SELECT a.n_nationkey + b.r_regionkey AS n_nationkey FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) i FROM nation) a JOIN (SELECT r_regionkey, row_number() OVER (ORDER BY r_name DESC) i FROM region) b USING (i)")
def broadcast_of_tables(spark, d):
    n = S.row_ids(_table(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", "i")
    r = S.row_ids(_table(spark, d, "region").select("r_regionkey", "r_name"), ("r_name", True), "j")
    got = n.join(r, F.col("i") == F.col("j")).select("i", "n_nationkey", "r_regionkey")
    a, b = (Frame(got.select(c, "i")).with_order("i") for c in ("n_nationkey", "r_regionkey"))
    return a.broadcast(lambda x, y: x + y, b).select("n_nationkey").df


@query("SELECT r_regionkey, r_name, [10, 20, 30, 40, 50][row_number() OVER (ORDER BY r_regionkey)] AS v FROM region")
def insert_vector(spark, d):
    return Frame(_table(spark, d, "region").select("r_regionkey", "r_name")).with_order("r_regionkey").insert_cols(3, v=[10, 20, 30, 40, 50]).df


@query("SELECT p_partkey, CASE WHEN n <= 25 THEN (SELECT n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) k FROM nation) WHERE k = n) ELSE p_name END AS p_name FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) n FROM part)")
def set_block(spark, d):
    n = _table(spark, d, "nation").select(F.col("n_name").alias("p_name"))
    return S.set_block(_table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", range(1, 26), n, "p_name")


@query("SELECT o_orderkey, o_totalprice - avg(o_totalprice) OVER () > 0 AS o_totalprice FROM orders")
def mapcols_to_columns(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    mean = Frame(o).stat(A.mean, "o_totalprice")
    return Frame(o).map_cols([lambda c: c, lambda c: c - mean > 0], scalar=False).df
