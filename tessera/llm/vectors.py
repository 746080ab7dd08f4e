"""Embedding near-duplicates through a robust-pruned flat graph built on overlapping cluster shards.

1. Equal vectors collapse into a class with a weight; its smallest id stands for it.
2. Dense groups come off first. A pivot is the mean of a group that shows in the sample (GROUP members or
   more); classes within half the angle of a pivot all link with each other, so they are counted by weight and
   no pair is formed. Classes outside such a ball but near enough to reach into it are compared with its members
   exactly, in chunks of both. All that follows concerns the other classes.
3. Centroids are fitted on the sample; a class goes to the shards of its nearest centroids, to as many as
   TARGET_MET of planted partners at the least cosine need to share a shard with their class (planted on AUDIT
   classes, so data without links are measured too). A shard above SHARD_CAP classes is dealt into chunks, and
   every pair of its chunks is a task, so no task holds more than two chunks and no pair of the shard is lost.
4. Each shard keeps for every class its nearest candidates after robust pruning (a candidate is dropped
   when a kept one is ALPHA times nearer to it). Lists of all shards are united.
5. In its shards, each class is searched in the united graph: greedy from the shard's medoids with a beam,
   then range expansion from everything in range (and the class's own node) until nothing new is in range.
6. Beyond its shards, the expansion goes on: from what is in range of a class along the united lists of those,
   round by round, to classes that share no shard with it.
7. Each hit is verified by cosine in double precision. A pair that meets in several shards is counted in
   the first of them. Recall is audited against brute force over all classes of step 3, on blocks of AUDIT query
   classes until LEAST_UNITS of them are linked: the lesser of the share of links and the mean over query classes
   that have links, those linked with each other counted once. Below TARGET the number of shards for each class
   doubles and steps 3 to 6 run again; when that reaches all shards, every pair is compared instead. Without a
   linked query, the planted partners alone vouch for the links, and a warning says so.

There are as many shards as hold SHARD classes each, and the square root of the classes at most, so centroids
(broadcast) and the sample (SAMPLE classes, eight for each shard at least) grow with the root of the table.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
vectors of different lengths never link; a repeated row is one more vector (it links with its copies);
rows that share an id but not the vector are vectors of their own; a null id is kept and links with nothing;
an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import components, read_table, stage

SAMPLE = 20_000
GROUP = 32
SHARD = 512
SHARD_CAP = 2048
PROBES = 2
CANDIDATES = 32
DEGREE = 12
ALPHA = 1.2
BEAM = 16
AUDIT = 2048
AUDIT_BLOCKS = 4
LEAST_UNITS = 30
TARGET = 0.98
TARGET_MET = 0.99

LOG = logging.getLogger(__name__)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix_of(col: pa.Array) -> np.ndarray:
    n, col = len(col), col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten()).reshape(n, -1) if n else np.zeros((0, 1))


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(1))
        c[norm > 1e-9] = sums[norm > 1e-9] / norm[norm > 1e-9, None]
    return c


def pruned_lists(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each row after robust pruning of its nearest candidates."""
    n, k = len(x), min(CANDIDATES, len(x) - 1)
    out: list[np.ndarray] = []
    y = x.astype(np.float32)
    for a in range(0, n, 512):
        sim = y[a : a + 512] @ y.T
        sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -2
        cand = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-sim, axis=1)[:, :k]
        near = np.take_along_axis(sim, cand, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
        dist = np.sqrt(np.maximum(0, 2 - 2 * near))
        v = y[cand]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nkd,nld->nkl", v, v, optimize=True)))
        alive, kept = np.ones(cand.shape, bool), np.zeros(cand.shape, bool)
        rows = np.arange(len(cand))
        for _ in range(min(degree, k)):
            best = alive.argmax(1)  # candidates are in order, so the first one left is the nearest
            ok = alive[rows, best]
            kept[rows[ok], best[ok]] = True
            alive &= ~(alpha * between[rows, best] <= dist) | ~ok[:, None]
            alive[rows, best] = False
        out += [c[m] for c, m in zip(cand, kept, strict=True)]
    return out


def padded(lists: list[np.ndarray]) -> np.ndarray:
    """Adjacency with links both ways; -1 fills rows."""
    n = len(lists)
    src = np.repeat(np.arange(n), [len(x) for x in lists])
    dst = np.concatenate(lists).astype(np.int64) if n else np.zeros(0, np.int64)
    key = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    src, dst = key // max(n, 1), key % max(n, 1)
    deg = np.bincount(src, minlength=n)
    out = np.full((n, int(deg.max()) if n and len(src) else 1), -1, np.int64)
    out[src, np.arange(len(src)) - np.repeat(np.cumsum(deg) - deg, deg)] = dst
    return out


def cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for i in range(0, len(a), 50_000):
        out[i : i + 50_000] = np.einsum("ij,ij->i", x[a[i : i + 50_000]], x[b[i : i + 50_000]])
    return out


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs within range: greedy beam from medoids, then expansion of all that is in range."""
    n, q = len(x), len(queries)
    far = x @ x.mean(0)
    medoids = [int(far.argmax())]
    for _ in range(min(3, n - 1)):
        medoids.append(int((x @ x[medoids].T).max(1).argmin()))
    seen = np.zeros((q, n), bool)
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -9.0)
    start = np.unique(np.array(medoids))[:beam]
    ids[:, : len(start)], sims[:, : len(start)] = start, x[queries] @ x[start].T
    seen[:, start] = True
    fresh = ids >= 0
    rows = np.arange(q)
    for _ in range(2 * beam):
        open_ = np.where(fresh, sims, -9.0)
        best = open_.argmax(1)
        act = rows[open_[rows, best] > -9]
        if not len(act):
            break
        fresh[act, best[act]] = False
        nb = graph[ids[act, best[act]]]
        r, c = np.nonzero((nb >= 0) & ~seen[act[:, None], np.maximum(nb, 0)])
        if not len(r):
            continue
        qq, node = act[r], nb[r, c]
        seen[qq, node] = True
        s = np.full(nb.shape, -9.0)
        s[r, c] = cosines(x, queries[qq], node)
        all_s = np.concatenate([sims[act], s], 1)
        all_i = np.concatenate([ids[act], np.where(s > -9, nb, -1)], 1)
        all_f = np.concatenate([fresh[act], s > -9], 1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        ids[act], sims[act], fresh[act] = (np.take_along_axis(z, top, 1) for z in (all_i, all_s, all_f))
    r, c = np.nonzero(sims >= least)
    hit_q, hit_n = [r], [ids[r, c]]
    done = np.zeros((q, n), bool)  # in range and expanded
    done[r, ids[r, c]] = True
    own = ~done[rows, queries]
    front_q, front_n = np.concatenate([r, rows[own]]), np.concatenate([ids[r, c], queries[own]])
    done[rows, queries] = True
    hit_q.append(rows[own])
    hit_n.append(queries[own])
    tried = done.copy()
    while len(front_q):
        new_q, new_n = [], []
        for i in range(0, len(front_q), 100_000):
            nb = graph[front_n[i : i + 100_000]]
            r, c = np.nonzero(nb >= 0)
            a, b = front_q[i : i + 100_000][r], nb[r, c]
            key = np.unique((a * n + b)[~tried[a, b]])
            a, b = key // n, key % n
            tried[a, b] = True
            ok = cosines(x, queries[a], b) >= least
            new_q.append(a[ok])
            new_n.append(b[ok])
        front_q, front_n = np.concatenate(new_q), np.concatenate(new_n)
        hit_q.append(front_q)
        hit_n.append(front_n)
    return np.concatenate(hit_q), np.concatenate(hit_n)


def shard_links(x: np.ndarray, lists: list[np.ndarray], least: float) -> np.ndarray:
    """Whether i and j, i != j, are in range, found from either side: one byte a pair, at most (2 SHARD_CAP) squared."""
    n, graph = len(x), padded(lists)
    found = np.zeros((n, n), bool)
    for a in range(0, n, 256):
        q, node = range_search(x, graph, np.arange(a, min(n, a + 256)), least)
        found[q + a, node] = True
    found |= found.T
    np.fill_diagonal(found, False)
    return found


def _valid(vec: str):
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows that agree in the first ``width`` (integer) columns: (key, rows)."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            new = tuple(int(c[lo]) for c in cols)
            if new != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                key, held = new, []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def pivots(x: np.ndarray, least: float, group: int | None = None) -> np.ndarray:
    """Means of groups of a sample of which ``group`` members lie within half the angle; densest first."""
    group = group or GROUP
    half, y = math.sqrt((1 + least) / 2) + 1e-7, x.astype(np.float32)
    near = np.concatenate([(y[i : i + 512] @ y.T >= least).sum(1) for i in range(0, len(y), 512)]) if len(y) else np.zeros(0, int)
    near[near < group] = 0
    out = []
    while near.any():
        at = int(near.argmax())
        around = x @ x[at] >= least
        mean = x[around].mean(0)
        for _ in range(3):
            mean = mean / np.sqrt(mean @ mean)
            inside = x @ mean >= half
            if inside.sum() < group:
                break
            mean = x[inside].mean(0)
        if inside.sum() >= group:
            out.append(mean / np.sqrt(mean @ mean))
            near[x @ out[-1] >= half] = 0
            near[at] = 0
        else:
            near[around] = 0  # too wide for a ball
    return np.array(out) if out else np.zeros((0, x.shape[1]))


def probes_needed(cent: np.ndarray, x: np.ndarray, least: float, seed: int = 5) -> int:
    """Least number of nearest centroids with which TARGET_MET of the rows share one with a partner at cosine ``least``."""
    away = np.random.Generator(np.random.PCG64(seed)).normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    y = least * x + np.sqrt(max(0.0, 1 - least * least)) * away / np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), 1e-30)
    rank = np.full(len(x), len(cent))  # least p so that the p nearest of both have a common one
    place = np.arange(len(cent))
    for i in range(len(x)):
        at = np.empty((2, len(cent)), np.int64)
        for side, v in zip(at, (x[i], y[i]), strict=True):
            side[np.argsort(-(cent @ v), kind="stable")] = place
        rank[i] = at.max(0).min() + 1
    return max(PROBES, int(np.quantile(rank, TARGET_MET, method="higher"))) if len(x) else PROBES


def _first(classes: DataFrame, limit: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the first classes by a hash of their id."""
    got = classes.select("cid", "v").orderBy(F.xxhash64("cid", F.lit(salt)), "cid").limit(limit).toArrow()
    return got.column(0).to_numpy(), unit(matrix_of(got.column(1))) if got.num_rows else np.zeros((0, 1))


def _balls(classes: DataFrame, mids: np.ndarray, least: float) -> DataFrame:
    """classes plus ball (-1: none) and reach: balls whose members may link to the class, each pair of balls from the larger number only."""
    kind = classes.schema["v"].dataType.simpleString()
    if not len(mids):
        return classes.select("cid", "v", "w", F.lit(-1).alias("ball"), F.array().cast("array<int>").alias("reach"))
    near, half = classes.sparkSession.sparkContext.broadcast(mids), math.sqrt((1 + least) / 2) + 1e-7  # at most SAMPLE / GROUP vectors
    touch = math.cos(min(math.pi, 1.5 * math.acos(least))) - 1e-7

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sim = unit(matrix_of(b.column(1))) @ near.value.T
                best = sim.argmax(1)
                ball = np.where(sim[np.arange(len(sim)), best] >= half, best, -1).astype(np.int32)
                reach = (sim >= touch) & ((ball < 0)[:, None] | (np.arange(sim.shape[1]) < ball[:, None]))
                row, col = np.nonzero(reach)
                offs = np.searchsorted(row, np.arange(len(sim) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(col.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ball), lists], names=["cid", "v", "w", "ball", "reach"])

    return stage(classes.select("cid", "v", "w").mapInArrow(deal, f"cid bigint, v {kind}, w bigint, ball int, reach array<int>"), "balls")


def _chunked(rows: DataFrame, group: str, sizes: dict[int, int], name: str) -> DataFrame:
    """rows plus <name>: how many chunks the row's group is dealt into."""
    many = {g: -(-n // SHARD_CAP) for g, n in sizes.items() if n > SHARD_CAP}
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for gp in many.items() for x in gp]), F.col(group)), F.lit(1)) if many else F.lit(1)
    return rows.withColumn(name, parts.cast("int"))


def _reached(dealt: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Counts (cid, links) and edges (a, b) of links between members of balls and the classes that reach into them."""
    balls = dealt.where("ball >= 0").groupBy("ball").agg(F.count("*").alias("n"), F.sum("w").alias("total"), F.min("cid").alias("rep"))
    balls = stage(balls, "ball")  # at most SAMPLE / GROUP rows
    info = {r["ball"]: r for r in balls.collect()}
    reps = {b: r["rep"] for b, r in info.items()}
    inside = dealt.where("ball >= 0").join(F.broadcast(balls.select("ball", "total")), "ball")
    counts = inside.select("cid", (F.col("total") - F.col("w")).alias("links"))
    outside = dealt.where(F.size("reach") > 0).select("cid", "v", "w", F.col("ball").alias("own"), F.explode("reach").alias("ball"))
    reach = {r["ball"]: r["count"] for r in outside.groupBy("ball").count().collect() if r["ball"] in info}
    none = dealt.sparkSession.createDataFrame([], "a bigint, b bigint")
    if not reach:
        return counts, none
    # Both sides of a ball in chunks; each pair of chunks is a task.
    ball_n = {b: info[b]["n"] for b in reach}
    cut = lambda c: F.pmod(F.xxhash64("cid"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    sides = []
    for rows, own, other, node in (
        (dealt.where(F.col("ball").isin(list(reach))).select("cid", "v", "w", "ball"), "i", "j", F.lit(0).cast("bigint")),
        (outside.where(F.col("ball").isin(list(reach))).select("cid", "v", "w", "ball", "own"), "j", "i", F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for br in reps.items() for x in br]), F.col("own")), F.col("cid"))),
    ):
        rows = _chunked(_chunked(rows, "ball", ball_n, "ni"), "ball", reach, "nj")
        sides.append(rows.withColumn(own, cut(f"n{own}")).withColumn(other, each(f"n{other}")).select("ball", "i", "j", F.lit(own == "j").cast("int").alias("side"), "cid", "v", "w", node.alias("node")))
    rows = sides[0].unionAll(sides[1]).repartition("ball", "i", "j").sortWithinPartitions("ball", "i", "j", "side", "cid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ball, _, _), t in _groups(batches, 3):
            side, cid, w, node = (t.column(k).to_numpy() for k in (3, 4, 6, 7))
            x, n = unit(matrix_of(t.column(5))), int((side == 0).sum())
            links, joined = np.zeros(len(cid), np.int64), np.zeros(len(cid), bool)
            for lo in range(n, len(cid), 256):
                hit = x[lo : lo + 256] @ x[:n].T >= least
                links[lo : lo + 256] = hit @ w[:n]
                links[:n] += w[lo : lo + 256] @ hit
                joined[lo : lo + 256] = hit.any(1)
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(links[some]), pa.array(node[some], mask=~joined[some]), pa.array(np.full(int(some.sum()), reps[ball], np.int64))], names=["cid", "links", "a", "b"])

    got = stage(rows.mapInArrow(compare, "cid bigint, links bigint, a bigint, b bigint"), "reached")
    return counts.unionAll(got.select("cid", "links")), got.where("a is not null").select("a", "b").distinct()


def _search(classes: DataFrame, cent: np.ndarray, take: int, least: float, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Counts (cid, links) and edges (a, b): for each class and shard, weight of links counted there and one node to join with.

    exact: every pair of a shard is compared, without the graph.
    """
    spark = classes.sparkSession
    kind = classes.schema["v"].dataType.simpleString()
    near = spark.sparkContext.broadcast(cent)  # the square root of the classes at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sim = unit(matrix_of(b.column(1))) @ near.value.T
                mine = np.sort(np.argpartition(-sim, take - 1, axis=1)[:, :take], axis=1).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(mine) * take + 1, take, dtype=np.int32)), pa.array(mine.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, flat], names=["cid", "v", "w", "shards"])

    dealt = stage(classes.select("cid", "v", "w").mapInArrow(deal, f"cid bigint, v {kind}, w bigint, shards array<int>"), "dealt")
    sizes = dict(dealt.select(F.explode("shards").alias("s")).groupBy("s").count().where(f"count > {SHARD_CAP}").collect())
    rows = _chunked(dealt.withColumn("s", F.explode("shards")), "s", sizes, "parts").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = rows.select("s", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "cid", "v", "w", "shards")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _groups(batches, 3):
            ids = t.column(4).to_numpy()
            lists = pruned_lists(unit(matrix_of(t.column(5)))) if len(ids) > 1 else [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([ids[x] for x in lists], pa.list_(pa.int64()))], names=["cid", "near"])

    if exact:
        whole = keyed.withColumn("near", F.array().cast("array<bigint>"))
    else:
        graph = keyed.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j", "cid").mapInArrow(build, "cid bigint, near array<bigint>")
        graph = stage(graph.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")  # DEGREE for each of its tasks
        whole = keyed.join(graph, "cid").select("s", "i", "j", "chunk", "cid", "v", "w", "shards", "near")
    whole = whole.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j", "cid")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (s, ci, cj), t in _groups(batches, 3):
            chunk, ids, w = (t.column(k).to_numpy() for k in (3, 4, 6))
            x, shards, n = unit(matrix_of(t.column(5))), matrix_of(t.column(7)), t.num_rows
            hops: list[np.ndarray] = [ids[:0]] * n
            if exact:
                found = np.concatenate([x[lo : lo + 256] @ x.T >= least for lo in range(0, n, 256)])
                np.fill_diagonal(found, False)
            else:
                lists = t.column(8).combine_chunks()
                src, dst = np.repeat(np.arange(n), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
                at = np.minimum(np.searchsorted(ids, dst), n - 1)  # ids come sorted
                here = ids[at] == dst
                src, at = src[here], at[here]
                found = shard_links(x, np.split(at, np.searchsorted(src, np.arange(1, n))), least)
                ok = cosines(x, src, at) >= least
                for i in np.unique(src[ok]):
                    hops[i] = ids[at[ok & (src == i)]]
            links, root = np.zeros(n, np.int64), np.arange(n)
            if ci != cj:
                found &= chunk[:, None] != chunk[None, :]
            linked = found.any(1)
            row, p = np.nonzero((shards < s) & linked[:, None])
            lower, at = np.unique(shards[row, p], return_inverse=True)
            inside = np.zeros((n, len(lower)), np.float32)  # smaller shards that a linked node is in
            inside[row, at] = 1
            weight = w.astype(np.float64)
            for lo in range(0, n, 256):
                if linked[lo : lo + 256].any():
                    first = found[lo : lo + 256]  # no smaller shard that both are in
                    if len(lower):
                        first = first & (inside[lo : lo + 256] @ inside.T == 0)
                    links[lo : lo + 256] = np.rint(first @ weight)
            while True:  # least label of a node and all it is linked to
                new = root.copy()
                for i in np.flatnonzero(linked):
                    new[i] = min(root[i], root[found[i]].min())
                new = new[new]
                if (new == root).all():
                    break
                root = new
            some = (links > 0) | (root != np.arange(n)) | np.array([len(h) > 0 for h in hops], bool)
            out = [pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]]), pa.array([hops[i] for i in np.flatnonzero(some)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["cid", "links", "root", "hops"])

    found = stage(whole.mapInArrow(search, "cid bigint, links bigint, root bigint, hops array<bigint>"), "links")
    counts, edges = found.select("cid", "links"), found.select(F.col("cid").alias("a"), F.col("root").alias("b"))
    hops = stage(found.select("cid", F.explode("hops").alias("to")).distinct(), "hops")
    if not exact and not hops.isEmpty():
        pairs = _beyond(dealt, hops, least)
        if pairs is not None:
            more = pairs.join(dealt.select(F.col("cid").alias("b"), "w"), "b").select(F.col("a").alias("cid"), F.col("w").alias("links"))
            counts, edges = counts.unionAll(more), edges.unionAll(pairs.select("a", "b"))
    return counts, edges


def _beyond(dealt: DataFrame, hops: DataFrame, least: float) -> DataFrame | None:
    """(a, b), both ways: links between classes that share no shard, by range expansion along the lists: DEGREE squared candidates a class and round."""
    steps = hops.select(F.col("cid").alias("mid"), F.col("to").alias("b"))
    front, known = hops.select(F.col("cid").alias("a"), F.col("to").alias("mid")), None
    side = lambda n: dealt.select(F.col("cid").alias(n), F.col("v").alias(f"v{n}"), F.col("shards").alias(f"s{n}"))
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    while True:
        new = front.join(steps, "mid").where("a != b").select("a", "b").distinct()
        if known is not None:
            new = new.join(known, ["a", "b"], "left_anti")
        new = new.join(side("a"), "a").join(side("b"), "b").where(~F.arrays_overlap("sa", "sb") & (dot >= least * size(F.col("va")) * size(F.col("vb"))))
        new = stage(new.select("a", "b").unionAll(new.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "beyond")
        if known is not None:
            new = stage(new.join(known, ["a", "b"], "left_anti"), "beyond")
        if new.isEmpty():
            return known
        known = new if known is None else known.unionAll(new)
        front = new.select("a", F.col("b").alias("mid"))


def unit_recall(q: np.ndarray, recall: np.ndarray, least: float) -> tuple[float, int]:
    """Mean recall over units, and their number: queries linked with each other are one unit."""
    close = q @ q.T >= least
    np.fill_diagonal(close, True)
    label = np.arange(len(q))
    while True:
        new = np.array([label[c].min() for c in close], np.int64)
        new = new[new]
        if (new == label).all():
            break
        label = new
    _, at, size = np.unique(label, return_inverse=True, return_counts=True)
    return (float((np.bincount(at, weights=recall) / size).mean()), len(size)) if len(q) else (1.0, 0)


def audit(classes: DataFrame, found: DataFrame, least: float, limit: int | None = None) -> tuple[float, int]:
    """Recall against brute force over all classes (the lesser of by link and by unit), and the number of units."""
    limit = limit or AUDIT
    every, vecs = _first(classes, limit * AUDIT_BLOCKS, 1)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    out = 1.0, 0
    for s in range(0, len(every), limit):
        ids, q = every[s : s + limit], vecs[s : s + limit]

        def count(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(ids), np.int64)
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    x = b.slice(lo, 1024)
                    hit = (q @ unit(matrix_of(x.column(1))).T >= least) & (ids[:, None] != x.column(0).to_numpy()[None, :])
                    total += np.rint(hit @ x.column(2).to_numpy().astype(np.float64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["cid", "n"])

        want = {r["cid"]: r["n"] for r in classes.select("cid", "v", "w").mapInArrow(count, "cid bigint, n bigint").groupBy("cid").agg(F.sum("n").alias("n")).where("n > 0").collect()}
        got = {r["cid"]: r["n"] for r in found.where(F.col("cid").isin([int(x) for x in want])).groupBy("cid").agg(F.sum("links").alias("n")).collect()} if want else {}
        linked = np.array([int(x) in want for x in ids], bool)
        held.append((q[linked], np.array([min(got.get(int(x), 0), want[int(x)]) for x in ids[linked]], float), np.array([want[int(x)] for x in ids[linked]], float)))
        near, have, all_ = (np.concatenate([h[k] for h in held]) for k in range(3))
        mean, units = unit_recall(near, have / all_, least)
        out = min(mean, have.sum() / all_.sum()) if units else 1.0, units
        if out[1] >= LEAST_UNITS:
            break
    return out


def _audited(classes: DataFrame, sample: np.ndarray, n: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Counts and edges of ``_search`` with as many shards for each class as the audit asks for."""
    cent = kmeans(sample, min(len(sample), shards_of(n)))
    probes = probes_needed(cent, _first(classes, AUDIT, 1)[1], least)
    while probes < len(cent):
        counts, edges = _search(classes, cent, probes, least)
        recall, units = audit(classes, counts, least)
        if not units:
            LOG.warning("op2: no linked class among %d queries of %d classes; recall rests on planted partners", AUDIT * AUDIT_BLOCKS, n)
        if recall >= TARGET:
            return counts, edges
        probes *= 2
    return _search(classes, cent[:1], 1, least, exact=True)  # one shard of all: every pair is compared


def shards_of(n: int) -> int:
    return max(1, min(-(-n // SHARD), math.isqrt(n) + 1))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", least: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) of each row."""
    kind = df.schema[vec].dataType
    kind = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast(kind).alias("v"))
    valid = rows.where(_valid("v") & F.col("id").isNotNull())
    classes = stage(valid.groupBy("v").agg(F.min("id").alias("cid"), F.count("*").alias("w")), "classes")
    # Different vectors may share an id: then ``most`` keys stand for each id, in the order of ids.
    most = classes.groupBy("cid").count().agg(F.max("count")).first()[0] or 1
    if most > 1:
        place = F.row_number().over(W.partitionBy("cid").orderBy(F.xxhash64("v"), "v")) - 1
        classes = stage(classes.withColumn("cid", F.col("cid") * most + place), "keyed")
    counts, edges, nodes = [], [], []
    dims = classes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()  # lengths of vectors: a few
    for d, n in dims:
        own = classes.where(F.size("v") == d)
        _, sample = _first(own, max(SAMPLE, 8 * shards_of(n)))
        mids = pivots(sample[:SAMPLE], least)
        dealt = _balls(own, mids, least)
        if len(mids):
            got = _reached(dealt, least)
            counts.append(got[0])
            edges.append(got[1])
            sample = sample[(sample @ mids.T).max(1) < math.sqrt((1 + least) / 2)]
        first = dealt.where("ball >= 0").groupBy("ball").agg(F.min("cid").alias("rep"))
        nodes.append(dealt.select("cid", "ball").join(F.broadcast(first), "ball", "left").select("cid", F.coalesce("rep", "cid").alias("node")))
        rest = dealt.where("ball < 0").select("cid", "v", "w")
        left = rest.count()
        if left > 1:
            got = _audited(rest, sample if len(sample) else _first(rest, SAMPLE)[1], left, least)
            counts.append(got[0])
            edges.append(got[1])
    union = lambda parts, kind: reduce(DataFrame.unionAll, parts) if parts else df.sparkSession.createDataFrame([], kind)
    comp = components(union(edges, "a bigint, b bigint"))
    total = union(counts, "cid bigint, links bigint").groupBy("cid").agg(F.sum("links").alias("links"))
    label = union(nodes, "cid bigint, node bigint").join(comp, "node", "left").select("cid", F.coalesce("root", "node").alias("root"))
    full = classes.join(total, "cid", "left").join(label, "cid").select("v", "w", F.coalesce("links", F.lit(0)).alias("links"), F.expr(f"(root - pmod(root, {most}L)) div {most}L").alias("root"))
    own = valid.join(full, "v").select("id", (F.col("links") + F.col("w") - 1).cast("long").alias("n_links"), F.col("root").alias("component_id"))
    rest = rows.where(~(_valid("v") & F.col("id").isNotNull())).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = own.unionAll(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
