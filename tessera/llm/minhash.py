"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star edges.

1. Each document becomes its set of distinct word shingles (64-bit hashes), from whole texts.
2. Documents with equal sets collapse into a class; its smallest id stands for it from here on.
3. One pass over the sorted set gives the minimum of each of K bins; an empty bin takes the value of the
   first filled bin in its own fixed random order of bins (the same order for every document).
4. Bins form bands of ROWS; classes that share a band's key share a bucket. A bucket is a star: all its
   members link to the member with the least hash of id, the same centre in all bands, so pairs are
   linear in the members.
5. Every candidate is confirmed on the full sets, recomputed from the texts. Members that do not link to
   their centre are compared with the others of their chunk (at most CHUNK members of one centre), so a
   star loses no link inside a chunk; larger stars are cut into chunks that all hold the centre.
6. Confirmed links go through connected components. Members of a star of several chunks that are still not
   in their centre's component are then compared with all members of that star, BLOCK by BLOCK of both, so
   no star loses a link across chunks; a pair within one component needs no comparison.

The number of bands for a threshold keeps the chance to miss a pair at the threshold under MISS.

Edge cases: a null or empty text, or one without words, has an empty set and links with nothing; fewer
words than a shingle count as one shingle; words are hashed by a non-linear chain, so patterned words don't collide; rows that share an id share its component; a null id is kept
as a row of its own, linked with nothing; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import buffer_of, components, mix, range_hash, read_table, small_batches, stage

WORDS = 5
BAND_ROWS = 6
MISS = 1e-8
CHUNK = 64
#: Tasks that the members of one star are dealt to when the star's size is looked up.
SALTS = 32
#: Members of a star, and those that ask, in one task of the comparison across chunks, about.
BLOCK = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def bands_for(threshold: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a buffer."""
    data = _LOWER[data]
    n = len(offs) - 1
    blank = np.ones(len(data) + 1, bool)
    blank[:-1] = _BLANK[data]
    first = np.ones(len(data) + 1, bool)  # a word starts after a blank or where a text starts
    first[1:] = blank[:-1]
    first[offs[:-1]] = True
    starts = np.flatnonzero(first & ~blank)
    stop = blank.copy()
    stop[offs[1:]] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
    words = range_hash(data, starts, ends)
    at = np.searchsorted(starts, offs)  # words of text i: at[i] .. at[i + 1]
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    m = len(words) - width + 1
    grams = mix(sum((words[k : k + m] * factors[k] for k in range(width)), np.zeros(m, np.uint64))) if m > 0 else np.zeros(0, np.uint64)
    out = []
    for i in range(n):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = mix(h * factors[0] + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_ORDERS: dict[int, np.ndarray] = {}


def signature(sets: list[np.ndarray], k: int) -> np.ndarray:
    """K bin minima of each non-empty set, empty bins filled by optimal densification."""
    if k not in _ORDERS:
        rng = np.random.Generator(np.random.PCG64(99))
        _ORDERS[k] = np.stack([rng.permutation(k) for _ in range(k)])
    sig, full = np.zeros((len(sets), k), np.uint64), np.zeros((len(sets), k), bool)
    for i, s in enumerate(sets):
        bins = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        head = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))  # sorted: the first of a bin is its least
        sig[i, bins[head].astype(np.int64)] = s[head]
        full[i, bins[head].astype(np.int64)] = True
    rows, cols = np.nonzero(~full)
    for t in range(k):
        if not len(rows):
            break
        take = _ORDERS[k][cols, t]
        hit = full[rows, take]
        sig[rows[hit], cols[hit]] = sig[rows[hit], take[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    b = sig.shape[1] // rows
    h = np.broadcast_to(mix(np.arange(b, dtype=np.uint64)), (len(sig), b)).copy()
    for r in range(rows):
        h = mix(h ^ sig[:, r::rows][:, :b]) + np.uint64(r)
    return h.view(np.int64)


def features(df: DataFrame, id_col: str, text: str, n_bands: int, rows: int = BAND_ROWS, width: int = WORDS) -> DataFrame:
    """(id, n_shingles, s1, s2, bands): the set's size, its 128-bit cryptographic digest and its band keys (none if empty)."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(*buffer_of(b.column(1)), width)
            some = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(signature([sets[i] for i in some], n_bands * rows), rows) if some else np.zeros((0, n_bands), np.int64)
            counts = np.zeros(len(sets) + 1, np.int32)
            counts[np.array(some, np.int64) + 1] = n_bands
            digests = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets), "<i8").reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists], names=["id", "n_shingles", "s1", "s2", "bands"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary")).mapInArrow(run, "id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>")


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    common = len(x) + len(y) - len(np.union1d(x, y))
    return den * common >= num * (len(x) + len(y) - common)


def common_sizes(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections of sorted sets xs with ys: products of membership matrices, ``width`` values at a time."""
    out = np.zeros((len(xs), len(ys)), np.int64)
    flat = [np.concatenate(z) if z else np.zeros(0, np.uint64) for z in (xs, ys)]
    values = np.intersect1d(*flat)
    sides = []
    for z, sets in zip(flat, (xs, ys), strict=True):
        at = np.searchsorted(values, z)
        hit = np.flatnonzero(at < len(values))
        hit = hit[values[at[hit]] == z[hit]]
        hit = hit[np.argsort(at[hit], kind="stable")]
        sides.append((at[hit], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit]))
    for lo in range(0, len(values), width):
        parts = []
        for (at, who), sets in zip(sides, (xs, ys), strict=True):
            a, b = np.searchsorted(at, [lo, lo + width])
            m = np.zeros((len(sets), width), np.float32)
            m[who[a:b], at[a:b] - lo] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def confirm_block(asks: list[tuple[int, np.ndarray]], members: list[tuple[int, np.ndarray]], num: int, den: int) -> list[tuple[int, int]]:
    """Links between those that ask and members, as a forest."""
    if not asks or not members:
        return []
    both = common_sizes([s for _, s in asks], [s for _, s in members])
    size = np.array([len(s) for _, s in asks])[:, None] + np.array([len(s) for _, s in members])[None, :]
    root, links = {i: i for i, _ in asks + members}, []
    for x, y in zip(*np.nonzero(den * both >= num * (size - both)), strict=True):
        ends = a, b = [asks[x][0], members[y][0]]
        for k in (0, 1):
            while root[ends[k]] != ends[k]:
                root[ends[k]] = root[root[ends[k]]]
                ends[k] = root[ends[k]]
        if ends[0] != ends[1]:
            root[ends[1]] = ends[0]
            links.append((a, b))
    return links


def confirm_chunk(ids: list[int], sets: list[np.ndarray], num: int, den: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that join each member to those it is similar to, as a forest, and the members apart from ids[0], the centre."""
    root, links = list(range(len(ids))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def link(i: int, j: int) -> None:
        root[find(j)] = find(i)
        links.append((ids[i], ids[j]))

    apart = []
    for j in range(1, len(ids)):
        if _similar(sets[0], sets[j], num, den):
            link(0, j)
        else:
            apart.append(j)
    done: set[tuple[int, int]] = set()
    for j in apart:  # each of these against every other member that is not yet joined to it
        for i in range(1, len(ids)):
            if i != j and (min(i, j), max(i, j)) not in done and find(i) != find(j):
                done.add((min(i, j), max(i, j)))
                if _similar(sets[i], sets[j], num, den):
                    link(i, j)
    return links, [ids[j] for j in apart]


def confirm(texts: DataFrame, edges: DataFrame, num: int, den: int, width: int = WORDS) -> DataFrame:
    """(a, b, apart): links among candidates, and, apart, (centre, member) of stars of several chunks that are not similar.

    texts: (id, data); edges: (centre, member), distinct.
    """
    # Only centres of several chunks are looked up, by (centre, salt): a hot star is dealt over SALTS tasks. Its chunks are numbered
    # from the count, so the centre's own rows need no distinct over the members.
    sizes = edges.groupBy("centre").agg(F.count("*").alias("n")).select("centre", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))
    wide = sizes.where("parts > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("member", F.lit(4)), F.lit(SALTS)).cast("int")
    parts = F.coalesce("parts", F.lit(1))
    chunk = F.pmod(F.xxhash64("member", F.lit(3)), parts).cast("int")
    want = edges.withColumn("salt", salt).join(wide.hint("merge"), ["centre", "salt"], "left").select(F.col("member").alias("id"), "centre", chunk.alias("chunk"), (parts > 1).alias("wide"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    want = want.unionAll(sizes.select(F.col("centre").alias("id"), "centre", each.alias("chunk"), (F.col("parts") > 1).alias("wide")))
    # Always the shuffled plan: the list of candidates grows with the corpus, and a broadcast that fits small inputs only
    # would make cost jump where it stops fitting.
    rows = want.hint("merge").join(texts, "id").select("centre", "chunk", (F.col("id") != F.col("centre")).alias("other"), "id", "wide", "data")
    rows = rows.repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", "other", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = (None, None, False), [], []

        def flush() -> list[tuple[int, int, bool]]:
            links, apart = confirm_chunk(ids, sets, num, den)
            return [(a, b, False) for a, b in links] + [(key[0], b, True) for b in apart if key[2]]

        for b in batches:
            found = []
            own = shingle_sets(*buffer_of(b.column(5)), width)
            for c, k, i, w, s in zip(*(b.column(j).to_pylist() for j in (0, 1, 3, 4)), own, strict=True):
                if (c, k, w) != key:
                    found += flush()
                    key, ids, sets = (c, k, w), [], []
                if ids and ids[-1] == i:  # rows that share an id: the set that is last in this order speaks for it
                    sets[-1] = max(sets[-1], s, key=lambda x: (len(x), x.tobytes()))
                    continue
                ids.append(i)
                sets.append(s)
            yield _link_batch(found)
        yield _link_batch(flush())

    return rows.mapInArrow(run, "a bigint, b bigint, apart boolean")


def _link_batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = {"a": pa.int64(), "b": pa.int64(), "apart": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], t) for j, t in enumerate(kinds.values())], names=list(kinds))


def confirm_across(texts: DataFrame, edges: DataFrame, asks: DataFrame, num: int, den: int, width: int = WORDS) -> DataFrame:
    """Links (a, b) between the members ``asks`` (centre, member) and all members of the same star, block by block of both."""
    some = asks.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("gs"))
    star = edges.join(some, "centre")
    size = star.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("js"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64("member", F.lit(5)), F.col(c)).cast("int")
    own = star.join(size, "centre").select(F.col("member").alias("id"), "centre", upto("gs").alias("g"), dealt("js").alias("j"), F.lit(False).alias("ask"))
    ask = asks.join(some, "centre").join(size, "centre").select(F.col("member").alias("id"), "centre", dealt("gs").alias("g"), upto("js").alias("j"), F.lit(True).alias("ask"))
    rows = own.unionAll(ask).hint("merge").join(texts, "id").select("centre", "g", "j", "ask", "id", "data")
    rows = rows.repartition("centre", "g", "j").sortWithinPartitions("centre", "g", "j", "ask", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])
        for b in batches:
            found = []
            own = shingle_sets(*buffer_of(b.column(5)), width)
            for c, g, j, a, i, s in zip(*(b.column(k).to_pylist() for k in range(5)), own, strict=True):
                if (c, g, j) != key:
                    found += confirm_block(held[1], held[0], num, den)
                    key, held = (c, g, j), ([], [])
                if held[a] and held[a][-1][0] == i:
                    held[a][-1] = (i, max(held[a][-1][1], s, key=lambda x: (len(x), x.tobytes())))
                else:
                    held[a].append((i, s))
            yield _link_batch([(*x, False) for x in found])
        yield _link_batch([(*x, False) for x in confirm_block(held[1], held[0], num, den)])

    return rows.mapInArrow(run, "a bigint, b bigint, apart boolean").select("a", "b")


def linked(texts: DataFrame, edges: DataFrame, num: int, den: int, width: int = WORDS) -> DataFrame:
    """(node, root) of the components of all links within stars."""
    found = stage(confirm(texts, edges, num, den, width), "links")
    comp = components(found.where("not apart"))
    apart = found.where("apart").select(F.col("a").alias("centre"), F.col("b").alias("member"))
    if apart.isEmpty():
        return comp
    for c in ("centre", "member"):
        apart = apart.join(comp.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    away = F.coalesce("centre_root", "centre") != F.coalesce("member_root", "member")
    asks = stage(apart.where(away).select("centre", "member"), "asks")
    if asks.isEmpty():
        return comp
    more = confirm_across(texts, edges, asks, num, den, width)
    return components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", num: int = 85, den: int = 100, width: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row; links have den * |A & B| >= num * |A | B|."""
    n_bands = bands_for(num / den)
    feats = stage(features(df, id_col, text, n_bands, width=width), "features")
    some = feats.where("n_shingles > 0 and id is not null")
    # Staged, so that the join of rows to classes below is between plain exchanges, and a hot class can be split.
    classes = stage(some.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("id", "bands")).alias("r")), "classes")
    member = classes.select(F.col("r.id").alias("id"), F.explode("r.bands").alias("key"))
    stars = member.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("c"), F.count("*").alias("n")).where("n > 1").select("key", F.col("c.id").alias("centre"))
    edges = stage(member.join(stars, "key").where("id != centre").select("centre", F.col("id").alias("member")).distinct(), "edges")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("data")).where("id is not null")
    comp = linked(texts, edges, num, den, width)
    equal = some.select("id", "s1", "s2", "n_shingles").join(classes.select("s1", "s2", "n_shingles", F.col("r.id").alias("rep")), ["s1", "s2", "n_shingles"]).select("id", "rep")
    label = equal.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("component_id")).groupBy("id").agg(F.min("component_id").alias("component_id"))
    out = feats.select("id", "n_shingles").join(label, "id", "left")
    root = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(True)).alias("kept"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
