"""Repeated byte strings of WINDOW bytes across a corpus, by suffix arrays of co-located passages.

Co-location. Every window start of a text is assigned to the least k-mer hash of its window (its
minimizer); maximal runs of starts with one minimizer form a passage. Two equal windows have equal
minimizers, so they meet when passages are dealt by minimizer. Passages that are equal byte for byte
collapse into one class with a count. A minimizer met once, at one place, needs nothing more.

Suffix sorting. The classes of a minimizer come together with their bytes. A buffer of such groups is
sorted in two stages: suffixes smaller than their successor are sorted directly (by 8 bytes a round, only
those still tied, to WINDOW bytes); all others are induced by scanning the buckets of first bytes in
order, each scanned suffix placing its predecessor. Common prefixes of neighbours in that order give the
windows that occur twice. A class met twice repeats in full.

Marks go back to the passages, and each text drops the bytes that marked windows cover.

Hot minimizers: a group of more than GROUP passages is dealt into chunks by the hash of the class, each sorted
by itself. Equal windows of different chunks meet in a second step: each chunk gives the hash of each
different window once (21 bytes), dealt into a bucket for each MEET passages of the minimizer. A passage in any share of
the corpus, each time in other surroundings, thus counts once for each chunk there, not for each text. No
group of texts, passages or marks is gathered beyond one text, one chunk, one bucket, or a buffer.

Edge cases: a null text is empty; texts under WINDOW bytes keep all; equal texts (repeated rows too) of
WINDOW bytes or more lose all; rows are kept one for one, null ids included; an empty table gives an
empty one; extra columns are ignored. Equality of passages is judged by 64 bits of hash among those
of one 64-bit minimizer, and so is equality of windows of different chunks; equality inside the suffix
array is judged on bytes. Texts are one when 160 bits of their SHA-256 are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import buffer_of, range_hash, read_table, small_batches, stage, window_hashes

WINDOW = 200
KMER = 32
RUN = 1024
GROUP = 1024
#: Passages of a hot minimizer for each bucket of its windows, about.
MEET = 16
SPREAD = 1021
BUFFER = 1 << 20


def passages(data: np.ndarray, offs: np.ndarray, window: int = WINDOW, k: int = KMER) -> tuple[np.ndarray, ...]:
    """(text, start, starts, minimizer, content hash, inner) of each passage of a buffer of texts.

    inner: the least k-mer stands at several places of the passage, so windows may repeat inside it.
    """
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if len(data) < window:
        return empty
    kmers = window_hashes(data, k)
    low, span, width = kmers, 1, window - k + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    wide = low  # minima of ``span`` k-mers
    low = np.minimum(low[: len(data) - window + 1], low[width - span : width - span + len(data) - window + 1])
    ok = np.zeros(len(low), bool)
    who = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(low)]
    ok = np.arange(len(low)) + window <= offs[1:][who]
    cut = np.ones(len(low), bool)
    cut[1:] = (low[1:] != low[:-1]) | (who[1:] != who[:-1]) | ~ok[:-1]
    first = np.flatnonzero(cut & ok)
    if not len(first):
        return empty
    stops = np.flatnonzero(np.concatenate([cut | ~ok, [True]]))
    last = stops[np.searchsorted(stops, first, side="right")]
    long = np.flatnonzero(last - first > RUN)  # a run of one byte makes one minimizer for long
    if len(long):
        more = np.concatenate([np.arange(first[i] + RUN, last[i], RUN) for i in long])
        first = np.sort(np.concatenate([first, more]))
        last = np.minimum(stops[np.searchsorted(stops, first, side="right")], first + RUN)
    # Equal windows i < j of one passage put its least k-mer at a start of the passage and again at most ``width`` further.
    own = np.flatnonzero(kmers[: len(low)] == low)
    own = own[own + 1 < len(low)]
    again = np.minimum(wide[own + 1], wide[own + width - span]) == low[own]
    own = own[again | (low[own + 1] == low[own])]
    inner = np.searchsorted(own, first) < np.searchsorted(own, last)
    return who[first], first - offs[who[first]], last - first, low[first], range_hash(data, first, last + window - 1), inner


def _keys(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number; past the end: zeros."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = pad[:-8].copy()
    for j in range(1, 8):
        out = (out << np.uint64(8)) | pad[j : j + len(data)]
    return out


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor; the last one is larger (the end is least)."""
    n = len(data)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1] = -1
    known = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(known[::-1])[::-1]] > 0


def sort_direct(keys: np.ndarray, at: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Positions ``at`` in the order of their suffixes, by ``depth`` bytes; only ties go to the next round."""
    order = np.argsort(keys[at], kind="stable")
    at = at[order]
    first = keys[at]
    group = np.cumsum(np.concatenate([[0], (first[1:] != first[:-1]).astype(np.int64)])) if len(at) else np.zeros(0, np.int64)
    tied = _tied(group)
    for d in range(8, depth, 8):
        if not len(tied):
            break
        pos = at[tied] + d
        k = np.where(pos < len(keys), keys[np.minimum(pos, len(keys) - 1)], np.uint64(0))
        g = group[tied]
        order = np.lexsort((k, g))
        k, at[tied] = k[order], at[tied][order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
        starts = np.flatnonzero(new)
        group[tied] = tied[starts][np.cumsum(new) - 1]  # the place of its first member names a group
        tied = tied[_tied(group[tied])]
    return at


def _tied(group: np.ndarray) -> np.ndarray:
    if len(group) < 2:
        return np.zeros(0, np.int64)
    same = group[1:] == group[:-1]
    return np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))


def suffix_order(data: np.ndarray, want: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """The wanted positions (bool) in suffix order to ``depth`` bytes, by two-stage sorting.

    Suffixes smaller than their successor are sorted directly. The others are induced: buckets of the
    first byte are scanned in order, and each suffix of the scan puts its predecessor, when that is larger
    than its successor, at the next free place of the predecessor's bucket. Positions that no wanted one
    is induced from are left out.
    """
    n = len(data)
    small = smaller_than_next(data)
    # a wanted larger suffix needs all after it up to and with the next smaller one
    nxt = np.where(small, np.arange(n), n - 1)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    deep = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(want)
    np.add.at(deep, at, 1)
    np.add.at(deep, nxt[at] + 1, -1)
    need = np.cumsum(deep[:-1]) > 0
    keys = _keys(data)
    direct = sort_direct(keys, np.flatnonzero(need & small), depth)
    heads = data[direct]
    direct = np.split(direct, np.searchsorted(heads, np.arange(1, 256)))  # sorted by first byte already
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and need[n - 1]:
        induced[data[n - 1]].append(np.array([n - 1]))
    larger = need & ~small
    out = []

    def scan(pos: np.ndarray, c: int) -> np.ndarray:
        """Predecessors that the scanned suffixes put in place; those of the same bucket are returned."""
        prev = pos[pos > 0] - 1
        prev = prev[larger[prev]]
        head = data[prev]
        prev, head = prev[head >= c], head[head >= c]
        if not len(prev):
            return prev
        order = np.argsort(head, kind="stable")
        prev, head = prev[order], head[order]
        cuts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        same = prev[:0]
        for a, b in zip(cuts, [*cuts[1:], len(prev)], strict=True):
            if head[a] == c:
                same = prev[a:b]
            else:
                induced[head[a]].append(prev[a:b])
        return same

    for c in range(256):
        part = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(part):  # larger suffixes of this bucket; each may put another before it in the same bucket
            out.append(part)
            part = scan(part, c)
        if len(direct[c]):
            out.append(direct[c])
            scan(direct[c], c)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[want[order]]


def common_prefix(keys: np.ndarray, order: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Bytes in common between neighbours of the order, up to ``depth``, in steps of the last whole 8 bytes."""
    n = max(0, len(order) - 1)
    out, live = np.zeros(n, np.int64), np.arange(n)
    for d in range(0, depth, 8):
        d = min(d, depth - 8)
        a, b = order[live] + d, order[live + 1] + d
        ok = (a < len(keys)) & (b < len(keys))
        ok[ok] = keys[a[ok]] == keys[b[ok]]
        live = live[ok]
        out[live] = d + 8
        if not len(live):
            break
    return out


def repeated(data: np.ndarray, want: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which wanted starts (bool over positions) open a window that another wanted start opens too."""
    order = suffix_order(data, want, window)
    same = common_prefix(_keys(data), order, window) >= window
    out = np.zeros(len(data), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"o": int(a), "l": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_MARKS = pa.list_(pa.struct([("o", pa.int32()), ("l", pa.int32())]))
_FOUND = pa.schema([("m_", pa.int64()), ("h_", pa.int64()), ("marks", _MARKS), ("bucket", pa.int32()), ("windows", pa.binary())])
_ROW = np.dtype([("w", "u8"), ("h", "i8"), ("o", "i4"), ("met", "?")])


def _found(cols, schema: pa.Schema = _FOUND) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _windows(group: list[tuple[int, tuple]], hit: np.ndarray, hashes: np.ndarray, window: int) -> pa.RecordBatch:
    """The different windows of a chunk by hash w, with class h, start o there and whether marked already: packed, a row a bucket of w."""
    at = np.concatenate([np.arange(a, a + row[4]) for a, row in group])
    own = np.repeat(np.arange(len(group)), [row[4] for _, row in group])
    w, first = np.unique(hashes[at], return_index=True)
    at, own = at[first], own[first]
    x = np.zeros(len(w), _ROW)
    x["w"], x["h"] = w, np.array([row[2] for _, row in group], np.int64)[own]
    x["o"] = at - np.array([a for a, _ in group])[own]
    x["met"] = hit[at] | np.array([row[5] for _, row in group])[own]
    bucket = (w % np.uint64(group[0][1][7])).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    names, cuts = np.unique(bucket[order], return_index=True)
    n = len(names)
    packs = [p.tobytes() for p in np.split(x[order], cuts[1:])]
    return _found([[group[0][1][0]] * n, [None] * n, [None] * n, names, packs])


def _twins(m: int, packs: list[bytes]) -> pa.RecordBatch:
    """Marks of the windows that two chunks hold, by class; those that are marked already are left out."""
    x = np.frombuffer(b"".join(packs), _ROW)
    _, inv, n = np.unique(x["w"], return_inverse=True, return_counts=True)
    x = np.sort(x[(n[inv] > 1) & ~x["met"]], order=["h", "o"])
    cuts = np.flatnonzero(np.concatenate([[True], x["h"][1:] != x["h"][:-1]])) if len(x) else np.zeros(0, np.int64)
    ones = pa.StructArray.from_arrays([pa.array(x["o"]), pa.array(np.ones(len(x), np.int32))], names=["o", "l"])
    marks = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(x)).astype(np.int32)), ones)
    return _found([[m] * len(cuts), x["h"][cuts], marks], pa.schema(list(_FOUND)[:3]))


def spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, *carry, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) of each row.

    ``kept_text`` is the remaining bytes as text, without bytes that a cut left of a character.
    """
    small_batches(df.sparkSession)
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col), *carry, F.coalesce(F.substring(F.unhex(F.sha2(data, 256)), 1, 20), F.lit(b"")).alias("key"), data.alias("data"))
    mark = "array<struct<o:int,l:int>>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = buffer_of(b.column(1))
            lo = 0
            while lo < b.num_rows:  # buffers of about BUFFER bytes, or one text
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + BUFFER, side="right")) - 1)
                hi = min(hi, b.num_rows)
                who, start, n, low, h, inner = passages(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], window)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who + lo)), pa.array(2 * start + inner), pa.array(n.astype(np.int32)), pa.array(low.view(np.int64)), pa.array(h.view(np.int64))], names=["key", "place", "len", "m", "h"])
                lo = hi

    # place: twice the start, plus one for a passage that may repeat inside. Only passages whose minimizer occurs again, or that
    # may repeat inside, go on; the minimizers are counted before they are exchanged.
    found = rows.select("key", "data").mapInArrow(find, "key binary, place bigint, len int, m bigint, h bigint")
    inner = F.max(F.col("place") % 2)
    count = found.groupBy(F.col("m").alias("m_")).agg(F.count("*").alias("total"), ((F.min("h") != F.max("h")) | (inner == 1)).alias("shared"), inner.alias("inner"))
    count = count.where("total + inner > 1").select("m_", "shared", F.ceil(F.col("total") / GROUP).cast("int").alias("subs"), F.ceil(F.col("total") / MEET).cast("int").alias("buckets"))
    found = stage(found.join(count.hint("merge"), F.col("m") == F.col("m_")).drop("m_"), "passages")
    classes = found.groupBy("m", "h").agg(F.count("*").alias("n"), F.min(F.struct("key", "place", "len")).alias("r"), F.max("shared").alias("shared"), F.max("subs").alias("subs"), F.max("buckets").alias("buckets"))
    # A class met twice repeats in full: it is its own neighbour. Classes that share a minimizer are sorted.
    full = F.array(F.struct(F.lit(0).alias("o"), F.col("r.len").alias("l"))).cast(mark)
    whole = classes.where("n > 1").select(F.col("m").alias("m_"), F.col("h").alias("h_"), full.alias("marks"))
    q = F.struct("m", "h", F.floor(F.col("r.place") / 2).cast("int").alias("start"), F.col("r.len").alias("len"), "subs", "buckets", (F.col("n") > 1).alias("known"))
    asked = classes.where("shared").select(F.col("r.key").alias("of"), q.alias("q")).groupBy("of").agg(F.collect_list("q").alias("qs"))
    # Equal texts are one text here. This exchange of texts is shared by both uses below: for that they must read the same
    # columns through the same plan, hence keys that are never null (no filter is put in on one side) and n carried along.
    texts = rows.groupBy("key").agg(F.max("data").alias("data"), F.count("*").alias("n"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for text_, qs in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                for q in qs:
                    part = text_[q["start"] : q["start"] + q["len"] + window - 1]
                    for col, v in zip(out, (q["m"], q["h"] % q["subs"], q["h"], part, q["len"], q["known"], q["subs"], q["buckets"]), strict=True):
                        col.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]
            for i in range(0, len(out[0]), 4000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 4000], t) for c, t in zip(out, kinds, strict=True)], names=["m", "sub", "h", "part", "len", "known", "subs", "buckets"])

    pieces = texts.join(asked.hint("merge"), texts["key"] == F.col("of")).select("data", "n", "qs").mapInArrow(slices, "m bigint, sub int, h bigint, part binary, len int, known boolean, subs int, buckets int")
    pieces = pieces.repartition("m", "sub").sortWithinPartitions("m", "sub")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks of classes, and of each chunk of a hot minimizer its different windows, packed."""
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            buf = np.frombuffer(b"".join(h[3] for h in held), np.uint8) if held else np.zeros(0, np.uint8)
            want, at, res = np.zeros(len(buf), bool), 0, []
            for h in held:
                want[at : at + h[4]] = True
                at += len(h[3])
            hit, at = repeated(buf, want, window) if len(buf) else want, 0
            hashes = window_hashes(buf, window) if any(h[6] > 1 for h in held) else None
            group: list[tuple[int, tuple]] = []
            for k, h in enumerate(held):
                if not h[5] and (runs := _runs(hit[at : at + h[4]])):
                    res.append((h[0], h[2], runs, h[2] % SPREAD))  # marks go on as they are: dealt out evenly
                if h[6] > 1:
                    group.append((at, h))
                at += len(h[3])
                if group and (k + 1 == len(held) or held[k + 1][:2] != h[:2]):
                    yield _windows(group, hit, hashes, window)
                    group = []
            yield _found([[r[k] for r in res] for k in range(4)] + [[None] * len(res)])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] != last and size > BUFFER:
                    yield from flush()
                    held, size = [], 0
                last = row[:2]
                held.append(row)
                size += len(row[3])
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks as they are; windows of one bucket are held until the next begins."""
        held: list[bytes] = []
        last = None
        for b in batches:
            packed = b.column(4).is_valid()
            yield b.filter(pc.invert(packed)).select([0, 1, 2])
            for m, bucket, pack in zip(*(b.filter(packed).column(k).to_pylist() for k in (0, 3, 4)), strict=True):
                if (m, bucket) != last:
                    if len(held) > 1:
                        yield _twins(last[0], held)
                    held, last = [], (m, bucket)
                held.append(pack)
        if len(held) > 1:
            yield _twins(last[0], held)

    marks = pieces.mapInArrow(sort, f"m_ bigint, h_ bigint, marks {mark}, bucket int, windows binary")
    marks = marks.repartition("m_", "bucket").sortWithinPartitions("m_", "bucket").mapInArrow(meet, f"m_ bigint, h_ bigint, marks {mark}").unionAll(whole)
    hits = found.select("key", "place", "m", "h").join(marks.hint("merge"), (F.col("m") == F.col("m_")) & (F.col("h") == F.col("h_")))
    hits = hits.select(F.col("key").alias("of"), F.floor(F.col("place") / 2).cast("int").alias("start"), F.explode("marks").alias("x"))
    # equal texts bring equal marks: a set, built before the exchange
    hits = hits.groupBy("of").agg(F.collect_set(F.struct((F.col("start") + F.col("x.o")).alias("o"), F.col("x.l").alias("l"))).alias("xs"))
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, text_, n, xs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                gone = np.zeros(len(text_) + 1, np.int32)
                if n > 1 and len(text_) >= window:
                    gone[:-1] = 1
                elif xs:
                    np.add.at(gone, [x["o"] for x in xs], 1)
                    np.add.at(gone, [x["o"] + x["l"] + window - 1 for x in xs], -1)
                    gone = np.cumsum(gone)
                gone = gone[:-1] > 0
                left = np.frombuffer(text_, np.uint8)[~gone].tobytes()
                runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
                out.append((key, len(text_), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None)[: len(names)])
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: len(names)]
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    done = texts.join(hits.hint("merge"), texts["key"] == F.col("of"), "left").select("key", "data", "n", "xs")
    done = done.mapInArrow(cut, "key binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text)
    return rows.select(id_col, *carry, "key").join(done, "key").drop("key")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(read_table(spark, sf_dir, "documents"))
