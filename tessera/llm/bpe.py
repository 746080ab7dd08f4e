"""Byte-level BPE encoding and decoding in numpy.

Distinct pieces (matches of the split pattern) are put into matrices by length bucket. In each round every
row merges its leftmost pair of least rank, found through a hash table of pairs; rows shrink by one and
finished rows leave the matrix. A piece that is itself in the vocabulary keeps that one id. Pieces above
LONG bytes take a heap with the same order of merges, as rounds would cost the square of their length.
Ids of pieces are kept in a bounded cache per worker.

Edge cases: a null or empty text has no tokens (and the hash of no bytes); repeated rows are encoded
alike; an empty table gives an empty one; extra columns are dropped by ``encode`` but for the id.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm._common import read_table, small_batches

LONG = 256
CACHE = 300_000


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class PairTable:
    """Open addressing with linear probes: (left id, right id) -> merged id, or NONE."""

    NONE = np.int64(1 << 40)

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.dict = pairs
        self.bits = max(4, (2 * len(pairs)).bit_length() + 1)
        size = 1 << self.bits
        self.keys, self.values, self.probes = np.full(size, -1, np.int64), np.full(size, self.NONE, np.int64), 1
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        at = _slots(keys, self.bits)
        while len(keys):
            free = self.keys[at] < 0
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & (size - 1)
            self.probes += 1

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32 | right).ravel()
        out, at, todo = np.full(len(key), self.NONE), _slots(key, self.bits), np.flatnonzero(key >= 0)
        for _ in range(self.probes):
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        return out.reshape(left.shape)


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pairs = PairTable(self.ranks)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def _heap(self, piece: bytes) -> list[int]:
        ids, n = [int(self.byte[b]) for b in piece], len(piece)
        nxt, prv, look = [*range(1, n), -1], [-1, *range(n - 1)], self.pairs.dict.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := look(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = r, -1, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
                if (s := look(r << 32 | ids[nxt[i]])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[nxt[i]]))
            if prv[i] >= 0 and (s := look(ids[prv[i]] << 32 | r)) is not None:
                heapq.heappush(heap, (s, prv[i], ids[prv[i]], r))
        return [x for x in ids if x >= 0]

    def _rounds(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of one length bucket."""
        lens = np.array([len(p) for p in pieces])
        width = int(lens.max())
        mat = np.full((len(pieces), width), -1, np.int64)
        live = np.arange(width) < lens[:, None]
        mat[live] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        rows, ranks = np.arange(len(pieces)), self.pairs.look(mat[:, :-1], mat[:, 1:])
        ranks[(mat[:, :-1] < 0) | (mat[:, 1:] < 0)] = PairTable.NONE
        while True:
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), int)
            value = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), PairTable.NONE)
            done = value == PairTable.NONE
            for k in np.flatnonzero(done):
                out[rows[k]] = mat[k][mat[k] >= 0]
            if done.all():
                return out
            rows, mat, ranks, best, value = rows[~done], mat[~done], ranks[~done], best[~done], value[~done]
            cols, me = np.arange(mat.shape[1] - 1), np.arange(len(rows))
            take = cols + (cols > best[:, None])  # all but the right half of the merged pair
            mat = np.take_along_axis(mat, take, 1)
            mat[me, best] = value
            ranks = np.take_along_axis(ranks, np.minimum(take, ranks.shape[1] - 1), 1)[:, : mat.shape[1] - 1]
            for col in (best - 1, best):
                ok = (col >= 0) & (col < ranks.shape[1])
                left, right = mat[me[ok], col[ok]], mat[me[ok], col[ok] + 1]
                new = self.pairs.look(left, right)
                new[(left < 0) | (right < 0)] = PairTable.NONE
                ranks[me[ok], col[ok]] = new

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of these pieces into the cache."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            data = p.encode()
            if (whole := self.ranks.get(data)) is not None:
                self.cache[p] = whole.to_bytes(4, "little")
            elif len(data) > LONG:
                self.cache[p] = np.array(self._heap(data), "<u4").tobytes()
            else:
                buckets.setdefault((len(data) - 1).bit_length(), []).append((p, data))
        for group in buckets.values():
            for i in range(0, len(group), 20_000):
                part = group[i : i + 20_000]
                for (p, _), ids in zip(part, self._rounds([d for _, d in part]), strict=True):
                    self.cache[p] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        for i in range(0, len(texts), 64):
            split = [self.findall(t) for t in texts[i : i + 64]]
            new = set().union(*split).difference(self.cache)
            if new:
                if len(self.cache) + len(new) > CACHE:
                    self.cache.clear()
                    new = set().union(*split)
                self.learn(new)
            for pieces in split:
                yield b"".join(map(self.cache.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids (LE u32 bytes), ids_sha256, decoded_sha256); ``with_ids=False`` leaves the ids themselves out."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            got = list(c.encode([t or "" for t in b.column(1).to_pylist()]))
            cols = [b.column(0), pa.array([len(x) // 4 for x in got], pa.int64())]
            cols += [pa.array(got, pa.binary())] * with_ids
            cols += [pa.array([hashlib.sha256(x).hexdigest() for x in got], pa.string()), pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, {'ids binary, ' * with_ids}ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode(read_table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, with_ids=False)
