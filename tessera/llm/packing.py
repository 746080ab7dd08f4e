"""Packing token sequences: shortest-pack-first over the length histogram.

Documents are tokenized, closed by an end id and cut into pieces of at most ``width`` ids (full pieces and
one rest). Only the histogram of piece lengths, at most ``width`` numbers, reaches the driver. Lengths are
placed longest first, each into the pattern with the least filled room that still holds it (the shortest
pack), splitting pattern counts as they are used up. Patterns then become slots: a slot says which ranks of
a length go to which sequences at which offset, and is found by bisection. Ranks within a length are dealt by
buckets of a hash, each as large as the square root of the length's pieces, with bucket offsets from their counts, so no task holds all
pieces of a length at any size.

Edge cases: a null or empty text is a document of the end id alone; an empty table gives no pieces;
repeated rows are packed each on their own; ``pieces_of`` carries no extra columns, so none can clash; ``pack`` carries
all of its input's and replaces none (its helpers live beside them in a struct).
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._common import read_table, small_batches, stage

WIDTH = 2048
END = 1
CACHE = 500_000
#: Rows of one bucket of a length, about, or the square root of the length's rows where that is more.
BUCKET_ROWS = 500
#: How the file of a tokenizer must cut words for ``WordCache`` to take them one by one: these parts of it are compared.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


_TAIL = b".,;:!?"


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def cuts_words(file: dict) -> bool:
    """Whether a tokenizer's file lower-cases, drops white space and tokenizes runs of letters each on their own, as ``WordCache`` supposes."""
    pre = file.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers") or [{}, {}]
    split = parts[0].get("pattern") == {"Regex": SPLIT} and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
    level = parts[-1].get("type") == "ByteLevel" and not parts[-1].get("add_prefix_space") and not parts[-1].get("use_regex")
    plain = not any(file.get(k) for k in ("truncation", "padding")) and not file["model"].get("dropout")
    return file.get("normalizer") == NORMAL and len(parts) == 2 and split and level and plain


class WordCache(dict):
    """Ids of a word as little-endian u32 bytes; a tokenizer of another make (``cuts_words``) takes whole texts. No token of this vocabulary spans white space, so texts may be cut there.

    A word of Latin-1 letters, with or without marks after it, is one pre-token (and one for the marks): the model takes
    it as it is, in lower case. Any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            self.by_word = cuts_words(json.load(f))
        self.word = self.tok.model.tokenize
        self.letters = byte_letters()

    def __missing__(self, w: bytes) -> bytes:
        core = w.rstrip(_TAIL)
        if len(core) < len(w) and core.isalpha():
            got = self[core] + self[w[len(core) :]]
        elif w.isalpha():
            low = w.lower()
            got = self[low] if low != w else np.array([t.id for t in self.word(w.decode())], "<u4").tobytes()
        else:
            text = w.decode()
            if text.isalpha() and max(text) < "\u0100":
                ids = [t.id for t in self.word("".join(map(self.letters.__getitem__, text.lower().encode())))]
            else:
                ids = self.tok.encode(text, add_special_tokens=False).ids
            got = np.array(ids, "<u4").tobytes()
        self[w] = got
        return got

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        for t in texts:
            if not self.by_word:
                yield np.array(self.tok.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes()
                continue
            if len(self) > CACHE:
                self.clear()
            yield b"".join(map(self.__getitem__, t.split()))


_CACHES: dict[str, WordCache] = {}


def pieces_of(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): a row per piece."""
    small_batches(df.sparkSession)
    close = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in _CACHES:
            _CACHES[path] = WordCache(path)
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            rows: list[tuple] = []
            for i, ids in enumerate(_CACHES[path].ids(texts)):
                data, n = ids + close, len(ids) // 4 + 1
                for s in range(0, n, width):
                    part = data[4 * s : 4 * (s + width)]
                    rows.append((i, s, len(part) // 4, zlib.crc32(part), n, part))
            who, start, length, crc, total, part = zip(*rows, strict=True) if rows else ((),) * 6
            cols = [b.column(0).take(pa.array(who, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(part, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids)


def patterns(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many packs): shortest pack first, lengths from the longest down."""
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(width + 1)]  # by room left
    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left = histogram[length]
        while left:
            room = next((r for r in range(width, length - 1, -1) if open_[r]), None)  # the shortest pack has the most room
            if room is None:
                fit = width // length
                full, rest = divmod(left, fit)
                for k, n in ((fit, full), (rest, 1 if rest else 0)):
                    if n:
                        key = (length,) * k
                        open_[width - k * length][key] = open_[width - k * length].get(key, 0) + n
                break
            pack, count = open_[room].popitem()
            use = min(count, left)
            if count > use:
                open_[room][pack] = count - use
            key = (*pack, length)
            open_[room - length][key] = open_[room - length].get(key, 0) + use
            left -= use
    return [(p, n) for packs in open_ for p, n in sorted(packs.items())]


def slots_of(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) of every place in every pattern."""
    used: dict[int, int] = {}
    out, base = [], 0
    for lengths, count in packs:
        offset = 0
        for x in lengths:
            out.append((x, used.get(x, 0), count, base, offset))
            used[x] = used.get(x, 0) + count
            offset += x
        base += count
    return out


def pack(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """Add sequence_id and offset to a table with a ``length`` column (1..width). It is read four times: stage it first."""
    cols = pieces.columns
    histogram = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most ``width`` rows
    buckets = F.element_at(F.from_json(F.lit(str([-(-n // max(BUCKET_ROWS, math.isqrt(n))) for n in (histogram.get(x, 1) for x in range(1, width + 1))])), "array<bigint>"), F.col("length").cast("int"))
    row = F.struct(*[f"`{c}`" for c in cols]).alias("_row")  # own columns can't clash with helpers
    keyed = pieces.select(row, "length", F.xxhash64(*[f"`{c}`" for c in cols]).alias("_h")).withColumn("_b", F.pmod("_h", buckets).cast("int"))
    sizes = keyed.groupBy("length", "_b").count()  # at most the square root of its pieces for each length
    before = F.sum("count").over(W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("length", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    slots: dict[int, list] = {}
    for x, *rest in slots_of(patterns(histogram, width)):
        slots.setdefault(x, []).append(rest)
    table = {x: np.array(sorted(v), np.int64) for x, v in slots.items()}  # first rank, ranks, first sequence, offset: patterns, not pieces

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, k: pd.Series) -> pd.DataFrame:
        """Where the k-th piece of a length goes: its slot is found by bisection."""
        length, k = length.to_numpy(), k.to_numpy()
        seq, at = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        for x in np.unique(length):
            own = np.flatnonzero(length == x)
            t = table[int(x)]
            i = np.searchsorted(t[:, 0], k[own], side="right") - 1
            seq[own], at[own] = t[i, 2] + k[own] - t[i, 0], t[i, 3]
        return pd.DataFrame({"sequence_id": seq, "offset": at})

    rank = F.row_number().over(W.partitionBy("length", "_b").orderBy("_h", "_row"))
    ranked = keyed.withColumn("_k", rank - 1).join(offsets, ["length", "_b"])
    return ranked.withColumn("_s", place("length", F.col("_k") + F.col("_before"))).select("_row.*", "_s.sequence_id", "_s.offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(stage(pieces_of(read_table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), with_ids=False), "pieces"))
