"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt into P logical partitions by a hash of their content, so a lost task finds the same rows
again. The matrix says how many rows each partition sends to each block of each shard: multivariate
hypergeometric rows, with column sums equal to the exact block sizes. It is never held whole: a tree halves
the partitions, each node splits what its blocks take between its halves by a draw seeded with the node's
place, and a task that needs the row of a partition follows one path of the tree. Only the partition sizes
go through the driver. Each partition is permuted by a seeded hash and cut by its row of the matrix, rows
are exchanged, and each block is permuted again. A row's slot is its block's start plus its rank there, so
slots are gapless without a further exchange. Partitions and blocks hold about PART_ROWS rows, and the
square root of the table's rows where that is more, so tasks and matrix rows grow with the root.

Rows that are equal in all columns share a hash. Where one hash has more rows than a partition should, its
rows are dealt by their place in the read (equal rows are interchangeable, but the input must come in the
same order when it is read again, as files do). Above 10**9 rows a draw that numpy can't make is a rounded
normal with the same mean and variance, inside the exact bounds.

Edge cases: an empty table gives no rows; a null text has size 1 and the checksum of no bytes; repeated
rows are dealt like any others; extra columns pass through, and columns named like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._common import read_table

PART_ROWS = 4_000
SEED = 17
#: What numpy's hypergeometric draws allow.
LARGEST = 10**9


def _drawn(rng: np.random.Generator, colors: np.ndarray, n: int) -> np.ndarray:
    """How many of n balls, taken without return, have each color."""
    if int(colors.sum()) < LARGEST:
        return rng.multivariate_hypergeometric(colors, n, method="marginals")
    if len(colors) == 1:
        return np.array([n], np.int64)
    half = len(colors) // 2
    good, bad = int(colors[:half].sum()), int(colors[half:].sum())
    if good + bad < LARGEST:
        k = int(rng.hypergeometric(good, bad, n)) if n else 0
    else:
        share = good / (good + bad)
        spread = math.sqrt(n * share * (1 - share) * max(0.0, (good + bad - n) / (good + bad - 1)))
        k = min(max(round(rng.normal(n * share, spread)), max(0, n - bad)), min(good, n))
    return np.concatenate([_drawn(rng, colors[:half], k), _drawn(rng, colors[half:], n - k)])


def matrix_row(p: int, ends: np.ndarray, blocks: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows that partition p sends to each block; ends: rows of partitions 0..i. Over all p: a uniform draw given both margins."""
    low, high, left = 0, len(ends), blocks
    upto = lambda i: int(ends[i - 1]) if i else 0
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, low, high])))
        first = _drawn(rng, left, upto(mid) - upto(low))
        low, high, left = (low, mid, first) if p < mid else (mid, high, left - first)
    return left


def near_equal(total: int, parts: int) -> list[int]:
    """Sizes at most one apart."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = SEED, part_rows: int = PART_ROWS) -> DataFrame:
    """All columns of df plus shard (0..n_shards-1) and slot (0.. in each shard); counts are at most one apart."""
    own = [c for c in df.columns if c not in ("shard", "slot")]
    plain = [F.to_json(F.struct(c)) if df.schema[c].dataType.typeName() in ("map", "struct", "variant") else F.col(f"`{c}`") for c in own]
    df = df.select(F.struct(*[f"`{c}`" for c in own]).alias("_row"), F.xxhash64(F.lit(seed), *plain).alias("_h"))  # own columns can't clash with helpers
    total = df.count()
    per = max(part_rows, math.isqrt(total))
    parts = max(1, -(-total // per))
    deal = lambda c: F.pmod(F.xxhash64(F.lit(seed + 1), c), F.lit(parts)).cast("int")
    part = deal(F.col("_h"))
    # Hashes are counted inside partitions first; what is gathered is one number a partition, and the hashes of more than ``per``
    # rows: at most total / per of them.
    hot = [r["_h"] for r in df.groupBy("_h").count().where(F.col("count") > per).select("_h").collect()]
    if hot:
        part = F.when(F.col("_h").isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).otherwise(part)
    df = df.withColumn("_p", part)
    counts = dict(df.groupBy("_p").count().collect())
    ends = np.cumsum([counts.get(p, 0) for p in range(parts)], dtype=np.int64)
    sizes = near_equal(total, n_shards)
    each = max(1, -(-max(sizes) // per))  # blocks of a shard
    blocks = np.array([b for s in sizes for b in near_equal(s, each)], np.int64)
    starts = [int(sum(blocks[s * each : b])) for s in range(n_shards) for b in range(s * each, (s + 1) * each)]

    @F.pandas_udf("int")
    def block_of(cols: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """The block of the r-th row of partition p; a partition's rows come together, so its row of the matrix is drawn once or so."""
        last, upto = -1, np.zeros(0, np.int64)
        for p, r in cols:
            p, r, out = p.to_numpy(), r.to_numpy(), np.zeros(len(p), np.int32)
            cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1), len(p)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if p[a] != last:
                        last, upto = p[a], matrix_row(int(p[a]), ends, blocks, seed).cumsum()
                    out[a:b] = np.searchsorted(upto, r[a:b], side="left")
            yield pd.Series(out)

    rank = F.row_number().over(W.partitionBy("_p").orderBy(F.xxhash64(F.lit(seed + 2), "_h"), "_h"))
    sent = df.withColumn("_r", rank).withColumn("_b", block_of("_p", "_r")).drop("_r", "_p")
    base = F.element_at(F.from_json(F.lit(str(starts)), "array<bigint>"), F.col("_b") + 1)
    again = F.row_number().over(W.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + 3), "_h"), "_h"))
    return sent.select("_row.*", F.floor(F.col("_b") / each).cast("int").alias("shard"), (base + again - 1).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return shuffle_into_shards(docs, 16).select(
        "doc_id", (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
