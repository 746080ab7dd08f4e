"""Shared helpers: work folder, staged tables, text buffers, 64-bit hashing, components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Folder shared by the driver and all executors: ``spark.checkpoint.dir``.

    Only a session on one machine (tests) gets a local folder without that setting; on a cluster its lack is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="tessera-"))
    return f"{base.rstrip('/')}/tessera/{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "t", rows_a_file: int = 0) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors. Zero: files of any number of rows."""
    path = f"{work_dir(df.sparkSession)}/{name}"
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(*dfs: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in dfs:
        for f in df.inputFiles()[:1]:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the Arrow batches of text rows (whole texts may be long)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    elif not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]] if len(offs) else data[:0], offs - (offs[0] if len(offs) else 0)


BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a little-endian number; past the end: zeros."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", pad, strides=(1,))


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end of each range: 8 at a time through a mixing permutation, so no linear relation of bytes carries over."""
    words, n, k = loads(data), end - start, 0
    h, live = mix(n.astype(np.uint64) * BASE + np.uint64(1)), np.flatnonzero(n > 0)
    while len(live):
        left = n[live] - k
        w = words[start[live] + k]
        short = np.flatnonzero(left < 8)
        w[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        h[live] = mix(h[live] ^ w) + BASE
        k += 8
        live = live[left > 8]
    return h


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes (8 at least) from each position that has as many, by doubling."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    h, span = mix(loads(data)), 8
    while span < width:
        step = min(span, width - span)
        h = mix(h[:-step] * BASE + h[step:])
        span += step
    return h[: len(data) - width + 1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large and small stars.

    Takes links (a, b) of longs; returns (node, root) for every node that is not itself the smallest of
    its component. A round is two aggregations and joins on whole tables; the edges are staged each
    round. Nothing is collected but a count and a checksum. Self links and repeats are allowed. A hub's links are
    split at run time: for that, the minima are exchanged anew (``anew``), so both sides of a join are plain exchanges.
    """
    anew = F.col("u").bitwiseXOR(F.lit(0)).alias("u")  # the same values, but not known to be dealt by u already
    e = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    seen = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(anew, "m")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low.select(anew, "m"), "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        new = stage(small.where("u != v").distinct(), "edges")
        state = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop_staged(e)
        e = new
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
