"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: each record is one gzip member. Files are written under a name of their own for each attempt and
renamed when whole, so a task that runs twice leaves one file. Reading: tasks take byte ranges of the
files, look for the gzip magic, decode the start of each candidate member and accept it when a WARC
header follows; a record belongs to the range in which its member starts, and is read past the range's
end. Files are opened through pyarrow's file systems by URI (a local shared folder, hdfs, object stores).

Edge cases: null payloads are empty; records of equal payloads (of ``min_bytes`` or more) revisit the one
with the largest id; rows repeated in full, id included, are records of their own and all of them that
carry the largest id are responses; a null id is written as no id and sorts below all others; an empty
table gives no file and no record; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import read_table, small_batches, work_dir

MAGIC = b"\x1f\x8b\x08"
RANGE = 8 << 20
#: What a range task reads at once, and beyond its range to finish its last record.
STEP = 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w[\w+.-]*:", uri) else f"file://{uri}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key, digest: str) -> str:
    return f"<urn:page:{'' if key is None else key}:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {digest}')}>"


def record(key, url: str, payload: bytes | None, size: int, digest: str, refers) -> bytes:
    """One gzip member. Without a payload: a revisit."""
    block = HTTP + (payload or b"") if payload is not None else HTTP
    kind = "response" if payload is not None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key, digest)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {url}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", f"X-Page-ID: {'' if key is None else key}"]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers, digest)}"]
    raw = ("WARC/1.1\r\n" + "\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write(df: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archives now; returns (path, bytes) of the files."""
    small_batches(df.sparkSession, 1000)
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    df = df.select(F.col(id_col).alias("id"), F.translate(F.coalesce(F.col(url), F.lit("")), "\r\n", "").alias("url"), data.alias("data"))
    df = df.select("id", "url", "data", F.octet_length("data").cast("long").alias("size"), F.sha1("data").alias("sha"), F.unhex(F.sha2("data", 256)).alias("same"))
    small = df.where(F.col("size") < min_bytes).select("id", "url", "data", "size", "sha", F.lit(None).cast("long").alias("refers"))
    large = df.where(F.col("size") >= min_bytes) if min_bytes else df
    # The payload of a group is shuffled once for each map task at most: the row with the largest id, and light rows for all.
    tops = large.groupBy("same").agg(F.max(F.struct("id", "data")).alias("top"))
    light = large.select("id", "url", "size", "sha", "same").join(large.groupBy("same").agg(F.max("id").alias("last")), "same")
    revisits = light.where(~F.col("id").eqNullSafe(F.col("last"))).select("id", "url", F.lit(None).cast("binary").alias("data"), "size", "sha", F.col("last").alias("refers"))
    firsts = light.where(F.col("id").eqNullSafe(F.col("last"))).join(tops, "same")
    responses = firsts.select("id", "url", F.col("top.data").alias("data"), "size", "sha", F.lit(None).cast("long").alias("refers"))
    rows = responses.unionAll(revisits)
    if min_bytes:
        rows = rows.unionAll(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        size = 0
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    fs, root = file_system(folder)
                    fs.create_dir(root)
                    name = f"{root}/{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{name}.part", compression=None)
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                member = record(r["id"], r["url"], r["data"], r["size"], digest, r["refers"])
                size += len(member)
                out.write(member)
        if out is not None:
            out.close()
            fs.move(f"{name}.part", f"{name}.warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}.warc.gz"]), pa.array([size], pa.int64())], names=["path", "bytes"])

    files = rows.mapInArrow(run, "path string, bytes bigint")
    listed = [tuple(r) for r in files.collect()]  # a file name and size from each task whose result counts
    return df.sparkSession.createDataFrame(listed, "path string, bytes bigint")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def members(f, start: int, end: int, size: int) -> Iterator[bytes]:
    """Records whose gzip member starts in start..end of an open file of this size."""
    base, buf = start, b""
    f.seek(start)

    def more() -> bool:
        nonlocal buf
        got = f.read(STEP)
        buf += got
        return bool(got)

    at = 0
    while base + at < end:
        hit = buf.find(MAGIC, at)
        if hit < 0 or base + hit >= end:
            keep = max(at, len(buf) - 2) if hit < 0 else hit
            if hit >= 0 or base + keep >= end or not more():
                return
            buf, base, at = buf[keep:], base + keep, 0
            continue
        z, raw, ok, fed = zlib.decompressobj(31), [], True, hit
        got = 0
        while not z.eof:
            if fed >= len(buf) and not more():
                ok = False
                break
            try:
                part = z.decompress(buf[fed : fed + (4096 if fed == hit else STEP)])
            except zlib.error:
                ok = False
                break
            fed += 4096 if fed == hit else STEP
            fed = min(fed, len(buf))
            raw.append(part)
            got += len(part)
            if got >= 5 and len(raw) and not b"".join(raw[:2])[:5] == b"WARC/":
                ok = False
                break
        if ok and (text := b"".join(raw))[:5] == b"WARC/":
            yield text
            at = fed - len(z.unused_data)
        else:
            at = hit + 1
        if at > 4 * STEP:
            buf, base, at = buf[at:], base + at, 0


def read(files: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Records of the listed files (path, bytes): id, payload (null for revisits), sizes, digests, type, refers_to."""
    spark = files.sparkSession
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(1, spark.sparkContext.defaultParallelism), "path", "start")
    names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"]
    kind = "page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, url string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, path = file_system(r["path"])
                rows: list[tuple] = []
                held = 0
                with fs.open_input_file(path) as f:
                    for text in members(f, r["start"], min(r["start"] + range_bytes, r["bytes"]), r["bytes"]):
                        head, _, block = text.partition(b"\r\n\r\n")
                        h = _fields(head)
                        block = block[: int(h["content-length"])]
                        key = int(h["x-page-id"]) if h["x-page-id"] else None
                        if h["warc-type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            rows.append((key, "response", len(payload), digest_of(payload), None, h["warc-target-uri"], payload))
                            held += len(payload)
                        else:
                            m = re.search(r"page:(-?\d+)", h["warc-refers-to"])
                            rows.append((key, h["warc-type"], int(h["x-payload-length"]), h["warc-payload-digest"].partition(":")[2], int(m[1]) if m else None, h["warc-target-uri"], None))
                        if held > 16 << 20:
                            yield _batch(rows, names)
                            rows, held = [], 0
                yield _batch(rows, names)

    return ranges.mapInArrow(run, kind)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    files = write(pages, f"{work_dir(spark)}/warc")
    return read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
