"""Shared helpers of the text operators: tables, shared-folder materialisation, hashing.

Everything that runs on executors is numpy over Arrow batches; nothing here
keeps state between tasks, so a lost executor only repeats its own tasks.
"""

from __future__ import annotations

import atexit
import gc
import hashlib
import math
import tempfile
import time
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words (space and U+0009..U+000D).
WORD_BREAKS = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression for native plans.
WORD_BREAK_REGEX = r"[ \\x09-\\x0D]+"

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; operators on it pass small batches to Python."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared folder


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session sets none and runs on one machine (local mode, as in
    tests) a temporary folder is made and set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fauntrack-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder is scratch space
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


#: A lookup table up to this many bytes may be broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 16_000_000


def sized(df: DataFrame, bytes_a_row: int) -> DataFrame:
    """df, marked for broadcast only if its rows have been counted and stay below BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * bytes_a_row <= BROADCAST_BYTES else df


#: A key that holds this share of all rows or more is joined by broadcast: there are HOT_SHARE such keys at most.
HOT_SHARE = 4096


def join_hot(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined to facts (a written table with one row a key, `weight` telling how many of rows have it), without a hot task.

    Keys that hold at least one in HOT_SHARE of all rows are broadcast (at most
    HOT_SHARE keys, whatever the input); the rows of the others are shuffled.
    how is inner or left.
    """
    count, total = facts.agg(F.count("*"), F.sum(weight)).first()
    facts_ = facts.drop(weight)
    if count * 64 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts_), on, how)
    is_hot = F.col(weight) * HOT_SHARE >= (total or 0)
    hot = F.broadcast(facts.where(is_hot).drop(weight))
    cold = rows.join(F.broadcast(facts.where(is_hot).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(cold.join(facts.where(~is_hot).drop(weight), on, how))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever the case of its own."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


#: Most rows and bytes of an Arrow batch between JVM and Python: bounds the memory of both sides.
BATCH_ROWS, BATCH_BYTES = 2000, "12m"


def small_batches(spark: SparkSession) -> None:
    """Ask for small Arrow batches in this session: texts are long, and two workers share an executor's spare memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_RELEASED = [0.0]


def release(spark: SparkSession) -> None:
    """Let the driver notice that finished shuffles are no longer referenced, so that their files go; once a second at most."""
    if time.monotonic() - _RELEASED[0] < 1:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _RELEASED[0] = time.monotonic()


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_for(size: int, each: int, least: int = 1) -> int:
    """How many blocks of about `each` units hold `size` units: grows with the input, no upper limit."""
    return max(least, math.ceil(max(0, size) / each))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; one number reaches the driver."""
    return text_totals(docs, column)[0]


def text_totals(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Bytes of all texts, and the number of rows."""
    row = docs.agg(F.sum(F.octet_length(column)).alias("b"), F.count("*").alias("n")).first()
    return int(row["b"] or 0), int(row["n"])


def hash_sample(df: DataFrame, keys: list[str], rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, twice as many at most, chosen by a hash of keys: a filter, no sort and no shuffle of what is not chosen."""
    share = min(1 << 40, (rows << 40) // max(1, total))
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < share).limit(2 * rows)


# ---------------------------------------------------------------- hashing


@lru_cache(maxsize=4)
def _byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 16
    while size < n:
        size *= 2
    up, down = _powers(size)
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: From this many bytes on a span is hashed by a digest.
_LONG = 512


def strong_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit names of buf[start:end]: eight bytes a step, each step a permutation of the state; long spans by a digest.

    Unlike span_hash, no two spans of a length are sure to meet, whatever their
    pattern, so that equal names may stand for equal bytes.
    """
    wide = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    size = end - start
    h = mix(size.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed * 2 + 1))
    live = np.flatnonzero((size > 0) & (size < _LONG))
    at, left = start[live], size[live]
    while len(live):
        x = wide[at]
        last = left < 8
        x[last] &= (U64(1) << (left[last].astype(np.uint64) * U64(8))) - U64(1)
        h[live] = mix((h[live] ^ x) * U64(0xD6E8FEB86659FD93) + U64(0xA0761D6478BD642F))
        go = left > 8
        live, at, left = live[go], at[go] + 8, left[go] - 8
    for k in np.flatnonzero(size >= _LONG):
        h[k] = int.from_bytes(hashlib.blake2b(buf[start[k] : end[k]].tobytes(), digest_size=8, key=seed.to_bytes(4, "little")).digest(), "little")
    return h


def prefix_hash(buf: np.ndarray, seed: int = 7) -> np.ndarray:
    """Polynomial prefix sums of bytes modulo 2**64; see span_hash.

    Cheap, but some patterns of unlike bytes meet for certain: good for finding
    candidates only. Where equality is concluded, use strong_hash or a digest.
    """
    out = np.zeros(len(buf) + 1, np.uint64)
    up, _ = powers(len(buf) + 1)
    np.cumsum(_byte_table(seed)[buf] * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of buf[start:end] for arrays of spans: equal bytes give equal values wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def mix_int(x: int, seed: int = 0) -> int:
    """Same permutation for one Python number."""
    return int(mix(np.array([(x ^ seed) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


# ---------------------------------------------------------------- Arrow


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copying, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Split rows into runs of about `most` bytes; a longer text stands alone."""
    out, start = [], 0
    n = len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(end, start + 1))
        out.append((start, end))
        start = end
    return out


def frame(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of the given schema from numpy arrays, Arrow arrays or lists."""
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(k).type) for k, c in columns.items()], schema=schema)
