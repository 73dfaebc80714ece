"""Helpers shared by the text operators: table access, shared folders, Arrow buffers and word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+`` as a byte table.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Byte table that lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Text bytes that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def small_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Bound what a batch of long texts holds, for the rest of this session: bytes and rows of an Arrow batch, and
    rows of a batch of the Parquet reader. Settings that are smaller already stay."""
    for name, value in (("execution.arrow.maxBytesPerBatch", size), ("execution.arrow.maxRecordsPerBatch", 2000), ("parquet.columnarReaderBatchSize", 512)):
        key = f"spark.sql.{name}"
        if int(spark.conf.get(key, str(value + 1))) > value or int(spark.conf.get(key, "0")) <= 0:
            spark.conf.set(key, str(value))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which the driver and all executors see.

    Where that setting is absent, a temporary folder is made and set if all tasks run in this process; on a
    cluster that is an error, as executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="cellbeam-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stash(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stash(spark: SparkSession, path: str) -> None:
    """Delete a stashed table that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on, and others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def narrow(arr: pa.Array) -> pa.Array:
    """Texts or bytes with 32-bit offsets, whatever the session sends."""
    kind = {pa.large_string(): pa.string(), pa.string_view(): pa.string(), pa.large_binary(): pa.binary(), pa.binary_view(): pa.binary()}.get(arr.type)
    return arr.cast(kind) if kind else arr


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES):
    """Cut a batch into row ranges of about ``limit`` bytes of ``column``; rows stay whole."""
    arr = narrow(batch.column(batch.schema.get_field_index(column)))
    ends = np.frombuffer(arr.buffers()[1], np.int32, len(arr) + 1, arr.offset * 4).astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    at = 0
    while at < len(arr):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, min(to, len(arr)) - at)
        at = min(to, len(arr))
    give_back()


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 row bounds in them. A null row is empty."""
    arr = narrow(arr)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) else b"")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(arr.buffers()[1], np.int32, n + 1, arr.offset * 4).astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0]) if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal True runs of ``inside``, cut at the row bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = bounds[(bounds > 0) & (bounds < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)


def powers(n: int, base: np.uint64) -> np.ndarray:
    """1, b, b^2 ... modulo 2^64."""
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        step = base
        while done <= n:
            take = min(done, n + 1 - done)
            out[done : done + take] = out[:take] * step
            done += take
            step = step * step
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes."""
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers(max(len(raw) - 1, 0), _BASE)[: len(raw)], out=total[1:])
        down = powers(len(raw), inverse)
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the n + 1 per-row bounds of the words ``[^\x20\x09-\x0D]+``."""
    starts, ends = runs(~SPACE[raw], bounds)
    return starts, ends, np.searchsorted(starts, bounds)


def strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
