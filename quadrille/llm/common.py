"""What several operators share: staged tables, word boundaries and hashes of whole Arrow columns."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only if unset.

    A machine-local folder is taken in local mode alone; on a cluster without the setting the
    warehouse, which is shared too, serves."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if spark.sparkContext.master.split("[")[0] == "local":
        base = "file://" + tempfile.mkdtemp(prefix="quadrille-")
    else:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    spark.sparkContext.setCheckpointDir(base)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _discard_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            discard(spark, path)
    except Exception:  # noqa: BLE001  the session ended first
        pass


#: Rows that go to a Python worker at a time: texts and packed hashes are long rows.
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Fewer rows a batch, so that neither side of a Python worker holds much; another setting of the session's stays."""
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, "1000")


#: Whether Spark deletes the shuffle files of a query as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _few_processes(spark: SparkSession) -> dict[str, str]:
    """Options of a write by which Hadoop starts two processes a task on a local or mounted folder, not three; elsewhere they say nothing.

    Without its native library Hadoop runs chmod for each folder and file.  Until such a child runs its own program it shares its
    parent's memory, and whoever adds up processes sees the JVM's twice.  The class below the usual one writes no checksum
    files beside the data.  Another class that the session names stays."""
    usual = "org.apache.hadoop.fs.LocalFileSystem"
    if spark.sparkContext._jsc.hadoopConfiguration().get("fs.file.impl", usual) != usual:
        return {}
    return {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: its lineage ends there, and a lost executor
    costs no recomputation.  What the write shuffled goes with its end, not when the driver happens to collect its
    garbage, and the driver gives back the memory that it took.  Returns the table and its path; it goes when the program ends."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**_few_processes(spark)).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    release(spark)
    atexit.register(_discard_at_exit, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Ask the driver for a collection, after which Spark deletes shuffle files nothing refers to, and have its JVM give
    memory outside the heap back to the system: hundreds of threads plan and compile, and what they free stays in
    their arenas, some hundred MB after a thousand stages.  Now and then the executors collect as well."""
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)
    collect_executors(spark)


#: Seconds between collections of the executors, which take some tenths of one each; when the last one was.
_COLLECT_EVERY, _collected = 5.0, {"at": 0.0}


def collect_executors(spark: SparkSession) -> int:
    """Have each executor's JVM collect its garbage, after which its heap shrinks to a few times what it holds; by itself it only
    grows, up to its limit.  Returns how many were asked: none in local mode, where the driver's JVM is the only one, or
    if they were asked a moment ago."""
    n = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1
    if n < 1 or time.monotonic() < _collected["at"] + _COLLECT_EVERY:
        return 0
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc')").collect()  # idle executors get one task each
    _collected["at"] = time.monotonic()
    return n


def trim_jvm(spark: SparkSession) -> str:
    """What trim() does, for the driver's JVM, and what it says of it; "" if it cannot."""
    sc = spark.sparkContext
    lang, new = sc._jvm.java.lang, sc._gateway.new_array

    def array(kind, *values):
        out = new(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    named = getattr(lang, "Class").forName
    kinds = [named(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    try:
        # by reflection: the server's own class is not open to Py4J
        invoke = named("javax.management.MBeanServerConnection").getMethod("invoke", array(getattr(lang, "Class"), *kinds))
        command = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = array(lang.Object, command, "systemTrimNativeHeap", array(lang.Object, array(lang.String)), array(lang.String, "[Ljava.lang.String;"))
        return invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # another JVM, or an older one
        return ""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker and is shared by its tasks."""
    return sys.__dict__.setdefault("_quadrille", {}).setdefault(name, {})


def trim() -> None:
    """Give memory that a task no longer holds back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# --- words of a whole column ------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes of text whose prefix sums are held at a time.
_PIECE = 1 << 18


def _tables(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of bytes, and the powers of an odd base and of its inverse; `which` chooses among independent ones."""
    got = worker_cache(f"hash{which}")
    if not got:
        rng = np.random.default_rng(20240607 + which)
        base = _BASE if not which else int(rng.integers(1, 1 << 63, dtype=np.uint64)) * 2 + 1
        inverse = pow(base, -1, 1 << 64)
        ones = np.ones(_PIECE + 1, np.uint64)
        up, down = ones.copy(), ones.copy()
        up[1:], down[1:] = np.uint64(base), np.uint64(inverse)
        got.update(byte=rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return got["byte"], got["up"], got["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one after another, and where each row begins; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and row of every word: `[^\\x20\\x09-\\x0D]+`, or what stands between
    the bytes for which `between` is true."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~between[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge + 1]
    ends[edge - 1] = inside[edge]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(at, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and do not overlap.  `which`: of several hashes."""
    byte, up, down = _tables(which)
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        low = start[i]
        j = int(np.searchsorted(end, low + _PIECE, "right"))
        if j <= i:  # one span of over _PIECE bytes
            h = np.uint64(0)
            for a in range(int(low), int(end[i]), _PIECE):
                part = data[a : min(a + _PIECE, int(end[i]))]
                h = mix(np.array([h + (byte[part] * up[: len(part)]).sum(dtype=np.uint64)], np.uint64))[0]
            out[i] = h
            i += 1
            continue
        part = data[low : end[j - 1]]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(byte[part] * up[: len(part)], dtype=np.uint64, out=total[1:])
        a, b = start[i:j] - low, end[i:j] - low
        out[i:j] = (total[b] - total[a]) * down[a]
        i = j
    return mix(out)


def by_bytes(batch: pa.RecordBatch, name: str, most: int = 1 << 20):
    """Slices of batch of about so many bytes of text; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, the first bytes of all, then the second ones: short for a codec."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)
