"""Shared plumbing: tables stashed in the cluster's checkpoint folder, Arrow text buffers, byte-level hashing in numpy."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; longer single texts are taken alone.
CHUNK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for stashed tables: ``spark.checkpoint.dir``; a temporary folder only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="billprism-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of a batch between the JVM and a Python worker; the setting it stands for is the session's again afterwards.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds Arrow batches by bytes while a job runs, as 10,000 rows may be long texts and an executor holds several batches at once."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def trim() -> None:
    """Gives a worker's free memory back to the machine, as idle workers stay beside those that run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns it reread, so its lineage ends there and executors may go."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/stash/{tag}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of jobs that are over. Executors keep them until the driver collects its garbage, and a driver with little to do may not before they come to several times the input."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Deletes all stashed tables below the shared folder, for sessions that live long: results that were not written are lost."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/stash")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unstash(*dfs: DataFrame) -> None:
    """Deletes stashed tables that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_stash_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


#: Parts into which spread_join cuts the rows of a key.
SPREAD = 64


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """left joined with right, which has a row for each key at most, on not-null keys: a key's rows on the left go to SPREAD tasks by the hash of ``by``.

    The keys on the left are made distinct where they are, so right's row meets SPREAD rows of a key, and each of these its part of the left.
    """
    left = left.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(SPREAD)))
    wanted = left.select(*keys, "_part").distinct().toDF(*keys, "_part").join(right, keys)
    return left.join(wanted, [*keys, "_part"]).drop("_part")


def let(value, body):
    """body of value, which is evaluated once; a column named twice in a lambda is evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Entries of an array that running_sums adds at once.
SUM_BLOCK = 256


def running_sums(numbers):
    """The sums of an array's beginnings; sums of whole blocks are made first, so an entry costs a block and not all before it."""

    def total(a, start, n):
        return F.aggregate(F.slice(a, start, n), F.lit(0).cast("long"), lambda s, x: s + x)

    def of(a):
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(SUM_BLOCK)), lambda i: total(a, i + 1, F.lit(SUM_BLOCK)))
        return let(blocks, lambda b: F.transform(a, lambda _, i: total(b, F.lit(1), F.floor(i / SUM_BLOCK).cast("int")) + total(a, (i - i % SUM_BLOCK + 1).cast("int"), (i % SUM_BLOCK + 1).cast("int"))))

    return let(numbers, of)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


# ---------------------------------------------------------------- Arrow text


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and n + 1 offsets into them; null is empty."""
    pa.default_memory_pool().release_unused()  # of earlier batches, as an executor's memory is shared with its JVM
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_utf8())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def spans_of(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts come to at most ``most`` bytes, or one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# ---------------------------------------------------------------- hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Word separators of the word and shingle operators: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of the texts, and the number of words of each text; words never span two texts."""
    n = len(offs) - 1
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    word = ~SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = offs[:-1][(offs[:-1] > 0) & (offs[:-1] < len(raw))]
    first[edge] |= word[edge]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[edge - 1] |= word[edge - 1]
    ends = np.flatnonzero(last) + 1
    per = np.diff(np.searchsorted(starts, offs))
    return starts, ends, per
