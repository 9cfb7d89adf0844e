"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import re
import tempfile
import time
import uuid
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python: long documents make batches of
#: this many rows large, so it stays well below Spark's default of 10,000.
BATCH_ROWS = 500

#: Bytes of such a batch, beyond one row.
BATCH_BYTES = "8m"

#: Key of a row inside an operator. Ids may be null or repeat, so decisions
#: are joined back on the position of the row in the scan instead.
ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for executors with little memory.

    Results are lazy, so the setting has to hold until they are read; a session
    that has chosen a smaller size keeps it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def with_row(df: DataFrame) -> DataFrame:
    """``df`` with ROW, written once to the shared folder and read from there.

    The number that Spark gives a row depends on how files are packed into
    partitions, which may change between two jobs; so no job numbers rows anew.
    """
    return checkpoint(df.withColumn(ROW, F.monotonically_increasing_id()))


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the one named by ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder is set as the session's on a single machine, as in tests;
    a cluster has no such folder, so there it is an error.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder.

    Parquet takes a fraction of the space of a checkpoint of the RDD, and
    survives lost executors as well.
    """
    spark = df.sparkSession
    path = shared_path(spark, "step")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """A table in the shared folder like that of ``checkpoint``, bucketed by ``key``.

    Its rows stay where they are in joins by the key, at any size; only the
    other side is shuffled.
    """
    spark = df.sparkSession
    path = shared_path(spark, "buckets")
    name = f"quern_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd")
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(name)
    out = spark.table(name)
    _paths[out] = path
    _tables[out] = name
    return out


#: Where the tables of ``checkpoint`` and ``bucketed`` are, and the latter's names; an entry goes with its frame.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``checkpoint`` and ``bucketed`` that nothing reads any more."""
    for df in frames:
        if name := _tables.pop(df, None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path := _paths.pop(df, None):
            jvm = df.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has at most so many rows (they are counted).

    A larger one is joined by a shuffle, in which Spark splits skewed keys.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of frames that are no longer in use.

    The context cleaner removes them once the driver's JVM has collected their
    owners, which it otherwise does only when its heap fills.
    """
    for _ in range(3):  # an owner found dead in one pass frees what it owns in the next
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


@functools.cache
def _freeze() -> None:
    gc.collect()
    gc.freeze()


def _collect() -> None:
    """A full collection that passes over what the first one left: modules, most of all."""
    _freeze()
    gc.collect()


def trim() -> None:
    """Give memory that is no longer used back to the system.

    Python workers live on between tasks and would else keep the peak of each.
    """
    _collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    path = name if os.path.isabs(name) else public_tokenizers.path(name)
    return path


@functools.cache
def _weights(n: int, base: int, modulus_bits: int = 64) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    step = np.uint64(base)
    filled, power = 1, step
    while filled < n:
        take = min(filled, n - filled)
        with np.errstate(over="ignore"):
            out[filled : filled + take] = out[:take] * power
            power = power * power
        filled += take
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    size = 1 << max(12, int(n - 1).bit_length()) if n > 1 else 4096
    return _weights(size, base)[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit integers (a bijection)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return np.ascontiguousarray(x).view(np.int64)


def text_values(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes of an Arrow string array without nulls."""
    import xxhash

    values = pa.concat_arrays([values.cast(pa.large_binary())])
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64, count=len(values) + 1, offset=8 * values.offset) if len(values) else np.zeros(1, dtype=np.int64)
    first, last = int(ends[0]), int(ends[-1])
    data = data[first:last].to_pybytes() if last > first else b""
    at = (ends - first).tolist()
    parts = map(data.__getitem__, map(slice, at, at[1:]))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(values))


#: A-Z to a-z, and every ASCII white space to a blank, byte by byte.
_PLAIN = bytes(32 if b in (32, *range(9, 14)) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain_text(column: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case and blanks for ASCII white space."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.concat_arrays([column.cast(pa.large_string())])
    _, offsets, data = column.buffers()
    data = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(_PLAIN))
    return pa.LargeStringArray.from_buffers(len(column), offsets, data, offset=column.offset)


def coded_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each word, code of each word, distinct words).

    Words are maximal runs without ASCII white space; A-Z are lower-cased.
    """
    lists = pc.split_pattern(plain_text(column), " ")
    words = lists.flatten()
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(words, "")
    words, rows = words.filter(full), rows[full.to_numpy(zero_copy_only=False)]
    coded = words.dictionary_encode()
    return rows, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def ascii_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of every text, in order."""
    rows, codes, words = coded_words(column)
    hashes = hash_strings(words)
    return rows, hashes[codes] if len(hashes) else np.empty(0, dtype=np.uint64)
