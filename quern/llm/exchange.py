"""Exchange of sorted keys between chunks of rows and buckets of keys.

A *chunk* asks about its distinct keys: sorted 64-bit integers, coded by their
differences, with a value of a fixed type beside each. They are cut by ranges
of the key into *buckets*. A bucket sees all that was asked about its range and
answers each question with one value. So a hot key costs one key for each chunk
that holds it, and no task gets more than a range of keys.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKET_KEYS = 1_000_000  # about the keys that a task compares
ASKED = "bucket int, chunk long, keys binary, more binary"
#: Number of the chunk of a row that holds what a bucket tells besides its answers.
NOTE = -1


def coded(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and differences of as many bytes as the largest needs."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    body = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(body).tobytes()


def decoded(blob: bytes) -> np.ndarray:
    width = blob[0]
    if len(blob) < 9:
        return np.empty(0, dtype=np.uint64)
    body = np.frombuffer(blob, dtype=np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(body) + 1, 8), dtype=np.uint8)
    wide[1:, :width] = body
    wide[0] = np.frombuffer(blob, dtype=np.uint8, count=8, offset=1)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


@functools.cache
def _zstd() -> tuple:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(values: np.ndarray) -> bytes:
    """Values, byte plane by byte plane and compressed: most are small numbers."""
    return _zstd()[0].compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).data)


def unpacked(blob: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(_zstd()[1].decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def answers_of(blobs: list[bytes] | None, kind) -> np.ndarray:
    """The answers to a chunk, from the blobs of ``by_chunk``."""
    return np.concatenate([unpacked(b, kind) for b in blobs]) if blobs else np.empty(0, dtype=kind)


def buckets_for(keys: int, each: int = BUCKET_KEYS) -> int:
    return max(1, -(-keys // each))


def cut(keys: np.ndarray, buckets: int, span: int = 1 << 64) -> np.ndarray:
    """Places where sorted keys below ``span`` go to another bucket, ends included."""
    step = -(-span // buckets)
    ends = np.searchsorted(keys, np.array([min((1 << 64) - 1, i * step) for i in range(1, buckets)], dtype=np.uint64))
    return np.concatenate([[0], ends, [len(keys)]]).astype(np.int64)


def questions(chunk: int, keys: np.ndarray, more: np.ndarray, buckets: int, span: int = 1 << 64) -> pa.RecordBatch:
    """Rows of ASKED for sorted keys with something beside each."""
    bounds = cut(keys, buckets, span)
    full = np.flatnonzero(np.diff(bounds))
    pairs = [(int(bounds[i]), int(bounds[i + 1])) for i in full]
    return pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array([chunk] * len(full), pa.int64()), pa.array([coded(keys[a:b]) for a, b in pairs], pa.binary()), pa.array([packed(more[a:b]) for a, b in pairs], pa.binary())],
        names=["bucket", "chunk", "keys", "more"],
    )


def told(asked: DataFrame, buckets: int, answer: Callable, kind) -> DataFrame:
    """(chunk, bucket, codes): the answers of each bucket to each chunk.

    ``answer`` gets the keys of one bucket, what came with each (of numpy type
    ``kind``), the number of its asker and the bucket's; it gives an array of
    answers, bytes for the bucket's NOTE or None, and which answers to send
    (None: all).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        bucket = None

        def done() -> pa.RecordBatch:
            parts = [decoded(keys) for _, keys, _ in held]
            own = np.repeat(np.arange(len(held)), [len(p) for p in parts])
            codes, note, send = answer(np.concatenate(parts), np.concatenate([unpacked(m, kind) for _, _, m in held]), own, bucket)
            if send is not None:
                codes, own = codes[send], own[send]
            chunks = [c for c, _, _ in held]
            blobs = [packed(x) for x in np.split(codes, np.cumsum(np.bincount(own, minlength=len(held)))[:-1])]
            if note is not None:
                chunks, blobs = [*chunks, NOTE], [*blobs, note]
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([bucket] * len(chunks), pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "bucket", "codes"])

        for batch in batches:
            for b, c, k, m in zip(*(batch[n].to_pylist() for n in ("bucket", "chunk", "keys", "more")), strict=True):
                if b != bucket and held:
                    yield done()
                    held = []
                bucket = b
                held.append((c, k, m))
        if held:
            yield done()
        common.trim()

    sorted_rows = asked.repartitionById(buckets, F.col("bucket") % buckets).sortWithinPartitions("bucket", "chunk")
    return sorted_rows.mapInArrow(run, "chunk long, bucket int, codes binary")


def by_chunk(answers: DataFrame) -> DataFrame:
    """(chunk, note, codes): the blobs of answers to each chunk, in the order of its keys.

    A NOTE stays a row of its own; ``note`` is its bucket, else null.
    """
    parts = F.array_sort(F.collect_list(F.struct("bucket", "codes")))
    note = F.when(F.col("chunk") == NOTE, F.col("bucket")).alias("note")
    return answers.groupBy("chunk", note).agg(F.transform(parts, lambda x: x["codes"]).alias("codes"))


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of large binaries, one in memory at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch[n][i].as_py() for n in batch.schema.names}


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, how often each occurs, number of each key's)."""
    bits = len(keys).bit_length()
    if len(keys) and keys.dtype == np.uint64 and int(keys.max()).bit_length() + bits <= 64:  # key and place sort as one number
        both = np.sort(keys << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64))
        k, order = both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).view(np.int64)
    else:
        order = np.argsort(keys)
        k = keys[order]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.empty(0, dtype=bool)
    at = np.flatnonzero(new)
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return k[at], np.diff(np.append(at, len(k))), number


def summed(number: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of integers (below 2 ** 53) for each number."""
    return np.bincount(number, weights=values, minlength=n).astype(np.int64)
