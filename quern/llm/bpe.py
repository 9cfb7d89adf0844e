"""Byte-level BPE encoding and decoding by a monoid tree reduction.

Texts are halved down to leaves, leaves are encoded alone, and neighbours are
joined: a window around their border is encoded again and replaces the tokens
it covers. The window grows until both of its ends are stable places (see
``cuts``), outside which tokens cannot change. The join is associative, so any
shape of the tree gives the ids of the whole text. Decoding concatenates the
bytes of the halves up the same kind of tree.

Defined results: a null or empty text has no ids and decodes to no bytes; rows
and ids may repeat, each row is encoded alone; columns other than the text are
kept; text without any stable place (one huge word) is encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, cuts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF_CHARS = 4096
WINDOW_CHARS = 32


class TreeBPE:
    """Encoder and decoder over one file of ranks."""

    def __init__(self, path: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.base = tiktoken.Encoding("quern", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leaf, self.window = max(1, leaf), max(1, window)

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.base.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        if not left or not right:
            return left or right
        size = self.window
        while True:
            a, b = max(lo, mid - size), min(hi, mid + size)
            start, end = cuts.last_cut(text, a, mid), cuts.first_cut(text, mid, b)
            start = lo if start < 0 and a == lo else start
            end = hi if end < 0 and b == hi else end
            if start >= 0 and end >= 0:
                tail = self.base.encode_ordinary(text[start:mid])
                head = self.base.encode_ordinary(text[mid:end])
                if left[len(left) - len(tail) :] == tail and right[: len(head)] == head:
                    middle = self.base.encode_ordinary(text[start:end])
                    return left[: len(left) - len(tail)] + middle + right[len(head) :]
            if a == lo and b == hi:
                return self.base.encode_ordinary(text[lo:hi])
            size *= 2

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.base.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@functools.cache
def codec(path: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS) -> TreeBPE:
    return TreeBPE(path, leaf, window)


def encode(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS, ids: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of each text as an array of int."""
    common.small_batches(docs.sparkSession)
    schema = T.StructType([*(f for f in docs.schema if f.name != ids), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    kept = [f.name for f in docs.schema if f.name != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(common.tokenizer_file(vocabulary), leaf)
        for batch in batches:
            out = pa.array([tree.encode(x) for x in common.text_values(batch[text])], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in kept), out], names=[*kept, ids])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "token_ids", vocabulary: str = VOCABULARY, out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of each array of ids (null: no bytes)."""
    common.small_batches(encoded.sparkSession)
    schema = T.StructType([*(f for f in encoded.schema if f.name != out), T.StructField(out, T.BinaryType())])
    kept = [f.name for f in encoded.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(common.tokenizer_file(vocabulary))
        for batch in batches:
            raw = pa.array([tree.decode(x or []) for x in batch[ids].to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in kept), raw], names=[*kept, out])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row.

    Encodes and decodes in one pass, so no array of ids leaves the task.
    """
    common.small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(common.tokenizer_file(vocabulary), leaf)
        for batch in batches:
            counts, hashes, decoded = [], [], []
            for x in common.text_values(batch[text]):
                found = tree.encode(x)
                counts.append(len(found))
                hashes.append(hashlib.sha256(np.asarray(found, dtype="<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(tree.decode(found)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
