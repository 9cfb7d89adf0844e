"""Toxicity by compression distance.

Two zstandard dictionaries are made, one of ordinary and one of toxic text.
Windows of a text are its words, each compressed with either dictionary; the
bytes saved by the toxic one (fewer than none: by the ordinary one) are the
window's distance. A word alone and the word three times over are both
compressed: in the second case the fixed cost of a compressed sequence is paid
by both sides, which makes short words comparable. Which distances speak for
toxicity is calibrated on the training rows: a logistic model weighs the set of
distances seen in a text.

Both dictionaries start with the same ordinary text and go on with words of
their class: those whose beginnings occur in at least ``MIN_SHARE`` of the
training texts of the class and hardly in the other; what is left of the larger
one's size is filled with further ordinary words, so a window without words of
either class costs the same under both. Dictionaries as zstandard trains them
on the texts of each class do not give right results, as nearly all of a toxic
text is ordinary: the README has the figures.

The fit uses at most ``TRAIN_ROWS`` labelled rows of documents and at most
``TRAIN_BYTES`` bytes of text (the first by hash of key and text, without texts
of more than an eighth of these bytes), the documented bound. Labels and texts
are its only inputs.

Defined results: null and empty texts have no window and score the model's
base rate; rows and texts that repeat score alike; labels of unknown or null
keys and null labels are not used, whatever their number; without any labelled
row of both classes every score is ``NO_MODEL``; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TRAIN_ROWS = 8_000
TRAIN_BYTES = 64 << 20
NO_MODEL = 0.0
CHUNK = 500
FOLDS = 5
SHARED_WORDS = 1500
CLASS_BYTES = 8192  # of a dictionary for the words of its class
MIN_SHARE = 0.02
BEGINNINGS = (4, 5, 6, 7)
TRIM = ".,;:!?|*#%$\"'()[]"
SINGLE, TRIPLE = (-3, 8), (-4, 13)  # distances are cut to these ranges
WIDTH = TRIPLE[1] - TRIPLE[0]
BUCKETS = (SINGLE[1] - SINGLE[0]) * WIDTH
NONE = -SINGLE[0] * WIDTH - TRIPLE[0]  # the bucket of no distance
CACHE_WORDS = 200_000


def words_of(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(row of each word, distinct words, code of each word)."""
    column = pc.fill_null(column, "")
    lists = pc.utf8_split_whitespace(pc.utf8_lower(column.cast(pa.large_string())))
    words = pc.utf8_trim(lists.flatten(), TRIM)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(words, "")
    words, rows = words.filter(full), rows[full.to_numpy(zero_copy_only=False)]
    coded = words.dictionary_encode()
    return rows, [x.encode() for x in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Distance:
    """Saved bytes of a word under the two dictionaries."""

    ordinary: bytes
    toxic: bytes
    level: int = 13
    cache: dict[bytes, int] = field(default_factory=dict, repr=False)
    pair: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return (self.ordinary, self.toxic, self.level)

    def __setstate__(self, state):
        self.ordinary, self.toxic, self.level = state
        self.cache, self.pair = {}, []

    def open(self) -> None:
        import zstandard

        for content in (self.ordinary, self.toxic):
            settings = zstandard.ZstdCompressionParameters.from_level(self.level, window_log=17, write_checksum=False, write_dict_id=False, write_content_size=False)
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(compression_params=settings)
            self.pair.append(zstandard.ZstdCompressor(dict_data=trained, compression_params=settings))

    def buckets(self, words: list[bytes]) -> np.ndarray:
        """Bucket of each word: its two distances as one number."""
        if not self.pair:
            self.open()
        ordinary, toxic = (x.compress for x in self.pair)
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        out = np.empty(len(words), dtype=np.int64)
        for i, w in enumerate(words):
            b = cache.get(w)
            if b is None:
                s = b" " + w + b" "
                once = min(max(len(ordinary(s)) - len(toxic(s)), SINGLE[0]), SINGLE[1] - 1)
                s *= 3
                thrice = min(max(len(ordinary(s)) - len(toxic(s)), TRIPLE[0]), TRIPLE[1] - 1)
                b = cache[w] = (once - SINGLE[0]) * WIDTH + thrice - TRIPLE[0]
            out[i] = b
        return out


@dataclass
class Model:
    distance: Distance
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        return self.squash(present(column, self.distance))

    def squash(self, x: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
        rows, buckets, n = x
        z = np.full(n, self.bias)
        np.add.at(z, rows, self.weights[buckets])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))) if math.isfinite(self.bias) else np.full(n, NO_MODEL)


def present(column: pa.Array, distance: Distance) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct (row, bucket) of the words with any distance, and the number of rows."""
    rows, words, codes = words_of(column)
    buckets = distance.buckets(words)[codes] if len(codes) else np.empty(0, dtype=np.int64)
    keep = buckets != NONE
    pairs = np.unique(rows[keep] * BUCKETS + buckets[keep])
    return pairs // BUCKETS, pairs % BUCKETS, len(column)


def dictionaries(texts: pa.Array, toxic: np.ndarray) -> Distance:
    """The two dictionaries, from training texts and their labels."""
    n = (max(1, int((~toxic).sum())), max(1, int(toxic.sum())))
    begins: tuple[Counter, Counter] = (Counter(), Counter())
    used: tuple[Counter, Counter] = (Counter(), Counter())
    for lo in range(0, len(texts), CHUNK):
        rows, words, codes = words_of(texts.slice(lo, CHUNK))
        pairs = np.unique(rows * len(words) + codes)
        for part in np.split(pairs, np.flatnonzero(np.diff(pairs // max(1, len(words)))) + 1):
            if len(part):
                y = int(toxic[lo + part[0] // len(words)])
                own = [words[i] for i in (part % len(words)).tolist()]
                used[y].update(own)
                begins[y].update({w[:k] for w in own for k in BEGINNINGS if len(w) >= k - 1})
    often = lambda c: sorted(c.items(), key=lambda x: (-x[1], x[0]))

    def own(y: int) -> list[bytes]:
        """Words of class y, the most frequent first."""
        here, there, k, m = begins[y], begins[1 - y], n[y], n[1 - y]
        marks = {b for b, x in here.items() if x >= max(3, MIN_SHARE * k) and there[b] <= 0.002 * m and math.log((x + 0.5) / (k + 1)) - math.log((there[b] + 0.5) / (m + 1)) > 3}
        return [w for w, _ in often({w: x for w, x in used[y].items() if any(w[:j] in marks for j in BEGINNINGS)})]

    plain = [w for w, _ in often(used[0])]
    tails = [b"".join(b" " + w + b" " for w in reversed(own(y)))[-CLASS_BYTES:] for y in (0, 1)]
    shared = b"".join(b" " + w for w in reversed(plain[:SHARED_WORDS]))
    size = max(map(len, tails))
    further = b"".join(b" " + w for w in plain[SHARED_WORDS:]) + b" " * size
    return Distance(*(shared + further[: size - len(t)] + t + b"\n" * 8 for t in tails))


def fit(texts: pa.Array, toxic: np.ndarray, rounds: int = 300, ridge: float = 1.0) -> Model:
    """Dictionaries and calibration on the training rows, some at a time."""
    distance = dictionaries(texts, toxic)
    n = len(texts)
    x = np.zeros((n, BUCKETS))
    for lo in range(0, n, CHUNK):
        rows, buckets, _ = present(texts.slice(lo, CHUNK), distance)
        x[lo + rows, buckets] = 1
    y = toxic.astype(float)
    weights, bias = np.zeros(x.shape[1]), math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    for _ in range(rounds // 20):  # Newton steps of the ridge logistic model
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        full = np.column_stack([x, np.ones(n)])
        gradient = full.T @ (y - p) - ridge * np.append(weights, 0)
        hessian = (full * s[:, None]).T @ full + np.diag(np.append(np.full(len(weights), ridge), 1e-9))
        step = np.linalg.solve(hessian, gradient)
        weights, bias = weights + step[:-1], bias + step[-1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(distance, weights, float(bias))


def remainder(key: str, folds: int) -> F.Column:
    """crc32 of the key as text, modulo folds; null keys count as ''."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % folds


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, folds: int = FOLDS, size: int = TRAIN_BYTES) -> Model:
    """Fit on labelled rows outside the held-out fold, within the stated bound."""
    told = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (remainder(key, folds) != 0))
    told = told.groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).alias("__toxic"))
    # Only keys are joined to all labels, so that texts stay where they are.
    keys = docs.select(F.col(key).alias("key")).distinct().join(told, "key").orderBy(F.xxhash64("key"), "key").limit(rows)
    keys = common.checkpoint(keys)  # at most ``rows``
    bytes_of, order = F.octet_length("__text"), F.xxhash64("key", "__text")
    sample = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(keys), "key").where(bytes_of <= size // 8)
    sample = sample.select("key", "__text", "__toxic", order.alias("h"))
    sizes = sample.select("h", bytes_of.alias("n")).orderBy("h").limit(rows).toPandas()
    fits = sizes["n"].cumsum() <= size
    last = int(sizes["h"][fits].max()) if fits.any() else None
    found = sample.where(F.col("h") <= F.lit(last)).orderBy("h", "__toxic").limit(rows).select("__text", "__toxic").toArrow()
    common.discard(keys)
    if not found.num_rows or len(pc.unique(found["__toxic"])) < 2:
        return Model(Distance(b" " * 16, b" " * 16), np.zeros(BUCKETS), -math.inf)
    model = fit(found["__text"].combine_chunks(), found["__toxic"].to_numpy(zero_copy_only=False).astype(bool))
    model.distance.cache.clear()
    del found
    common.trim()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each text."""
    common.small_batches(docs.sparkSession)
    kept = [f.name for f in docs.schema if f.name != out]
    schema = T.StructType([*(f for f in docs.schema if f.name != out), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in kept), pa.array(model.scores(batch[text]), pa.float64())], names=[*kept, out])
        model.distance.cache.clear()
        common.trim()

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = FOLDS) -> DataFrame:
    """(key, held_out, score, predicted) of each row."""
    model = train(docs, labels, key, text, label, folds=folds)
    scored = score(docs.select(key, text), model, text)
    return scored.select(key, (remainder(key, folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows scored 0.5 or more."""
    out = "__toxicity"
    return score(docs, train(docs, labels, key, text), text, out).where(F.col(out) < 0.5).drop(out)
