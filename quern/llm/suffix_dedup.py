"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A suffix matters only through its first ``size`` bytes, its window. Suffixes
are put into groups by successive digits, most significant first, and groups
of one are dropped after each pass; the groups left after the last digit are
exactly the repeated windows.

* Neighbouring suffixes that share an *anchor* (the gram of least hash in their
  windows, see ``windows``) are a *run* and go through the first pass together:
  a run whose gram occurs nowhere else holds no repeated window and is dropped;
  runs that are equal as a whole are repeated as a whole, and only one of them
  goes on, as a partner of others. What else has a gram in common goes on.
* The suffixes of those runs, one by one, are sorted by the digits of
  ``DIGITS`` bytes each, up to ``size``.

Texts are written once, in chunks of about ``CHUNK`` bytes beside their other
columns, in a table bucketed by chunk, and are never shuffled. Passes
exchange keys (see ``exchange``): in the first one a chunk sends its runs; then it sends its
distinct keys, 64-bit hashes of the prefix so far, and gets a code for each:
whether it occurs again. So a hot string costs one key for each chunk, and no
task gets more than a range of keys. Only the bytes of suffixes that are still
open go from pass to pass. The last pass uses a second hash besides, with other
weights.

Defined results: null texts are empty; texts shorter than ``size`` lose
nothing; equal texts (repeated rows, too) repeat each other; matches never
cross rows, may overlap, and are judged on the input; texts may have any length
up to 2 GB; other columns are kept by ``remove`` and ``rewrite``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, exchange, windows

SIZE = 200
GRAM = 64
DIGITS = (64, 68, 68)
CHUNK = 1 << 18  # rows of chunks stay below what the JVM's collector takes for huge
PART = 1 << 21  # bytes of one text that are hashed at a time
BUCKET_KEYS = 400_000  # a run takes more memory than a key

DROP, WHOLE, ON, PARTNER = 0, 1, 2, 3  # codes of the first pass

_CHUNKS = "chunk long, n_bytes long, sizes binary, data binary, others binary"


# --- chunks --------------------------------------------------------------------


def _raw(column: pa.Array) -> list[bytes]:
    return [x.encode() for x in common.text_values(column)]


def _runs(data: np.ndarray, bounds: np.ndarray, size: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of the texts of a chunk; a long text is taken part by part."""
    names = ("first", "last", "gram", "around")
    if len(data) <= 2 * PART:
        found = windows.anchors(data, bounds, size, gram)
        return {k: found[k] for k in names}
    parts = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        for at in range(lo, max(lo + 1, hi - size + 1), PART):
            end = min(hi, at + PART + size - 1)
            found = windows.anchors(data[at:end], np.array([0, end - at]), size, gram)
            parts.append({"first": found["first"] + at, "last": found["last"] + at, "gram": found["gram"], "around": found["around"]})
    return {k: np.concatenate([p[k] for p in parts]) for k in names}


def _others(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _chunked(docs: DataFrame, text: str) -> DataFrame:
    """Texts with their other columns, in chunks; written once."""
    kept = [n for n in docs.columns if n != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        texts: list[bytes] = []
        held: list[pa.RecordBatch] = []
        total = 0

        def packed() -> pa.RecordBatch:
            nonlocal number, total, texts, held
            sizes = np.array(list(map(len, texts)), dtype=np.int64)
            data = b"".join(texts)
            row = [number, len(data), sizes.tobytes(), data, _others(held)]
            number, total, texts, held = number + 1, 0, [], []
            names = [x.split()[0] for x in _CHUNKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 2 else pa.binary()) for i, v in enumerate(row)], names=names)

        for batch in batches:
            raw = _raw(batch["__text"])
            side = pa.RecordBatch.from_arrays([batch["__text"].is_null(), *(batch[f"c{i}"] for i in range(len(kept)))], names=["none", *(f"c{i}" for i in range(len(kept)))])
            start = 0
            for i, x in enumerate(raw):
                texts.append(x)
                total += len(x)
                if total >= CHUNK:
                    held.append(side.slice(start, i + 1 - start))
                    start = i + 1
                    yield packed()
            if start < len(raw):
                held.append(side.slice(start))
        if texts:
            yield packed()
        common.trim()

    source = docs.select(*(F.col(n).alias(f"c{i}") for i, n in enumerate(kept)), F.col(text).alias("__text"))
    return common.bucketed(source.mapInArrow(run, _CHUNKS), "chunk")


# --- answers -------------------------------------------------------------------


_RUN = np.dtype([("around", "<u8"), ("first", "<u4"), ("last", "<u4")])
_JUDGED = np.dtype([("code", "u1"), ("first", "<u4"), ("last", "<u4")])


def _judged_runs(gram: np.ndarray, more: np.ndarray, own: np.ndarray, bucket: int) -> tuple[np.ndarray, None, np.ndarray]:
    """Code and windows of each run; one of several equal ones goes on."""
    order = np.lexsort((more["around"], gram))
    g, a = gram[order], more["around"][order]
    new = np.append(True, (g[1:] != g[:-1]) | (a[1:] != a[:-1])) if len(g) else np.empty(0, dtype=bool)
    at = np.flatnonzero(new)
    copies = np.diff(np.append(at, len(g)))
    head = g[at]
    group = np.cumsum(np.append(True, head[1:] != head[:-1])) - 1 if len(head) else np.empty(0, dtype=np.int64)
    several = np.bincount(group)[group] > 1 if len(group) else np.empty(0, dtype=bool)
    code = np.repeat(np.where(several, np.where(copies > 1, WHOLE, ON), np.where(copies > 1, WHOLE, DROP)), copies)
    code[at[several & (copies > 1)]] = PARTNER
    out = np.empty(len(gram), dtype=_JUDGED)
    out["code"][order] = code
    out["first"], out["last"] = more["first"], more["last"]
    return out, None, out["code"] != DROP


def _judged_keys(keys: np.ndarray, more: np.ndarray, own: np.ndarray, bucket: int) -> tuple[np.ndarray, None, None]:
    """1 for keys that occur more than once; ``more`` is 2 for those that do so in their chunk, else 1."""
    found, _, number = exchange.distinct(keys)
    return (np.bincount(number, weights=more, minlength=len(found)) > 1)[number].astype(np.uint8), None, None


# --- passes --------------------------------------------------------------------


def _windows_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places of all windows of some runs."""
    n = last.astype(np.int64) - first + 1
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first.astype(np.int64), n)


def _prefixes(data: np.ndarray, places: np.ndarray, depth: int, salt: int) -> np.ndarray:
    """Keys of the first ``depth`` bytes at ascending places."""
    out = np.empty(len(places), dtype=np.uint64)
    at = 0
    while at < len(places):  # only the bytes around the places are hashed
        base = int(places[at])
        end = int(np.searchsorted(places, base + PART))
        gap = np.flatnonzero(np.diff(places[at:end]) > 4 * depth)
        end = at + int(gap[0]) + 1 if len(gap) else end
        piece = data[base : int(places[end - 1]) + depth]
        start = places[at:end] - base
        out[at:end] = windows.Hashes(piece, salt).of(start, start + depth)
        at = end
    return out


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges joined where they overlap or touch, in order."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order].astype(np.int64), np.maximum.accumulate(end[order].astype(np.int64)) if len(end) else end
    heads = np.flatnonzero(np.append(True, begin[1:] > reach[:-1])) if len(begin) else np.empty(0, dtype=np.int64)
    return begin[heads], reach[np.append(heads[1:], len(begin)) - 1] if len(heads) else begin


def _pairs(begin: np.ndarray, end: np.ndarray) -> bytes:
    return np.column_stack([begin, end]).astype(np.int32).tobytes()


def _unpaired(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(blob or b"", dtype=np.int32).reshape(-1, 2).astype(np.int64)
    return both[:, 0], both[:, 1]


_OPEN = "chunk long, n long, windows binary, parts binary, data binary"


def _opened(chunk: int, windows_: tuple[np.ndarray, np.ndarray], size: int, data: bytes, parts: tuple[np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
    """A row of _OPEN: ranges of open windows, and the parts of the texts that they need.

    ``data`` is a whole chunk, or ``parts`` of it side by side.
    """
    begin, end = windows_
    a, b = _merged(begin, end + size - 1)
    base, offset = (np.zeros(1, dtype=np.int64),) * 2 if parts is None else (parts[0], _offsets(*parts))
    inside = np.searchsorted(base, a, side="right") - 1
    x = offset[inside] + a - base[inside]
    body = b"".join(data[i:j] for i, j in zip(x.tolist(), (x + b - a).tolist(), strict=True))
    row = [chunk, int((end - begin).sum()), _pairs(begin, end), _pairs(a, b), body]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 2 else pa.binary()) for i, v in enumerate(row)], names=[x.split()[0] for x in _OPEN.split(", ")])


def _offsets(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.cumsum(end - begin) - (end - begin)


def _pass_keys(row: dict, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of open windows, their keys) at a digit."""
    begin, end = _unpaired(row["windows"])
    places = _windows_of(begin, end - 1)
    base, stop = _unpaired(row["parts"])
    inside = np.searchsorted(base, places, side="right") - 1
    depths = np.minimum(np.cumsum(DIGITS), size)
    depth, salt = (int(depths[level]), 0) if level < len(DIGITS) else (size, 1)
    return places, _prefixes(np.frombuffer(row["data"], dtype=np.uint8), _offsets(base, stop)[inside] + places - base[inside], depth, salt)


def _repeats(docs: DataFrame, text: str, size: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(chunks, ranges of their removed bytes)."""
    common.small_batches(docs.sparkSession)
    gram = min(gram, size)
    chunks = _chunked(docs, text)
    # Of random bytes every (size - gram) / 2 or so begins a run.
    count = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0] * 2 // (size - gram + 2)
    buckets = exchange.buckets_for(count, BUCKET_KEYS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            bounds = np.append(0, np.cumsum(np.frombuffer(row["sizes"], dtype=np.int64)))
            found = _runs(np.frombuffer(row["data"], dtype=np.uint8), bounds, size, gram)
            keys = common.mix64(found["gram"])  # least hashes are small, buckets want them even
            order = np.argsort(keys, kind="stable")
            more = np.empty(len(keys), dtype=_RUN)
            for n in ("around", "first", "last"):
                more[n] = found[n][order]
            yield exchange.questions(row["chunk"], keys[order], more, buckets)
        common.trim()

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            judged = exchange.answers_of(row["codes"], _JUDGED)
            first, last, code = (judged[n] for n in ("first", "last", "code"))
            whole, on = code != ON, code != WHOLE
            removed = _pairs(*_merged(first[whole], last[whole].astype(np.int64) + size))
            open_ = _pairs(*_merged(first[on], last[on].astype(np.int64) + 1))
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([removed], pa.binary()), pa.array([open_], pa.binary())], names=["chunk", "removed", "open"])

    asked = chunks.select("chunk", "sizes", "data").mapInArrow(ask, exchange.ASKED)
    told = exchange.by_chunk(exchange.told(asked, buckets, _judged_runs, _RUN))
    runs = common.checkpoint(told.mapInArrow(sort_out, "chunk long, removed binary, open binary"))
    del asked, told
    common.release(docs.sparkSession)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            yield _opened(row["chunk"], _unpaired(row["open"]), size, row["data"], None)
        common.trim()

    state = common.bucketed(chunks.select("chunk", "data").join(runs.select("chunk", "open").where("open != X''"), "chunk").mapInArrow(begin, _OPEN), "chunk")
    for level in range(len(DIGITS) + 1):
        if 0 < level < len(DIGITS) and sum(DIGITS[:level]) >= size:
            continue
        count = state.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not count:
            break
        state = _next_digit(state, level, size, exchange.buckets_for(count, BUCKET_KEYS))
    both = common.checkpoint(runs.select("chunk", "removed").join(state.select("chunk", "windows"), "chunk", "full"))
    common.discard(runs, state)
    return chunks, both


def _next_digit(state: DataFrame, level: int, size: int, buckets: int) -> DataFrame:
    """The windows whose prefix occurs again, with their bytes."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            keys, times, _ = exchange.distinct(_pass_keys(row, level, size)[1])
            yield exchange.questions(row["chunk"], keys, np.minimum(times, 2).astype(np.uint8), buckets)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            places, keys = _pass_keys(row, level, size)
            left = places[exchange.answers_of(row["codes"], "u1")[exchange.distinct(keys)[2]] > 0]
            if len(left):
                yield _opened(row["chunk"], _merged(left, left + 1), size, row["data"], _unpaired(row["parts"]))
        common.trim()

    answers = exchange.by_chunk(exchange.told(state.mapInArrow(ask, exchange.ASKED), buckets, _judged_keys, "u1")).drop("note")
    out = common.bucketed(state.join(answers, "chunk").mapInArrow(go_on, _OPEN), "chunk")
    del answers
    common.discard(state)
    common.release(out.sparkSession)
    return out


# --- results -------------------------------------------------------------------


def _covered(row: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of ranges of removed bytes of a chunk, in order; windows never cross texts."""
    begin, end = _unpaired(row["removed"])
    a, b = _unpaired(row["windows"])
    begin, end = np.concatenate([begin, a]), np.concatenate([end, b + size - 1])
    order = np.argsort(begin, kind="stable")
    return begin[order], end[order]


def _split(begin: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges cut at the texts' bounds (those of neighbouring texts may have been joined)."""
    first, last = np.searchsorted(bounds, begin, side="right"), np.searchsorted(bounds, end, side="left")
    n = last - first + 1
    i = np.repeat(np.arange(len(begin)), n)
    k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    a = np.where(k == 0, begin[i], bounds[np.minimum(first[i] + k - 1, len(bounds) - 1)])
    b = np.where(k == n[i] - 1, end[i], bounds[np.minimum(first[i] + k, len(bounds) - 1)])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def _cut(row: dict, size: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(bytes kept, bytes, bytes removed, removed runs) of each text of a chunk."""
    data = row["data"]
    bounds = np.append(0, np.cumsum(np.frombuffer(row["sizes"], dtype=np.int64)))
    begin, end = _covered(row, size)
    begin, end = _split(begin, end, bounds)
    ranges = np.searchsorted(begin, bounds)
    for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        a, b = begin[ranges[i] : ranges[i + 1]], end[ranges[i] : ranges[i + 1]]
        if not len(a):
            yield data[lo:hi], hi - lo, 0, 0
            continue
        reach = np.maximum.accumulate(b)
        heads = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
        starts, ends = a[heads], reach[np.append(heads[1:], len(a)) - 1]
        kept, at = [], lo
        for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
            kept.append(data[at:x])
            at = y
        kept.append(data[at:hi])
        yield b"".join(kept), hi - lo, int((ends - starts).sum()), len(starts)


def _results(docs: DataFrame, text: str, size: int, gram: int, made: T.StructType, make: Callable[[list, pa.Array], list[pa.Array]], names: list[str]) -> DataFrame:
    """Other columns called ``names`` and what ``make`` gives for the texts of a chunk.

    ``make`` gets what ``_cut`` yields for each and which texts are null.
    """
    chunks, ranges = _repeats(docs, text, size, gram)
    kept = [n for n in docs.columns if n != text]
    places = [f"c{kept.index(n)}" for n in names]
    schema = T.StructType([*(docs.schema[n] for n in names), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            others = pa.ipc.open_stream(row["others"]).read_all().combine_chunks()
            done = list(_cut(row, size))
            for at in range(0, len(done), common.BATCH_ROWS):
                part = others.slice(at, common.BATCH_ROWS)
                columns = [part[c].combine_chunks() for c in places] + make(done[at : at + common.BATCH_ROWS], part["none"].combine_chunks())
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        common.trim()

    held = chunks.select("chunk", "sizes", "data", "others").join(ranges, "chunk", "left")
    return held.mapInArrow(run, schema)


_COUNTS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())]


def _counts(done: list) -> list[pa.Array]:
    return [pa.array([x[i] for x in done], pa.int64()) for i in (1, 2, 3)]


def remove(docs: DataFrame, text: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``kept`` (bytes left), ``n_bytes``, ``n_removed`` and ``n_spans``.

    Columns of these names give way; the text is left out.
    """
    added = T.StructType([T.StructField("kept", T.BinaryType()), *_COUNTS])
    docs = docs.drop(*({*docs.columns} & {*added.names} - {text}))
    return _results(docs, text, size, gram, added, lambda done, _: [pa.array([x[0] for x in done], pa.binary()), *_counts(done)], [n for n in docs.columns if n != text])


def rewrite(docs: DataFrame, text: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``docs`` with each text cut to the bytes kept.

    A character of which only some bytes are left is dropped. Null texts stay
    null; a text that is repeated as a whole becomes empty.
    """
    make = lambda done, none: [pa.array([x[0].decode("utf-8", "ignore") for x in done], pa.string(), mask=np.asarray(none))]
    return _results(docs, text, size, gram, T.StructType([docs.schema[text]]), make, [n for n in docs.columns if n != text]).select(*docs.columns)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    added = T.StructType([*_COUNTS, T.StructField("kept_sha256", T.StringType())])
    make = lambda done, _: [*_counts(done), pa.array([hashlib.sha256(x[0]).hexdigest() for x in done], pa.string())]
    return _results(docs.select(F.col(key), F.col(text)), text, size, gram, added, make, [key])
