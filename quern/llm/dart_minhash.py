"""Near-duplicates by DartMinHash signatures.

A text is the multiset of its shingles of five words. Its copies make weights:
the j-th copy of a shingle is a region of weight one, and into each region
darts are thrown at random but fixed ranks (a Poisson process seeded by the
hash of shingle and j). Each dart also hits one of ``COORDINATES``; the dart of
least rank at each coordinate is the signature there. Two texts agree at a
coordinate with the probability of their weighted Jaccard similarity. Only
darts of rank below k ln k + 2k over the text's weight are thrown at first; a
text with an empty coordinate gets twice that rank until none is left.

Signatures are joined by bands of ``ROWS`` coordinates. Texts with the same
multiset are one *kind* from the start and only kinds are compared. In each
bucket of a band all kinds are compared exactly with one pivot, and links of at
least ``SIMILARITY`` join kinds to classes. A bucket whose kinds are all of one
class is settled. In the others every kind that is not of the pivot's class is
compared with all kinds of other classes, whatever linked them before. So two
kinds of a bucket that are similar are always in one class, and no bucket is
cut. A large bucket is compared block by block, each pair of blocks a group of
its own, and no pair of texts is ever a row.

Defined results: null texts and texts without words have no shingle and are
one kind; texts of fewer than five words have one shingle of all their words;
case of A-Z is ignored; rows and ids may repeat; the class is named by the
least id of its rows, null if all of them are null; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import ROW, mix64

WORDS = 5
SIMILARITY = 0.8
ROWS = 7
BANDS = 30
COORDINATES = ROWS * BANDS
PIECE_CHARS = 300_000
ROW_WEIGHT = 1500  # darts of a row take as much as so many characters
SMALL_PAIRS = 100_000  # pairs of ids that are broadcast: below 2 MB
SMALL_KINDS = 1_000_000  # numbers of rows that are broadcast: below 20 MB
SMALL_CLASSES = 200_000  # classes that are broadcast: below 10 MB
BLOCK, BLOCK_WEIGHT = 500, 500_000  # about the rows and shingles of a block of a bucket

FEW = 256  # pairs of a cell that are counted one by one
PAIRS, CELLS = 4_000_000, 2048  # pairs and cells counted at a time


def cells(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle and copy of each text."""
    rows, hashes = common.ascii_words(column)
    if not len(rows):
        return rows, hashes
    codes = mix64(hashes)
    begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    lengths = np.diff(np.append(begins, len(rows)))
    place = np.arange(len(rows)) - np.repeat(begins, lengths)
    left = np.repeat(lengths, lengths) - place
    take = (left >= words) | (place == 0)
    at = np.flatnonzero(take)
    width = np.minimum(left[at], words)
    out = width.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            inside = width > k
            out[inside] = mix64(out[inside] * np.uint64(0x9E3779B97F4A7C15) + codes[at[inside] + k])
    rows = rows[at]
    order = np.lexsort((out, rows))
    rows, out = rows[order], out[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (out[1:] != out[:-1]))
    group = np.flatnonzero(new)
    copy = np.arange(len(out)) - np.repeat(group, np.diff(np.append(group, len(out))))
    with np.errstate(over="ignore"):
        return rows, mix64(out + copy.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def signatures(rows: np.ndarray, hashes: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """Signature of each of n texts, whose cells are sorted by row.

    A text without cells gets zeros.
    """
    out = np.zeros((n, k), dtype=np.uint64)
    weight = np.bincount(rows, minlength=n).astype(float)
    rank_limit = (k * math.log(k) + 2 * k) / np.maximum(weight, 1)
    open_rows = weight > 0
    while open_rows.any():
        use = open_rows[rows]
        cell, row = hashes[use], rows[use]
        rank = np.zeros(len(cell))
        thrown = []
        step = 0
        while len(cell):
            step += 1
            with np.errstate(over="ignore"):
                dart = mix64(cell + np.uint64(step) * np.uint64(0x9FB21C651E98DF25))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            hit = rank <= rank_limit[row]
            cell, row, rank, dart = cell[hit], row[hit], rank[hit], dart[hit]
            thrown.append((row, rank, dart))
        row, rank, dart = (np.concatenate(x) for x in zip(*thrown, strict=True))
        with np.errstate(over="ignore"):
            named = mix64(dart ^ np.uint64(0xA0761D6478BD642F))
        place = row * k + (named % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, place))
        place = place[order]
        first = np.append(True, place[1:] != place[:-1]) if len(place) else np.empty(0, dtype=bool)
        place, named = place[first], named[order][first]
        full = np.bincount(place // k, minlength=n) == k
        done = full & open_rows
        keep = done[place // k]
        out.ravel()[place[keep]] = named[keep]
        open_rows &= ~full
        rank_limit[open_rows] *= 2
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each band of each signature."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows)
    key = np.broadcast_to(np.arange(k // rows, dtype=np.uint64), (n, k // rows)).copy()
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def similarity(left: pa.Array, right: pa.Array, words: int = WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of the texts side by side."""
    n = len(left)
    (ra, ha), (rb, hb) = cells(left, words), cells(right, words)
    with np.errstate(over="ignore"):
        ka, kb = (h ^ mix64(r.astype(np.uint64) + np.uint64(1)) for r, h in ((ra, ha), (rb, hb)))
    both = np.bincount(ra[np.isin(ka, kb)], minlength=n).astype(float)
    either = np.bincount(ra, minlength=n) + np.bincount(rb, minlength=n) - both
    return np.divide(both, either, out=np.ones(n), where=either > 0)


def pieces(*columns: pa.Array, size: int = PIECE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` characters, which bound a task's memory."""
    weight = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        weight += pc.fill_null(pc.utf8_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, w in enumerate(weight.tolist()):
        held += w + ROW_WEIGHT
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(weight):
        yield start, len(weight)


def signed_rows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(ROW, kind_a, kind_b, weight, bands) of each row with ``text``."""
    schema = f"{ROW} long, kind_a long, kind_b long, weight long, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in pieces(whole["text"]):
                batch = whole.slice(lo, hi - lo)
                n = batch.num_rows
                rows, hashes = cells(batch["text"], words)
                kinds = []
                for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
                    total = np.zeros(n, dtype=np.uint64)
                    with np.errstate(over="ignore"):
                        np.add.at(total, rows, mix64(hashes ^ np.uint64(salt)))
                    kinds.append(pa.array(common.signed(total)))
                keys = common.signed(bands(signatures(rows, hashes, n)).ravel())
                weight = np.bincount(rows, minlength=n)
                some = weight > 0
                offsets = np.append(0, np.cumsum(np.where(some, BANDS, 0))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[np.repeat(some, BANDS)]))
                yield pa.RecordBatch.from_arrays([batch[ROW], *kinds, pa.array(weight.astype(np.int64)), lists], names=[ROW, "kind_a", "kind_b", "weight", "bands"])
        common.trim()

    return docs.select(ROW, "text").mapInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """(kind, pivot) of the similar pairs, by their whole texts.

    The kinds of a pivot are cut into groups of about ``BLOCK``, each with one
    copy of the pivot's text, which comes first; so a pivot of any number of
    kinds is spread over tasks. Few pairs are broadcast (their number is
    checked), so that only the texts that take part are shuffled.
    """
    pairs = common.checkpoint(pairs)
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__groups"))
    part = F.pmod(F.xxhash64("kind"), F.col("__groups")).cast("int")
    grouped = common.checkpoint(pairs.join(sizes, "pivot").select("kind", "pivot", part.alias("part")))
    side = texts.select(F.col(ROW).alias("node"), "text")
    first = grouped.select(F.col("pivot").alias("node"), "pivot", "part", F.lit(None).cast("long").alias("kind")).distinct()
    parts = first.unionByName(grouped.select(F.col("kind").alias("node"), "pivot", "part", "kind"))
    rows = side.join(common.sized(common.checkpoint(parts), SMALL_PAIRS), "node").select("pivot", "part", "kind", "text")
    rows = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.col("kind").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.array([""], pa.string())  # text of the pivot at hand
        for batch in batches:
            begins = batch["kind"].is_null().to_numpy(zero_copy_only=False)
            source = pa.concat_arrays([held, batch["text"].cast(pa.string())])
            place = np.maximum.accumulate(np.where(begins, np.arange(1, len(begins) + 1), 0))
            held = source.slice(int(place[-1]) if len(place) else 0, 1)
            use = pa.array(~begins)
            of, own = source.take(pa.array(place)).filter(use), batch["text"].filter(use)
            linked = [similarity(own.slice(lo, hi - lo), of.slice(lo, hi - lo), words) for lo, hi in pieces(own, of)]
            near = pa.array(np.concatenate(linked or [np.empty(0)]) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch["kind"].filter(use), batch["pivot"].filter(use)], names=["kind", "pivot"]).filter(near)
        common.trim()

    return rows.mapInArrow(run, "kind long, pivot long")


def _grouped(left: DataFrame) -> DataFrame:
    """(kind, cls, x, y, band, bx, by) of each group (band, bx, by) that a row takes part in.

    Its block among the kinds that are not of the pivot's class is ``x`` (null:
    it is of that class), that among all kinds is ``y``.
    """
    # Buckets of the same kinds count once.
    alike = left.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.xxhash64("kind").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("kind", F.lit(1))).alias("b"), F.sum("weight").alias("w"), F.min_by("cls", "kind").alias("main"))
    one = alike.groupBy("n", "a", "b", "w", "main").agg(F.min("band").alias("band"))
    rows = left.join(one.select("band", "n", "w", "main"), "band")
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_WEIGHT), F.lit(1)).cast("int")
    rest = rows.where("cls != main").groupBy("band").agg(F.count("*").alias("__rn"), F.sum("weight").alias("__rw"))
    rows = rows.join(rest, "band").select("band", "kind", "cls", (F.col("cls") != F.col("main")).alias("__rest"), blocks(F.col("__rn"), F.col("__rw")).alias("__nx"), blocks(F.col("n"), F.col("w")).alias("__ny"))
    block = lambda n: F.pmod(F.xxhash64("kind"), n).cast("int")
    rows = rows.select("*", F.when(F.col("__rest"), block(F.col("__nx"))).alias("x"), block(F.col("__ny")).alias("y"))
    pair = lambda x, y: F.struct(x.alias("bx"), y.alias("by"))
    as_x = F.when(F.col("__rest"), F.transform(F.sequence(F.lit(0), F.col("__ny") - 1), lambda y: pair(F.col("x"), y)))
    as_y = F.transform(F.sequence(F.lit(0), F.col("__nx") - 1), lambda x: pair(x, F.col("y")))
    groups = F.array_distinct(F.concat(F.coalesce(as_x, F.array().cast("array<struct<bx:int,by:int>>")), as_y))
    return rows.select("band", "kind", "cls", "x", "y", F.explode(groups).alias("g")).select("kind", "cls", "x", "y", "band", "g.bx", "g.by")


def _shared_cells(row: np.ndarray, cell: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Number of cells that each row of ``x`` shares with each of ``y``."""
    at_x, at_y = np.full(n, -1), np.full(n, -1)
    at_x[x], at_y[y] = np.arange(len(x)), np.arange(len(y))
    _, place = np.unique(cell, return_inverse=True)
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    keys = int(place[-1]) + 1 if len(place) else 0
    sides = []
    for at in (at_x, at_y):
        inside = at[row] >= 0
        sides.append((at[row[inside]], place[inside], np.bincount(place[inside], minlength=keys)))
    (rx, px, nx), (ry, py, ny) = sides
    out = np.zeros(len(x) * len(y), dtype=np.int64)
    # Cells of few rows by their pairs, those of many by products of matrices.
    few = nx * ny <= FEW
    use = few[px]
    rx_few, px_few = rx[use], px[use]
    begin = np.append(0, np.cumsum(ny))
    step = max(1, PAIRS // FEW)
    for at in range(0, len(rx_few), step):
        r, k = rx_few[at : at + step], px_few[at : at + step]
        times = ny[k]
        ends = np.cumsum(times)
        inner = np.arange(int(ends[-1])) - np.repeat(ends - times, times)
        out += np.bincount(np.repeat(r, times) * len(y) + ry[np.repeat(begin[k], times) + inner], minlength=len(out))
    both = out.reshape(len(x), len(y))
    often = np.flatnonzero(~few)
    for at in range(0, len(often), CELLS):
        named = np.full(keys, -1)
        named[often[at : at + CELLS]] = np.arange(len(often[at : at + CELLS]))
        parts = []
        for r, k, size in ((rx, px, len(x)), (ry, py, len(y))):
            use = named[k] >= 0
            part = np.zeros((size, CELLS), dtype=np.float32)
            part[r[use], named[k[use]]] = 1
            parts.append(part)
        both += (parts[0] @ parts[1].T).astype(np.int64)
    return both


def _group_links(held: pa.Table, threshold: float, words: int) -> np.ndarray:
    """Rows (a, b) of linked classes in whole groups."""
    held = held.combine_chunks()
    n = len(held)
    column = lambda name: held[name].to_numpy()
    row, cell = cells(held["text"].combine_chunks(), words)
    weight = np.bincount(row, minlength=n)
    band, bx, by, cls = column("band"), column("bx"), column("by"), column("cls")
    new = np.append(True, (band[1:] != band[:-1]) | (bx[1:] != bx[:-1]) | (by[1:] != by[:-1]))
    with np.errstate(over="ignore"):
        cell = cell ^ mix64(np.cumsum(new).astype(np.uint64)[row])
    x = np.flatnonzero(pc.fill_null(held["x"], -1).to_numpy() == bx)
    y = np.flatnonzero(column("y") == by)
    both = _shared_cells(row, cell, x, y, n)
    i, j = np.nonzero(both)
    shared, i, j = both[i, j], x[i], y[j]
    near = (cls[i] != cls[j]) & (shared / (weight[i] + weight[j] - shared) >= threshold - 1e-12)
    i, j = cls[i[near]], cls[j[near]]
    return np.unique(np.column_stack([np.maximum(i, j), np.minimum(i, j)]), axis=0)


def _open_links(left: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """(kind, pivot): similar classes, named by a kind each, of buckets of several classes."""
    keys = ["band", "bx", "by"]
    rows = common.checkpoint(_grouped(left)).join(texts.select(F.col(ROW).alias("kind"), "text"), "kind").select("cls", "x", "y", *keys, "text")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(held: pa.Table) -> pa.RecordBatch:
            found = _group_links(held, threshold, words)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["kind", "pivot"])

        # Whole groups are held until they are PIECE_CHARS long.
        held: list[pa.RecordBatch] = []
        chars, group = 0, None
        for batch in batches:
            names = list(zip(*(batch[k].to_pylist() for k in keys), strict=True))
            lengths = pc.utf8_length(batch["text"]).to_pylist()
            start = 0
            for i, name in enumerate(names):
                if name != group and chars >= PIECE_CHARS:
                    yield linked(pa.Table.from_batches([*held, batch.slice(start, i - start)]))
                    held, chars, start = [], 0, i
                group = name
                chars += lengths[i] + ROW_WEIGHT // 10
            held.append(batch.slice(start))
        if held and sum(b.num_rows for b in held):
            yield linked(pa.Table.from_batches(held))
        common.trim()

    return rows.mapInArrow(run, "kind long, pivot long")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): components of an undirected graph, named by their
    least node. Labels spread along links and are followed to their own
    labels, so the number of rounds grows as the logarithm of a path."""
    edges = common.checkpoint(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    labels = common.checkpoint(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("__near"))
        step = labels.join(near, "x").select("x", F.least("label", "__near").alias("__step"), F.col("label").alias("__old"))
        up = labels.select(F.col("x").alias("__step"), F.col("label").alias("__up"))
        new = common.checkpoint(step.join(up, "__step", "left").select("x", F.least("__step", "__up").alias("label"), (F.least("__step", "__up") != F.col("__old")).alias("__moved")))
        labels = new.select("x", "label")
        if new.where("__moved").isEmpty():
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))


def classes(rows: DataFrame, threshold: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(ROW, kind, cls) of each row of ``rows`` (ROW, text).

    ``kind`` is the least ROW of those with the same shingles, ``cls`` that of
    the class of similar kinds.
    """
    common.small_batches(rows.sparkSession)
    made = common.checkpoint(signed_rows(rows, words))
    # Written before it is joined, so that Spark can split the rows of a hot kind.
    kinds = common.checkpoint(made.groupBy("kind_a", "kind_b").agg(F.min(ROW).alias("kind")))
    # Bands depend on the kind alone; they are read from its first row.
    first = made.join(kinds.select(F.col("kind").alias(ROW)), ROW, "left_semi")
    keyed = first.select(F.explode("bands").alias("band"), F.col(ROW).alias("kind"), "weight")
    shared = keyed.groupBy("band").agg(F.count("*").alias("__n")).where("__n > 1")
    left = common.checkpoint(keyed.join(shared.select("band"), "band"))
    compared = common.checkpoint(left.select(F.col("kind").alias(ROW)).distinct())
    texts = common.checkpoint(rows.select(ROW, "text").join(common.sized(compared, SMALL_KINDS), ROW, "left_semi"))
    buckets = left.groupBy("band").agg(F.min("kind").alias("pivot"))
    tried = left.join(buckets, "band").where("kind != pivot").select("kind", "pivot").distinct()
    links = common.checkpoint(_verified(tried, texts, threshold, words))
    joined = components(links, "kind", "pivot")
    known = common.checkpoint(left.join(joined.toDF("kind", "cls"), "kind", "left").withColumn("cls", F.coalesce("cls", "kind")))
    # Buckets of one class are settled.
    several = known.groupBy("band").agg(F.min("cls").alias("__lo"), F.max("cls").alias("__hi")).where("__lo < __hi").select("band")
    open_rows = common.checkpoint(known.join(several, "band", "left_semi"))
    common.discard(left, known)
    del buckets, tried, known, several, left
    common.release(rows.sparkSession)
    if not open_rows.isEmpty():
        more = common.checkpoint(_open_links(open_rows, texts, threshold, words))
        joined = components(links.unionByName(more).distinct(), "kind", "pivot")
    common.discard(open_rows, texts, links)
    named = common.checkpoint(kinds.join(joined.toDF("kind", "cls"), "kind", "left").select("kind_a", "kind_b", "kind", F.coalesce("cls", "kind").alias("cls")))
    out = common.checkpoint(made.select(ROW, "kind_a", "kind_b").join(named, ["kind_a", "kind_b"]).select(ROW, "kind", "cls"))
    common.discard(made, kinds, named)
    return out


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """(key, class_id, class_size) of each row; class_id is the least key of the class."""
    rows = common.with_row(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    found = common.checkpoint(rows.select(ROW, "key").join(classes(rows.select(ROW, "text"), threshold), ROW).select("key", "cls"))
    # Rows of no class but their own need no join; a large table of the others
    # is written first, so that Spark can split the rows of a hot class.
    sizes = common.checkpoint(found.groupBy("cls").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1"))
    named = found.join(common.sized(sizes, SMALL_CLASSES), "cls", "left")
    alone = F.col("class_size").isNull()
    return named.select(F.col("key").alias(key), F.when(alone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def keep_one(docs: DataFrame, text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with the first row of each class only.

    Rows without words are no copies of each other and all stay.
    """
    names = docs.columns
    rows = common.with_row(docs.select(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names)), F.col(text).alias("text")))
    found = classes(rows.select(ROW, "text"), threshold)
    first = found.groupBy("cls").agg(F.min(ROW).alias(ROW)).select(ROW)
    wordless = rows.where(F.coalesce(F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")), F.lit("")) == "").select(ROW)
    gone = common.checkpoint(found.select(ROW).join(first.unionByName(wordless), ROW, "left_anti"))
    common.discard(found)
    return rows.join(common.sized(gone, SMALL_KINDS), ROW, "left_anti").select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
