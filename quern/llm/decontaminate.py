"""Benchmark decontamination by template canonicalisation.

Texts become token sequences in which numbers, names and units are typed
placeholders. Windows of ``WINDOW`` tokens of the benchmark's items are
hash-joined to those of the documents. Windows of one document and item on the
same diagonal (document place minus item place) are one alignment; its slots
have to be consistent: a value of the item always stands for the same value of
the document (two values of the item may stand for equal ones). So a question is
found as well when its numbers, names or units were exchanged throughout, but
not when a text merely has the same shape. Windows whose slots have the item's
own values are verbatim and count whatever the rest of the alignment does. A
pair is reported if the windows that count cover at least ``COVERAGE`` of the
item's windows, or if ``VERBATIM`` tokens in a row are verbatim.

Numbers are tokens with a digit and number words; units come from a fixed
list; names are capitalised words inside a sentence. Other words are compared
in lower case without punctuation around them. Windows of which less than half
of the tokens are literal are compared by the values of all tokens; they do not
count for ``COVERAGE`` unless an item has no others. Items shorter than a window
are one window as they are; those of fewer than ``SHORT`` tokens hold too little
of a template and are compared by value, so a document is reported that has the
same words side by side anywhere.

Windows of the benchmark are sent to the executors as a filter if there are at
most ``FILTER_WINDOWS`` of them (a checked bound); a larger benchmark is joined
without the filter, by a shuffle.

Defined results: null and empty texts and items have no window; repeated rows
and items are reported each; pairs come once per row of the documents; other
columns are kept by ``remove`` and not read by ``leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import ROW, mix64

WINDOW = 8
COVERAGE = 0.25
VERBATIM = 13
SHORT = 3
FILTER_WINDOWS = 1_000_000
SMALL_ROWS = 1_000_000  # numbers of rows that are broadcast: below 20 MB
TRIM = ".,;:!?|*#\"'()[]{}<>«»“”‘’…–—-"

# Words that stand for numbers, and for units.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds lb lbs ounce ounces oz ton tons ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur mph kph degree degrees celsius fahrenheit percent metre metres meter meters kilometre kilometres kilometer kilometers centimetre centimetres centimeter centimeters".split()

NUMBER, UNIT, NAME = np.uint64(1), np.uint64(2), np.uint64(3)
STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tokens:
    """Tokens of a batch: row, code and code of the value (0: not in the vocabulary), placeholder kind, and text."""

    row: np.ndarray
    code: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    text: pa.Array
    index: np.ndarray


def tokens(column: pa.Array, vocabulary: pa.Array | None = None) -> Tokens:
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    spaced = pc.replace_substring_regex(column.cast(pa.large_string()), r"[\t-\r]", " ")
    lists = pc.split_pattern(spaced, " ")
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    index, raw = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    bare = pc.utf8_trim(raw, TRIM)
    lower = pc.utf8_lower(bare)
    flag = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    empty = flag(pc.equal(bare, ""))
    number = flag(pc.match_substring_regex(bare, "[0-9]")) | flag(pc.is_in(lower, pa.array(NUMBERS, lower.type)))
    unit = flag(pc.is_in(lower, pa.array(UNITS, lower.type))) & ~number
    title = flag(pc.match_substring_regex(bare, r"^\p{Lu}\p{Ll}")) & ~number & ~unit
    ends = flag(pc.match_substring_regex(raw, r"[.!?][\"'”’)\]]*$"))
    literal = np.zeros(len(raw), dtype=np.uint64)
    known = np.ones(len(raw), dtype=bool) if vocabulary is None else flag(pc.is_in(lower, vocabulary.cast(lower.type)))
    at = np.flatnonzero(known & ~empty)
    literal[at] = common.hash_strings(lower.take(pa.array(at))) | np.uint64(8)

    full = ~empty[index] if len(index) else np.empty(0, dtype=bool)
    rows, index = rows[full], index[full]
    starts = np.ones(len(rows), dtype=bool)
    starts[1:] = (rows[1:] != rows[:-1]) | ends[index[:-1]]
    kind = np.zeros(len(rows), dtype=np.uint64)
    kind[number[index]] = NUMBER
    kind[unit[index]] = UNIT
    kind[title[index] & ~starts] = NAME
    return Tokens(rows, np.where(kind > 0, kind, literal[index]), literal[index], kind, bare, index)


def window_hashes(t: Tokens, width: int, by_value: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of each window of enough literal tokens, all known.

    With ``by_value`` the other windows, by the values of all their tokens.
    """
    n = len(t.row) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    code = t.value if by_value else t.code
    fine = t.row[:n] == t.row[width - 1 :]
    unknown = np.append(0, np.cumsum(code == 0))
    literal = np.append(0, np.cumsum(t.kind == 0))
    enough = (2 * (literal[width:] - literal[:n]) >= width) & (width >= SHORT)
    fine &= (unknown[width:] == unknown[:n]) & (enough != by_value)
    at = np.flatnonzero(fine)
    h = np.full(len(at), width + (1 << 16 if by_value else 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = mix64(h * STEP + code[at + k])
    return at, h


SCHEMA = "key long, place int, width int, by_value boolean, hash long, slots array<string>"


def _windows(t: Tokens, keys: np.ndarray, widths: list[int], wanted: np.ndarray | None, own_length: bool) -> Iterator[pa.RecordBatch]:
    begins = np.flatnonzero(np.append(True, t.row[1:] != t.row[:-1])) if len(t.row) else np.empty(0, dtype=np.int64)
    lengths = np.diff(np.append(begins, len(t.row)))
    begin_of, length_of = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    begin_of[t.row[begins]], length_of[t.row[begins]] = begins, lengths
    for width, by_value in ((w, v) for w in widths for v in (False, True)):
        at, h = window_hashes(t, width, by_value)
        keep = np.ones(len(at), dtype=bool)
        if own_length and width < WINDOW:
            keep &= length_of[t.row[at]] == width
        if wanted is not None and len(at):
            i = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
            keep &= (wanted[i] == h) if len(wanted) else False
        at, h = at[keep], h[keep]
        if not len(at):
            continue
        texts = t.text
        slots = [[f"{t.kind[p + k]}:{texts[int(t.index[p + k])].as_py().lower()}" for k in range(width) if t.kind[p + k]] for p in at.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[t.row[at]]), pa.array((at - begin_of[t.row[at]]).astype(np.int32)), pa.array(np.full(len(at), width, dtype=np.int32)), pa.array(np.full(len(at), by_value)), pa.array(common.signed(h)), pa.array(slots, pa.list_(pa.string()))],
            names=["key", "place", "width", "by_value", "hash", "slots"],
        )


def windows(rows: DataFrame, widths: list[int], wanted: np.ndarray | None = None, vocabulary: pa.Array | None = None, own_length: bool = False) -> DataFrame:
    """Template windows of ``rows`` (ROW, text), only those wanted if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _windows(tokens(batch["text"], vocabulary), batch[ROW].to_numpy(), widths, wanted, own_length)

    return rows.select(ROW, "text").mapInArrow(run, SCHEMA)


def _vocabulary(items: DataFrame) -> pa.Array:
    """Distinct literal words of the items; bounded by their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = tokens(batch["text"])
            words = pc.unique(pc.utf8_lower(t.text).take(pa.array(np.unique(t.index))))
            yield pa.RecordBatch.from_arrays([words.cast(pa.string())], names=["word"])

    found = items.select("text").mapInArrow(run, "word string").distinct().toArrow()
    return found["word"].combine_chunks()


def leaks(rows: DataFrame, items: DataFrame, coverage: float = COVERAGE, filter_windows: int = FILTER_WINDOWS) -> DataFrame:
    """(ROW, item_row, n_windows, item_windows) of the pairs covered enough.

    Both tables hold (ROW, text).
    """
    common.small_batches(rows.sparkSession)
    widths = list(range(1, WINDOW + 1))
    known = common.checkpoint(windows(items, widths, own_length=True))
    counted = known.groupBy("width").count().collect()  # at most WINDOW rows
    widths = sorted(r["width"] for r in counted)
    wanted = vocabulary = None
    if sum(r["count"] for r in counted) <= filter_windows:
        wanted = np.unique(known.select("hash").toArrow()["hash"].to_numpy().view(np.uint64))
        vocabulary = _vocabulary(items)
    found = windows(rows, widths, wanted, vocabulary)
    template = F.count(F.when(~F.col("by_value"), 1))
    totals = known.groupBy("key").agg(F.count("*").alias("item_windows"), template.alias("__template")).withColumnRenamed("key", "item_row")
    items_side = known.select("hash", "width", "by_value", F.col("key").alias("item_row"), F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    matched = found.join(items_side, ["hash", "width", "by_value"]).select(F.col("key").alias(ROW), "item_row", "item_place", "width", "by_value", (F.col("place") - F.col("item_place")).alias("diagonal"), F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")).alias("pairs"))
    # Aggregates of each alignment: its windows and its distinct slot pairs,
    # both bounded by the length of the item.
    place = F.struct("item_place", "by_value")
    verbatim = F.forall("pairs", lambda x: x["i"] == x["d"])
    aligned = matched.groupBy(ROW, "item_row", "diagonal").agg(
        F.collect_set(place).alias("places"),
        F.collect_set(F.when(verbatim, place)).alias("same"),
        F.array_sort(F.collect_set(F.when(verbatim & (F.col("width") == WINDOW), F.col("item_place")))).alias("run"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda x: x["i"]))) == F.size("pairs")
    step = VERBATIM - WINDOW
    starts = F.when(F.size("run") > step, F.sequence(F.lit(1), F.size("run") - step))
    long_run = F.coalesce(F.exists(starts, lambda k: F.element_at("run", k + step) - F.element_at("run", k) == step), F.lit(False))
    counted = aligned.select(ROW, "item_row", F.when(consistent, F.col("places")).otherwise(F.col("same")).alias("places"), long_run.alias("__long"))
    covered = counted.groupBy(ROW, "item_row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.max("__long").alias("__long"))
    covered = covered.select(ROW, "item_row", "__long", F.size("places").cast("long").alias("n_windows"), F.size(F.filter("places", lambda p: ~p["by_value"])).alias("__n"))
    part = F.when(F.col("__template") > 0, F.col("__n") >= coverage * F.col("__template")).otherwise(F.col("n_windows") >= coverage * F.col("item_windows"))
    return covered.join(totals, "item_row").where((F.col("n_windows") > 0) & (F.col("__long") | part)).select(ROW, "item_row", "n_windows", "item_windows")


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, n_windows, item_windows) of each contaminated pair."""
    rows = common.with_row(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    items = common.with_row(benchmark.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")))
    found = leaks(rows, items)
    named = found.join(items.select(F.col(ROW).alias("item_row"), "item"), "item_row").join(rows.select(ROW, "key"), ROW)
    return named.select(F.col("key").alias(key), F.col("item").alias(item_key), "n_windows", "item_windows")


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows."""
    names = docs.columns
    rows = common.with_row(docs.select(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names)), F.col(text).alias("text")))
    items = common.with_row(benchmark.select(F.col(item_text).alias("text")))
    bad = common.checkpoint(leaks(rows.select(ROW, "text"), items).select(ROW).distinct())
    return rows.join(common.sized(bad, SMALL_ROWS), ROW, "left_anti").select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
