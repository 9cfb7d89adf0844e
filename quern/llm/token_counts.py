"""Exact token counts of texts of any length by overlap resynchronisation.

Texts are cut at stable places (see ``cuts``) into words with the blanks before
them. The library encodes each distinct piece once, many side by side in one
text; a worker keeps where the tokens begin in the pieces it met first.
Tokenizers that are no plain byte-level BPE, or whose added tokens look at
blanks or hold them, get texts and chunks whole.

A huge text is encoded in chunks that overlap, with offsets. Two neighbours
are spliced at a stable place inside their overlap at which a
token of both begins: tokens left of it are counted from the first chunk,
those right of it from the second. If the overlap has no such place it is
widened and the chunk encoded again, at worst up to the end of the text.

Defined results: null and empty texts have 0 bytes and 0 tokens; each row is
counted alone, so ties and repeated rows change nothing; other columns are not
read; strings of special tokens inside a text count as the library counts them
by default, and no splice falls inside one.
"""

from __future__ import annotations

import functools
import json
import os
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, cuts

VOCABULARY = "byte_bpe_50k.json"
CHUNK_CHARS = 16384
OVERLAP_CHARS = 256
LIMIT = 512
#: Pieces whose tokens are kept, the characters of one, and how many are encoded as one text.
KEPT_PIECES = 500_000
KEPT_CHARS = 64
JOINED_PIECES = 500


class ChunkedCounter:
    """Counts tokens as the tokenizers library does for whole texts."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = max(1, chunk), max(2, overlap)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [x.content for x in added]
        made = json.loads(self.tokenizer.to_str())
        split, model = made["pre_tokenizer"] or {}, made["model"]
        self.in_pieces = (
            made["normalizer"] is None
            and made["post_processor"] is None
            and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
            and model["type"] == "BPE"
            and not model.get("dropout")
            and not any(x.lstrip or x.rstrip or x.single_word or any(c.isspace() for c in x.content) for x in added)
        )
        self.kept: dict[str, Sequence[int]] = {}

    def count_all(self, texts: list[str]) -> list[int]:
        """Short texts go to the library together, long ones in chunks."""
        short = [i for i, x in enumerate(texts) if len(x) <= self.chunk + self.overlap]
        out = [-1] * len(texts)
        if self.in_pieces:
            counts = [sum(map(len, x)) for x in self._told([cuts.pieces(texts[i]) for i in short])]
        else:
            counts = [len(e) for e in self.tokenizer.encode_batch([texts[i] for i in short], add_special_tokens=False)]
        for i, n in zip(short, counts, strict=True):
            out[i] = n
        return [self.count(texts[i]) if n < 0 else n for i, n in enumerate(out)]

    def _told(self, parts: list[list[str]]) -> list[list[Sequence[int]]]:
        """Where the tokens of each piece begin, for lists of pieces."""
        new = list(set().union(*parts).difference(self.kept))
        self.kept.update(zip(new, self._encoded(new), strict=True))
        out = [list(map(self.kept.__getitem__, p)) for p in parts]
        full = len(self.kept) > KEPT_PIECES
        for p in new:
            if full or len(p) > KEPT_CHARS:
                del self.kept[p]
        return out

    def _encoded(self, pieces: list[str]) -> list[Sequence[int]]:
        """The same for pieces; they are encoded side by side where that leaves them apart."""
        texts: list[str] = []
        sizes: list[list[int]] = []
        apart = [not cuts.joinable(p) for p in pieces]
        order = sorted(range(len(pieces)), key=apart.__getitem__)
        side = len(pieces) - sum(apart)
        for lo in range(0, side, JOINED_PIECES):
            group = [pieces[i] for i in order[lo : min(side, lo + JOINED_PIECES)]]
            texts.append("".join(group))
            sizes.append([len(p) for p in group])
        for i in order[side:]:
            texts.append(pieces[i])
            sizes.append([len(pieces[i])])
        out: list[Sequence[int]] = [b""] * len(pieces)
        at = iter(order)
        for e, lengths in zip(self.tokenizer.encode_batch(texts, add_special_tokens=False), sizes, strict=True):
            starts = [a for a, _ in e.offsets]
            begin, first = 0, 0
            for n in lengths:
                last = bisect_left(starts, begin + n, first)
                found = [a - begin for a in starts[first:last]]
                out[next(at)] = bytes(found) if n <= 256 else found
                begin, first = begin + n, last
        return out

    def count(self, text: str) -> int:
        total, start, splice = 0, 0, 0
        while True:
            overlap = self.overlap
            while True:
                end = min(len(text), start + self.chunk + overlap)
                starts = self._starts(text, start, end)
                done = bisect_left(starts, splice)
                if end == len(text):
                    return total + len(starts) - done
                begin = start + self.chunk
                after = self._starts(text, begin, end)
                place = self._place(text, begin, end, starts, after)
                if place >= 0:
                    break
                overlap *= 2
            total += bisect_left(starts, place) - done
            start, splice = begin, place

    def _starts(self, text: str, lo: int, hi: int) -> list[int]:
        if not self.in_pieces:
            return [lo + a for a, _ in self.tokenizer.encode(text[lo:hi], add_special_tokens=False).offsets]
        pieces = cuts.pieces(text[lo:hi])
        begins = accumulate(map(len, pieces), initial=lo)
        return [begin + a for begin, starts in zip(begins, self._told([pieces])[0], strict=False) for a in starts]

    def _place(self, text: str, lo: int, hi: int, first: list[int], second: list[int]) -> int:
        """A stable place strictly inside text[lo:hi] where both have a token's begin."""
        p = cuts.first_cut(text, lo, hi)
        while p >= 0:
            if self._begins(first, p) and self._begins(second, p) and not self._in_special(text, p):
                return p
            p = cuts.first_cut(text, p, hi)
        return -1

    @staticmethod
    def _begins(starts: list[int], p: int) -> bool:
        i = bisect_left(starts, p)
        return i < len(starts) and starts[i] == p

    def _in_special(self, text: str, p: int) -> bool:
        return any(s in text[max(0, p - len(s) + 1) : p + len(s) - 1] for s in self.special)


@functools.cache
def counter(path: str, chunk: int, overlap: int) -> ChunkedCounter:
    return ChunkedCounter(path, chunk, overlap)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row."""
    common.small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(common.tokenizer_file(vocabulary), chunk, overlap)
        for batch in batches:
            texts = common.text_values(batch[text])
            n = c.count_all(texts)
            yield pa.RecordBatch.from_arrays([batch[key], pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=schema.names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
