"""Document fingerprints from closed syncmers, by DataFrame functions only.

A text's tokens are its words (each CJK character is a word). Of every run of
``K`` tokens, it is an *anchor* if the least hash among its inner runs of ``S``
tokens stands at its first or last place. Whether a run is an anchor depends on
nothing outside it, so shared passages have the same anchors wherever they
stand.

Texts are matched by anchors and their places: a *link* is two neighbouring
anchors and the number of tokens between them. The fingerprint is all links of
a text, in order, so equal links are anchors that stand at the same distance in
both texts, and a shared passage is matched wherever it stands. Nothing is
sampled: the fingerprint grows with the text. Likeness is the share of common
links (32 bits each) among the distinct links of both.

Defined results: a text of fewer than K tokens has one anchor, all its tokens;
a text of one anchor has one link, that anchor; null and empty texts and texts
without words have an empty fingerprint, and two empty fingerprints are alike
by 1, one and another by 0; equal texts have equal fingerprints. Ids may be
numbers or anything that is ordered as text; rows are ordered by id, null ids
first, and equal ids by hash and text; the last row is followed by the first, a
lone row by itself.

The next row is found without a global sort: ids are cut into ranges at
quantiles and each range into equal parts of about ``BUCKET`` rows (null ids by
the hash of their text); windows run inside a part, and the first row of each
part is handed to the part before it. Rows of one repeated id that is not null
are in one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 6
S = 2
BUCKET = 256
QUANTILES = 256
SUPER = 1024  # parts that are put in order together
WORD_BREAK = r"\s+|(?<=[぀-ヿ㐀-鿿가-힯])"
LINK_BITS = 32


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (place, hash) of the anchors of a text; places count tokens from 1."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    inner = k - s + 1

    def of(h: Column) -> Column:
        n = F.size(h)
        runs = lambda i, size: F.xxhash64(*(F.get(h, i + j) for j in range(size)))
        small = F.when(n >= k, F.transform(F.sequence(F.lit(0), n - s), lambda i: runs(i, s)))

        def chosen(m: Column) -> Column:
            least = lambda i: F.least(*(F.get(m, i + j) for j in range(inner)))
            places = F.filter(F.sequence(F.lit(0), n - k), lambda i: F.least(F.get(m, i), F.get(m, i + (inner - 1))) == least(i))
            return F.transform(places, lambda i: F.struct((i + 1).alias("place"), runs(i, k).alias("hash")))

        whole = F.array(F.struct(F.lit(1).alias("place"), F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")).alias("hash")))
        # array(x)[0] binds x once for the functions inside.
        long = F.get(F.transform(F.array(small), chosen), F.lit(0))
        return F.when(n >= k, long).when(n > 0, whole).otherwise(F.array().cast("array<struct<place:int,hash:bigint>>"))

    return F.get(F.transform(F.array(hashes), of), F.lit(0))


def links(found: Column) -> Column:
    """Array of the distinct links between neighbouring anchors, in order."""
    mask = F.lit((1 << LINK_BITS) - 1)

    def of(a: Column) -> Column:
        n = F.size(a)
        here, after = lambda i: F.get(a, i - 1), lambda i: F.get(a, i)
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(here(i)["hash"], after(i)["hash"], after(i)["place"] - here(i)["place"]).bitwiseAND(mask))
        lone = F.transform(a, lambda x: x["hash"].bitwiseAND(mask))
        return F.array_distinct(F.when(n > 1, pairs).otherwise(lone))

    return F.get(F.transform(F.array(found), of), F.lit(0))


def fingerprint(text: Column, k: int = K, s: int = S) -> Column:
    """The links of a text."""
    return links(anchors(text, k, s))


def likeness(a: Column, b: Column) -> Column:
    """Similarity of two fingerprints, 0 to 1."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, 1.0).otherwise(shared / F.greatest(either, F.lit(1)))


def text_form(found: Column) -> Column:
    """A fingerprint as hex digits, 8 for each link."""
    return F.lower(F.array_join(F.transform(found, lambda x: F.lpad(F.hex(x), LINK_BITS // 4, "0")), ""))


def _bucket(rows: DataFrame) -> Column:
    """Part of the order of (id, h) that a row falls into; grows with them."""
    if isinstance(rows.schema["id"].dataType, T.NumericType):
        value = F.col("id").cast("double")
    else:  # the first bytes, as a number
        value = F.conv(F.rpad(F.hex(F.substring(F.encode("id", "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    valued = rows.select(value.alias("v"))
    count, low, nulls = valued.agg(F.count("v"), F.min("v"), F.count_if(F.col("v").isNull())).first()
    lone = max(1, nulls // BUCKET)  # parts of null ids, numbered -lone .. -1
    of_null = F.floor(F.shiftrightunsigned(F.col("h"), 33) / float(1 << 31) * lone) - lone
    if not count:
        return of_null.cast("long")
    cuts = sorted({low, *valued.where("v IS NOT NULL").approxQuantile("v", [i / QUANTILES for i in range(1, QUANTILES + 1)], 0.0005)})
    parts = max(1, count // (BUCKET * len(cuts)))
    ends = [*cuts[1:], cuts[-1] + 1]
    widths = [(b - a) / parts or 1.0 for a, b in zip(cuts, ends, strict=True)]
    begins = F.array(*map(F.lit, cuts))
    segment = F.size(F.filter(begins, lambda x: x <= value))
    inside = F.floor((value - F.get(begins, segment - 1)) / F.get(F.array(*map(F.lit, widths)), segment - 1))
    return F.when(value.isNull(), of_null).otherwise(segment * F.lit(1 << 40) + inside).cast("long")


def _order() -> list[Column]:
    return [F.col("id").asc_nulls_first(), F.col("h"), F.col("text")]


def _next_heads(rows: DataFrame) -> DataFrame:
    """(bucket, head): for each bucket the first text of the next one."""
    # Spark keeps one row of each part and task before the shuffle.
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*_order()))
    heads = rows.withColumn("place", place).where("place = 1").select("bucket", F.col("text").alias("head"))
    order = rows.select("bucket").distinct().select("bucket", F.floor(F.col("bucket") / SUPER).alias("part"))
    inside = order.withColumn("next", F.lead("bucket").over(Window.partitionBy("part").orderBy("bucket")))
    # One row for each SUPER parts of BUCKET rows each: small enough for one task.
    parts = order.groupBy("part").agg(F.min("bucket").alias("first"))
    line = Window.orderBy("part")
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = parts.select("part", F.coalesce(F.lead("first").over(line), F.min("first").over(every)).alias("after"))
    pairs = inside.join(after, "part").select(F.col("bucket"), F.coalesce("next", "after").alias("__next"))
    return pairs.join(heads.withColumnRenamed("bucket", "__next"), "__next").select("bucket", "head")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each row and of its edited text.

    The edited text is the row's with its last half (rounded down) of code
    points replaced by the first as many of the next row's. Texts are shuffled
    once, to stand beside the next one.
    """
    plain = isinstance(docs.schema[key].dataType, T.NumericType)
    given = F.col(key) if plain else F.col(key).cast("string")
    rows = docs.select(given.alias("id"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("bucket", _bucket(rows))
    order = Window.partitionBy("bucket").orderBy(*_order())
    led = rows.withColumn("next", F.lead("text").over(order))
    heads = _next_heads(rows).withColumn("head_print", fingerprint(F.col("head")))
    joined = led.join(heads, "bucket", "left")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    next_text = F.coalesce("next", "head", F.lit(""))
    held = ["bucket", "id", "key", "h", "text", "head_print"]
    made = joined.select(*held, n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring(next_text, F.lit(1), half)).alias("edited"))
    made = made.select(*held, "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("own"), fingerprint(F.col("edited")).alias("changed"))
    made = made.withColumn("following", F.coalesce(F.lead("own").over(order), "head_print"))
    return made.select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        text_form(F.col("own")).alias("fingerprint"),
        text_form(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
