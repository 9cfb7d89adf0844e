"""A training corpus from ``documents``, in stages of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents; columns besides these are kept by all but the last, too,
whatever their names. Rows are told apart by their place, so ids may be null or
repeat. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, dart_minhash, decontaminate, suffix_dedup, toxicity
from quern.llm.common import shared_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject.

    Null and empty texts have the model's base rate, so they stay unless most
    labelled texts are toxic; equal texts are judged alike; without labels of
    both classes all rows stay.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the first in the table.

    Texts without words (null and empty ones, too) are no copies of each other
    and all stay.
    """
    return dart_minhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur elsewhere as well.

    All rows stay: a text that is repeated as a whole becomes empty, a null one
    stays null. ``n_chars`` is counted anew (null for null texts). A character
    of which only some bytes are left goes.
    """
    return suffix_dedup.rewrite(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; null and empty texts stay."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids; the text is what the ids decode to.

    A null text becomes empty, with no ids. Of other columns only those of
    documents are returned.
    """
    encoded = bpe.decode(bpe.encode(docs), out="decoded")
    return encoded.select("doc_id", F.decode("decoded", "UTF-8").alias("text"), "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: The classifier, signatures and tokenizer are beyond SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
