"""Entry points of the corpus operators for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, dart_minhash, decontaminate, licenses, pitman_yor, suffix_dedup, syncmers, token_counts, toxicity, warc_zip
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.report(table(spark, sf_dir, "documents"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.report(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_syncmers,
        op3_pitman_yor,
        op4_token_counts,
        op5_warc_zip,
        op6_decontamination,
        op7_near_duplicates,
        op8_licenses,
        op9_toxicity,
        op10_suffix_dedup,
    )
}


def _canonical_sql(column: str) -> str:
    out = f"lower(coalesce({column}, ''))"
    out = f"regexp_replace({out}, '{licenses.COPYRIGHT}', ' ', 'g')"
    out = f"trim(regexp_replace({out}, '{licenses.PUNCTUATION}', ' ', 'g'))"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def _licenses_sql() -> str:
    quoted = lambda pairs: ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in pairs)
    return f"""
    WITH known AS (
        SELECT digest, min(licence) AS licence FROM (
            SELECT md5({_canonical_sql("text")}) AS digest, licence FROM (VALUES {quoted(licenses.KNOWN)}) AS t(licence, text)
            UNION ALL SELECT digest, licence FROM (VALUES {quoted(licenses.DIGESTS)}) AS d(licence, digest))
        GROUP BY 1),
    docs AS (SELECT row_number() OVER () AS rid, doc_id, text, md5({_canonical_sql("text")}) AS text_digest FROM documents),
    lines AS (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs),
    noted AS (
        SELECT rid, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences, count(*) AS n
        FROM lines JOIN known ON known.digest = md5({_canonical_sql("line")})
        WHERE line <> '' GROUP BY rid)
    SELECT doc_id, text_digest, known.licence AS text_licence, coalesce(line_licences, '') AS line_licences, coalesce(n, 0) AS n_license_lines
    FROM docs LEFT JOIN known ON known.digest = docs.text_digest LEFT JOIN noted USING (rid)
    """


ORACLE_SQL: dict[str, str] = {
    "op8_licenses": _licenses_sql(),
}
