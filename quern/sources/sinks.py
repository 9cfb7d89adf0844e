"""Where results go: rows, an iterator of rows, JSON and CSV."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.compiler import quoted


#: What a job group sets in a thread.
_GROUP = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


def rows(df: DataFrame, limit: int | None = None, tag: str | None = None) -> list[dict[str, Any]]:
    """Result rows as dictionaries, nests included; no limit unless asked for.

    With a tag, ``abort(spark, tag)`` in another thread ends the query.
    """
    sc = df.sparkSession.sparkContext
    before = {name: sc.getLocalProperty(name) for name in _GROUP}
    if tag is not None:
        sc.setJobGroup(tag, tag, interruptOnCancel=True)
    try:
        return [r.asDict(recursive=True) for r in (df.limit(limit) if limit is not None else df).collect()]
    finally:
        for name, value in before.items():
            sc.setLocalProperty(name, value)


def abort(spark: SparkSession, tag: str) -> None:
    """End the jobs of queries with this tag."""
    spark.sparkContext.cancelJobGroup(tag)


def stream(df: DataFrame) -> Iterator[dict[str, Any]]:
    """Result rows one by one, one partition in memory at a time."""
    for r in df.toLocalIterator(prefetchPartitions=True):
        yield r.asDict(recursive=True)


def flattened(df: DataFrame) -> DataFrame:
    """A rectangular table: records become columns, arrays of records rows.

    Arrays side by side are not multiplied: their rows stand one below the
    other, with nulls in the other's columns.
    """
    while True:
        record = next((f for f in df.schema if isinstance(f.dataType, T.StructType)), None)
        if record is not None:
            inner = [quoted(record.name).getField(n).alias(f"{record.name}.{n}") for n in record.dataType.names]
            df = df.select(*(c for f in df.schema for c in (inner if f is record or f.name == record.name else [quoted(f.name)])))
            continue
        arrays = [f for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        if not arrays:
            return df
        parts = []
        for i, a in enumerate(arrays):
            others = {f.name for f in arrays if f.name != a.name}
            source = df if i == 0 else df.where(F.size(quoted(a.name)) > 0)
            exploded = F.explode_outer(quoted(a.name)).alias(a.name)
            kept = [exploded if f.name == a.name else F.lit(None).cast(f.dataType).alias(f.name) if f.name in others else quoted(f.name) for f in df.schema]
            parts.append(source.select(*kept))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        df = out


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested results are flattened first."""
    flattened(df).write.mode("overwrite").option("header", True).csv(path)


def cost(df: DataFrame) -> int:
    """Bytes that Catalyst expects the query's scans to read."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
