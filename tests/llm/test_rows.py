"""Results do not depend on how files are packed into partitions, whatever changes between jobs."""

import itertools

import pytest

from quern.llm import common, dart_minhash, decontaminate, licenses, pitman_yor, suffix_dedup, warc_zip


@pytest.fixture(scope="module")
def files(spark, data, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("files"))
    spark.read.parquet(f"{data}/documents.parquet").repartition(7).write.mode("overwrite").parquet(f"{place}/documents")
    spark.read.parquet(f"{data}/pages.parquet").repartition(5).write.mode("overwrite").parquet(f"{place}/pages")
    return place


def of_documents(run):
    return lambda spark, files, data: run(spark.read.parquet(f"{files}/documents"), spark.read.parquet(f"{data}/benchmark.parquet"))


OPERATORS = {
    "pitman_yor": of_documents(lambda docs, _: pitman_yor.score(docs).drop("score", "perplexity", "base_score")),
    "decontaminate": of_documents(decontaminate.report),
    "dart_minhash": of_documents(lambda docs, _: dart_minhash.report(docs)),
    "suffix_dedup": of_documents(lambda docs, _: suffix_dedup.report(docs)),
    "licenses": of_documents(lambda docs, _: licenses.scan(docs)),
    "keep_one": of_documents(lambda docs, _: dart_minhash.keep_one(docs).select("text").distinct()),
    "rewrite": of_documents(lambda docs, _: suffix_dedup.rewrite(docs)),
    "warc_zip": lambda spark, files, data: warc_zip.round_trip(spark.read.parquet(f"{files}/pages")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_packing_may_change(spark, data, files, monkeypatch, name):
    wanted = sorted(map(tuple, OPERATORS[name](spark, files, data).collect()), key=str)
    assert wanted
    packings, plain = itertools.cycle(["1", "16", "3"]), common.checkpoint

    def checkpoint(df):
        out = plain(df)
        spark.conf.set("spark.sql.files.minPartitionNum", next(packings))
        return out

    monkeypatch.setattr(common, "checkpoint", checkpoint)
    try:
        found = sorted(map(tuple, OPERATORS[name](spark, files, data).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert found == wanted


def test_shared_folder(spark, monkeypatch):
    """A cluster without a shared folder is an error; on one machine there is a temporary one."""

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)
    assert common.shared_dir(spark)


def test_steps_are_discarded(spark):
    step = common.checkpoint(spark.range(5))
    assert step.count() == 5
    common.discard(step)
    with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
        step.count()
    common.discard(step)  # nothing happens


def test_sized(spark):
    few = common.sized(spark.range(10), 10)
    assert "broadcast" in few._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in common.sized(spark.range(11), 10)._jdf.queryExecution().logical().toString().lower()
