"""Each pipeline stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
import corpus_pipeline
from quern.llm import bpe, common

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def plain(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.mark.parametrize("name", list(STAGES))
def test_edges(spark, data, plain, nothing, name):
    out = STAGES[name](spark, plain, data)
    rows = out.collect()
    kept = plain.columns
    assert out.columns[: len(kept)] == kept and (name == "bpe" or out.columns == kept)
    texts = {r.doc_id: r.text for r in plain.where("doc_id IS NOT NULL").collect()}
    assert all(r.doc_id is None or r.doc_id in texts for r in rows)
    if name in ("toxicity", "decontamination"):
        assert len(rows) == plain.count() and all(r.text == texts[r.doc_id] for r in rows if r.doc_id is not None)
    if name == "near_duplicates":
        assert len(rows) == plain.count() - 2 and sum((r.text or "").strip() == "" for r in rows) == 3
    if name == "suffix_dedup":
        assert len(rows) == plain.count() and [r.text for r in rows if r.doc_id == 0] == [None] and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        assert {r.text for r in rows if r.doc_id in (4, 5)} == {""}
    if name == "bpe":
        assert all(r.text == (texts[r.doc_id] or "") for r in rows if r.doc_id is not None) and all(r.n_tokens == len(r.token_ids) for r in rows)
    assert STAGES[name](spark, nothing.select(*kept), data).count() == 0


@pytest.mark.parametrize("name", [n for n in STAGES if n != "bpe"])
def test_clashing_columns(spark, data, docs, name):
    """Columns with names that operators use themselves are kept as they are."""
    out = STAGES[name](spark, docs, data)
    assert out.columns == docs.columns and out.count() >= docs.count() - 2
    assert out.where("bucket IS NOT NULL OR kept IS NOT NULL OR hash IS NOT NULL").count() == 0


def test_encode_and_decode_keep_columns(docs):
    out = bpe.decode(bpe.encode(docs))
    assert out.columns == [*docs.columns, "token_ids", "decoded"]


def test_clean_documents_stay(spark, data):
    """Of ordinary documents no filtering stage takes any away."""
    words = [f"plain{i % 89} word{i % 83} text{i}" for i in range(300)]
    df = spark.createDataFrame([(i, " ".join(words[i % 200 : i % 200 + 40]) + f" number {i}", "en", "s", 1) for i in range(0, 200, 50)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("toxicity", "near_duplicates", "decontamination"):
        assert STAGES[name](spark, df, data).count() == df.count(), name


def test_table(spark, data):
    assert common.table(spark, data, "region").count() == 5
