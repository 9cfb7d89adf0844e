"""Tags and notebooks."""

from quern.lang import notebook
from quern.lang.tags import tags
from quern.sources.model import Model


def test_tags():
    assert tags(["# bar size=large title='a b' list=[x, 'y z'] nested { k=1 } a.b=2", "# -bar size=small"]) == {"size": "small", "title": "a b", "list": ["x", "y z"], "nested": {"k": "1"}, "a": {"b": "2"}}


def test_field_notes(spark, data):
    m = Model(spark, {"region": f"{data}/region.parquet"}).load("## top\n# percent\nsource: r is t.table('region') extend {\n # label=key\n dimension: k is r_regionkey\n}")
    assert tags(m.sources["r"].notes) == {"percent": True}


def test_notebook(spark, data):
    m = Model(spark, {"region": f"{data}/region.parquet"})
    text = ">>>markdown\n# Title\n>>>model\nsource: r is t.table('region')\nrun: r -> { aggregate: n is count() }\n>>>sql\nSELECT n + 1 AS k FROM %{ r -> { aggregate: n is count() } }\n"
    out = list(notebook.run(m, text))
    assert [c.kind for c, _ in out] == ["markdown", "model", "sql"]
    assert out[1][1].first().n == 5 and out[2][1].first().k == 6
