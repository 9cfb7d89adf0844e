"""The streaming adapter."""

import pytest

from quern.sources.model import Model, ModelProblem
from quern.streaming import adapter


def test_windowed_counts(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet").selectExpr("event_id", "ts::timestamp AS ts", "user_id", "event_type", "value")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    model = Model(spark, {"events": batch}).load("source: events is t.table('events') extend { measure: n is count(), s is value.sum() }")
    text = "source: live is t.table('live') extend { measure: n is count() } run: live -> { where: value > 0 group_by: ts.day, event_type aggregate: n, hi is max(value) }"
    out = adapter.run(model, text, {"live": stream}, ("ts", "1 day"))
    q = out.writeStream.outputMode("append").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    found = {(r.ts, r.event_type): r.n for r in spark.table("days").collect()}
    wanted = {(r.ts, r.event_type): r.n for r in model.run("run: events -> { where: value > 0 group_by: ts.day, event_type aggregate: n }").collect()}
    assert found and all(wanted[k] == v for k, v in found.items())


@pytest.mark.parametrize("body", ["group_by: event_type aggregate: n is count() limit: 3", "group_by: event_type nest: x is { group_by: user_id }", "aggregate: a is all(count())", "aggregate: d is count(user_id)", "group_by: event_type aggregate: n is count() calculate: r is rank()"])
def test_refusals(spark, data, body):
    stream = spark.readStream.format("rate").load().selectExpr("timestamp AS ts", "value AS user_id", "'x' AS event_type")
    with pytest.raises(ModelProblem):
        adapter.run(Model(spark), f"run: t.table('live') -> {{ {body} }}", {"live": stream})
