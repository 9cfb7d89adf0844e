"""Queries over streams: the part of the language that Structured Streaming can keep up.

A stage with where:, select: or group_by: and additive aggregates runs over a
streaming DataFrame. Time dimensions on the watermark's column, such as
``ts.hour``, become windows, so results are final once the watermark passes.
Nests, windows, ungrouped and symmetric aggregates, index and limits need all
rows and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.lang.syntax import Node, parse
from quern.plans.planner import Planner, Query
from quern.sources.model import Model, ModelProblem, Source, nodes

WINDOWS = {"second": "1 second", "minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days"}
ADDITIVE = frozenset(("count", "sum", "avg", "min", "max", "count_approx"))
#: Windows are aligned to 1970-01-01, a Thursday; weeks begin on Sunday.
WEEK_OFFSET = "3 days"


def run(model: Model, text: str, streams: dict[str, DataFrame], watermark: tuple[str, str] | None = None) -> DataFrame:
    """The streaming DataFrame of a text whose source reads one of ``streams``.

    ``watermark`` is (column, delay), as in ("ts", "10 minutes").
    """
    column = watermark[0] if watermark else None
    inner = Model(model.spark, {**model.tables, **{k: (df.withWatermark(*watermark) if watermark else df) for k, df in streams.items()}}, model.base, model.virtual)
    inner.sources, inner.queries, inner.types, inner.givens = dict(model.sources), dict(model.queries), dict(model.types), dict(model.givens)
    inner.runs = []
    for s in parse(text):
        inner.statement(s)
    source, stages, raw = Query(inner, inner.runs[-1]).parts(inner.runs[-1])
    if raw is not None or len(stages) != 1 or isinstance(stages[0], Node):
        raise ModelProblem("a stream takes one stage")
    stage = stages[0]
    for kind in ("nest", "calculate", "index", "order", "limit", "having"):
        if stage.of(kind):
            raise ModelProblem(f"{kind} needs all rows; a stream never has them")
    for n in nodes([p.f for p in stage.properties]):
        if n.kind == "ungroup":
            raise ModelProblem(f"{n.how}() needs all rows; a stream never has them")
        if n.kind == "call" and n.name == "count" and n.args:
            raise ModelProblem("count(x) of a stream: use count_approx(x)")
    return aggregate(inner, source, stage, column) if stage.kind == "reduce" else Planner(inner, source, stage).run(False, {})


def aggregate(model: Model, source: Source, stage, column: str | None) -> DataFrame:
    plan = Planner(model, source, stage)
    level = plan.level(stage, None)
    if any(n.path for n in plan.frame.nodes.values() if n.kind in ("many", "cross", "array")):
        raise ModelProblem("joins that repeat rows need symmetric aggregates; a stream has none")
    df = plan.frame.build()
    for w in source.where:
        df = df.where(plan.compiler(None).condition(w))
    for c in level.where:
        df = df.where(c)
    groups, outs = [], []
    for d, item in zip(level.dims, stage.of("group_by"), strict=True):
        e = item.expr
        if e.kind == "trunc" and column and e.expr.kind == "path" and e.expr.path == [column]:
            if e.unit not in WINDOWS:
                raise ModelProblem(f"windows of a {e.unit} have no fixed length")
            time = plan.frame.column((), column)
            groups.append(F.window(time, WINDOWS[e.unit], startTime=WEEK_OFFSET) if e.unit == "week" else F.window(time, WINDOWS[e.unit]))
            outs.append(F.col("window.start").alias(d.name))
        else:
            groups.append(d.e.c.alias(d.id))
            outs.append(F.col(d.id).alias(d.name))
    made = df.groupBy(*groups).agg(*(plan.plain_column(s).alias(s.name) for s in level.ledger.specs))
    return made.select(*outs, *(a.e.c.alias(a.name) for a in level.aggs))
