"""Fluent queries: the same stages as in a text, built step by step.

    Q("orders").where("o_totalprice > 1000").group_by("o_orderstatus").aggregate("n is count()")
        .nest("top", Q().group_by("o_orderpriority").aggregate("n is count()").limit(2))

Expressions are texts of the language. Every call returns a new query.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from quern.sources.model import Model


class Q:
    """A pipeline of stages over a source named or given as a text."""

    def __init__(self, source: str | None = None):
        self.source = source
        self.stages: list[list[str]] = [[]]
        self.starts: list[str | None] = [None]

    def _with(self, line: str) -> Q:
        out = Q(self.source)
        out.stages = [*self.stages[:-1], [*self.stages[-1], line]]
        out.starts = list(self.starts)
        return out

    def _list(self, what: str, items: tuple[str, ...]) -> Q:
        return self._with(f"{what}: {', '.join(items)}")

    def view(self, name: str) -> Q:
        """Begin the current stage with a view of the source."""
        out = self._with("")
        out.starts[-1] = name
        out.stages[-1] = [x for x in out.stages[-1] if x]
        return out

    def select(self, *items: str) -> Q:
        return self._list("select", items)

    def group_by(self, *items: str) -> Q:
        return self._list("group_by", items)

    def aggregate(self, *items: str) -> Q:
        return self._list("aggregate", items)

    def calculate(self, *items: str) -> Q:
        return self._list("calculate", items)

    def where(self, *items: str) -> Q:
        return self._list("where", items)

    def having(self, *items: str) -> Q:
        return self._list("having", items)

    def order_by(self, *items: str) -> Q:
        return self._list("order_by", items)

    def index(self, *items: str) -> Q:
        return self._list("index", items)

    def drill(self, *items: str) -> Q:
        return self._list("drill", items)

    def limit(self, n: int) -> Q:
        return self._with(f"limit: {n}")

    def timezone(self, zone: str) -> Q:
        return self._with(f"timezone: '{zone}'")

    def nest(self, name: str, inner: Q | str) -> Q:
        return self._with(f"nest: {name} is {inner if isinstance(inner, str) else inner.pipeline()}")

    def then(self) -> Q:
        """Begin another stage over the result so far."""
        out = Q(self.source)
        out.stages, out.starts = [*self.stages, []], [*self.starts, None]
        return out

    def pipeline(self) -> str:
        parts = []
        for start, lines in zip(self.starts, self.stages, strict=True):
            body = "{ " + "\n".join(lines) + " }"
            parts.append(body if start is None else f"{start} + {body}" if lines else start)
        return " -> ".join(parts)

    def text(self) -> str:
        return f"run: {self.source} -> {self.pipeline()}"

    def run(self, model: Model, givens: dict[str, Any] | None = None) -> DataFrame:
        return model.run(self.text(), givens)
