"""Sources and models: what queries are asked of.

A ``Source`` is a lazy DataFrame with named fields on top: columns,
dimensions, measures, views and joins. It never changes; extending makes
another one. A ``Model`` holds named sources and queries and reads documents.
"""

from __future__ import annotations

import copy
import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quern.lang import syntax
from quern.lang.syntax import Node


class ModelProblem(ValueError):
    """A document or query that means nothing in this model."""


@dataclass
class JoinDef:
    source: Source
    many: str  # one, many or cross
    how: str = "left"
    on: Node | None = None
    key: Node | None = None


@dataclass
class Field:
    kind: str  # column, dimension, measure, view or join
    dtype: T.DataType | None = None
    expr: Node | None = None
    join: JoinDef | None = None
    access: str | None = None
    notes: list[str] = field(default_factory=list)
    column: str | None = None  # physical name, if renamed
    grouped_by: list[list[str]] = field(default_factory=list)
    unit: str | None = None  # granularity of a truncated time
    scope: Source | None = None  # where a dimension of a joined source was defined


@dataclass
class Source:
    name: str
    frame: Callable[[], DataFrame]
    fields: dict[str, Field]
    primary_key: str | None = None
    where: list[Node] = field(default_factory=list)
    arguments: dict[str, Node] = field(default_factory=dict)
    zone: str | None = None
    hidden: list[str] = field(default_factory=list)
    parts: list[Source] = field(default_factory=list)  # of a composite
    changes: list[list[Node]] = field(default_factory=list)  # made to a composite
    partition: tuple[str, dict[str, list[str]]] | None = None
    notes: list[str] = field(default_factory=list)
    digest: str = ""

    @staticmethod
    def of(name: str, frame: Callable[[], DataFrame] | DataFrame, digest: str = "", units: dict[str, str] | None = None) -> Source:
        df = frame if isinstance(frame, DataFrame) else None
        load = (lambda: df) if df is not None else _once(frame)
        schema = load().schema
        fields = {f.name: Field("column", f.dataType, unit=(units or {}).get(f.name)) for f in schema}
        return Source(name, load, fields, digest=digest or name)

    def copy(self) -> Source:
        out = copy.copy(self)
        out.fields, out.where, out.arguments = dict(self.fields), list(self.where), dict(self.arguments)
        out.changes, out.parts = list(self.changes), list(self.parts)
        return out


def _once(load: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    held: list[DataFrame] = []

    def get() -> DataFrame:
        if not held:
            held.append(load())
        return held[0]

    return get


class Model:
    """Named sources, queries, types and givens over one session."""

    def __init__(self, spark: SparkSession, tables: dict[str, Any] | None = None, base: str = ".", virtual: dict[str, str] | None = None, restricted: bool = False, manifest: dict[str, str] | None = None):
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # wall clocks are UTC
        self.spark, self.base, self.restricted = spark, base, restricted
        self.tables = dict(tables or {})
        self.virtual = dict(virtual or {})
        self.manifest = dict(manifest or {})
        self.sources: dict[str, Any] = {}  # Source or (parameters, Node)
        self.queries: dict[str, Node] = {}
        self.types: dict[str, dict[str, str]] = {}
        self.givens: dict[str, Node] = {}
        self.values: dict[str, Any] = {}
        self.exported: set[str] | None = None
        self.persisted: dict[str, Source] = {}
        self.runs: list[Node] = []

    # -- documents
    def load(self, text: str) -> Model:
        """Read a document; its last run: is what ``run()`` without text runs."""
        for s in syntax.parse(text):
            self.statement(s)
        return self

    def load_file(self, path: str) -> Model:
        with open(path) as f:
            return self.load(f.read())

    def statement(self, s: Node) -> None:
        if s.kind == "source":
            if s.name in self.sources or s.name in self.queries:
                raise ModelProblem(f"{s.name} is defined twice")
            if s.parameters:
                self.sources[s.name] = (s.parameters, s.body)
            else:
                made = self.source(s.body).copy()
                made.name, made.notes = s.name, s.notes
                self.sources[s.name] = made
                if any("@ persist" in n or "@persist" in n for n in s.notes):
                    self.persisted[s.name] = made
        elif s.kind == "query":
            self.queries[s.name] = s.body
        elif s.kind == "run":
            self.runs.append(s.query)
        elif s.kind == "type":
            self.types[s.name] = s.body
        elif s.kind == "given":
            self.refuse("given:")
            self.givens[s.name] = s
        elif s.kind == "import":
            self.refuse("import")
            self.imported(s)
        elif s.kind == "export":
            self.exported = (self.exported or set()) | set(s.names)

    def refuse(self, what: str) -> None:
        if self.restricted:
            raise ModelProblem(f"{what} is not allowed in a restricted model")

    def imported(self, s: Node) -> None:
        path = os.path.join(self.base, s.url)
        other = Model(self.spark, self.tables, os.path.dirname(path), self.virtual, manifest=self.manifest).load_file(path)
        names = s.picked or {n: n for n in (other.exported if other.exported is not None else [*other.sources, *other.queries])}
        for new, old in names.items():
            if other.exported is not None and old not in other.exported:
                raise ModelProblem(f"{s.url} does not export {old}")
            if old in other.sources:
                self.sources[new] = other.sources[old]
            elif old in other.queries:
                self.sources[new] = other.source(other.queries[old])
            else:
                raise ModelProblem(f"{s.url} has no {old}")

    # -- sources
    def table(self, path: str) -> DataFrame:
        self.refuse("table()") if path not in self.tables else None
        if path in self.tables:
            t = self.tables[path]
            return t() if callable(t) else t if isinstance(t, DataFrame) else self._file(t)
        return self._file(path)

    def _file(self, path: str) -> DataFrame:
        ending = path.rstrip("/*").rsplit(".", 1)[-1].lower()
        if ending == "csv":
            return self.spark.read.csv(path, header=True, inferSchema=True)
        if ending in ("json", "ndjson", "jsonl"):
            return self.spark.read.json(path)
        if ending == "parquet" or "/" in path:
            return self.spark.read.parquet(path)
        return self.spark.table(path)

    def source(self, n: Node) -> Source:
        from quern.plans import planner

        if n.kind == "table":
            return Source.of(n.body, lambda: self.table(n.body), f"table:{n.body}")
        if n.kind == "virtual":
            if n.body not in self.virtual:
                raise ModelProblem(f"virtual source {n.body} is not mapped")
            return Source.of(n.body, lambda: self.table(self.virtual[n.body]), f"virtual:{n.body}")
        if n.kind == "sql":
            self.refuse("sql()")
            pieces = [p if isinstance(p, str) else self.source(p) for p in n.body]
            return Source.of("sql", lambda: self.sql(pieces), "sql:" + "".join(p if isinstance(p, str) else f"%{{{p.digest}}}" for p in pieces))
        if n.kind == "compose":
            parts = [self.source(p) for p in n.parts]
            out = parts[0].copy()
            for p in parts[1:]:
                for k, f in p.fields.items():
                    out.fields.setdefault(k, f)
            out.parts, out.name = parts, "composite"
            out.digest = "compose:" + ",".join(p.digest for p in parts)
            return out
        if n.kind == "name":
            return self.named(n)
        if n.kind == "extend":
            return self.extended(self.source(n.source), n.properties)
        if n.kind == "include":
            return include(self.source(n.source), n.items)
        if n.kind == "typed":
            return self.typed(self.source(n.source), n.types)
        if n.kind in ("arrow", "refine"):
            units: dict[str, str] = {}
            plan = planner.Query(self, n)
            out = Source.of("query", lambda: plan.frame(final=False, units=units), f"query:{plan.digest()}")
            for k, u in units.items():
                if k in out.fields:
                    out.fields[k].unit = u
            return out
        raise ModelProblem(f"{n.kind} is not a source")

    def named(self, n: Node) -> Source:
        if n.name in self.sources:
            found = self.sources[n.name]
            if isinstance(found, Source):
                table = self.manifest.get(build_id(found)) if n.name in self.persisted else None
                if table:
                    ready = Source.of(n.name, lambda: self.table(table), found.digest)
                    ready.primary_key = found.primary_key
                    ready.fields = {**ready.fields, **{k: f for k, f in found.fields.items() if f.kind != "column"}}
                    return ready
                return found
            parameters, body = found
            values = {}
            for p in parameters:
                v = n.arguments.get(p.name, p.value)
                if v is None:
                    raise ModelProblem(f"{n.name} needs a value for {p.name}")
                values[p.name] = v
            if extra := set(n.arguments) - set(values):
                raise ModelProblem(f"{n.name} has no parameter {', '.join(extra)}")
            inner = copy.copy(self)
            inner.values = self.values
            bound = substitute(body, values)
            out = self.source(bound).copy()
            out.name = n.name
            out.arguments |= values
            return out
        if n.name in self.queries:
            return self.source(self.queries[n.name])
        raise ModelProblem(f"there is no source {n.name}")

    def sql(self, pieces: list[Any]) -> DataFrame:
        text = ""
        for p in pieces:
            if isinstance(p, Source):
                from quern.plans import planner

                view = f"quern_{hashlib.sha1(p.digest.encode()).hexdigest()[:12]}"
                planner.whole(self, p).createOrReplaceTempView(view)
                p = f"(SELECT * FROM {view})"
            text += p
        for name, t in self.tables.items():
            if name.isidentifier() and name in text:
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def typed(self, s: Source, names: list[str]) -> Source:
        wanted: dict[str, str] = {}
        for n in names:
            if n not in self.types:
                raise ModelProblem(f"there is no type {n}")
            wanted |= self.types[n]
        missing = set(wanted) - set(s.fields)
        if missing:
            raise ModelProblem(f"{s.name} lacks {', '.join(sorted(missing))} of {' and '.join(names)}")
        out = s.copy()
        out.fields = {k: f for k, f in s.fields.items() if k in wanted or f.kind != "column"}
        return out

    def extended(self, s: Source, properties: list[Node]) -> Source:
        out = s.copy()
        for p in properties:
            access = p.get("access")
            if p.kind in ("dimension", "measure", "declare"):
                if p.name in out.fields and not out.parts:
                    raise ModelProblem(f"{p.name} is defined twice in {out.name}")
                kind = p.kind
                if kind == "declare":
                    kind = "measure" if is_aggregate(p.expr, out) else "dimension"
                if kind == "dimension" and is_aggregate(p.expr, out):
                    raise ModelProblem(f"dimension {p.name} is an aggregate")
                out.fields[p.name] = Field(kind, expr=p.expr, access=access, notes=p.get("notes", []), grouped_by=p.expr.get("grouped_by", []) if p.expr.kind == "props" else [])
            elif p.kind == "view":
                out.fields[p.name] = Field("view", expr=p.body, access=access, notes=p.get("notes", []))
            elif p.kind == "join":
                many = p.many.removeprefix("join_")
                target = self.source(p.body)
                if p.key is not None and not target.primary_key:
                    raise ModelProblem(f"join {p.name} with a key needs a primary key")
                if many != "cross" and p.on is None and p.key is None:
                    raise ModelProblem(f"join {p.name} needs on or with")
                out.fields[p.name] = Field("join", join=JoinDef(target, many, p.how, p.on, p.key), access=access)
            elif p.kind == "primary_key":
                out.primary_key = p.name
            elif p.kind == "rename":
                out.fields[p.new] = renamed(out.fields.pop(p.old), p.old)
            elif p.kind in ("accept", "except"):
                out.fields = {k: f for k, f in out.fields.items() if (k in p.names) == (p.kind == "accept") or f.kind != "column"}
            elif p.kind == "where":
                out.where.append(p.expr)
            elif p.kind == "timezone":
                out.zone = p.zone
            elif p.kind == "access":
                for k in p.names:
                    out.fields[k] = copy.copy(out.fields[k])
                    out.fields[k].access = p.access
        out.changes.append(properties)
        out.digest = f"{s.digest}+{hashlib.sha1(repr(properties).encode()).hexdigest()[:12]}"
        return out

    # -- queries
    def query(self, text: str | None = None, givens: dict[str, Any] | None = None):
        """The query of a text (its last run:), of a name, or of the last run: read."""
        from quern.plans import planner

        if text is None:
            node = self.runs[-1]
        elif text in self.queries:
            node = self.queries[text]
        else:
            inner = copy.copy(self)
            inner.sources, inner.queries, inner.givens, inner.types, inner.runs = dict(self.sources), dict(self.queries), dict(self.givens), dict(self.types), []
            if any(t.kind == "note" and t.text.startswith("##!") for t in syntax.tokenize(text)):
                self.refuse("##!")
            for s in syntax.parse(text):
                inner.statement(s)
            if not inner.runs:
                raise ModelProblem("the text runs nothing")
            inner.values = {**self.values, **(givens or {})}
            return planner.Query(inner, inner.runs[-1])
        inner = copy.copy(self)
        inner.values = {**self.values, **(givens or {})}
        return planner.Query(inner, node)

    def run(self, text: str | None = None, givens: dict[str, Any] | None = None, default_limit: int | None = None) -> DataFrame:
        """The query's DataFrame; ``default_limit`` holds if its last stage has no lower one."""
        out = self.query(text, givens).frame()
        return out if default_limit is None else out.limit(default_limit)

    def search(self, source: str, text: str, limit: int = 1000, field_name: str | None = None) -> DataFrame:
        from quern.plans import planner

        return planner.search(self, self.named(Node("name", 0, {"name": source, "arguments": {}})), text, limit, field_name)

    # -- persistence
    def build_plan(self) -> list[tuple[str, str]]:
        """(source, build id) of persistent sources, dependencies first."""
        order: list[str] = []

        def visit(name: str) -> None:
            for other in self.persisted:
                if other != name and other not in order and self.persisted[other].digest in self.persisted[name].digest:
                    visit(other)
            if name not in order:
                order.append(name)

        for name in self.persisted:
            visit(name)
        return [(n, build_id(self.persisted[n])) for n in order]

    def build(self, folder: str) -> dict[str, str]:
        """Write persistent sources that the manifest lacks; the new manifest."""
        from quern.plans import planner

        for name, key in self.build_plan():
            if key not in self.manifest:
                path = f"{folder.rstrip('/')}/{name}-{key}"
                planner.whole(self, self.persisted[name]).write.mode("overwrite").parquet(path)
                self.manifest[key] = path
        return dict(self.manifest)


def build_id(s: Source) -> str:
    return hashlib.sha256(s.digest.encode()).hexdigest()[:32]


def renamed(f: Field, old: str) -> Field:
    out = copy.copy(f)
    if out.kind == "column":
        out.column = f.column or old
    return out


def include(s: Source, items: list[tuple[str, list[str], str, str]]) -> Source:
    """Access per field; fields that are not named stay unless * is missing."""
    out = s.copy()
    star = [a for a, path, new, _ in items if new == "*" and not path]
    named = {old: (a, new) for a, path, new, old in items if not path and new != "*"}
    fields: dict[str, Field] = {}
    for k, f in s.fields.items():
        access, new = named.get(k, (star[0] if star else ("except" if any(a != "except" for a, _ in named.values()) and f.kind == "column" else None), k))
        if access == "except":
            continue
        f = renamed(f, k)
        f.access = access if access in ("private", "internal") else f.access
        fields[new] = f
    out.fields = fields
    for access, path, new, old in items:
        if path and path[0] in out.fields and out.fields[path[0]].kind == "join":
            f = copy.copy(out.fields[path[0]])
            f.join = copy.copy(f.join)
            f.join.source = include(f.join.source, [(access, path[1:], new, old), ("public", [], "*", "*")])
            out.fields[path[0]] = f
    return out


def nodes(n: Any) -> Iterator[Node]:
    """All nodes of a tree, outermost first."""
    if isinstance(n, Node):
        yield n
        for v in n.f.values():
            yield from nodes(v)
    elif isinstance(n, (list, tuple)):
        for v in n:
            yield from nodes(v)
    elif isinstance(n, dict):
        for v in n.values():
            yield from nodes(v)


def substitute(n: Any, values: dict[str, Node]) -> Any:
    """The tree with parameters replaced by their values."""
    if isinstance(n, Node):
        if n.kind == "path" and len(n.path) == 1 and n.path[0] in values:
            return Node("parens", n.at, {"expr": values[n.path[0]]})
        return Node(n.kind, n.at, {k: substitute(v, values) for k, v in n.f.items()})
    if isinstance(n, list):
        return [substitute(x, values) for x in n]
    if isinstance(n, tuple):
        return tuple(substitute(x, values) for x in n)
    if isinstance(n, dict):
        return {k: substitute(v, values) for k, v in n.items()}
    return n


def is_aggregate(n: Any, s: Source | None) -> bool:
    from quern.functions.library import AGGREGATE

    for x in nodes(n):
        if x.kind == "ungroup":
            return True
        if x.kind == "call" and (x.name in syntax.AGGREGATES or x.name.lower() in AGGREGATE):
            return True
        if x.kind == "path" and s is not None:
            f = find(s, x.path)
            if f is not None and f.kind == "measure":
                return True
    return False


def find(s: Source, path: list[str]) -> Field | None:
    for i, name in enumerate(path):
        f = s.fields.get(name)
        if f is None or i == len(path) - 1:
            return f
        if f.kind != "join":
            return None
        s = f.join.source
    return None
