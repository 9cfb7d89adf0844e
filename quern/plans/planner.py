"""Stages as DataFrames: joined frame, grains, nests, windows, limits.

A reduce stage is a tree of levels: the stage and the nests in it. All
expressions of the tree are compiled first, which settles the joins; then the
joined frame is built once and each level is one grain of it:

* the level's aggregates, grouped by the dimensions of all levels above and
  its own. Aggregates of rows that the joins repeat are computed in two steps,
  first by key and then over keys, so they are exact and spill as any other;
* ungrouped aggregates, by fewer dimensions, joined back null-safely;
* having, windows, order and limit, the latter inside each parent group;
* nests, folded to arrays of records and joined to the level.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import library
from quern.lang.syntax import Node
from quern.plans.compiler import Compiler, E, Frame, Ledger, Spec, kind_of, quoted
from quern.sources.model import Field, Model, ModelProblem, Source, find, nodes

INDEX_ROWS = 100_000
NODE_ROLES = ("select", "group_by", "aggregate", "calculate", "nest", "index")


# --- from views to stages ----------------------------------------------------


@dataclass
class Stage:
    """Properties of one stage, refinements merged."""

    properties: list[Node] = field(default_factory=list)

    def of(self, *kinds: str) -> list[Node]:
        return [p for p in self.properties if p.kind in kinds]

    @property
    def kind(self) -> str:
        if self.of("index"):
            return "index"
        if self.of("group_by", "aggregate", "nest") or (self.of("calculate") and not self.of("select")):
            return "reduce"
        return "select" if self.of("select") else "partial"


def merged(a: Stage, b: Stage, literal: bool) -> Stage:
    """a refined by b; a literal may override order and limit."""
    if "partial" not in (a.kind, b.kind) and a.kind != b.kind:
        raise ModelProblem(f"a {a.kind} stage is not refined by a {b.kind} stage")
    taken = {name_of(p) for p in a.properties if p.kind in NODE_ROLES and name_of(p)}
    for p in b.properties:
        if p.kind in NODE_ROLES and name_of(p) in taken:
            raise ModelProblem(f"{name_of(p)} is defined twice")
    out = list(a.properties)
    for kind in ("order", "limit"):
        new = b.of(kind)
        if new and literal:
            out = [p for p in out if p.kind != kind] + new
        elif new and not a.of(kind):
            out += new
    return Stage([*out, *(p for p in b.properties if p.kind not in ("order", "limit"))])


def name_of(p: Node) -> str | None:
    return p.get("name")


def stages_of(view: Node, source: Source) -> list[Stage]:
    if view.kind == "stage":
        return [Stage(list(view.properties))]
    if view.kind == "view_name":
        f = find(source, view.path)
        if f is None:
            raise ModelProblem(f"there is no view {'.'.join(view.path)} in {source.name}")
        if f.kind == "view":
            return stages_of(f.expr, source)
        kind = "aggregate" if f.kind == "measure" else "group_by"
        return [Stage([Node(kind, view.at, {"name": view.path[-1], "expr": Node("path", view.at, {"path": view.path})})])]
    if view.kind == "view_refine":
        left, right = stages_of(view.left, source), stages_of(view.right, source)
        if len(right) > 1:
            raise ModelProblem("a refinement has one stage")
        return [*left[:-1], merged(left[-1], right[0], view.right.kind == "stage")]
    if view.kind == "view_arrow":
        return [*stages_of(view.left, source), *([Stage(list(view.right.properties))] if view.right.kind == "stage" else [view.right])]
    raise ModelProblem(f"{view.kind} is not a view")


# --- queries -----------------------------------------------------------------


class Query:
    """A query ready to become a DataFrame."""

    def __init__(self, model: Model, node: Node):
        self.model, self.node = model, node

    def parts(self, n: Node) -> tuple[Source | None, list[Any], Node | None]:
        """(source, stages, raw SQL)."""
        if n.kind == "arrow":
            s, stages, raw = self.parts(n.source)
            if s is None:
                s = self.model.source(n.source)
            if not stages:
                return s, stages_of(n.view, s), None
            view = n.view
            return s, [*stages, *(stages_of(view, s) if view.kind == "stage" else [view])], None
        if n.kind == "refine":
            s, stages, _ = self.parts(n.query)
            if not stages:
                if n.view.kind == "view_name":
                    return s, stages_of(n.view, s), None
                raise ModelProblem("only a query can be refined")
            more = stages_of(n.view, s)
            return s, [*stages[:-1], merged(stages[-1], more[0], n.view.kind == "stage")], None
        if n.kind == "name" and n.name in self.model.queries:
            return self.parts(self.model.queries[n.name])
        if n.kind == "sql":
            return None, [], n
        return self.model.source(n), [], None

    def digest(self) -> str:
        s, stages, _ = self.parts(self.node)
        return hashlib.sha1(f"{s.digest if s else ''}:{stages!r}:{self.node!r}".encode()).hexdigest() + (f"({s.digest})" if s else "")

    def frame(self, final: bool = True, units: dict[str, str] | None = None) -> DataFrame:
        s, stages, raw = self.parts(self.node)
        if raw is not None:
            self.model.refuse("sql()")
            return self.model.source(raw).frame()
        if not stages:
            raise ModelProblem("a query needs a stage")
        df = None
        for i, stage in enumerate(stages):
            if isinstance(stage, Node):
                more = stages_of(stage, s)
                if len(more) != 1:
                    raise ModelProblem("a view of several stages cannot follow a stage")
                stage = more[0]
            last = i == len(stages) - 1
            found: dict[str, str] = {}
            df = run_stage(self.model, s, stage, final and last, found)
            if last:
                if units is not None:
                    units |= found
                return df
            s = Source.of(f"stage {i + 1}", df, f"{s.digest}>{i}", found)
        return df


def whole(model: Model, s: Source) -> DataFrame:
    """All atomic fields of a source, as select: * does."""
    names = atomic(s)
    stage = Stage([Node("select", 0, {"name": k, "expr": Node("path", 0, {"path": [k]})}) for k in names])
    return run_stage(model, s, stage, False, {})


def atomic(s: Source) -> list[str]:
    """Scalar fields in the order of select: *."""
    return sorted((k for k, f in s.fields.items() if f.kind in ("column", "dimension") and f.access is None), key=lambda k: (k.casefold(), k))


def choose(model: Model, s: Source, stage: Stage) -> Source:
    """The first part of a composite that has all fields the stage uses."""
    if not s.parts:
        return s
    for part in s.parts:
        inner = part
        for properties in s.changes:
            inner = model.extended(inner, [p for p in properties if all(find(inner, x.path) is not None for x in nodes(p.get("expr")) if x.kind == "path") or p.kind not in ("dimension", "measure")])
        inner = choose(model, inner, stage) if inner.parts else inner
        if usable(inner, stage):
            return inner
    raise ModelProblem(f"no part of {s.name} has all fields of the query")


def usable(s: Source, stage: Stage) -> bool:
    own = {p.name for p in stage.properties if p.get("name")}
    for p in stage.properties:
        exprs = [p.get("expr"), p.get("view")] + ([p.properties] if p.kind == "stage_extend" else [])
        for x in nodes(exprs):
            path = x.path if x.kind == "path" else x.prefix if x.kind == "call" and x.get("prefix") else None
            late = p.kind in ("calculate", "having", "order") and path and path[0] in own
            if path and find(s, path) is None and not late and path[0] != "source":
                return False
            if x.kind == "view_name" and find(s, x.path) is None:
                return False
    return True


def partitioned(s: Source, stage: Stage) -> Node | None:
    """Filter for the first partition that covers the fields used."""
    if s.partition is None:
        return None
    column, parts = s.partition
    used = {x.path[0] for p in stage.properties for x in nodes(p.f) if x.kind == "path"} | {x.path[0] for w in s.where for x in nodes(w) if x.kind == "path"}
    for name, fields in parts.items():
        listed = {f for fs in parts.values() for f in fs}
        if (used & listed) <= set(fields):
            return Node("compare", 0, {"op": "=", "left": Node("path", 0, {"path": [column]}), "right": Node("string", 0, {"value": name})})
    raise ModelProblem(f"no partition of {s.name} has all fields of the query")


def run_stage(model: Model, s: Source, stage: Stage, final: bool, units: dict[str, str]) -> DataFrame:
    if stage.kind == "partial":
        raise ModelProblem("a stage needs select:, group_by:, aggregate:, nest: or index:")
    s = choose(model, s, stage)
    extra = partitioned(s, stage)
    return Planner(model, s, stage, extra).run(final, units)


# --- levels ------------------------------------------------------------------


@dataclass
class Item:
    name: str
    e: E
    id: str


@dataclass
class Level:
    stage: Stage
    ledger: Ledger
    parent: Level | None = None
    dims: list[Item] = field(default_factory=list)
    aggs: list[Item] = field(default_factory=list)
    calcs: list[Item] = field(default_factory=list)
    nests: list[tuple[str, Level, list[Stage]]] = field(default_factory=list)
    rows: list[Item] = field(default_factory=list)  # of a select
    where: list[Column] = field(default_factory=list)
    having: list[Column] = field(default_factory=list)
    order: list[tuple[Column, bool]] = field(default_factory=list)
    asked: bool = False
    limit: int | None = None
    names: list[str] = field(default_factory=list)
    items: dict[str, Item] = field(default_factory=dict)
    required: list[list[list[str]]] = field(default_factory=list)

    def keys(self) -> list[str]:
        return [*(self.parent.keys() if self.parent else []), *(d.id for d in self.dims)]


def ordered(order: list[tuple[Column, bool]]) -> list[Column]:
    return [c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in order]


class Planner:
    def __init__(self, model: Model, source: Source, stage: Stage, extra: Node | None = None, hidden: list[str] | None = None):
        self.model = model
        for p in stage.of("stage_extend"):
            source = model.extended(source, p.properties)
        for p in stage.of("stage_join"):
            source = model.extended(source, [p.join])
        self.source, self.stage, self.hidden = source, stage, hidden or source.hidden
        zones = stage.of("timezone")
        self.zone = zones[-1].zone if zones else source.zone
        self.frame = Frame(source)
        self.counter = [0]
        self.ids = 0
        for p in stage.of("stage_join"):
            Compiler(model, self.frame, None, self.zone).join_path([p.join.name])
        self.extra = extra

    def new_id(self, mark: str) -> str:
        self.ids += 1
        return f"{mark}{self.ids}"

    def compiler(self, ledger: Ledger | None) -> Compiler:
        return Compiler(self.model, self.frame, ledger, self.zone)

    # -- compiling a level
    def level(self, stage: Stage, parent: Level | None) -> Level:
        lv = Level(stage, Ledger(self.counter), parent)
        base = self.compiler(lv.ledger).but(grouped=lv.required.append)
        lv.where = [self.compiler(None).condition(p.expr) for p in stage.of("where")] + [self.drill(p) for p in stage.of("drill")]
        taken: set[str] = set()

        def add(name: str, e: E, mark: str, group: list[Item], reference: Node | None = None) -> None:
            if name in taken:
                path = reference.path if reference is not None and reference.kind == "path" else None
                if not path or len(path) < 2:
                    raise ModelProblem(f"{name} is defined twice")
                name = "_".join(path)
                k = 2
                while name in taken:
                    name, k = f"{'_'.join(path)}_{k}", k + 1
            taken.add(name)
            item = Item(name, e, self.new_id(mark))
            group.append(item)
            lv.names.append(name)
            lv.items[name] = item

        for p in stage.properties:
            if p.kind == "group_by":
                e = base.but(ledger=None).compile(p.expr)
                add(p.name, e, "d", lv.dims, p.expr)
            elif p.kind == "aggregate":
                e = base.compile(p.expr)
                if not e.agg:
                    raise ModelProblem(f"{p.name} is not an aggregate")
                add(p.name, e, "m", lv.aggs, p.expr)
            elif p.kind == "select":
                for name, expr in self.selected(p):
                    e = base.but(ledger=None).compile(expr)
                    add(name, e, "s", lv.rows, expr)
            elif p.kind == "nest":
                inner = stages_of(p.view, self.source)
                child = self.level(inner[0], lv)
                if p.name in taken:
                    raise ModelProblem(f"{p.name} is defined twice")
                taken.add(p.name)
                lv.names.append(p.name)
                lv.nests.append((p.name, child, inner[1:]))
        for needed in lv.required:
            named = {d.name for lvl in self.line(lv) for d in lvl.dims} | {w.expr.left.path[-1] for p in [lv, *([parent] if parent else [])] for w in p.stage.of("where") if w.expr.kind == "compare" and w.expr.op == "=" and w.expr.left.kind == "path"}
            if missing := [".".join(x) for x in needed if x[-1] not in named]:
                raise ModelProblem(f"a measure needs group_by: {', '.join(missing)}")
        outputs = {i.name: E(F.col(i.id), i.e.t, i.e.unit, None, i.e.agg, i.e.dtype) for i in [*lv.dims, *lv.aggs, *lv.rows]}
        self.ordering(lv, outputs)
        lv.having = [self.compiler(lv.ledger).but(outputs=outputs).condition(p.expr) for p in stage.of("having")]
        for p in stage.of("calculate"):
            c = self.compiler(lv.ledger).but(outputs=outputs, window=self.windows(lv))
            add(p.name, c.compile(p.expr), "w", lv.calcs)
            outputs[p.name] = E(F.col(lv.calcs[-1].id), lv.calcs[-1].e.t, window=True)
        limits = stage.of("limit")
        lv.limit = limits[-1].n if limits else None
        return lv

    def line(self, lv: Level) -> list[Level]:
        return [lv, *(self.line(lv.parent) if lv.parent else [])]

    def selected(self, p: Node) -> list[tuple[str, Node]]:
        if p.get("wildcard") is None:
            return [(p.name, p.expr)]
        prefix, s = p.wildcard, self.source
        for name in prefix:
            f = s.fields[name]
            if f.kind != "join":
                if isinstance(f.dtype, T.StructType):
                    return [(k, Node("path", p.at, {"path": [*prefix, k]})) for k in sorted(f.dtype.names)]
                raise ModelProblem(f"{name}.* needs a join")
            s = f.join.source
        return [(k, Node("path", p.at, {"path": [*prefix, k]})) for k in atomic(s) if k not in p.dropped]

    def ordering(self, lv: Level, outputs: dict[str, E]) -> None:
        asked = lv.stage.of("order")
        lv.asked = bool(asked)
        for o in asked:
            if isinstance(o.what, int):
                name = lv.names[o.what - 1]
            elif isinstance(o.what, list):
                name = o.what[-1] if o.what[-1] in outputs else ".".join(o.what)
            else:
                raise ModelProblem("order_by: takes output names and numbers")
            if name not in outputs:
                if lv.stage.kind == "select" and isinstance(o.what, list):
                    e = self.compiler(None).lookup(o.what)
                    lv.order.append((e.c, o.way == "desc"))
                    continue
                raise ModelProblem(f"there is no output {name} to order by")
            e = outputs[name]
            lv.order.append((e.c, o.way == "desc"))
        if not asked and lv.stage.kind == "reduce":
            items = [lv.items[n] for n in lv.names if n in lv.items and n in outputs]
            first = next((i for i in items if i.e.agg or i.e.t in ("date", "timestamp")), None)
            if first is not None:
                lv.order = [(F.col(first.id), True)]
            else:
                plain = next((i for i in items if i.e.t not in ("array", "record")), None)
                lv.order = [(F.col(plain.id), False)] if plain is not None else []

    def windows(self, lv: Level):
        parents = lv.parent.keys() if lv.parent else list(self.hidden)

        def make(base: Column, needs_order: bool, frame, partition, order, arg: E | None, default=None, name=None, step=1) -> E:
            w = Window.partitionBy(*(quoted(k) for k in parents), *partition)
            by = ordered(order or lv.order) if needs_order else []
            w = w.orderBy(*by) if by else w
            if default is not None:
                rows = F.row_number().over(w)
                size = F.count(F.lit(1)).over(Window.partitionBy(*(quoted(k) for k in parents), *partition))
                missing = rows <= step if name == "lag" else rows > size - step
                return E(F.when(missing, default).otherwise(base.over(w)), arg.t if arg else "number", window=True)
            if frame is not None:
                w = w.rowsBetween(*frame)
            return E(base.over(w), arg.t if arg is not None else "number", window=True)

        return make

    def drill(self, p: Node) -> Column:
        """Filters of the view that the path names, and the comparison itself."""
        e = p.expr
        left = e.left if e.kind in ("compare", "apply") else e
        f = self.source.fields.get(left.path[0]) if left.kind == "path" else None
        if f is None or f.kind != "view":
            return self.compiler(None).condition(e)
        stage = stages_of(f.expr, self.source)[0]
        conditions = [self.compiler(None).condition(w.expr) for w in stage.of("where")]
        names = left.path[1:]
        while len(names) > 1:
            nest = next(n for n in stage.of("nest") if n.name == names[0])
            stage = stages_of(nest.view, self.source)[0]
            conditions += [self.compiler(None).condition(w.expr) for w in stage.of("where")]
            names = names[1:]
        item = next((d for d in stage.of("group_by", "select") if d.name == names[0]), None)
        if item is None:
            raise ModelProblem(f"the view has no dimension {names[0]}")
        a = self.compiler(None).compile(item.expr)
        conditions.append(self.compiler(None).compare(a, e.op if e.kind == "compare" else "=", e.right).c)
        return reduce(lambda x, y: x & y, conditions)

    # -- running
    def run(self, final: bool, units: dict[str, str]) -> DataFrame:
        if self.stage.kind == "index":
            return self.index()
        root = self.level(self.stage, None)
        base = [self.compiler(None).condition(w) for w in self.source.where]
        base += [self.compiler(None).condition(self.extra)] if self.extra is not None else []
        self.mark_keys(root)
        df = self.frame.build()
        for c in base:
            df = df.where(c)
        self.root_where = root.where
        out = self.rows(root, df, list(self.hidden)) if self.stage.kind == "select" else self.evaluate(root, df, list(self.hidden))
        for i in [*root.dims, *root.rows]:
            if i.e.unit:
                units[i.name] = i.e.unit
        return self.finish(root, out, final)

    def finish(self, lv: Level, out: DataFrame, final: bool) -> DataFrame:
        kept = [quoted(h) for h in self.hidden]
        if self.hidden:
            return out
        if lv.order and (lv.limit is not None or final) and not (lv.stage.kind == "reduce" and not lv.dims):
            out = out.orderBy(*ordered(lv.order))
        if lv.limit is not None:
            out = out.limit(lv.limit)
        return out.select(*kept, *(quoted(self.column_of(lv, n)).alias(n) for n in lv.names))

    def column_of(self, lv: Level, name: str) -> str:
        return lv.items[name].id if name in lv.items else f"n·{name}"

    def mark_keys(self, lv: Level) -> None:
        """Ask for the keys of nodes whose rows the joins repeat."""
        for ledger in [lv.ledger, *lv.ledger.ungrouped.values()]:
            for s in ledger.specs:
                if s.fn in ("sum", "avg", "count", "general") and not self.frame.plain(s.path):
                    self.frame.key(s.path)
        for _, child, _ in lv.nests:
            self.mark_keys(child)

    def rows(self, lv: Level, df: DataFrame, parents: list[str]) -> DataFrame:
        """A select: one row for each row of the frame."""
        for c in lv.where:
            df = df.where(c)
        df = df.withColumns({i.id: i.e.c for i in lv.rows})
        if lv.calcs:
            df = df.withColumns({i.id: i.e.c for i in lv.calcs[:1]})
            for i in lv.calcs[1:]:
                df = df.withColumn(i.id, i.e.c)
        return df

    def evaluate(self, lv: Level, df: DataFrame, parents: list[str]) -> DataFrame:
        """Rows of a reduce level: parent keys and columns by id."""
        for c in lv.where:
            df = df.where(c)
        if lv.dims:
            df = df.withColumns({d.id: d.e.c for d in lv.dims})
        keys = [*parents, *(d.id for d in lv.dims)]
        out = self.aggregate(df, keys, lv.ledger.specs, lv)
        for (how, fields), ledger in lv.ledger.ungrouped.items():
            fewer, rows = self.reduced(lv, df, parents, how, fields)
            out = same_keys(out, self.aggregate(rows, fewer, ledger.specs), fewer, "left")
        if lv.aggs:
            out = out.withColumns({a.id: a.e.c for a in lv.aggs})
        later = bool(lv.nests) and bool(lv.having)
        if not later:
            for c in lv.having:
                out = out.where(c)
        for w in lv.calcs:
            out = out.withColumn(w.id, w.e.c)
        if later:
            for c in lv.having:
                out = out.where(c)
        if lv.limit is not None and parents:
            rank = F.row_number().over(Window.partitionBy(*map(quoted, parents)).orderBy(*(ordered(lv.order) or [F.lit(1)])))
            out = out.withColumn("__rank", rank).where(F.col("__rank") <= lv.limit).drop("__rank")
        elif lv.limit is not None and lv.nests:
            out = (out.orderBy(*ordered(lv.order)) if lv.order else out).limit(lv.limit)
        for name, child, more in lv.nests:
            out = self.folded(out, df, keys, name, child, more)
        return out

    def reduced(self, lv: Level, df: DataFrame, parents: list[str], how: str, fields: tuple[str, ...]) -> tuple[list[str], DataFrame]:
        """Keys and rows of an ungrouped aggregate.

        all() without fields sees the rows of the level above, the forms with
        fields those of the whole query.
        """
        line = self.line(lv)
        named = {d.name: d.id for x in reversed(line) for d in x.dims}
        if missing := [f for f in fields if f not in named]:
            raise ModelProblem(f"{how}() of {', '.join(missing)}: not in the query's output")
        if how == "all" and not fields:
            return parents, self.upper(lv)
        if how == "all":
            own = {d.name for d in lv.dims}
            return [*parents, *(named[f] for f in fields if f in own)], self.open(lv)
        gone = {named[f] for f in fields}
        return [k for k in [*parents, *(d.id for d in lv.dims)] if k not in gone], self.open(lv)

    def upper(self, lv: Level) -> DataFrame:
        """Rows under the filters of the levels above (of this one at the root)."""
        df = self.base_rows()
        for x in reversed(self.line(lv)[1:] if lv.parent else [lv]):
            for c in x.where:
                df = df.where(c)
        for x in reversed(self.line(lv)):
            if x.dims:
                df = df.withColumns({d.id: d.e.c for d in x.dims})
        return df

    def open(self, lv: Level) -> DataFrame:
        """Rows under the root's filters only, with all dimensions."""
        df = self.base_rows()
        for c in self.root_where:
            df = df.where(c)
        for x in reversed(self.line(lv)):
            if x.dims:
                df = df.withColumns({d.id: d.e.c for d in x.dims})
        return df

    def lean(self, lv: Level, specs: list[Spec]) -> tuple[DataFrame | None, frozenset]:
        """Rows of a level without the branches that some aggregates do not need, and those branches."""
        line = self.line(lv)
        columns = [d.e.c for x in line for d in x.dims] + [c for x in line for c in x.where]
        columns += [self.compiler(None).condition(w) for w in [*self.source.where, *([self.extra] if self.extra is not None else [])]]
        for s in specs:
            columns += [*s.args, *([s.cond] if s.cond is not None else []), *(o for o, _ in s.order)]
        without = self.frame.idle(columns, [s.path for s in specs])
        if not without:
            return None, without
        df = self.base_rows(without)
        if self.extra is not None:
            df = df.where(self.compiler(None).condition(self.extra))
        for x in reversed(line):
            for c in x.where:
                df = df.where(c)
            if x.dims:
                df = df.withColumns({d.id: d.e.c for d in x.dims})
        return df, without

    def base_rows(self, without: frozenset = frozenset()) -> DataFrame:
        df = self.frame.build(without)
        for w in self.source.where:
            df = df.where(self.compiler(None).condition(w))
        return df

    def folded(self, out: DataFrame, df: DataFrame, keys: list[str], name: str, child: Level, more: list[Any]) -> DataFrame:
        """The level with a nest as an array of records, or as one record."""
        if child.stage.kind == "select":
            inner = self.rows(child, df, keys)
        else:
            inner = self.evaluate(child, df, keys)
        names, columns, order, limit = child.names, {n: self.column_of(child, n) for n in child.names}, child.order, child.limit
        single = child.stage.kind == "reduce" and not child.dims
        for stage in more:
            if isinstance(stage, Node):
                stage = stages_of(stage, self.source)[0]
            if limit is not None and child.stage.kind == "select":
                inner = self.topped(inner, keys, order, limit)
            step = inner.select(*map(quoted, keys), *(quoted(columns[n]).alias(n) for n in names))
            s = Source.of(name, step)
            for k in keys:
                s.fields.pop(k, None)
            s.hidden = list(keys)
            inner_plan = Planner(self.model, s, stage, hidden=list(keys))
            inner_plan.ids = self.ids + 1000
            lv = inner_plan.level(stage, None)
            inner_plan.mark_keys(lv)
            built = inner_plan.frame.build()
            inner_plan.root_where = lv.where
            inner = inner_plan.rows(lv, built, keys) if stage.kind == "select" else inner_plan.evaluate(lv, built, keys)
            self.ids = inner_plan.ids
            child, names, order, limit = lv, lv.names, lv.order, lv.limit
            columns = {n: inner_plan.column_of(lv, n) for n in names}
            single = stage.kind == "reduce" and not lv.dims
        record = F.struct(*(quoted(columns[n]).alias(n) for n in names))
        target = f"n·{name}"
        if single:
            folded = inner.select(*map(quoted, keys), record.alias(target))
            return same_keys(out, folded, keys, "left")
        by = ordered(order)
        w = Window.partitionBy(*map(quoted, keys)).orderBy(*(by or [F.lit(1)]))
        ranked = inner.select(*map(quoted, keys), F.row_number().over(w).alias("__at"), record.alias("__row"))
        if limit is not None:
            ranked = ranked.where(F.col("__at") <= limit)
        grouped = ranked.groupBy(*map(quoted, keys)) if keys else ranked.groupBy()
        arrays = grouped.agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__row"))), lambda x: x["__row"]).alias(target))
        joined = same_keys(out, arrays, keys, "left")
        return joined.withColumn(target, F.coalesce(quoted(target), F.array().cast(joined.schema[target].dataType)))

    def topped(self, df: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
        w = Window.partitionBy(*map(quoted, keys)).orderBy(*(ordered(order) or [F.lit(1)]))
        return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= limit).drop("__rank")

    # -- aggregation
    def aggregate(self, df: DataFrame, keys: list[str], specs: list[Spec], lv: Level | None = None) -> DataFrame:
        """One row for each combination of keys, with a column for each spec.

        Aggregates of rows that joins repeat are taken, level by level, from a
        frame without the branches that repeat them, if nothing else needs
        these; so branches side by side are never multiplied. Distinct counts
        beside sketches are taken apart: together, Spark would make and merge
        the sketches of each distinct value.
        """
        plain: list[Column] = []
        apart: list[Column] = []
        by_path: dict[tuple[str, ...], list[Spec]] = {}
        sketched = any(s.build in library.SKETCHES and (s.fn == "free" or self.frame.plain(s.path)) for s in specs)
        for s in specs:
            if s.fn == "count_distinct" and sketched:
                apart.append(self.plain_column(s).alias(s.name))
            elif s.fn in ("min", "max", "count_distinct", "free") or self.frame.plain(s.path):
                plain.append(self.plain_column(s).alias(s.name))
            else:
                by_path.setdefault(s.path, []).append(s)
        columns = list(map(quoted, keys))
        thin = self.lean(lv, [])[0] if lv is not None and by_path else None
        if plain:
            out = df.groupBy(*columns).agg(*plain) if keys else df.agg(*plain)
        elif by_path and not keys:
            out = None
        else:
            out = (df if thin is None else thin).select(*columns).distinct() if keys else df.sparkSession.range(1).select(F.lit(1).alias("__one"))
        for path, group in by_path.items():
            fewer, without = self.lean(lv, group) if lv is not None else (None, frozenset())
            if fewer is not None and self.frame.plain(path, without):
                found = [self.plain_column(s).alias(s.name) for s in group]
                part = fewer.groupBy(*columns).agg(*found) if keys else fewer.agg(*found)
            else:
                part = self.by_key(df if fewer is None else fewer, keys, path, group)
            out = part if out is None else same_keys(out, part, keys, "left")
        if apart:
            out = same_keys(out, df.groupBy(*columns).agg(*apart) if keys else df.agg(*apart), keys, "left")
        return out

    def plain_column(self, s: Spec) -> Column:
        pick = lambda c: F.when(s.cond, c) if s.cond is not None else c
        if s.fn == "count":
            here = self.frame.node(s.path)
            if not s.path:
                return F.count(pick(F.lit(1)))
            key = self.frame.column(s.path, "__pos") if here.kind == "array" else self.frame.present(s.path)
            return F.count(pick(key))
        if s.fn == "count_distinct":
            return F.count_distinct(pick(s.args[0]))
        if s.fn in ("sum", "avg", "min", "max"):
            return getattr(F, s.fn)(pick(s.args[0]))
        return self.general(s, [pick(s.args[0]), *s.args[1:]])

    def general(self, s: Spec, args: list[Column]) -> Column:
        if s.order or s.limit is not None:
            order = s.order or [(args[0], False)]
            ranks = [o for o, _ in order]
            texts = s.build not in (library.AGGREGATE["array_agg"], library.AGGREGATE["array_agg_distinct"])
            rows = F.collect_list(F.when(args[0].isNotNull(), F.struct(*(r.alias(f"o{i}") for i, r in enumerate(ranks)), (args[0].cast("string") if texts else args[0]).alias("v"))))

            def before(a: Column, b: Column) -> Column:
                out = F.lit(0)
                for i in reversed(range(len(order))):
                    x, y = a[f"o{i}"], b[f"o{i}"]
                    less = (x > y) if order[i][1] else (x < y)
                    more = (x < y) if order[i][1] else (x > y)
                    out = F.when(x.isNull() & y.isNotNull(), 1).when(y.isNull() & x.isNotNull(), -1).when(less, -1).when(more, 1).otherwise(out)
                return out

            values = F.transform(F.array_sort(rows, before), lambda r: r["v"])
            values = F.slice(values, 1, s.limit) if s.limit is not None else values
            if not texts:
                return values
            joiner = args[1] if len(args) > 1 else F.lit(",")
            return F.nullif(F.reduce(values, F.lit(None).cast("string"), lambda acc, v: F.when(acc.isNull(), v).otherwise(F.concat(acc, joiner, v))), F.lit(None))
        return s.build(*args)

    def by_key(self, df: DataFrame, keys: list[str], path: tuple[str, ...], specs: list[Spec]) -> DataFrame:
        """Aggregates over rows that joins repeat: first by their key."""
        key = self.frame.key(path)
        held: dict[str, Column] = {}
        outs: list[Column] = []
        for s in specs:
            pick = lambda c, s=s: F.when(s.cond, c) if s.cond is not None else c
            if s.fn == "count":
                held[f"{s.name}·0"] = F.max(pick(F.lit(1)))
                outs.append(F.count(quoted(f"{s.name}·0")).alias(s.name))
                continue
            args = [pick(s.args[0]), *s.args[1:], *(o for o, _ in s.order)]
            literal = [*s.fixed, *([False] * (len(args) - len(s.fixed)))]
            for i, a in enumerate(args):
                if not literal[i]:
                    held[f"{s.name}·{i}"] = F.max(a)
            columns = [a if literal[i] else quoted(f"{s.name}·{i}") for i, a in enumerate(s.args)]
            if s.fn in ("sum", "avg"):
                outs.append(getattr(F, s.fn)(columns[0]).alias(s.name))
            else:
                again = Spec(s.name, s.fn, columns, None, path, s.build, [(quoted(f"{s.name}·{len(s.args) + i}"), d) for i, (_, d) in enumerate(s.order)], s.limit, s.fixed)
                outs.append(self.general(again, columns).alias(s.name))
        first = df.withColumn("__key", key).where(F.col("__key").isNotNull())
        first = first.groupBy(*map(quoted, keys), "__key").agg(*(c.alias(n) for n, c in held.items()))
        return first.groupBy(*map(quoted, keys)).agg(*outs) if keys else first.agg(*outs)

    # -- index
    def index(self) -> DataFrame:
        p = self.stage.of("index")[0]
        paths: list[list[str]] = []
        for item in p.fields:
            if item[-1] == "*":
                s = self.source
                for name in item[:-1]:
                    s = s.fields[name].join.source
                paths += [[*item[:-1], k] for k in atomic(s)]
            else:
                paths.append(item)
        sample = self.stage.of("sample")
        source = self.source
        # sample: true leaves it to the engine whether to sample, and Spark reads all rows.
        v = sample[-1].value if sample and not isinstance(sample[-1].value, bool) else None
        if v is not None:
            load = source.frame
            source = source.copy()
            source.frame = lambda: sampled(load(), v)
        parts = []
        for path in paths:
            # Each field is a query of its own, so joins never multiply rows.
            by = Node("path", 0, {"path": p.by}) if p.by else Node("call", 0, {"name": "count", "prefix": [], "args": [], "raw": None, "type": None})
            plan = Planner(self.model, source, Stage([*self.stage.of("where"), Node("aggregate", 0, {"name": "weight", "expr": by})]))
            e = plan.compiler(None).lookup(path)
            if e.t in ("array", "record"):
                continue
            rows = [*self.stage.of("where")]
            if e.t == "string" or e.t == "boolean":
                text = e.c.cast("string")
                items = [Node("group_by", 0, {"name": "fieldValue", "expr": Node("path", 0, {"path": path})})]
                found = Planner(self.model, source, Stage([*rows, *items, Node("aggregate", 0, {"name": "weight", "expr": by})])).run(False, {})
                text, kind = F.col("fieldValue").cast("string"), "string"
                if e.t == "boolean":
                    text, kind = F.lit(None).cast("string"), "boolean"
                    found = found.groupBy().agg(F.sum("weight").alias("weight"))
            else:
                call = lambda fn: Node("call", 0, {"name": fn, "prefix": [], "args": [Node("path", 0, {"path": path})], "raw": None, "type": None})  # noqa: B023, E731
                found = Planner(self.model, source, Stage([*rows, Node("aggregate", 0, {"name": "lo", "expr": call("min")}), Node("aggregate", 0, {"name": "hi", "expr": call("max")}), Node("aggregate", 0, {"name": "weight", "expr": by})])).run(False, {})
                text, kind = F.concat(F.col("lo").cast("string"), F.lit(" to "), F.col("hi").cast("string")), e.t or "number"
            from urllib.parse import quote

            parts.append(found.select(F.lit(path[-1] if len(path) == 1 else ".".join(path)).alias("fieldName"), F.lit("/".join(quote(x, safe="") for x in path)).alias("fieldPath"), text.alias("fieldValue"), F.lit(kind).alias("fieldType"), F.col("weight").cast("double" if p.by else "bigint").alias("weight")))
        if not parts:
            raise ModelProblem("index: has no field")
        out = reduce(DataFrame.unionByName, parts)
        limits = self.stage.of("limit")
        if limits:
            return out.orderBy(F.col("weight").desc_nulls_last(), "fieldPath", "fieldValue").limit(limits[-1].n)
        return out if v is None else out.limit(INDEX_ROWS)


def sampled(df: DataFrame, how: float | int) -> DataFrame:
    """A share of the rows, or about so many of them taken evenly."""
    if isinstance(how, float):
        return df.sample(how, seed=1)
    there = df.count()
    return df if there <= how else df.sample(how / there, seed=1)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be null."""
    if not keys:
        return left.join(right, F.lit(True), how) if "__one" not in left.columns else right
    names = {k: f"r·{k}" for k in keys}
    right = right.select(*(quoted(k).alias(names[k]) for k in keys), *(quoted(c) for c in right.columns if c not in names))
    on = reduce(lambda a, b: a & b, (quoted(k).eqNullSafe(quoted(n)) for k, n in names.items()))
    return left.join(right, on, how).drop(*names.values())


def search(model: Model, source: Source, text: str, limit: int, field_name: str | None) -> DataFrame:
    """Values of string fields that hold the text, best first."""
    paths = [k for k in atomic(source) if kind_of(source.fields[k].dtype) == "string" or source.fields[k].kind == "dimension"]
    index = Planner(model, source, Stage([Node("index", 0, {"fields": [[k] for k in paths], "by": None})])).run(False, {})
    found = index.where(F.col("fieldType") == "string").where(F.lower("fieldValue").contains(text.lower()))
    if field_name:
        found = found.where(F.col("fieldName") == field_name)
    starts = F.when(F.lower("fieldValue").startswith(text.lower()), 1).otherwise(0)
    return found.orderBy(starts.desc(), F.desc("weight"), "fieldName", "fieldValue").limit(limit)


def column_fields(s: Source) -> dict[str, Field]:
    return {k: f for k, f in s.fields.items() if f.kind == "column"}
