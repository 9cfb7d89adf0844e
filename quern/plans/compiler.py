"""From syntax to Columns.

A ``Compiler`` turns expressions into Columns over a joined frame. Names are
looked up in a scope; looking one up through a join activates the join. An
aggregate is not computed in place: it is noted in a ledger of the level and
stands for the column that the level will make for it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import library, temporal
from quern.lang.syntax import AGGREGATES, UNITS, Node
from quern.operators import filters
from quern.sources.model import JoinDef, ModelProblem, Source


@dataclass
class E:
    """A compiled expression: Column, kind of value, granularity and end of a literal."""

    c: Column
    t: str | None = None
    unit: str | None = None
    end: Column | None = None
    agg: bool = False
    dtype: T.DataType | None = None
    path: tuple[str, ...] = ()
    window: bool = False


def kind_of(d: T.DataType | None) -> str | None:
    if isinstance(d, T.DateType):
        return "date"
    if isinstance(d, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(d, T.StringType):
        return "string"
    if isinstance(d, T.BooleanType):
        return "boolean"
    if isinstance(d, T.NumericType):
        return "number"
    if isinstance(d, T.ArrayType):
        return "array"
    if isinstance(d, T.StructType):
        return "record"
    return None


@dataclass
class Spec:
    """One aggregate of a ledger."""

    name: str
    fn: str
    args: list[Column]
    cond: Column | None
    path: tuple[str, ...]
    build: Callable[..., Column] | None = None
    order: list[tuple[Column, bool]] = field(default_factory=list)
    limit: int | None = None
    fixed: tuple[bool, ...] = ()  # which arguments are literals


@dataclass
class Ledger:
    """Aggregates of one grain, and those of reduced grains inside it."""

    counter: list[int]
    specs: list[Spec] = field(default_factory=list)
    ungrouped: dict[tuple[str, tuple[str, ...]], Ledger] = field(default_factory=dict)

    def note(self, **f: Any) -> str:
        self.counter[0] += 1
        name = f"a{self.counter[0]}"
        self.specs.append(Spec(name=name, **f))
        return name


# --- frames ------------------------------------------------------------------


@dataclass
class JoinNode:
    path: tuple[str, ...]
    id: str
    source: Source | None
    kind: str  # root, one, many, cross or array
    define: JoinDef | None = None
    array: E | None = None
    element: T.DataType | None = None
    on: Column | None = None
    where: list[Column] = field(default_factory=list)
    keyed: bool = False


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Frame:
    """The join tree of one stage; joins come into being when used."""

    def __init__(self, source: Source):
        self.source = source
        self.nodes: dict[tuple[str, ...], JoinNode] = {(): JoinNode((), "j0", source, "root")}

    def node(self, path: tuple[str, ...]) -> JoinNode:
        return self.nodes[path]

    def join(self, parent: tuple[str, ...], name: str, define: JoinDef, compiler: Compiler) -> tuple[str, ...]:
        path = (*parent, name)
        if path not in self.nodes:
            node = JoinNode(path, f"j{len(self.nodes)}", define.source, define.many, define)
            self.nodes[path] = node
            inner = compiler.at(parent)
            if define.key is not None:
                key = compiler.at(path).lookup([define.source.primary_key])
                node.on = key.c == inner.compile(define.key).c
            elif define.on is not None:
                node.on = inner.compile(define.on).c
            node.where = [compiler.at(path).compile(w).c for w in define.source.where]
            # Joins that the condition needs have to come first.
            del self.nodes[path]
            self.nodes[path] = node
        return path

    def unnest(self, parent: tuple[str, ...], name: str, array: E, element: T.DataType) -> tuple[str, ...]:
        path = (*parent, name)
        if path not in self.nodes:
            self.nodes[path] = JoinNode(path, f"j{len(self.nodes)}", None, "array", array=array, element=element)
        return path

    def column(self, path: tuple[str, ...], name: str) -> Column:
        return quoted(f"{self.nodes[path].id}·{name}")

    def present(self, path: tuple[str, ...]) -> Column:
        return self.column(path, "__m") if path else F.lit(True)

    def key(self, path: tuple[str, ...]) -> Column:
        """What tells rows of a node apart; null where the node has no row."""
        node = self.nodes[path]
        node.keyed = True
        if node.kind == "array":
            pos = self.column(path, "__pos")
            return F.when(pos.isNotNull(), F.struct(self.key(path[:-1]).alias("p"), pos.alias("i")))
        return self.column(path, "__key")

    def plain(self, path: tuple[str, ...], without: frozenset = frozenset()) -> bool:
        """Whether each row of the node occurs once in the joined frame (without some nodes)."""
        active = [n for n in self.nodes.values() if n.path and n.path not in without]
        if any(n.kind == "cross" or (n.define is not None and n.define.how in ("right", "full")) for n in active):
            return False
        many = [n.path for n in active if n.kind in ("many", "array")]
        if any(m != path[: len(m)] for m in many):
            return False
        return all(self.nodes[path[: i + 1]].kind in ("many", "array") for i in range(len(path)))

    def idle(self, columns: list[Column], paths: list[tuple[str, ...]]) -> frozenset:
        """Nodes of left joins that repeat rows and that nothing in some columns and paths needs.

        Without them the frame has the same rows, not repeated.
        """
        ids = {n.id: n.path for n in self.nodes.values()}
        of = lambda c: {ids[i] for i in re.findall(r"\bj\d+(?=·)", str(c)) if i in ids}
        needed, fresh = set(), {(), *paths}.union(*(of(c) for c in columns))
        while fresh:
            path = fresh.pop()
            if path in needed:
                continue
            needed.add(path)
            n = self.nodes[path]
            own = [*([n.on] if n.on is not None else []), *n.where, *([n.array.c] if n.array is not None else [])]
            fresh |= {path[:i] for i in range(len(path))}.union(*(of(c) for c in own))
        out: set[tuple[str, ...]] = set()
        for n in self.nodes.values():
            if n.kind in ("many", "array"):
                tree = [m for m in self.nodes.values() if m.path[: len(n.path)] == n.path]
                if all(m.path not in needed and m.kind in ("one", "many", "array") and (m.define is None or m.define.how == "left") for m in tree):
                    out |= {m.path for m in tree}
        # What another node's condition refers to has to stay.
        for n in self.nodes.values():
            if n.path and n.path not in out:
                own = [*([n.on] if n.on is not None else []), *n.where]
                if out & set().union(*(of(c) for c in own)):
                    return frozenset()
        return frozenset(out)

    def build(self, without: frozenset = frozenset()):
        """The joined DataFrame; columns are named <node>·<field>."""
        root = self.nodes[()]
        df = self.side(root, self.source.hidden)
        arrays = [n for n in self.nodes.values() if n.kind == "array" and all(self.nodes[n.path[:i]].kind == "array" for i in range(1, len(n.path)))]
        later = [n for n in self.nodes.values() if n.path and n not in arrays]
        for n in [*arrays, *later]:
            if n.path in without:
                continue
            if n.kind == "array":
                df = df.select("*", F.posexplode_outer(n.array.c).alias(f"{n.id}·__pos", f"{n.id}·value"))
                continue
            right = self.side(n, []).withColumn(f"{n.id}·__m", F.lit(True))
            on = n.on if n.on is not None else F.lit(True)
            for w in n.where:
                on = on & w
            df = df.join(right, on, n.define.how)
        return df

    def side(self, n: JoinNode, hidden: list[str]):
        df = n.source.frame()
        names = {f.column or k for k, f in n.source.fields.items() if f.kind == "column"} | ({n.source.primary_key} & set(df.columns) if n.source.primary_key else set())
        columns = [quoted(c).alias(f"{n.id}·{c}") for c in df.columns if c in names or c not in n.source.fields]
        if n.keyed:
            pk = n.source.primary_key
            field_ = n.source.fields.get(pk) if pk else None
            key = quoted(field_.column or pk) if field_ is not None and field_.kind == "column" else F.monotonically_increasing_id()
            columns.append(key.alias(f"{n.id}·__key"))
        return df.select(*columns, *(quoted(h) for h in hidden))


# --- expressions -------------------------------------------------------------


class Compiler:
    def __init__(self, model, frame: Frame, ledger: Ledger | None, zone: str | None = None):
        self.model, self.frame, self.ledger, self.zone = model, frame, ledger, zone
        self.path: tuple[str, ...] = ()
        self.conds: list[Column] = []
        self.outputs: dict[str, E] | None = None  # of the level, for order and having
        self.window: Callable[..., Any] | None = None
        self.subject: E | None = None  # of a partial comparison
        self.grouped: Callable[[list[list[str]]], None] | None = None

    def but(self, **f: Any) -> Compiler:
        out = object.__new__(Compiler)
        out.__dict__.update(self.__dict__)
        out.__dict__.update(f)
        return out

    def at(self, path: tuple[str, ...]) -> Compiler:
        return self.but(path=path, outputs=None, subject=None, conds=self.conds)

    # -- names
    def lookup(self, names: list[str]) -> E:
        if self.outputs is not None and len(names) == 1 and names[0] in self.outputs:
            return self.outputs[names[0]]
        if names[0] == "source" and len(names) > 1:
            return self.at(()).lookup(names[1:])
        node = self.frame.node(self.path)
        if node.source is None:
            return self.element(node, names)
        f = node.source.fields.get(names[0])
        if f is None:
            raise ModelProblem(f"there is no field {'.'.join(names)} in {node.source.name}")
        if f.access == "private" and self.path:
            raise ModelProblem(f"{names[0]} is private in {node.source.name}")
        rest = names[1:]
        if f.kind == "join":
            path = self.frame.join(self.path, names[0], f.join, self)
            if not rest:
                raise ModelProblem(f"{names[0]} is a join, not a value")
            return self.at(path).lookup(rest)
        if f.kind == "column":
            e = E(self.frame.column(self.path, f.column or names[0]), kind_of(f.dtype), f.unit, None, False, f.dtype, self.path)
        elif f.kind == "view":
            raise ModelProblem(f"{names[0]} is a view, not a value")
        else:
            if f.grouped_by and self.grouped:
                self.grouped(f.grouped_by)
            e = self.but(outputs=None, window=None if f.kind == "dimension" else self.window).compile(f.expr)
        return self.inside(e, names[0], rest) if rest else e

    def inside(self, e: E, name: str, rest: list[str]) -> E:
        """A field of a record, or of the elements of an array."""
        d = e.dtype
        if isinstance(d, T.ArrayType) or e.t == "array":
            element = d.elementType if isinstance(d, T.ArrayType) else None
            path = self.frame.unnest(self.path, name, e, element)
            return self.at(path).lookup(rest)
        inner = d[rest[0]].dataType if isinstance(d, T.StructType) and rest[0] in d.names else None
        out = E(e.c.getField(rest[0]), kind_of(inner), dtype=inner, path=self.path)
        return self.but(path=self.path).inside(out, f"{name}.{rest[0]}", rest[1:]) if len(rest) > 1 else out

    def element(self, node: JoinNode, names: list[str]) -> E:
        value = self.frame.column(node.path, "value")
        d = node.element
        if isinstance(d, T.StructType) or (d is None and names[0] not in ("value", "each")):
            inner = d[names[0]].dataType if isinstance(d, T.StructType) and names[0] in d.names else None
            if isinstance(d, T.StructType) and names[0] not in d.names:
                raise ModelProblem(f"there is no field {names[0]}")
            e = E(value.getField(names[0]), kind_of(inner), dtype=inner, path=node.path)
        elif names[0] in ("value", "each"):
            e = E(value, kind_of(d), dtype=d, path=node.path)
        else:
            raise ModelProblem(f"there is no field {names[0]}")
        return self.inside(e, names[0], names[1:]) if len(names) > 1 else e

    def join_path(self, names: list[str]) -> tuple[str, ...] | None:
        """The node that a path of joins names, if it names one."""
        path = self.path
        for i, name in enumerate(names):
            if name == "source" and i == 0:
                path = ()
                continue
            node = self.frame.node(path)
            f = node.source.fields.get(name) if node.source is not None else None
            if f is not None and f.kind == "join":
                path = self.frame.join(path, name, f.join, self)
            elif f is not None and f.kind in ("column", "dimension") and (isinstance(f.dtype, T.ArrayType) or f.kind == "dimension"):
                e = self.at(path).lookup([name])
                if e.t != "array" or e.agg:
                    return None
                path = self.frame.unnest(path, name, e, e.dtype.elementType if isinstance(e.dtype, T.ArrayType) else None)
            elif node.kind == "array" and isinstance(node.element, T.StructType) and name in node.element.names and isinstance(node.element[name].dataType, T.ArrayType):
                e = self.at(path).lookup([name])
                path = self.frame.unnest(path, name, e, e.dtype.elementType)
            else:
                return None
        return path

    # -- expressions by kind
    def compile(self, n: Node) -> E:
        return getattr(self, "on_" + n.kind)(n)

    def condition(self, n: Node) -> Column:
        return self.compile(n).c

    def on_path(self, n: Node) -> E:
        return self.lookup(n.path)

    def on_parens(self, n: Node) -> E:
        return self.compile(n.expr)

    def on_number(self, n: Node) -> E:
        text = n.text
        return E(F.lit(float(text) if any(x in text for x in ".eE") else int(text)), "number")

    def on_string(self, n: Node) -> E:
        return E(F.lit(n.value), "string")

    def on_boolean(self, n: Node) -> E:
        return E(F.lit(n.value), "boolean")

    def on_null(self, n: Node) -> E:
        return E(F.lit(None), "null")

    def on_now(self, n: Node) -> E:
        return E(F.current_timestamp().cast("timestamp_ntz"), "timestamp")

    def on_time(self, n: Node) -> E:
        begin, kind, unit, end = temporal.literal(n.text, self.zone)
        return E(begin, kind, unit, end)

    def on_array(self, n: Node) -> E:
        values = [self.compile(v) for v in n.values]
        d = values[0].dtype if values else None
        return E(F.array(*(v.c for v in values)), "array", agg=any(v.agg for v in values), dtype=T.ArrayType(d) if d is not None else None, path=self.path)

    def on_record(self, n: Node) -> E:
        values = [(k, self.compile(v)) for k, v in n.fields]
        d = T.StructType([T.StructField(k, v.dtype or {"string": T.StringType(), "boolean": T.BooleanType(), "number": T.DoubleType()}.get(v.t, T.StringType())) for k, v in values])
        return E(F.struct(*(v.c.alias(k) for k, v in values)), "record", agg=any(v.agg for _, v in values), dtype=d, path=self.path)

    def on_given_ref(self, n: Node) -> E:
        if n.name in self.model.values:
            v = self.model.values[n.name]
            if isinstance(v, (list, tuple)):
                return E(F.array(*map(F.lit, v)), "array")
            c = F.lit(v)
            return E(c, "date" if temporal.is_date(v) else "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else "string")
        g = self.model.givens.get(n.name)
        if g is None or g.value is None:
            raise ModelProblem(f"given {n.name} has no value")
        return self.compile(g.value)

    def on_member(self, n: Node) -> E:
        return self.inside(self.compile(n.expr), "value", [n.name])

    def on_minus(self, n: Node) -> E:
        e = self.compile(n.expr)
        return E(-e.c, "number", agg=e.agg, window=e.window)

    def both(self, n: Node) -> tuple[E, E, dict[str, bool]]:
        a, b = self.compile(n.left), self.compile(n.right)
        return a, b, {"agg": a.agg or b.agg, "window": a.window or b.window}

    def on_math(self, n: Node) -> E:
        if n.right.kind == "duration" and n.op in "+-":
            a = self.compile(n.left)
            k = self.compile(n.right.n)
            return self.moved(a, k.c if n.op == "+" else -k.c, n.right.unit)
        a, b, flags = self.both(n)
        if n.op in "+-" and a.t in ("date", "timestamp") and b.t not in ("date", "timestamp"):
            unit = a.unit or "day"
            return self.moved(a, b.c if n.op == "+" else -b.c, unit)
        if n.op == "/":
            return E(F.try_divide(a.c.cast("double"), b.c.cast("double")), "number", **flags)
        if n.op == "%":
            return E(F.try_mod(a.c, b.c), "number", **flags)
        return E({"+": a.c + b.c, "-": a.c - b.c, "*": a.c * b.c}[n.op], "number", **flags)

    def moved(self, a: E, n: Column, unit: str) -> E:
        kind = a.t or "timestamp"
        if kind == "date" and unit in temporal.SECONDS:
            kind = "timestamp"
        return E(temporal.offset(a.c, a.t or "timestamp", n, unit, self.zone), kind, a.unit, agg=a.agg, window=a.window)

    def on_duration(self, n: Node) -> E:
        raise ModelProblem("a duration stands only beside + or - or in a range")

    def on_trunc(self, n: Node) -> E:
        e = self.compile(n.expr)
        kind = e.t if e.t in ("date", "timestamp") else "timestamp"
        begin = temporal.truncate(e.c, kind, n.unit, self.zone)
        return E(begin, kind, n.unit, temporal.offset(begin, kind, F.lit(1), n.unit, self.zone), e.agg)

    def on_cast(self, n: Node) -> E:
        e = self.compile(n.expr)
        name = n.type
        spark = {"string": "string", "number": "double", "integer": "bigint", "bigint": "bigint", "float": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "json": "string"}.get(name) or (name[4:] if name.startswith("sql:") else name)
        c = e.c
        if self.zone and name == "date" and e.t == "timestamp":
            c = temporal.to_zone(c, self.zone)
        out = c.try_cast(spark) if n.safe else c.cast(spark)
        if self.zone and name == "timestamp" and e.t == "date":
            out = temporal.from_zone(out, self.zone)
        return E(out, {"integer": "number", "bigint": "number", "float": "number", "timestamptz": "timestamp"}.get(name, name), agg=e.agg, window=e.window)

    def on_coalesce(self, n: Node) -> E:
        a, b, flags = self.both(n)
        return E(F.coalesce(a.c, b.c), a.t if a.t != "null" else b.t, **flags)

    def on_not(self, n: Node) -> E:
        e = self.compile(n.expr)
        return E(F.coalesce(~e.c, F.lit(True)), "boolean", agg=e.agg, window=e.window)

    def on_and(self, n: Node) -> E:
        a, b, flags = self.both(n)
        return E(a.c & b.c, "boolean", **flags)

    def on_or(self, n: Node) -> E:
        a, b, flags = self.both(n)
        return E(a.c | b.c, "boolean", **flags)

    def on_is_null(self, n: Node) -> E:
        e = self.compile(n.expr)
        return E(e.c.isNotNull() if n.negated else e.c.isNull(), "boolean", agg=e.agg, window=e.window)

    def on_in(self, n: Node) -> E:
        e = self.compile(n.expr)
        if isinstance(n.values, Node):
            values = self.model.values.get(n.values.name)
            if values is None:
                g = self.model.givens.get(n.values.name)
                values = [self.compile(v).c for v in g.value.values] if g is not None and g.value is not None else []
            if not values:
                return E(F.lit(n.negated), "boolean")
            out = e.c.isin(list(values))
        else:
            out = e.c.isin([self.compile(v).c for v in n.values])
        return E(~out if n.negated else out, "boolean", agg=e.agg, window=e.window)

    # -- comparison; the right side may be a tree of alternatives
    def on_compare(self, n: Node) -> E:
        return self.compare(self.compile(n.left), n.op, n.right)

    def on_apply(self, n: Node) -> E:
        left = self.compile(n.left)
        if n.right.kind in ("pick", "case"):
            return self.but(subject=left).compile(n.right)
        return self.compare(left, "=", n.right)

    def on_partial(self, n: Node) -> E:
        if self.subject is None:
            raise ModelProblem(f"{n.op} needs something on its left")
        return self.compare(self.subject, n.op, n.right)

    def on_partial_null(self, n: Node) -> E:
        if self.subject is None:
            raise ModelProblem("is null needs something on its left")
        return E(self.subject.c.isNotNull() if n.negated else self.subject.c.isNull(), "boolean", agg=self.subject.agg)

    def on_alt(self, n: Node) -> E:
        return self.compare(self.required(), "=", n)

    on_both = on_alt

    def on_range(self, n: Node) -> E:
        return self.compare(self.required(), "=", n)

    on_for_range = on_range

    def required(self) -> E:
        if self.subject is None:
            raise ModelProblem("an alternative or range needs something to compare with")
        return self.subject

    def compare(self, a: E, op: str, n: Node) -> E:
        while n.kind == "parens" and n.expr.kind in ("alt", "both", "range", "for_range", "partial", "partial_null", "parens"):
            n = n.expr
        if n.kind == "partial":
            return self.compare(a, n.op, n.right)
        if n.kind == "partial_null":
            return self.but(subject=a).compile(n)
        if n.kind in ("alt", "both"):
            leaves = self.leaves(n, n.kind)
            if n.kind == "alt" and op in ("=", "!=") and all(x.kind in ("string", "number") for x in leaves):
                values = [self.compile(x).c for x in leaves]
                return E(a.c.isin(values) if op == "=" else ~a.c.isin(values), "boolean", agg=a.agg, window=a.window)
            either = (n.kind == "alt") == (op not in ("!=", "!~"))
            parts = [self.compare(a, op, x).c for x in leaves]
            return E(filters.any_of(parts) if either else filters.all_of(parts), "boolean", agg=a.agg, window=a.window)
        if n.kind == "range":
            return self.in_range(a, op, self.aligned(a, self.compile(n.left)), self.aligned(a, self.compile(n.right)))
        if n.kind == "for_range":
            begin = self.compile(n.left)
            k = self.compile(n.n)
            return self.in_range(a, op, self.aligned(a, begin), self.aligned(a, self.moved(begin, k.c, n.unit)))
        if op in ("~", "!~"):
            return self.match(a, op, n)
        b = self.compile(n)
        flags = {"agg": a.agg or b.agg, "window": a.window or b.window}
        if b.t == "null":
            return E(a.c.isNotNull() if op == "!=" else a.c.isNull(), "boolean", **flags)
        if b.end is not None and a.t in ("date", "timestamp", None) and not (a.unit == b.unit and a.unit is not None) and not (a.t == "date" and b.t == "date" and b.unit == "day"):
            return self.in_range(a, op, self.aligned(a, b), self.aligned(a, E(b.end, b.t, None)))
        right = self.aligned(a, b) if a.t in ("date", "timestamp") and b.t in ("date", "timestamp") else b.c
        left = a.c.cast("timestamp_ntz") if a.t == "date" and b.t == "timestamp" else a.c
        out = {"=": left == right, "!=": F.coalesce(left != right, F.lit(True)), "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op]
        return E(out, "boolean", **flags)

    def aligned(self, a: E, b: E) -> Column:
        """b as a value that a compares with: dates against timestamps are
        midnights in the query's zone."""
        if a.t == "timestamp" and b.t == "date":
            return temporal.from_zone(b.c.cast("timestamp_ntz"), self.zone)
        if a.t == "date" and b.t == "timestamp":
            return b.c
        return b.c

    def in_range(self, a: E, op: str, low: Column, high: Column) -> E:
        c = a.c
        out = {"=": (c >= low) & (c < high), "!=": (c < low) | (c >= high), ">": c >= high, ">=": c >= low, "<": c < low, "<=": c < high}.get(op)
        if out is None:
            raise ModelProblem(f"{op} does not work with a range")
        return E(out, "boolean", agg=a.agg, window=a.window)

    def leaves(self, n: Node, kind: str) -> list[Node]:
        if n.kind == kind:
            return [*self.leaves(n.left, kind), *self.leaves(n.right, kind)]
        return [n]

    def match(self, a: E, op: str, n: Node) -> E:
        flags = {"agg": a.agg, "window": a.window}
        if n.kind == "parens":
            n = n.expr
        if n.kind == "filter":
            kind = a.t if a.t in ("string", "number", "boolean", "date", "timestamp") else "string"
            out = filters.condition(kind, n.value, a.c, self.zone)
            return E(~F.coalesce(out, F.lit(False)) if op == "!~" else out, "boolean", **flags)
        if n.kind == "regex":
            out = F.rlike(a.c, F.lit(n.value))
        else:
            b = self.compile(n)
            out = F.like(a.c, b.c)
        return E(F.coalesce(~out, F.lit(True)) if op == "!~" else out, "boolean", **flags)

    # -- choices
    def on_pick(self, n: Node) -> E:
        out, kind, agg, window = None, None, False, False
        for value, when in n.options:
            test = self.compile(when) if self.subject is None else self.compare(self.subject, "=", when)
            v = self.but(subject=None).compile(value) if value is not None else self.required()
            kind = kind or (v.t if v.t != "null" else None)
            agg, window = agg or v.agg or test.agg, window or v.window or test.window
            out = F.when(test.c, v.c) if out is None else out.when(test.c, v.c)
        if n.default is not None:
            d = self.but(subject=None).compile(n.default)
            agg, window, kind = agg or d.agg, window or d.window, kind or d.t
            out = out.otherwise(d.c)
        elif self.subject is not None:
            out = out.otherwise(self.subject.c)
        else:
            raise ModelProblem("pick needs an else")
        return E(out, kind, agg=agg, window=window)

    def on_case(self, n: Node) -> E:
        subject = self.compile(n.subject) if n.subject is not None else None
        out, kind, agg = None, None, False
        for when, then in n.options:
            test = self.compile(when) if subject is None else self.compare(subject, "=", when)
            v = self.compile(then)
            kind, agg = kind or v.t, agg or v.agg or test.agg
            out = F.when(test.c, v.c) if out is None else out.when(test.c, v.c)
        if n.default is not None:
            d = self.compile(n.default)
            out, agg = out.otherwise(d.c), agg or d.agg
        return E(out, kind, agg=agg)

    # -- aggregates
    def on_ungroup(self, n: Node) -> E:
        if self.ledger is None:
            raise ModelProblem(f"{n.how}() stands only in a query")
        key = (n.how, tuple(x[-1] for x in n.fields))
        inner = self.ledger.ungrouped.setdefault(key, Ledger(self.ledger.counter))
        if inner is self.ledger:
            raise ModelProblem("all() and exclude() do not nest")
        e = self.but(ledger=inner, outputs=None).compile(n.expr)
        if not e.agg:
            raise ModelProblem(f"{n.how}() needs an aggregate")
        return e

    def on_props(self, n: Node) -> E:
        me = self
        if n.where:
            me = self.but(conds=[*self.conds, *(self.but(outputs=None).condition(w) for w in n.where)], outputs=None)
        base = n.expr
        while base.kind == "parens":
            base = base.expr
        if base.kind == "call" and (n.order_by or n.limit is not None or n.partition_by):
            return me.call(base, n)
        return me.compile(base)

    def cond(self) -> Column | None:
        return filters.all_of(self.conds) if self.conds else None

    def aggregate(self, fn: str, args: list[Column], path: tuple[str, ...], build=None, order=(), limit=None, t: str | None = "number", dtype=None, fixed=()) -> E:
        if self.ledger is None:
            raise ModelProblem(f"{fn} stands only in a query")
        name = self.ledger.note(fn=fn, args=args, cond=self.cond(), path=path, build=build, order=list(order), limit=limit, fixed=tuple(fixed))
        c = F.col(name)
        return E(F.coalesce(c, F.lit(0)) if fn in ("sum", "count", "count_distinct") else c, t, agg=True, dtype=dtype)

    def on_call(self, n: Node) -> E:
        return self.call(n, None)

    def call(self, n: Node, props: Node | None) -> E:
        name = n.name.lower()
        if n.raw:
            self.model.refuse(f"{n.name}!()")
            args = [self.compile(a) for a in n.args]
            return E(F.call_function(n.name, *(a.c for a in args)), n.type, agg=any(a.agg for a in args))
        if name in AGGREGATES:
            return self.basic(name, n)
        if name in library.AGGREGATE:
            return self.general(name, n, props)
        if name in library.WINDOW or name in library.MOVING:
            return self.windowed(name, n, props)
        if name.startswith("sql_") and name[4:] in ("number", "string", "boolean", "date", "timestamp"):
            return self.raw_sql(name[4:], n)
        if n.prefix:
            raise ModelProblem(f"{name} is not an aggregate")
        plain = name[:-1] if name.endswith("s") and name[:-1] in UNITS else name
        if plain in UNITS or name in ("day_of_week", "day_of_year", "days_of_week"):
            return self.time_part(plain, n)
        if name == "replace" and len(n.args) > 1 and n.args[1].kind == "regex":
            name = "replace_regex"
        if name not in library.SCALAR:
            raise ModelProblem(f"there is no function {n.name}")
        args = [E(F.lit(a.value), "string") if a.kind == "regex" else self.compile(a) for a in n.args]
        if name == "array_join" and len(args) == 3:
            c = F.array_join(args[0].c, n.args[1].value, n.args[2].value)
        elif name in ("array_join", "date_format") and len(args) == 2 and n.args[1].kind == "string":
            c = F.array_join(args[0].c, n.args[1].value) if name == "array_join" else F.call_function("date_format", args[0].c, F.lit(library.java_pattern(n.args[1].value)))
        elif name == "date_parse" and n.args[1].kind == "string":
            c = F.to_timestamp(args[0].c, library.java_pattern(n.args[1].value)).cast("timestamp_ntz")
        elif name == "round" and len(args) == 2:
            digits = n.args[1]
            c = F.round(args[0].c, -int(digits.expr.text) if digits.kind == "minus" else int(digits.text)) if digits.kind in ("number", "minus") else F.round(args[0].c, args[1].c)
        else:
            c = library.SCALAR[name](*(a.c for a in args))
        t = args[0].t if name in library.SAME and args else library.RETURNS.get(name)
        if t is None and args and args[0].t == "array":
            t = "array" if name.startswith(("array_", "slice", "flatten", "shuffle")) and name not in ("array_max", "array_min", "array_sum", "array_average", "array_join", "array_position", "array_has_duplicates") else None
        return E(c, t, agg=any(a.agg for a in args), window=any(a.window for a in args), dtype=args[0].dtype if t == "array" and args else None)

    def basic(self, name: str, n: Node) -> E:
        if name == "count":
            if n.args:
                e = self.compile(n.args[0])
                return self.aggregate("count_distinct", [e.c], self.path)
            path = self.join_path(n.prefix) if n.prefix else self.path
            if path is None:
                e = self.lookup(n.prefix)
                return self.aggregate("count_distinct", [e.c], self.path)
            return self.aggregate("count", [], path)
        t = "number"
        if n.args:
            path = self.join_path(n.prefix) if n.prefix else None
            e = self.compile(n.args[0])
            grain = path if path is not None else self.path
        else:
            if not n.prefix:
                raise ModelProblem(f"{name} needs an argument")
            if self.join_path(n.prefix) is not None and self.frame.nodes.get((*self.path, *n.prefix), JoinNode((), "", None, "")).kind == "array":
                path = (*self.path, *n.prefix)
                e = self.at(path).lookup(["value"])
                grain = path
            else:
                e = self.lookup(n.prefix)
                grain = self.join_path(n.prefix[:-1]) if len(n.prefix) > 1 else self.path
                grain = grain if grain is not None else self.path
        if e.agg:
            raise ModelProblem(f"{name} of an aggregate")
        if name in ("min", "max"):
            t = e.t
        return self.aggregate(name, [e.c], grain, t=t)

    def general(self, name: str, n: Node, props: Node | None) -> E:
        args = [self.compile(a) for a in n.args]
        fixed = [a.kind in ("string", "number", "minus") for a in n.args]
        path = self.path
        if n.prefix:
            found = self.join_path(n.prefix)
            if found is None:
                args, fixed = [self.lookup(n.prefix), *args], [False, *fixed]
                found = self.join_path(n.prefix[:-1]) if len(n.prefix) > 1 else self.path
            path = found if found is not None else self.path
        order, limit = [], None
        if props is not None:
            for o in props.order_by:
                order.append((self.compile(o.what).c if o.what is not None else args[0].c, o.way == "desc"))
            limit = props.limit
        symmetric = name in ("count_approx", "bool_and", "bool_or", "bitwise_and_agg", "bitwise_or_agg", "string_agg_distinct", "array_agg_distinct", "set_agg", "max_by", "min_by", "arbitrary", "any_value")
        return self.aggregate("free" if symmetric else "general", [a.c for a in args], path, library.AGGREGATE[name], order, limit, t=args[0].t if name in ("arbitrary", "any_value", "max_by", "min_by") and args else "array" if "array" in name or name.startswith("set_") else None, fixed=fixed)

    def windowed(self, name: str, n: Node, props: Node | None) -> E:
        if self.window is None:
            raise ModelProblem(f"{name} stands only in calculate:")
        literal = [a for a in n.args]
        args = [self.compile(a) for a in literal]
        if n.prefix:
            args = [self.lookup(n.prefix), *args]
        partition = [self.lookup([p[-1]]).c for p in (props.partition_by if props is not None else [])]
        order = [(self.compile(o.what).c if o.what is not None else args[0].c, o.way == "desc") for o in (props.order_by if props is not None else [])]
        number = lambda a: int(a.text)
        if name in library.MOVING:
            frame = (-number(literal[1 if not n.prefix else 0]), number(literal[-1]) if len(args) > 2 else 0)
            base = library.MOVING[name](args[0].c)
            return self.window(base, True, frame, partition, order, args[0])
        build, ordered, frame = library.WINDOW[name]
        values: list[Any] = [args[0].c] if args else []
        if len(args) > 1:
            values.append(number(literal[1 if not n.prefix else 0]))
        if len(args) > 2:
            return self.window(build(*values), ordered, frame, partition, order, args[0], args[2].c, name, values[1])
        return self.window(build(*values), ordered, frame, partition, order, args[0] if args else None)

    def raw_sql(self, kind: str, n: Node) -> E:
        self.model.refuse("sql functions")
        text = n.args[0].value
        node = self.frame.node(self.path)

        def put(m) -> str:
            inner = m[1].strip()
            if inner == "TABLE":
                return node.id
            names = inner.split(".")
            self.lookup(names)
            path = self.join_path(names[:-1]) if len(names) > 1 else self.path
            f = self.frame.node(path).source.fields[names[-1]]
            return f"`{self.frame.node(path).id}·{f.column or names[-1]}`"

        return E(F.expr(re.sub(r"\$\{([^}]*)\}", put, text)), kind)

    def time_part(self, name: str, n: Node) -> E:
        a = n.args[0]
        unit = UNITS.get(name, name)
        if a.kind == "range":
            low, high = self.compile(a.left), self.compile(a.right)
            if unit in (*temporal.MONTHS, "week") and (low.t, high.t) != ("date", "date") and "timestamp" in (low.t, high.t):
                raise ModelProblem(f"{name}() measures between dates only")
            return E(temporal.difference(low.c, high.c, unit), "number", agg=low.agg or high.agg)
        e = self.compile(a)
        if n.name.lower() in UNITS and n.name.lower() == unit and len(n.args) == 1 and unit != n.name.lower():
            raise ModelProblem(n.name)
        return E(temporal.extract(e.c, unit, self.zone, e.t or "timestamp"), "number", agg=e.agg)

    def on_filter(self, n: Node) -> E:
        raise ModelProblem("a filter stands only beside ~")

    on_regex = on_filter
