"""Compact filter expressions for strings, numbers, booleans and times.

``condition(kind, text, column)`` gives the predicate of ``column ~ f'text'``.
An empty text is always true, ``none`` always false.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import temporal

WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
_UNIT = r"(second|minute|hour|day|week|month|quarter|year)s?"


class FilterProblem(ValueError):
    """The text is not a filter of its kind."""


def condition(kind: str, text: str, c: Column, zone: str | None = None, now: Column | None = None) -> Column:
    body = text.strip()
    if not body:
        return F.lit(True)
    if body.lower() == "none":
        return F.lit(False)
    if kind == "string":
        return strings(body, c)
    if kind == "number":
        return Numbers(body, c).parse()
    if kind == "boolean":
        return booleans(body, c)
    return Times(body, c, kind, zone, now).parse()


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


# --- strings -----------------------------------------------------------------


def _split(text: str, marks: str) -> list[str]:
    """Parts between unescaped marks outside parentheses, escapes kept."""
    out, depth, held, i = [], 0, "", 0
    while i < len(text):
        ch = text[i]
        if ch == "\\" and i + 1 < len(text):
            held += text[i : i + 2]
            i += 2
            continue
        depth += (ch == "(") - (ch == ")")
        if ch in marks and depth == 0:
            out.append(held)
            held = ""
        else:
            held += ch
        i += 1
    return [*out, held]


def strings(text: str, c: Column) -> Column:
    for mark, join in ((";", all_of), ("|", any_of)):
        parts = _split(text, mark)
        if len(parts) > 1:
            return join([strings(p.strip(), c) for p in parts if p.strip()])
    if text.startswith("(") and text.endswith(")"):
        return strings(text[1:-1].strip(), c)
    if text.startswith("-(") and text.endswith(")"):
        return ~F.coalesce(strings(text[2:-1].strip(), c), F.lit(False))
    include, exclude, null, empty = [], [], set(), set()
    for raw in _split(text, ","):
        item = raw.strip()
        if not item:
            continue
        negative = item.startswith("-")
        item = item[1:].strip() if negative else item
        word = item.lower()
        if word in ("null", "empty"):
            (null if word == "null" else empty).add(negative)
        else:
            (exclude if negative else include).append(item)
    if len(null) == 2 or len(empty) == 2:
        return F.lit(False)
    ored = [_match(x, c) for x in _grouped(include)]
    ored += [c.isNull()] if False in null else []
    ored += [F.coalesce(c, F.lit("")) == ""] if False in empty else []
    anded = [any_of(ored)] if ored else []
    anded += [c.isNull() | ~_match(x, c) for x in _grouped(exclude)]
    if not ored:
        anded += [c.isNotNull()] if True in null else []
        anded += [c.isNotNull() & (c != "")] if True in empty else []
    return all_of(anded) if anded else F.lit(True)


def _grouped(items: list[str]) -> list[str | list[str]]:
    """Plain values together, so that they become one IN."""
    plain = [_plain(x) for x in items if not _wild(x)]
    return [*([plain] if plain else []), *(x for x in items if _wild(x))]


def _wild(item: str) -> bool:
    return bool(re.search(r"(?<!\\)(?:\\\\)*[%_]", item))


def _plain(item: str) -> str:
    return re.sub(r"\\(.)", r"\1", item)


def _match(item: str | list[str], c: Column) -> Column:
    if isinstance(item, list):
        return c == item[0] if len(item) == 1 else c.isin(item)
    bare = item.strip("%") if not item.endswith("\\%") else None
    if bare is not None and bare and not _wild(bare):
        value = _plain(bare)
        if item.startswith("%") and item.endswith("%"):
            return c.contains(value)
        return c.endswith(value) if item.startswith("%") else c.startswith(value)
    like = re.sub(r"\\([^%_\\])", r"\1", item)
    return c.like(like)


# --- booleans ----------------------------------------------------------------


def booleans(text: str, c: Column) -> Column:
    word = re.sub(r"\s+", " ", text.lower())
    if word.startswith("not "):
        return ~F.coalesce(booleans(word[4:], c), F.lit(False))
    table = {"true": F.coalesce(c, F.lit(False)), "false": ~F.coalesce(c, F.lit(False)), "=true": c, "=false": ~c, "null": c.isNull()}
    if word.replace("= ", "=") not in table:
        raise FilterProblem(f"boolean filter {text!r}")
    return table[word.replace("= ", "=")]


# --- numbers and times share and, or, not and parentheses -------------------


class Logic:
    """Recursive descent over words; leaves are up to the kind."""

    words: re.Pattern

    def __init__(self, text: str, c: Column):
        self.text, self.c = text, c
        self.w = [m.group().lower() for m in self.words.finditer(text)]
        self.i = 0

    @property
    def t(self) -> str:
        return self.w[self.i] if self.i < len(self.w) else ""

    def take(self, *options: str) -> str:
        if self.t in options and self.t:
            self.i += 1
            return self.w[self.i - 1]
        return ""

    def problem(self) -> FilterProblem:
        return FilterProblem(f"filter {self.text!r} at {self.t or 'its end'!r}")

    def parse(self) -> Column:
        out = self.either()
        if self.t:
            raise self.problem()
        return out

    def either(self) -> Column:
        parts = [self.every()]
        while self.take("or", "|"):
            parts.append(self.every())
        return any_of(parts)

    def every(self) -> Column:
        parts = [self.leaf()]
        while self.take("and", ";"):
            parts.append(self.leaf())
        return all_of(parts)

    def leaf(self) -> Column:
        negated = bool(self.take("not"))
        if self.t == "(" and self.grouped():
            self.i += 1
            out = self.either()
            if not self.take(")"):
                raise self.problem()
            return ~F.coalesce(out, F.lit(False)) if negated else out
        return self.clause(negated)

    def grouped(self) -> bool:
        return True

    def clause(self, negated: bool) -> Column:
        raise NotImplementedError


class Numbers(Logic):
    words = re.compile(r"<=|>=|!=|[<>=()\[\],;|]|-?\d*\.?\d+(?:e[+-]?\d+)?|[a-zA-Z]+", re.I)

    def grouped(self) -> bool:
        """( opens a range if 'to' follows its number."""
        return not (self.i + 2 < len(self.w) and self.w[self.i + 2] == "to")

    def number(self) -> float | int:
        try:
            out = float(self.t)
        except ValueError:
            raise self.problem() from None
        self.i += 1
        return int(out) if out.is_integer() else out

    def clause(self, negated: bool) -> Column:
        c = self.c
        if self.take("null"):
            return c.isNotNull() if negated else c.isNull()
        if self.t in ("[", "("):
            low = self.take("[", "(")
            a = self.number()
            if not self.take("to"):
                raise self.problem()
            b = self.number()
            high = self.take("]", ")")
            inside = ((c >= a) if low == "[" else (c > a)) & ((c <= b) if high == "]" else (c < b))
            return ~inside if negated else inside
        op = self.take("<=", ">=", "<", ">")
        if op:
            n = self.number()
            out = {"<=": c <= n, ">=": c >= n, "<": c < n, ">": c > n}[op]
            return ~out if negated else out
        unequal = bool(self.take("!="))
        if not unequal:
            self.take("=")
        values, null = [], False
        while True:
            if self.take("null"):
                null = True
            else:
                values.append(self.number())
            if not self.take(","):
                break
        out = c.isin(values) if values else F.lit(False)
        if unequal != negated:
            out = (c.isNull() | ~out) if values else F.lit(True)
            return (out & c.isNotNull()) if null else out
        return (out | c.isNull()) if null else out


class Times(Logic):
    words = re.compile(r"\d{4}-q[1-4]|\d{4}-\d\d-\d\d-wk|\d{4}-\d\d-\d\d[ t]\d\d(?::\d\d(?::\d\d(?:\.\d+)?)?)?|\d{4}-\d\d-\d\d|\d{4}-\d\d|\d{4}|\d+|[a-z]+|[();|]", re.I)

    def __init__(self, text: str, c: Column, kind: str, zone: str | None, now: Column | None):
        super().__init__(text, c)
        self.kind, self.zone = kind, zone
        self.now = F.current_timestamp().cast("timestamp_ntz") if now is None else now

    def bound(self, x: Column) -> Column:
        return x.cast("date") if self.kind == "date" else x.cast("timestamp_ntz")

    def floor(self, unit: str) -> Column:
        return temporal.truncate(self.now, "timestamp", unit, self.zone)

    def move(self, x: Column, n: int, unit: str) -> Column:
        return temporal.offset(x, "timestamp", F.lit(n), unit, self.zone)

    def unit(self) -> str:
        m = re.fullmatch(_UNIT, self.t)
        if not m:
            raise self.problem()
        self.i += 1
        return m[1]

    def is_unit(self, word: str) -> bool:
        return bool(re.fullmatch(_UNIT, word))

    def after(self, k: int = 1) -> str:
        return self.w[self.i + k] if self.i + k < len(self.w) else ""

    def moment(self) -> tuple[Column, Column]:
        """(begin, end) of a moment; equal for an instant."""
        t = self.t
        if self.take("now"):
            return self.now, self.now
        if t in ("today", "yesterday", "tomorrow"):
            self.i += 1
            day = self.move(self.floor("day"), {"today": 0, "yesterday": -1, "tomorrow": 1}[t], "day")
            return day, self.move(day, 1, "day")
        if t in ("this", "last", "next") and self.is_unit(self.after()):
            self.i += 1
            unit = self.unit()
            begin = self.move(self.floor(unit), {"this": 0, "last": -1, "next": 1}[t], unit)
            return begin, self.move(begin, 1, unit)
        way = self.take("last", "next")
        if self.t in WEEKDAYS:
            wanted = WEEKDAYS.index(self.t)
            self.i += 1
            day = self.floor("day")
            today = F.dayofweek(temporal.to_zone(day, self.zone)) - 1
            step = (F.lit(wanted) - today + 6) % 7 + 1 if way == "next" else -((today - wanted + 6) % 7 + 1)
            begin = temporal.offset(day, "timestamp", step, "day", self.zone)
            return begin, self.move(begin, 1, "day")
        if way:
            self.i -= 1
            raise self.problem()
        if re.fullmatch(r"\d+", t) and self.is_unit(self.after()):
            n = int(t)
            self.i += 1
            unit = self.unit()
            if self.take("ago"):
                n = -n
            elif self.t == "from" and self.after() == "now":
                self.i += 2
            else:
                raise self.problem()
            begin = self.move(self.floor(unit), n, unit)
            return begin, self.move(begin, 1, unit)
        if re.match(r"\d{4}", t):
            self.i += 1
            begin, _, _, end = temporal.literal(t.upper().replace("T", " "), self.zone)
            return begin, end
        raise self.problem()

    def inside(self, a: Column, b: Column, negated: bool) -> Column:
        c, a, b = self.c, self.bound(a), self.bound(b)
        return (c < a) | (c >= b) if negated else (c >= a) & (c < b)

    def clause(self, negated: bool) -> Column:
        c = self.c
        if self.take("null"):
            return c.isNotNull() if negated else c.isNull()
        word = self.take("before", "after", "starting", "through")
        if word:
            begin, end = self.moment()
            out = {"before": c < self.bound(begin), "starting": c >= self.bound(begin), "after": c >= self.bound(end), "through": c < self.bound(end)}[word]
            return ~out if negated else out
        if self.t in ("last", "next") and re.fullmatch(r"\d+", self.after()):
            way = self.take("last", "next")
            n = int(self.t)
            self.i += 1
            unit = self.unit()
            now = self.floor(unit)
            if way == "last":
                return self.inside(self.move(now, -n, unit), now, negated)
            return self.inside(self.move(now, 1, unit), self.move(now, n + 1, unit), negated)
        if re.fullmatch(r"\d+", self.t) and self.is_unit(self.after()) and self.after(2) not in ("ago", "from"):
            n = int(self.t)
            self.i += 1
            unit = self.unit()
            now = self.floor(unit)
            return self.inside(self.move(now, 1 - n, unit), self.move(now, 1, unit), negated)
        instant = self.t == "now"
        begin, end = self.moment()
        if self.take("to"):
            return self.inside(begin, self.moment()[0], negated)
        if self.take("for"):
            n = int(self.t)
            self.i += 1
            return self.inside(begin, self.move(begin.cast("timestamp_ntz"), n, self.unit()), negated)
        if instant or end is begin:
            same = c == self.bound(begin)
            return c.isNull() | ~same if negated else same
        return self.inside(begin, end, negated)


KINDS: dict[str, Callable] = {"string": strings, "boolean": booleans}
