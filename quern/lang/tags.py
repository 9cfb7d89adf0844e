"""Tags in annotations: ``# bar_chart size=large { color=red } -hidden list=[a, b]``."""

from __future__ import annotations

import re
from typing import Any

_WORD = re.compile(r"""\s*(?:(-)?([\w.]+|`[^`]*`)|("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|([={}\[\],]))""")


def tags(notes: list[str]) -> dict[str, Any]:
    """Properties of a field's or source's annotations, later ones winning."""
    out: dict[str, Any] = {}
    for note in notes:
        body = re.sub(r"^#+\S*", "", note) if re.match(r"^#+[^\s#]", note) else note.lstrip("#")
        _merge(out, _Reader(body).properties(""))
    return out


def _merge(into: dict[str, Any], new: dict[str, Any]) -> None:
    for k, v in new.items():
        if v is None:
            into.pop(k, None)
        elif isinstance(v, dict) and isinstance(into.get(k), dict):
            _merge(into[k], v)
        else:
            into[k] = v


class _Reader:
    def __init__(self, text: str):
        self.tokens = [m.groups() for m in _WORD.finditer(text)]
        self.i = 0

    def sign(self) -> str | None:
        return self.tokens[self.i][3] if self.i < len(self.tokens) else ""

    def properties(self, end: str) -> dict[str, Any]:
        out: dict[str, Any] = {}
        while self.i < len(self.tokens) and self.sign() != (end or "none"):
            gone, word, quoted, sign = self.tokens[self.i]
            self.i += 1
            if word is None:
                continue
            *path, last = word.strip("`").split(".") if not word.startswith("`") else [word.strip("`")]
            where = out
            for p in path:
                where = where.setdefault(p, {})
            if gone:
                where[last] = None
                continue
            where[last] = True
            if self.sign() == "=":
                self.i += 1
                where[last] = self.value()
            if self.i < len(self.tokens) and self.sign() == "{":
                self.i += 1
                inner = self.properties("}")
                self.i += 1
                where[last] = inner if where[last] is True else {"": where[last], **inner}
        return out

    def value(self) -> Any:
        _, word, quoted, sign = self.tokens[self.i]
        self.i += 1
        if sign == "[":
            out = []
            while self.i < len(self.tokens) and self.sign() != "]":
                if self.sign() == ",":
                    self.i += 1
                    continue
                out.append(self.value())
            self.i += 1
            return out
        if sign == "{":
            self.i -= 1
            return True
        if quoted is not None:
            return re.sub(r"\\(.)", r"\1", quoted[1:-1])
        return word
