"""Notebooks: cells that begin with ``>>>markdown``, ``>>>model`` or ``>>>sql``.

A model cell is read into the model and, if it runs something, run; in a SQL
cell ``%{ }`` holds queries of the model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quern.lang.syntax import Node, Parser
from quern.sources.model import Model


@dataclass
class Cell:
    kind: str
    text: str


def cells(text: str) -> list[Cell]:
    found = re.split(r"^>>>\s*(\w+)[^\n]*\n", text, flags=re.M)
    return [Cell(k.lower(), body.strip("\n")) for k, body in zip(found[1::2], found[2::2], strict=True)]


def run(model: Model, text: str) -> Iterator[tuple[Cell, DataFrame | None]]:
    """Each cell with the result it gives, in order."""
    for cell in cells(text):
        if cell.kind == "markdown":
            yield cell, None
        elif cell.kind == "sql":
            pieces = Parser('"""' + cell.text + '"""').sql_text()
            yield cell, model.source(Node("sql", 0, {"connection": "t", "body": pieces})).frame()
        else:
            before = len(model.runs)
            model.load(cell.text)
            yield cell, model.run() if len(model.runs) > before else None
