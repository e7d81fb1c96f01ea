"""Table functions for SQL: what the column functions make of markup, as functions after ``lateral``."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_ROW, _CELL = re.compile(r"<tr.*?</tr>", re.I | re.S), re.compile(r"<t[dh].*?</t[dh]>", re.I | re.S)
_TAG, _SPAN = re.compile(r"<[^>]*>?"), {k: re.compile(rf"[<\s\"']{k}[ =\"']*([0-9]+)", re.A) for k in ("colspan", "rowspan")}


def _span(head: str, name: str) -> int:
    found = _SPAN[name].search(head)
    return max(1, min(512, int(found[1]))) if found else 1


@udtf(returnType="row_ int, col int, text string, colspan int, rowspan int")
class TableCells:
    """A row for each cell of a table's markup, counted from 1; none for null."""

    def eval(self, html: str):
        for r, row in enumerate(_ROW.findall(html or "")):
            for c, cell in enumerate(_CELL.findall(row)):
                head = cell.split(">", 1)[0]
                yield r + 1, c + 1, _TAG.sub("", cell).replace(">", ""), _span(head, "colspan"), _span(head, "rowspan")


@udtf(returnType="row_ int, col int, kind string, text string")
class TokenCells:
    """A row for each cell token of a table in structure tokens (fcel, ecel, lcel, ucel, xcel, ched, rhed, srow), counted from 1; nl ends a row."""

    def eval(self, tokens: str):
        row, col = 1, 0
        for kind, text in re.findall(r"<(nl|[a-z]{4})>([^<]*)", tokens or ""):
            if kind == "nl":
                row, col = row + 1, 0
                continue
            col += 1
            yield row, col, kind, text


FUNCTIONS = {"table_cells": TableCells, "token_cells": TokenCells}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
