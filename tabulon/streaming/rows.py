"""Iterators and visitors. Rows come in sheet order and stop as soon as the caller stops; the driver holds one partition's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import types as T

from tabulon.functions.cells import to_python
from tabulon.operators.relation import ROW, Sheet, limit_rows


@dataclass(frozen=True)
class VisitSummary:
    sheet: str
    #: All header names, repeated ones too.
    columns: tuple[str, ...]
    visited_rows: int


def value(v):
    """A collected value: cells become Python values."""
    return to_python(v) if isinstance(v, T.Row) and "kind" in v.__fields__ else v


def iterate(sheet: Sheet) -> Iterator[tuple[int, dict]]:
    """(row number, values by column name), in sheet order."""
    names = [(n, sheet.input(n)) for n in sheet.columns]
    ordered = sheet.df.select(ROW, *[c.column.alias(f"v{k}") for k, (_, c) in enumerate(names)]).orderBy(ROW)
    for r in ordered.toLocalIterator():
        yield r[0], {n: value(r[k + 1]) for k, (n, _) in enumerate(names)}


def visit(sheet: Sheet, f: Callable[[int, dict], bool]) -> VisitSummary:
    """Call f with each row until it returns false."""
    n = 0
    for row, values in iterate(sheet):
        n += 1
        if f(row, values) is False:
            break
    return VisitSummary(sheet.name, sheet.names, n)


def preview(sheet: Sheet, limit: int = 100) -> dict:
    """The first rows (0: all), and how many there are."""
    rows = [values for _, values in iterate(limit_rows(sheet, limit))]
    total = sheet.df.count()
    return {"selectedSheet": sheet.name, "columns": sheet.columns, "rows": rows, "totalRows": total, "displayedRows": len(rows), "truncated": len(rows) < total}
