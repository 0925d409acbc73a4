"""A1 references: Python for options and files, Column expressions for data."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.errors import RangeError, CellReferenceError

MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384

_A1 = re.compile(r"\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})")


def letters(n: int) -> str:
    """Column number (1 is A) to letters."""
    out = ""
    while n > 0:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def number(text: str) -> int | None:
    """Letters to column number; None beyond the last column or for anything else."""
    if not re.fullmatch("[A-Za-z]{1,3}", text):
        return None
    n = 0
    for c in text.upper():
        n = 26 * n + ord(c) - 64
    return n if n <= MAX_COLUMNS else None


@dataclass(frozen=True, order=True)
class CellReference:
    """1-based row and column."""

    row: int
    column: int

    def __post_init__(self):
        if not (1 <= self.row <= MAX_ROWS and 1 <= self.column <= MAX_COLUMNS):
            raise CellReferenceError(f"cell ({self.row}, {self.column}) is outside a sheet")

    @classmethod
    def parse(cls, text: str) -> CellReference:
        m = _A1.fullmatch(text.strip())
        column = number(m[1]) if m else None
        if not m or column is None or int(m[2]) > MAX_ROWS:
            raise CellReferenceError(f"invalid cell reference: {text!r}")
        return cls(int(m[2]), column)

    def __str__(self) -> str:
        return f"{letters(self.column)}{self.row}"


@dataclass(frozen=True)
class CellRange:
    """Both corners, or neither for an empty sheet."""

    start: CellReference | None = None
    end: CellReference | None = None

    def __post_init__(self):
        if self.start and self.end and (self.end.row < self.start.row or self.end.column < self.start.column):
            raise RangeError(f"range {self.start}:{self.end} ends before it starts")

    @property
    def row_count(self) -> int:
        return self.end.row - self.start.row + 1 if self.start and self.end else 0

    @property
    def column_count(self) -> int:
        return self.end.column - self.start.column + 1 if self.start and self.end else 0


def column_letters(n: Column) -> Column:
    """Letters of a column number from 1 to 16,384."""
    one = lambda x: F.char(F.lit(65) + x)
    tail = one((n - 1) % 26)
    two = F.concat(one(F.floor((n - 27) / 26) % 26), tail)
    three = F.concat(one(F.floor((n - 703) / 676)), two)
    return F.when(n <= 26, tail).when(n <= 702, two).otherwise(three)


def column_number(text: Column) -> Column:
    """Number of letters; null beyond the last column or for anything else."""
    up = F.upper(text)
    digit = lambda k: F.ascii(F.substring(up, k, 1)) - 64
    n = F.when(F.length(up) == 1, digit(1)).when(F.length(up) == 2, digit(1) * 26 + digit(2)).otherwise(digit(1) * 676 + digit(2) * 26 + digit(3))
    return F.when(up.rlike("^[A-Z]{1,3}$") & (n <= MAX_COLUMNS), n)


def address(column: Column, row: Column) -> Column:
    return F.concat(column_letters(column), row.cast("string"))
