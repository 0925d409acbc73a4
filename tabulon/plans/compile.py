"""Filters and aggregates as Column expressions.

Filters are two-valued and fail at the first offending cell in sheet order, where ``and`` and
``or`` decide what is looked at. Spark promises no order of evaluation, so every node becomes a
pair of total expressions: its value, never null, and its error, null if there is none. Where the
column's type rules an error out, the error is absent. Beside them goes a plain form for selecting
rows, where null counts as false: bare comparisons under ``and`` and ``or``, which Catalyst pushes
into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.cells import FIELDS, micros_of_duration, micros_of_time, native_kind
from tabulon.plans.model import Filter, Literal

NUMBERS = ("int", "float")


@dataclass(frozen=True)
class Input:
    """A column of a sheet: its name there, its expression and its type."""

    name: str
    column: Column
    type: T.DataType
    #: Whether a float column may hold NaN; false where the source rules it out.
    nan: bool = True

    @property
    def kind(self) -> str | None:
        return native_kind(self.type)

    def kinds(self) -> tuple[str, ...]:
        return (self.kind,) if self.kind else tuple(FIELDS)

    def has(self, kind: str) -> Column:
        """Whether the value is of that kind."""
        return self.column.isNotNull() if self.kind else F.coalesce(self.column["kind"] == kind, F.lit(False))

    def get(self, kind: str) -> Column:
        if not self.kind:
            return self.column[FIELDS[kind]]
        return micros_of_time(self.column) if kind == "time" else micros_of_duration(self.column) if kind == "duration" else self.column

    def number(self) -> Column:
        """Any number as a double."""
        return self.column.cast("double") if self.kind else F.when(self.column["kind"] == "int", self.column["i"].cast("double")).otherwise(self.column["f"])


@dataclass(frozen=True)
class Term:
    value: Column
    error: Column | None = None
    #: True where the value is, otherwise false or null.
    plain: Column | None = None

    @property
    def rows(self) -> Column:
        """What to select rows by."""
        return self.value if self.plain is None else self.plain


def fail(column: str, message: str | Column) -> Column:
    return F.struct(F.lit(column).alias("column"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def literal(x: Literal) -> Column:
    if x.type == "time":
        return F.lit(((x.value.hour * 60 + x.value.minute) * 60 + x.value.second) * 1_000_000 + x.value.microsecond).cast("long")
    if x.type == "dateTime":
        return F.lit(x.value.isoformat(sep=" ")).cast("timestamp_ntz")
    if x.type == "int":
        return F.lit(x.value).cast("long")
    return F.lit(x.value).cast("long") if x.type == "duration" else F.lit(x.value)


def _ordered(op: str, a: Column, b: Column) -> Column:
    return {"eq": a == b, "notEq": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]


def comparison(c: Input, op: str, x: Literal) -> Term:
    empty = c.column.isNull()
    if op == "contains":
        if x.type != "string":
            return Term(F.lit(False), fail(c.name, "contains needs a string to look for"))
        value = F.coalesce(F.when(c.has("string"), c.get("string").contains(x.value)), F.lit(False)) if "string" in c.kinds() else F.lit(False)
        plain = c.column.contains(x.value) if c.kind == "string" else None
        bad = empty if c.kind == "string" else ~c.has("string") if not c.kind else F.lit(True)
        return Term(value, F.when(bad, fail(c.name, "contains needs string cells")), plain)
    plain, orders = None, op not in ("eq", "notEq")
    errors: list[tuple[Column, str]] = []
    if "error" in c.kinds():
        errors.append((c.has("error"), "an error cell can't be compared"))
    if x.type == "empty":
        if orders:
            errors.append((~empty, "a value has no order against an empty cell"))
        value = empty if op in ("eq", "le", "ge") else ~empty if op == "notEq" else F.lit(False)
    else:
        if orders:
            errors.append((empty, "an empty cell has no order against a value"))
        same = [k for k in c.kinds() if k == x.type or k in NUMBERS and x.type in NUMBERS]
        tests = []
        for k in same:
            as_double = k in NUMBERS and "float" in (k, x.type)
            if as_double and x.value != x.value:
                errors.append((c.has(k), "NaN can't be compared"))
                continue
            if k == "float" and c.nan:
                errors.append((c.has(k) & F.isnan(c.get(k)), "NaN can't be compared"))
            a, b = (c.get(k).cast("double"), F.lit(float(x.value))) if as_double else (c.get(k), literal(x))
            tests.append((k, _ordered(op, a, b)))
        if c.kind:
            if not same:
                errors.append((~empty, f"{c.kind} and {x.type} can't be compared"))
                value = F.lit(op == "notEq") & empty
            else:
                value = tests[0][1] if tests else F.lit(False)
                # a null comparison: the cell is empty, and differs from any value
                plain = (empty | value if op == "notEq" else value) if tests else None
                value = F.coalesce(value, F.lit(op == "notEq"))
        else:
            others = ~empty & ~c.has("error")
            value = F.when(empty, F.lit(op == "notEq"))
            for k, test in tests:
                value = value.when(c.has(k), test)
                others = others & ~c.has(k)
            value = F.coalesce(value.otherwise(F.lit(False)), F.lit(False))
            errors.append((others, f"cells of another kind than {x.type} can't be compared with it"))
    out = None
    for bad, message in errors:
        out = F.when(bad, fail(c.name, message)) if out is None else out.when(bad, fail(c.name, message))
    return Term(value, out, plain)


def compile_filter(x: Filter, inputs: dict[str, Input]) -> Term:
    if x.kind in ("and", "or"):
        both = x.kind == "and"
        value, error, plain = F.lit(both), None, None
        for k, part in enumerate(x.expressions):
            t = compile_filter(part, inputs)
            if t.error is not None:
                # the part is looked at only if nothing before it failed or decided
                reached = t.error if k == 0 else F.when(value if both else ~value, t.error)
                error = reached if error is None else F.coalesce(error, reached)
            value = t.value if k == 0 else value & t.value if both else value | t.value
            plain = t.rows if k == 0 else plain & t.rows if both else plain | t.rows
        return Term(value, error, plain)
    if x.kind == "not":
        t = compile_filter(x.expressions[0], inputs)
        return Term(~t.value, t.error)
    if x.kind == "compare":
        return comparison(inputs[x.column], x.op, x.value)
    c = inputs[x.column].column
    return Term(c.isNull() if x.kind == "isEmpty" else c.isNotNull())
