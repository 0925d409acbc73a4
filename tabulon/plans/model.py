"""The plan document.

A plan is versioned JSON in camelCase; every field has a default and unknown fields are ignored.
Filters are tagged by ``kind``, literals by ``type`` and ``value``.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass, field, replace

from tabulon.errors import PlanError
from tabulon.functions.cells import Duration

VERSION = "tabulon.query-plan/v1"
#: Plans of other tools with the same document are taken too.
_KNOWN = re.compile(r"[a-z]+\.query-plan/v1")
COMPARISONS = ("eq", "notEq", "lt", "le", "gt", "ge", "contains")
AGGREGATES = ("count", "sum", "average", "min", "max")
LITERALS = ("empty", "bool", "int", "float", "string", "date", "time", "dateTime", "duration")


@dataclass(frozen=True)
class Literal:
    """value: None, bool, int, float, str, date, time, datetime; durations in milliseconds in JSON, microseconds here."""

    type: str
    value: object = None

    @classmethod
    def of(cls, v) -> Literal:
        kinds = [(bool, "bool"), (Duration, "duration"), (int, "int"), (float, "float"), (str, "string"), (dt.datetime, "dateTime"), (dt.date, "date"), (dt.time, "time")]
        if v is None:
            return cls("empty")
        if isinstance(v, dt.timedelta):
            return cls("duration", v // dt.timedelta(microseconds=1))
        return next(cls(name, v) for kind, name in kinds if isinstance(v, kind))

    @classmethod
    def from_json(cls, x: dict) -> Literal:
        kind = x.get("type")
        if kind not in LITERALS:
            raise PlanError(f"unknown literal type {kind!r}")
        v = x.get("value")
        right = {"empty": lambda: True, "bool": lambda: isinstance(v, bool), "int": lambda: isinstance(v, int) and not isinstance(v, bool), "float": lambda: isinstance(v, (int, float)) and not isinstance(v, bool), "duration": lambda: isinstance(v, int)}
        if not right.get(kind, lambda: isinstance(v, str))():
            raise PlanError(f"literal of type {kind} has the value {v!r}")
        try:
            made = {"empty": lambda: None, "float": lambda: float(v), "duration": lambda: v * 1000, "date": lambda: dt.date.fromisoformat(v), "time": lambda: dt.time.fromisoformat(v), "dateTime": lambda: dt.datetime.fromisoformat(v)}
            return cls(kind, made.get(kind, lambda: v)())
        except ValueError as e:
            raise PlanError(f"literal of type {kind}: {e}") from e

    def to_json(self) -> dict:
        if self.type == "empty":
            return {"type": "empty"}
        v = self.value
        return {"type": self.type, "value": v // 1000 if self.type == "duration" else v.isoformat() if hasattr(v, "isoformat") else v}


@dataclass(frozen=True)
class Filter:
    """kind: and, or, not, compare, isEmpty, isNotEmpty."""

    kind: str
    expressions: tuple[Filter, ...] = ()
    column: str = ""
    op: str = ""
    value: Literal = Literal("empty")

    def columns(self) -> set[str]:
        return ({self.column} if self.column else set()).union(*(x.columns() for x in self.expressions))

    @classmethod
    def from_json(cls, x: dict) -> Filter:
        kind = x.get("kind")
        try:
            if kind in ("and", "or"):
                return cls(kind, tuple(map(cls.from_json, x["expressions"])))
            if kind == "not":
                return cls(kind, (cls.from_json(x["expression"]),))
            if kind in ("isEmpty", "isNotEmpty"):
                return cls(kind, column=x["column"])
            if kind == "compare":
                if x["op"] not in COMPARISONS:
                    raise PlanError(f"unknown comparison {x['op']!r}")
                return cls(kind, column=x["column"], op=x["op"], value=Literal.from_json(x["value"]))
        except (KeyError, TypeError, AttributeError) as e:
            raise PlanError(f"filter of kind {kind}: {e!r}") from e
        raise PlanError(f"unknown filter kind {kind!r}")

    def to_json(self) -> dict:
        if self.kind in ("and", "or"):
            return {"kind": self.kind, "expressions": [x.to_json() for x in self.expressions]}
        if self.kind == "not":
            return {"kind": "not", "expression": self.expressions[0].to_json()}
        out = {"kind": self.kind, "column": self.column}
        return out | {"op": self.op, "value": self.value.to_json()} if self.kind == "compare" else out


def all_of(*x: Filter) -> Filter:
    return Filter("and", x)


def any_of(*x: Filter) -> Filter:
    return Filter("or", x)


def negate(x: Filter) -> Filter:
    return Filter("not", (x,))


def compare(column: str, op: str, value) -> Filter:
    return Filter("compare", column=column, op=op, value=value if isinstance(value, Literal) else Literal.of(value))


def is_empty(column: str) -> Filter:
    return Filter("isEmpty", column=column)


def is_not_empty(column: str) -> Filter:
    return Filter("isNotEmpty", column=column)


@dataclass(frozen=True)
class Aggregate:
    """op of a column; count without a column counts rows."""

    op: str
    alias: str
    column: str | None = None

    @classmethod
    def from_json(cls, x: dict) -> Aggregate:
        try:
            if x["op"] not in AGGREGATES:
                raise PlanError(f"unknown aggregate {x['op']!r}")
            return cls(x["op"], x["alias"], x.get("column"))
        except (KeyError, TypeError) as e:
            raise PlanError(f"aggregate: {e!r}") from e

    def to_json(self) -> dict:
        return {"op": self.op, "column": self.column, "alias": self.alias}


@dataclass(frozen=True)
class Plan:
    aggregates: tuple[Aggregate, ...] = ()
    group_by: tuple[str, ...] = ()
    filter: Filter | None = None
    max_groups: int = 10_000
    limit: int | None = None
    evidence_rows: int = 5
    version: str = field(default=VERSION)

    def where(self, x: Filter) -> Plan:
        return replace(self, filter=x)

    def by(self, *columns: str) -> Plan:
        return replace(self, group_by=columns)

    def select(self, *aggregates: Aggregate) -> Plan:
        return replace(self, aggregates=aggregates)

    @classmethod
    def from_json(cls, text: str | dict) -> Plan:
        try:
            x = json.loads(text) if isinstance(text, str) else text
        except ValueError as e:
            raise PlanError(f"not JSON: {e}") from e
        if not isinstance(x, dict):
            raise PlanError("a plan is a JSON object")
        own = cls()
        return cls(
            aggregates=tuple(map(Aggregate.from_json, x.get("aggregates", ()))),
            group_by=tuple(x.get("groupBy", ())),
            filter=Filter.from_json(x["filter"]) if x.get("filter") is not None else None,
            max_groups=x.get("maxGroups", own.max_groups),
            limit=x.get("limit"),
            evidence_rows=x.get("evidenceRowsPerGroup", own.evidence_rows),
            version=x.get("version", VERSION),
        )

    def to_json(self) -> dict:
        return {
            "version": self.version,
            "filter": self.filter.to_json() if self.filter else None,
            "groupBy": list(self.group_by),
            "aggregates": [a.to_json() for a in self.aggregates],
            "maxGroups": self.max_groups,
            "limit": self.limit,
            "evidenceRowsPerGroup": self.evidence_rows,
        }

    def columns(self) -> set[str]:
        return {*self.group_by, *(a.column for a in self.aggregates if a.column), *(self.filter.columns() if self.filter else ())}

    def validate(self, columns: list[str] | None = None) -> Plan:
        """Checks before any job; columns: those of the sheet."""

        def need(ok, message):
            if not ok:
                raise PlanError(message)

        need(_KNOWN.fullmatch(self.version), f"unsupported plan version {self.version!r}; expected {VERSION!r}")
        need(self.aggregates, "a plan needs an aggregate")
        need(self.max_groups > 0, "maxGroups must be positive")
        need(self.limit is None or self.limit > 0, "limit must be positive")
        need(self.evidence_rows >= 0, "evidenceRowsPerGroup must not be negative")
        names: set[str] = set()
        for g in self.group_by:
            need(g, "a group column is empty")
            need(g not in names, f"duplicate group column {g!r}")
            names.add(g)
        for a in self.aggregates:
            need(a.alias, "an aggregate alias is empty")
            need(a.alias not in names, f"duplicate output column {a.alias!r}")
            names.add(a.alias)
            need(a.op == "count" or a.column, f"aggregate {a.op} needs a column")
        if columns is not None:
            missing = sorted(self.columns() - set(columns))
            need(not missing, f"unknown column {missing[0]!r}" if missing else "")
        return self


def literal_for(kind: str, op: str, text: str) -> Literal:
    """The literal that a column previewed as ``kind`` is compared with, from what a user typed."""
    if op == "contains":
        return Literal("string", text)
    if kind == "boolean":
        if text.lower() not in ("true", "false"):
            raise PlanError("expects true or false")
        return Literal("bool", text.lower() == "true")
    if kind == "integer":
        m = re.match(r"\s*[+-]?\d+", text)
        if not m or abs(int(m[0])) > 9_007_199_254_740_991:
            raise PlanError("expects a safe integer")
        return Literal("int", int(m[0]))
    if kind == "number":
        try:
            x = float(text)
        except ValueError:
            x = float("inf")
        if x != x or abs(x) == float("inf"):
            raise PlanError("expects a number")
        return Literal("float", x)
    if kind in ("date", "time", "datetime"):
        return Literal.from_json({"type": {"datetime": "dateTime"}.get(kind, kind), "value": text})
    return Literal("string", text)
