"""The cell: a struct for columns whose values are of more than one kind.

A null struct is an empty cell. ``kind`` names the one field that is set, besides ``f`` or ``i`` for
numbers; times are microseconds of the day, durations microseconds.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import text as X

#: Field of each kind.
FIELDS = {"bool": "b", "int": "i", "float": "f", "string": "s", "error": "s", "date": "d", "time": "us", "dateTime": "ts", "duration": "dur"}
CELL = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("i", T.LongType()),
        T.StructField("f", T.DoubleType()),
        T.StructField("s", T.StringType()),
        T.StructField("d", T.DateType()),
        T.StructField("us", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("dur", T.LongType()),
    ]
)
EPOCH = dt.datetime(1970, 1, 1)


class Duration(int):
    """Microseconds."""


class ErrorCell(str):
    """The text of an error."""


def native_kind(kind: T.DataType) -> str | None:
    """The kind of cell that a native column holds; None for columns of cells."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return "dateTime"
    if isinstance(kind, T.DayTimeIntervalType):
        return "duration"
    if type(kind).__name__ == "TimeType":
        return "time"
    if kind == CELL or isinstance(kind, T.StructType) and kind.names[:1] == ["kind"]:
        return None
    raise TypeError(f"no kind of cell for {kind.simpleString()}")


_PLACES = {n: k for k, n in enumerate(CELL.names)}


def _cell(kind: str, field: str, v) -> tuple:
    out = [None] * len(CELL.names)
    out[0], out[_PLACES[field]] = kind, v
    return tuple(out)


def of_python(v) -> tuple | None:
    """A Python value as a cell's fields."""
    if v is None:
        return None
    if isinstance(v, bool):
        return _cell("bool", "b", v)
    if isinstance(v, Duration):
        return _cell("duration", "dur", int(v))
    if isinstance(v, dt.timedelta):
        return _cell("duration", "dur", v // dt.timedelta(microseconds=1))
    if isinstance(v, int):
        return _cell("int", "i", v)
    if isinstance(v, float):
        return _cell("float", "f", v)
    if isinstance(v, ErrorCell):
        return _cell("error", "s", str(v))
    if isinstance(v, str):
        return _cell("string", "s", v)
    if isinstance(v, dt.datetime):
        return _cell("dateTime", "ts", v)
    if isinstance(v, dt.date):
        return _cell("date", "d", v)
    if isinstance(v, dt.time):
        return _cell("time", "us", ((v.hour * 60 + v.minute) * 60 + v.second) * 1_000_000 + v.microsecond)
    raise TypeError(f"no kind of cell for {type(v).__name__}")


def to_python(cell):
    """A collected cell as a Python value."""
    if cell is None:
        return None
    v = cell[FIELDS[cell["kind"]]]
    if cell["kind"] == "time":
        return (EPOCH + dt.timedelta(microseconds=v)).time()
    if cell["kind"] == "duration":
        return dt.timedelta(microseconds=v)
    return ErrorCell(v) if cell["kind"] == "error" else v


def lift(c: Column, kind: T.DataType) -> Column:
    """A column of any kind as cells."""
    name = native_kind(kind)
    if name is None:
        return c
    value = c
    if name == "time":
        value = micros_of_time(c)
    elif name == "duration":
        value = micros_of_duration(c)
    fields = [F.lit(name).alias("kind")]
    for f in CELL.fields[1:]:
        fields.append((value.cast(f.dataType) if f.name == FIELDS[name] else F.lit(None).cast(f.dataType)).alias(f.name))
    return F.when(c.isNotNull(), F.struct(*fields))


def micros_of_time(c: Column) -> Column:
    return (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + (F.second(c).cast("decimal(20,6)") * 1_000_000).cast("long")


def micros_of_duration(c: Column) -> Column:
    return (c.cast("decimal(30,6)") * 1_000_000).cast("long")


def _by_kind(c: Column, of: dict[str, Callable[[Column], Column]]) -> Column:
    out = F
    for kind, f in of.items():
        out = out.when(c["kind"] == kind, f(c))
    return out


def plain_text(c: Column, duration: str = " ms") -> Column:
    """The text of a cell; empty cells have none. duration: what follows the milliseconds."""
    return F.coalesce(
        _by_kind(
            c,
            {
                "string": lambda x: x["s"],
                "error": lambda x: x["s"],
                "int": lambda x: x["i"].cast("string"),
                "float": lambda x: X.float_text(x["f"]),
                "bool": lambda x: x["b"].cast("string"),
                "date": lambda x: X.date_text(x["d"]),
                "time": lambda x: X.time_text(x["us"]),
                "dateTime": lambda x: X.datetime_text(x["ts"]),
                "duration": lambda x: F.concat(F.floor(x["dur"] / 1000).cast("string"), F.lit(duration)),
            },
        ),
        F.lit(""),
    )


def json_string(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


def json_value(c: Column, duration: str = "ms", safe: bool = False) -> Column:
    """JSON of a cell as the command line prints it; safe: whole numbers that browsers can't hold become strings."""
    whole = c["i"].cast("string")
    if safe:
        whole = F.when(F.abs(c["i"]) <= 9_007_199_254_740_991, whole).otherwise(F.concat(F.lit('"'), whole, F.lit('"')))
    finite = ~(F.isnan(c["f"]) | (F.abs(c["f"]) == float("inf")))
    number = X.float_text(c["f"])
    number = F.when(~finite, F.concat(F.lit('"'), number, F.lit('"'))).when(number.contains("."), number).otherwise(F.concat(number, F.lit(".0")))
    return F.when(c.isNull(), "null").when(c["kind"] == "int", whole).when(c["kind"] == "float", number).when(c["kind"] == "bool", c["b"].cast("string")).otherwise(json_string(plain_text(c, duration)))


#: Names of kinds on the two surfaces. Fixed values.
PREVIEW_TYPES = {"bool": "boolean", "int": "integer", "float": "number", "string": "string", "date": "date", "time": "time", "dateTime": "datetime", "duration": "duration", "error": "error"}
EVIDENCE_TYPES = {"bool": "bool", "int": "int", "float": "float", "string": "string", "date": "date", "time": "time", "dateTime": "dateTime", "duration": "durationMilliseconds", "error": "error"}


def type_name(c: Column, names: dict[str, str]) -> Column:
    out = F.when(c.isNull(), "empty")
    for kind, name in names.items():
        out = out.when(c["kind"] == kind, name)
    return out


def tagged_json(c: Column) -> Column:
    """``{"type": ..., "value": ...}`` of an evidence cell; floats are strings, durations milliseconds, empty cells have no value."""
    kind = type_name(c, EVIDENCE_TYPES)
    value = F.when(c["kind"] == "int", c["i"].cast("string")).when(c["kind"] == "bool", c["b"].cast("string")).when(c["kind"] == "duration", F.floor(c["dur"] / 1000).cast("string")).otherwise(json_string(plain_text(c)))
    return F.when(c.isNull(), '{"type":"empty"}').otherwise(F.concat(F.lit('{"type":"'), kind, F.lit('","value":'), value, F.lit("}")))
