"""A DataFrame treated as a worksheet.

Every sheet has the column ``_row``: the source row, from 1, gaps included. Other columns are named
by position inside (``c0``, ``c1``, ...), as header texts may hold dots, differ in case only, or
occur twice; ``names`` has the header. A column is native where its cells are of one kind, with
null for empty, or a struct of cells (see ``functions.cells``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import ConversionError, PlanError, RangeError
from tabulon.functions import cells as C
from tabulon.functions.references import CellRange, CellReference, letters
from tabulon.plans.compile import Input

ROW = "_row"


@dataclass(frozen=True)
class Sheet:
    df: DataFrame
    names: tuple[str, ...]
    name: str = "Sheet1"
    #: Sheet column (from 1) of the first column.
    first_column: int = 1
    header_row: int | None = None

    def __post_init__(self):
        if len(self.df.columns) != len(self.names) + 1 or self.df.columns[0] != ROW:
            raise ValueError("a sheet has _row and a column for each name")

    @property
    def columns(self) -> list[str]:
        """Distinct names, in order of their first place."""
        return list(dict.fromkeys(self.names))

    def input(self, name: str) -> Input:
        """The column of that exact name; of equal names the last one's data."""
        if name not in self.names:
            raise PlanError(f"unknown column {name!r}")
        k = len(self.names) - 1 - self.names[::-1].index(name)
        return Input(name, F.col(f"c{k}"), self.df.schema[f"c{k}"].dataType)

    def inputs(self) -> dict[str, Input]:
        return {n: self.input(n) for n in self.columns}

    def cell(self, k: int) -> Column:
        return C.lift(F.col(f"c{k}"), self.df.schema[f"c{k}"].dataType)

    def to_df(self) -> DataFrame:
        """_row and the columns by their names, one for each distinct name."""
        return self.df.select(ROW, *[self.input(n).column.alias(n) for n in self.columns])


def from_dataframe(df: DataFrame, row: Column, name: str = "Sheet1", header_row: int | None = 1) -> Sheet:
    """row: each row's number. Give a dense key or ``_metadata.row_index`` plus 2 (row 1 is the header); numbering rows of a large table otherwise needs a sort."""
    names = tuple(df.columns)
    return Sheet(df.select(row.cast("long").alias(ROW), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]), names, name, header_row=header_row)


def select_range(sheet: Sheet, start: str | CellReference = "A1", end: str | CellReference | None = None) -> Sheet:
    """Rows and columns from one corner to the other, both included."""
    start = CellReference.parse(start) if isinstance(start, str) else start
    end = CellReference.parse(end) if isinstance(end, str) else end
    if end and (end.row < start.row or end.column < start.column):
        raise RangeError(f"range {start}:{end} ends before it starts")
    first = sheet.first_column
    keep = [k for k in range(len(sheet.names)) if first + k >= start.column and (end is None or first + k <= end.column)]
    df = sheet.df.where(F.col(ROW) >= start.row)
    df = df.where(F.col(ROW) <= end.row) if end else df
    df = df.select(ROW, *[F.col(f"c{k}").alias(f"c{n}") for n, k in enumerate(keep)])
    return replace(sheet, df=df, names=tuple(sheet.names[k] for k in keep), first_column=max(first, start.column))


def with_letters(sheet: Sheet) -> Sheet:
    """Columns named by letters, from the sheet's first column."""
    return replace(sheet, names=tuple(letters(sheet.first_column + k) for k in range(len(sheet.names))))


def drop_empty_rows(sheet: Sheet) -> Sheet:
    """Without rows whose cells are all empty; an empty string is not empty."""
    some = F.lit(False)
    for k in range(len(sheet.names)):
        some = some | F.col(f"c{k}").isNotNull()
    return replace(sheet, df=sheet.df.where(some))


def fill_missing_rows(sheet: Sheet, first: int = 1) -> Sheet:
    """Rows that are absent between ``first`` and the last row become empty rows. Row numbers come from counting within ranges, not from one list."""
    last = sheet.df.agg(F.max(ROW)).first()[0]
    if last is None:
        return sheet
    rows = sheet.df.sparkSession.range(first, last + 1).select(F.col("id").alias(ROW))
    return replace(sheet, df=rows.join(sheet.df, ROW, "left").select(*sheet.df.columns))


def limit_rows(sheet: Sheet, n: int = 20) -> Sheet:
    """The first rows in sheet order; 0: all."""
    return replace(sheet, df=sheet.df.orderBy(ROW).limit(n)) if n else sheet


def dimensions(sheet: Sheet) -> DataFrame:
    """One row: start and end corner, rows and columns; corners null and counts 0 without rows."""
    a, b = F.min(ROW).alias("a"), F.max(ROW).alias("b")
    left, right = letters(sheet.first_column), letters(sheet.first_column + len(sheet.names) - 1)
    corner = lambda c, r: F.when(F.col(r).isNotNull(), F.concat(F.lit(c), F.col(r).cast("string")))
    return sheet.df.agg(a, b).select(
        corner(left, "a").alias("start"),
        corner(right, "b").alias("end"),
        F.coalesce(F.col("b") - F.col("a") + 1, F.lit(0)).alias("n_rows"),
        F.when(F.col("a").isNull(), 0).otherwise(len(sheet.names)).cast("long").alias("n_columns"),
    )


def used_range(sheet: Sheet) -> CellRange:
    r = dimensions(sheet).first()
    return CellRange(CellReference.parse(r["start"]), CellReference.parse(r["end"])) if r["start"] else CellRange()


def columns_with_data(sheet: Sheet) -> list[str]:
    """The column names, or none if there is no data row."""
    return [] if sheet.df.isEmpty() else sheet.columns


def structured(sheet: Sheet, explicit_only: bool = True) -> DataFrame:
    """One row per cell: _row, column (from 1), cell, empty cells only if asked for."""
    listed = F.array(*[F.struct(F.lit(sheet.first_column + k).alias("column"), sheet.cell(k).alias("cell")) for k in range(len(sheet.names))])
    out = sheet.df.select(ROW, F.explode(listed).alias("x")).select(ROW, "x.column", "x.cell")
    return out.where("cell IS NOT NULL") if explicit_only else out


def typed(sheet: Sheet, schema: T.StructType, trim: bool = True) -> DataFrame:
    """_row and the columns of ``schema``, by header name (trimmed if asked for), or by position in a sheet without a header. The first cell in row order that doesn't fit raises ConversionError.

    Cells fit columns of their own kind; whole numbers fit where numbers are wanted, dates where
    datetimes are, datetimes at midnight where dates are, and ISO texts where either is.
    """
    by_name = {(n.strip() if trim else n): n for n in sheet.names}
    if sheet.header_row is None:
        by_name = {f.name: n for f, n in zip(schema, sheet.names, strict=False)}
    made, errors = [F.col(ROW)], []
    for f in schema:
        if f.name not in by_name:
            if not f.nullable:
                raise PlanError(f"unknown column {f.name!r}")
            made.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = sheet.input(by_name[f.name])
        want = C.native_kind(f.dataType)
        value = F.lit(None).cast(f.dataType)
        good = c.column.isNull()
        kinds = {"float": ("float", "int"), "dateTime": ("dateTime", "date", "string"), "date": ("date", "dateTime", "string")}.get(want, (want,))
        for k in kinds:
            if k in c.kinds():
                raw = c.column if c.kind else c.get(k)
                cast = raw.try_cast(f.dataType) if want in ("int", "float", "dateTime", "date") else raw.cast(f.dataType)
                if (want, k) == ("date", "dateTime"):
                    cast = F.when(raw == F.date_trunc("day", raw), cast)
                value = F.when(c.has(k), cast).otherwise(value)
                good = good | (c.has(k) & cast.isNotNull())
        bad = ~good if f.nullable else ~good | c.column.isNull()
        message = F.concat(F.lit(f"column {f.name!r} wants {f.dataType.simpleString()}, got "), F.coalesce(C.plain_text(C.lift(c.column, c.type)), F.lit("nothing")))
        errors.append(F.when(bad, message))
        made.append(value.alias(f.name))
    if errors:
        error = F.coalesce(*errors, F.lit(None).cast("string"))
        first = sheet.df.agg(F.min_by(F.struct(F.col(ROW), error.alias("e")), F.when(error.isNotNull(), F.col(ROW)))).first()[0]
        if first:
            raise ConversionError(sheet.name, first[ROW], first["e"])
    return sheet.df.select(*made)
