"""Workbooks as sheets. Files are read with Spark's ``binaryFile`` source, so any store will do; a sheet is one deflate stream, so it is one task, and many files are many tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import ReadError
from tabulon.functions import cells as C
from tabulon.functions.references import CellRange, CellReference, letters
from tabulon.operators.relation import ROW, Sheet
from tabulon.sources.ooxml import Cell, SheetInfo, Workbook

STRUCTURED = T.StructType(
    [
        T.StructField("column", T.IntegerType()),
        T.StructField("cell", C.CELL),
        T.StructField("formula", T.StringType()),
        T.StructField("style_id", T.IntegerType()),
        T.StructField("number_format", T.StringType()),
    ]
)
ROWS = T.StructType([T.StructField("path", T.StringType()), T.StructField("sheet", T.StringType()), T.StructField(ROW, T.LongType()), T.StructField("cells", T.ArrayType(STRUCTURED))])


@dataclass(frozen=True)
class ReadOptions:
    sheet_name: str | None = None
    start_cell: str = "A1"
    end_cell: str | None = None
    #: None: no header for rows, the first row for typed reads.
    header: bool | None = None
    ignore_empty_rows: bool = False
    trim_headers: bool = True

    @property
    def start(self) -> CellReference:
        return CellReference.parse(self.start_cell)

    @property
    def end(self) -> CellReference | None:
        return CellReference.parse(self.end_cell) if self.end_cell else None

    def uses_header(self, typed: bool = False) -> bool:
        return typed if self.header is None else self.header


def load_bytes(spark: SparkSession, path: str) -> bytes:
    """The one file at a path."""
    files = spark.read.format("binaryFile").load(path)
    found = files.select("path").take(2)
    if not found:
        raise ReadError(f"no file at {path}")
    if len(found) > 1:
        raise ReadError(f"several files at {path}: a sheet is one file's; structured_rows reads them all")
    return bytes(files.select("content").first()[0])


def _workbook(source, spark: SparkSession | None) -> Workbook:
    return source if isinstance(source, Workbook) else Workbook(source if isinstance(source, (bytes, bytearray)) or spark is None else load_bytes(spark, source))


def sheet_names(source, spark: SparkSession | None = None) -> list[str]:
    return [s.name for s in _workbook(source, spark).sheets]


def sheet_info(source, spark: SparkSession | None = None) -> list[SheetInfo]:
    return _workbook(source, spark).checked_types()


def sheet_dimensions(source, spark: SparkSession | None = None) -> list[CellRange]:
    w = _workbook(source, spark)
    return [w.dimensions(s) for s in w.sheets]


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of the sheets of all files at a path."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = Workbook(content).checked_types()
                yield pa.RecordBatch.from_pydict({"path": [p] * len(found), "id": [s.id for s in found], "index": [s.index for s in found], "name": [s.name for s in found], "sheet_type": [s.sheet_type for s in found], "visibility": [s.visibility for s in found], "is_active": [s.is_active for s in found]}, schema=pa.schema([("path", pa.string()), ("id", pa.int32()), ("index", pa.int32()), ("name", pa.string()), ("sheet_type", pa.string()), ("visibility", pa.string()), ("is_active", pa.bool_())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, id int, index int, name string, sheet_type string, visibility string, is_active boolean")


class _Batch:
    """Rows gathered as flat columns of their cells."""

    def __init__(self):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(ROWS)
        self.rows: list[tuple[str, str, int]] = []
        self.ends = [0]
        self.outer: list[list] = [[] for _ in STRUCTURED.names]
        self.inner: list[list] = [[] for _ in C.CELL.names]

    def add(self, path: str, sheet: str, row: int, cells: list[Cell]) -> None:
        for c in cells:
            v = C.of_python(c.value)
            for held, x in zip(self.outer, (c.column, v is None, c.formula, c.style, c.format), strict=True):
                held.append(x)
            for held, x in zip(self.inner, v or _NOTHING, strict=True):
                held.append(x)
        self.rows.append((path, sheet, row))
        self.ends.append(len(self.outer[0]))

    def arrow(self):
        import pyarrow as pa

        fields = self.schema.field("cells").type.value_type
        of_cell = fields.field("cell").type
        cell = pa.StructArray.from_arrays([pa.array(v, of_cell.field(k).type) for k, v in enumerate(self.inner)], fields=list(of_cell), mask=pa.array(self.outer[1], pa.bool_()))
        parts = [cell if k == 1 else pa.array(v, fields.field(k).type) for k, v in enumerate(self.outer)]
        cells = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(fields)))
        path, sheet, row = zip(*self.rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(sheet, pa.string()), pa.array(row, pa.int64()), cells.cast(self.schema.field("cells").type)], schema=self.schema)


_NOTHING = (None,) * len(C.CELL.names)


def structured_batches(w: Workbook, path: str | None, options: ReadOptions) -> Iterator:
    """Arrow batches of the selected rows of a sheet."""
    info, held = w.sheet(options.sheet_name), _Batch()
    for row, cells in w.rows(info, options.start, options.end, options.ignore_empty_rows):
        held.add(path, info.name, row, cells)
        if len(held.rows) == 5000:
            yield held.arrow()
            held = _Batch()
    if held.rows:
        yield held.arrow()


def structured_rows(spark: SparkSession, path: str, options: ReadOptions = ReadOptions()) -> DataFrame:
    """path, sheet, _row, cells: the explicit cells of the selected rows, of all files at a path."""

    def run(batches) -> Iterator:
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from structured_batches(Workbook(content), p, options)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS)


def structured_bytes(spark: SparkSession, data: bytes, options: ReadOptions = ReadOptions()) -> DataFrame:
    """The same from bytes on the driver, with a null path."""
    return spark.createDataFrame([(bytes(data),)], "content binary").select(F.lit(None).cast("string").alias("path"), "content").mapInArrow(_of_bytes(options), ROWS)


def _of_bytes(options: ReadOptions):
    def run(batches) -> Iterator:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                yield from structured_batches(Workbook(content), None, options)

    return run


def header_of(w: Workbook, info: SheetInfo, options: ReadOptions, typed: bool = False) -> tuple[int, list[int], list[str], int | None]:
    """First column, kept columns, their names, and the header's row."""
    start, end = options.start, options.end
    last = end.column if end else (w.extent(info) or (0, 0, 0, 0))[3]
    columns = list(range(start.column, last + 1))
    if not options.uses_header(typed):
        return start.column, columns, [letters(n) for n in columns], None
    for row, cells in w.rows(info, start, end, options.ignore_empty_rows):
        text = {c.column: header_text(c.value) for c in cells}
        kept = [n for n in columns if text.get(n)]
        names = [text[n].strip() if typed and options.trim_headers else text[n] for n in kept]
        return start.column, kept, names, row
    return start.column, [], [], None


def header_text(v) -> str:
    """Text of a header cell; whole floats without a point, booleans in lower case."""
    from tabulon.functions.text import float_text_of

    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    return float_text_of(v) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)


def read(spark: SparkSession, path: str, options: ReadOptions = ReadOptions(), typed: bool = False) -> Sheet:
    """A sheet of one workbook; every column is of cells."""
    w = Workbook(load_bytes(spark, path))
    info = w.sheet(options.sheet_name)
    _, columns, names, header = header_of(w, info, options, typed)
    rows = structured_rows(spark, path, options)
    rows = rows if header is None else rows.where(F.col(ROW) != header)
    # Of cells declared twice the last one has the value of all.
    cells = F.map_from_entries(F.transform(F.array_distinct(F.transform("cells", lambda c: F.struct(c["column"].alias("k"), c["cell"].alias("v")))), lambda x: F.struct(x["k"], x["v"])))
    wide = rows.select(ROW, cells.alias("m")).select(ROW, *[F.col("m")[F.lit(n)].alias(f"c{k}") for k, n in enumerate(columns)])
    return Sheet(wide, tuple(names), info.name, columns[0] if columns else options.start.column, header)


def read_bytes(spark: SparkSession, data: bytes, options: ReadOptions = ReadOptions(), typed: bool = False) -> Sheet:
    """The same from bytes on the driver, which are as large as the result."""
    w = Workbook(data)
    info = w.sheet(options.sheet_name)
    _, columns, names, header = header_of(w, info, options, typed)
    rows = []
    for row, cells in w.rows(info, options.start, options.end, options.ignore_empty_rows):
        if row != header:
            own = {c.column: c.value for c in cells}
            rows.append((row, *[C.of_python(own.get(n)) for n in columns]))
    schema = T.StructType([T.StructField(ROW, T.LongType()), *[T.StructField(f"c{k}", C.CELL) for k in range(len(columns))]])
    return Sheet(spark.createDataFrame(rows, schema), tuple(names), info.name, columns[0] if columns else options.start.column, header)


def native(sheet: Sheet) -> Sheet:
    """Columns whose cells are all of one kind become native columns; whole numbers and others mixed become doubles. One pass to see the kinds."""
    n = len(sheet.names)
    kinds = sheet.df.agg(*[F.collect_set(F.col(f"c{k}")["kind"]).alias(f"c{k}") for k in range(n)]).first() if n else ()
    out = [F.col(ROW)]
    for k in range(n):
        c, found = F.col(f"c{k}"), set(kinds[k])
        if found == {"int", "float"}:
            c = F.coalesce(c["f"], c["i"].cast("double"))
        elif len(found) == 1 and not found & {"error", "time", "duration"}:
            c = c[C.FIELDS[next(iter(found))]]
        elif not found:
            c = F.lit(None).cast("string")
        out.append(c.alias(f"c{k}"))
    return Sheet(sheet.df.select(*out), sheet.names, sheet.name, sheet.first_column, sheet.header_row)
