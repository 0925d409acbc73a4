"""Workbooks as a Spark data source.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").option("sheet", "Data").option("startCell", "A2").load(path)

A row is a worksheet's row: path, sheet, _row, cells, as ``workbook.structured_rows`` gives them. A
path is a file, or a folder whose workbooks are all read, a task each, in any store that Arrow's
file systems reach. Options: sheet, startCell, endCell, ignoreEmptyRows. Where only Spark reaches a
store, ``structured_rows`` is the way.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tabulon.errors import ReadError
from tabulon.sources import workbook as W
from tabulon.sources.ooxml import Workbook

#: Names of workbooks in a folder.
SUFFIXES = (".xlsx", ".xlsm")


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _store(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, options: W.ReadOptions):
        self.path, self.options = path, options

    def partitions(self) -> list[File]:
        from pyarrow import fs

        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return [File(path)]
        if info.type != fs.FileType.Directory:
            raise ReadError(f"no file at {self.path}")
        return [File(f.path) for f in sorted(store.get_file_info(fs.FileSelector(path)), key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name.lower().endswith(SUFFIXES) and not f.base_name.startswith("~$")]

    def read(self, partition: File) -> Iterator:
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as f:
            data = f.read()
        yield from W.structured_batches(Workbook(data), partition.path, self.options)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        return W.ROWS

    def reader(self, schema: StructType) -> WorkbookReader:
        o = self.options
        if not o.get("path"):
            raise ReadError("a path is needed")
        ignore = (o.get("ignoreEmptyRows") or "false").lower() == "true"
        return WorkbookReader(o["path"], W.ReadOptions(o.get("sheet"), o.get("startCell") or "A1", o.get("endCell"), ignore_empty_rows=ignore))
