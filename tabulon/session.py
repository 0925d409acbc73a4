"""A workbook's bytes as a session whose answers are JSON-ready documents, and evidence export from files or bytes."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.errors import PlanError
from tabulon.functions import cells as C
from tabulon.operators import evidence as E
from tabulon.operators.analyze import AnalysisResult, analyze
from tabulon.operators.relation import ROW, Sheet, limit_rows
from tabulon.plans.model import Plan
from tabulon.sources import workbook as W

#: Rows of a preview, where the options don't say.
PREVIEW_ROWS = 100


def export_bytes(spark: SparkSession, data: bytes, options: W.ReadOptions = W.ReadOptions(), export: E.ExportOptions = E.ExportOptions(), source_name: str = "") -> E.Evidence:
    """Evidence of a sheet of a workbook's bytes. It is parsed once: its rows stay cached until the result is closed."""
    w = W.Workbook(data)
    info = w.sheet(options.sheet_name)
    w.checked_types()
    E.check_visible(info.name, info.visibility, export)
    one = W.ReadOptions(info.name, options.start_cell, options.end_cell, options.header, options.ignore_empty_rows)
    rows = W.structured_bytes(spark, data, one).persist()
    end = str(options.end) if options.end else None
    found = E.export(rows, info.name, hashlib.sha256(data).hexdigest(), export, options.uses_header(), info.index, info.visibility, str(options.start), end, source_name)
    return E.Evidence(found.chunks, found.manifest, rows)


def export_workbook(spark: SparkSession, path: str, options: W.ReadOptions = W.ReadOptions(), export: E.ExportOptions = E.ExportOptions()) -> E.Evidence:
    """The same of the one file at a path."""
    return export_bytes(spark, W.load_bytes(spark, path), options, export, os.path.basename(path))


def result_sheet(spark: SparkSession, r: AnalysisResult) -> tuple[Sheet, list[list[int]]]:
    """An analysis' rows as a sheet numbered from 0, and each row's source rows; at most as many as the plan's groups."""
    names = [c for c in r.rows.columns if c != "source_rows"]
    rows = r.rows.collect()
    kinds = ",".join(f"c{k}:{r.rows.schema[c].dataType.simpleString()}" for k, c in enumerate(names))
    numbered = spark.createDataFrame([(k, *[x[c] for c in names]) for k, x in enumerate(rows)], f"struct<{ROW}:bigint,{kinds}>")
    return Sheet(numbered, tuple(names), r.sheet), [x["source_rows"] for x in rows]


def stats_document(r: AnalysisResult) -> dict:
    return {"seenRows": r.seen_rows, "matchedRows": r.matched_rows, "totalGroups": r.total_groups, "returnedGroups": r.returned_groups, "truncated": r.truncated}


def _shown(sheet: Sheet) -> DataFrame:
    """_row, values (a JSON object in column order) and kinds of the cells."""
    kinds: list[Column] = [C.type_name(C.lift(c.column, c.type), C.PREVIEW_TYPES) for c in sheet.inputs().values()]
    return sheet.df.select(ROW, E.row_document(sheet, " ms", safe=True).alias("document"), F.array(*kinds).cast("array<string>").alias("kinds"))


def _rows(sheet: Sheet) -> tuple[list[list], list[list[str]]]:
    found = _shown(sheet).orderBy(ROW).collect()
    return [list(json.loads(r["document"]).values()) for r in found], [list(r["kinds"]) for r in found]


class WorkbookSession:
    """Options are documents with sheetName, hasHeader, startCell, endCell, ignoreEmptyRows, allowHiddenSheets and limit, all optional."""

    def __init__(self, spark: SparkSession, data: bytes):
        self.spark, self.data = spark, bytes(data)

    @staticmethod
    def _read(options: dict | None) -> W.ReadOptions:
        o = options or {}
        return W.ReadOptions(o.get("sheetName"), o.get("startCell") or "A1", o.get("endCell"), bool(o.get("hasHeader")), bool(o.get("ignoreEmptyRows")))

    def inspect(self, options: dict | None = None) -> dict:
        """The sheets, and the first ``limit`` rows of one (0: all)."""
        info = W.sheet_info(self.data)
        sheet = W.read_bytes(self.spark, self.data, self._read(options))
        limit = (options or {}).get("limit")
        values, kinds = _rows(limit_rows(sheet, PREVIEW_ROWS if limit is None else limit))
        total = sheet.df.count()
        return {
            "sheetNames": [s.name for s in info],
            "sheetInfo": [{"name": s.name, "sheetType": s.sheet_type, "visibility": s.visibility} for s in info],
            "selectedSheet": sheet.name,
            "columns": sheet.columns,
            "rows": values,
            "cellTypes": kinds,
            "totalRows": total,
            "displayedRows": len(values),
            "truncated": len(values) < total,
        }

    def analyze(self, options: dict | None, plan: Plan | dict | str) -> dict:
        """The plan's groups with their evidence, and statistics of the run."""
        if isinstance(plan, (dict, str)):
            plan = Plan.from_json(plan if isinstance(plan, str) else json.dumps(plan))
        if not isinstance(plan, Plan):
            raise PlanError("a plan is a document")
        r = analyze(W.read_bytes(self.spark, self.data, self._read(options)), plan)
        sheet, sources = result_sheet(self.spark, r)
        values, kinds = _rows(sheet)
        rows = [{"values": v, "cellTypes": k, "sourceRows": s} for v, k, s in zip(values, kinds, sources, strict=True)]
        return {"selectedSheet": r.sheet, "columns": sheet.columns, "rows": rows, "stats": stats_document(r), "plan": r.plan.to_json()}

    def export_rag(self, options: dict | None = None, export: E.ExportOptions = E.ExportOptions()) -> dict:
        """All chunks of a sheet, as documents, JSON lines and Markdown, and the manifest."""
        found = export_bytes(self.spark, self.data, self._read(options), export)
        try:
            rows = found.chunks.orderBy("chunk").select("json", "markdown").collect()
        finally:
            found.close()
        return {
            "chunks": [json.loads(r["json"]) for r in rows],
            "chunksJsonl": "".join(r["json"] + "\n" for r in rows),
            "chunksMarkdown": E.stream_start(found.manifest) + "".join(r["markdown"] for r in rows) + E.stream_end(found.manifest),
            "manifest": found.manifest,
        }

    def export_simple_markdown(self, options: dict | None = None) -> dict:
        """One table without provenance."""
        read, w = self._read(options), W.Workbook(self.data)
        info = w.sheet(read.sheet_name)
        E.check_visible(info.name, info.visibility, E.ExportOptions(allow_hidden_sheets=bool((options or {}).get("allowHiddenSheets"))))
        sheet = W.read_bytes(self.spark, self.data, read)
        lines = [r["line"] for r in E.simple_markdown(sheet).orderBy(ROW).select("line").collect()]
        return {"markdown": "".join(x + "\n" for x in lines), "selectedSheet": sheet.name, "emittedRows": max(0, len(lines) - 2)}
