"""Command line: sheets, query, analyze, rag-export, write-demo."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile

from pyspark.sql import SparkSession

from tabulon.errors import TabulonError
from tabulon.functions import cells as C
from tabulon.functions import text as X
from tabulon.operators import evidence as E
from tabulon.operators.analyze import analyze
from tabulon.operators.relation import ROW, Sheet, limit_rows
from tabulon.plans.model import Plan
from tabulon.session import export_workbook, result_sheet, stats_document
from tabulon.sources import workbook as W
from tabulon.sources.writer import save


def print_table(columns: list[str], rows: list[list[str]], out) -> None:
    if not rows:
        print("No rows.", file=out)
        return
    print(f"| {' | '.join(columns)} |", file=out)
    print(f"| {' | '.join('---' for _ in columns)} |", file=out)
    for r in rows:
        print(f"| {' | '.join(r)} |", file=out)


def _read_options(a, header: bool | None = None) -> W.ReadOptions:
    return W.ReadOptions(a.sheet, a.start_cell, a.end_cell, a.header if header is None else header, a.ignore_empty_rows)


def _put(sheet: Sheet, form: str, out, order: str = ROW) -> None:
    if form == "table":
        shown = [X.table_text(C.plain_text(C.lift(c.column, c.type), "ms")).alias(f"v{k}") for k, c in enumerate(sheet.inputs().values())]
        print_table(sheet.columns, [list(r) for r in sheet.df.orderBy(order).select(*shown).toLocalIterator()], out)
        return
    lines = (r[0] for r in sheet.df.orderBy(order).select(E.row_document(sheet)).toLocalIterator())
    if form == "jsonl":
        for x in lines:
            print(x, file=out)
    else:
        print(json.dumps([json.loads(x) for x in lines], ensure_ascii=False, indent=2), file=out)


def publish(files: dict[str, object]) -> None:
    """Write each file whole before any is put in place; if one can't be, those before it come back."""
    parts, done = {}, []
    try:
        for path, lines in files.items():
            with tempfile.NamedTemporaryFile("w", encoding="utf-8", newline="", dir=os.path.dirname(path) or ".", delete=False) as f:
                parts[path] = f.name
                for x in lines:
                    f.write(x)
        for path, part in parts.items():
            old = f"{part}.old" if os.path.exists(path) else None
            if old:
                os.replace(path, old)
            done.append((path, old))
            os.replace(part, path)
    except BaseException:
        for path, old in reversed(done):
            if old:
                os.replace(old, path)
            elif os.path.exists(path):
                os.unlink(path)
        raise
    finally:
        for part in parts.values():
            if os.path.exists(part):
                os.unlink(part)
    for _, old in done:
        if old:
            os.unlink(old)


def write_evidence(found: E.Evidence, prefix: str, form: str = "both") -> None:
    ordered = found.chunks.orderBy("chunk")
    files: dict[str, object] = {}
    if form in ("jsonl", "both"):
        files[f"{prefix}.chunks.jsonl"] = (r["json"] + "\n" for r in ordered.select("json").toLocalIterator())
    if form in ("markdown", "both"):

        def lines():
            yield E.stream_start(found.manifest)
            for r in ordered.select("markdown").toLocalIterator():
                yield r["markdown"]
            yield E.stream_end(found.manifest)

        files[f"{prefix}.chunks.md"] = lines()
    files[f"{prefix}.manifest.json"] = [E.manifest_json(found.manifest)]
    publish(files)


DEMO = [
    {"Town": "Oslo", "Trade": "Timber", "Coast": "Fjord", "State": "Open", "Stalls": 34, "Covered": True, "Fee": 6.5},
    {"Town": "Porto", "Trade": "Wine", "Coast": "Ocean", "State": "Shut", "Stalls": 12, "Covered": False, "Fee": 4.25},
    {"Town": "Split", "Trade": "Fish", "Coast": "Sea", "State": "Open", "Stalls": 51, "Covered": True, "Fee": 3.0},
]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tabulon")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("sheets").add_argument("file")

    def read(name):
        q = sub.add_parser(name)
        q.add_argument("file")
        q.add_argument("--sheet")
        q.add_argument("--header", action="store_true")
        q.add_argument("--start-cell", default="A1")
        q.add_argument("--end-cell")
        q.add_argument("--ignore-empty-rows", action="store_true")
        return q

    q = read("query")
    q.add_argument("--limit", type=int, default=20)
    q.add_argument("--format", choices=("table", "json", "jsonl"), default="table")
    q = read("analyze")
    q.add_argument("--plan", required=True)
    q.add_argument("--format", choices=("table", "json", "jsonl"), default="table")
    q = read("rag-export")
    q.add_argument("--output-prefix", required=True)
    q.add_argument("--format", choices=("jsonl", "markdown", "both"), default="both")
    q.add_argument("--chunk-rows", type=int, default=25)
    q.add_argument("--max-rows", type=int)
    q.add_argument("--allow-hidden-sheets", action="store_true")
    sub.add_parser("write-demo").add_argument("file")
    return p


def run(a, spark: SparkSession, out=sys.stdout, err=sys.stderr) -> None:
    if a.command == "sheets":
        for k, name in enumerate(W.sheet_names(a.file, spark)):
            print(f"{k + 1}\t{name}", file=out)
    elif a.command == "query":
        _put(limit_rows(W.read(spark, a.file, _read_options(a)), a.limit), a.format, out)
    elif a.command == "analyze":
        text = sys.stdin.read() if a.plan == "-" else open(a.plan, encoding="utf-8").read()
        r = analyze(W.read(spark, a.file, _read_options(a, a.header)), Plan.from_json(text))
        stats = stats_document(r)
        sheet, sources = result_sheet(spark, r)
        if a.format == "json":
            lines = [json.loads(x[0]) for x in sheet.df.orderBy(ROW).select(E.row_document(sheet)).collect()]
            print(json.dumps({"sheet": r.sheet, "plan": r.plan.to_json(), "rows": [{"values": v, "sourceRows": x} for v, x in zip(lines, sources, strict=True)], "stats": stats}, ensure_ascii=False, indent=2), file=out)
        else:
            _put(sheet, a.format, out)
            print(json.dumps(stats), file=err)
    elif a.command == "rag-export":
        found = export_workbook(spark, a.file, _read_options(a), E.ExportOptions(a.chunk_rows, a.max_rows, a.allow_hidden_sheets))
        try:
            write_evidence(found, a.output_prefix, a.format)
        finally:
            found.close()
    elif a.command == "write-demo":
        os.makedirs(os.path.dirname(a.file) or ".", exist_ok=True)
        save(a.file, DEMO)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tabulon").getOrCreate()
    try:
        run(a, spark)
        return 0
    except (TabulonError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


