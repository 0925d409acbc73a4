"""What a scan of a workbook gives: rows, columns and kinds of cells, case by case, from files and from bytes."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from tabulon.errors import ConversionError
from tabulon.operators import relation as S
from tabulon.sources import workbook as W
from tabulon.streaming import rows as V
from tests.test_workbooks import package


def text(t, at=""):
    return f'<c {at and f"""r="{at}" """}t="inlineStr"><is><t>{t}</t></is></c>'


def number(x, at="", style=""):
    return f'<c {at and f"""r="{at}" """}{style}><v>{x}</v></c>'


PLAIN = package([("One", "", f"<sheetData><row>{text('town')}{text('area')}</row><row>{text('Graz')}{number(3)}</row><row>{text('Linz')}{number(4.5)}</row></sheetData>"), ("Two", "", f"<sheetData><row>{text('other')}</row></sheetData>")])
GAPS = package([("G", "", f'<sheetData><row r="1">{text("w", "A1")}{text("x", "B1")}{text("y", "C1")}</row><row r="2">{number(7, "B2")}</row><row r="3"/><row r="4"></row><row r="6">{number(8, "A6")}{number(9, "C6")}</row></sheetData>')])
LOOSE = package([("L", "", f"<sheetData><row>{number(1)}{number(2)}</row><row>{number(3)}{number(4, 'D2')}{number(5)}</row></sheetData>")])
STYLES = '<numFmts><numFmt numFmtId="170" formatCode="[h]:mm:ss"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/></cellXfs>'
TIMES = package([("T", "", f"<sheetData><row>{number(45000.25, '', 's=\"1\"')}{number(1.25, '', 's=\"2\"')}{number(45000.25)}</row></sheetData>")], None, STYLES)

CASES = [
    (PLAIN, {}, ["A", "B"], [(1, ["town", "area"]), (2, ["Graz", 3]), (3, ["Linz", 4.5])]),
    (PLAIN, {"header": True}, ["town", "area"], [(2, ["Graz", 3]), (3, ["Linz", 4.5])]),
    (PLAIN, {"sheet_name": "Two"}, ["A"], [(1, ["other"])]),
    (PLAIN, {"start_cell": "B2"}, ["B"], [(2, [3]), (3, [4.5])]),
    (PLAIN, {"start_cell": "A2", "end_cell": "A2"}, ["A"], [(2, ["Graz"])]),
    (PLAIN, {"start_cell": "B1", "end_cell": "C2", "header": True}, ["area"], [(2, [3])]),
    (GAPS, {}, ["A", "B", "C"], [(1, ["w", "x", "y"]), (2, [None, 7, None]), (3, [None] * 3), (4, [None] * 3), (5, [None] * 3), (6, [8, None, 9])]),
    (GAPS, {"ignore_empty_rows": True, "header": True}, ["w", "x", "y"], [(2, [None, 7, None]), (6, [8, None, 9])]),
    (LOOSE, {}, ["A", "B", "C", "D", "E"], [(1, [1, 2, None, None, None]), (2, [3, None, None, 4, 5])]),
    (TIMES, {}, ["A", "B", "C"], [(1, [dt.datetime(2023, 3, 15, 6), dt.timedelta(hours=30), 45000.25])]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_scan(spark, tmp_path, k):
    raw, options, columns, rows = CASES[k]
    (tmp_path / "c.xlsx").write_bytes(raw)
    for sheet in (W.read(spark, str(tmp_path / "c.xlsx"), W.ReadOptions(**options)), W.read_bytes(spark, raw, W.ReadOptions(**options))):
        assert sheet.columns == columns
        got = list(V.iterate(sheet))
        assert [(r, list(v.values())) for r, v in got] == rows
        assert [list(map(type, v.values())) for _, v in got] == [list(map(type, v)) for _, v in rows]


def test_typed(spark):
    raw = package([("T", "", f"<sheetData><row>{text(' id ')}{text('open')}{text('since')}</row><row>{number(5)}<c t=\"b\"><v>1</v></c>{number(45000, '', 's=\"1\"')}</row><row>{text('six')}</row></sheetData>")], None, STYLES)
    sheet = W.read_bytes(spark, raw, typed=True)
    assert sheet.columns == ["id", "open", "since"]
    kinds = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("open", T.BooleanType()), T.StructField("since", T.TimestampNTZType())])
    first = S.typed(S.limit_rows(sheet, 1), kinds).collect()
    assert [(r.id, r.open, r.since) for r in first] == [(5, True, dt.datetime(2023, 3, 15))]
    with pytest.raises(ConversionError) as e:
        S.typed(sheet, kinds)
    assert e.value.row == 3
