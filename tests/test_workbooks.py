"""Workbooks written by the tests: scans, round trips, typed rows, evidence, templates, command line."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import types as T

from tabulon import cli
from tabulon.errors import ConversionError, DuplicateColumnError, HiddenSheetError, MissingSchemaError, NoSheetsError, RangeError, ReadError, SheetNameError, SheetNotFoundError, TemplateError, WriteError
from tabulon.functions import references as R
from tabulon.functions.cells import ErrorCell
from tabulon.operators import evidence as E
from tabulon.operators import relation as S
from tabulon.operators.analyze import analyze
from tabulon.plans import model as M
from tabulon.session import WorkbookSession, export_workbook
from tabulon.sources import ooxml as O
from tabulon.sources import template as P
from tabulon.sources import workbook as W
from tabulon.sources import writer as X
from tabulon.sources.datasource import WorkbookSource
from tabulon.streaming import rows as V

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(sheets, strings=None, styles=None, extra=""):
    """sheets: (name, attributes, sheetData and what stands before it)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{k + 1}" {a} r:id="rId{k + 1}"/>' for k, (n, a, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}>{extra}<sheets>{listed}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k + 1}" Type="{KIND}/worksheet" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, (_, _, data) in enumerate(sheets):
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f"<worksheet {MAIN}>{data}</worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{strings}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")
    return out.getvalue()


STYLES = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm:ss.000"/><numFmt numFmtId="165" formatCode="[hh]:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="46"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
ODD = package(
    [
        ("Odd", "", '<sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c t="s"><v>0</v></c><c r="B2"><v>7</v></c></row><row r="5"><c r="A5" s="1"><v>44196.5</v></c><c s="2"><v>1.5</v></c><c s="3"><v>44275.98590639</v></c><c t="e"><v>#N/A</v></c><c t="b"><v>true</v></c><c t="d"><v>2020-01-02</v></c><c t="d"><v>10:11:12</v></c><c t="d"><v>soon</v></c><c t="str"><f>A1&amp;"x"</f><v></v></c><c><v>2.0</v></c><c><v>2.5</v></c></row><row/></sheetData>'),
        ("Hidden", 'state="hidden"', '<dimension ref="B2:C9"/><sheetData/>'),
    ],
    "<si><t>a_x000A_b</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si>",
    STYLES,
)


def test_parser_on_odd_sheets():
    w = O.Workbook(ODD)
    rows = list(w.rows(w.sheet()))
    assert [r for r, _ in rows] == [1, 2, 3, 4, 5, 6] and [len(c) for _, c in rows] == [0, 3, 0, 0, 11, 0]
    assert [(c.column, c.value) for c in rows[1][1]] == [(2, 7), (3, "a\nb"), (2, 7)]
    assert [c.value for c in rows[4][1]] == [dt.datetime(2020, 12, 31, 12), dt.timedelta(hours=36), dt.datetime(2021, 3, 20, 23, 39, 42, 312000), ErrorCell("#N/A"), True, dt.date(2020, 1, 2), dt.time(10, 11, 12), "soon", "", 2, 2.5]
    assert rows[4][1][8].formula == 'A1&"x"' and rows[4][1][0].format == "mm-dd-yy" and type(rows[4][1][9].value) is int
    assert w.dimensions(w.sheet("Hidden")) == R.CellRange(R.CellReference(2, 2), R.CellReference(9, 3)) and str(w.dimensions(w.sheet()).end) == "K6"
    assert [r for r, _ in w.rows(w.sheet(), R.CellReference(2, 1), R.CellReference(4, 3))] == [2]
    assert [r for r, _ in w.rows(w.sheet(), ignore_empty=True)] == [2, 5]
    with pytest.raises(RangeError):
        list(w.rows(w.sheet(), R.CellReference(3, 1), R.CellReference(2, 1)))
    with pytest.raises(SheetNotFoundError):
        w.sheet("odd")
    with pytest.raises(ReadError):
        O.Workbook(b"no zip")
    with pytest.raises(NoSheetsError):
        O.Workbook(package([])).sheet()
    with pytest.raises(ReadError):
        O.Workbook(package([("A", 'state="gone"', "")]))
    assert O.Workbook(package([("A", "", '<sheetData><row><c s="1"><v>0</v></c></row></sheetData>')], None, STYLES, '<workbookPr date1904="1"/>')).rows(O.SheetInfo(1, 0, "A", "worksheet", "visible", True, "xl/worksheets/sheet1.xml")).__next__()[1][0].value == dt.datetime(1904, 1, 1)
    assert [O.classify(c) for c in ("General", '"day" 0', "[Red]0", "0;yy", "[h]:mm", "\\d0", "mmm")] == ["number", "number", "number", "number", "duration", "number", "dateTime"]


def one_sheet(data, **more):
    return package([("S", "", f"<sheetData>{data}</sheetData>")], **more)


def values(raw, **options):
    w = O.Workbook(raw)
    return [(r, {R.letters(c.column): c.value for c in cells}) for r, cells in w.rows(w.sheet(), **options)]


def test_cells_without_a_value_and_odd_attributes():
    rows = values(one_sheet('<row r="0"><c t="b"/><c t="d"/><c t="s"/><c t="n"/><c t="str"/><c t="inlineStr"><v>lost</v></c><c s="x"><v>1</v></c></row><row r="0"><c><v>2</v></c></row>'))
    assert rows == [(1, {"A": False, "B": "", "C": None, "D": None, "E": "", "F": "", "G": 1}), (2, {"A": 2})]
    for bad in ('<c t="e"/>', "<c><v>1_0</v></c>", "<c><v> 1</v></c>", '<c t="s"><v>9</v></c>', '<c t="s"><v>-1</v></c>', "<c><v>one</v></c>"):
        with pytest.raises(ReadError):
            values(one_sheet(f"<row>{bad}</row>"))
    assert values(one_sheet("<row><c><v>1e3</v></c><c><v>-.5</v></c><c><v>inf</v></c></row>"))[0][1] == {"A": 1000, "B": -0.5, "C": float("inf")}


def test_escapes_and_format_codes():
    for text, shown in [("_X0041_", "A"), ("_xD800_x0041_", "_xD800A"), ("_x0041", "_x0041"), ("__x0042_", "_B"), ("_x00g1_", "_x00g1_"), ("_x005F_x0041_", "_x0041_")]:
        assert O.unescape(text) == shown
    for code, kind in [("0\\;d", "dateTime"), ("0;d", "number"), ('"d"0', "number"), ("[Red]0", "number"), ("[mm]:ss", "duration"), ("_d0", "number"), ('";"d', "dateTime")]:
        assert O.classify(code) == kind, code
    out = io.BytesIO()
    X.write(out, [("S", ["t"], [("_X0041_ _x0041_",)])])
    assert values(out.getvalue())[1][1] == {"A": "_X0041_ _x0041_"}


def test_one_file_at_a_path(spark, tmp_path):
    X.save(str(tmp_path / "a.xlsx"), [{"k": 1}])
    X.save(str(tmp_path / "b.xlsx"), [{"z": 2}])
    with pytest.raises(ReadError, match="several files"):
        W.read(spark, str(tmp_path))
    assert {r.path[-6:] for r in W.structured_rows(spark, f"{tmp_path}/*.xlsx").collect()} == {"a.xlsx", "b.xlsx"}
    drop = lambda df: [(r.sheet, r["_row"], r.cells) for r in df.orderBy("_row").collect()]
    assert drop(W.structured_bytes(spark, (tmp_path / "a.xlsx").read_bytes())) == drop(W.structured_rows(spark, str(tmp_path / "a.xlsx")))


def test_data_source(spark, tmp_path):
    spark.dataSource.register(WorkbookSource)
    X.save(str(tmp_path / "a.xlsx"), [{"k": 1, "v": "x"}, {"k": 2.5, "v": None}])
    X.save(str(tmp_path / "b.xlsx"), [{"z": True}])
    (tmp_path / "notes.txt").write_text("none")
    rows = lambda df: sorted((r.path[-6:], r.sheet, r["_row"], str(r.cells)) for r in df.collect())
    assert rows(spark.read.format("workbook").load(str(tmp_path))) == rows(W.structured_rows(spark, f"{tmp_path}/*.xlsx"))
    one = spark.read.format("workbook").option("startCell", "B2").option("ignoreEmptyRows", "true").load(f"file://{tmp_path}/a.xlsx")
    assert [(r["_row"], [c.cell.s for c in r.cells]) for r in one.collect()] == [(2, ["x"])]
    assert one.where("_row > 2").count() == 0


def test_session_documents(spark, tmp_path):
    X.save(str(tmp_path / "s.xlsx"), [{"k": "a", "v": 2**60, "d": dt.date(2024, 2, 3)}, {"k": "b", "v": 2.5, "d": None}, {"k": "a", "v": True, "d": None}])
    session = WorkbookSession(spark, (tmp_path / "s.xlsx").read_bytes())
    found = session.inspect({"hasHeader": True, "limit": 2})
    assert found["columns"] == ["k", "v", "d"] and found["sheetNames"] == ["Sheet1"] and found["sheetInfo"][0]["visibility"] == "visible"
    assert (found["totalRows"], found["displayedRows"], found["truncated"]) == (3, 2, True)
    assert found["rows"][1] == ["b", 2.5, None] and found["rows"][0][2] == "2024-02-03T00:00:00" and found["cellTypes"][1] == ["string", "number", "empty"]
    assert session.inspect({"limit": 0})["displayedRows"] == 4
    r = session.analyze({"hasHeader": True}, {"groupBy": ["k"], "aggregates": [{"op": "count", "alias": "n"}]})
    assert r["columns"] == ["k", "n"] and r["rows"] == [{"values": ["a", 2], "cellTypes": ["string", "integer"], "sourceRows": [2, 4]}, {"values": ["b", 1], "cellTypes": ["string", "integer"], "sourceRows": [3]}]
    assert r["stats"]["totalGroups"] == 2 and r["plan"]["groupBy"] == ["k"] and r["selectedSheet"] == "Sheet1"
    assert session.export_simple_markdown({"endCell": "A2"}) == {"markdown": "| A |\n| --- |\n| k |\n| a |\n", "selectedSheet": "Sheet1", "emittedRows": 2}


def test_references():
    assert [R.letters(n) for n in (1, 26, 27, 702, 703, 16384)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert all(R.number(R.letters(n)) == n for n in range(1, 16385, 7)) and R.number("XFE") is None
    assert str(R.CellReference.parse(" $b$12 ")) == "B12"
    for bad in ("", "A", "1", "A0", "XFE1", "A1048577", "A1B", "$$A1"):
        with pytest.raises(ValueError):
            R.CellReference.parse(bad)


ROW = {"Name": "a|b <&> _x0041_ \x01", "Count": 3, "Ratio": 2.5, "Active": True, "Date": dt.date(2020, 1, 2), "Time": dt.time(10, 11, 12), "Created": dt.datetime(2021, 3, 20, 23, 39, 42, 313000), "Elapsed": dt.timedelta(hours=27), "Missing": None}


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    assert X.save(path, [ROW, {"Name": "", "Later": 2**60}], options=X.WriteOptions(column_formats={"Ratio": "0.00"})) == 2
    s = W.read(spark, path, W.ReadOptions(header=True))
    assert s.columns == [*ROW, "Later"]
    (_, a), (_, b) = V.iterate(s)
    assert a == {**ROW, "Date": dt.datetime(2020, 1, 2), "Time": dt.datetime(1899, 12, 31, 10, 11, 12), "Later": None}
    assert b["Name"] == "" and b["Later"] == str(2**60)
    assert [(i, x["Name"]) for i, x in V.iterate(W.read_bytes(spark, open(path, "rb").read(), W.ReadOptions(header=True)))] == [(2, a["Name"]), (3, "")]
    seen = []
    assert V.visit(s, lambda i, r: seen.append(i) or False).visited_rows == 1 and seen == [2]
    assert V.preview(s, 1)["truncated"] and V.preview(s, 0)["displayedRows"] == 2
    assert S.columns_with_data(W.read(spark, path, W.ReadOptions(start_cell="A9"))) == []
    with pytest.raises(FileExistsError):
        X.save(path, [ROW])
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, v string").coalesce(1)
    assert X.save_sheets(path, {"One": df, "Two": [{"q": 1}]}, X.WriteOptions(overwrite=True)) == [2, 1]
    assert W.sheet_names(path, spark) == ["One", "Two"]
    assert [r["name"] for r in W.sheets(spark, path).orderBy("index").collect()] == ["One", "Two"]
    assert [str(d.end) for d in W.sheet_dimensions(path, spark)] == ["B3", "A2"]
    native = W.native(W.read(spark, path, W.ReadOptions("One", header=True)))
    assert native.to_df().orderBy("_row").collect() == [T.Row(_row=2, id=1, v="x"), T.Row(_row=3, id=2, v=None)]
    for sheets in ({}, {"a" * 32: df}, {"A": df, "a": df}, {"a/b": df}, {"'a": df}):
        with pytest.raises((SheetNameError, MissingSchemaError)):
            X.save_sheets(str(tmp_path / "b.xlsx"), sheets)
    with pytest.raises(MissingSchemaError):
        X.save_bytes([])
    with pytest.raises(DuplicateColumnError):
        X.save_bytes([], ["a", "a"])
    with pytest.raises(WriteError):
        X.save_bytes([{"a": float("nan")}])
    assert O.Workbook(X.save_bytes([], ["a", "b"])).extent(O.Workbook(X.save_bytes([], ["a", "b"])).sheet()) == (1, 1, 1, 2)


def test_typed_rows(spark, tmp_path):
    path = str(tmp_path / "t.xlsx")
    X.save(path, [{" Name ": "a", "N": 1, "P": 2}, {" Name ": "b", "N": 2, "P": 2.5}, {" Name ": "c", "N": "Error", "P": None}])
    schema = T.StructType([T.StructField("Name", T.StringType()), T.StructField("P", T.DoubleType()), T.StructField("Gone", T.LongType())])
    s = W.read(spark, path, typed=True)
    assert [tuple(r) for r in S.typed(s, schema).orderBy("_row").collect()] == [(2, "a", 2.0, None), (3, "b", 2.5, None), (4, "c", None, None)]
    with pytest.raises(ConversionError) as e:
        S.typed(s, T.StructType([T.StructField("N", T.IntegerType())]))
    assert e.value.row == 4 and "Error" in str(e.value)


def test_typed_dates_and_positions(spark, tmp_path):
    path = str(tmp_path / "p.xlsx")
    X.save(path, [{"a": dt.date(2020, 1, 2), "b": "2020-01-03"}, {"a": "2020-01-04T05:06:07", "b": None}], options=X.WriteOptions(header=False))
    s = W.read(spark, path)
    both = T.StructType([T.StructField("when", T.TimestampNTZType()), T.StructField("day", T.DateType())])
    assert [tuple(r) for r in S.typed(s, both).orderBy("_row").collect()] == [(1, dt.datetime(2020, 1, 2), dt.date(2020, 1, 3)), (2, dt.datetime(2020, 1, 4, 5, 6, 7), None)]
    with pytest.raises(ConversionError, match="row 1"):
        S.typed(s, T.StructType([T.StructField("n", T.LongType())]))


def test_analysis_of_a_workbook(spark, tmp_path):
    path = str(tmp_path / "s.xlsx")
    X.save(path, [{"k": "a", "v": 1}, {"k": "b", "v": 2.5}, {"k": "a", "v": None}])
    plan = M.Plan((M.Aggregate("count", "n"), M.Aggregate("sum", "s", "v")), ("k",))
    r = analyze(W.read(spark, path, W.ReadOptions(header=True)), plan)
    assert [(V.value(x.k), x.n, V.value(x.s), x.source_rows) for x in r.rows.collect()] == [("a", 2, 1, [2, 4]), ("b", 1, 2.5, [3])]


def test_evidence(spark, tmp_path):
    with open(tmp_path / "e.xlsx", "wb") as f:
        f.write(package([("D*1", "", '<sheetData><row><c t="inlineStr"><is><t>Na|me</t></is></c><c><v>1</v></c></row>' + "".join(f'<row><c><v>{i}.5</v></c><c s="1"><f>B1*2</f><v>{i}</v></c></row>' for i in range(5)) + "</sheetData>"), ("H", 'state="veryHidden"', "<sheetData/>")], None, STYLES))
    found = export_workbook(spark, str(tmp_path / "e.xlsx"), W.ReadOptions(header=True), E.ExportOptions(2, 4))
    chunks = found.chunks.orderBy("chunk").collect()
    docs = [json.loads(c.json) for c in chunks]
    m = found.manifest
    assert [c.data_range for c in chunks] == ["A2:B3", "A4:B5"] and (m["emittedRows"], m["truncated"], m["continuationRow"]) == (4, True, 6)
    assert m["jsonlUtf8Bytes"] == sum(len(c.json.encode()) + 1 for c in chunks) and m["approximateTokens"] == -(-m["jsonlUtf8Bytes"] // 4)
    assert docs[0]["header"]["cells"][0] == {"row": 1, "column": 1, "address": "A1", "value": {"type": "string", "value": "Na|me"}, "formula": None, "calculationStatus": "notApplicable", "styleId": 0, "numberFormat": "General"}
    assert docs[0]["rows"][0]["cells"][0]["value"] == {"type": "float", "value": "0.5"} and docs[0]["rows"][1]["cells"][1]["calculationStatus"] == "cachedOnly"
    lines = chunks[0].markdown.split("\n")
    assert lines[1] == "## D\\*1 - A2:B3" and lines[3] == "| _row | Na\\|me | 1 |" and lines[4] == "| ---: | --- | --- |"
    assert lines[5].startswith("| 2 | 0.5 | 1899-12-31T00:00:00 \\[formula: =B1\\*2; cached\\] |") and "### Cell metadata" in chunks[0].markdown and lines[-3] == "<!-- tabulon:chunk-end -->"
    with pytest.raises(HiddenSheetError):
        export_workbook(spark, str(tmp_path / "e.xlsx"), W.ReadOptions("H"))
    session = WorkbookSession(spark, (tmp_path / "e.xlsx").read_bytes())
    again = session.export_rag({"hasHeader": True}, E.ExportOptions(2, 4, source_name="e.xlsx"))
    assert again["chunks"] == docs and again["manifest"] == m and again["chunksJsonl"].count("\n") == 2
    assert again["chunksMarkdown"] == E.stream_start(m) + "".join(c.markdown for c in chunks) + E.stream_end(m)
    with pytest.raises(HiddenSheetError):
        session.export_simple_markdown({"sheetName": "H"})
    assert session.export_simple_markdown({"sheetName": "H", "allowHiddenSheets": True}) == {"markdown": "", "selectedSheet": "H", "emittedRows": 0}
    for bad in ({"chunk_rows": 0}, {"max_rows": 0}):
        with pytest.raises(ValueError):
            E.ExportOptions(**bad)
    cli.write_evidence(found, str(tmp_path / "out"))
    assert json.load(open(tmp_path / "out.manifest.json"))["emittedChunks"] == 2
    assert [json.loads(x) for x in open(tmp_path / "out.chunks.jsonl")] == docs
    text = open(tmp_path / "out.chunks.md").read()
    assert text.startswith("<!-- tabulon:stream-start -->\n# e.xlsx\n") and text.endswith('<!-- tabulon:stream-end chunks="2" rows="4" truncated="true" -->\n')


def test_template(tmp_path):
    text = lambda at, t, s="": f'<c r="{at}" {s} t="inlineStr"><is><t>{t}</t></is></c>'
    raw = package([("R", "", f'<dimension ref="A1:C4"/><sheetData><row r="1">{text("A1", "{{title}}")}</row><row r="3">{text("A3", "{{lots.town}}", "s=\"1\"")}{text("B3", "{{ lots.area }}")}{text("C3", "{{$rowindex}}: {{active}}")}</row><row r="4">{text("A4", "Foot: {{title}}")}{text("B4", "{{none}}")}</row></sheetData>')], None, STYLES)
    data = {"title": "Q <1> & =", "active": True, "lots": [{"town": "=Bern", "area": 10}, {"town": "Lund", "area": 2.5}]}
    w = O.Workbook(P.fill_bytes(raw, data))
    rows = {r: {c.column: c.value for c in cells} for r, cells in w.rows(w.sheet())}
    assert rows == {1: {1: "Q <1> & ="}, 2: {}, 3: {1: "'=Bern", 2: 10, 3: "1: true"}, 4: {1: "Lund", 2: 2.5, 3: "2: true"}, 5: {1: "Foot: Q <1> & =", 2: None}}
    assert str(w.dimensions(w.sheet()).end) == "C5"
    assert [c.style for _, cells in w.rows(w.sheet(), R.CellReference(3, 1), R.CellReference(4, 1)) for c in cells] == [1, 1]
    empty = O.Workbook(P.fill_bytes(raw, {**data, "lots": []}))
    assert [c.value for c in dict(empty.rows(empty.sheet()))[3]] == [None, None, "1: true"] and 5 not in dict(empty.rows(empty.sheet()))
    with pytest.raises(TemplateError, match="none"):
        P.fill_bytes(raw, data, ignore_missing=False)
    (tmp_path / "t.xlsx").write_bytes(raw)
    P.fill(str(tmp_path / "o.xlsx"), str(tmp_path / "t.xlsx"), data)
    with pytest.raises(FileExistsError):
        P.fill(str(tmp_path / "o.xlsx"), str(tmp_path / "t.xlsx"), data)
    P.fill(str(tmp_path / "o.xlsx"), str(tmp_path / "t.xlsx"), data, overwrite=True)


def test_command_line(spark, tmp_path):
    path, plan = str(tmp_path / "d" / "demo.xlsx"), tmp_path / "p.json"
    plan.write_text(json.dumps({"groupBy": ["State"], "aggregates": [{"op": "sum", "column": "Stalls", "alias": "total"}]}))

    def call(*argv):
        out, err = io.StringIO(), io.StringIO()
        cli.run(cli.parser().parse_args(argv), spark, out, err)
        return out.getvalue(), err.getvalue()

    call("write-demo", path)
    assert call("sheets", path)[0] == "1\tSheet1\n"
    assert call("query", path, "--header", "--limit", "1")[0].splitlines()[2] == "| Oslo | Timber | Fjord | Open | 34 | true | 6.5 |"
    assert json.loads(call("query", path, "--format", "jsonl", "--limit", "1")[0])["A"] == "Town"
    assert call("query", path, "--start-cell", "A90")[0] == "No rows.\n"
    table, stats = call("analyze", path, "--header", "--plan", str(plan))
    assert table.splitlines()[2:] == ["| Open | 85 |", "| Shut | 12 |"] and json.loads(stats)["totalGroups"] == 2
    assert json.loads(call("analyze", path, "--header", "--plan", str(plan), "--format", "json")[0])["rows"][0] == {"values": {"State": "Open", "total": 85}, "sourceRows": [2, 4]}
    call("rag-export", path, "--header", "--output-prefix", str(tmp_path / "x"), "--format", "jsonl")
    assert (tmp_path / "x.chunks.jsonl").exists() and not (tmp_path / "x.chunks.md").exists()
    with pytest.raises(ZeroDivisionError):
        cli.publish({str(tmp_path / "x.chunks.jsonl"): ["new"], str(tmp_path / "y"): (1 / 0 for _ in "a")})
    assert (tmp_path / "x.chunks.jsonl").read_text() != "new"
