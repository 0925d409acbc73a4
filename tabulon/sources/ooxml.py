"""A pull parser for OOXML workbooks, on zipfile and expat.

It holds one row at a time, besides shared strings and styles. Element names match by local name.
"""

from __future__ import annotations

import datetime as dt
import functools
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from tabulon.errors import NoSheetsError, RangeError, ReadError, SheetNotFoundError
from tabulon.functions.cells import Duration, ErrorCell
from tabulon.functions.references import MAX_COLUMNS, MAX_ROWS, CellRange, CellReference, number

#: Texts of error cells. Fixed values.
ERRORS = ("#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!", "#DATA!", "#GETTING_DATA")
#: Number formats by built-in id. Fixed values.
FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
DATE_IDS = {*range(14, 23), 45, 47}
DURATION_IDS = {46}
SHEET_TYPES = {"worksheet": "worksheet", "chartsheet": "chartsheet", "dialogsheet": "dialogsheet", "macrosheet": "macrosheet", "xlMacrosheet": "macrosheet", "xlIntlMacrosheet": "macrosheet"}
VISIBILITY = {None: "visible", "visible": "visible", "hidden": "hidden", "veryHidden": "veryHidden"}


@dataclass(frozen=True)
class SheetInfo:
    id: int
    index: int
    name: str
    sheet_type: str
    visibility: str
    is_active: bool
    part: str = ""


@dataclass(frozen=True)
class Style:
    kind: str = "number"  # or dateTime, duration
    format: str | None = None


@dataclass(frozen=True)
class Cell:
    """value: None, bool, int, float, str, datetime, date, time, timedelta or ErrorCell."""

    column: int
    value: object
    formula: str | None = None
    style: int = 0
    format: str | None = None


@functools.lru_cache(maxsize=4096)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(e: ET.Element, name: str) -> str | None:
    """By local name, whatever its namespace."""
    value = e.get(name)
    if value is None and e.attrib:
        value = next((v for k, v in e.attrib.items() if _local(k) == name), None)
    return value


@functools.lru_cache(maxsize=65_536)
def _column_of(letters: str) -> int | None:
    """The column that a reference without its row begins with."""
    m = re.match(r"\$?([A-Za-z]+)", letters)
    return number(m[1]) if m else None


def classify(code: str) -> str:
    """What numbers of a format code are: the first date letter or elapsed-time bracket of its first section decides."""
    for m in re.finditer(r'\\.|_.|\*.|"[^"]*"?|\[([^\]]*)\]?|[dmyhsDMYHS;]', code, re.S):
        if m[0] == ";":
            break
        if m[0][0] == "[":
            if m[1] and not m[1].strip("hmsHMS"):
                return "duration"
        elif m[0][0] not in '\\_*"':
            return "dateTime"
    return "number"


def unescape(text: str) -> str:
    """``_xHHHH_`` is a character, the x in either case; surrogates and other forms stay, and what follows them counts anew."""
    return re.sub(r"_[xX](?![dD][89A-Fa-f])([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text) if "_" in text else text


#: What a cell's number may look like: no spaces, no underscores.
_NUMBER = re.compile(r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])")


def _from_serial(x: float, kind: str, base: dt.datetime):
    try:
        ms = round(x * 86_400_000)
        if kind == "duration":
            return dt.timedelta(milliseconds=ms)
        if base.year == 1899 and x < 60:  # the 29th of February 1900, which never was
            ms += 86_400_000
        return base + dt.timedelta(milliseconds=ms)
    except (OverflowError, ValueError):
        return None


def number_value(x: float):
    """Whole numbers in range are integers."""
    return int(x) if x == x and abs(x) != float("inf") and x == int(x) and -(2.0**63) <= x < 2.0**63 else x


def iso_value(text: str):
    try:
        if "T" in text or " " in text:
            v = dt.datetime.fromisoformat(text)
            return v.replace(tzinfo=None) if v.tzinfo is None else text
        return dt.time.fromisoformat(text) if ":" in text else dt.date.fromisoformat(text)
    except ValueError:
        return text


class Workbook:
    """data: the file's bytes, or a path of this machine."""

    def __init__(self, data: bytes | str):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, (bytes, bytearray)) else data)
        except (OSError, zipfile.BadZipFile) as e:
            raise ReadError(f"not a workbook: {e}") from e
        self.parts = {n.replace("\\", "/").lstrip("/"): n for n in self.zip.namelist()}
        self._strings: list[str] | None = None
        self._styles: list[Style] | None = None
        root = self._xml("xl/workbook.xml")
        if root is None:
            raise ReadError("the workbook part is missing")
        self.date1904, active, listed = False, 0, []
        for e in root.iter():
            name = _local(e.tag)
            if name == "workbookPr":
                self.date1904 = (_attribute(e, "date1904") or "").lower() in ("1", "true", "on")
            elif name == "workbookView":
                active = int(_attribute(e, "activeTab") or 0)
            elif name == "sheet":
                state = e.get("state")
                if state not in VISIBILITY:
                    raise ReadError(f"unknown sheet state {state!r}")
                relation = next((v for k, v in e.attrib.items() if _local(k) == "id" and k != "id"), None)
                if e.get("name") and relation:
                    listed.append((int(e.get("sheetId") or 0), e.get("name"), VISIBILITY[state], relation))
        self.relations = self._relations("xl/_rels/workbook.xml.rels", "xl")
        self.sheets = []
        for k, (i, name, shown, relation) in enumerate(listed):
            kind, part = self.relations.get(relation, ("", ""))
            self.sheets.append(SheetInfo(i, k, name, SHEET_TYPES.get(kind.rpartition("/")[2], kind), shown, k == active, part))
        self.base = dt.datetime(1904, 1, 1) if self.date1904 else dt.datetime(1899, 12, 30)

    def _xml(self, part: str) -> ET.Element | None:
        if part not in self.parts:
            return None
        try:
            return ET.fromstring(self.zip.read(self.parts[part]))
        except (ET.ParseError, zipfile.BadZipFile, OSError) as e:
            raise ReadError(f"{part}: {e}") from e

    def _relations(self, part: str, folder: str) -> dict[str, tuple[str, str]]:
        root, out = self._xml(part), {}
        for e in root.iter() if root is not None else ():
            if _local(e.tag) == "Relationship":
                target = (e.get("Target") or "").replace("\\", "/")
                path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
                out[e.get("Id")] = (e.get("Type") or "", path)
        return out

    @property
    def strings(self) -> list[str]:
        if self._strings is None:
            part = next((p for kind, p in self.relations.values() if kind.endswith("/sharedStrings")), "xl/sharedStrings.xml")
            root = self._xml(part)
            self._strings = [unescape("".join(t.text or "" for t in si.iter() if _local(t.tag) == "t")) for si in root if _local(si.tag) == "si"] if root is not None else []
        return self._strings

    @property
    def styles(self) -> list[Style]:
        if self._styles is None:
            part = next((p for kind, p in self.relations.values() if kind.endswith("/styles")), "xl/styles.xml")
            root, own, out = self._xml(part), {}, []
            for e in root.iter() if root is not None else ():
                if _local(e.tag) == "numFmt":
                    own[int(e.get("numFmtId") or 0)] = e.get("formatCode") or ""
            for group in root if root is not None else ():
                if _local(group.tag) != "cellXfs":
                    continue
                for xf in group:
                    if _local(xf.tag) == "xf":
                        i = int(xf.get("numFmtId") or 0)
                        kind = classify(own[i]) if i in own else "dateTime" if i in DATE_IDS else "duration" if i in DURATION_IDS else "number"
                        out.append(Style(kind, own.get(i, FORMATS.get(i))))
            self._styles = out
        return self._styles

    def sheet(self, name: str | None = None) -> SheetInfo:
        """By exact name, or the first in workbook order."""
        if not self.sheets:
            raise NoSheetsError("the workbook has no sheets")
        if name is None:
            return self.sheets[0]
        found = next((s for s in self.sheets if s.name == name), None)
        if found is None:
            raise SheetNotFoundError(name)
        return found

    def checked_types(self) -> list[SheetInfo]:
        """The sheets, where a kind of sheet that isn't known is an error."""
        for s in self.sheets:
            if s.sheet_type not in SHEET_TYPES.values():
                raise ReadError(f"unknown kind of sheet {s.sheet_type!r}")
        return self.sheets

    def _events(self, info: SheetInfo) -> Iterator[tuple[str, ET.Element]]:
        if info.part not in self.parts:
            raise ReadError(f"the part of sheet {info.name!r} is missing")
        try:
            with self.zip.open(self.parts[info.part]) as f:
                yield from ET.iterparse(f, ("start", "end"))
        except ET.ParseError as e:
            raise ReadError(f"{info.part}: {e}") from e

    def _declared(self, info: SheetInfo) -> Iterator[tuple[int, list[ET.Element]]]:
        """Row numbers and cell elements in file order; a row without a number follows the one before."""
        row, data = 0, None
        for event, e in self._events(info):
            name = _local(e.tag)
            if event == "start":
                if name == "sheetData":
                    data = e
            elif name == "row" and data is not None:
                r = _attribute(e, "r")
                row = int(r) if r and r.isdecimal() and int(r) else row + 1
                yield row, [c for c in e if _local(c.tag) == "c"]
                data.clear()
            elif name == "sheetData":
                return

    @staticmethod
    def _columns(found: list[ET.Element]) -> Iterator[tuple[int, ET.Element]]:
        at = 0
        for c in found:
            n = _column_of((_attribute(c, "r") or "").rstrip("0123456789"))
            at = n if n else at + 1
            yield at, c

    def _value(self, c: ET.Element) -> Cell:
        kind, v, formula, inline = c.get("t") or "n", "", None, ""
        for e in c:
            name = _local(e.tag)
            if name == "v":
                v = e.text or ""
            elif name == "f":
                formula = e.text or ""
            elif name == "is":
                inline = unescape("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t"))
        chosen = c.get("s") or ""
        style = int(chosen) if chosen.isdecimal() else 0
        look = self.styles[style] if style < len(self.styles) else Style()
        value: object = None
        if kind == "inlineStr":
            value = inline
        elif kind == "str":
            value = unescape(v)
        elif kind == "b":
            value = v == "1" or v.lower() == "true"
        elif kind == "e":
            if v not in ERRORS:
                raise ReadError(f"unknown error text {v!r}")
            value = ErrorCell(v)
        elif kind == "d":
            value = iso_value(v)
        elif kind == "s" and v:
            if not v.isdecimal() or int(v) >= len(self.strings):
                raise ReadError(f"no shared string {v!r}")
            value = self.strings[int(v)]
        elif v:
            if not _NUMBER.fullmatch(v):
                raise ReadError(f"not a number: {v!r}")
            x = float(v)
            value = _from_serial(x, look.kind, self.base) if look.kind != "number" else number_value(x)
            value = x if value is None else value
        return Cell(0, value, formula, style, look.format)

    def extent(self, info: SheetInfo) -> tuple[int, int, int, int] | None:
        """First and last row, first and last column of all declared rows and cells; None without a row. Columns are 0 without a cell."""
        rows, columns = [], []
        for row, found in self._declared(info):
            rows = [min([row, *rows]), max([row, *rows])]
            for n, _ in self._columns(found):
                columns = [min([n, *columns]), max([n, *columns])]
        return (*rows, *(columns or (0, 0))) if rows else None

    def dimensions(self, info: SheetInfo) -> CellRange:
        """The declared dimension where it stands before the data, else the extent."""
        for event, e in self._events(info):
            name = _local(e.tag)
            if event == "start" and name == "dimension" and e.get("ref"):
                a, _, b = e.get("ref").partition(":")
                return CellRange(CellReference.parse(a), CellReference.parse(b or a))
            if event == "start" and name == "sheetData":
                break
        found = self.extent(info)
        if not found or not found[2]:
            return CellRange()
        return CellRange(CellReference(found[0], found[2]), CellReference(found[1], found[3]))

    def rows(self, info: SheetInfo, start: CellReference = CellReference(1, 1), end: CellReference | None = None, ignore_empty: bool = False) -> Iterator[tuple[int, list[Cell]]]:
        """Selected rows with their explicit cells, in file order; undeclared rows before a declared one come as empty rows. Of cells declared twice all come, with the last one's value."""
        if end and (end.row < start.row or end.column < start.column):
            raise RangeError(f"range {start}:{end} ends before it starts")
        last, expected = end.row if end else MAX_ROWS, start.row
        for row, found in self._declared(info):
            if row > last:
                return
            if row < start.row:
                continue
            if not ignore_empty:
                for gap in range(expected, row):
                    yield gap, []
            expected = max(expected, row + 1)
            cells, seen = [], {}
            for n, c in self._columns(found):
                if start.column <= n <= (end.column if end else MAX_COLUMNS):
                    x = self._value(c)
                    seen[n] = x.value
                    cells.append(Cell(n, x.value, x.formula, x.style, x.format))
            cells = [Cell(c.column, seen[c.column], c.formula, c.style, c.format) for c in cells]
            if ignore_empty and all(c.value is None for c in cells):
                continue
            yield row, cells

    def close(self) -> None:
        self.zip.close()


__all__ = ["Cell", "Duration", "SheetInfo", "Style", "Workbook", "classify", "iso_value", "number_value", "unescape"]
