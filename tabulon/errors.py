"""Exceptions, one for each kind of failure."""

from __future__ import annotations


class TabulonError(Exception):
    """Base of all."""


class ReadError(TabulonError):
    """A workbook that can't be read."""


class WriteError(TabulonError):
    """A workbook that can't be written."""


class TemplateError(TabulonError):
    """A template that can't be filled."""


class CellReferenceError(TabulonError, ValueError):
    """Not an A1 reference, or beyond the limits of a sheet."""


class RangeError(TabulonError, ValueError):
    """A range whose end lies before its start."""


class SheetNotFoundError(TabulonError, KeyError):
    """No sheet of that name."""

    def __str__(self) -> str:
        return f"sheet not found: {self.args[0]}"


class NoSheetsError(TabulonError):
    """A workbook without sheets."""


class SheetNameError(WriteError, ValueError):
    """A sheet name that isn't allowed, or occurs twice."""


class MissingSchemaError(WriteError, ValueError):
    """No columns are known for a sheet."""


class SizeLimitError(WriteError, ValueError):
    """More rows or columns than a sheet has."""


class DuplicateColumnError(WriteError, ValueError):
    """A column name that occurs twice."""


class ConversionError(TabulonError, ValueError):
    """A cell that doesn't fit the wanted type."""

    def __init__(self, sheet: str, row: int, message: str):
        super().__init__(f"{sheet}, row {row}: {message}")
        self.sheet, self.row = sheet, row


class PlanError(TabulonError, ValueError):
    """A query plan that isn't valid."""


class AnalysisError(TabulonError, ValueError):
    """The first offending cell of an analysis, in sheet order."""

    def __init__(self, sheet: str, column: str, row: int, message: str):
        super().__init__(f"{sheet}!{column}{row}: {message}")
        self.sheet, self.column, self.row = sheet, column, row


class GroupLimitError(TabulonError):
    """More groups than the plan allows."""


class HiddenSheetError(TabulonError):
    """Evidence of a hidden sheet without opt-in."""
