"""Texts of values, escapes for Markdown and tables, and other scalars."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is escaped with a backslash, by surface. Fixed values.
EVIDENCE_MARKS = r"\|`*_[]~"
HEADING_MARKS = r"\`*_[]<>#"
SIMPLE_MARKS = r"\|`*_[]()#+-!~"


def _class(marks: str) -> str:
    return "([" + "".join(f"\\{c}" for c in marks) + "])"


def _breaks(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n|\r|\n", "<br>")


def escape_evidence(text: Column) -> Column:
    """A Markdown table cell of an evidence chunk."""
    marked = F.regexp_replace(text, _class(EVIDENCE_MARKS), r"\\$1")
    named = F.replace(F.replace(F.replace(marked, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return _breaks(F.regexp_replace(named, r"[\x00-\x09\x0B\x0C\x0E-\x1F\x7F-\x9F]", " "))


def escape_heading(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _class(HEADING_MARKS), r"\\$1"), r"[\x00-\x1F\x7F-\x9F]", " ")


def escape_simple(text: Column) -> Column:
    """A cell of the simple Markdown table: more marks, no ampersands, controls as they are."""
    marked = F.regexp_replace(text, _class(SIMPLE_MARKS), r"\\$1")
    return _breaks(F.replace(F.replace(marked, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))


def table_text(text: Column) -> Column:
    """A cell of the command line's table: separators become visible."""
    for mark, shown in (("|", r"\|"), ("\r", r"\r"), ("\n", r"\n"), ("\t", r"\t")):
        text = F.replace(text, F.lit(mark), F.lit(shown))
    return text


def float_text(x: Column) -> Column:
    """Shortest digits without an exponent; whole numbers without a point; NaN, inf and -inf by name."""
    short = x.cast("string")  # shortest digits, but with an exponent far from 1
    digits = F.regexp_extract(short, r"^-?([0-9]+)(?:\.([0-9]+))?", 1)
    after = F.regexp_replace(F.regexp_extract(short, r"^-?([0-9]+)\.([0-9]+)", 2), "^0$", "")
    power = F.coalesce(F.try_to_number(F.regexp_extract(short, r"E(-?[0-9]+)$", 1), F.lit("S999")).cast("int"), F.lit(0))
    sign = F.when(short.startswith("-"), "-").otherwise("")
    large = F.concat(digits, F.rpad(after, F.greatest(power, F.length(after)), "0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits, after)
    plain = F.when(after == "", digits).otherwise(F.concat(digits, F.lit("."), after))
    middle = F.concat(digits, F.substring(after, F.lit(1), power), F.lit("."), F.substring(after, power + 1, F.length(after)))
    text = F.when(~short.contains("E"), plain).when(power < 0, small).when(power >= F.length(after), large).otherwise(middle)
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, text))


def float_text_of(x: float) -> str:
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    text = format(Decimal(repr(x)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def fraction_text(micros: Column) -> Column:
    """Nothing, or a point and 3 or 6 digits; micros: of the second."""
    return F.when(micros == 0, "").when(micros % 1000 == 0, F.concat(F.lit("."), F.lpad((micros / 1000).cast("int").cast("string"), 3, "0"))).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("int").cast("string"), 6, "0")))


def date_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def datetime_text(ts: Column) -> Column:
    micros = F.date_format(ts, "SSSSSS").cast("int")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction_text(micros))


def time_text(us: Column) -> Column:
    """us: microseconds of the day."""
    part = lambda per, mod: F.lpad((F.floor(us / per) % mod).cast("string"), 2, "0")
    return F.concat(part(3_600_000_000, 24), F.lit(":"), part(60_000_000, 60), F.lit(":"), part(1_000_000, 60), fraction_text(us % 1_000_000))


def formula_guard(text: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(text.startswith("=") | text.startswith("$="), F.concat(F.lit("'"), text)).otherwise(text)


def token_estimate(n_bytes: Column) -> Column:
    return F.ceil(n_bytes / 4).cast("long")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def json_path(text: Column, path: str) -> Column:
    """Dots descend into objects."""
    return F.get_json_object(text, "$" + "".join(f"['{p}']" for p in path.split(".")))
