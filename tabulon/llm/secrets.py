r"""Secret scanning with assignment-aware lexing.

Two layers over every whole text:

* Base patterns, leftmost and non-overlapping per kind: ``assign`` (a sensitive name, ``:`` or
  ``=``, and a value of 8 or more characters), ``access`` (``AKIA`` and 16 or more characters in
  all), ``hex`` (32 or more characters). Failing matches still use up their text.
* Lexed assignments (``llm/lexing.py``): names and the literals that they are given, constants
  followed. A literal's score adds how sensitive its target's name is to how much the literal looks
  like a key; from ``THRESHOLD`` on it is a span of kind ``literal``.

Spans are in code points, the end exclusive, sorted by start, then kind in the order assign,
access, hex, literal. A literal that a base span covers isn't reported again. Null texts are
empty; repeated rows each give a row; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import released, slices
from tabulon.llm.lexing import lex

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 2.0


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")])
ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal either way; shorter ones fail

#: How sensitive the words of a target's name are.
SENSITIVE = {
    "password": 2.0, "passwd": 2.0, "passphrase": 2.0, "pwd": 1.5, "pass": 1.0, "secret": 2.0, "token": 1.5, "apikey": 2.0, "credential": 2.0, "credentials": 2.0,
    "private": 1.0, "key": 1.0, "api": 0.5, "access": 0.5, "auth": 1.0, "bearer": 1.5, "signing": 1.0, "encryption": 1.0, "salt": 0.5, "client": 0.25,
}
HARMLESS = re.compile(r"(?i)^(?:(?:x|\*|\.|-|_|0)+|your.*|example.*|changeme|change_me|placeholder|none|null|nil|true|false|undefined|default|todo|<.*>|\$\{.*\}|%.*%|\{\{.*\}\}|https?://\S*|password|secret|token)$")

_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: A text without any of these has no sensitive name.
_SOME = re.compile("|".join(sorted({w[:3] for w in SENSITIVE})), re.I)


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORD.findall(name)]
    joined = [a + b for a, b in zip(words, words[1:], strict=False)]
    return sum(SENSITIVE.get(w, 0) for w in {*words, *joined})


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def literal_score(text: str) -> float:
    """From -4 for what is certainly no key to 1 for what looks like one."""
    if len(text) < 6 or HARMLESS.match(text) or any(c.isspace() for c in text):
        return -4.0
    kinds = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return (0.5 if entropy(text) >= 3 else 0.0) + (0.5 if kinds >= 3 else 0.25 if kinds == 2 else 0.0)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else []
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Literals that a sensitive name is given, directly or through constants."""
    if not _SOME.search(text):
        return []
    found: dict[tuple[int, int], float] = {}
    for name, places in lex(text):
        if (score := name_score(name)) > 0:
            score += literal_score("".join(text[a:b] for a, b in places))
            for p in places:
                found[p] = max(score, found.get(p, 0.0))
    return [p for p, score in found.items() if score >= THRESHOLD and p[0] < p[1]]


def spans(text: str) -> list[dict]:
    base = base_spans(text)
    taken = sorted((a, b) for a, b, _ in base)
    out = [(a, KINDS.index(k), b, True) for a, b, k in base]
    reach, i = 0, 0
    for a, b in sorted(lexed_spans(text)):
        while i < len(taken) and taken[i][0] <= a:
            reach, i = max(reach, taken[i][1]), i + 1
        if b > reach:
            out.append((a, 3, b, False))
    return [{"kind": KINDS[k], "start": a, "end": b, "base": x} for a, k, b, x in sorted(out)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and spans array<struct<kind,start,end,base>>. One pass, without a shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [spans(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], names=["id", "spans"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,base:boolean>>").withColumnRenamed("id", id_col)
