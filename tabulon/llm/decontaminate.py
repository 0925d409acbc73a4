"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words: A-Z lower-cased, words are runs of digits, letters a-z and
everything outside ASCII. Each item gives windows of ``window`` consecutive words (an item of
fewer words is one window). All windows enter one automaton over numbered words, so that a match
begins and ends at word bounds; each document is scanned once, and matched words are mapped back to
offsets in the original text.

Null and word-less texts have no words and no hits; null or word-less items give no window; an item
without an id hits, but isn't listed; repeated items and repeated rows each count for themselves.
An empty table gives an empty result, an empty benchmark no hits. All columns of ``scan_rows`` pass
through, whatever their names.

An automaton's size is bounded by ``BLOCK_BYTES`` of items. A benchmark of more takes several, which
a task goes through for every ``HOLD_BYTES`` of texts, so texts are still read once; a worker keeps
the automaton that it built last. Up to ``PASS_BYTES`` of items go out with one job, and only that
much is on the driver at any time; beyond it there is another pass over the texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import Scratch, released, slices

WINDOW = 13
#: Bytes of item texts that one automaton is built from (about 30 times that in memory), and that go out at once.
BLOCK_BYTES, PASS_BYTES = 4_000_000, 64_000_000
#: Bytes of texts that are held while several automata scan them.
HOLD_BYTES = 8_000_000

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEEP else 32 for b in range(256))
SPANS = "spans array<struct<start:int,end:int,first_word:int,n_words:int>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Matcher:
    """The automaton of some items: (id, text), the id a string or null."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], dict[str, None]] = {}
        for item, text in items:
            w = tuple(self.number.setdefault(x, len(self.number) + 1) for x in words(text))
            for i in range(max(1, len(w) - window + 1) if w else 0):
                ids = found.setdefault(w[i : i + window], {})
                if item is not None:
                    ids[item] = None
        self.least = min(map(len, found), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, ids in found.items():
            self.automaton.add_word(w, (len(w), tuple(ids)))
        if found:
            self.automaton.make_automaton()

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word intervals covered by windows, and the items found. A window lies within a run of the items' words, so shorter runs than any window needn't be looked at."""
        hits, found = [], set()
        if not self.least or len(text) < self.least:
            return hits, found
        numbers = np.fromiter(map(self.number.get, text, itertools.repeat(0)), np.int64, len(text))
        strange = np.concatenate([[-1], np.flatnonzero(numbers == 0), [len(numbers)]])
        for k in np.flatnonzero(np.diff(strange) > self.least).tolist():
            begin, end = int(strange[k]) + 1, int(strange[k + 1])
            for last, (n, ids) in self.automaton.iter(tuple(numbers[begin:end].tolist())):
                hits.append((begin + last + 1 - n, begin + last + 1))
                found.update(ids)
        return merged(hits), found


#: The matcher that this worker built last, under the digest of its items.
_LAST: dict[bytes, Matcher] = {}


def matcher(items: list[tuple[str | None, str | None]], window: int) -> Matcher:
    import xxhash

    digest = xxhash.xxh3_128()
    for item, text in items:
        for x in (item, text):
            raw = b"" if x is None else x.encode("utf-8", "surrogatepass")
            digest.update(f"{-1 if x is None else len(raw)},{window}:".encode() + raw)
    key = digest.digest()
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Matcher(items, window)
    return _LAST[key]


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(raw: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Code point offsets of word intervals."""
    import re

    out, at, chars, bounds = [], 0, 0, [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_TABLE))]
    for a, b in spans:
        start, end = bounds[a][0], bounds[b - 1][1]
        chars += len(raw[at:start].decode("utf-8", "replace"))
        n = len(raw[start:end].decode("utf-8", "replace"))
        out.append({"start": chars, "end": chars + n, "first_word": a, "n_words": b - a})
        chars, at = chars + n, end
    return out


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in slices(batches):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scanner(blocks: list[list[tuple]], window: int, first: bool, schema: pa.Schema):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = list(blocks)
        for held in _held(batches, HOLD_BYTES if len(blocks) > 1 else 1):
            texts = [words(t) for b in held for t in b.column("text").to_pylist()]
            own: list[list] = [[] for _ in texts]
            found: list[set] = [set() for _ in texts]
            for items in turn:
                m = matcher(items, window)
                for i, w in enumerate(texts):
                    hits, ids = m.scan(w)
                    own[i] += hits
                    found[i] |= ids
            turn.reverse()  # the last one built comes first
            at = 0
            for batch in held:
                counts, spans, items = [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    hits, ids = own[at], found[at]
                    if not first:
                        hits = hits + [(s["first_word"], s["first_word"] + s["n_words"]) for s in batch.column("spans")[i].as_py()]
                        ids = ids | set(batch.column("items")[i].as_py())
                    counts.append(len(texts[at]))
                    spans.append(offsets(text.encode("utf-8", "surrogatepass"), merged(hits)) if hits else [])
                    items.append(sorted(ids))
                    at += 1
                cols = [batch.column("row"), batch.column("text"), pa.array(counts, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(items, schema.field("items").type)]
                yield pa.RecordBatch.from_arrays([c for c, n in zip(cols, ("row", "text", "n_words", "spans", "items"), strict=True) if n in schema.names], schema=schema)

    return run


def item_passes(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, pass_bytes: int) -> Iterator[tuple[int, list[list[tuple]]]]:
    """How many passes follow, and the items of this one, in blocks; what a caller is done with is let go before more is read. The size is known before anything comes to the driver."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // pass_bytes) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        blocks, size = [[]], 0
        for r in part.toLocalIterator():
            size += len(r["text"] or "")
            if size > block_bytes and blocks[-1]:
                blocks.append([])
                size = len(r["text"] or "")
            blocks[-1].append((r["item"], r["text"]))
        yield n - 1 - k, blocks


def scan_rows(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """All rows: row struct (the columns as they came), n_words, spans (merged matched runs: code point offsets in the original text, first word, number of words), items (ids found, sorted as strings).

    One pass over the texts, without a shuffle, for every ``pass_bytes`` of items; usually there is one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    row, text, more = rows.schema["row"], rows.schema["text"], T._parse_datatype_string(f"n_words long, {SPANS}").fields
    scratch, first = Scratch(spark, "decontaminate"), True
    for left, blocks in item_passes(benchmark, item_col, item_text_col, block_bytes, pass_bytes):
        schema = T.StructType([row, *([text] if left else []), *more])
        arrow = spark.createDataFrame([], schema).toArrow().schema
        rows = rows.mapInArrow(_scanner(blocks, window, first, arrow), schema)
        if left:
            rows = scratch.save(rows, f"pass-{left}")
        first = False
    return rows


def scan_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: the id, then n_words, spans and items as above."""
    found = scan_rows(docs.select(id_col, text_col), benchmark, text_col=text_col, **options)
    return found.select(F.col("row")[id_col].alias(id_col), "n_words", "spans", "items")


def cut(text: Column, spans: Column) -> Column:
    """The text without those spans."""

    @F.pandas_udf("string")
    def run(t: pd.Series, spans: pd.Series) -> pd.Series:
        def one(x, found):
            kept, at = [], 0
            for s in found:
                kept.append(x[at : s["start"]])
                at = s["end"]
            return "".join([*kept, x[at:]])

        return pd.Series([x if found is None or not len(found) else one(x, found) for x, found in zip(t, spans, strict=True)])

    return run(text, spans)


def contaminated(share: float = 0.05) -> Column:
    """Whether hits make up at least ``share`` of a document's words."""
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["n_words"])
    return (n_hit > 0) & (n_hit >= F.lit(share) * F.col("n_words"))
