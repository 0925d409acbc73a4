r"""Line dedup over overlapping three-line windows.

Lines are what lies between line feeds. Lines of blanks (space, tab, carriage return) only don't
count; every three consecutive lines that count, trimmed of blanks, make a window. A window whose
lines also make an earlier window (smaller id, or same document and earlier line) covers the lines
from its first to its last, blank ones between them included. Covered lines go, overlaps merged.

Null texts stay null and have no lines; texts of fewer than three lines that count stay as they
are. Rows that repeat an id are told apart by their text and ordered by its hash; rows equal in
both are one document to each other: neither removes the other's lines. Columns other than id and
text pass through untouched, whatever their names. An empty table gives an empty result.

Windows are cut once and saved as 16-byte digests with places, never as lines. Digests are counted with a partial
aggregate before the shuffle, so a window with very many copies is one row there; the join that
flags later copies is an ordinary sort-merge join, whose large partitions Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import Scratch, released, slices

BLANKS = " \t\r"
WINDOW = 3


def _windows(text: Column) -> Column:
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANKS)).alias("t")))
    lines = F.filter(numbered, lambda x: x["t"] != "")
    parts = [lines if k == 0 else F.slice(lines, F.lit(k + 1), F.greatest(F.size(lines), F.lit(0))) for k in range(WINDOW)]
    zipped = F.filter(F.arrays_zip(*[p.alias(f"w{k}") for k, p in enumerate(parts)]), lambda z: z[f"w{WINDOW - 1}"].isNotNull())
    return F.transform(zipped, lambda z: F.struct(z["w0"]["i"].alias("s"), z[f"w{WINDOW - 1}"]["i"].alias("e"), F.unhex(F.md5(F.concat_ws("\n", *[z[f"w{k}"]["t"] for k in range(WINDOW)]))).alias("digest")))


def repeated(docs: DataFrame) -> DataFrame:
    """docs: id, h, text. (id, h, cuts array<struct<s,e>>) of documents with windows that occurred earlier."""
    scratch = Scratch(docs.sparkSession, "lines")
    w = scratch.save(docs.select("id", "h", F.explode(_windows(F.col("text"))).alias("w")).select("id", "h", "w.s", "w.e", "w.digest"), "windows")
    firsts = w.groupBy("digest").agg(F.min(F.struct("id", "h", "s")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = w.join(firsts, "digest").where(~F.struct("id", "h", "s").eqNullSafe(F.col("first")))
    cuts = scratch.save(later.groupBy("id", "h").agg(F.collect_set(F.struct("s", "e")).alias("cuts")), "cuts")
    scratch.keep("cuts")
    return cuts


def cut_lines(text: str, cuts: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without those ranges of lines, and the number of lines removed."""
    lines, kept, at, gone = text.split("\n"), [], 0, 0
    for s, e in sorted(cuts):
        if e < at:
            continue
        kept.extend(lines[at : max(s, at)])
        gone += e + 1 - max(s, at)
        at = e + 1
    kept.extend(lines[at:])
    return "\n".join(kept), gone


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows: rest struct (the other columns), id, text (without the covered lines), n_lines, n_removed."""
    others = [f.name for f in docs.schema if f.name not in (id_col, text_col)]
    rest = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in others]) if others else F.struct(F.lit(None).cast("string").alias("none"))
    rows = docs.select(rest.alias("rest"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    # One plan at every size: the cuts grow with the table.
    cuts = repeated(rows.select("id", "h", "text")).withColumnsRenamed({"id": "id2", "h": "h2"}).hint("merge")
    both = rows.join(cuts, rows["id"].eqNullSafe(cuts["id2"]) & (rows["h"] == cuts["h2"]), "left").select("rest", "id", "text", "cuts")
    schema = T.StructType([*both.schema.fields[:3], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, n, gone = [], [], []
            for t, c in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                n.append(0 if t is None else t.count("\n") + 1)
                left, k = cut_lines(t, [(x["s"], x["e"]) for x in c]) if c else (t, 0)
                text.append(left)
                gone.append(k)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("id"), pa.array(text, batch.schema.field("text").type), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["rest", "id", "text", "n_lines", "n_removed"])

    return both.mapInArrow(run, schema)


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
     s AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
     w AS (SELECT doc_id, pos AS a, lead(pos, 2) OVER o AS b, t || chr(10) || lead(t, 1) OVER o || chr(10) || lead(t, 2) OVER o AS k FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
     d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, a) AS rn FROM w WHERE b IS NOT NULL),
     c AS (SELECT DISTINCT l.doc_id, l.pos FROM l JOIN d ON l.doc_id = d.doc_id AND l.pos BETWEEN d.a AND d.b WHERE d.rn > 1)
SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
"""
