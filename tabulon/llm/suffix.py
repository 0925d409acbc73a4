"""Suffix-array dedup of long repeated byte strings, over a logarithmic family of levels.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (in a document of
smaller id, or earlier in the same one) is removed; strings overlap freely, are judged on the
input as it came, and never cross documents.

Sorting all suffixes would move every byte a hundred times, so the suffix arrays are sparse. Each
string of ``LENGTH`` bytes has an anchor, the place inside it whose ``GRAM`` bytes hash smallest;
equal strings have their anchors at the same place. Consecutive strings with one anchor are an
entry: the anchor's hash, a digest of all the bytes that those strings span, and where they are. A
suffix array lists entries by hash and digest, one for each, the earliest; like any suffix array it
holds places, not text. Batches of documents come in id order:

1. A new batch gets its suffix array.
2. Existing levels are merge-scanned with it: an entry that a level or an earlier place of the
   batch has is repeated as a whole. Only entries that no level has go into the new level.
3. Before the next batch, levels of equal size merge, so that there are logarithmically many.

Entries that share an anchor but not all bytes (at the ends of repeated passages) are compared
string by string on the text itself, in sorted runs of about ``MANY`` entries. An anchor with more
of them takes several runs; the strings that each run has first meet by their digests, so that no
group has to fit a task, and what is repeated within a run stays there.

Null texts are empty; texts shorter than ``LENGTH`` stay whole. Rows equal in id and text are one
document to each other. Rows that repeat an id with other texts are ordered by their checksum; a
null id comes before all others. An empty table gives an empty result. Columns other than id and text
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, released, slices

LENGTH, GRAM = 100, 24
#: Batches that a table is taken in, and entries of one anchor that are compared in one run.
BATCHES, MANY = 4, 4096

_POSITION = np.uint64((1 << 23) - 1)
_MULTIPLIER = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(100).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NULL_ID = -(1 << 63)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_MULTIPLIER, n, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h = _TABLE[data]
    for n in (1, 2, 4):
        h = h[:-n] * _power(n) + h[n:]
    both = h[:-8] * _power(8) + h[8:]
    out = both[: len(data) - GRAM + 1] * _power(8) + h[16 : len(data) - GRAM + 17]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        key, n = np.minimum(key[:-n], key[n:]), 2 * n
    return np.minimum(key[: len(key) - (width - n)], key[width - n :]) if width > n else key


def entries(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all texts at once: arrays (text number, first string's start, strings, anchor's distance from that start, anchor's hash), and the digests."""
    import xxhash

    raw = b"".join(texts)
    size = np.array([len(t) for t in texts], np.int64)
    if not len(size) or size.max() < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    data = np.frombuffer(raw, np.uint8)
    if len(data) > int(_POSITION):
        raise ValueError("too many bytes at once")
    hashes = gram_hashes(data)
    least = _sliding_least((hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64), LENGTH - GRAM + 1) & _POSITION
    number = np.repeat(np.arange(len(size), dtype=np.int32), size)
    begin = np.cumsum(size) - size
    at = np.flatnonzero(number[: len(data) - LENGTH + 1] == number[LENGTH - 1 :])
    of, anchor = number[at], least[at].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])]))
    count = np.diff(np.append(new, len(at)))
    start, of, anchor = at[new], of[new].astype(np.int64), anchor[new]
    digest, view = xxhash.xxh3_64_intdigest, memoryview(raw)
    digests = np.array([digest(view[a:b]) for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)], np.uint64)
    return of, start - begin[of], count, anchor - start, hashes[anchor].view(np.int64), digests.view(np.int64)


#: The bytes that are looked at in one go; longer texts are cut into overlapping parts.
PART_BYTES = 1_500_000


def parts(raw: bytes, most: int = PART_BYTES) -> list[tuple[int, bytes]]:
    """Overlapping parts of a text so that each string of LENGTH bytes lies in exactly one."""
    return [(a, raw[a : a + most + LENGTH - 1]) for a in range(0, max(1, len(raw) - LENGTH + 1), most)]


@released
def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held):
        of, a, n, off, h, c = entries([t for _, _, _, t in held])
        ids, subs, shift = (np.array([x[k] for x in held], np.int64) for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(ids[of]), pa.array(subs[of]), pa.array(a + shift[of]), pa.array((n << 8 | off).astype(np.int32))], names=["h", "c", "id", "sub", "a", "shape"])

    for batch in slices(batches, most=PART_BYTES):
        held, size = [], 0
        for i, sub, text in zip(batch.column("id").to_pylist(), batch.column("sub").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for a, part in parts(raw) if len(raw) >= LENGTH else []:
                if size + len(part) > PART_BYTES + LENGTH and held:
                    yield out(held)
                    held, size = [], 0
                held.append((i, sub, a, part))
                size += len(part)
        if held:
            yield out(held)


ENTRY = "h long, c long, id long, sub long, a long, shape int"


class Family:
    """The levels: saved tables of entries, one row for each (h, c), the earliest; ordered by both within partitions."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.made = scratch, [], 0  # (rank, name, table)

    def _save(self, df: DataFrame) -> tuple[str, DataFrame]:
        self.made += 1
        name = f"level-{self.made}"
        return name, self.scratch.save(df, name)

    def merge(self) -> None:
        """Merge the two smallest levels while they are of equal rank."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a, x), (_, b, y) = self.levels.pop(), self.levels.pop()
            name, both = self._save(x.unionByName(y).repartition("h").sortWithinPartitions("h", "c"))
            for old in (a, b):
                self.scratch.drop(old)
            self.levels.append((rank + 1, name, both))

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: saved entries later than all before. (id, sub, a, n): repeated runs of strings."""
        self.merge()
        place = F.struct("id", "sub", "a")
        # The batch's suffix array: sorted by hash and digest, the earliest place of each.
        own = batch.groupBy("h", "c").agg(F.min(F.struct("id", "sub", "a", "shape")).alias("e"), F.count(F.lit(1)).alias("copies"))
        for k, (_, _, level) in enumerate(self.levels):
            own = own.join(level.select("h", "c", F.lit(True).alias(f"in{k}")), ["h", "c"], "left")
        known = F.coalesce(*[F.col(f"in{k}") for k in range(len(self.levels))], F.lit(False))
        self.made += 1
        scanned, name = f"scanned-{self.made}", ""
        own = self.scratch.save(own.select("h", "c", "e.*", "copies", known.alias("known")).sortWithinPartitions("h", "c"), scanned)
        name, fresh = self._save(own.where("NOT known").select("h", "c", "id", "sub", "a", "shape"))
        self.levels.append((0, name, fresh))
        repeated = own.where("known OR copies > 1").select("h", "c", "known", F.struct("id", "sub", "a").alias("first"))
        later = batch.join(repeated, ["h", "c"]).where(F.col("known") | (place != F.col("first")))
        later = self.scratch.save(later.select("id", "sub", "a", F.shiftright("shape", 8).alias("n")), f"later-{self.made}")
        self.scratch.drop(scanned)
        return later

    def entries(self) -> DataFrame:
        out = self.levels[0][2]
        for _, _, level in self.levels[1:]:
            out = out.unionByName(level)
        return out


@released
def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that entries span, of the documents that have such entries."""
    for batch in slices(batches, most=1_000_000):
        out: dict[str, list] = {k: [] for k in ("h", "runs", "id", "sub", "a", "n", "bytes")}
        for i, sub, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "sub", "text", "wanted")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                n = w["shape"] >> 8
                for k, v in zip(out, (w["h"], w["runs"], i, sub, w["a"], n, raw[w["a"] : w["a"] + n + LENGTH - 1]), strict=True):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("h", pa.int64()), ("runs", pa.int32()), ("id", pa.int64()), ("sub", pa.int64()), ("a", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())]))


def _runs(flags: list[bool]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(flags):
        end = at
        while end < len(flags) and flags[end] == flags[at]:
            end += 1
        if flags[at]:
            yield at, end - at
        at = end


@released
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of run, then of place: the strings that an earlier entry of the same run has, and, where an anchor has several runs, the digests of the others."""
    import xxhash

    now, seen = None, set()
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            out: dict[str, list] = {k: [] for k in ("digest", "id", "sub", "a", "n")}
            for h, runs, run, i, sub, a, n, raw in zip(*(whole.slice(at, 2000).column(c).to_pylist() for c in ("h", "runs", "run", "id", "sub", "a", "n", "bytes")), strict=True):
                if (h, run) != now:
                    now, seen = (h, run), set()
                strings = [raw[k : k + LENGTH] for k in range(n)]
                old = []
                for x in strings:  # an entry can hold a string twice
                    old.append(x in seen)
                    seen.add(x)
                rows = [(None, k, m) for k, m in _runs(old)]
                if runs > 1:
                    rows += [(xxhash.xxh3_128_digest(x), k, 1) for k, (x, o) in enumerate(zip(strings, old, strict=True)) if not o]
                for digest, k, m in rows:
                    for name, v in zip(out, (digest, i, sub, a + k, m), strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("digest", pa.binary()), ("id", pa.int64()), ("sub", pa.int64()), ("a", pa.int64()), ("n", pa.int32())]))


def partial_matches(docs: DataFrame, index: DataFrame, scratch: Scratch, many: int = MANY) -> DataFrame:
    """(id, sub, a, n): repeated strings in entries that share an anchor with others, but not all bytes."""
    anchors = index.groupBy("h").agg(F.count(F.lit(1)).alias("n_entries")).where("n_entries > 1").select("h", F.ceil(F.col("n_entries") / many).cast("int").alias("runs"))
    wanted = index.join(anchors, "h").groupBy("id", "sub").agg(F.collect_list(F.struct("h", "runs", "a", "shape")).alias("wanted"))
    spans = "h long, runs int, id long, sub long, a long, n int, bytes binary"
    found = docs.join(wanted, ["id", "sub"]).select("id", "sub", "text", "wanted").mapInArrow(_with_bytes, spans)
    found = found.withColumn("run", F.pmod(F.xxhash64("id", "sub"), F.col("runs"))).repartition("h", "run").sortWithinPartitions("h", "run", "id", "sub", "a")
    compared = scratch.save(found.mapInArrow(_compare, "digest binary, id long, sub long, a long, n int"), "compared")
    single, place = compared.where("digest IS NOT NULL"), F.struct("id", "sub", "a")
    firsts = single.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rest = single.join(firsts, "digest").where(place != F.col("first")).select("id", "sub", "a", "n")
    return scratch.save(compared.where("digest IS NULL").select("id", "sub", "a", "n").unionByName(rest), "partial-later")


def merge_spans(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges that runs of strings (start, strings) cover, merged."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(runs):
        end = a + n + LENGTH - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((a, end))
    return out


@released
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n_bytes, spans, kept = [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            found = merge_spans([(r["a"], r["n"]) for r in runs]) if runs else []
            left, at = [], 0
            for a, b in found:
                left.append(raw[at:a])
                at = b
            n_bytes.append(len(raw))
            spans.append([{"start": a, "end": b} for a, b in found])
            kept.append(b"".join([*left, raw[at:]]))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(n_bytes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def dedup(docs: DataFrame, batches: int = BATCHES, many: int = MANY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, n_bytes, spans (removed byte ranges array<struct<start,end>>), kept (the bytes that remain)."""
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).cast("string").alias("text"))
    n, ids = docs.agg(F.count(F.lit(1)), F.countDistinct(id_col)).first()
    # Where each id has one row, nothing else is needed to tell documents apart.
    sub = F.crc32(F.coalesce("text", F.lit("")).cast("binary")) if n != ids else F.lit(0).cast("long")
    rows = rows.withColumn("id", F.coalesce("own", F.lit(NULL_ID))).withColumn("sub", sub)
    cuts = sorted(set(rows.select("id").approxQuantile("id", [k / batches for k in range(1, batches)], 0.01))) if n and batches > 1 else []
    bounds = [None, *(int(c) for c in cuts), None]
    family, later = Family(scratch), []
    for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = rows if low is None else rows.where(F.col("id") > low)
        part = part if high is None else part.where(F.col("id") <= high)
        batch = scratch.save(part.select("id", "sub", "text").mapInArrow(_entries, ENTRY), f"batch-{k}")
        later.append(family.add(batch))
        scratch.drop(f"batch-{k}")
    later.append(partial_matches(rows.select("id", "sub", "text").dropDuplicates() if n != ids else rows.select("id", "sub", "text"), family.entries(), scratch, many))
    runs = later[0]
    for x in later[1:]:
        runs = runs.unionByName(x)
    runs = scratch.save(runs.groupBy("id", "sub").agg(F.collect_set(F.struct("a", "n")).alias("runs")), "runs")
    scratch.keep("runs")
    both = rows.join(runs.hint("merge"), ["id", "sub"], "left").select("own", "text", "runs")
    out = both.mapInArrow(_cut, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
