"""Token-id files coded with a static range asymmetric numeral system.

A set of files has one shared frequency table, counted over all its ids. Files follow each other
in ascending document id order, and so do the blocks of a file and the documents of a block. A
block is independent: it holds whole documents, coded in ``LANES`` interleaved lanes (id number i
goes to lane i modulo ``LANES``), with checkpoints of all lanes' states every ``CHECK_STEPS``
steps, from which decoding can start, and a crc32 of the decoded ids.

Layout of a block (little-endian):

    magic "rANS" | u16 version | u16 lanes | u32 check steps | u32 crc32 of the table
    u32 documents | u64 ids | u64 words | u32 checkpoints | u32 crc32 of the ids as 32-bit integers
    documents x i64 document ids | documents x u8 (1: the id is null) | documents x u64 counts of ids
    checkpoints x (u64 words before it, lanes x u64 states) | words x u32

Blocks are rows of a Parquet folder (file, block, first: ids of the file before the block, n_ids,
n_docs, payload), so that any store Spark knows can hold them; ``table.parquet`` beside it has the
frequency table. Null texts are empty; every document has at least its end id; rows that repeat a
document id are all written, in the order of their ids; an empty table gives an empty set of files;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.chunks import Block, Chunks, Table
from tabulon.llm.common import Scratch, released, slices

VERSION, LANES, CHECK_STEPS, BLOCK_IDS = 1, 1024, 128, 1 << 18
#: Frequencies add up to 2 to this power; states lie in [LOW, 2**63).
BITS, LOW = 20, 1 << 31
HEAD = struct.Struct("<4sHHIIIQQII")
#: Parts of chunks whose ids a worker keeps, about; some 250 bytes each.
TABLE_ENTRIES = 1_000_000
#: Chunks encoded in one call of the whole library, which is slower on much longer strings and on single chunks.
JOINED = 20
#: Bytes of ids of one file, about.
FILE_BYTES = 128 << 20


#: Letters that lower-casing and composition leave alone, and how the vocabulary writes their bytes.
PLAIN = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_BYTES = {b: chr(b) for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
_BYTES |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _BYTES)}
_WRITTEN = {ord(c): "".join(_BYTES[b] for b in c.encode()) for c in PLAIN if ord(c) > 127}
_PLAIN, _WORD = re.compile(r"[a-z]+|[0-9]|[!-&(-/:-@\[-`{-~]+"), re.compile(f"[{PLAIN}]+")
#: Kinds of bytes: letters, digits, other printable ASCII, ASCII that isn't cut, the rest.
_LETTER, _DIGIT, _SIGN, _ODD, _HIGH = range(5)
_KIND = np.array([_HIGH if b > 127 else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN if 32 < b < 127 and chr(b) != "'" else _ODD for b in range(256)], np.uint8)
_TAIL = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"])


def cut(chunks: pa.Array) -> Chunks:
    """Parts of chunks that are encoded apart. A chunk of printable ASCII without an apostrophe or "<|" is put in lower case and cut into runs of letters, single digits and runs of signs, as the vocabulary's pattern would; of others one mark is cut off after a letter."""
    block = Block.of(chunks)
    data, kind = block.data.copy(), _KIND[block.data]
    first = np.zeros(len(data) + 1, bool)
    first[block.bounds] = True
    starts = np.flatnonzero(first[:-1])
    if not len(starts):
        return Chunks.cut(block, first[:-1])
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    kept = np.add.reduceat(kind >= _ODD, starts) > 0
    kept[np.searchsorted(starts, special, side="right") - 1] = True
    sizes = np.diff(np.append(starts, len(data)))
    loose = ~np.repeat(kept, sizes)
    data[loose & (data >= 65) & (data <= 90)] += 32
    first[1:-1] |= loose[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    last = (starts + sizes - 1)[kept & (sizes > 1)]
    one, two = data[last - 1], data[np.maximum(last - 2, 0)]
    latin = (two == 0xC3) & (one >= 0x80) & (one <= 0xBF) & (one != 0x97) & (one != 0xB7)
    first[last[_TAIL[data[last]] & ((_KIND[one] == _LETTER) | latin)]] = True
    return Chunks.cut(Block(data, block.bounds), first[:-1])


class WordCodec:
    """Ids as the tokenizers library gives them, for a vocabulary that never joins over white space.

    Texts are cut at spaces, tabs and line feeds; each distinct chunk of a block of texts is encoded
    once, and the ids go back by position. It is cut further, and a worker keeps the ids of the parts
    that it has seen. Parts of plain letters, single digits and printable signs go to the merges directly; the
    others go through the whole library, several in one call.
    """

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.table = Table(np.uint16, entries * Table.ENTRY)
        if len(self.tok.encode("a b", add_special_tokens=False).ids) != 2 or self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("this vocabulary cannot be used chunk by chunk")
        for text in ("th\xe9", "a+&b", "x7"):
            if [t.id for c in re.findall(r"[^\W\d]+|\d|\W+", text) for t in self.tok.model.tokenize(c.translate(_WRITTEN))] != self.tok.encode(text, add_special_tokens=False).ids:
                raise ValueError("this vocabulary writes letters or cuts words otherwise")

    def _whole(self, chunks: list[str]) -> list[list[int]]:
        """Through the whole library, several in one call."""
        out = []
        for k in range(0, len(chunks), JOINED):
            part = chunks[k : k + JOINED]
            ends = np.cumsum([len(c) + 1 for c in part])
            e = self.tok.encode("\n".join(part), add_special_tokens=False)
            ends = np.searchsorted(np.array([a for a, _ in e.offsets], np.int64), ends).tolist()
            out += [e.ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _merge(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        merge, ids, later = self.tok.model.tokenize, [], []
        for k, c in enumerate(chunks):
            if _PLAIN.fullmatch(c) and "<|" not in c:
                ids.append([t.id for t in merge(c)])
            elif _WORD.fullmatch(c):
                ids.append([t.id for t in merge(c.translate(_WRITTEN))])
            else:
                ids.append(None)
                later.append(k)
        for k, found in zip(later, self._whole([chunks[k] for k in later]), strict=True):
            ids[k] = found
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint16, int(sizes.sum())), sizes

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        chunks = Chunks.split(texts, " \t\n")
        ids, sizes = self.table.ids(cut(chunks.distinct), self._merge)
        return chunks.spread(ids, np.cumsum(sizes) - sizes, sizes)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 16-bit integers."""
        ids, counts = self.arrays(pa.array(texts, pa.large_string()))
        ends = np.cumsum(counts)
        return [ids[a:b].astype("<u2").tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]


@functools.lru_cache(maxsize=1)
def codec(path: str) -> WordCodec:
    """The one of this worker, which keeps its table from task to task."""
    return WordCodec(path)


def tokenize(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids binary (16-bit little-endian, the end id appended), counts null; and last in each partition a row with nothing but counts: its symbols and how often each occurs, as 64-bit integers."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total = codec(path), np.zeros(1 << 16, np.int64)
        for batch in slices(batches):
            ids, counts = coder.arrays(batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            total += np.bincount(ids, minlength=1 << 16)
            ends = np.concatenate([[0], 2 * np.cumsum(counts + 1)]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), binary, pa.nulls(len(counts), pa.binary())], names=["id", "ids", "counts"])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.stack([at, total[at]]).astype("<i8").tobytes()], pa.binary())], names=["id", "ids", "counts"])

    return rows.mapInArrow(run, "id long, ids binary, counts binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs, over all rows: 65,536 counts at most come to the driver."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                at, n = np.frombuffer(x, "<i8").reshape(2, -1)
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["symbol", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for r in tokens.where("counts IS NOT NULL").select("counts").mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        counts[r["symbol"]] = r["n"]
    return counts


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**BITS, at least 1 for each id that occurs."""
    f, total = np.zeros(len(counts), np.int64), int(counts.sum())
    if total:
        used = counts > 0
        spare = (1 << BITS) - int(used.sum())
        f[used] = 1 + (counts[used].astype(object) * spare // total).astype(np.int64)
        f[int(np.argmax(f))] += (1 << BITS) - int(f.sum())
    return f


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    def encode(self, docs: list[tuple[int | None, bytes]]) -> bytes:
        """One block of (document id, ids as 16-bit integers)."""
        ids = np.frombuffer(b"".join(x for _, x in docs), "<u2")
        if not np.all(self.freq[ids] > 0):
            raise ValueError("an id that the shared table lacks")
        x, words, checks, n_words = np.full(LANES, LOW, np.uint64), [], [], 0
        steps = -(-len(ids) // LANES)
        for t in range(steps - 1, -1, -1):
            s = ids[t * LANES : (t + 1) * LANES]
            f, v = self.freq[s], x[: len(s)]
            full = v >= f << np.uint64(63 - BITS)
            if full.any():
                words.append((v[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                n_words += len(words[-1])
                v[full] >>= np.uint64(32)
            q = v // f
            v[:] = (q << np.uint64(BITS)) + (v - q * f) + self.start[s]
            if t % CHECK_STEPS == 0:
                checks.append((n_words, x.astype("<u8").tobytes()))
        stream = np.concatenate(words[::-1]).tobytes() if words else b""
        head = HEAD.pack(b"rANS", VERSION, LANES, CHECK_STEPS, self.crc, len(docs), len(ids), n_words, len(checks), zlib.crc32(ids.astype("<u4").tobytes()))
        index = np.array([i or 0 for i, _ in docs], "<i8").tobytes() + bytes(i is None for i, _ in docs) + np.array([len(x) // 2 for _, x in docs], "<u8").tobytes()
        return head + index + b"".join(struct.pack("<Q", n_words - after) + x for after, x in reversed(checks)) + stream

    def parse(self, block: bytes) -> dict:
        magic, version, lanes, every, table, n_docs, n_ids, n_words, n_checks, crc = HEAD.unpack_from(block)
        if magic != b"rANS" or version != VERSION or table != self.crc:
            raise ValueError("not a block of this table")
        at = HEAD.size
        doc_ids = np.frombuffer(block, "<i8", n_docs, at)
        null = np.frombuffer(block, "u1", n_docs, at + 8 * n_docs)
        counts = np.frombuffer(block, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        at += 17 * n_docs
        checks = [(struct.unpack_from("<Q", block, at + k * 8 * (lanes + 1))[0], np.frombuffer(block, "<u8", lanes, at + k * 8 * (lanes + 1) + 8)) for k in range(n_checks)]
        words = np.frombuffer(block, "<u4", n_words, at + n_checks * 8 * (lanes + 1))
        return {"docs": [None if z else int(i) for i, z in zip(doc_ids, null, strict=True)], "counts": counts, "n_ids": n_ids, "lanes": lanes, "every": every, "checks": checks, "words": words, "crc": crc}

    def decode_from(self, b: dict, check: int) -> np.ndarray:
        """The ids between one checkpoint and the next; parts can be decoded apart."""
        at, x = b["checks"][check][0], b["checks"][check][1].astype(np.uint64)
        first, lanes, mask, low = check * b["every"], b["lanes"], np.uint64((1 << BITS) - 1), np.uint64(LOW)
        n = min(b["n_ids"], (first + b["every"]) * lanes) - first * lanes
        out = np.empty(n, np.uint16)
        for t in range(0, n, lanes):
            v = x[: min(lanes, n - t)]
            slot = v & mask
            s = self.symbol[slot]
            out[t : t + len(s)] = s
            v[:] = self.freq[s] * (v >> np.uint64(BITS)) + slot - self.start[s]
            short = v < low
            k = int(short.sum())
            if k:
                v[short] = v[short] << np.uint64(32) | b["words"][at : at + k]
                at += k
        return out

    def decode(self, block: bytes) -> list[tuple[int | None, bytes]]:
        """(document id, ids as little-endian 32-bit integers); the checksum is compared."""
        b = self.parse(block)
        parts = [self.decode_from(b, k) for k in range(len(b["checks"]))]
        raw = np.concatenate(parts).astype("<u4").tobytes() if parts else b""
        if zlib.crc32(raw) != b["crc"]:
            raise ValueError("the block's checksum differs")
        ends = np.cumsum(b["counts"]) * 4
        return [(i, raw[e - 4 * n : e]) for i, n, e in zip(b["docs"], b["counts"].tolist(), ends.tolist(), strict=True)]


def write(tokens: DataFrame, path: str, n_files: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Write what ``tokenize`` gives as a set of files below ``path``, in ascending order of id.

    tokens should be a saved table: it is read twice, its counts for the frequency table and its ids for the blocks.
    """
    spark = tokens.sparkSession
    counts = count_ids(tokens)
    freq = frequencies(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq.tolist()) if f], "symbol int, freq int").coalesce(1).write.parquet(f"{path}/table.parquet")
    files = n_files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) * 2 // FILE_BYTES)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, file, block, first, held, n = Coder(freq), TaskContext.get().partitionId(), 0, 0, [], 0

        def row():
            return pa.RecordBatch.from_pydict({"file": [file], "block": [block], "first": [first], "n_ids": [n], "n_docs": [len(held)], "payload": [coder.encode(held)]}, schema=kind)

        kind = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for i, x in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if held and n + len(x) // 2 > block_ids:
                    yield row()
                    block, first, held, n = block + 1, first + n, [], 0
                held.append((i, x))
                n += len(x) // 2
        if held:
            yield row()

    # Equal ids may be very many: a digest of the content spreads them over neighbouring files.
    ordered = tokens.where("counts IS NULL").select("id", "ids").withColumn("tie", F.xxhash64("ids")).repartitionByRange(files, "id", "tie").sortWithinPartitions("id", "tie").select("id", "ids")
    ordered.mapInArrow(run, "file int, block int, first long, n_ids long, n_docs long, payload binary").write.parquet(f"{path}/blocks.parquet")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a set of files: id, start (ids before it in the whole set), n_tokens, ids binary (32-bit little-endian)."""
    freq = np.zeros(1 << 16, np.int64)
    for r in spark.read.parquet(f"{path}/table.parquet").collect():
        freq[r["symbol"]] = r["freq"]
    blocks = spark.read.parquet(f"{path}/blocks.parquet")
    # One row for each file of about FILE_BYTES: the only thing that is summed in one place.
    sizes, base = sorted(map(tuple, blocks.groupBy("file").agg(F.sum("n_ids")).collect())), 0
    bases = []
    for file, n in sizes:
        bases.append((file, base))
        base += n
    rows = blocks.join(spark.createDataFrame(bases, "file int, base long"), "file").select((F.col("base") + F.col("first")).alias("start"), "payload")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                docs = coder.decode(payload)
                n = np.array([len(x) // 4 for _, x in docs], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array([x for _, x in docs], pa.binary())], names=["id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def write_documents(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise and write; ids are saved in between, so texts are encoded once."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write(scratch.save(tokenize(docs, tokenizer, end_id, id_col, text_col), "ids"), path)
    scratch.drop("ids")
