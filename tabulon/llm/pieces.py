"""SentencePiece encoding and decoding through a table of distinct chunks.

In a model where no piece has another character before a whitespace marker, pieces never cross
the place before a marker; the same holds around any character that occurs in no piece of two
or more characters, such as the line feed here. The marked text is cut at those places. Each
distinct chunk of a block of texts is segmented once, and the ids go back by position. A worker
keeps the table between blocks, up to ``TABLE_ENTRIES`` chunks, and then starts it anew.

Null texts are empty; an empty text has no ids; repeated rows each give a row; extra columns are
ignored; an empty table gives an empty result. Whole texts are encoded, whatever their length.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.chunks import Block, Chunks, Table, gathered
from tabulon.llm.common import released, slices

MARK = "▁"
#: Chunks that a worker keeps, about; some 300 bytes each.
TABLE_ENTRIES = 100_000
#: Chunks segmented in one call.
JOINED = 100


class ChunkCodec:
    """Encodes and decodes exactly as the library does with this model."""

    def __init__(self, model: str, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("this model has pieces across whitespace markers: chunks cannot be encoded apart")
        # A line feed that is in no piece never merges with its neighbours.
        self.lead, self.mark = "" if any("\n" in p for p in pieces) else "\n", [self.sp.piece_to_id(MARK)]
        self.led = len(self.sp.encode(self.lead)) if self.lead else 0
        self.table = Table(np.int32, entries * Table.ENTRY)
        # What each id stands for, in bytes, and whether a marker begins it.
        shown = [bytes([int(p[3:-1], 16)]) if self.sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size = np.array([len(x) for x in shown], np.int64)
        self.start, self.shown = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(shown), np.uint8)
        self.marked = np.array([p.startswith(MARK) for p in pieces])

    def cut(self, texts: pa.Array) -> Chunks:
        """Chunks begin at runs of spaces, which stand for markers here, and at runs of line feeds and after them. A space goes before each text that isn't empty."""
        block = Block.of(pa.compute.replace_substring(texts, MARK, " "))
        used = np.diff(block.bounds) > 0
        data = np.insert(block.data, block.bounds[:-1][used], 32)
        bounds = block.bounds + np.concatenate([[0], np.cumsum(used)])
        space, feed = data == 32, data == (10 if self.lead else 0xFF)
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        first[1:-1] |= (space[1:] & ~space[:-1]) | (feed[1:] & ~feed[:-1]) | (feed[:-1] & ~feed[1:])
        return Chunks.cut(Block(data, bounds), first[:-1])

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Segment chunks, each once. Those of one marker and more go in one call, as each of their first pieces, and no other, begins with a marker."""
        ids, sizes, apart = [], np.zeros(len(chunks), np.int64), []
        joined = [k for k, c in enumerate(chunks) if c[0] == " " and c[1:2].strip(" ")]
        for k in range(0, len(joined), JOINED):
            ids.append(np.array(self.sp.encode("".join([chunks[i] for i in joined[k : k + JOINED]])[1:], num_threads=1), np.int32))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        first = np.flatnonzero(self.marked[flat])
        sizes[joined] = np.diff(np.append(first, len(flat)))
        # The library puts a marker before what it encodes: it stands for a chunk's first one, or goes with the lead.
        apart = sorted(set(range(len(chunks))).difference(joined))
        found = self.sp.encode([c[1:] if c[0] == " " else self.lead + c for c in (chunks[i] for i in apart)], num_threads=1)
        found = [x or self.mark if chunks[i][0] == " " else x[self.led :] for i, x in zip(apart, found, strict=True)]
        sizes[apart] = [len(x) for x in found]
        out, alone = np.zeros(int(sizes.sum()), np.int32), np.ones(len(chunks), bool)
        alone[joined] = False
        mask = np.repeat(alone, sizes)
        out[~mask], out[mask] = flat, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(mask.sum()))
        return out, sizes

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The ids of all texts one after the other, how many each has, and the texts that they decode to: what their pieces show, without the first marker."""
        ids, counts = self.table.ids(self.cut(texts), self._learn)
        size, after = self.size[ids], np.cumsum(counts)
        shown = gathered(self.shown, self.start[ids], size)
        bounds = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], after])]
        gone = np.zeros(len(shown) + 1, bool)
        gone[bounds[:-1]] = counts > 0
        left = Block(shown, bounds).without(gone[:-1])
        return ids, counts, pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(left.bounds.astype(np.int64)), pa.py_buffer(left.data)])

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """The ids of each text as little-endian 32-bit integers, and the text that they decode to."""
        ids, counts, back = self.arrays(pa.array(texts, pa.large_string()))
        ends = np.cumsum(counts)
        return [ids[a:b].astype("<i4").tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)], back.to_pylist()


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ids array<int>, decoded string (what the library's decode gives for the ids). An empty table gives none."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model)
        for batch in slices(batches, most=1_000_000):
            ids, counts, back = codec.arrays(batch.column("text"))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), back.cast(pa.string())], names=["id", "ids", "decoded"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id arrays from anywhere, by the library's decode; null arrays are empty."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            text = sp.decode([x or [] for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(text, pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
