"""Distinct-chunk tables: texts are cut into chunks, each distinct one is encoded once, and ids go back by position.

Cutting, finding distinct chunks and putting ids in place are array operations on a block of texts;
Python sees each distinct chunk of a block once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Block:
    """The bytes of a block of texts; text i lies at bounds[i] to bounds[i + 1]."""

    data: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Block:
        """Null texts are empty."""
        column = column.cast(pa.large_string()).fill_null("")
        _, ends, data = column.buffers()
        bounds = np.frombuffer(ends, np.int64, len(column) + 1, 8 * column.offset)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(whole[bounds[0] : bounds[-1]], bounds - bounds[0])

    def without(self, gone: np.ndarray) -> Block:
        """gone: which bytes to leave out."""
        before = np.concatenate([[0], np.cumsum(gone)])
        return Block(self.data[~gone], self.bounds - before[self.bounds])


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of flat from each start on, one after the other."""
    after = np.cumsum(size)
    place = np.repeat(start - (after - size), size)
    place += np.arange(len(place))
    return flat[place]


@dataclass
class Chunks:
    """Where the chunks of a block are: ``of[counts so far]`` numbers its distinct chunks."""

    distinct: pa.Array
    of: np.ndarray
    counts: np.ndarray

    @classmethod
    def split(cls, texts: pa.Array, gaps: str) -> Chunks:
        """What lies between any of these characters, empty chunks too."""
        texts = texts.cast(pa.large_string()).fill_null("")
        for c in gaps[1:]:
            texts = pa.compute.replace_substring(texts, c, gaps[0])
        parts = pa.compute.split_pattern(texts, gaps[0])
        found = parts.flatten().dictionary_encode()
        return cls(found.dictionary, found.indices.to_numpy(), parts.value_lengths().to_numpy())

    @classmethod
    def cut(cls, block: Block, first: np.ndarray) -> Chunks:
        """first: which bytes begin a chunk."""
        starts = np.flatnonzero(first)
        ends = np.append(starts, len(block.data)).astype(np.int64)
        raw = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(block.data))])
        found = raw.dictionary_encode()
        return cls(found.dictionary, found.indices.to_numpy(), np.diff(np.searchsorted(starts, block.bounds)))


    def spread(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From where each distinct chunk's ids are in flat: those of all texts one after the other, and how many each text has."""
        if not len(self.of):
            return flat[:0], np.zeros(len(self.counts), np.int64)
        sizes = size[self.of]
        so_far = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(self.counts)])]
        return gathered(flat, start[self.of], sizes), np.diff(so_far)


class Table:
    """Chunk to ids, in flat arrays that double when full; at most about ``most`` bytes, then it starts anew."""

    #: Bytes that Python keeps for a chunk beside its text and ids.
    ENTRY = 200

    def __init__(self, dtype, most: int):
        self.dtype, self.most = dtype, most
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.start, self.size, self.flat, self.used, self.bytes = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, self.dtype), 0, 0

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])

    def _add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, at = len(self.row), self.used
        self.start, self.size, self.flat = self._room(self.start, n + len(chunks)), self._room(self.size, n + len(chunks)), self._room(self.flat, at + len(ids))
        self.flat[at : at + len(ids)] = ids
        self.size[n : n + len(chunks)] = sizes
        self.start[n : n + len(chunks)] = at + np.cumsum(sizes) - sizes
        self.row.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.used += len(ids)
        self.bytes += sum(map(len, chunks)) + len(chunks) * self.ENTRY + 8 * len(ids)

    def ids(self, chunks: Chunks, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has. encode: chunks that the table lacks, each once, to their ids, one after the other, and how many each has."""
        if self.bytes > self.most:
            self.clear()
        distinct = chunks.distinct.to_numpy(zero_copy_only=False).tolist()
        rows = np.array([-1 if r is None else r for r in map(self.row.get, distinct)], np.int64)
        lacking = np.flatnonzero(rows < 0)
        if len(lacking):
            new = [distinct[i] for i in lacking.tolist()]
            rows[lacking] = len(self.row) + np.arange(len(new))
            self._add(new, *encode(new))
        return chunks.spread(self.flat, self.start[rows], self.size[rows])
