"""Sum-of-squares online packing of tokenized documents into fixed-length sequences.

A document's full sequences are cut off first; the rest is an item that is put,
as it comes, into the open window (or a new one) whose change of fill level
makes the sum of the squared counts of partially filled windows smallest.  The
counts by level are one array of ``length`` numbers.

Each task packs its own partition with its own level array, so packing needs no
shuffle and a lost task is packed again alone.  When a task's documents end, its
open windows are merged: pieces of the emptiest fill up the fullest (cutting a
piece where it must), and the one window left is cut into sequences of
power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.llm.tokens import encoded_blocks

SEQUENCE = 4096


@dataclass(slots=True)
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens), Piece(self.doc_id, self.start + at, self.ids[at:], self.doc_tokens)


class SumOfSquares:
    """Open windows by fill level; ``add`` returns windows that are complete."""

    def __init__(self, length: int = SEQUENCE):
        self.length = length
        self.counts = np.zeros(length + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def level_for(self, size: int) -> int:
        """Level (0: a new window) at which an item of ``size`` < length raises the sum of squares least."""
        counts = self.counts[: self.length - size + 1]
        rise = 2 * self.counts[size:] + 1  # of the level reached; a full window is no longer counted
        rise[-1] = 0
        levels = np.flatnonzero(counts)
        best, where = int(rise[0]), 0
        if len(levels):
            change = rise[levels] - 2 * counts[levels] + 1
            k = int(np.argmin(change))
            if change[k] <= best:
                where = int(levels[k])
        return where

    def add(self, piece: Piece) -> list[list[Piece]]:
        full = []
        while len(piece.ids) >= self.length:
            head, piece = piece.cut(self.length)
            full.append([head])
        size = len(piece.ids)
        if size:
            level = self.level_for(size)
            window = []
            if level:
                window = self.open[level].pop()
                self.counts[level] -= 1
            window.append(piece)
            if level + size == self.length:
                full.append(window)
            else:
                self.counts[level + size] += 1
                self.open.setdefault(level + size, []).append(window)
        return full

    def close(self) -> list[list[Piece]]:
        """Merge what is open; the last window comes in power-of-two parts."""
        windows = [(n, w) for n in sorted(self.open, reverse=True) for w in self.open[n]]
        self.open, self.counts[:] = {}, 0
        out: list[list[Piece]] = []
        i, j = 0, len(windows) - 1
        while i < j:
            fill, window = windows[i]
            left, source = windows[j]
            while fill < self.length and source:
                piece = source.pop()
                if len(piece.ids) > self.length - fill:
                    piece, rest = piece.cut(self.length - fill)
                    source.append(rest)
                window.append(piece)
                fill += len(piece.ids)
                left -= len(piece.ids)
            windows[i], windows[j] = (fill, window), (left, source)
            if fill == self.length:
                out.append(window)
                i += 1
            if not source:
                j -= 1
        if i == j:
            left, source = windows[i]
            source.reverse()
            while left:
                part: list[Piece] = []
                room = 1 << (left.bit_length() - 1)
                left -= room
                while room:
                    piece = source.pop()
                    if len(piece.ids) > room:
                        piece, rest = piece.cut(room)
                        source.append(rest)
                    part.append(piece)
                    room -= len(piece.ids)
                out.append(part)
        return out


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _pack(vocabulary: str, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = SumOfSquares(length), TaskContext.get().partitionId() << 32

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out = []
            for window in windows:
                at = 0
                for p in window:
                    n = len(p.ids)
                    out.append((p.doc_id, p.start, n, zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, number, at, p.ids.tolist() if with_ids else None))
                    at += n
                number += 1
            columns = zip(*out, strict=True) if out else [[] for _ in _OUT]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

        for block, ids, bounds in encoded_blocks(batches, vocabulary):
            done = []
            for doc, a, b in zip(block.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                # a copy, so that an open window does not hold the block
                done += packer.add(Piece(doc, 0, ids[a:b].copy(), int(b - a)))
            yield rows(done)
        yield rows(packer.close())

    return run


def pack(docs: DataFrame, vocabulary: str, length: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` tokens.

    One row per piece: doc_id, start and length (within the document's ids),
    ids_crc32, doc_tokens, sequence_id, offset (gapless in the sequence, from
    0), and the ids unless ``with_ids`` is off.  A document's ids are those of
    its text (null: empty) and the end id.  ``vocabulary`` is the path of a
    tokenizer file on every executor.  Repeated rows and null doc_ids are packed
    like any other row.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pack(vocabulary, length, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")
