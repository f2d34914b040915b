"""Token ids in directly addressable codes: random access without decoding blocks.

A segment keeps its ids in levels.  Level 0 has the low ``CHUNK`` bits of every
id and a bitmap of the ids that go on; level 1 has the next bits of those that
go on, and so forth.  A rank directory counts the set bits before every 512th
bit, so the place of an id's next chunk is one lookup and a few popcounts.

On disk a segment is one row of a Parquet table: its documents, its place, and
the coded ids as bytes.  Spark writes and commits the files, so lost executors
and slow stores are its business; min/max statistics on ``part`` and ``start``
find the segment of a token.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.llm.tokens import encoded_blocks

MAGIC = b"DAC1"
CHUNK = 8
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 18


def encode(ids: np.ndarray) -> bytes:
    """Coded form of unsigned 32-bit ids."""
    parts, rest = [], ids.astype(np.uint32)
    levels = 0
    while True:
        chunk = (rest & np.uint32(0xFF)).astype(np.uint8)
        more = (rest >> np.uint32(CHUNK)) > 0
        last = not more.any()
        parts.append(struct.pack("<QB", len(chunk), not last) + chunk.tobytes())
        levels += 1
        if last:
            break
        bits = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, dtype=np.uint8)
        bits[: len(more)] = more
        ranks = np.concatenate(([0], np.cumsum(bits.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint32))[:-1])).astype("<u4")
        parts.append(np.packbits(bits, bitorder="little").tobytes() + ranks.tobytes())
        rest = rest[more] >> np.uint32(CHUNK)
    return MAGIC + struct.pack("<B", levels) + b"".join(parts)


class Coded:
    """Reader of one coded segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a coded segment")
        self.levels = []
        at = 5
        for _ in range(data[4]):
            n, goes_on = struct.unpack_from("<QB", data, at)
            at += 9
            chunk = np.frombuffer(data, dtype=np.uint8, count=n, offset=at)
            at += n
            bits = ranks = None
            if goes_on:
                blocks = -(-n // RANK_BITS)
                bits = np.frombuffer(data, dtype=np.uint8, count=blocks * RANK_BITS // 8, offset=at)
                at += len(bits)
                ranks = np.frombuffer(data, dtype="<u4", count=blocks, offset=at)
                at += 4 * blocks
            self.levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit ``i``."""
        block = i // RANK_BITS
        if block == len(ranks):
            block -= 1
        low = block * RANK_BITS
        own = np.unpackbits(bits[low // 8 : -(-i // 8)], bitorder="little")[: i - low]
        return int(ranks[block]) + int(own.sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if bits is None or not (bits[i // 8] >> (i % 8)) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + CHUNK
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids of a range: the ids that go on are a range of the next level too."""
        out = np.zeros(stop - start, dtype=np.uint32)
        where, shift = np.arange(stop - start), 0
        for chunk, bits, ranks in self.levels:
            out[where] |= chunk[start:stop].astype(np.uint32) << np.uint32(shift)
            if bits is None or stop == start:
                break
            more = np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 : start % 8 + stop - start].astype(bool)
            where, start = where[more], self._rank(bits, ranks, start)
            stop, shift = start + len(where), shift + CHUNK
        return out


_SEGMENT = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("codes", pa.binary())])
_SEGMENT_DDL = "part int, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, codes binary"


def _segments(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        total = 0

        def close() -> pa.RecordBatch:
            nonlocal start, docs, sizes, held, total
            columns = [[part], [start], [total], [docs], [sizes], [encode(np.concatenate(held))]]
            start += total
            docs, sizes, held, total = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEGMENT, strict=True)], schema=_SEGMENT)

        for block, ids, bounds in encoded_blocks(batches, vocabulary):
            for doc, a, b in zip(block.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                docs.append(doc)
                sizes.append(int(b - a))
                held.append(ids[a:b].astype(np.uint32))
                total += int(b - a)
                if total >= SEGMENT_TOKENS:
                    yield close()
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str) -> None:
    """Encode every document (null text: empty; an end id after each) and write coded segments in ascending doc_id order.

    Rows without a doc_id come first; rows that repeat a doc_id are ordered by
    text.  A document is never split over segments.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_segments(vocabulary), _SEGMENT_DDL).write.parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``first``, the number of ids before the segment in the whole table.

    A part is one task of the writer, so the table of part totals has as many
    rows as the writer had tasks, whatever the number of documents.
    """
    segments = spark.read.schema(_SEGMENT_DDL).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, at = [], 0
    for row in totals:
        before.append((row["part"], at))
        at += row["n"]
    offsets = spark.createDataFrame(before, "part int, before long")
    return segments.join(F.broadcast(offsets), "part").withColumn("first", F.col("before") + F.col("start"))


_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                first, docs, sizes = (batch.column(i)[k].as_py() for i in range(3))
                coded = Coded(batch.column(3)[k].as_py())
                rows, at = [], 0
                for doc, n in zip(docs, sizes, strict=True):
                    ids = coded.slice(at, at + n)
                    rows.append((doc, first + at, n, zlib.crc32(ids.astype("<u4").tobytes()), ids.tolist() if with_ids else None))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DOC, strict=True)], schema=_DOC)

    return run


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): the documents of a coded table; start counts the ids before them."""
    rows = _placed(spark, path).select("first", "doc_ids", "doc_tokens", "codes")
    return rows.mapInArrow(_documents(with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def read_tokens(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, id) for a table of global token positions: only their segments are read and only those ids decoded.

    One row per input row; the id is null where the position is null, negative or
    past the last id.  Positions meet their segments by an equi-join on cells of
    ``SEGMENT_TOKENS`` positions, of which a segment touches few.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, codes, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                coded = Coded(codes)
                out += [(p, coded[p - first]) for p in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["position", "id"])

    def cell(at: Column) -> Column:
        return F.floor(at / SEGMENT_TOKENS)

    placed = _placed(spark, path)
    spans = placed.select("part", "start", "first", (F.col("first") + F.col("n_tokens")).alias("end"))
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("first")), cell(F.col("end") - 1))))
    asked = positions.select(F.col("position").cast("long").alias("position"))
    hits = asked.distinct().withColumn("cell", cell(F.col("position"))).join(spans, "cell").filter("position >= first AND position < end")
    wanted = hits.groupBy("part", "start").agg(F.collect_list("position").alias("wanted"))  # a segment's positions at most
    found = placed.join(wanted, ["part", "start"]).select("first", "codes", "wanted").mapInArrow(pick, "position long, id long")
    return asked.join(found, "position", "left")
