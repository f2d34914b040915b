"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text is its sequence of words between two edge marks.  Each word has two
faces: the lower-cased word itself, and its shape (what it begins and ends with,
its case, digits and symbols, its length class).  The runs of ``GRAMS`` words of
either face are hashed into ``2**BITS`` weights; a text's value for a weight is
the share of its runs of that kind that fall there, so long and short texts are
alike.  An empty text still has the run of its two edges.

Training is the online proximal form of follow-the-regularised-leader with a
learning rate of its own for every weight and an absolute penalty that leaves
most weights at zero.  It sees at most ``SAMPLE_ROWS`` labelled documents (those
with the smallest hashed doc_id) of at most ``SAMPLE_BYTES`` of text in all, whose
features Spark computes; a score is a sparse dot product of a whole text with
the weights, made in the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.llm.text import _IS_SEP, U64, blocks, mix, string_buffers, word_hashes

BITS = 18
#: (face, words in a run): face 0 is the lower-cased word, 1 its shape.
GRAMS = ((0, 1), (0, 2), (1, 1), (1, 2), (1, 3))
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 24 << 20
#: Rates and penalties of the leader, and how often the sample is gone through.
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 0.05, 0.002, 0.02, 4
CUT = 0.3

_EDGE = U64(0x5851F42D4C957F2D)
_UPPER, _LOWER, _DIGIT = (np.zeros(256, dtype=bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _LOWER[128:] = _DIGIT[48:58] = True
_OTHER = ~(_UPPER | _LOWER | _DIGIT | _IS_SEP)


def _shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shape of every word as a small number: classes of its first and last byte, kinds of bytes inside, length class."""
    inside = ~_IS_SEP[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    out = np.zeros(len(starts), dtype=np.int64)
    for kind in (_UPPER, _LOWER, _DIGIT, _OTHER):
        sums = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(kind[data], out=sums[1:])
        out = out * 4 + np.minimum(sums[ends] - sums[starts], 3)
    # an opening or closing byte that is no letter counts as itself
    first, last = data[starts], data[ends - 1]
    sign = lambda b: np.where(_OTHER[b], b, np.where(_UPPER[b], 1, np.where(_DIGIT[b], 2, 3))).astype(np.int64)
    return ((out * 256 + sign(first)) * 256 + sign(last)) * 8 + np.minimum((ends - starts).astype(np.int64) // 3, 7)


def runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, weight, share) of every run of every text; rows ascend within each kind of run."""
    data, offsets = string_buffers(column)
    words, bounds = word_hashes(data, offsets, lower=True)
    faces = (words, mix(_shapes(data, offsets).astype(U64) + U64(1)))
    n = len(offsets) - 1
    counts = np.diff(bounds)
    row = np.repeat(np.arange(n), counts)
    firsts = np.concatenate([[0], np.cumsum(counts + 2)])
    at = np.arange(len(words)) + 2 * row + 1
    owner = np.repeat(np.arange(n), counts + 2)
    out = []
    for k, (face, size) in enumerate(GRAMS):
        line = np.full(len(words) + 2 * n, _EDGE, dtype=U64)
        line[at] = faces[face]
        run = np.full(len(line) - size + 1 if len(line) >= size else 0, U64(k + 1), dtype=U64)
        for j in range(size):
            run = mix(run * U64(0x9E3779B97F4A7C15) + line[j : j + len(run)])
        start = np.flatnonzero(np.arange(len(run)) + size <= firsts[owner[: len(run)] + 1])
        of = owner[start]
        out.append((of, (run[start] >> U64(64 - BITS)).astype(np.int64), 1.0 / np.maximum(1, counts + 3 - size)[of]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass(frozen=True)
class Model:
    """Bias, and the weights that are not zero."""

    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.index] = self.weight
        return out


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Model of (weights, shares, label) of each document, gone through in the order given."""
    size = (1 << BITS) + 1  # the last is the bias
    z, n = np.zeros(size), np.zeros(size)
    held = lambda i: np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
    for _ in range(EPOCHS):
        for index, share, label in rows:
            index, share = np.append(index, size - 1), np.append(share, 0.1)
            w = held(index)
            p = 1 / (1 + np.exp(-np.clip(w @ share, -30, 30)))
            g = (p - label) * share
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA * w
            n[index] += g * g
    w = held(np.arange(size))
    index = np.flatnonzero(w[:-1])
    return Model(0.1 * float(w[-1]), index, w[index])


def scores(model: Model, dense: np.ndarray, column: pa.Array) -> np.ndarray:
    """Probability of label 1 of every text."""
    row, weight, share = runs(column)
    total = np.bincount(row, weights=dense[weight] * share, minlength=len(column)) + model.bias
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the doc_id's text leaves 0 modulo 5 (null: like the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


_FEATURES = pa.schema([("doc_id", pa.int64()), ("bytes", pa.int64()), ("weights", pa.list_(pa.int32())), ("shares", pa.list_(pa.float64()))])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        row, weight, share = runs(block.column(1))
        key, of = np.unique(row * (1 << BITS) + weight, return_inverse=True)
        shares = np.bincount(of, weights=share)
        bounds = np.searchsorted(key >> BITS, np.arange(block.num_rows + 1))
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, kind))
        size = np.diff(string_buffers(block.column(1))[1])
        yield pa.RecordBatch.from_arrays([block.column(0), pa.array(size), lists(key & ((1 << BITS) - 1), pa.int32()), lists(shares, pa.float64())], schema=_FEATURES)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the labelled rows.

    A doc_id with several labels counts as good only if all of them say so; of
    rows that repeat a doc_id the longest text counts.  Without labels every
    score is 0.5.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("label")).filter(~held_out(F.col("doc_id")))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).collect()
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def sample(ids: list[int]) -> DataFrame:
        # at most SAMPLE_ROWS ids, whatever the corpus
        return texts.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id")

    ids = [r["doc_id"] for r in drawn]
    sizes = {r["doc_id"]: r["bytes"] for r in sample(ids).groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("bytes")).collect()}
    label, taken, room = {r["doc_id"]: r["label"] for r in drawn}, [], SAMPLE_BYTES
    for i in ids:
        if i in sizes and sizes[i] <= room:
            room -= sizes[i]
            taken.append(i)
    longest = sample(taken).groupBy("doc_id").agg(F.max_by("text", F.struct(F.octet_length("text"), "text")).alias("text"))
    rows = {r["doc_id"]: (np.array(r["weights"], dtype=np.int64), np.array(r["shares"])) for r in longest.mapInArrow(_features, "doc_id long, bytes long, weights array<int>, shares array<double>").toLocalIterator()}
    return train([(*rows[i], label[i]) for i in taken])


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1) and predicted (1 from CUT on).

    Only the text makes the score; null counts as empty.  Null doc_ids and
    repeated rows are scored like any other row.  Other columns are ignored.
    """
    model = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for block in blocks(batches):
            p = scores(model, dense, block.column(2))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(p), pa.array((p >= CUT).astype(np.int32))], schema=_OUT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
