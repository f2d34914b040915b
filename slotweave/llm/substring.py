"""Substring deduplication by Rabin-Karp hashes of fixed-length word windows.

Every window of ``window`` consecutive words gets a Rabin-Karp hash.  Equal
windows are brought together by a shuffle, counted there, and each window that
also starts in a document with a smaller ``doc_id`` is marked; overlapping marks
merge into maximal removal intervals.

How the work is spread:

* the map side hashes blocks of documents and combines *within* the block: of
  equal windows only those of the smallest document travel, the others are
  marked on the spot.  A passage that a third of all documents share therefore
  reaches its reducer once per block, not once per document;
* windows are dealt out by their minimizer (the smallest hash of the
  ``ANCHOR``-word runs inside), so neighbouring windows travel as one run of
  hashes and come back as one interval;
* rows of a block for one bucket travel as one packed record; a task holds one
  bucket at a time, and there are as many as the text needs for each to be small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.llm.text import (
    U64,
    blocks,
    int_array,
    starts_of_windows,
    string_buffers,
    text_buckets,
    window_hashes,
    word_hashes,
)

ANCHOR = 10

_RUN = np.dtype([("doc", "<i8"), ("text", "<i8"), ("mini", "<u8"), ("start", "<u4"), ("len", "<u4")])
_SPAN = np.dtype([("doc", "<i8"), ("text", "<i8"), ("start", "<u4"), ("end", "<u4")])
_PACKED = pa.schema([("bucket", pa.int32()), ("runs", pa.binary()), ("hashes", pa.binary()), ("spans", pa.binary())])


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _not_first(hashes: np.ndarray, minis: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Mask of the windows whose content also has a window in a smaller document."""
    out = np.zeros(len(hashes), dtype=bool)
    if len(hashes) < 2:
        return out
    order = np.argsort(hashes)
    h = hashes[order]
    same = h[1:] == h[:-1]
    shared = np.zeros(len(h), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    pick = order[shared]
    if len(pick) == 0:
        return out
    pick = pick[np.lexsort((docs[pick], minis[pick], hashes[pick]))]
    first = np.ones(len(pick), dtype=bool)
    first[1:] = (hashes[pick][1:] != hashes[pick][:-1]) | (minis[pick][1:] != minis[pick][:-1])
    smallest = docs[pick][np.flatnonzero(first)][np.cumsum(first) - 1]
    out[pick] = docs[pick] > smallest
    return out


def _runs(*changes: np.ndarray) -> np.ndarray:
    """Start indices of the runs over which none of the arrays changes by a break."""
    brk = np.zeros(len(changes[0]), dtype=bool)
    brk[:1] = True
    for c in changes:
        brk[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(brk)


def _pack(window: int, buckets: int):
    anchor = min(ANCHOR, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            data, offsets = string_buffers(block.column(2))
            known = ~np.asarray(block.column(0).is_null())
            words, bounds = word_hashes(data, offsets)
            if len(words) < window:
                continue
            row_of = np.repeat(np.arange(block.num_rows), np.diff(bounds))
            valid = starts_of_windows(bounds, window, len(words))
            valid &= known[row_of[: len(valid)]]
            at = np.flatnonzero(valid)
            if len(at) == 0:
                continue
            hashes = window_hashes(words, window)[at]
            minis = _sliding_min(window_hashes(words, anchor), window - anchor + 1)[at]
            doc_ids, texts = int_array(block.column(0), 0), int_array(block.column(1), 0)
            rows = row_of[at]
            docs, positions = doc_ids[rows], at - bounds[rows]
            done = _not_first(hashes, minis, docs)
            # runs: same row, same minimizer, same verdict, consecutive positions
            first = _runs(rows, minis, done, at - np.arange(len(at)))
            length = np.diff(np.append(first, len(at)))
            bucket = (minis[first] % U64(buckets)).astype(np.int32)
            local = done[first]
            order = np.argsort(bucket, kind="stable")
            cut = _runs(bucket[order])
            out: list[list] = [[], [], [], []]
            for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
                own = order[a:b]
                sent, marked = own[~local[own]], own[local[own]]
                table = np.empty(len(sent), dtype=_RUN)
                f = first[sent]
                table["doc"], table["text"], table["mini"] = docs[f], texts[rows[f]], minis[f]
                table["start"], table["len"] = positions[f], length[sent]
                spans = np.empty(len(marked), dtype=_SPAN)
                g = first[marked]
                spans["doc"], spans["text"], spans["start"] = docs[g], texts[rows[g]], positions[g]
                spans["end"] = positions[g] + length[marked] - 1 + window
                hashed = [hashes[i : i + n] for i, n in zip(f, length[sent], strict=True)]
                payload = np.concatenate(hashed).tobytes() if hashed else b""
                for column, value in zip(out, (int(bucket[own[0]]), table.tobytes(), payload, spans.tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PACKED, strict=True)], schema=_PACKED)

    return run


def _mark(window: int):
    def emit(doc, text, start, end) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(x.astype(np.int64)) for x in (doc, text, start, end)], names=["doc_id", "text_key", "start", "end"]
        )

    def judge(parts: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        table = np.concatenate([np.frombuffer(r, dtype=_RUN) for r, _ in parts])
        hashes = np.concatenate([np.frombuffer(h, dtype="<u8") for _, h in parts])
        if len(table) == 0:
            return
        n = table["len"].astype(np.int64)
        run_of = np.repeat(np.arange(len(table)), n)
        marked = _not_first(hashes, table["mini"][run_of], table["doc"][run_of])
        at = np.flatnonzero(marked)
        if len(at) == 0:
            return
        begin = np.cumsum(n) - n
        first = _runs(run_of[at], at - np.arange(len(at)))
        length = np.diff(np.append(first, len(at)))
        run = run_of[at[first]]
        start = table["start"][run].astype(np.int64) + (at[first] - begin[run])
        yield emit(table["doc"][run], table["text"][run], start, start + length - 1 + window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by bucket: one bucket is in memory at a time
        now, parts = None, []
        for batch in batches:
            for bucket, runs, hashes, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if parts:
                        yield from judge(parts)
                    now, parts = bucket, []
                parts.append((runs, hashes))
                s = np.frombuffer(spans, dtype=_SPAN)
                if len(s):
                    yield emit(s["doc"], s["text"], s["start"], s["end"])
        if parts:
            yield from judge(parts)

    return run


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, text_key, start, end): word spans covered by windows that also start in a smaller document.

    Spans of one document may overlap or touch; ``text_key`` is
    ``xxhash64(text)`` and tells rows apart that share a ``doc_id``.
    """
    buckets = text_buckets(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    packed = keyed.mapInArrow(_pack(window, buckets), "bucket int, runs binary, hashes binary, spans binary")
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_mark(window), "doc_id long, text_key long, start long, end long")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = []
            for doc, text, spans in zip(block.column(0).to_pylist(), block.column(1).cast(pa.binary()), block.column(2).to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                holes = _merged(spans)
                kept, at = [], 0
                for s, e in holes:
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                joined = b" ".join(kept)
                rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None, [{"start": s, "end": e} for s, e in holes]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    return run


def remove_repeats(docs: DataFrame, window: int = 50, with_text: bool = True) -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller ``doc_id``.

    Returns doc_id, n_words, n_removed, kept_sha256, kept_text (null unless
    ``with_text``) and removed (maximal word intervals, end exclusive), one row
    per input row.  Windows are judged on the input.  Null or empty text: no
    words, nothing removed.  Null ``doc_id``: not comparable, so nothing is
    removed and nothing is removed because of it.  Rows that share a ``doc_id``
    never remove words from each other.  Other columns are ignored.
    """
    spans = (
        repeated_spans(docs, window)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    joined = left.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<start:long,end:long>>")
