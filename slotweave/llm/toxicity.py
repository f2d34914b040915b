"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Two dictionaries are trained: one on ordinary texts, one on the parts of toxic
texts that mark them (byte runs in significantly more toxic than ordinary
texts).  A text is cut into windows of ``WINDOW_WORDS`` words; each is
compressed once with the ordinary dictionary alone and once with the toxic one
added, and the bytes that this saves are the window's gain.  A logistic curve
over the gains of all windows of a text, calibrated on labelled texts that the
dictionaries have not seen, turns them into a score.

Matches have ``MIN_MATCH`` bytes at least, so a window that shares no run of
that length with the toxic dictionary cannot gain and is not compressed: exact,
and most windows are like that.

The fit uses at most ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` labelled rows of at
most ``SAMPLE_BYTES`` of text altogether; scoring reads every whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.llm.text import _IS_SEP, U64, blocks, mix, string_buffers

WINDOW_WORDS = 4
MIN_MATCH = 6
TOXIC_ROWS = 2000
ORDINARY_ROWS = 4000
SAMPLE_BYTES = 16 << 20
ORDINARY_DICTIONARY = 4096
TOXIC_DICTIONARY = 4096
SEGMENT = 64
SIGNIFICANT = 5.0
CUT = 0.3

_SPACE = np.where(_IS_SEP, np.uint8(32), np.arange(256, dtype=np.uint8)).astype(np.uint8)


def prepared(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of lower-case texts with a space before and after; separators are spaces; null is empty."""
    text = pc.utf8_lower(pc.fill_null(column, ""))
    space = pa.scalar(" ", text.type)
    data, offsets = string_buffers(pc.binary_join_element_wise(space, text, space, pa.scalar("", text.type)))
    return _SPACE[data], offsets


def _grams(data: np.ndarray) -> np.ndarray:
    """Every run of MIN_MATCH bytes as one number."""
    n = max(0, len(data) - MIN_MATCH + 1)
    out = np.zeros(n, dtype=U64)
    for k in range(MIN_MATCH):
        out |= data[k : k + n].astype(U64) << U64(8 * k)
    return out


def _in_word(data: np.ndarray) -> np.ndarray:
    """Mask of the runs of MIN_MATCH bytes that have a space at their ends alone."""
    n = max(0, len(data) - MIN_MATCH + 1)
    out = np.ones(n, dtype=bool)
    for k in range(1, MIN_MATCH - 1):
        out &= data[k : k + n] != 32
    return out


def _document_counts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of all texts, and the number of texts that hold each."""
    each = [np.unique(_grams(t)[_in_word(t)]) for t in texts]
    return np.unique(np.concatenate([*each, np.zeros(0, dtype=U64)]), return_counts=True)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Dictionary of ``size`` bytes: all distinct samples, commonest last, where they fit; else trained on them."""
    distinct = Counter(samples)
    if sum(map(len, distinct)) <= size:
        return b"".join(sorted(distinct, key=lambda s: (distinct[s], s)))
    return zstandard.train_dictionary(size, samples, k=SEGMENT, d=MIN_MATCH).as_bytes()


def marking_parts(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> list[bytes]:
    """Parts of the toxic texts whose byte runs are in significantly more toxic than ordinary texts."""
    runs, a = _document_counts(toxic)
    other, b = _document_counts(ordinary)
    at = np.minimum(np.searchsorted(other, runs), max(0, len(other) - 1))
    b = np.where(other[at] == runs, b[at], 0) if len(other) else np.zeros(len(runs))
    p = (a + b) / (len(toxic) + len(ordinary))
    error = np.sqrt(p * (1 - p) * (1 / max(1, len(toxic)) + 1 / max(1, len(ordinary)))) + 1e-12
    marks = runs[(a >= 3) & ((a / max(1, len(toxic)) - b / max(1, len(ordinary))) / error > SIGNIFICANT)]
    parts = []
    for text in toxic:
        hit = np.flatnonzero(_in_word(text) & np.isin(_grams(text), marks))
        for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
            if len(run):
                parts.append(text[run[0] : run[-1] + MIN_MATCH].tobytes())
    return parts


@dataclass(frozen=True)
class Model:
    """The dictionaries, and the logistic curve over the features of ``features``."""

    ordinary: bytes
    toxic: bytes
    center: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = (features - np.array(self.center)) / np.array(self.spread)
        z = np.clip(x @ np.array(self.weights[1:]) + self.weights[0], -30, 30)
        return 1 / (1 + np.exp(-z))


class Scorer:
    """Gains of windows; made once in each task."""

    def __init__(self, model: Model):
        options = zstandard.ZstdCompressionParameters(compression_level=3, window_log=16, hash_log=13, chain_log=13, min_match=MIN_MATCH, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.compressors = []
        for content in (model.ordinary, model.ordinary + model.toxic):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=options)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=held, compression_params=options))
        both = np.frombuffer(model.toxic, dtype=np.uint8)
        self.known = np.unique(_grams(both))
        self.table = np.zeros(1 << 16, dtype=bool)
        self.table[(mix(self.known) & U64(0xFFFF)).astype(np.int64)] = True

    def _shares(self, data: np.ndarray) -> np.ndarray:
        """Positions at which a run of the toxic dictionary starts."""
        out = []
        for at in range(0, len(data), 1 << 20):
            grams = _grams(data[at : at + (1 << 20) + MIN_MATCH - 1])
            hit = np.flatnonzero(self.table[(mix(grams) & U64(0xFFFF)).astype(np.int64)])
            out.append(at + hit[np.isin(grams[hit], self.known)])
        return np.concatenate([*out, np.zeros(0, dtype=np.int64)])

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text: log of the total gain, largest gain, gain by window, share of the windows that gain, log of the windows."""
        space = data == 32
        first = np.flatnonzero(space[:-1] & ~space[1:]) if len(data) else np.zeros(0, dtype=np.int64)
        bounds = np.searchsorted(first, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        opens = (np.arange(len(first)) - bounds[row]) % WINDOW_WORDS == 0
        starts, rows = first[opens], row[opens]
        ends = np.append(starts[1:] + 1, len(data))
        ends = np.minimum(ends, offsets[rows + 1])
        windows = np.bincount(rows, minlength=len(offsets) - 1)
        shared = self._shares(data)
        inside = np.searchsorted(starts, shared, side="right") - 1
        ok = inside >= 0
        inside, shared = inside[ok], shared[ok]
        wanted = np.unique(inside[shared + MIN_MATCH <= ends[inside]])
        raw = data.tobytes()
        plain, marked = self.compressors
        gain = np.zeros(len(wanted), dtype=np.int64)
        for k, (s, e) in enumerate(zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True)):
            window = raw[s:e]
            gain[k] = max(0, len(plain.compress(window)) - len(marked.compress(window)))
        of = rows[wanted]
        n = len(offsets) - 1
        total = np.bincount(of, weights=gain, minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, of, gain)
        share = np.bincount(of[gain > 1], minlength=n) / np.maximum(1, windows)
        return np.stack([np.log1p(total), most, np.sqrt(total / np.maximum(1, windows)), np.sqrt(share), np.log1p(windows)], axis=1)


def _expanded(x: np.ndarray) -> np.ndarray:
    """Features and the products that let density weigh by length."""
    return np.concatenate([x, x[:, :1] * x[:, 2:3], x[:, :1] * x[:, 4:5], x[:, 1:2] * x[:, 2:3]], axis=1)


def _calibrated(model: Model, texts: list[str], toxic: np.ndarray) -> Model:
    x = _expanded(Scorer(model).features(*prepared(pa.array(texts, pa.string()))))
    center, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    design = np.concatenate([np.ones((len(x), 1)), (x - center) / spread], axis=1)
    w = np.zeros(design.shape[1])
    ridge = np.diag([1e-3, *[0.3] * (len(w) - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, design.T @ (toxic - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.ordinary, model.toxic, tuple(center), tuple(spread), tuple(w))


def fit_texts(rows: list[tuple[int, str, int]]) -> Model:
    """Model of labelled (doc_id, text, toxic); three of five rows make the dictionaries, the others calibrate."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    texts = [t for _, t, _ in rows]
    toxic = np.array([x for _, _, x in rows], dtype=np.int64)
    part = (mix(np.array([r[0] for r in rows], dtype=np.int64).view(U64) + U64(17)) % U64(5)).astype(np.int64)
    train = part < 3
    data, offsets = prepared(pa.array(texts, pa.string()))
    pieces = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    marked = [p for p, t, x in zip(pieces, train, toxic, strict=True) if t and x]
    plain = [p for p, t, x in zip(pieces, train, toxic, strict=True) if t and not x]
    parts = marking_parts(marked, plain)
    ordinary = _dictionary([p[k : k + 256].tobytes() for p in plain for k in range(0, len(p), 256)], ORDINARY_DICTIONARY)
    model = Model(ordinary, _dictionary(parts, TOXIC_DICTIONARY))
    held = ~train if (~train).any() else train
    if not held.any():
        return Model(ordinary, b"", (0.0,) * 8, (1.0,) * 8, (-30.0, *(0.0,) * 8))
    return _calibrated(model, [t for t, h in zip(texts, held, strict=True) if h], toxic[held])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the doc_id's text leaves 2 modulo 4 (null: like the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the labelled rows, by hashed doc_id; a doc_id with several labels is toxic if one says so."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    by_hash = known.withColumn("h", F.xxhash64("doc_id"))
    drawn = by_hash.filter("toxic = 1").orderBy("h").limit(TOXIC_ROWS).union(by_hash.filter("toxic = 0").orderBy("h").limit(ORDINARY_ROWS))
    ids = [(r["doc_id"], r["toxic"], r["h"]) for r in drawn.collect()]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def sample(rows: list[tuple]) -> DataFrame:
        # at most TOXIC_ROWS + ORDINARY_ROWS rows, whatever the corpus
        return texts.join(F.broadcast(docs.sparkSession.createDataFrame(rows, "doc_id long, toxic int, h long")), "doc_id")

    sizes = {r["doc_id"]: r["bytes"] for r in sample(ids).groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("bytes")).collect()}
    taken, room = [], {1: SAMPLE_BYTES // 2, 0: SAMPLE_BYTES // 2}
    for doc_id, toxic, h in sorted(ids, key=lambda r: r[2]):
        size = sizes.get(doc_id)
        if size is not None and size <= room[toxic]:
            room[toxic] -= size
            taken.append((doc_id, toxic, h))
    rows = sample(taken).groupBy("doc_id", "toxic").agg(F.max_by("text", F.struct(F.octet_length("text"), "text")).alias("text")).collect()
    return fit_texts([(r["doc_id"], r["text"], r["toxic"]) for r in rows])


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1) and predicted (1 from CUT on).

    Only the text makes the score; null and empty texts, which have no window,
    get the score of no gain.  Null doc_ids and repeated rows are scored like
    any other row; without labels nothing is toxic.  Other columns are ignored.
    """
    model = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for block in blocks(batches):
            p = model.probability(_expanded(scorer.features(*prepared(block.column(2)))))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(p), pa.array((p >= CUT).astype(np.int32))], schema=_OUT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
