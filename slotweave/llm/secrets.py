"""Secret scan: base patterns, and a linear-chain conditional random field over words.

The field tags every word as secret begin (B), inside (I) or outside (O) from
its shape, the words before it and features of the whole text, and is decoded by
Viterbi.  It is trained by maximum likelihood on generated lines (secrets and
look-alikes of many kinds) and on at most ``SAMPLE_ROWS`` documents of the
corpus of at most ``SAMPLE_CHARS`` characters each, tagged by the base patterns.

Decoding whole texts is cheap because most words are outside beyond doubt: where
O leads by more than any two transitions could make up, the best path must pass
through O, so the text falls apart into short runs of doubtful words between
such words, and Viterbi runs on those runs alone.  That is exact.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.llm.text import _IS_SEP, blocks, string_buffers, word_hashes

SAMPLE_ROWS = 400
SAMPLE_CHARS = 8000
GENERATED_LINES = 1500
CHUNK_WORDS = 32
STEPS = 80
O, B, I = 0, 1, 2  # noqa: E741
KINDS = ("assign", "access", "hex", "crf")

#: Base patterns (fixed values of the contract); a match counts from the given length on.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

#: Words before a value that speak for a secret.
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "key", "bearer", "authorization", "credential", "credentials", "auth", "access_token", "client_secret", "private_key", "secret_key", "aws_secret_access_key", "pass", "signature", "pat")


def base_spans(text: str, longest_word: int | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start and then kind; code points, end exclusive.

    ``longest_word`` (bytes), where known, saves scans that cannot match.
    """
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if longest_word is None or longest_word >= 20:
        if "AKIA" in text:
            out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        if longest_word is None or longest_word >= 24:
            out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- features: one row of small integers per word -------------------------------------------------

_DIGIT, _UPPER, _LOWER_CASE, _SYMBOL = (np.zeros(256, dtype=bool) for _ in range(4))
_DIGIT[48:58] = _UPPER[65:91] = _LOWER_CASE[97:123] = True
_SYMBOL[[ord(c) for c in "+/_=.-"]] = True
_LENGTHS = np.array([4, 8, 12, 20, 32, 64])
SIZES = (7 * 32, 4, 4, 4, 4, 6)  # shape; digit share; digit-letter switches; previous word; the one before; text


def _keyword_hashes() -> np.ndarray:
    forms = [p + k + s for k in KEYWORDS for p in ("", '"', "'") for s in ("", ":", "=", '"', '":', "':", '"=')]
    column = pa.array(forms)
    return np.sort(word_hashes(*string_buffers(column), lower=True)[0])


def word_features(data: np.ndarray, offsets: np.ndarray, keywords: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, starts, ends, bounds) of the words of a block; starts and ends are byte positions."""
    hashes, bounds = word_hashes(data, offsets, lower=True)
    inside = ~_IS_SEP[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    n = (ends - starts).astype(np.int64)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, dtype=np.int32)
        np.cumsum(mask, out=sums[1:])
        return (sums[ends] - sums[starts]).astype(np.int64)

    digit = _DIGIT[data]
    d, u, low, sym = count(digit), count(_UPPER[data]), count(_LOWER_CASE[data]), count(_SYMBOL[data])
    letter = _UPPER[data] | _LOWER_CASE[data]
    flips = np.zeros(len(data), dtype=bool)
    flips[1:] = (digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])
    f = count(flips)
    # an upper-case first letter alone is no sign
    first_upper = _UPPER[data[starts]] if len(starts) else np.zeros(0, dtype=bool)
    flags = (d > 0) + 2 * ((u - first_upper) > 0) + 4 * (low > 0) + 8 * (sym > 0) + 16 * (n - d - u - low - sym > 0)
    shape = np.digitize(n, _LENGTHS) * 32 + flags
    share = np.where(d == 0, 0, np.where(4 * d <= n, 1, np.where(5 * d <= 3 * n, 2, 3)))
    switch = np.digitize(f, [1, 3, 6])
    last = data[ends - 1] if len(ends) else np.zeros(0, dtype=np.uint8)
    at = np.minimum(np.searchsorted(keywords, hashes), len(keywords) - 1)
    named = keywords[at] == hashes
    kind = np.where(named, 3, np.where((last == ord(":")) | (last == ord("=")), 2, 1))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    before, before2 = np.zeros_like(kind), np.zeros_like(kind)
    before[1:] = np.where(row[1:] == row[:-1], kind[:-1], 0)
    before2[2:] = np.where(row[2:] == row[:-2], kind[:-2], 0)
    words = np.maximum(np.diff(bounds), 1)
    with_digit = np.bincount(row, weights=d > 0, minlength=len(words)) / words
    any_name = np.bincount(row, weights=named, minlength=len(words)) > 0
    text = (np.digitize(with_digit, [0.01, 0.2]) + 3 * any_name)[row]
    return np.stack([shape, share, switch, before, before2, text], axis=1).astype(np.int16), starts, ends, bounds


# --- the field --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """Weights of the features by state, and of the transitions; ``edges`` weighs first and last states."""

    emit: tuple[np.ndarray, ...]
    move: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for k, w in enumerate(self.emit):
            out += w[features[:, k]]
        return out

    def certain(self, scores: np.ndarray) -> np.ndarray:
        """Words that every best path leaves outside.

        Were such a word B or I on a best path, tagging it O would gain: its lead
        exceeds whatever the transitions around it, and a following I that would
        have to become B, can lose.
        """
        t = self.move
        into = max(t[:, s].max() + t[s, :2].max() for s in (B, I)) - (t[:, O].min() + t[O, :2].min())
        chain = max(t[:, s].max() + t[s, I] for s in (B, I)) + t[I].max() - (t[:, O].min() + t[O, B] + t[B].min())
        follow = np.append(scores[1:, I] - scores[1:, B], -np.inf)
        lead = scores[:, O] - scores[:, 1:].max(axis=1)
        return lead > np.maximum(into, chain + follow)

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """Best tags of a run; before and after it lies O (or the text's edge, which counts as O)."""
        move = self.move.tolist()
        best, back = [move[O][s] + x for s, x in enumerate(scores[0].tolist())], []
        for row in scores[1:].tolist():
            step = [max(range(3), key=lambda a: best[a] + move[a][s]) for s in range(3)]  # noqa: B023
            best = [best[step[s]] + move[step[s]][s] + row[s] for s in range(3)]
            back.append(step)
        tag = max(range(3), key=lambda s: best[s] + move[s][O])
        tags = [tag]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]

    def tag(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tags of all words of a block."""
        scores = self.scores(features)
        tags = np.zeros(len(features), dtype=np.int8)
        doubt = np.flatnonzero(~self.certain(scores))
        if len(doubt):
            row = np.searchsorted(bounds, doubt, side="right")
            cut = np.flatnonzero((np.diff(doubt) > 1) | (np.diff(row) > 0)) + 1
            for run in np.split(doubt, cut):
                tags[run] = self.viterbi(scores[run])
        return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(features: np.ndarray, tags: np.ndarray, steps: int = STEPS, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Maximum likelihood by Adam on chunks of equal length: features (n, words, kinds), tags (n, words)."""
    n, words, _ = features.shape
    sizes = [*SIZES]
    shape = [(s, 3) for s in sizes] + [(3, 3)]
    theta = [np.zeros(s) for s in shape]
    theta[-1][O, I] = -50.0  # nothing continues what has not begun
    m, v = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape]
    gold = np.eye(3)[tags]
    gold_moves = np.zeros((3, 3))
    padded = np.concatenate([np.zeros((n, 1), dtype=tags.dtype), tags, np.zeros((n, 1), dtype=tags.dtype)], axis=1)
    np.add.at(gold_moves, (padded[:, :-1].ravel(), padded[:, 1:].ravel()), 1)
    for t in range(1, steps + 1):
        emit, move = [w.astype(np.float32) for w in theta[:-1]], theta[-1].astype(np.float32)
        s = sum(w[features[:, :, k]] for k, w in enumerate(emit))
        fwd = np.empty((n, words, 3), dtype=np.float32)
        fwd[:, 0] = s[:, 0] + move[O]
        for i in range(1, words):
            fwd[:, i] = _log_sum(fwd[:, i - 1, :, None] + move, axis=1) + s[:, i]
        bwd = np.empty((n, words, 3), dtype=np.float32)
        bwd[:, -1] = move[:, O]
        for i in range(words - 2, -1, -1):
            bwd[:, i] = _log_sum(move + (s[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
        z = _log_sum(fwd[:, -1] + move[:, O], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None])
        pairs = np.exp(fwd[:, :-1, :, None] + move + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        pairs[O] += p[:, 0].sum(axis=0)
        pairs[:, O] += p[:, -1].sum(axis=0)
        diff = (gold - p) / n
        grads = [np.zeros(s) for s in shape]
        for k in range(len(sizes)):
            for state in range(3):
                grads[k][:, state] = np.bincount(features[:, :, k].ravel(), weights=diff[:, :, state].ravel(), minlength=sizes[k])
        grads[-1] = (gold_moves - pairs) / n
        grads[-1][O, I] = 0.0
        for k, g in enumerate(grads):
            g = g - decay * theta[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            theta[k] = theta[k] + rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        theta[-1][O, I] = -50.0
    return Field(tuple(theta[:-1]), theta[-1])


def generated_lines(count: int = GENERATED_LINES, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with secrets and with look-alikes, and the spans of the secrets in them."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choices(chars, k=n))
    alnum, b64, hexed = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    prose = lambda n: " ".join(pick(string.ascii_lowercase, r.randint(1, 11)) for _ in range(n))
    uuid_like = lambda: "-".join(pick(hexed, n) for n in (8, 4, 4, 4, 12))
    out = []
    for _ in range(count):
        values: list[str] = []
        k = r.random()
        if k < 0.45:
            value = r.choice([
                lambda: pick(alnum, r.randint(16, 44)), lambda: pick(b64, 40), lambda: pick(hexed, r.choice([24, 32, 40, 64])), lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24),
                lambda: f"xoxb-{pick(string.digits, 11)}-{pick(alnum, 24)}", lambda: f"eyJ{pick(alnum, 20)}.eyJ{pick(alnum, 30)}.{pick(alnum + '_-', 43)}", lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
                # keys of services in general: a short mark, a sign, one part or two; and a mark with hexadecimal digits of either case
                lambda: pick(r.choice([string.ascii_lowercase, string.ascii_letters]), r.randint(2, 6)) + r.choice("-_") + pick(alnum + "_-" * r.randint(0, 1), r.randint(18, 44)),
                lambda: f"{pick(string.ascii_letters, r.randint(2, 4))}.{pick(alnum + '_-', r.randint(12, 24))}.{pick(alnum + '_-', r.randint(24, 48))}",
                lambda: pick(string.ascii_uppercase, r.randint(0, 2)) + pick(hexed, r.choice([32, 40, 64])), lambda: pick(string.ascii_uppercase, r.randint(0, 3)) + pick(hexed.upper(), r.choice([24, 32, 40])),
            ])()
            values = [value]
            form = r.choice(['{k} = "{v}"', "{k}: {v}", "{k} = {v}", "{k}: '{v}'", '"{k}" : "{v}"', "Authorization: Bearer {v}", "{k} {v}", "{v}", "{w} {v}", '{w}="{v}"', "{w}: {v},"])
            body = form.format(k=r.choice(KEYWORDS), v=value, w=prose(1))
        elif k < 0.5:
            values = [pick(b64, 64) for _ in range(r.randint(2, 5))]
            body = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(values) + "\n-----END PRIVATE KEY-----"
        else:
            body = r.choice([
                lambda: pick(string.digits, 16), lambda: f"555-{pick(string.digits, 4)}", lambda: f"{pick(string.ascii_lowercase, 7)}.{pick(string.digits, 2)}@mail.example.com",
                lambda: f"https://www.{pick(string.ascii_lowercase, 9)}.org/{pick(string.ascii_lowercase, 8)}/{pick(string.digits, 4)}", lambda: f"20{pick(string.digits, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}",
                lambda: f"version {r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: prose(3).upper().replace(" ", "!! ") + "!!", lambda: prose(4).replace(" ", "*** ") + "###", lambda: prose(5).replace(" ", " | "),
                lambda: f"the {r.choice(KEYWORDS)} of {prose(2)}", lambda: f"{prose(1)}: {prose(3)}", lambda: f"{prose(1)} = {pick(string.digits, 3)}", lambda: pick(string.ascii_lowercase, r.randint(18, 30)),
                lambda: pick(string.ascii_lowercase, 9).capitalize() + pick(string.ascii_lowercase, 8).capitalize(), uuid_like, lambda: f"id={uuid_like()}", lambda: "/usr/" + pick(string.ascii_lowercase, 6) + "/lib64/" + pick(string.ascii_lowercase, 9), lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)),
            ])()
        line = f"{prose(r.randint(0, 9))} {body} {prose(r.randint(0, 9))}".strip()
        spans, at = [], 0
        for value in values:
            at = line.index(value, at)
            spans.append((at, at + len(value)))
            at += len(value)
        out.append((line, spans))
    return out


def _value_spans(text: str) -> list[tuple[int, int]]:
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return found + [(s, e) for kind, s, e in base_spans(text) if kind != "assign"]


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Field:
    """Train the field on generated lines and on a bounded sample of documents (whole ones, those of the smallest hashes)."""
    keyed = docs.filter(F.length("text") <= sample_chars).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    # the hashes alone are ordered; texts follow for the chosen ones only
    drawn = [r["h"] for r in keyed.select("h").orderBy("h").limit(sample_rows).collect()]
    chosen = docs.sparkSession.createDataFrame([(h,) for h in sorted(set(drawn))], "h long")
    sample = keyed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("text").alias("text")).orderBy("h").collect()
    labelled = generated_lines() + [(r["text"], _value_spans(r["text"])) for r in sample]
    data, offsets = string_buffers(pa.array([t for t, _ in labelled], pa.string()))
    features, starts, ends, bounds = word_features(data, offsets, _keyword_hashes())
    tags = np.zeros(len(features), dtype=np.int64)
    for k, (text, spans) in enumerate(labelled):
        last = -2
        for s, e in sorted(spans):
            low, high = (int(offsets[k]) + len(text[:i].encode()) for i in (s, e))
            a = bounds[k] + np.searchsorted(ends[bounds[k] : bounds[k + 1]], low, side="right")
            b = bounds[k] + np.searchsorted(starts[bounds[k] : bounds[k + 1]], high, side="left")
            if a < b:
                tags[a:b] = I
                if a != last + 1 or "PRIVATE" not in text:
                    tags[a] = B
                last = b - 1
    # chunks of one length: all with a secret or a digit in them, others until each text has four
    chunks = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        plain = 0
        for at in range(int(a), int(b), CHUNK_WORDS):
            to = min(at + CHUNK_WORDS, int(b))
            telling = tags[at:to].any() or (features[at:to, 1] > 0).any()
            if telling or plain < 4:
                plain += not telling
                chunks.append((at, to))
    x = np.zeros((len(chunks), CHUNK_WORDS, len(SIZES)), dtype=np.int64)
    y = np.zeros((len(chunks), CHUNK_WORDS), dtype=np.int64)
    x[:, :, 0] = 4  # what is missing at a chunk's end is like a short plain word
    x[:, :, 3:5] = 1
    for k, (at, to) in enumerate(chunks):
        x[k, : to - at], y[k, : to - at] = features[at:to], tags[at:to]
        if y[k, 0] == I:
            y[k, 0] = B
    return train(x, y)


_TRIM = "\"'`,;:.()[]{}<>|!?*"


def _field_spans(raw: bytes, starts: np.ndarray, ends: np.ndarray, tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of the tagged words of one text, in code points, without quotes and punctuation around them."""
    out: list[list[int]] = []
    for i in np.flatnonzero(tags):
        if tags[i] == I and out and out[-1][2] == i - 1:
            out[-1][1:] = [int(ends[i]), i]
        else:
            out.append([int(starts[i]), int(ends[i]), i])
    spans = []
    for low, high, _ in out:
        text = raw[low:high].decode("utf-8", "replace")
        left = len(text) - len(text.lstrip(_TRIM))
        text = text.strip(_TRIM)
        if text:
            at = len(raw[:low].decode("utf-8", "replace")) + left
            spans.append(("crf", at, at + len(text)))
    return spans


def _scanned(field: Field, batches: Iterator[pa.RecordBatch], text_column: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, list, list]]]]:
    """Blocks with (text, base spans, all spans) of each of their rows."""
    keywords = _keyword_hashes()
    for block in blocks(batches, text_column):
        data, offsets = string_buffers(block.column(block.schema.get_field_index(text_column)))
        features, starts, ends, bounds = word_features(data, offsets, keywords)
        tags = field.tag(features, bounds)
        longest = np.zeros(block.num_rows, dtype=np.int64)
        np.maximum.at(longest, np.repeat(np.arange(block.num_rows), np.diff(bounds)), ends - starts)
        raw = data.tobytes()
        rows = []
        for k in range(block.num_rows):
            own = raw[offsets[k] : offsets[k + 1]]
            text = own.decode()
            base = base_spans(text, int(longest[k]))
            a, b = bounds[k], bounds[k + 1]
            extra = _field_spans(own, starts[a:b] - offsets[k], ends[a:b] - offsets[k], tags[a:b]) if tags[a:b].any() else []
            extra = [x for x in extra if not any(x[1] < e and s < x[2] for _, s, e in base)]
            rows.append((text, base, sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
        yield block, rows


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_crf", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Secrets of every whole text: doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans.

    ``spans`` lists ``kind:start:end`` (code points, end exclusive) by start;
    ``base_sha256`` is the digest of that list without the field's spans.  The
    field adds spans that overlap no base span.  One row per input row; null
    text: empty; null doc_ids and repeated rows are scanned like any other row.
    Other columns are ignored.
    """
    field = field or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _scanned(field, batches, "text"):
            counts = [[sum(s[0] == kind for s in spans) for _, _, spans in rows] for kind in KINDS]
            digest = [hashlib.sha256(_joined(base).encode()).hexdigest() for _, base, _ in rows]
            columns = [block.column(0), *counts, digest, [_joined(spans) for _, _, spans in rows]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every found secret replaced by ``mark``; ``n_chars``, where present, follows the text.

    Null texts stay null.  All columns stay.
    """
    field = field or fit(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _scanned(field, batches, "text"):
            at = names.index("text")
            column = block.column(at)
            texts = [redacted(t, spans, mark) if spans else t for t, _, spans in rows]
            new = pa.array(texts, column.type, mask=np.asarray(column.is_null()))
            columns = [new if i == at else block.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, schema=block.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed))
    return out
