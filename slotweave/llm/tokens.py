"""Token ids of documents, block by block, with a public tokenizer file.

Tokenizers of this kind drop white space, so the ids of a text are the ids of
its white-space separated pieces, one after another, whatever the case of their
ASCII letters (the tokenizer lowers them); punctuation behind a letter is a piece
of its own.  Pieces repeat a lot: a block's distinct pieces are found by Arrow's
dictionary encoding, those that the worker has not met are encoded, and numpy
gathers the ids from one pool.

Whether a file's tokenizer is of this kind is tried out on probes when the file is
loaded; any other one encodes whole texts.  So are texts in which a special token
stands in any case, because such a token counts in its own case only.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
CACHED_PARTS = 600_000
#: Punctuation that the tokenizer always cuts from a letter before it.
TAIL = ".,;:!?&*#%$|"


def _gathered(begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions begin[k] .. begin[k] + counts[k] - 1 for all k in turn, and the ends of the runs."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begin - (ends - counts), counts) + np.arange(total), ends


class PieceEncoder:
    """Encodes blocks of texts; keeps the ids of about CACHED_PARTS words."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.by_piece = self._splits()
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _splits(self) -> bool:
        """Whether white space, the case of ASCII letters and punctuation behind letters are treated as ``encode`` assumes."""
        words = ["Hello", "WORLD", "x1", "don't", "a-b", "(é)", "12", "ß", "can't.", "«q»"]
        probes = [" ".join(words), "\n\n".join(words), "  " + "\t ".join(words) + "\x0b\x0c\r", *(f"ab{c}{e} cd" for c in TAIL for e in ("", c, "!?"))]

        def cut(piece: str) -> list[str]:
            stem = piece.rstrip(TAIL)
            return [stem, piece[len(stem) :]] if stem != piece and "a" <= stem[-1:] <= "z" else [piece]

        return all(self._ids(p) == [i for w in p.lower().split() for part in cut(w) for i in self._ids(part)] for p in probes)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.sizes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def _looked_up(self, parts: list[str]) -> np.ndarray:
        """Numbers of the parts among all that are known."""
        if len(self.known) > CACHED_PARTS:
            self._forget()
        new = [p for p in parts if p not in self.known]
        if new:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(sizes.sum()))))
            self.sizes = np.concatenate((self.sizes, sizes))
        return np.fromiter(map(self.known.__getitem__, parts), dtype=np.int64, count=len(parts))

    def _parts(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(part codes of all pieces, parts of each piece, distinct parts): words and the punctuation behind them."""
        tailed = pc.match_substring_regex(pieces, f"[a-z][{TAIL}]+$")
        stems = pc.if_else(tailed, pc.utf8_rtrim(pieces, TAIL), pieces)
        tails = pc.replace_substring_regex(pieces.filter(tailed), f"(?s)^.*[a-z]([{TAIL}]+)$", r"\1")
        coded = pa.concat_arrays([stems, tails]).dictionary_encode()
        codes, two = coded.indices.to_numpy(), tailed.to_numpy(zero_copy_only=False).astype(bool)
        at = np.arange(len(pieces)) + np.cumsum(two) - two
        flat = np.zeros(len(codes), dtype=np.int64)
        flat[at] = codes[: len(pieces)]
        flat[at[two] + 1] = codes[len(pieces) :]
        return flat, 1 + two.astype(np.int64), coded.dictionary

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): ids of all texts, END_ID after each, and each text's bounds. Null is empty."""
        texts = pc.fill_null(texts, "")
        low = pc.ascii_lower(texts)
        whole = np.full(len(texts), not self.by_piece)
        for token in self.special:
            whole |= pc.match_substring(low, token).to_numpy(zero_copy_only=False).astype(bool)
        if not whole.any():
            return self._encoded(low)
        ids, bounds = self._encoded(pc.if_else(pa.array(whole), pa.scalar("", low.type), low))
        parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for k in np.flatnonzero(whole):
            parts[k] = np.array([*self._ids(texts[int(k)].as_py()), END_ID], dtype=ids.dtype)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def _encoded(self, low: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for lower-case texts, by their pieces."""
        split = pc.ascii_split_whitespace(low)
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        flat, parts, distinct = self._parts(coded.dictionary)
        numbers = self._looked_up(distinct.to_pylist())
        begin = np.cumsum(self.sizes) - self.sizes
        # occurrences -> parts -> ids
        where, part_ends = _gathered((np.cumsum(parts) - parts)[codes], parts[codes])
        part = numbers[flat[where]]
        spots, id_ends = _gathered(begin[part], self.sizes[part])
        ids = self.pool[spots]
        pieces_before = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))
        parts_before = np.concatenate(([0], part_ends))[pieces_before]
        cut = np.concatenate(([0], id_ends))[parts_before]
        ids = np.insert(ids, cut[1:], END_ID)
        return ids, cut + np.arange(len(cut))


@lru_cache(maxsize=1)
def _encoder(vocabulary: str, changed: int) -> PieceEncoder:
    """One encoder for all tasks that a Python worker runs one after another: most words of a task are known from those before."""
    return PieceEncoder(vocabulary)


def encoded_blocks(batches: Iterator[pa.RecordBatch], vocabulary: str, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    from slotweave.llm.text import blocks

    encoder = _encoder(vocabulary, os.stat(vocabulary).st_mtime_ns)
    for block in blocks(batches, text):
        ids, bounds = encoder.encode(block.column(block.schema.get_field_index(text)))
        yield block, ids, bounds
