"""Longest of many names that a text contains, by one automaton for all names.

The names' bytes form a tree; every node knows the node of its longest proper
suffix that is in the tree, and the best name that ends there.  The automaton is
five arrays, broadcast once.  A batch of texts is walked together, one byte of
each at a time, so a step costs a few array operations whatever the number of
names, and a text costs its length.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are walked together.
BLOCK = 8 << 20


@dataclass(frozen=True)
class Automaton:
    """``edges`` are node * 256 + byte, sorted, with the node each leads to; ``best`` is the rank of the best name that ends at a node (``len(names)``: none)."""

    edges: np.ndarray
    to: np.ndarray
    suffix: np.ndarray
    best: np.ndarray
    names: np.ndarray

    @classmethod
    def of(cls, names: list[str]) -> Automaton:
        """Longest names are best, of equal ones the first; case is not looked at."""
        ranked = sorted(dict.fromkeys(names), key=lambda n: -len(n))
        children: list[dict[int, int]] = [{}]
        best = [len(ranked)]
        for rank, name in enumerate(ranked):
            node = 0
            for byte in name.lower().encode():
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    best.append(len(ranked))
                node = children[node][byte]
            best[node] = min(best[node], rank)
        suffix = [0] * len(children)
        todo = deque(children[0].values())
        while todo:
            node = todo.popleft()
            best[node] = min(best[node], best[suffix[node]])
            for byte, child in children[node].items():
                back = suffix[node]
                while back and byte not in children[back]:
                    back = suffix[back]
                suffix[child] = children[back].get(byte, 0)
                todo.append(child)
        edges = np.array([n * 256 + b for n, c in enumerate(children) for b in c], dtype=np.int64)
        to = np.array([x for c in children for x in c.values()], dtype=np.int32)
        order = np.argsort(edges, kind="stable")
        return cls(edges[order], to[order], np.array(suffix, dtype=np.int32), np.array(best, dtype=np.int32), np.array([*ranked, None], dtype=object))

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next node of every text: along the byte's edge, from the longest suffix that has one."""
        state, open_ = state.copy(), np.arange(len(state))
        while len(open_):
            key = state[open_].astype(np.int64) * 256 + byte[open_]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            at_root = state[open_] == 0
            state[open_] = np.where(hit, self.to[at], self.suffix[state[open_]])
            open_ = open_[~hit & ~at_root]
        return state

    def longest(self, texts: list[str | None]) -> np.ndarray:
        """Rank of the best name that each text contains."""
        raw = [(t or "").encode() for t in texts]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        found = np.full(len(raw), self.best[0], dtype=np.int32)
        found[[t is None for t in texts]] = len(self.names) - 1
        if not len(self.edges):
            return found
        order = np.argsort(-sizes, kind="stable")  # the texts that go on at a place come first
        state, ends = np.zeros(len(raw), dtype=np.int32), np.sort(sizes)
        for place in range(int(sizes.max(initial=0))):
            on = order[: len(raw) - int(np.searchsorted(ends, place, side="right"))]
            state[on] = self._step(state[on], data[starts[on] + place].astype(np.int64))
            found[on] = np.minimum(found[on], self.best[state[on]])
        return found


def longest_of_many(df: DataFrame, column: str, names: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: the longest of the names that the column's text contains, case aside; of equal ones the first; null if none."""
    held = df.sparkSession.sparkContext.broadcast(Automaton.of(names))

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        automaton = held.value
        ranks, at = [], 0
        values = pa.array(texts, pa.string()).to_pylist()
        while at < len(values):
            size, to = 0, at
            while to < len(values) and (to == at or size + len(values[to] or "") <= BLOCK):
                size, to = size + len(values[to] or ""), to + 1
            ranks.append(automaton.longest(values[at:to]))
            at = to
        return pd.Series(automaton.names[np.concatenate([*ranks, np.zeros(0, dtype=np.int32)])], dtype=object)

    return df.withColumn(out, found(F.lower(F.col(column).cast("string"))))
