"""Word-shingle Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

Two documents link when ``jaccard(A, B) >= num / den`` for their sets of word
shingles.  The join is exact for every pair, and never enumerates the pairs of
a group that is already known to hang together.  Equal sets are one *node*.

Tiles.  Sizes are cut into bands ``[l, r]`` with ``r = l / threshold``; linked
sets sit in the same or in neighbouring bands, and each set enters the tiles of
its band and of the next.  Linked sets of a band differ in ``D`` shingles at most.
Each set is cut by hash range into ``D + s`` classes, so ``s`` classes at least
are equal in both.  Each set leaves out its ``s - 1`` weakest classes, by an order
of class contents that is the same everywhere; the strongest class that two sets
share is never among those, so the hashes of the other ``D + 1`` classes are tile
keys that linked sets cannot miss each other by.  ``s`` follows the band: it is so
large that empty classes, the weakest of all, are left out but in one set of
millions; sets with more of them than that share a tile of their band.  In bands
of so few shingles that no ``s`` does this, the keys are single shingles: of ``n``
shingles, rare ones first, the first ``n - ceil(t n) + 1`` meet every partner of
the same band or the band below, the first ``n - ceil(2 t n / (1 + t)) + 1`` every
partner in the band above.

A class is strong by its rare shingles.  How rare a shingle is comes from a table
of ``2**SKETCH_BITS`` counters over all documents; where counters collide, some
pruning is lost and no link.  So a tile holds several sets where these are near
copies, and hardly by chance or by a passage that many documents share.

Two rounds, however the data lie.
1. In each tile the smallest node is the pivot, and every node is compared with
   the pivots that it meets.
2. Tiles whose nodes are in more than one component are opened: nodes that may
   link across components by the bit-count bound are put out, each once for a
   tile, and get their shingles; then the pairs of a tile that still hang apart
   are compared, and the task puts out what joins components, less than a row for
   each node.  Tiles with the same nodes are opened once; tiles of more than
   ``TILE`` nodes are cut into block pairs that are spread over tasks.

A comparison bounds the overlap from above by the bit counts of hashed parity
signatures (``|A xor B|`` is at least the number of differing bits; a signature
has eight bits for each shingle that linked sets of its size may differ in), then
intersects the sorted shingle arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.llm.components import EDGE, connected_components
from slotweave.llm.text import (
    U64,
    blocks,
    broadcast_below,
    checkpoint,
    drop_tables,
    files_for,
    in_few,
    int_array,
    mix,
    shuffle_buckets,
    string_buffers,
    unused,
    window_hashes,
    word_hashes,
)

TILE = 2048
#: Shingles of a block whose sets are compared exactly within a task.
SHINGLES = 1 << 19
#: Rows of opened tiles of one lowest component that are dealt to a task, and pairs that it remembers.
DEAL_ROWS = 2048
SEEN = 100_000
SKETCH_BITS = 20
SKETCH_CHUNKS = 16
BUCKET_ENTRIES = 2_000_000
#: Tables of document keys are counted, and broadcast up to so many rows (of 16 or 24 bytes); beyond that texts are shuffled.
BROADCAST_KEYS = 1_000_000
#: Bytes of a tile's packed entry, and of a row of numbers.
ENTRY, ROW = 13, 40

_PACKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("pairs", pa.binary()), ("docs", pa.binary())])
_PACKED_DDL = "bucket int, keys binary, nodes binary, pairs binary, docs binary"
_DOC = np.dtype([("node", "<i8"), ("doc", "<i8"), ("known", "<i8"), ("text", "<i8"), ("n", "<i8")])
_PAIR = np.dtype([("key", "<u8"), ("a", "<i8"), ("b", "<i8")])


@dataclass(frozen=True)
class Bands:
    """Upper sizes of the bands; classes (0: keys are single shingles) and classes left out in each."""

    upper: np.ndarray
    classes: np.ndarray
    left_out: np.ndarray


def bands(num: int, den: int, largest: int) -> Bands:
    upper, classes, left_out, low, least = [], [], [], 1, 1
    while len(upper) < 2 or upper[-2] < largest:
        high = low * den // num
        differ = 2 * high * (den - num) // (den + num)
        # the smallest set that enters is of the band below
        for spare in range(max(3, differ // 3), 2 * differ):
            empty = (differ + spare) * math.exp(-least / (differ + spare))
            if empty + 5 * math.sqrt(empty) + 1 <= spare:
                break
        else:
            spare = 0
        upper.append(high)
        classes.append(differ + spare if spare else 0)
        left_out.append(max(0, spare - 1))
        least, low = low, high + 1
    return Bands(*(np.array(x, dtype=np.int64) for x in (upper, classes, left_out)))


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row; fewer words than ``size`` make one shingle."""
    grams = window_hashes(words, size)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            g = np.sort(grams[a : b - size + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif n:
            out.append(window_hashes(words[a:b], n))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number for each set: its node (0 for an empty set)."""
    sums = np.array([np.sum(mix(s ^ U64(0xA24BAED4963EE407))) + U64(len(s)) for s in sets], dtype=U64)
    return np.where([len(s) > 0 for s in sets], mix(sums), U64(0)).astype(np.int64)


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles + U64(0x9FB21C651E98DF25)) >> U64(64 - SKETCH_BITS)).astype(np.int64)


def _prefix_keys(flat: np.ndarray, sizes: np.ndarray, counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Mask of the ``most`` rarest shingles of each set.

    Shingles of equal counts are ordered by their hashes' upper halves; of those
    that are equal even then, all are taken.
    """
    order = (counts[_slots(flat)].astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (flat >> U64(32))
    chosen, at = np.zeros(len(flat), dtype=bool), 0
    for n, k in zip(sizes.tolist(), most.tolist(), strict=True):
        part = order[at : at + n]
        chosen[at : at + n] = part <= np.partition(part, k - 1)[k - 1]
        at += n
    return chosen


def _class_keys(flat: np.ndarray, row: np.ndarray, classes: np.ndarray, left_out: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows) of sorted sets: the hashes of each set's classes but the weakest, and one key for too many empty classes."""
    width = (U64(2**64 - 1) // classes.astype(U64)) + U64(1)
    of = flat // width[row]
    first = np.ones(len(flat), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (of[1:] != of[:-1])
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(flat))
    sums, strong = np.zeros(len(flat) + 1, dtype=U64), np.zeros(len(flat) + 1, dtype=np.int64)
    np.cumsum(mix(flat + U64(0x632BE59BD9B4E019)), out=sums[1:])
    np.cumsum(weights[_slots(flat)], out=strong[1:])
    content, strength, rows, number = sums[end] - sums[start], strong[end] - strong[start], row[start], of[start]
    empty = classes - np.bincount(rows, minlength=len(classes))
    order = np.lexsort((number, strength, rows))
    begin = np.searchsorted(rows, np.arange(len(classes)))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order)) - begin[rows[order]]
    kept = place >= (left_out - empty)[rows]
    keys = mix(content[kept] + number[kept] * U64(0x9E3779B97F4A7C15))
    many = np.flatnonzero(empty > left_out)
    return np.concatenate([keys, np.full(len(many), 0x5BD1E995, dtype=U64)]), np.concatenate([rows[kept], many])


def tile_keys(sets: list[np.ndarray], counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows): tile keys of sorted, non-empty shingle sets, those of their bands and of the next."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not len(sizes):
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    cut = bands(num, den, int(sizes.max()))
    usual = max(1.0, float(counts.sum()) / len(counts))
    weights = 1 + (64 / (1 + (counts / usual) ** 2)).astype(np.int64)
    own = np.searchsorted(cut.upper, sizes)
    keys, rows = [], []
    for up, most in ((0, sizes - -(-sizes * num // den) + 1), (1, sizes - -(-2 * num * sizes // (num + den)) + 1)):
        band = own + up
        by_class = cut.classes[band] > 0
        for chosen in (by_class, ~by_class):
            sub = np.flatnonzero(chosen)
            if not len(sub):
                continue
            part = flat[chosen[row]]
            of = np.repeat(np.arange(len(sub)), sizes[sub])
            if chosen is by_class:
                k, r = _class_keys(part, of, cut.classes[band[sub]], cut.left_out[band[sub]], weights)
            else:
                mask = _prefix_keys(part, sizes[sub], counts, most[sub])
                k, r = mix(part[mask]), of[mask]
            keys.append(mix(k + (band[sub][r] + 1).astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
            rows.append(sub[r])
    return np.concatenate(keys), np.concatenate(rows)


def _counted(size: int):
    """Documents -> (chunk, counters): how many sets hold a shingle of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for block in blocks(batches):
            data, offsets = string_buffers(block.column(0))
            words, bounds = word_hashes(data, offsets, lower=True)
            sets = shingle_sets(words, bounds, size)
            counts += np.bincount(_slots(np.concatenate(sets)), minlength=len(counts)).astype(np.uint32)
        if counts.any():
            parts = counts.reshape(SKETCH_CHUNKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, dtype=np.uint32).astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])


def shingle_counts(texts: DataFrame, size: int) -> np.ndarray:
    """Counters of all documents' shingles, 2**SKETCH_BITS of them whatever the corpus."""
    each = texts.select("text").mapInArrow(_counted(size), "chunk int, counts binary")
    rows = each.repartition(SKETCH_CHUNKS, "chunk").mapInArrow(_summed, "chunk int, counts binary").collect()
    out = np.zeros((SKETCH_CHUNKS, (1 << SKETCH_BITS) // SKETCH_CHUNKS))
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["counts"])
    return out.reshape(-1)


def _grouped(keys: np.ndarray) -> np.ndarray:
    """Start flags of equal consecutive keys."""
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    return first


def _tiles(size: int, num: int, den: int, buckets: int, held):
    """Documents -> packed tile entries, pairs found within the block, and document records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, block_no = held.value, 0
        for block in blocks(batches):
            block_no += 1
            data, offsets = string_buffers(block.column(2))
            words, bounds = word_hashes(data, offsets, lower=True)
            sets = shingle_sets(words, bounds, size)
            docs = np.zeros(len(sets), dtype=_DOC)
            docs["node"] = set_keys(sets)
            docs["doc"], docs["text"] = int_array(block.column(0), 0), int_array(block.column(1), 0)
            docs["known"] = ~np.asarray(block.column(0).is_null())
            docs["n"] = [len(s) for s in sets]
            # exact copies are one node
            nodes, at = np.unique(docs["node"], return_index=True)
            nodes, at = nodes[docs["n"][at] > 0], at[docs["n"][at] > 0]
            keys, rows = tile_keys([sets[k] for k in at], counts, num, den)
            order = np.lexsort((rows, keys))  # nodes ascend with rows
            keys, own = keys[order], nodes[rows[order]]
            first = _grouped(keys)
            lead = own[np.flatnonzero(first)][np.cumsum(first) - 1] if len(own) else own
            pairs = np.empty(int(np.count_nonzero(~first)), dtype=_PAIR)
            pairs["key"], pairs["a"], pairs["b"] = keys[~first], lead[~first], own[~first]
            pairs = pairs[pairs["a"] != pairs["b"]]
            keys, own = keys[first], own[first]
            low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]  # the rest is in the bucket
            bucket = ((keys >> U64(40)) % U64(buckets)).astype(np.int64)
            pair_bucket = ((pairs["key"] >> U64(40)) % U64(buckets)).astype(np.int64)
            order, pair_order = np.argsort(bucket, kind="stable"), np.argsort(pair_bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            pair_edges = np.searchsorted(pair_bucket[pair_order], np.arange(buckets + 1))
            home = block_no % buckets
            out: list[list] = [[] for _ in _PACKED]
            for k in range(buckets):
                mine, my_pairs = order[edges[k] : edges[k + 1]], pair_order[pair_edges[k] : pair_edges[k + 1]]
                if len(mine) or len(my_pairs) or k == home:
                    values = (k, low[mine].tobytes(), own[mine].tobytes(), pairs[my_pairs].tobytes(), docs.tobytes() if k == home else b"")
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PACKED, strict=True)], schema=_PACKED)

    return run


_MEMBERS = pa.schema([("kind", pa.int8()), ("tile", pa.int64()), ("pivot", pa.int64()), ("node", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64())])
_MEMBERS_DDL = "kind byte, tile long, pivot long, node long, doc_id long, text_key long, n long"


def _members(kind: int, rows: int, **columns: np.ndarray) -> pa.RecordBatch:
    def column(name: str) -> pa.Array:
        x = columns.get(name)
        return pa.nulls(rows, pa.int64()) if x is None else (x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)))

    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, dtype=np.int8)), *(column(f.name) for f in list(_MEMBERS)[1:])], schema=_MEMBERS)


def _tile(bucket: int, keys: np.ndarray) -> np.ndarray:
    """Number of a tile: its bucket and the lower 40 bits of its key; should two keys agree in them, their tiles are one."""
    return ((keys & U64((1 << 40) - 1)) | U64(bucket << 40)).astype(np.int64)


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed entries, sorted by bucket -> members of tiles with their pivots, and document records."""

    def settle(bucket: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        low = np.concatenate([np.frombuffer(k, dtype=np.uint8).reshape(-1, 5) for k, _ in parts])
        wide = np.zeros((len(low), 8), dtype=np.uint8)
        wide[:, :5] = low
        keys = wide.reshape(-1).view("<u8")
        nodes = np.concatenate([np.frombuffer(n, dtype="<i8") for _, n in parts])
        order = np.argsort(keys, kind="stable")
        keys, nodes = keys[order], nodes[order]
        # most keys stand alone
        same = keys[1:] == keys[:-1]
        shared = np.zeros(len(keys), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        keys, nodes = keys[shared], nodes[shared]
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        first = _grouped(keys)
        lead = nodes[np.flatnonzero(first)][np.cumsum(first) - 1] if len(nodes) else nodes
        other = (nodes != lead) & (first | _grouped(nodes))
        if other.any():
            yield _members(1, int(other.sum()), tile=_tile(bucket, keys[other]), pivot=lead[other], node=nodes[other])

    now, parts = None, []
    for batch in batches:
        for bucket, keys, nodes, pairs, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                if parts:
                    yield from settle(now, parts)
                now, parts = bucket, []
            parts.append((keys, nodes))
            p = np.frombuffer(pairs, dtype=_PAIR)
            if len(p):
                yield _members(1, len(p), tile=_tile(bucket, p["key"]), pivot=p["a"], node=p["b"])
            d = np.frombuffer(docs, dtype=_DOC)
            if len(d):
                doc = pa.array(d["doc"], mask=d["known"] == 0)
                yield _members(0, len(d), node=d["node"], doc_id=doc, text_key=d["text"], n=d["n"])
    if parts:
        yield from settle(now, parts)


def signature(shingles: np.ndarray, num: int, den: int) -> bytes:
    """Parity of the shingles in each of a power of two of bits: differing bits never outnumber differing shingles."""
    most = 2 * len(shingles) * (den - num) // num + 1
    width = max(64, 1 << (8 * most - 1).bit_length())
    bits = np.bincount((mix(shingles) & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _features(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            data, offsets = string_buffers(block.column(1))
            words, bounds = word_hashes(data, offsets, lower=True)
            sets = shingle_sets(words, bounds, size)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s, num, den) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "n", "bits", "shingles"],
            )

    return run


def _folded(bits: bytes, width: int) -> np.ndarray:
    """A signature as ``width`` bytes: a narrower one is the exclusive or of the wider one's parts."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, dtype=np.uint64).reshape(-1, width // 8), axis=0)


def _may_link(na, nb, differing, num: int, den: int) -> np.ndarray:
    """Upper bound on the overlap from the bit counts: |A n B| <= (|A| + |B| - differing) / 2."""
    return (na + nb - differing) * den >= num * (na + nb + differing)


def _bounded(num: int, den: int):
    """(a, b, na, nb, bits_a, bits_b) -> the pairs that the bit counts leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                width = min(len(x), len(y))
                keep.append(_may_link(na, nb, int(np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum()), num, den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x)) if len(y) else 0


def _exact(num: int, den: int):
    """(a, b, shingles_a, shingles_b) -> linked pairs, by intersection of the sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=U64) for v in (x, y))
                both = overlap(x, y)
                keep.append(both * den >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, features: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Those that link of at most ``most`` pairs (a, b): bit counts first, then the exact test."""
    bits = features.select("node", "n", "bits")
    sides = pairs.join(bits.toDF("b", "nb", "bits_b"), "b").join(bits.toDF("a", "na", "bits_a"), "a")
    pairs = sides.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_bounded(num, den), "a long, b long")
    left = features.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = features.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    links = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(_exact(num, den), "a long, b long")
    # not in_few: the tasks that compare stay as many as the sets ask for
    return checkpoint(links.repartition(files_for(links.sparkSession, most * EDGE)))


def _by_part(task, keys: int, names: list[str]):
    """A map over rows sorted by their first ``keys`` columns: the rows that ``task()`` makes of the rows of each key, as columns of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = task()

        def made(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
            found = work(*key, rows)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(len(names))], names=names)

        now, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:keys] != now:
                    if rows:
                        yield made(now, rows)
                    now, rows = row[:keys], []
                rows.append(row[keys:])
        if rows:
            yield made(now, rows)

    return run


class _Part:
    """Rows (block, node, component, n, bits, ...) of the part (x, y) of a tile: block x meets block y, and itself when x = y."""

    def __init__(self, x: int, y: int, rows: list[tuple], num: int, den: int):
        self.block, self.node, self.component, self.n = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
        width = min(len(r[4]) for r in rows)
        self.bits = np.stack([_folded(r[4], width) for r in rows])
        self.left, self.right = np.flatnonzero(self.block == x), np.flatnonzero(self.block == y)
        self.one, self.num, self.den = x == y, num, den

    def near(self, i: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of other groups that may link with row ``i`` by their bit counts, and the numbers of differing bits."""
        j = self.right[group[self.right] != group[i]]
        if self.one:
            j = j[self.node[j] > self.node[i]]
        differing = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=-1, dtype=np.int64)
        may = _may_link(self.n[i], self.n[j], differing, self.num, self.den)
        return j[may], differing[may]


def _open_nodes(num: int, den: int):
    """Rows (lo, deal, tile, x, y, ...) -> (tile, node, component, n): the nodes that may link with one of another component.

    Tiles of one lowest component ``lo`` come one after another, in as many tasks as
    their rows ask for; a pair opens its nodes in one tile of a task (or seldom more:
    a task remembers ``SEEN`` pairs).
    """

    def task():
        seen: set[tuple[int, int]] = set()
        deal = None

        def work(lo: int, number: int, tile: int, x: int, y: int, rows: list[tuple]) -> list[tuple]:
            nonlocal deal
            if deal != (lo, number) or len(seen) > SEEN:
                seen.clear()
            deal = lo, number
            part = _Part(x, y, rows, num, den)
            some = np.zeros(len(rows), dtype=bool)
            for i in part.left.tolist():
                j, _ = part.near(i, part.component)
                a = int(part.node[i])
                for k, b in zip(j.tolist(), part.node[j].tolist(), strict=True):
                    pair = (a, b) if a < b else (b, a)
                    if pair not in seen:
                        seen.add(pair)
                        some[i] = some[k] = True
            return [(tile, *(int(v[k]) for v in (part.node, part.component, part.n))) for k in np.flatnonzero(some)]

        return work

    return _by_part(task, 5, ["tile", "node", "component", "n"])


def _bridges(num: int, den: int):
    """Parts of tiles, with shingles -> (a, b): each component that links within the part join with a smaller one, and the smallest of these.

    Components that have been joined are one group from then on.
    A node is compared with the nearest of every other group first, then with
    whatever has not been joined by that.
    """

    def work(tile: int, x: int, y: int, rows: list[tuple]) -> list[tuple]:
        part = _Part(x, y, rows, num, den)
        ends = np.concatenate(([0], np.cumsum(part.n)))
        distinct, flat = np.unique(np.concatenate([np.frombuffer(r[5], dtype=U64) for r in rows]), return_inverse=True)
        sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        held = np.zeros(len(distinct), dtype=bool)
        group = part.component.copy()
        for i in part.left.tolist():
            j, differing = part.near(i, group)
            if not len(j):
                continue
            held[sets[i]] = True
            j = j[np.lexsort((differing, group[j]))]
            nearest = _grouped(group[j])
            for some in (j[nearest], j[~nearest]):
                some = some[group[some] != group[i]]
                both = np.array([np.count_nonzero(held[sets[k]]) for k in some], dtype=np.int64)
                links = both * den >= num * (part.n[i] + part.n[some] - both)
                if links.any():
                    met = np.append(group[some[links]], group[i])
                    group[np.isin(group, met)] = met.min()
            held[sets[i]] = False
        moved = group != part.component
        return sorted(set(zip(part.component[moved].tolist(), group[moved].tolist(), strict=True)))

    return _by_part(lambda: work, 3, ["a", "b"])


def _cut(rows: DataFrame) -> DataFrame:
    """``rows`` (tile, parts, node, ...) for each part (x, y) of their tiles that they take part in; ``parts`` blocks make all pairs of blocks."""
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    each = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = [c for c in rows.columns if c not in ("tile", "parts")]
    return each.select("tile", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", *rest)


def _apart(tiles: DataFrame, most: int, components: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows for ``_open_nodes`` of the tiles (``most`` rows) of several components, of tiles with the same nodes one; and a table to drop once they are used."""
    entries = tiles.select("tile", "node").union(tiles.select("tile", F.col("pivot").alias("node"))).distinct()
    placed = checkpoint(in_few(entries.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")), 2 * most * ROW))
    seen = F.struct(F.count("*"), F.sum(F.xxhash64("node").cast("decimal(20,0)")), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")))
    several = placed.groupBy("tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"), seen.alias("seen"))
    several = several.filter("lo <> hi AND members > 2")  # the one pair of two nodes has been compared
    chosen = several.groupBy("seen").agg(F.min("tile").alias("tile"), F.first("lo").alias("lo"), F.first("members").alias("members"), F.ceil(F.first("members") / TILE).cast("int").alias("parts"))
    deals = chosen.groupBy("lo").agg(F.ceil(F.sum(F.col("members") * F.col("parts")) / DEAL_ROWS).cast("int").alias("deals"))
    rows = placed.join(chosen.join(deals, "lo"), "tile").join(features.select("node", "n", "bits"), "node")
    cut = _cut(rows.select("tile", "parts", "node", "component", "n", "bits", "lo", "deals"))
    return cut.select("lo", F.pmod(F.xxhash64("tile", "x", "y"), F.col("deals")).alias("deal"), *(c for c in cut.columns if c not in ("lo", "deals"))), placed


def _joined(opened: DataFrame, features: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of components that links between the ``opened`` nodes of a tile join."""
    parts = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / SHINGLES)).cast("int").alias("parts")
    rows = opened.join(opened.groupBy("tile").agg(parts), "tile").join(features.select("node", "bits", "shingles"), "node")
    cut = _cut(rows.select("tile", "parts", "node", "component", "n", "bits", "shingles"))
    dealt = cut.repartition("tile", "x", "y").sortWithinPartitions("tile", "x", "y")
    return checkpoint(in_few(dealt.mapInArrow(_bridges(num, den), "a long, b long").distinct(), opened.count() * EDGE))


def _components(tiles: DataFrame, features: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) of all nodes that link with another one, by the two rounds."""
    met = tiles.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    most = tiles.count()
    links = _linked(met, features, num, den, most)
    first = connected_components(links)
    spread, placed = _apart(tiles, most, first, features)
    dealt = spread.repartition("lo", "deal").sortWithinPartitions("lo", "deal", "tile", "x", "y")
    opened = checkpoint(in_few(dealt.mapInArrow(_open_nodes(num, den), "tile long, node long, component long, n long").distinct(), placed.count() * ROW))
    more = _joined(opened, features, num, den)
    final = first if more.isEmpty() else connected_components(first.toDF("a", "b").union(more))
    drop_tables(links, placed, opened, more, *([] if final is first else [first]))
    return final


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per input row: doc_id, text_key, n_shingles, component_id, is_first.

    Words are lower-cased (A-Z only).  A document's set is its distinct shingles
    of ``size`` words; with fewer words the whole sequence is one shingle; with
    no words or a null text the set is empty and links with nothing.  Two rows
    link when ``den * |A n B| >= num * |A u B|``.  ``component_id`` is the
    smallest doc_id reachable by links, the row's own included; a null doc_id
    takes part in links, and stays null only where no doc_id is reachable.  Rows
    that repeat a doc_id are separate documents.  ``text_key`` is
    ``xxhash64(text)``; ``is_first`` marks the rows of each component's smallest
    doc_id (null is the largest; ties: the smaller ``text_key``), several only
    where rows repeat both; rows with an empty set are all first.  Shingles and
    sets are compared by 64-bit hashes.  Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    counts = shingle_counts(keyed, size)
    share = 4 * (den - num) / (den + num)  # a set of n shingles has about this share of n as keys
    buckets = max(shuffle_buckets(spark, 2), int(counts.sum() * share / BUCKET_ENTRIES))
    held = spark.sparkContext.broadcast(counts.astype(np.float32))
    packed = keyed.mapInArrow(_tiles(size, num, den, buckets, held), _PACKED_DDL)
    members = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_pivots, _MEMBERS_DDL)
    members = checkpoint(in_few(members, int(counts.sum() * share) * ENTRY))

    records = members.filter("kind = 0").select("node", "doc_id", "text_key", "n")
    tiles = members.filter("kind = 1").select("tile", "pivot", "node")
    full = records.filter("n > 0")
    many = records.count() * ROW
    sets = checkpoint(in_few(full.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")).alias("best")), many))

    nodes = tiles.select("node").union(tiles.select("pivot")).distinct()
    wanted = checkpoint(in_few(sets.join(nodes, "node").select("node", "best.doc_id", "best.text_key"), many))
    texts = keyed.toDF("d", "k", "text")
    found = broadcast_below(wanted, BROADCAST_KEYS).join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    once = found.groupBy("node").agg(F.first("text").alias("text"))  # rows may repeat
    usual = ROW + 10 * int(counts.sum()) // max(1, records.count())  # bytes of a document's shingles and signature
    features = checkpoint(in_few(once.mapInArrow(_features(size, num, den), "node long, n long, bits binary, shingles binary"), wanted.count() * usual))

    components = _components(tiles, features, num, den)
    drop_tables(features, wanted)

    of = sets.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("best").alias("least"))
    labels = of.join(least, "component").select("node", "least")
    same = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))
    named = full.join(labels, "node").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), same.alias("is_first"))
    empty = records.filter("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("is_first"))
    return in_few(named.union(empty), many)


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each linked group is kept.

    The one with the smallest doc_id stays (a null doc_id counts as the largest;
    ties by ``text_key``); of rows that repeat both doc_id and text, the one whose
    row has the smallest ``xxhash64`` stays.  Empty texts link with nothing, so
    each of them stays.  All columns stay, whatever their names.
    """
    firsts = checkpoint(jaccard_components(docs, size, num, den))
    d, k = unused(docs, "d"), unused(docs, "k")
    key = [F.col("doc_id").cast("long"), F.xxhash64("text")]
    on = key[0].eqNullSafe(F.col(d)) & (key[1] == F.col(k))
    repeated = firsts.filter("is_first AND n_shingles > 0").groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key")
    gone = firsts.filter("NOT is_first").select("doc_id", "text_key").distinct()
    some = not repeated.isEmpty()
    out = docs.join(broadcast_below((gone.union(repeated) if some else gone).toDF(d, k), BROADCAST_KEYS), on, "left_anti")
    if some:
        again = docs.join(repeated.toDF(d, k), on, "left_semi")
        row, columns = F.struct(*docs.columns), F.xxhash64(*docs.columns)
        out = out.union(again.groupBy(key[0].alias(d), key[1].alias(k)).agg(F.min_by(row, columns).alias("row")).select("row.*"))
    return out
