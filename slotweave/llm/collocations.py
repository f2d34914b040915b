"""Phrase collocation mining by contiguous pattern growth, in the manner of PrefixSpan.

A text is lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line ends, and
the pieces into words.  A word's id is a 64-bit hash of the word and its
language, so one walk serves all languages (equal ids of different words are not
told apart; among 10**8 frequent words that is a chance of 1 in 3,000).

1. Words of every language are counted; the frequent ones are the first prefixes.
2. Pairs of neighbouring frequent words are counted by hash, to know which
   prefixes of two words can grow.
3. In the scan, an *occurrence pointer* stands at every word that opens a pair
   that can grow.  Its projection is the pair and the words that follow it while
   each next pair can grow too.  Equal projections of a block are added up, so
   what leaves the scan is (words, count).
4. Every prefix of two words is one distributed task's: its projections are dealt
   to it in order, and the task extends the prefix to the right depth first,
   child after child, in one pass over them.  It holds one count for each depth,
   whatever the number of occurrences.  A prefix with more than a
   ``HOT_SHARE``-th of all pairs is split by its third word; the parts' sums are
   added afterwards.

Which words and pairs can grow is looked up in bitmaps of ``2**WORD_BITS`` and
``2**PAIR_BITS`` bits, 8 MB and 16 MB for any corpus.  Where bits are shared,
more projections are written than necessary; counts stay exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.llm.text import _LOWER, HASH_STEP, U64, _Powers, blocks, checkpoint, drop_tables, in_few, mix, string_buffers

PIECE_ENDS = ".,;:!?\n\v\f\r"
MOST_WORDS = 3
LEAST = 10
KEEP = 2000
WORD_BITS = 26
PAIR_BITS = 27
HOT_SHARE = 1000
#: Each language's best are sought in so many parts first, then among the best of these.
TOP_PARTS = 32

_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(PIECE_ENDS.encode())] = True
_BREAKS = _ENDS.copy()
_BREAKS[[0x20, 0x09]] = True
_POWERS = _Powers(0xC2B2AE3D27D4EB4F | 1)


def _looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``table[data]`` of bytes, without an index of eight bytes for each."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), dtype=table.dtype)


class Words:
    """The words of a block of rows: where they start and end, their ids, and which follow the one before in its piece."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        data, offsets = string_buffers(text)
        self.data = data = _looked_up(_LOWER, data)
        inside = ~_looked_up(_BREAKS, data)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        bounds = np.searchsorted(starts, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        coded = pc.dictionary_encode(lang)
        names = coded.dictionary
        raw, at = string_buffers(names)
        keys = mix(np.array([int.from_bytes(raw[a:b].tobytes(), "little") % (2**64 - 59) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=U64) + U64(1))
        self.ids = np.empty(len(starts), dtype=U64)
        of = keys[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else keys
        a = 0
        while a < len(starts):
            b = max(int(np.searchsorted(ends, starts[a] + HASH_STEP, side="right")), a + 1)
            low, high = starts[a], ends[b - 1]
            up, down = _POWERS.upto(int(high - low) + 1)
            sums = np.zeros(int(high - low) + 1, dtype=U64)
            np.cumsum((data[low:high].astype(U64) + U64(1)) * up[: high - low], out=sums[1:])
            s, e = starts[a:b] - low, ends[a:b] - low
            self.ids[a:b] = mix(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64)) ^ of[self.row[a:b]])
            a = b
        self.ids[self.ids == 0] = U64(1)  # 0 stands for no word
        piece = np.searchsorted(np.flatnonzero(_looked_up(_ENDS, data)), starts)
        self.joined = np.zeros(len(starts), dtype=bool)  # with the word after
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])

    def texts(self, which: np.ndarray) -> pa.Array:
        """The words at these positions, as strings."""
        sizes = self.ends[which] - self.starts[which]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        taken = self.data[np.repeat(self.starts[which] - offsets[:-1], sizes) + np.arange(offsets[-1])]
        return pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken.tobytes()))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0x9E3779B97F4A7C15) + b)


class Bitmap:
    """A set of hashes as bits of their lowest ``bits``; may hold more, never less."""

    def __init__(self, bits: int, octets: np.ndarray):
        self.mask, self.octets = U64((1 << bits) - 1), octets

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.octets[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0


def bitmap(hashes: DataFrame, column: str, bits: int) -> Bitmap:
    """Bitmap of a long column; at most 2**bits bits reach the driver, in parts of 4 KB."""
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    parts = hashes.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("octets"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():
        out[row["part"] * 4096 : row["part"] * 4096 + len(row["octets"])] = np.frombuffer(row["octets"], dtype=np.uint8)
    return Bitmap(bits, out)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _added_up(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One position of each distinct key, and how often it occurs."""
    _, first, n = np.unique(keys, return_index=True, return_counts=True)
    return first, n


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def _ids(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block's words, and which are in a piece with the word after; where the words stand is not kept."""
    words = Words(block.column(0), block.column(1))
    return words.ids, words.joined


def by_block(rows: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that puts out ``rows`` of each block; what they were made from is free again before the next block."""
    return lambda batches: map(rows, blocks(batches))


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, id, n) of all words."""

    def rows(block: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(block.column(0), block.column(1))
        first, n = _added_up(words.ids)
        langs = block.column(1).take(pa.array(words.row[first]))
        return pa.RecordBatch.from_arrays([langs, words.texts(first), _signed(words.ids[first]), pa.array(n)], ["lang", "word", "id", "n"])

    return texts.mapInArrow(by_block(rows), "lang string, word string, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def count_pairs(texts: DataFrame, frequent: Bitmap) -> DataFrame:
    """(pair, n): neighbours that may both be frequent, by the hash of the pair."""
    held = texts.sparkSession.sparkContext.broadcast(frequent)

    def rows(block: pa.RecordBatch) -> pa.RecordBatch:
        ids, joined = _ids(block)
        known = held.value.has(ids)
        at = np.flatnonzero(joined[:-1] & known[:-1] & known[1:])
        pairs = pair_hash(ids[at], ids[at + 1])
        first, n = _added_up(pairs)
        return pa.RecordBatch.from_arrays([_signed(pairs[first]), pa.array(n)], ["pair", "n"])

    return texts.mapInArrow(by_block(rows), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def project(texts: DataFrame, growing: Bitmap, hot: np.ndarray, most_words: int) -> DataFrame:
    """(w1 .. wk, n, hot): the pairs that occurrence pointers stand at and the words after them; 0 where it ends.

    ``hot`` are the hashes of pairs to be marked, in order.  They are marked here
    and not in a step of their own: each Python step of a stage takes a worker of
    its own for every task, and these stay in the executor's memory.
    """
    held = texts.sparkSession.sparkContext.broadcast((growing, hot))
    names = [f"w{k + 1}" for k in range(most_words)]

    def rows(block: pa.RecordBatch) -> pa.RecordBatch:
        growing, hot = held.value
        ids, opens = _ids(block)
        at = np.flatnonzero(opens)
        pairs = pair_hash(ids[at], ids[at + 1])
        opens[at] = grows = growing.has(pairs)
        pointers, pairs = at[grows], pairs[grows]
        found = [ids[pointers], ids[pointers + 1]]
        alive = np.ones(len(pointers), dtype=bool)
        for k in range(2, most_words):
            # the word after stands if the pair that it closes can grow
            alive = alive & opens[np.minimum(pointers + k - 1, len(opens) - 1)]
            found.append(np.where(alive, ids[np.minimum(pointers + k, len(opens) - 1)], U64(0)))
        key = np.zeros(len(pointers), dtype=U64)
        for w in found:
            key = pair_hash(key, w)
        first, n = _added_up(key)
        return pa.RecordBatch.from_arrays([*(_signed(w[first]) for w in found), pa.array(n), pa.array(_among(pairs[first], hot))], [*names, "n", "hot"])

    return texts.mapInArrow(by_block(rows), ", ".join(f"{w} long" for w in [*names, "n"]) + ", hot boolean")


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def grow(batches: Iterator[pa.RecordBatch], most_words: int, least: int) -> Iterator[pa.RecordBatch]:
    """Frequent extensions of every prefix, from projections in order.

    The columns are w1 .. wk, n and hot.  The order makes the walk depth first: a
    prefix's projections stand together, and within them those of each child.
    What is open at the end of a batch, one prefix of each length, is carried on.
    A hot prefix of two words is here in part only, so its count stays whatever it is.
    """
    names = [f"w{k + 1}" for k in range(most_words)]

    def out(words: np.ndarray, counts: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        keep = (counts >= least) | hot
        return pa.RecordBatch.from_arrays([*(pa.array(words[keep, k]) for k in range(most_words)), pa.array(counts[keep])], [*names, "n"])

    open_words = [np.zeros((0, most_words), dtype=np.int64) for _ in range(most_words + 1)]
    open_counts = [np.zeros(0, dtype=np.int64) for _ in range(most_words + 1)]
    open_hot = [np.zeros(0, dtype=bool) for _ in range(most_words + 1)]
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = np.stack([batch.column(k).to_numpy() for k in range(most_words)], axis=1)
        n, hot = batch.column(most_words).to_numpy(), batch.column(most_words + 1).to_numpy(zero_copy_only=False)
        for depth in range(2, most_words + 1):
            there = rows[:, depth - 1] != 0
            words = np.zeros((int(there.sum()), most_words), dtype=np.int64)
            words[:, :depth] = rows[there, :depth]
            words = np.concatenate([open_words[depth], words])
            if not len(words):
                continue
            counts = np.concatenate([open_counts[depth], n[there]])
            split = np.concatenate([open_hot[depth], hot[there] & (depth == 2)])
            starts = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1)))
            sums, words, split = np.add.reduceat(counts, starts), words[starts], split[starts]
            open_words[depth], open_counts[depth], open_hot[depth] = words[-1:], sums[-1:], split[-1:]
            yield out(words[:-1], sums[:-1], split[:-1])
    for depth in range(2, most_words + 1):
        yield out(open_words[depth], open_counts[depth], open_hot[depth])


def frequent_phrases(texts: DataFrame, words: DataFrame, most_words: int, least: int) -> DataFrame:
    """(w1 .. wk, n) of the phrases of two words or more that occur ``least`` times or more; ``words`` are the frequent ones."""
    frequent = bitmap(words, "id", WORD_BITS)
    # what occurs ``least`` times or more is no more than a ``least``-th of the words, for each length
    most = (words.agg(F.sum("n")).first()[0] or 0) // least
    pairs = checkpoint(in_few(count_pairs(texts, frequent).filter(F.col("n") >= least), 16 * most))
    growing = bitmap(pairs, "pair", PAIR_BITS)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    # at most HOT_SHARE pairs have that share of all
    hot = [r["pair"] for r in pairs.filter(F.col("n") > max(least, total // HOT_SHARE)).select("pair").collect()]
    drop_tables(pairs)
    names = [f"w{k + 1}" for k in range(most_words)]
    ordered = np.sort(np.array(hot, dtype=np.int64).view(U64))
    dealt = project(texts, growing, ordered, most_words).repartition("w1", "w2", F.when(F.col("hot"), F.col(names[min(2, most_words - 1)])).otherwise(0))
    ddl = ", ".join(f"{w} long" for w in [*names, "n"])
    grown = dealt.sortWithinPartitions(*names).mapInArrow(lambda batches: grow(batches, most_words, least), ddl)
    return in_few(grown.groupBy(*names).agg(F.sum("n").alias("n")).filter(F.col("n") >= least), 8 * (most_words + 1) * (most_words - 1) * (total // least))


def scored(phrases: DataFrame, words: DataFrame, most_words: int) -> DataFrame:
    """Phrases with their lang, text, and the counts and score of their lowest-scoring cut.

    ``phrases`` are the rows of ``frequent_phrases``; columns added: lang,
    phrase, size, a, l, r, score.
    """
    names = [f"w{k + 1}" for k in range(most_words)]
    out = phrases.withColumnRenamed("n", "a").withColumn("size", sum(F.when(F.col(w) != 0, 1).otherwise(0) for w in names))
    for w in names:
        known = words.select(F.col("id").alias(w), F.col("word").alias(f"t_{w}"), F.col("n").alias(f"n_{w}"), *([F.col("lang")] if w == "w1" else []))
        out = out.join(known, w, "left" if w not in ("w1", "w2") else "inner")
    cuts = []
    for k in range(1, most_words):
        # counts of the first k words, and of the rest, by size
        if k == 1:
            left = F.col("n_w1")
        else:
            out = out.join(phrases.filter(_size_is(names, k)).select(*names[:k], F.col("n").alias(f"l_{k}")), names[:k], "left")
            left = F.col(f"l_{k}")
        right = F.when(F.col("size") == k + 1, F.col(f"n_{names[k]}"))
        for size in range(k + 2, most_words + 1):
            rest = phrases.filter(_size_is(names, size - k)).select(*(F.col(names[j]).alias(names[j + k]) for j in range(size - k)), F.col("n").alias(f"r_{k}_{size}"))
            out = out.join(rest, names[k:size], "left")
            right = right.when(F.col("size") == size, F.col(f"r_{k}_{size}"))
        cuts.append(F.when(F.col("size") > k, F.struct(_floor_score(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))))
    best = F.array_min(F.filter(F.array(*cuts), lambda c: c.isNotNull()))
    phrase = F.concat_ws(" ", *(f"t_{w}" for w in names))
    return out.withColumn("best", best).select("lang", phrase.alias("phrase"), "size", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"), *names)


def _size_is(names: list[str], size: int) -> Column:
    ends = F.col(names[size]) == 0 if size < len(names) else F.lit(True)
    return (F.col(names[size - 1]) != 0) & ends


def _floor_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly: counts below 10**15."""
    wide = lambda c: c.cast("decimal(15,0)")
    top, bottom = F.lit(1000000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right)
    return F.call_function("div", top, bottom).cast("long")


def maximal(phrases: DataFrame, most_words: int, num: int = 50, den: int = 100) -> DataFrame:
    """Phrases that no longer one holds with at least num/den of their count."""
    names = [f"w{k + 1}" for k in range(most_words)]
    inner = None
    for size in range(3, most_words + 1):
        longer = phrases.filter(_size_is(names, size))
        for part in range(2, size):
            for at in range(size - part + 1):
                held = longer.select(*((F.col(names[at + j]) if j < part else F.lit(0).cast("long")).alias(names[j]) for j in range(most_words)), F.col("n"))
                inner = held if inner is None else inner.unionAll(held)
    if inner is None:
        return phrases
    most = inner.groupBy(*names).agg(F.max("n").alias("most"))
    return phrases.join(most, names, "left").filter(F.col("most").isNull() | (den * F.col("most") < num * F.col("n"))).drop("most")


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, keep: int = KEEP) -> DataFrame:
    """The best ``keep`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null lang is ``und``; repeated rows count each, and
    equal ranks are settled by count and phrase.  Without a frequent phrase, as
    in an empty table, there are no rows.  Other columns are ignored.
    """
    texts = texts_of(docs)
    counted = checkpoint(in_few(count_words(texts), texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0))
    words = counted.filter(F.col("n") >= least)
    phrases = checkpoint(frequent_phrases(texts, words, most_words, least))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    found = scored(phrases, words, most_words).join(maximal(phrases, most_words).select(*(f"w{k + 1}" for k in range(most_words))), [f"w{k + 1}" for k in range(most_words)], "left_semi")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    parts = found.withColumn("part", F.pmod(F.hash("phrase"), F.lit(TOP_PARTS)))
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= keep)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= keep)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = LEAST, keep: int = KEEP) -> str:
    """The same for phrases of two and three words as DuckDB SQL."""
    return rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
),
words AS MATERIALIZED (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM pieces) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, CASE WHEN i + 2 <= len(ws) THEN ws[i + 2] END AS w3
  FROM (SELECT lang, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM pieces)
),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= {least}),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
inner2 AS (SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, a.f AS l, b.f AS r
  FROM f2 JOIN words a ON a.lang = f2.lang AND a.w = f2.w1 JOIN words b ON b.lang = f2.lang AND b.w = f2.w2 LEFT JOIN inner2 i ON i.lang = f2.lang AND i.w1 = f2.w1 AND i.w2 = f2.w2
  WHERE most IS NULL OR 100 * most < 50 * f2.f
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || w3, f3.f, 1, a.f, b.f
  FROM f3 JOIN words a ON a.lang = f3.lang AND a.w = f3.w1 JOIN f2 b ON b.lang = f3.lang AND b.w1 = f3.w2 AND b.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || w3, f3.f, 2, b.f, a.f
  FROM f3 JOIN words a ON a.lang = f3.lang AND a.w = f3.w3 JOIN f2 b ON b.lang = f3.lang AND b.w1 = f3.w1 AND b.w2 = f3.w2
),
scores AS (SELECT *, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS score FROM cuts),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) JOIN totals USING (lang) WHERE rank <= {keep}
"""
