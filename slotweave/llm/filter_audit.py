"""Filter interaction audit: what every order of five filters keeps and removes, by an incidence matrix product.

A document fails a set of the five filters: a mask of five bits.  What a filter
does at its place in an order depends on that mask alone, so 32 counts of each
part say everything.  Spark counts the documents of every part and mask, all of
them and those of either label; the three histograms of a part are rows of 32
numbers.  For each outcome an integer matrix of 32 masks by 600 places (120
orders of 5 steps) has a 1 where a document of that mask meets that outcome
there, and the rows times the matrix are the audit.

Only counts of a part and mask are shuffled for the histograms, 32 rows of a
part from each task at most, so a part may hold any share of the documents.
Texts are never shuffled: equal texts are found by a SHA-256 of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.llm.text import checkpoint, spaced

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
PLACES = [(order, step) for order in ORDERS for step in range(len(FILTERS))]

_OUT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((k, pa.int64()) for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))])
_DDL = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def incidence() -> dict[str, np.ndarray]:
    """The 32 by 600 matrices of the outcomes, and the 600 by 5 one that adds places up by their filter."""
    masks = np.arange(MASKS)
    out = {k: np.zeros((MASKS, len(PLACES)), dtype=np.int64) for k in ("kept", "removed", "redundant", "unique_fails")}
    own = np.zeros((len(PLACES), len(FILTERS)), dtype=np.int64)
    for place, (order, step) in enumerate(PLACES):
        bits = [1 << FILTERS.index(f) for f in order]
        before, here = sum(bits[:step]), bits[step]
        fails, gone = (masks & here) > 0, (masks & before) > 0
        out["kept"][:, place] = ~(fails | gone)
        out["removed"][:, place] = fails & ~gone
        out["redundant"][:, place] = fails & gone
        out["unique_fails"][:, place] = masks == here
        own[place, FILTERS.index(order[step])] = 1
    return {**out, "own": own}


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails by itself (null: empty)."""
    filled = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(spaced(text), " "), "")
    capitals = F.length(filled) - F.length(F.regexp_replace(filled, "[A-Z]+", ""))
    # the words are made once: the higher-order function binds them to a name
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    short, dull = F.when(counted["n"] < 50, 1).otherwise(0), F.when(100 * counted["d"].cast("long") < 65 * counted["n"].cast("long"), 2).otherwise(0)
    loud = F.when(100 * capitals.cast("long") > 5 * F.length(filled).cast("long"), 4).otherwise(0)
    return (short + dull + loud + F.when(F.rlike(filled, F.lit("[#$%&*|]")), 8).otherwise(0)).cast("int")


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: part, mask (bits A to E), good and toxic (0 or 1).

    A document fails E where any smaller doc_id has its text.  A null doc_id is
    smaller than none and none is smaller, so it neither fails E nor makes
    others fail; rows that repeat a doc_id don't make each other fail.  A label
    counts if any label row of the doc_id has it.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), own_failures(F.col("text")).alias("own"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    )
    rows = checkpoint(rows)
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    named = rows.filter("doc_id IS NOT NULL")
    # a digest meets its smallest doc_id by both, so a text that a third of the rows hold is no hot key
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(1))
    found = named.join(firsts, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    found = found.select("part", F.when(F.col("first").isNull(), F.col("own") + 16).otherwise(F.col("own")).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return found.unionAll(rows.filter("doc_id IS NULL").select("part", F.col("own").alias("mask"), F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matrices = incidence()
    steps = pa.array([step + 1 for _, step in PLACES], pa.int32())
    orders = pa.array([order for order, _ in PLACES])
    filters = np.array([FILTERS.index(order[step]) for order, step in PLACES])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            block = batch.slice(at, 256)
            part, n = block.column(0), block.num_rows
            owner = np.repeat(np.arange(n), np.diff(block.column(1).offsets.to_numpy()))
            entries = block.column(1).flatten()
            mask = entries.field("mask").to_numpy(zero_copy_only=False)
            rows = {}
            for kind in ("docs", "good", "toxic"):
                rows[kind] = np.zeros((n, MASKS), dtype=np.int64)
                rows[kind][owner, mask] = entries.field(kind).to_numpy(zero_copy_only=False)
            made = {k: rows["docs"] @ matrices[k] for k in ("kept", "removed", "redundant", "unique_fails")}
            made["good_lost"], made["toxic_lost"] = rows["good"] @ matrices["removed"], rows["toxic"] @ matrices["removed"]
            made["shapley"] = (made["removed"] @ matrices["own"])[:, filters]
            repeated = [part.take(pa.array(np.repeat(np.arange(n), len(PLACES)))), pa.concat_arrays([orders] * n), pa.concat_arrays([steps] * n)]
            yield pa.RecordBatch.from_arrays([*repeated, *(pa.array(made[k].reshape(-1)) for k in _OUT.names[3:])], schema=_OUT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows of each part (value of ``source``; null: empty string): filter_order, step and the counts there.

    kept, removed and redundant count the part's documents after and at the
    step; unique_fails those that fail its filter alone; good_lost and
    toxic_lost the labelled ones among the removed; shapley what its filter
    removes, over all orders.  No documents, no parts, no rows.  Repeated rows
    count each; other columns are ignored.
    """
    counts = failure_masks(docs, labels).groupBy("part", "mask").agg(F.count("*").alias("docs"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    # at most 32 entries of a part
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("entries")).mapInArrow(_multiply, _DDL)


def oracle_sql() -> str:
    """The same as DuckDB SQL: masks joined with all places, one sum for each outcome."""
    return r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
firsts AS (SELECT t, min(doc_id) AS first_id FROM w GROUP BY t),
masks AS (
  SELECT part, doc_id, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
         regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails
  FROM w JOIN firsts USING (t)
),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, fails),
f AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM f a, f b, f c, f d, f e
  WHERE a.k <> b.k AND a.k <> c.k AND a.k <> d.k AND a.k <> e.k AND b.k <> c.k AND b.k <> d.k AND b.k <> e.k AND c.k <> d.k AND c.k <> e.k AND d.k <> e.k
),
places AS (SELECT o, k AS step FROM orders, f),
judged AS (
  SELECT part, o, step, o[step] AS filter, n, good, toxic, fails[o[step]] AS here,
         len(list_filter(o[1:step - 1], lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS times
  FROM counts, places
),
summed AS (
  SELECT part, o, step, filter, sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN here AND times = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, o, step, filter
)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM summed
"""
