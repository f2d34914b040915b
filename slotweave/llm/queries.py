"""The corpus queries: thin digests of the operators in this subpackage, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slotweave.llm import classifier, collocations, dac, decontaminate, filter_audit, jaccard, licenses, packing, quality, secrets, sharding, substring, toxicity
from slotweave.llm.text import read_table, shared_folder

VOCABULARY = "word_bpe_49k.json"
SHARDS = [f"shard-{k:03d}" for k in range(128)]


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, re-parameterised ones included: doc_id, item_id, windows found and asked for, slots compared."""
    docs, benchmark = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.contaminated(docs, benchmark).select("doc_id", "item_id", "n_windows", "item_windows", "n_slots")


def op2_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base spans, all spans, and the number that the field added."""
    out = secrets.scan(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf")


def op3_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of documents: doc_id, license_id, best Dice coefficient, passages."""
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op4_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document, by the lookup table of 128 shards."""
    return sharding.place(read_table(spark, sf_dir, "documents").select("doc_id"), SHARDS).select("doc_id", "slot", "shard")


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and the weakly supervised verdict of every document."""
    out = quality.score(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from directly addressable codes written in ascending doc_id order."""
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    dac.write_tokens(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return dac.read_documents(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document once windows of 50 words that start in an earlier document are cut out."""
    out = substring.remove_repeats(read_table(spark, sf_dir, "documents"), window=50, with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from labels that are not held out."""
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.score(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 4096 tokens."""
    out = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), with_ids=False)
    return out.drop("ids")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at a Jaccard similarity of 0.9 of three-word shingles."""
    out = jaccard.jaccard_components(read_table(spark, sf_dir, "documents"), size=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of 120 orders of five filters keeps and removes at each step, in every source."""
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return filter_audit.audit(docs, labels)


def op12_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from labels that are not held out."""
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return classifier.score(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op13_phrase_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two or three words of each language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_template_decontamination": op1_template_decontamination,
    "op2_secret_crf": op2_secret_crf,
    "op3_license_dice": op3_license_dice,
    "op4_lookup_sharding": op4_lookup_sharding,
    "op5_weak_supervision": op5_weak_supervision,
    "op6_addressable_codes": op6_addressable_codes,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_compression_toxicity": op8_compression_toxicity,
    "op9_sum_of_squares_packing": op9_sum_of_squares_packing,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_filter_audit": op11_filter_audit,
    "op12_ftrl_quality": op12_ftrl_quality,
    "op13_phrase_growth": op13_phrase_growth,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP7 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w)
),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h),
covered AS (
  SELECT doc_id, list(DISTINCT k) AS ks
  FROM (SELECT win.doc_id, unnest(generate_series(i, i + 49)) AS k FROM win JOIN firsts USING (h) WHERE win.doc_id > first_doc)
  GROUP BY doc_id
),
kept AS (
  SELECT doc_id, len(ws) AS n_words, CASE WHEN ks IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ks, i)) END AS words
  FROM w LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_words - len(words) AS BIGINT) AS n_removed,
       sha256(array_to_string(words, ' ')) AS kept_sha256
FROM kept
"""

_OP10 = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS h FROM w
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM (SELECT * FROM s JOIN n USING (doc_id)) a JOIN (SELECT * FROM s JOIN n USING (doc_id)) b ON a.h = b.h AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_license_dice": licenses.oracle_sql(),
    "op5_weak_supervision": quality.oracle_sql(),
    "op7_substring_dedup": _OP7,
    "op10_ngram_jaccard": _OP10,
    "op11_filter_audit": filter_audit.oracle_sql(),
    "op13_phrase_growth": collocations.oracle_sql(),
}
