"""Quality rules as weak supervision, with DataFrame functions only.

Each rule looks at counts of one document and votes good (1), bad (0) or
abstains (-1).  Nothing is known about a rule's accuracy; expectation-
maximisation over the votes of all documents estimates, for each rule, how often
a vote is right on good and on bad documents.  A document's posterior
probability of being good then replaces the demand that every rule pass.  The
estimates are held where a rule cannot point the wrong way (``LEAST_GOOD``,
``LEAST_BAD``, ``TIMES``), so the two classes cannot change places.

Documents with equal votes are equal for the model, so Spark counts the
documents of each vote pattern and the model is fitted on those counts: with m
rules there are 3**m patterns at most, however large the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.llm.text import WORD, checkpoint, spaced

MIN_WORDS = 50
SYMBOL = "[#*$%&|<>]"
SHORT = r"[A-Za-z\x{C0}-\x{24F}]{1,3}"
ROUNDS = 20
SMOOTHING = 1.0
START = {"prior": 0.9, "good": 0.95, "bad": 0.5}
#: A rule is right on most good documents, may know one kind of bad document only, and never points the wrong way.
LEAST_GOOD, LEAST_BAD, TIMES = 0.9, 0.1, 2.0

#: Rule: (votes bad where, votes good where), in SQL over the counts of ``with_counts``; bad is tried first.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("20 * n_symbols > word_chars", "200 * n_symbols <= word_chars"),
    "symbol_words": ("4 * n_symbol_words > n_words", "50 * n_symbol_words <= n_words"),
    "short_words": ("25 * n_short_words < n_words", "10 * n_short_words >= n_words"),
    "sentences": ("60 * n_ends < n_words OR 3 * n_ends > n_words", "30 * n_ends >= n_words AND 5 * n_ends <= n_words"),
    "dup_lines": ("10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines <= n_lines"),
    "repeats": ("10 * n_repeat_words > 3 * n_words", "20 * n_repeat_words <= 3 * n_words"),
    "capitals": ("5 * n_capitals > word_chars", "10 * n_capitals <= word_chars"),
    "exclaims": ("20 * n_exclaims > n_words", "100 * n_exclaims <= n_words"),
    "variety": ("20 * n_distinct_words < 3 * n_words", "10 * n_distinct_words >= 3 * n_words"),
    "word_length": ("word_chars > 9 * n_words OR 2 * word_chars < 5 * n_words", "word_chars BETWEEN 3 * n_words AND 8 * n_words"),
}


def _count_of(text: str, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(F.col(text), pattern, ""))).cast("long")


def with_counts(docs: DataFrame) -> DataFrame:
    """Add the counts that the rules read, as columns of the struct ``_q`` (null text: none of anything)."""
    text = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_spaced", spaced(F.col("text")))
    worded = text.withColumn("_words", F.array_remove(F.split("_spaced", " "), ""))
    split = worded.withColumns({
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(WORD))),
        # one pass over the text leaves the few characters that are counted one by one
        "_marks": F.regexp_replace("_text", r"[^#*$%&|<>A-Z!]+", ""),
    })
    ahead = lambda i, k: F.get("_hashes", i + k)
    windows = F.slice(F.transform("_hashes", lambda h, i: F.xxhash64(h, ahead(i, 1), ahead(i, 2))), F.lit(1), F.greatest(F.size("_hashes") - 2, F.lit(0)))
    hashed = split.withColumn("_windows", windows)
    # only texts with a repeated window need their windows in order
    ordered = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ordered = hashed.withColumn("_ordered", ordered)
    near = lambda j: F.get("_ordered", j)["h"]
    twice = F.filter("_ordered", lambda w, j: (w["h"] == near(j - 1)) | (w["h"] == near(j + 1)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))))
    return ordered.withColumn(
        "_q",
        F.struct(
            F.size("_hashes").cast("long").alias("n_words"),
            F.length(F.replace("_spaced", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
            _count_of("_marks", r"[#*$%&|<>]+").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.col("_ordered").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            _count_of("_marks", r"[A-Z]+").alias("n_capitals"),
            _count_of("_marks", r"!+").alias("n_exclaims"),
            F.size(F.array_distinct("_hashes")).cast("long").alias("n_distinct_words"),
            F.when(F.length("_marks") == 0, F.lit(0)).otherwise(F.size(F.filter("_words", lambda w: F.rlike(w, F.lit(SYMBOL))))).cast("long").alias("n_symbol_words"),
            F.size(F.filter("_words", lambda w: (F.length(w) <= 3) & F.rlike(w, F.lit(rf"\A{SHORT}\z")))).cast("long").alias("n_short_words"),
            F.size(F.filter("_words", lambda w: F.endswith(w, F.lit(".")) | F.endswith(w, F.lit("!")) | F.endswith(w, F.lit("?")))).cast("long").alias("n_ends"),
        ),
    ).select(*docs.columns, "_q")


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words")


def votes() -> dict[str, Column]:
    """Vote of each rule: 1 good, 0 bad, -1 abstains."""
    return {name: F.expr(f"CASE WHEN n_words = 0 THEN -1 WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END") for name, (bad, good) in RULES.items()}


@dataclass(frozen=True)
class Model:
    """Share of good documents, and how often each rule's vote is right on good and on bad ones."""

    prior: float
    good: dict[str, float]
    bad: dict[str, float]

    def posterior(self, vote: dict[str, Column]) -> Column:
        """P(good | votes); an abstaining rule counts as no evidence."""
        yes, no = F.lit(self.prior), F.lit(1 - self.prior)
        for name, v in vote.items():
            yes = yes * F.when(v == 1, self.good[name]).when(v == 0, 1 - self.good[name]).otherwise(1.0)
            no = no * F.when(v == 1, 1 - self.bad[name]).when(v == 0, self.bad[name]).otherwise(1.0)
        return yes / (yes + no)


def fit(counts: DataFrame) -> Model:
    """Expectation-maximisation over the vote patterns of all documents in ``counts`` (the columns of ``_q``)."""
    patterns = [(row.asDict(), row["_n"]) for row in counts.select(*(v.alias(k) for k, v in votes().items())).groupBy(*RULES).agg(F.count("*").alias("_n")).collect()]
    prior, good, bad = START["prior"], dict.fromkeys(RULES, START["good"]), dict.fromkeys(RULES, START["bad"])
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS if total else 0):
        sure = []
        for p, n in patterns:
            yes, no = prior, 1 - prior
            for name in RULES:
                if p[name] >= 0:
                    yes *= good[name] if p[name] == 1 else 1 - good[name]
                    no *= bad[name] if p[name] == 0 else 1 - bad[name]
            sure.append((p, n * yes / (yes + no), n * no / (yes + no)))
        prior = (sum(y for _, y, _ in sure) + SMOOTHING) / (total + 2 * SMOOTHING)
        for name in RULES:
            spoke = [(p[name], y, n) for p, y, n in sure if p[name] >= 0]
            good[name] = (sum(y for v, y, _ in spoke if v == 1) + SMOOTHING) / (sum(y for _, y, _ in spoke) + 2 * SMOOTHING)
            bad[name] = (sum(n for v, _, n in spoke if v == 0) + SMOOTHING) / (sum(n for _, _, n in spoke) + 2 * SMOOTHING)
            good[name] = max(good[name], LEAST_GOOD)
            bad[name] = max(bad[name], LEAST_BAD, TIMES * (1 - good[name]))
    return Model(prior, good, bad)


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, p_good and kept.

    ``kept`` is false where ``base_failed`` (under 50 words, or more than half
    of the words in repeated 3-word windows), else whether the posterior is at
    least 0.5.  A null or empty text has no words and fails.  Null doc_ids and
    repeated rows are scored like any other row.  Other columns are ignored.
    """
    counts = checkpoint(with_counts(docs.select("doc_id", "text")).select("doc_id", "_q.*"))
    p = fit(counts).posterior(votes())
    scored = counts.withColumn("base_failed", base_failed()).withColumn("p_good", p)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns.

    Texts are counted twice, once to fit and once to filter, and written nowhere.
    """
    p = fit(with_counts(docs.select("doc_id", "text")).select("_q.*")).posterior(votes())
    # the input travels as one struct, so its columns may be named like a count; the outer
    # explode keeps the filter from being pushed into the computation of the counts
    counted = with_counts(docs.select(F.struct(*docs.columns).alias("_row"), "text")).select("_row", F.explode_outer(F.array("_q")).alias("_q"))
    return counted.select("_row", "_q.*").filter(~base_failed() & (p >= 0.5)).select("_row.*")


def oracle_sql() -> str:
    """The same as DuckDB SQL: counts, vote patterns, the fitting rounds one after another, verdicts."""
    vote = ", ".join(f"CASE WHEN n_words = 0 THEN -1 WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END AS v_{k}" for k, (bad, good) in RULES.items())
    names = list(RULES)
    yes = " * ".join(["prior", *(f"CASE v_{k} WHEN 1 THEN g_{k} WHEN 0 THEN 1 - g_{k} ELSE 1.0 END" for k in names)])
    no = " * ".join(["(1 - prior)", *(f"CASE v_{k} WHEN 1 THEN 1 - b_{k} WHEN 0 THEN b_{k} ELSE 1.0 END" for k in names)])
    rounds = [f"m0 AS (SELECT CAST({START['prior']} AS DOUBLE) AS prior, " + ", ".join(f"CAST({START['good']} AS DOUBLE) AS g_{k}, CAST({START['bad']} AS DOUBLE) AS b_{k}" for k in names) + ")"]
    s = SMOOTHING
    for r in range(ROUNDS):
        rates = ", ".join(
            f"greatest({LEAST_GOOD}, (coalesce(sum(y) FILTER (v_{k} = 1), 0) + {s}) / (coalesce(sum(y) FILTER (v_{k} >= 0), 0) + 2 * {s})) AS g_{k}, "
            f"(coalesce(sum(z) FILTER (v_{k} = 0), 0) + {s}) / (coalesce(sum(z) FILTER (v_{k} >= 0), 0) + 2 * {s}) AS c_{k}"
            for k in names
        )
        held = ", ".join(f"g_{k}, greatest(c_{k}, {LEAST_BAD}, {TIMES} * (1 - g_{k})) AS b_{k}" for k in names)
        rounds.append(
            f"m{r + 1} AS MATERIALIZED (SELECT prior, {held} FROM (SELECT (sum(y) + {s}) / (sum(n) + 2 * {s}) AS prior, {rates} FROM "
            f"(SELECT *, n * yes / (yes + no) AS y, n * no / (yes + no) AS z FROM (SELECT *, {yes} AS yes, {no} AS no FROM patterns, m{r}))))"
        )
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
rep AS (
  SELECT doc_id, count(DISTINCT k) AS c FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS times FROM win) WHERE times > 1
  ) GROUP BY doc_id
),
counts AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words,
         len(ls) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
         length(t) - length(replace(t, '!', '')) AS n_exclaims, len(list_distinct(ws)) AS n_distinct_words,
         len(list_filter(ws, lambda w: regexp_matches(w, '{SYMBOL}'))) AS n_symbol_words,
         len(list_filter(ws, lambda w: regexp_full_match(w, '{SHORT}'))) AS n_short_words,
         len(list_filter(ws, lambda w: regexp_matches(w, '[.!?]\z'))) AS n_ends
  FROM w LEFT JOIN rep USING (doc_id)
),
voted AS (SELECT *, {vote} FROM counts),
patterns AS MATERIALIZED (SELECT {", ".join(f"v_{k}" for k in names)}, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY ALL),
{", ".join(rounds)},
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {yes} AS yes, {no} AS no FROM voted, m{ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND yes / (yes + no) >= 0.5 AS kept
FROM judged
"""
