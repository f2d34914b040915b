"""Filter audit, quality classifier and phrase growth against brute force, with odd rows and hot keys."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from slotweave.llm import classifier, collocations, filter_audit
from slotweave.llm.text import U64

DDL = "doc_id long, text string, lang string, source string, n long, mask string, w1 string, rank int, part string"
LABELS = "doc_id long, quality int, toxic int"


def rows(spark, entries):
    """Rows of (doc_id, text, lang, source), with columns whose names clash with those inside."""
    return spark.createDataFrame([(*e, 1, "m", "w", 1, "p") for e in entries], DDL).repartition(3)


def filter_entries():
    r = random.Random(3)
    texts = ["", None, "one two", "a " * 60, " ".join(f"w{k}" for k in range(60)), " ".join(f"W{k}" for k in range(60)), "x # y", " ".join(f"é{k}" for k in range(80)) + " %", "AB" + "é" * 38, "ABC" + "é" * 37]
    texts += [" ".join(r.choice(["a", "b", "Cc", "d%", f"v{r.randrange(99)}"]) for _ in range(r.randrange(40, 70))) for _ in range(40)]
    return [(k, r.choice(texts), "en", r.choice(["s1", "s2", None, "s1"])) for k in range(120)] + [(None, "", "en", "s1"), (None, "one two", None, None), (7, "one two", "en", "s2"), (7, "one two", "en", "s2")]


def audit_by_force(entries, labels):
    first = {}
    for d, t, _, _ in entries:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    fails, out = [], {}
    for d, t, _, s in entries:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        fails.append((s or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    for part in {p for p, *_ in fails}:
        own, shapley = [x for x in fails if x[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before, here = set(order[: step - 1]), [x for x in own if f in x[1]]
                removed = [x for x in here if not x[1] & before]
                shapley[f] += len(removed)
                out[part, order, step] = [sum(not x[1] & (before | {f}) for x in own), len(removed), len(here) - len(removed), sum(x[1] == {f} for x in own), sum(x[2] for x in removed), sum(x[3] for x in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_filter_audit(spark):
    entries, labels = filter_entries(), [(k, k % 3 % 2, k % 5 % 2) for k in range(0, 120, 2)] + [(7, 1, None), (7, None, 1), (None, 1, 1), (999, 1, 1)]
    found = filter_audit.audit(rows(spark, entries), spark.createDataFrame(labels, LABELS)).collect()
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in found} == audit_by_force(entries, labels)
    assert len(found) == 600 * 3


def test_filter_audit_of_nothing(spark):
    nothing, labels = spark.createDataFrame([], DDL), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(nothing, labels).count() == 0
    lone = filter_audit.audit(rows(spark, [(1, None, None, None)]), labels).collect()
    assert len(lone) == 600 and {r["part"] for r in lone} == {""} and {r["kept"] for r in lone if r["filter_order"][r["step"] - 1] == "A"} == {0}


def quality_entries(n=240):
    r = random.Random(9)
    good = lambda: " ".join(f"{r.choice(['the', 'of', 'house', 'tree', 'and'])} {''.join(r.choices('abcdefg', k=6))}" for _ in range(r.randrange(8, 60))) + "."
    bad = lambda: " | ".join("".join(r.choices("abcdefg", k=6)) for _ in range(r.randrange(8, 60)))
    return [(k, bad() if k % 5 == 1 else good(), "en", "s", int(k % 5 != 1)) for k in range(n)]


def test_quality_on_held_out_labels(spark):
    entries = quality_entries()
    labels = spark.createDataFrame([(e[0], e[4], 0) for e in entries], LABELS)
    odd = [(None, "the house of the tree", "en", "s"), (3, entries[3][1], "en", "s"), (900, "", "en", "s"), (901, None, "en", "s"), (902, "the " * 200_000, "en", "s"), (903, "\t\n ", "en", "s")]
    docs = rows(spark, [e[:4] for e in entries] + odd)
    found = classifier.score(docs, labels).collect()
    assert len(found) == len(entries) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    of = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert all(of[e[0]]["held_out"] == (zlib.crc32(str(e[0]).encode()) % 5 == 0) for e in entries)
    held = [e for e in entries if of[e[0]]["held_out"]]
    assert len(held) > 20 and all(of[e[0]]["predicted"] == e[4] for e in held)
    assert of[900]["score"] == of[901]["score"] == of[903]["score"]
    assert len({r["score"] for r in found if r["doc_id"] == 3}) == 1


def test_held_out_labels_are_never_learnt(spark):
    entries = quality_entries(80)
    docs = rows(spark, [e[:4] for e in entries])
    flipped = [(e[0], 1 - e[4] if zlib.crc32(str(e[0]).encode()) % 5 == 0 else e[4], 0) for e in entries]
    one, other = (classifier.fit(docs, spark.createDataFrame(x, LABELS)) for x in (flipped, [(e[0], e[4], 0) for e in entries]))
    assert one.bias == other.bias and (one.weight == other.weight).all() and len(one.weight)


def test_quality_without_labels_or_rows(spark):
    nothing, labels = spark.createDataFrame([], DDL), spark.createDataFrame([], LABELS)
    assert classifier.score(nothing, labels).count() == 0
    assert [r["score"] for r in classifier.score(rows(spark, [(1, "a b", "en", "s")]), labels).collect()] == [0.5]


def test_runs_of_words_are_those_of_each_text_alone():
    texts = ["a b c d", "", None, "x", "Ab, #1 é!", "a b c d"]
    row, weight, share = classifier.runs(pa.array(texts))
    for k, text in enumerate(texts):
        alone = classifier.runs(pa.array([text], pa.string()))
        assert sorted(zip(weight[row == k], share[row == k], strict=True)) == sorted(zip(alone[1], alone[2], strict=True))
        n = len((text or "").split())
        assert len(alone[1]) == sum(n + 3 - size for _, size in classifier.GRAMS if n + 3 > size)


def phrases_by_force(entries, least, keep, most=3):
    counts, totals = {}, Counter()
    for _, t, lang, _ in entries:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for size in range(1, most + 1):
                for i in range(len(w) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        frequent, found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:keep], 1)]
    return sorted(out)


def phrase_entries():
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "ß!", "A,B", "New York City", "a.b"]
    texts = [" ".join(r.choices(vocabulary, k=r.randrange(0, 60))) for _ in range(60)] + ["hot pair " * 400, "", None, ".,;", "one\ntwo\rthree\x0bfour\tfive six " * 12, "x  y\t\tz. " * 30]
    return [(k, t, r.choice(["en", "en", "de", None, ""]), "s") for k, t in enumerate(texts)]


@pytest.mark.parametrize(("least", "keep"), [(10, 2000), (3, 7)])
def test_phrases(spark, least, keep):
    entries = phrase_entries() + phrase_entries()[:5]
    found = collocations.collocations(rows(spark, entries), least=least, keep=keep)
    assert sorted(map(tuple, found.collect())) == phrases_by_force(entries, least, keep)


@pytest.mark.parametrize("share", [1, 10, 10**6])
def test_longer_phrases_and_split_prefixes(spark, monkeypatch, share):
    monkeypatch.setattr(collocations, "HOT_SHARE", share)
    entries = phrase_entries()
    found = collocations.collocations(rows(spark, entries), most_words=4, least=4, keep=500)
    assert sorted(map(tuple, found.collect())) == phrases_by_force(entries, 4, 500, most=4)


def test_phrases_do_not_depend_on_bitmaps_or_batches(spark, monkeypatch):
    monkeypatch.setattr(collocations, "WORD_BITS", 16)
    monkeypatch.setattr(collocations, "PAIR_BITS", 16)
    entries = phrase_entries()
    assert sorted(map(tuple, collocations.collocations(rows(spark, entries)).collect())) == phrases_by_force(entries, 10, 2000)
    r = np.random.default_rng(1)
    table = r.integers(1, 4, (500, 3))
    table[r.random(500) < 0.3, 2] = 0
    table = table[np.lexsort(table.T[::-1])]
    batch = pa.RecordBatch.from_arrays([*(pa.array(table[:, k]) for k in range(3)), pa.array(np.ones(500, np.int64)), pa.array(np.zeros(500, bool))], ["w1", "w2", "w3", "n", "hot"])
    results = []
    for size in (500, 7, 1):
        parts = collocations.grow(iter([batch.slice(k, size) for k in range(0, 500, size)]), 3, 5)
        results.append(sorted(tuple(x.values()) for part in parts for x in part.to_pylist()))
    force = Counter(tuple([*row[:d], *[0] * (3 - d)]) for row in table.tolist() for d in (2, 3) if row[d - 1])
    assert results[0] == results[1] == results[2] == sorted((*k, n) for k, n in force.items() if n >= 5)


def test_phrases_of_nothing(spark):
    nothing = spark.createDataFrame([], DDL)
    assert collocations.collocations(nothing).count() == 0
    assert collocations.collocations(rows(spark, [(1, None, None, None), (2, "a b", "en", "s")])).count() == 0


def test_word_ids_keep_languages_apart():
    words = collocations.Words(pa.array(["The cat", "the cat", "a the"]), pa.array(["en", "en", "de"]))
    the, cat, the2, cat2, a, the3 = words.ids
    assert the == the2 and cat == cat2 and len({the, cat, a, the3}) == 4 and words.ids.dtype == U64
