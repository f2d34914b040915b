"""Corpus operators against brute force, round trips and planted cases, on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotweave.llm import dac, decontaminate, jaccard, licenses, packing, quality, secrets, sharding, substring, toxicity
from slotweave.llm import queries as corpus

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DDL = "doc_id long, text string, n_words string, window string"


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


def fixture_texts():
    r = random.Random(5)
    base = [prose(r, r.randrange(60, 140)) for _ in range(12)]
    passage = prose(r, 70)
    out = [*base, base[0], base[0], base[1] + " extra", base[2].replace("w1", "w2", 1), base[3] + " " + passage, passage + "\n" + base[4], base[5].upper(), "", None, "one", "one two", "a b c", " \t\n", "x " * 5000]
    out += ["password = hunter2hunter\nnothing", "key AKIA" + "A1" * 10 + " and " + "0a" * 14, "Released under the MIT License.\n" + base[6]]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    # columns with clashing names; a null doc_id; a repeated row
    rows = [(k * 3, t, "x", None) for k, t in fixture_texts()]
    return spark.createDataFrame([*rows, (None, "a null id", "x", None), rows[4]], DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_substring(docs, empty):
    table = rows_of(docs)
    starts = {}
    for d, t in table:
        w = words(t)
        for i in range(len(w) - 49):
            if d is not None:
                starts.setdefault(tuple(w[i : i + 50]), set()).add(d)
    wanted = []
    for d, t in table:
        w = words(t)
        gone = {i + j for i in range(len(w) - 49) if d is not None and min(starts[tuple(w[i : i + 50])]) < d for j in range(50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        wanted.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=key) == sorted(wanted, key=key)
    assert any(n for _, _, n, _ in got)
    assert substring.remove_repeats(empty).count() == 0


def test_jaccard(docs, empty):
    table = rows_of(docs)
    sets = []
    for _, t in table:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    of = list(range(len(table)))
    for i in range(len(table)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = of[i], of[j]
                of = [b if x == a else x for x in of]
    least = {c: min((table[i][0] for i in range(len(table)) if of[i] == c and table[i][0] is not None), default=None) for c in of}
    wanted = sorted(((table[i][0] is None, table[i][0] or 0, len(sets[i]), least[of[i]]) for i in range(len(table))), key=str)
    got = jaccard.jaccard_components(docs, 3, 90, 100).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got), key=str) == wanted
    assert jaccard.jaccard_components(empty).count() == 0


def test_quality(docs, empty):
    table = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = quality.score(table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").toPandas()
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pandas(table.select("doc_id", "text").toPandas()))
    wanted = con.sql(quality.oracle_sql()).df()
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, wanted[got.columns.tolist()].itertuples(index=False)))
    assert quality.score(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_licenses(docs, empty):
    got = licenses.scan(docs).collect()
    assert [r["license_id"] for r in got] == ["MIT"]
    assert licenses.scan(empty).count() == 0


def test_decontamination(spark, empty):
    question = "a farmer named Anna has 12 baskets and sells each of them for 5 dollars at the market on sunday morning how much does the farmer earn"
    other = question.replace("Anna", "Boris").replace("12", "31").replace("5 ", "9 ")
    table = spark.createDataFrame([(1, f"{prose(random.Random(1), 40)} {other} end", None, None), (2, prose(random.Random(2), 80), None, None), (3, None, None, None), (None, question, None, None)], DDL)
    benchmark = spark.createDataFrame([(7, question), (8, None), (9, "too short"), (10, prose(random.Random(3), 30))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(table, benchmark).collect()}
    assert got == {(1, 7), (None, 7)}
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(table, benchmark).collect()) == [2, 3]
    assert decontaminate.contaminated(empty, benchmark).count() == 0


def licensed(spark, *texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {(r["doc_id"], r["license_id"]): r["dice"] for r in rows}


def test_licenses_wrapped_over_lines(spark):
    plain = "Some text stands here.\nThis work is licensed under the GNU\nGeneral Public License, version 3.\nMore text follows in this line."
    marks = "int main;\n\n# This work is licensed under the GNU\n# General Public License,\n# version 3.\n#\n# More text follows.\ncode"
    assert licensed(spark, plain, marks, marks.replace("General Public License", "Other Things")) == {(0, "GPL-3.0"): 1.0, (1, "GPL-3.0"): 1.0}


def test_license_bodies(spark):
    import textwrap

    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
    wrapped = "\n".join(" * " + x for x in textwrap.wrap(mit, 70))
    got = licensed(spark, f"Copyright (c) 2020 A. Body\n\n{mit}\n\nmore", f"/*\n * Copyright (c) 2020 A. Body\n *\n{wrapped}\n *\n * more\n */")
    assert got == {(0, "MIT"): 1.0, (1, "MIT"): 1.0}


def leaks(spark, items, texts):
    """{(doc number, item number): (n_windows, item_windows)}"""
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"]) for r in decontaminate.contaminated(table, benchmark).collect()}


def test_decontamination_of_items_that_are_placeholders_mostly(spark):
    items = ["Tom has 3 apples, Anna has 5 pears, Ben has 7 figs and Sue has 2 plums.", "Compute 12 + 45 - 33 * 2 / 7 + 18 and give the result as a number", "What is 12 + 45 * 3 - 8 + 96 / 4 - 17 + 5 ?", "11 12 13 14 15 16 17 18 19"]
    changed = items[1].replace("12", "13").replace("45", "46"), items[2].replace("12", "13").replace("96", "95"), items[3].replace("14", "24").replace("16", "26")
    got = leaks(spark, items, [*(f"some words before, {x} and some behind" for x in items), *changed, "1 2 3 4 5 6 7 8 9 10 11 12"])
    assert got == {(0, 0): (10, 10), (1, 1): (7, 7), (2, 2): (3, 3), (3, 3): (2, 2), (4, 1): (7, 7)}


def test_decontamination_of_numbers_with_units_attached(spark):
    item = "two vehicles leave town at noon and the first drives 120km in one direction while the second covers 60KM before it stops for 5h and then turns back"
    changed = item.replace("120km", "95km").replace("60KM", "45km").replace("5h", "2h")
    got = leaks(spark, [item], [changed, changed.replace("95km", "95 km"), item.replace("120km", "120kmx").replace("60KM", "60th").replace("5h", "5g5")])
    assert got == {(0, 0): (24, 24), (1, 0): (24, 24)}


def test_decontamination_of_names_at_sentence_starts(spark):
    item = "Anna opens a shop and sells bread every morning. Anna pays rent to the owner each month. When the week ends the money that Anna keeps is counted twice."
    changed = item.replace("Anna", "Maria")
    mixed = item.replace("Anna pays", "Maria pays")  # no system: the windows without the exchanged word count
    got = leaks(spark, [item, item.replace("Anna", "Anna Smith")], ["Some text. " + changed, "a text, " + changed, "a text, " + changed.replace("When", "when"), mixed, "Some text. " + item.replace("Anna", "Maria Jones")])
    assert {k: v for k, v in got.items() if k[1] == 0} == {(0, 0): (22, 22), (1, 0): (22, 22), (2, 0): (22, 22), (3, 0): (14, 22), (4, 0): (22, 22)}
    assert got[4, 1] == (24, 24)
    item = "Three hours later the guests had left the house and nobody knew where the keys were"
    assert leaks(spark, [item], ["it was said that, " + item.replace("Three", "three")]) == {(0, 0): (9, 9)}


def test_secrets(docs, empty):
    field = secrets.train(*_chunks())
    got = {r["doc_id"]: r for r in secrets.scan(docs, field).collect()}
    for d, t in rows_of(docs):
        base = secrets.base_spans(t or "")
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
    assert sum(r["n_assign"] for r in got.values()) == 1 and sum(r["n_access"] for r in got.values()) == 1 and sum(r["n_hex"] for r in got.values()) == 1
    out = secrets.redact(docs, field)
    assert out.columns == docs.columns and not [r for r in out.collect() if "hunter2hunter" in (r["text"] or "")]
    assert secrets.scan(empty, field).count() == 0


def _chunks(words=6):
    r = np.random.default_rng(1)
    x = np.stack([r.integers(0, s, (40, words)) for s in secrets.SIZES], axis=2)
    y = (x[:, :, 1] == 3).astype(np.int64)
    return x, y, 20


def test_viterbi_on_runs_is_exact():
    field = secrets.train(*_chunks())
    r = np.random.default_rng(2)
    x = np.stack([r.integers(0, s, 300) for s in secrets.SIZES], axis=1)
    whole = field.viterbi(field.scores(x))
    assert field.tag(x, np.array([0, 300])).tolist() == whole


def test_toxicity(spark, empty):
    r = random.Random(9)
    table = [(k, prose(r, 120, 4000) + (" vile" + r.choice(["ness", "sort", "ly"]) + " " + prose(r, 3) + " vilesort nastyword") * (k % 4 == 0)) for k in range(400)]
    frame = spark.createDataFrame([(k, t, None, None) for k, t in table] + [(None, None, None, None), (401, "", None, None)], DDL)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    got = toxicity.score(frame, labels).collect()
    held = [x for x in got if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 400]
    assert np.mean([x["predicted"] == (x["doc_id"] % 4 == 0) for x in held]) > 0.95
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in held)
    assert all(0 <= x["score"] <= 1 for x in got) and len(got) == 402
    assert {x["predicted"] for x in toxicity.score(frame, labels.limit(0)).collect()} == {0}
    assert toxicity.score(empty, labels).count() == 0


def encoded(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids, 2]


def test_codes(spark, docs, empty, tmp_path):
    known = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    dac.write_tokens(known, str(tmp_path / "t"), VOCABULARY)
    got = dac.read_documents(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    at, every = 0, []
    for (d, t), r in zip(sorted(rows_of(known)), got, strict=True):
        ids = encoded(t)
        assert (r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) == (d, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at, every = at + len(ids), every + ids
    spots = spark.createDataFrame([(p,) for p in range(0, at, 97)], "position long")
    assert all(every[r["position"]] == r["id"] for r in dac.read_tokens(spark, str(tmp_path / "t"), spots).collect())
    dac.write_tokens(empty, str(tmp_path / "e"), VOCABULARY)
    assert dac.read_documents(spark, str(tmp_path / "e")).count() == 0
    ids = np.array([0, 255, 256, 65535, 65536, 2**32 - 1] * 300, dtype=np.uint32)
    coded = dac.Coded(dac.encode(ids))
    assert [coded[i] for i in range(len(ids))] == ids.tolist() and coded.slice(5, 900).tolist() == ids[5:900].tolist()


def test_packing(docs, empty):
    got = packing.pack(docs, VOCABULARY, 256).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["start"], list(r["ids"])))
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    for d, t in rows_of(docs):
        ids = encoded(t)
        found = [i for s, x in sorted(by_doc[d]) for i in x]
        assert found == ids or (d == 12 and len(found) == 2 * len(ids))
    padding = sum(0 if (n := sum(x for _, x in p)) & (n - 1) == 0 else 256 - n for p in by_sequence.values())
    assert padding == 0
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_sharding(spark, docs, empty):
    names = [f"s{k}" for k in range(7)]
    table = sharding.build_table(names, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    kept = sum(a == b for a, b in zip(table, sharding.build_table(names[:-1], 1009), strict=True) if a != 6)
    assert kept > 0.8 * sum(x != 6 for x in table)
    got = sharding.place(docs, names, size=1009).collect()
    assert len(got) == docs.count()
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % 1009
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert sharding.place(empty, names, size=1009).count() == 0


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in corpus.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(corpus.ORACLE_SQL) <= set(corpus.QUERIES)


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    alphabet = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(3, 9)))
    clean = [" ".join(alphabet() for _ in range(90)) + "." for _ in range(20)]
    leak = " ".join(alphabet() for _ in range(30))
    table = [*enumerate(clean), (100, clean[0]), (101, clean[1] + " more"), (102, clean[2] + " " + leak), (103, "short"), (104, None)]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in table], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {x["doc_id"] for x in out.select("doc_id").distinct().collect()} == set(range(20))
    assert out.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("ok")).filter("NOT ok").count() == 0
