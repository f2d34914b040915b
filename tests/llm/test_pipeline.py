"""The corpus pipeline, stage by stage against versions written here, on one small corpus with a case for every stage."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_edges import base_by_force, components_by_force, windows_by_force

import corpus_pipeline
from slotweave.llm import quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, d string, start long"
ITEM = "a farmer has 12 sheep and buys 30 more at the market then sells 12 of them and keeps 30 in the barn for the whole long winter"
PLAIN = "the quick brown fox jumps over one lazy dog while nine old cats sleep under that green wooden bridge near our house"


def corpus():
    """(rows, doc_ids that hold a benchmark item)"""
    r = random.Random(21)
    word = lambda: "".join(r.choices("abcdefghijklmnoprstu", k=r.choice([1, 2, 3, 3, 4, 6, 8, 10])))
    sentence = lambda: " ".join(word() for _ in range(r.randrange(7, 14))).capitalize() + "."
    text = lambda: " ".join(sentence() for _ in range(r.randrange(9, 30)))
    texts = [text() for _ in range(120)]
    near = [texts[0], texts[0], texts[1] + " extra words here", texts[2].replace(".", ". ", 1).replace("  ", " "), texts[3] + " " + text()]
    leaks = [f"{texts[5]} {ITEM} {sentence()}", f"{text()} {ITEM.replace('12', '17').replace('30', '44')} {sentence()}", f"{text()} {PLAIN} {sentence()}"]
    clashing = [f"{text()} {ITEM.replace('12 sheep', '17 sheep').replace('30 more', '44 more').replace('12 of', '19 of').replace('30 in', '31 in')}"]
    secret = [f"{text()} password = hunter2hunter {sentence()}", f"{text()}\ntoken: 'abcdef123456' and AKIA{'A1' * 9} {sentence()}", f"{text()} {'0a' * 14} {text()}"]
    junk = [" ".join(w + "###" for w in text().split()), " | ".join("".join(r.choices("abcdefgh", k=8)) for _ in range(120)), "short text", "", None, "word again " * 60]
    long = [" ".join(sentence() for _ in range(2500))]
    everything = [*texts, *near, *leaks, *clashing, *secret, *junk, *long]
    at = len(texts) + len(near)
    rows = [(k * 2, t, "en", "hot" if k % 3 else "s", len(t or ""), "w", None, 7) for k, t in enumerate(everything)]
    return [*rows, rows[7], rows[at + 5]], {2 * k for k in range(at, at + len(leaks))}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(corpus()[0], COLUMNS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, PLAIN), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def replaced(text):
    out, at = [], 0
    for _, s, e in base_by_force(text):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def test_every_stage_by_brute_force(spark, folder):
    rows, leaking = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scan", "packing"]
    seen = lambda frame: sorted((x["doc_id"], x["text"]) for x in frame.collect())

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(rows))), "text": [x[1] for x in rows]}))
    verdict = dict(con.sql(f"SELECT doc_id, kept FROM ({quality.oracle_sql()})").fetchall())
    wanted = sorted((x[0], x[1]) for k, x in enumerate(rows) if verdict[k])
    good = stages["quality rules"](spark, docs, folder)
    assert good.columns == docs.columns and seen(good) == wanted
    assert len(wanted) >= 120 and not {x[0] for x in wanted} & {x[0] for x in rows if x[1] is None or "###" in x[1] or " | " in x[1]}

    of, _ = components_by_force([t for _, t in wanted], 5, 80, 100)
    first = sorted({wanted[k] for k in range(len(wanted)) if wanted[of[k]] == wanted[k]})
    one = stages["n-gram Jaccard join"](spark, spark.createDataFrame(good.collect(), docs.schema), folder)
    assert one.columns == docs.columns and seen(one) == first
    assert len(first) < len(wanted) - 3

    clean = [x for x in first if x[0] not in leaking]
    assert not [x for x in clean if max(windows_by_force(x[1], PLAIN), windows_by_force(x[1], ITEM)) >= 0.5]
    kept = stages["benchmark decontamination"](spark, spark.createDataFrame(one.collect(), docs.schema), folder)
    assert kept.columns == docs.columns and seen(kept) == clean and len(clean) == len(first) - 3

    hidden = [(d, replaced(t)) for d, t in clean]
    safe = stages["secret scan"](spark, spark.createDataFrame(kept.collect(), docs.schema), folder)
    assert safe.columns == docs.columns and seen(safe) == hidden
    assert sum(t.count("[SECRET]") for _, t in hidden) == 4
    assert all(x["n_chars"] == len(x["text"]) for x in safe.collect())

    check_packed(stages["packing"](spark, spark.createDataFrame(safe.collect(), docs.schema), folder).collect(), hidden)
    check_packed(corpus_pipeline.run(spark, folder).collect(), hidden)


def check_packed(pieces, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = {}, {}
    for x in pieces:
        by_doc.setdefault(x["doc_id"], []).append(x)
        by_sequence.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    assert sorted(by_doc) == [d for d, _ in documents]
    for d, text in documents:
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 2], 0
        for x in sorted(by_doc[d], key=lambda x: x["start"]):
            own = ids[at : at + x["length"]]
            assert (x["start"], x["doc_tokens"], x["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(own, dtype="<u4").tobytes()))
            at += x["length"]
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at == 4096 or (at < 4096 and at & (at - 1) == 0)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
