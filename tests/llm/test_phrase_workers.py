"""Phrase growth takes one Python worker for each task, and a worker holds one block at a time."""

import random
import tracemalloc
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

from slotweave.llm import collocations


def test_no_stage_has_two_python_steps(spark):
    docs = spark.createDataFrame([("a b c. a b d", "en")] * 12, "text string, lang string")
    texts = collocations.texts_of(docs)
    words = collocations.count_words(texts).cache()
    plans = []
    for df in (words, collocations.frequent_phrases(texts, words, 3, 5)):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        assert all(stage.count("MapInArrow") <= 1 for stage in plans[-1].split("Exchange"))
    assert plans[1].count("MapInArrow") == 2


ALL = collocations.Bitmap(3, np.full(1, 255, dtype=np.uint8))
HOT = np.sort(np.arange(7, dtype=np.uint64) << np.uint64(60))
STEPS = {
    "words": lambda texts: collocations.count_words(texts),
    "pairs": lambda texts: collocations.count_pairs(texts, ALL),
    "projections": lambda texts: collocations.project(texts, ALL, HOT, 3),
}


@pytest.mark.parametrize("step", STEPS)
def test_a_block_is_free_before_the_next(spark, step):
    texts = MagicMock()
    texts.sparkSession.sparkContext.broadcast = lambda value: SimpleNamespace(value=value)
    STEPS[step](texts)
    run = texts.mapInArrow.call_args_list[0].args[0]
    r = random.Random(5)
    # one block each, about 3 MB of text
    batches = [pa.record_batch([[" ".join(f"{r.randrange(10**6):06}" for _ in range(1000)) for _ in range(450)], ["en"] * 450], names=["text", "lang"]) for _ in range(3)]

    def peak(count):
        tracemalloc.start()
        assert sum(batch.num_rows > 0 for batch in run(iter(batches[:count]))) == count
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / 2**20

    peak(1)  # the tables of powers
    one = peak(1)
    assert peak(3) < one + 18  # what is put out may be held a while


def test_hot_pairs_are_marked():
    x = np.array([5, 0, 2**63 + 1, 9, 2**64 - 1], dtype=np.uint64)
    assert collocations._among(x, np.array([0, 9, 2**63 + 1], dtype=np.uint64)).tolist() == [False, True, True, True, False]
    assert not collocations._among(x, x[:0]).any() and not len(collocations._among(x[:0], x))


def test_tables_of_few_rows_are_few_files(spark, monkeypatch):
    new = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in new}
    files = []

    def checkpoint(df, plain=collocations.checkpoint):
        out = plain(df)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(collocations, "checkpoint", checkpoint)
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        text = ". ".join(f"w{k} x{k} y{k} z{k}" for k in range(300))
        docs = spark.createDataFrame([(text, "en")] * 12, "text string, lang string").repartition(3)
        found = collocations.collocations(docs, keep=400).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # three words in two ways a line; pairs are held by them
    assert len(found) == 400 and {(r["a"], r["n"], len(r["phrase"].split())) for r in found} == {(12, 14400, 3)}
    assert len(files) == 3 and max(files) <= max(8, spark.sparkContext.defaultParallelism) < 40
