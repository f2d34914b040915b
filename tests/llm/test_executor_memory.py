"""Few rows are written as few files, and workers give memory back: the rest of an executor's memory is Spark's."""

import pyarrow as pa
import pytest

from slotweave.llm import components, decontaminate, jaccard, text


@pytest.fixture
def wide(spark):
    """As many shuffle partitions as a session may hold, none put together."""
    new = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_few_rows_are_written_as_few_files(wide, monkeypatch):
    files = []

    def checkpoint(df):
        out = text.checkpoint(df)
        files.append(len(out.inputFiles()))
        return out

    for module in (components, decontaminate, jaccard):
        monkeypatch.setattr(module, "checkpoint", checkpoint)
    monkeypatch.setattr(components, "drop_tables", lambda *tables: None)
    monkeypatch.setattr(jaccard, "drop_tables", lambda *tables: None)
    most = max(8, wide.sparkContext.defaultParallelism)
    assert most < 40

    line = " ".join(f"w{k}" for k in range(120))
    rows = [(k, line if k % 2 else f"{line} v{k} v{k // 2}") for k in range(120)] + [(k, " ".join(f"x{k * j}" for j in range(60))) for k in range(120, 240)]
    rows += [(k, "Anna has 12 apples and buys 7 more at the market before she goes home today") for k in (240, 241)]
    docs = wide.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = jaccard.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(120, 241)]
    joined = len(files)
    assert joined > 10 and max(files) <= most

    bench = wide.createDataFrame([(k, f"Item {k}: " + " ".join(f"t{k}{c}" for c in "abcdefghijklm")) for k in range(60)] + [(99, rows[-1][1])], "item_id long, text string")
    clean = decontaminate.drop_contaminated(kept, bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [0, *range(120, 240)]
    assert len(files) > joined + 4 and max(files) <= most


def test_a_task_gives_back_what_arrow_holds():
    import numpy as np

    pool = pa.default_memory_pool()
    if pool.backend_name == "system":
        pytest.skip("nothing is held")
    words = np.char.add("w", np.arange(700_000).astype(str)).tolist()
    texts = [" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for block in text.blocks(iter([batch])):
        split = pa.compute.ascii_split_whitespace(block.column(0)).flatten().dictionary_encode()
        del split, block
    before = _private()
    pool.release_unused()
    assert before - _private() < 8


def _private() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return next(int(x.split()[1]) for x in f if x.startswith("Private_Dirty:")) / 1024
