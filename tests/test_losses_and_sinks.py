"""What mapping loses, told by the pass that writes; several target classes from one stream, exactly once."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from slotweave.operators import execute
from slotweave.operators.losses import Losses
from slotweave.plans.catalogue import _BASE, _FLAGS, _row, _sale, _wide, specs_of
from slotweave.plans.schemas import TARGET
from slotweave.sources.metadata import Schema
from slotweave.streaming import run as streaming

DDL = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, other string"
ROWS = [(1, 10, "F", "1-URGENT", "x"), (2, 20, "O", "odd", "x"), (3, 30, None, "odd", "x"), (None, 10, "Q", None, "x"), (5, 40, "O", "2-HIGH", "x")]
MAPS = [_sale("o_orderkey", "saleID"), _sale("o_orderstatus", "state", sourceValue="F", targetValue="closed"), _sale("o_orderpriority", "urgency", sourceValue="1-URGENT", targetValue="high")]


def run(spark, rows=ROWS, **more):
    losses = Losses()
    table = spark.createDataFrame(rows, DDL).repartition(3)
    out = execute.execute(specs_of(spark, maps=MAPS), {"orders": table}, Schema.parse(TARGET), losses=losses, **more)["sales"]
    return losses, out


def test_losses_of_one_pass(spark):
    losses, out = run(spark)
    found = out.collect()
    assert sorted((r["saleID"] or 0, r["state"], r["urgency"]) for r in found) == [(0, None, None), (1, "closed", "high"), (2, None, None), (3, None, None), (5, None, None)]
    assert {(r["source_slot"], r["value"]): r["n"] for r in losses.values(spark).collect()} == {("o_orderstatus", "O"): 2, ("o_orderstatus", "Q"): 1, ("o_orderpriority", "odd"): 2, ("o_orderpriority", "2-HIGH"): 1}
    assert {(r["target_slot"], r["reason"]): r["n"] for r in losses.counts(spark).collect()} == {("state", "unmapped value"): 3, ("urgency", "unmapped value"): 3, ("saleID", "required slot is null"): 1, ("state", "required slot is null"): 4}


def test_losses_of_nothing(spark):
    losses, out = run(spark, [])
    assert out.collect() == [] and losses.values(spark).count() == 0 and {r["n"] for r in losses.counts(spark).collect()} == {0}


def test_losses_read_the_source_once_and_only_what_is_mapped(spark, tmp_path):
    spark.createDataFrame(ROWS, DDL).write.parquet(str(tmp_path / "t"))
    losses = Losses()
    out = execute.execute(specs_of(spark, maps=MAPS), {"orders": spark.read.parquet(str(tmp_path / "t"))}, Schema.parse(TARGET), losses=losses)["sales"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>" in plan
    out.write.parquet(str(tmp_path / "out"))
    assert losses.values(spark).count() == 4


def test_losses_of_wide_groups(spark):
    wide = [_wide(c, measure_value=m, value_value="{{" + c + "}}") for m, c in (("quantity", "l_quantity"), ("tax", "l_tax"))]
    lineitem = spark.createDataFrame([(1, 1, 2.0, None, "A"), (2, 1, 3.0, 4.0, "X")], "l_orderkey long, l_linenumber int, l_quantity double, l_tax double, l_returnflag string")
    losses = Losses()
    out = execute.execute(specs_of(spark, maps=[*_BASE, *_FLAGS], wide=wide), {"lineitem": lineitem}, Schema.parse(TARGET), losses=losses)["measures"]
    assert out.count() == 4  # of source rows a loss counts once, however many rows come of them
    assert [(r["target_slot"], r["value"], r["n"]) for r in losses.values(spark).collect()] == [("flag", "X", 1)]


# --- many sinks ----------------------------------------------------------------------------------------------

SINKS = [*MAPS, _row("orders", "o_custkey", "people", "personID"), _row("orders", "o_orderpriority", "people", "note")]


class Killed(RuntimeError):
    pass


def source(spark, tmp_path, n):
    for k in range(n):
        rows = [(100 * k + j, j, "F", f"p{j}", "x") for j in range(5)]
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def start(spark, tmp_path, stream, **more):
    return streaming.start_many(spark, specs_of(spark, maps=SINKS), "orders", stream, Schema.parse(TARGET), str(tmp_path / "out"), str(tmp_path / "state"), **more)


@pytest.mark.parametrize("dies_at", [0, 1, 3, 5])
def test_a_run_that_is_killed_and_started_again(spark, tmp_path, dies_at):
    stream, written = source(spark, tmp_path, 3), []

    def write(rows, path):
        if len(written) == dies_at:
            written.append("killed")
            rows.limit(2).write.mode("overwrite").parquet(path)  # half of a batch is left behind
            raise Killed(path)
        written.append(path)
        streaming._write(rows, path)

    with pytest.raises(Exception, match="Killed"):
        start(spark, tmp_path, stream, write=write).awaitTermination()
    before = {c: streaming.read_class(spark, str(tmp_path / "out"), c).count() if dies_at > 1 else 0 for c in ("sales", "people")}
    assert before == dict.fromkeys(before, 5 * (dies_at // 2))  # whole batches only
    start(spark, tmp_path, stream, write=write).awaitTermination()
    sales, people = (streaming.read_class(spark, str(tmp_path / "out"), c) for c in ("sales", "people"))
    assert sorted(r["saleID"] for r in sales.collect()) == [100 * k + j for k in range(3) for j in range(5)]
    assert Counter(r["note"] for r in people.collect()) == {f"p{j}": 3 for j in range(5)} and "batch" not in people.columns
    start(spark, tmp_path, stream).awaitTermination()  # nothing new: nothing written
    assert streaming.read_class(spark, str(tmp_path / "out"), "sales").count() == 15


def test_a_batch_is_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        reads.add(1)
        return x

    stream = source(spark, tmp_path, 1).withColumn("o_orderkey", seen.asNondeterministic()("o_orderkey"))
    start(spark, tmp_path, stream).awaitTermination()
    assert reads.value == 5 and streaming.read_class(spark, str(tmp_path / "out"), "people").count() == 5
