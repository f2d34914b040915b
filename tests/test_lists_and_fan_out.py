"""Value lists of any size, and wide groups that share what they have in common."""

import pytest
from pyspark.sql import functions as F

from slotweave.operators import compile as compiler
from slotweave.operators import execute, lists, prepare
from slotweave.plans import volume
from slotweave.plans.catalogue import _item, _sale, _wide, rows, specs_of
from slotweave.plans.schemas import SOURCE, TARGET
from slotweave.sources.local import local_table
from slotweave.sources.metadata import Schema

DATA = "k int, v string, _key string, _hit string, _n string"


def data_of(spark, values):
    return spark.createDataFrame([(k, v, "a", "b", "c") for k, v in enumerate(values)], DATA).repartition(4)


def plan_of(df):
    return df._jdf.queryExecution().toString()


VALUES = ["x", "y", None, "z", "hot", "", *["hot"] * 300, *[f"n{k}" for k in range(50)], "x", "dup"]
LIST = [("x", "X"), ("hot", "HOT"), ("", "blank"), ("dup", "second"), ("dup", "first"), (None, "null"), *((f"n{k}", f"N{k}") for k in range(0, 50, 2))]
KNOWN = {"x": "X", "hot": "HOT", "": "blank", "dup": "first", **{f"n{k}": f"N{k}" for k in range(0, 50, 2)}}


@pytest.mark.parametrize("most", [1 << 20, 2000, 0])
@pytest.mark.parametrize("share", [1000, 3])
@pytest.mark.parametrize("unmapped", ["null", "keep"])
def test_lists_by_any_way(spark, monkeypatch, most, share, unmapped):
    monkeypatch.setattr(lists, "HOT_SHARE", share)
    values = spark.createDataFrame(LIST, "source_value string, target_value string")
    out = lists.translated(data_of(spark, VALUES), "v", values, "t", unmapped, broadcast_bytes=most)
    assert out.columns == ["k", "v", "_key", "_hit", "_n", "t"]
    wanted = {k: KNOWN.get(v, v if unmapped == "keep" else None) for k, v in enumerate(VALUES)}
    assert {r["k"]: r["t"] for r in out.collect()} == wanted and out.count() == len(VALUES)


def test_ways_that_a_list_meets_the_data(spark):
    data, values = data_of(spark, VALUES), spark.createDataFrame(LIST, "source_value string, target_value string")
    broadcast = lists.translated(data, "v", values, "t")
    assert "BroadcastHashJoin" in plan_of(broadcast) and "SortMergeJoin" not in plan_of(broadcast)
    shuffled = lists.translated(data, "v", values, "t", broadcast_bytes=0)
    # rows with the hot value and null values stay where they are
    assert "SortMergeJoin" in plan_of(shuffled) and "BroadcastHashJoin" in plan_of(shuffled)


def test_values_that_are_unmapped_fail_where_told(spark):
    values = spark.createDataFrame(LIST, "source_value string, target_value string")
    with pytest.raises(Exception, match="unmapped value: "):
        lists.translated(data_of(spark, VALUES), "v", values, "t", "error").collect()


def test_empty_lists_and_tables(spark):
    none = spark.createDataFrame([], "source_value string, target_value string")
    for most in (0, 1000):
        assert [r["t"] for r in lists.translated(data_of(spark, ["a", None]), "v", none, "t", "keep", most).orderBy("k").collect()] == ["a", None]
        assert lists.translated(spark.createDataFrame([], DATA), "v", none, "t", broadcast_bytes=most).count() == 0


def large_list(spark, n, settings):
    """Specs with a list of n order keys, of which every second is mapped."""
    source, target = Schema.parse(SOURCE), Schema.parse(TARGET)
    source.raw["slots"]["l_orderkey"] = {"range": "keySet"}
    source.raw["enums"]["keySet"] = {"permissible_values": {str(k): {} for k in range(n)}}
    target.raw["enums"]["unitSet"] = {"permissible_values": {f"u{k}": {} for k in range(n)}}
    maps = [_item("l_linenumber", "line"), *(_item("l_orderkey", "unit", sourceValue=str(k), targetValue=f"u{k}", enumDerivationSettings=settings) for k in range(0, n, 2))]
    return compiler.compile_mapping(spark, source, target, prepare.prepare_maps(rows(spark, *maps)), strict=True), target


@pytest.mark.parametrize("settings", ["", "mirror_source: true"])
def test_a_large_list_is_no_literal(spark, settings):
    specs, target = large_list(spark, 4000, settings)
    lineitem = spark.range(5000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    out = execute.execute(specs, {"lineitem": lineitem}, target)["measures"]
    assert "u3998" not in plan_of(out) and "map(" not in plan_of(out) and "BroadcastHashJoin" in plan_of(out)
    found = sorted((r["unit"] or "") for r in out.collect())
    assert found == sorted(f"u{k}" if k < 4000 and k % 2 == 0 else str(k) if settings else "" for k in range(5000))


def test_two_hundred_thousand_values(spark):
    """A list of this size over rows of the data, without a literal in the plan and without a shuffle of the rows."""
    values = local_table(spark, [(str(k), f"t{k}") for k in range(200_000)], "source_value string, target_value string")
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = lists.translated(lineitem, "l_orderkey", values, "unit", "keep")
    assert len(plan_of(out)) < 50_000 and "BroadcastHashJoin" in plan_of(out)
    assert out.filter("unit <> concat('t', l_orderkey)").count() == 0 and out.count() == lineitem.count()


def test_lists_on_streams(spark, tmp_path):
    specs, target = large_list(spark, 2000, "")
    spark.range(3000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("l_orderkey long, l_linenumber int").parquet(str(tmp_path / "in"))
    out = execute.execute(specs, {"lineitem": stream}, target)["measures"]
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("unit IS NOT NULL").count() == 1000


# --- fan-out -------------------------------------------------------------------------------------------------


def wide_specs(spark, groups, slots):
    cells = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    wide = [_wide(cells[g % 4], wideGroup=f"g{g}", measure_value=f"m{g}", value_value="{{" + cells[g % 4] + "}}", note_expr=f"str({g}) + src.l_returnflag", **({"only_value": "one"} if g == 1 else {})) for g in range(groups)]
    return specs_of(spark, maps=[_item("l_orderkey", f"common{k}") for k in range(slots)] + [_item("l_linenumber", "line")], wide=wide)


@pytest.mark.parametrize("step", [1, 7, 96])
def test_every_group_gets_its_cells(spark, monkeypatch, step):
    monkeypatch.setattr(execute, "STEP_CELLS", step)
    lineitem = spark.createDataFrame([(k, k % 3, 1.0 * k, 2.0 * k, 3.0 * k, None if k == 2 else 4.0 * k, "AR"[k % 2], "s", "p") for k in range(5)], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, _step0 string, _place string")
    out = execute.execute(wide_specs(spark, 9, 3), {"lineitem": lineitem}, Schema.parse(TARGET))["measures"]
    found = sorted((r["common0"], r["common2"], r["line"], r["measure"], r["value"], r["note"], r["only"]) for r in out.fillna(-1.0, ["value"]).fillna("-", ["only"]).collect())
    wanted = [(str(k), str(k), k % 3, f"m{g}", -1.0 if k == 2 and g % 4 == 3 else 1.0 * (g % 4 + 1) * k, f"{g}{'AR'[k % 2]}", "one" if g == 1 else "-") for k in range(5) for g in range(9)]
    assert found == sorted(wanted)


def test_the_source_is_read_once_in_generated_code(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = execute.execute(wide_specs(spark, 69, 30), {"lineitem": lineitem}, Schema.parse(TARGET))["measures"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and all(line.lstrip(" +-:").startswith("*(") for line in plan.splitlines() if "Generate" in line or "Project" in line)
    assert out.count() == 69 * lineitem.count() and len(out.columns) == 35
    # no generated method is too large for the machine's compiler
    stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(out._jdf.queryExecution().executedPlan())
    sizes = [stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())]
    assert sizes and max(sizes) < 8000


def test_one_derivation_has_no_generator(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    out = execute.execute(specs_of(spark, maps=[_sale("o_orderkey", "saleID")]), {"orders": orders}, Schema.parse(TARGET))["sales"]
    assert "Generate" not in plan_of(out)


def test_many_groups_compute_letters_before_the_sums(spark):
    plan = volume.wide_many_groups(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    aggregate = next(line for line in plan.splitlines() if "Aggregate [" in line)
    assert "sum(" in aggregate and "length(" not in aggregate
