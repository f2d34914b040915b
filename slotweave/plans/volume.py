"""Queries at the size of real sheets and lists: many wide groups with many slots, value lists of any size."""

from __future__ import annotations

import yaml
from pyspark.sql import Window
from pyspark.sql import functions as F

from slotweave.functions import versions
from slotweave.operators import compile as compiler
from slotweave.operators import execute, lists, prepare, reshape
from slotweave.operators.losses import Losses
from slotweave.plans.catalogue import _STATES, _item, _row, _sale, _wide, query, rows, rows_of, specs_of
from slotweave.plans.schemas import SOURCE, TARGET
from slotweave.sources.local import work_folder
from slotweave.sources.metadata import Schema
from slotweave.sources.tables import read_table
from slotweave.streaming import run as streaming

#: Wide groups of a sheet, their slots, and how many of these every group has in common.
_GROUPS, _SLOTS, _COMMON = 69, 40, 32
_CELLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_COMMON_SLOTS = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]


def _fan_out_sql() -> str:
    common = " + ".join(f"length(CAST({_COMMON_SLOTS[k % 4]} AS VARCHAR))" for k in range(_COMMON))
    cells = " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(_CELLS))
    return f"""
    SELECT 'group ' || g AS measure, count(*) AS n, CAST(sum({common}) AS BIGINT) AS letters, round(sum(CASE g % 4 {cells} END), 2) AS value, round(sum(CASE (g + 1) % 4 {cells} END * (g + 1)), 2) AS scaled
    FROM lineitem, range({_GROUPS}) t(g) GROUP BY g
    """


@query(_fan_out_sql())
def wide_many_groups(spark, sf_dir):
    """69 groups of 40 slots in one scan: 32 slots in common, 2 cells and 6 constants of each group's own."""
    base = [_item(_COMMON_SLOTS[k % 4], f"common{k}") for k in range(_COMMON)]
    constants = lambda g: {f"own{k}_value": f"{g}-{k}" for k in range(_SLOTS - _COMMON - 3)}
    wide = [
        _wide(_CELLS[g % 4], wideGroup=f"g{g}", measure_value=f"group {g}", value_value="{{" + _CELLS[g % 4] + "}}", scaled_expr=f"str(src.{_CELLS[(g + 1) % 4]} * {g + 1})", **constants(g))
        for g in range(_GROUPS)
    ]
    specs = specs_of(spark, maps=base, wide=wide)
    out = execute.execute(specs, {"lineitem": read_table(spark, sf_dir, "lineitem")}, Schema.parse(TARGET))["measures"]
    letters = sum((F.length(f"common{k}") for k in range(_COMMON)), F.lit(0))
    # in a step of its own: within the sums it takes some four times as long
    told = out.select("measure", letters.alias("letters"), "value", F.col("scaled").cast("double").alias("scaled"))
    return told.groupBy("measure").agg(F.count("*").alias("n"), F.sum("letters").alias("letters"), F.round(F.sum("value"), 2).alias("value"), F.round(F.sum("scaled"), 2).alias("scaled"))


def _parts(spark, sf_dir, settings: str):
    """Lineitem with its part as a coded value: a list of all parts, of which nine of ten are mapped."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("key"), F.concat_ws(" ", "p_brand", "p_name").alias("name"))
    source, target = yaml.safe_load(SOURCE), yaml.safe_load(TARGET)
    source["classes"]["lineitem"]["slots"].append("l_partkey")
    source["slots"]["l_partkey"] = {"range": "partSet"}
    target["classes"]["measures"]["slots"].append("part")
    target["slots"]["part"] = {"range": "partNames"}
    maps = rows(spark, _item("l_orderkey", "saleID"), _item("l_linenumber", "line"))
    coded = rows_of(part.filter("p_partkey % 10 <> 0"), F.col("p_partkey") + 2, _item("l_partkey", "part", sourceValue=F.col("key"), targetValue=F.col("name"), enumDerivationSettings=settings))
    read = Schema("star", source).with_values("partSet", part.select(F.col("p_partkey").alias("pos"), F.col("key").alias("value")))
    aimed = Schema("long", target).with_values("partNames", part.select(F.col("p_partkey").alias("pos"), F.col("name").alias("value")))
    specs = compiler.compile_mapping(spark, read, aimed, prepare.prepare_maps(reshape.union_all([maps, coded])), strict=True)
    return execute.execute(specs, {"lineitem": read_table(spark, sf_dir, "lineitem")}, aimed)["measures"]


def _parts_sql(unmapped: str) -> str:
    return f"SELECT l_orderkey AS \"saleID\", CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_partkey % 10 > 0 AND p_partkey IS NOT NULL THEN p_brand || ' ' || p_name ELSE {unmapped} END AS part FROM lineitem LEFT JOIN part ON l_partkey = p_partkey"


@query(_parts_sql("NULL"))
def enum_list_of_parts(spark, sf_dir):
    """A value for every part, compiled from a mapping row each."""
    return _parts(spark, sf_dir, "")


@query(_parts_sql("CAST(l_partkey AS VARCHAR)"))
def enum_list_of_parts_mirrored(spark, sf_dir):
    return _parts(spark, sf_dir, "mirror_source: true")


def _orders_list(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    return orders.select(F.col("o_orderkey").cast("string").alias("source_value"), F.concat(F.lit("buyer "), "o_custkey").alias("target_value"))


_ORDERS_SQL = "SELECT l_orderkey, l_linenumber, coalesce('buyer ' || o_custkey, CAST(l_orderkey AS VARCHAR)) AS buyer FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey"


@query(_ORDERS_SQL)
def value_list_of_orders(spark, sf_dir):
    """A list as large as the orders: its measured bytes say how it meets the data."""
    lineitem = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return lists.translated(lineitem, "l_orderkey", _orders_list(spark, sf_dir), "buyer", "keep")


@query(_ORDERS_SQL)
def value_list_beyond_broadcast(spark, sf_dir):
    """The same where nothing is small enough to be broadcast but the commonest values."""
    lineitem = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return lists.translated(lineitem, "l_orderkey", _orders_list(spark, sf_dir), "buyer", "keep", broadcast_bytes=0)


#: Versions made of a part's numbers, in six spellings; and as many conditions, by size.
_VERSION = "CASE p_partkey % 6 WHEN 0 THEN printf('%d.%d', a, b) WHEN 1 THEN printf('%d.%d.0', a, b) WHEN 2 THEN printf('v%d.%d.%d', a, b, c) WHEN 3 THEN printf('%d.%drc%d', a, b, c) WHEN 4 THEN printf('%d.%d.post%d', a, b, c) ELSE printf('1!%d.%d', a, b) END"
_CONDITIONS = {1: ">=2.3", 2: "<2.3", 3: "==2.3.*", 4: "~=2.3", 5: ">=2.3rc2", 0: "!=2.3"}
_NUMBERS = "p_partkey % 5 AS a, p_partkey // 5 % 7 AS b, p_partkey // 35 % 4 AS c"


@query(f"""
WITH v AS (SELECT p_partkey, p_size, {_NUMBERS} FROM part),
k AS (
  -- release numbers, then what kind it is: pre-release below, post-release above
  SELECT *, {_VERSION} AS version, CASE WHEN p_partkey % 6 = 5 THEN 1 ELSE 0 END AS epoch, CASE WHEN p_partkey % 6 = 2 THEN c ELSE 0 END AS third,
         CASE p_partkey % 6 WHEN 3 THEN -10 + c WHEN 4 THEN 1 + c ELSE 0 END AS kind FROM v
)
SELECT p_partkey, version, CASE p_size % 6
  WHEN 1 THEN kind >= 0 AND (epoch, a, b, third, kind) >= (0, 2, 3, 0, 0)
  WHEN 2 THEN kind >= 0 AND (epoch, a, b) < (0, 2, 3)
  WHEN 3 THEN kind >= 0 AND (epoch, a, b) = (0, 2, 3)
  WHEN 4 THEN kind >= 0 AND (epoch, a, b, third, kind) >= (0, 2, 3, 0, 0) AND epoch = 0 AND a = 2
  WHEN 5 THEN (epoch, a, b, third, kind) >= (0, 2, 3, 0, -8)
  ELSE kind >= 0 AND (epoch, a, b, third, kind) <> (0, 2, 3, 0, 0) END AS met,
  dense_rank() OVER (ORDER BY epoch, a, b, third, kind) AS place
FROM k
""")
def version_conditions(spark, sf_dir):
    """Versions of all parts against conditions by their keys; and their places, by nothing but the keys."""
    numbers = read_table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", *(x.strip() for x in _NUMBERS.replace("//", "div").split(",")))
    version = F.expr(_VERSION)
    condition = F.element_at(F.create_map(*(F.lit(x) for pair in _CONDITIONS.items() for x in pair)), (F.col("p_size") % 6).cast("int"))
    told = numbers.withColumn("version", version).withColumn("key", versions.version_key(F.col("version")))
    # every distinct key once, then its place: as many rows as there are versions
    places = told.select("key").distinct().withColumn("place", F.row_number().over(Window.orderBy("key")).cast("long"))
    return told.join(places, "key").select("p_partkey", "version", versions.meets_all(F.col("version"), F.array(condition)).alias("met"), "place")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN c_name IS NOT NULL THEN c_name ELSE 'Customer' END WHEN o_orderkey % 4 = 1 THEN CASE WHEN contains(lower(n_name), 'united') OR length(n_name) > 8 THEN n_name ELSE 'Customer' END
       WHEN o_orderkey % 4 = 2 THEN n_name END AS class
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = o_orderkey % 25
""")
def longest_of_many_classes(spark, sf_dir):
    """The longest name in a text, of all customers, all nations and a word that all customers begin with."""
    customers = [r[0] for r in read_table(spark, sf_dir, "customer").select("c_name").collect()]
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nations = [r[1] for r in nation.collect()]
    orders = read_table(spark, sf_dir, "orders").join(F.broadcast(nation), F.col("n_nationkey") == F.col("o_orderkey") % 25)
    who = F.format_string("customer#%09d", "o_custkey")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("for "), who, F.lit("."))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("custom customers of "), F.lower("n_name"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("to:"), "n_name", F.lit("!")))
    return reshape.longest_contained(orders.select("o_orderkey", text.alias("text")), "text", ["Customer", *nations, *customers], "class").select("o_orderkey", "class")


def _lossy(spark, sf_dir) -> Losses:
    """Orders written with lists that lack some statuses and priorities; what the writing told."""
    maps = [_sale("o_orderkey", "saleID"), _sale("o_orderstatus", "state", sourceValue="F", targetValue="closed"), *(_sale("o_orderpriority", "urgency", sourceValue=s, targetValue=t) for s, t in (("1-URGENT", "high"), ("5-LOW", "low")))]
    losses = Losses()
    orders = read_table(spark, sf_dir, "orders")
    out = execute.execute(specs_of(spark, maps=maps), {"orders": orders}, Schema.parse(TARGET), losses=losses)["sales"]
    out.write.parquet(work_folder(spark))
    return losses


@query("SELECT 'o_orderstatus' AS source_slot, 'state' AS target_slot, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL UNION ALL SELECT 'o_orderpriority', 'urgency', o_orderpriority, count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') GROUP BY ALL")
def values_that_became_null(spark, sf_dir):
    """Values that the lists lack, told by the one pass that writes the rows."""
    return _lossy(spark, sf_dir).values(spark).select("source_slot", "target_slot", "value", "n")


@query("SELECT 'state' AS target_slot, 'unmapped value' AS reason, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'urgency', 'unmapped value', count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') UNION ALL SELECT 'state', 'required slot is null', count(*) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'saleID', 'required slot is null', 0")
def losses_of_a_run(spark, sf_dir):
    return _lossy(spark, sf_dir).counts(spark).select("target_slot", "reason", "n")


@query("SELECT 'sales' AS class, o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS value FROM orders UNION ALL SELECT 'people', o_custkey, o_orderpriority FROM orders")
def stream_to_many_classes(spark, sf_dir):
    """One stream of orders, read once for each micro-batch, to the tables of two target classes."""
    folder = work_folder(spark)
    orders = read_table(spark, sf_dir, "orders")
    stream = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders.parque[t]")
    person = lambda slot, to: _row("orders", slot, "people", to)
    specs = specs_of(spark, maps=[_sale("o_orderkey", "saleID"), *(_sale("o_orderstatus", "state", sourceValue=s, targetValue=t) for s, t in _STATES), person("o_custkey", "personID"), person("o_orderpriority", "note")])
    streaming.start_many(spark, specs, "orders", stream, Schema.parse(TARGET), f"{folder}/out", f"{folder}/state").awaitTermination()
    sales, people = (streaming.read_class(spark, f"{folder}/out", c) for c in ("sales", "people"))
    return sales.select(F.lit("sales").alias("class"), F.col("saleID").alias("key"), F.col("state").alias("value")).unionAll(people.select(F.lit("people"), "personID", "note"))
