"""Queries whose answer is an order, and a run from files."""

from __future__ import annotations

import yaml
from pyspark.sql import functions as F

from slotweave.operators import compile as compiler
from slotweave.operators import execute, prepare, reshape
from slotweave.plans import more
from slotweave.plans.catalogue import _BASE, query, rows
from slotweave.plans.run import run
from slotweave.plans.schemas import SOURCE, TARGET
from slotweave.sources import specs as stored
from slotweave.sources import tables
from slotweave.sources.local import local_table, work_folder
from slotweave.sources.metadata import Schema
from slotweave.sources.tables import read_table


@query("""
SELECT l_orderkey AS "saleID", CAST(l_linenumber AS BIGINT) AS line, measure, CASE r % 2 WHEN 0 THEN l_quantity ELSE l_tax END AS value
FROM lineitem, (SELECT n_regionkey AS r, max_by(n_name, n_nationkey) AS measure FROM nation GROUP BY n_regionkey)
""")
def wide_rows_in_order(spark, sf_dir):
    """Rows of one slot each under row numbers, mixed in the sheet: those of a number make one derivation, of rows for one slot the last counts."""
    nation = read_table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    cell = lambda n, slot, value: {"sourceClass": "lineitem", "targetClass": "measures", "targetSlot": slot, "targetValue": value, "wideRowNumber": str(n["n_regionkey"])}
    wide = [cell(n, slot, value) for n in nation for slot, value in (("measure", n["n_name"]), ("value", "{{l_tax}}" if n["n_regionkey"] % 2 else "{{l_quantity}}"))]
    specs = compiler.compile_mapping(spark, Schema.parse(SOURCE), Schema.parse(TARGET), prepare.prepare_maps(rows(spark, *_BASE)), prepare.prepare_wide_rows(rows(spark, *wide)), strict=True)
    return execute.execute(specs, {"lineitem": read_table(spark, sf_dir, "lineitem")}, Schema.parse(TARGET))["measures"]


@query("""
SELECT row_number() OVER (ORDER BY n_name) - 1 AS place, n_name AS value, 'sourceSlot,sourceEnumName,sourceEnumValue,numMappers,mapper' AS columns FROM nation WHERE n_nationkey % 2 = 1
""")
def report_in_order(spark, sf_dir):
    """A report's findings in the order of their keys, its columns in the order of the sheets."""
    report = more._report(spark, sf_dir, "missing_source_enum_values", "*")
    wanted = ["sourceSlot", "sourceEnumName", "sourceEnumValue", "numMappers", "mapper"]
    columns = ",".join(c for c in report.columns if c in wanted)
    return local_table(spark, [(k, r["sourceEnumValue"], columns) for k, r in enumerate(report.collect())], "place long, value string, columns string")


@query("SELECT row_number() OVER (ORDER BY sheet, key) - 1 AS place, CAST(key AS VARCHAR) AS key FROM (SELECT 1 AS sheet, n_nationkey AS key FROM nation UNION ALL SELECT 0, r_regionkey FROM region)")
def sheets_in_order(spark, sf_dir):
    """Rows of several files, by the files' names and then by line."""
    folder = work_folder(spark)
    for table, key, path in (("nation", "n_nationkey", f"{folder}/b.csv"), ("region", "r_regionkey", f"{folder}/a.tsv")):
        tables.write_rows(read_table(spark, sf_dir, table).select(F.col(key).cast("string").alias("key")).orderBy(F.col(key).cast("int")).coalesce(1), path)
    found = tables.read_folder(spark, [f"{folder}/b.csv", f"{folder}/a.tsv"]).orderBy("_ord").collect()
    return local_table(spark, [(k, r["key"]) for k, r in enumerate(found)], "place long, key string")


@query("SELECT o_custkey, string_agg(p, ';' ORDER BY p) AS priorities FROM (SELECT o_custkey, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O') GROUP BY o_custkey")
def common_values(spark, sf_dir):
    """Priorities that a customer has among open and among closed orders."""
    found = reshape.common_values(read_table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")
    return found.select("o_custkey", F.array_join("values", ";").alias("priorities"))


@query("SELECT 't' || s_suppkey AS target_class, slot AS target_slot FROM supplier, (VALUES ('saleID'), ('state')) s(slot) WHERE s_suppkey % 3 > 0 AND (slot = 'saleID' OR s_suppkey % 3 = 1)")
def run_from_files(spark, sf_dir):
    """Options, schemas and two sheets with a row for every supplier, tagged for runs that take them or not; the specs that the run leaves."""
    folder = work_folder(spark)
    suppliers = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    row = F.struct(F.lit("orders").alias("sourceClass"), F.lit("o_orderkey").alias("sourceSlot"), F.concat(F.lit("t"), "s_suppkey").alias("targetClass"), F.lit("saleID").alias("targetSlot"))
    tag = F.element_at(F.array(F.lit("off"), F.lit("core>=3.0"), F.lit("")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    tables.write_rows(suppliers.select(row.alias("r"), tag.alias("selectors")).select("r.*", "selectors"), f"{folder}/b_maps.csv")
    more_rows = suppliers.select(row.alias("r"), "s_suppkey").select("r.*", F.when(F.col("s_suppkey") % 3 == 1, "1").otherwise("0").alias("Complete"))
    tables.write_rows(more_rows.filter("Complete = '1'").withColumns({"sourceSlot": F.lit("o_orderstatus"), "targetSlot": F.lit("state")}), f"{folder}/a_maps.tsv")
    for name, text in (("source", SOURCE), ("target", TARGET)):
        local_table(spark, [(text,)], "value string").coalesce(1).write.text(f"{folder}/{name}.yaml")
    text = yaml.safe_dump({"source-schema-file": "source.yaml", "target-schema-file": "target.yaml", "maps-files": ["b_maps.csv", "a_maps.tsv"], "selectors": ["core=3.1", "!off"], "output-dir": "specs"})
    run(spark, tables.read_options(text, base=folder))
    return stored.stored_slot_rows(spark, f"{folder}/specs").select("target_class", "target_slot")


