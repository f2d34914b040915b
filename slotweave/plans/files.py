"""Queries over files that Spark writes and reads: one file for each spec, tabs of workbooks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from slotweave.operators import reshape
from slotweave.plans.catalogue import _row, query, rows_of, specs_of
from slotweave.sources import specs as stored
from slotweave.sources import workbooks
from slotweave.sources.files import write_named
from slotweave.sources.local import work_folder
from slotweave.sources.tables import read_table


@query("""
SELECT printf('mapper-%010d-orders-t%d_x_.yaml', row_number() OVER (PARTITION BY place ORDER BY s_suppkey) - 1, s_suppkey) AS file, 't' || s_suppkey || '/x#' AS target_class, slot AS target_slot, source AS source_slot, place
FROM supplier, (VALUES ('saleID', 'o_orderkey', 0), ('state', 'o_orderstatus', 1)) s(slot, source, place)
""")
def spec_files(spark, sf_dir):
    """Specs of a target class of every supplier, each a file of its own, in order and under names that files may have."""
    target = F.concat(F.lit("t"), "s_suppkey", F.lit("/x#"))
    maps = rows_of(read_table(spark, sf_dir, "supplier"), "s_suppkey", *(_row("orders", slot, target, to) for slot, to in (("o_orderkey", "saleID"), ("o_orderstatus", "state"))))
    path = work_folder(spark)
    stored.write_specs(specs_of(spark, maps=maps), path)
    return stored.stored_slot_rows(spark, path).select("file", "target_class", "target_slot", "source_slot", "place")


#: Customers of a workbook.
_IN_A_BOOK = 1000


def _book(customers: pd.DataFrame) -> pd.DataFrame:
    held = customers.sort_values("c_custkey")
    people = [["c_custkey", "c_name", "c_mktsegment", "vip"], *([int(k), n, s, bool(b > 0)] for k, n, s, b in zip(held["c_custkey"], held["c_name"], held["c_mktsegment"], held["c_acctbal"], strict=True))]
    money = [["key", "balance", "note"], *([int(k), float(b), "NA"] for k, b in zip(held["c_custkey"], held["c_acctbal"], strict=True))]
    return pd.DataFrame({"file": [f"customers-{int(held['c_custkey'].iloc[0]) // _IN_A_BOOK:06d}.xlsx"], "document": [workbooks.workbook({"people": people, "money & more": money})]})


def _books(spark, sf_dir) -> str:
    """Workbooks of a thousand customers each, made where the customers are."""
    path = work_folder(spark)
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    books = customers.groupBy(F.floor(F.col("c_custkey") / _IN_A_BOOK)).applyInPandas(_book, "file string, document binary")
    write_named(books, path, suffix=".xlsx")
    return path


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, CASE WHEN c_acctbal > 0 THEN 'TRUE' ELSE 'FALSE' END AS vip, dense_rank() OVER (ORDER BY c_custkey // {_IN_A_BOOK}) * 1000000000 + row_number() OVER (PARTITION BY c_custkey // {_IN_A_BOOK} ORDER BY c_custkey) - 1000000001 AS place FROM customer")
def workbook_rows(spark, sf_dir):
    """A tab of many workbooks as one sheet, with a list of blank values of one column."""
    found = workbooks.tab_rows(spark, _books(spark, sf_dir), "people", blank_values={"people": {"c_mktsegment": ["BUILDING"]}})
    return found.withColumnRenamed("_ord", "place")


@query("SELECT 'money & more' AS tab, CAST(c_custkey AS VARCHAR) AS key, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS note FROM customer UNION ALL SELECT 'people', CAST(c_custkey AS VARCHAR), NULL, NULL FROM customer")
def workbook_tabs(spark, sf_dir):
    """All tabs of all workbooks, one task each."""
    found = workbooks.read_tabs(spark, _books(spark, sf_dir))
    cell = lambda c: F.try_element_at("cells", F.lit(c))
    people = found.filter("tab = 'people'").select("tab", cell("c_custkey").alias("key"))
    money = found.filter("tab <> 'people'").select("tab", cell("key").alias("key"), cell("balance").cast("double").alias("balance"), cell("note").alias("note"))
    return reshape.union_all([money, people])
