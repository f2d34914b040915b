"""Queries whose mapping rows hold statements instead of single expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotweave.functions import exprs
from slotweave.operators import compile as compiler
from slotweave.operators import execute, prepare, validate
from slotweave.plans.catalogue import _BASE, _row, _sale, _wide, mapped, query, rows_of, specs_of
from slotweave.plans.schemas import SOURCE, TARGET
from slotweave.sources.metadata import Schema
from slotweave.sources.tables import read_table

#: A name's first part or the rest of it, by a function whose flag is known where it is called.
_GET_NAME = """
def get_name(full_name, get_first):
    names = full_name.strip().rsplit(" ", 1)
    idx = 0 if get_first else 1
    return names[idx] if len(names) > idx else ""
target = get_name(src.o_orderpriority, {})
"""

_A_OR_B = """
def a_or_b(a, b):
    if a:
        return a
    if b:
        return b
    return ""


target = a_or_b(src.c_mktsegment, src.c_name)
"""


@query("SELECT o_orderkey AS \"saleID\", regexp_replace(o_orderpriority, ' [^ ]*$', '') AS \"firstName\", CASE WHEN contains(o_orderpriority, ' ') THEN regexp_extract(o_orderpriority, '([^ ]*)$', 1) ELSE '' END AS \"lastName\" FROM orders")
def statement_names(spark, sf_dir):
    """Two slots of one text, cut at its last space."""
    maps = [_sale("o_orderkey", "saleID"), _sale(None, "firstName", targetExpr=_GET_NAME.format(True)), _sale(None, "lastName", targetExpr=_GET_NAME.format(False))]
    return mapped(spark, sf_dir, "orders", "sales", maps=maps)


@query("SELECT c_custkey AS \"personID\", CASE c_nationkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_name ELSE '' END AS note FROM customer")
def statement_fallback(spark, sf_dir):
    """The first of two slots that is set, else an empty text."""
    person = lambda slot, to, **more: _row("customer", slot, "people", to, **more)
    specs = specs_of(spark, maps=[person("c_custkey", "personID"), person(None, "note", targetExpr=_A_OR_B)])
    blanked = read_table(spark, sf_dir, "customer").withColumns({
        "c_mktsegment": F.when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_nationkey") % 3 == 1, ""),
        "c_name": F.when(F.col("c_nationkey") % 3 < 2, F.col("c_name")),
    })
    return execute.execute(specs, {"customer": blanked}, Schema.parse(TARGET))["people"]


_BAND = """
size = src.l_quantity
if src.l_returnflag == 'R':
    size -= 10
elif src.l_returnflag in ('A', 'N') and src.l_discount > 0.05:
    size = size * 2 + 1
if size < 0:
    target = f'back {-size}'
elif size > 50:
    target = 'bulk'
"""


@query("SELECT l_orderkey AS \"saleID\", CAST(l_linenumber AS BIGINT) AS line, 'quantity' AS measure, CASE WHEN size < 0 THEN CASE WHEN l_quantity = floor(l_quantity) THEN 'back ' || CAST(CAST(-size AS BIGINT) AS VARCHAR) || '.0' END WHEN size > 50 THEN 'bulk' END AS purpose FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN l_quantity - 10 WHEN l_returnflag IN ('A', 'N') AND l_discount > 0.05 THEN l_quantity * 2 + 1 ELSE l_quantity END AS size FROM lineitem)")
def statement_branches(spark, sf_dir):
    """Reassigned names, branches and a way that leaves nothing, in a cell of a wide group."""
    return mapped(spark, sf_dir, "lineitem", "measures", maps=_BASE, wide=[_wide("l_quantity", measure_value="quantity", purpose_expr=_BAND)])


@query("SELECT p_partkey, string_split(p_name, ' ')[-1] AS last, CASE WHEN starts_with(p_brand, 'Brand#') THEN CAST(p_brand[7:] AS BIGINT) * 100 + p_size ELSE -1 END AS code, CASE WHEN p_type = 'PROMO' THEN 'P' WHEN p_type = 'ECONOMY' THEN 'E' ELSE '?' END AS kind FROM part")
def statement_columns(spark, sf_dir):
    """Methods, indexes, slices and a dictionary, on a table of the data."""
    part = read_table(spark, sf_dir, "part")
    told = {
        "last": "words = src.p_name.split(' ')\ntarget = words[-1]",
        "code": "target = -1\nif src.p_brand.startswith('Brand#'):\n    target = int(src.p_brand[6:]) * 100 + src.p_size",
        "kind": "known = {'PROMO': 'P', 'ECONOMY': 'E'}.get(src.p_type, '?')\ntarget = known",
    }
    return part.select("p_partkey", *(exprs.slot_expression(text, part.schema).alias(c) for c, text in told.items()))


_TEXTS = ["target = src.o_orderkey\npass", "for x in src.o_orderstatus:\n    target = x", "import os\ntarget = 1", "target = src.nothing + 1\npass", "src.o_totalprice * 2"]


@query("SELECT 's' || c_custkey AS target_slot, CASE c_custkey % 5 WHEN 1 THEN 'not allowed in statements: for x in src.o_orderstatus:' WHEN 2 THEN 'not allowed in statements: import os' WHEN 3 THEN 'no source slot nothing' END AS message FROM customer WHERE c_custkey % 5 IN (1, 2, 3)")
def refused_expressions(spark, sf_dir):
    """A mapping row of every customer; those whose text cannot be a Column are named before anything runs."""
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("c_custkey") % 5 + 1).cast("int"))
    maps = rows_of(read_table(spark, sf_dir, "customer"), "c_custkey", _sale(None, F.concat(F.lit("s"), "c_custkey"), targetExpr=text))
    specs = compiler.compile_mapping(spark, Schema.parse(SOURCE), Schema.parse(TARGET), prepare.prepare_maps(maps))
    return validate.refused_expressions(specs, Schema.parse(SOURCE)).select("target_slot", "message")


