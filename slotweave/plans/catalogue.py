"""Queries of the mapping engine over the driver tables, with DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions import exprs, names, selectors
from slotweave.operators import compile as compiler
from slotweave.operators import conform, execute, legacy, prepare, reshape, validate
from slotweave.plans.schemas import SOURCE, TARGET
from slotweave.sources.local import local_table
from slotweave.sources.metadata import Schema
from slotweave.sources.tables import read_table

FLAGSHIP = "wide_lineitem_measures"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def rows(spark: SparkSession, *table: dict[str, str]) -> DataFrame:
    """Mapping rows given in place, with their order."""
    columns = list(dict.fromkeys(c for r in table for c in r))
    return local_table(spark, [(*(r.get(c) for c in columns), k) for k, r in enumerate(table)], ", ".join([*(f"`{c}` string" for c in columns), "_ord long"]))


def rows_of(table: DataFrame, order: str | Column, *entries: dict[str, str | Column | None], step: int | None = None) -> DataFrame:
    """Mapping rows made of each row of a table, however large, in the order of a key of it; ``step`` is how many rows a key has at most, if not as many as here."""
    columns = list(dict.fromkeys(c for e in entries for c in e))
    cell = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
    place = (F.col(order) if isinstance(order, str) else order).cast("long") * (step or len(entries))
    return table.select(F.inline(F.array(*(F.struct(*(cell(e.get(c)).alias(c) for c in columns), (place + k).alias("_ord")) for k, e in enumerate(entries)))))


def specs_of(spark: SparkSession, maps: list[dict] | DataFrame = (), wide: list[dict] = (), enums: list[dict] = ()) -> compiler.Specs:
    return compiler.compile_mapping(
        spark, Schema.parse(SOURCE), Schema.parse(TARGET), prepare.prepare_maps(maps if isinstance(maps, DataFrame) else rows(spark, *maps)) if maps else None,
        prepare.prepare_wide(rows(spark, *wide)) if wide else None, prepare.prepare_enums(rows(spark, *enums)) if enums else None, strict=True,
    )


def mapped(spark: SparkSession, sf_dir: str, source: str, target: str, **parts) -> DataFrame:
    return execute.execute(specs_of(spark, **parts), {source: read_table(spark, sf_dir, source)}, Schema.parse(TARGET))[target]


def _row(source: str | Column, slot: str | Column | None, target: str | Column, to: str | Column, **more: str | Column) -> dict:
    return {"sourceClass": source, "sourceSlot": slot, "targetClass": target, "targetSlot": to, **more}


def _sale(slot: str | Column | None, to: str | Column, **more: str | Column) -> dict:
    return _row("orders", slot, "sales", to, **more)


# --- maps: copies, constants, expressions, coded values ------------------------------------------------


@query("SELECT o_orderkey AS \"saleID\", o_custkey AS \"buyerID\", o_totalprice AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def map_copy_orders(spark, sf_dir):
    out = mapped(spark, sf_dir, "orders", "sales", maps=[_sale("o_orderkey", "saleID"), _sale("o_custkey", "buyerID"), _sale("o_totalprice", "amount"), _sale("o_orderdate", "day")])
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT o_orderkey AS \"saleID\", 'web' AS origin, o_totalprice > 100000 AS big FROM orders")
def map_const_expr(spark, sf_dir):
    return mapped(spark, sf_dir, "orders", "sales", maps=[_sale("o_orderkey", "saleID"), _sale(None, "origin", targetExpr="'web'"), _sale(None, "big", targetExpr="case((src.o_totalprice > 100000, True), (True, False))")])


@query("SELECT l_orderkey AS \"saleID\", l_linenumber AS line, l_extendedprice * (1 - l_discount) AS value FROM lineitem")
def map_expr_arith(spark, sf_dir):
    item = lambda slot, to, **more: _row("lineitem", slot, "measures", to, **more)
    out = mapped(spark, sf_dir, "lineitem", "measures", maps=[item("l_orderkey", "saleID"), item("l_linenumber", "line"), item(None, "value", targetExpr="src.l_extendedprice * (1 - src.l_discount)")])
    return out.withColumn("line", F.col("line").cast("int"))


_STATES = [("F", "closed"), ("O", "open"), ("P", "partial")]


@query("SELECT o_orderkey AS \"saleID\", CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS state FROM orders")
def enum_translate_status(spark, sf_dir):
    return mapped(spark, sf_dir, "orders", "sales", maps=[_sale("o_orderkey", "saleID"), *(_sale("o_orderstatus", "state", sourceValue=s, targetValue=t) for s, t in _STATES)])


_URGENCY = [("1-URGENT", "high"), ("2-HIGH", "high"), ("3-MEDIUM", "normal"), ("4-NOT SPECIFIED", "normal"), ("5-LOW", "low")]


@query("SELECT o_orderkey AS \"saleID\", CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'normal' END AS urgency FROM orders")
def enum_many_to_one_priority(spark, sf_dir):
    return mapped(spark, sf_dir, "orders", "sales", maps=[_sale("o_orderkey", "saleID"), *(_sale("o_orderpriority", "urgency", sourceValue=s, targetValue=t) for s, t in _URGENCY)])


def _partly(spark, sf_dir, settings: str | None):
    one = _sale("o_orderstatus", "state", sourceValue="F", targetValue="closed", enumDerivationSettings=settings)
    return mapped(spark, sf_dir, "orders", "sales", maps=[_sale("o_orderkey", "saleID"), one])


@query("SELECT o_orderkey AS \"saleID\", CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE o_orderstatus END AS state FROM orders")
def enum_mirror_unmapped(spark, sf_dir):
    return _partly(spark, sf_dir, '{"mirror_source": true}')


@query("SELECT o_orderkey AS \"saleID\", CASE o_orderstatus WHEN 'F' THEN 'closed' END AS state FROM orders")
def enum_null_unmapped(spark, sf_dir):
    return _partly(spark, sf_dir, None)


@query("SELECT o_orderkey AS \"saleID\", o_orderstatus AS state FROM orders")
def enum_missing_is_copied(spark, sf_dir):
    return mapped(spark, sf_dir, "orders", "sales", maps=[_sale("o_orderkey", "saleID"), _sale("o_orderstatus", "state")])


@query("SELECT o_orderkey AS \"saleID\", CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'partial' END AS state FROM orders")
def enum_scope_specificity(spark, sf_dir):
    """Values come from an enum tab whose scope is blank but for the enums."""
    tab = [{"sourceEnum": "statusSet", "targetEnum": "stateSet", "sourceValue": s, "targetValue": t} for s, t in _STATES]
    return mapped(spark, sf_dir, "orders", "sales", maps=[_sale("o_orderkey", "saleID"), _sale("o_orderstatus", "state")], enums=tab)


# --- wide: one source row, many target rows -------------------------------------------------------------

_MEASURES = [("l_quantity", "quantity", "pieces"), ("l_extendedprice", "price", "currency"), ("l_discount", "discount", "share"), ("l_tax", "tax", "share")]


def _item(slot: str | None, to: str, **more: str) -> dict:
    return _row("lineitem", slot, "measures", to, **more)


def _wide(slot: str, **cells: str) -> dict:
    return {"sourceClass": "lineitem", "sourceSlot": slot, "targetClass": "measures", **cells}


_BASE = [_item("l_orderkey", "saleID"), _item("l_linenumber", "line")]
_FLAGS = [_item("l_returnflag", "flag", sourceValue=s, targetValue=t) for s, t in (("A", "accepted"), ("N", "none"), ("R", "returned"))]


def _long_sql(columns: list[tuple[str, str, str]], more: str = "") -> str:
    return " UNION ALL ".join(f"SELECT l_orderkey AS \"saleID\", CAST(l_linenumber AS BIGINT) AS line, '{m}' AS measure, {c} AS value, '{u}' AS unit{more} FROM lineitem" for c, m, u in columns)


@query(_long_sql(_MEASURES, ", CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' WHEN 'R' THEN 'returned' END AS flag"))
def wide_lineitem_measures(spark, sf_dir):
    wide = [_wide(c, measure_value=m, value_value="{{" + c + "}}", unit_value=u) for c, m, u in _MEASURES]
    return mapped(spark, sf_dir, "lineitem", "measures", maps=[*_BASE, *_FLAGS], wide=wide)


@query("SELECT l_orderkey AS \"saleID\", 0 AS line, 'tax' AS measure, l_tax * 100 AS value, 'fixed' AS purpose FROM lineitem")
def wide_overlay_base(spark, sf_dir):
    """A group's cells lie over the base slots, expressions over values."""
    out = mapped(spark, sf_dir, "lineitem", "measures", maps=[*_BASE, _item("l_discount", "value")], wide=[_wide("l_tax", line_value="0", measure_value="tax", value_value="{{l_tax}}", value_expr="src.l_tax * 100", purpose_value="fixed")])
    return out.withColumn("line", F.col("line").cast("int"))


@query(_long_sql([("l_quantity", "quantity", "pieces"), ("l_quantity", "quantity", "share")]))
def wide_two_groups_same_slot(spark, sf_dir):
    wide = [_wide("l_quantity", wideGroup=g, measure_value="quantity", value_value="{{l_quantity}}", unit_value=g) for g in ("pieces", "share")]
    return mapped(spark, sf_dir, "lineitem", "measures", maps=_BASE, wide=wide)


@query(_long_sql(_MEASURES[:1]))
def wide_suppresses_base(spark, sf_dir):
    """The pair's base derivation isn't emitted beside its wide group."""
    return mapped(spark, sf_dir, "lineitem", "measures", maps=_BASE, wide=[_wide("l_quantity", measure_value="quantity", value_value="{{l_quantity}}", unit_value="pieces")])


@query(_long_sql(_MEASURES[:2]))
def wide_json_other_slots(spark, sf_dir):
    """Cells given as one JSON object overwrite and extend the wide columns."""
    wide = [_wide(c, measure_value="tax", value_value="{{" + c + "}}", wideOtherSlots=f'{{"measure_value": "{m}", "unit_value": "{u}"}}') for c, m, u in _MEASURES[:2]]
    return mapped(spark, sf_dir, "lineitem", "measures", maps=_BASE, wide=wide)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_to_columns(spark, sf_dir):
    return reshape.json_cells(read_table(spark, sf_dir, "events"), "props", ["k"]).select("event_id", F.col("k").cast("long").alias("k"))


@query("SELECT c_custkey, 'name' AS slot, c_name AS cell FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def unpivot_sheet(spark, sf_dir):
    sheet = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name_value"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment_expr"))
    return reshape.unpivot_cells(sheet, ["c_custkey"]).select("c_custkey", "slot", "cell")


# --- selectors, gates and names ------------------------------------------------------------------------

_TAGS = "CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'b, c' WHEN 2 THEN '!b' WHEN 3 THEN 'd' WHEN 4 THEN 'core>=3.0,core<=3.1' ELSE 'b,core~=2.1' END"


def _selected(spark, sf_dir, run: list[str]):
    tagged = read_table(spark, sf_dir, "part").select("p_partkey", F.expr(_TAGS).alias("selectors"))
    return selectors.apply_selectors(tagged, selectors.parse_run(run))


def _selected_sql(kept: str) -> str:
    return f"SELECT p_partkey, {_TAGS} AS selectors FROM part WHERE p_partkey % 6 IN ({kept})"


@query(_selected_sql("0, 1"))
def selector_include(spark, sf_dir):
    return _selected(spark, sf_dir, ["b", "c"])


@query(_selected_sql("0, 2"))
def selector_exclude(spark, sf_dir):
    return _selected(spark, sf_dir, ["!d"])


@query(_selected_sql("0, 2, 4"))
def selector_version(spark, sf_dir):
    return _selected(spark, sf_dir, ["core=3.0.5"])


@query(_selected_sql("0, 1, 5"))
def selector_compatible(spark, sf_dir):
    return _selected(spark, sf_dir, ["b", "core=2.4"])


@query("SELECT p_partkey, p_name FROM part WHERE p_size % 3 < 2")
def complete_gate(spark, sf_dir):
    marked = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr("CASE p_size % 3 WHEN 0 THEN '1' WHEN 1 THEN ' true' ELSE '0' END").alias("Complete"))
    return reshape.complete_gate(marked)


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 1 THEN p_name END AS a, CASE WHEN p_size % 4 = 2 THEN p_brand ELSE ' ' END AS b FROM part WHERE p_size % 4 IN (1, 2)")
def drop_blank_rows(spark, sf_dir):
    cells = read_table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_size % 4 = 1 THEN p_name END AS a", "CASE WHEN p_size % 4 = 2 THEN p_brand ELSE ' ' END AS b")
    return reshape.drop_blank_rows(cells, ["a", "b"])


@query("SELECT c_custkey, upper(rtrim(regexp_replace(regexp_replace(c_name || '#_', '[^A-Za-z0-9]', '_', 'g'), '__+', '_', 'g'), '_')) AS slot FROM customer")
def slot_format_chain(spark, sf_dir):
    c = F.concat("c_name", F.lit("#_"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", names.format_slot(c, ["alpha_numeric_underscore", "single_underscores", "trim_trailing_underscores", "uppercase"]).alias("slot"))


@query("SELECT p_partkey, replace(replace(p_brand, '#', ''), 'r', '') AS slot FROM part")
def slot_format_remove_chars(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", names.format_slot(F.col("p_brand"), [{"remove_chars": "#r"}]).alias("slot"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN lower(p_brand) END AS slot FROM part")
def variable_reference(spark, sf_dir):
    cell = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("{{"), "p_brand", F.lit("}}"))).otherwise(F.col("p_brand"))
    return read_table(spark, sf_dir, "part").select("p_partkey", names.variable_reference(cell, ["lowercase"]).alias("slot"))


_ONTOLOGY = r"\[[A-Z]+:[0-9]+\]"


@query("SELECT p_partkey, p_name AS value FROM part")
def strip_ontology(spark, sf_dir):
    value = F.concat("p_name", F.lit(" [GENEPIO:"), F.format_string("%07d", "p_partkey"), F.lit("]"))
    return read_table(spark, sf_dir, "part").select("p_partkey", names.strip_ontology(value, _ONTOLOGY).alias("value"))


@query("""
SELECT p_partkey, i AS place, CASE WHEN listed THEN list_extract(xs, least(i + 1, len(xs))) ELSE a END AS a, CASE WHEN listed THEN list_extract(ys, least(i + 1, len(ys))) ELSE b END AS b
FROM (SELECT *, string_split(a, ';') AS xs, string_split(b, ';') AS ys, p_size % 3 > 0 AS listed,
             unnest(range(CASE WHEN p_size % 3 > 0 THEN greatest(len(string_split(a, ';')), len(string_split(b, ';'))) ELSE 1 END)) AS i
      FROM (SELECT p_partkey, p_size, CASE p_size % 3 WHEN 0 THEN p_name ELSE replace(p_name, ' ', ';') END AS a,
                   CASE p_size % 3 WHEN 2 THEN p_brand || ';' || p_type || ';' || p_brand ELSE p_brand END AS b FROM part))
""")
def expand_multi_rows(spark, sf_dir):
    cells = read_table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE p_size % 3 WHEN 0 THEN p_name ELSE replace(p_name, ' ', ';') END AS a", "CASE p_size % 3 WHEN 2 THEN p_brand || ';' || p_type || ';' || p_brand ELSE p_brand END AS b")
    return reshape.expand_multi_rows(cells, ["a", "b"]).select("p_partkey", F.col("_place").cast("long").alias("place"), "a", "b")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS value FROM part")
def select_and_value(spark, sf_dir):
    cell = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("("), "p_brand", F.lit(" & "), "p_type", F.lit(")"))).otherwise(F.col("p_type"))
    return read_table(spark, sf_dir, "part").select("p_partkey", reshape.select_and_value(cell).alias("value"))


_NUMERIC = "CASE p_size % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) || '.5' WHEN 2 THEN p_brand ELSE '' END"


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(x, '^[0-9]+$') THEN CAST(x AS BIGINT) END AS whole, CASE WHEN regexp_matches(x, '[0-9]') THEN TRY_CAST(x AS DOUBLE) END AS number FROM (SELECT p_partkey, {_NUMERIC} AS x FROM part)")
def parse_numeric_split(spark, sf_dir):
    cells = read_table(spark, sf_dir, "part").select("p_partkey", F.expr(_NUMERIC.replace("VARCHAR", "STRING")).alias("x"))
    return cells.select("p_partkey", names.parse_integer(F.col("x")).alias("whole"), names.parse_float(F.col("x")).alias("number"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('FURNITURE', 'BUILDING') THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) ELSE c_mktsegment END AS segment FROM customer")
def canonical_case_lookup(spark, sf_dir):
    known = local_table(spark, [("Furniture", 0), ("Building", 1)], "name string, _ord int")
    cells = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return reshape.canonical_case(cells, "segment", known, "name")


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'widget') THEN 'Widget' WHEN contains(lower(p_name), 'cold') THEN 'cold' WHEN contains(lower(p_name), 'id') THEN 'id' END AS class FROM part")
def longest_class_match(spark, sf_dir):
    return reshape.longest_contained(read_table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", ["id", "cold", "Widget"], "class").select("p_partkey", "class")


@query("SELECT p_partkey, split_part(split_part(p_brand || '[1](2)', '[', 1), '(', 1) AS class, p_type AS file_class FROM part")
def class_names(spark, sf_dir):
    cell = F.concat("p_brand", F.lit("[1](2)"))
    path = F.concat(F.lit("/data/in.d/"), "p_type", F.lit("[000,0001=a].csv"))
    return read_table(spark, sf_dir, "part").select("p_partkey", names.cut_class_name(cell).alias("class"), names.class_of_file(path).alias("file_class"))


# --- grouping and unions ---------------------------------------------------------------------------------


@query("SELECT o_custkey, string_agg(o_orderpriority, ';' ORDER BY k) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY o_custkey")
def ordered_distinct_fold(spark, sf_dir):
    firsts = read_table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k"))
    return reshape.ordered_fold(firsts, ["o_custkey"], "o_orderpriority", "k").select("o_custkey", F.array_join("values", ";").alias("priorities"))


@query("SELECT o_orderkey AS key, o_orderstatus AS state, NULL AS segment FROM orders UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def union_specs(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("state"))
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return reshape.union_all([orders, customers])


# --- validation --------------------------------------------------------------------------------------------


@query("SELECT vec_id AS \"vectorID\", CAST(embedding[1] AS DOUBLE) AS first FROM embeddings")
def multi_first_value(spark, sf_dir):
    return mapped(spark, sf_dir, "embeddings", "vectors", maps=[_row("embeddings", "vec_id", "vectors", "vectorID"), _row("embeddings", "embedding", "vectors", "first")])


@query("SELECT o_orderstatus AS \"sourceEnumValue\", o_orderpriority AS \"targetEnumValue\", count(*) AS \"numMappers\", string_agg(m, '; ' ORDER BY m) AS mapper FROM (SELECT DISTINCT o_orderstatus, o_orderpriority, 'spec-' || o_custkey % 97 AS m FROM orders) GROUP BY ALL")
def simplify_report(spark, sf_dir):
    """A finding is named by the specs that have it, and specs are few; so are the names in a row here, whatever the table."""
    mapper = F.concat(F.lit("spec-"), (F.col("o_custkey") % 97).cast("string"))
    report = read_table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("sourceEnumValue"), F.col("o_orderpriority").alias("targetEnumValue"), mapper.alias("mapper")).distinct()
    return validate.simplify(report)


# --- conformance of data --------------------------------------------------------------------------------


@query("SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def ref_integrity(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    return conform.dangling(read_table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey", orders, "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def identifier_unique(spark, sf_dir):
    return conform.repeated_identifiers(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_CHECKED = {
    "required": ("CASE WHEN p_size > 3 THEN p_name END IS NOT NULL", lambda: conform.required("name")),
    "pattern": ("regexp_matches(p_brand, '^Brand#[1-3]')", lambda: conform.matches("p_brand", "^Brand#[1-3]")),
    "range": ("p_retailprice BETWEEN 900 AND 1000", lambda: conform.between("p_retailprice", 900, 1000)),
    "member": ("p_type IN ('ECONOMY', 'STANDARD')", lambda: conform.member("p_type", ["ECONOMY", "STANDARD"])),
}


@query(" UNION ALL ".join(f"SELECT p_partkey, '{k}' AS rule FROM part WHERE NOT ({sql})" for k, (sql, _) in _CHECKED.items()))
def schema_checks(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").withColumn("name", F.expr("CASE WHEN p_size > 3 THEN p_name END"))
    return conform.violations(part, ["p_partkey"], {k: rule() for k, (_, rule) in _CHECKED.items()})


# --- the older parts list ---------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || upper(p_name[1]) || p_name[2:] END AS enum FROM part")
def legacy_enum_name(spark, sf_dir):
    where = F.when(F.col("p_size") % 2 == 0, "variableCategories").otherwise("tables")
    return read_table(spark, sf_dir, "part").select("p_partkey", names.enum_name(F.col("p_type"), F.col("p_name"), where).alias("enum"))


@query("SELECT p_partkey FROM part WHERE p_size % 4 < 2")
def header_rows(spark, sf_dir):
    cells = read_table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE p_size % 4 WHEN 0 THEN 'PK' ELSE p_type END AS a"), F.expr("CASE p_size % 4 WHEN 1 THEN 'Header' END AS b"))
    return legacy.header_rows(cells, ["a", "b"]).select("p_partkey")


@query("SELECT o_custkey, o_orderstatus, max_by(o_orderpriority, o_orderkey) AS o_orderpriority, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) GROUP BY ALL")
def legacy_last_slot_wins(spark, sf_dir):
    return legacy.class_slots(read_table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderpriority", "o_orderkey")


@query("SELECT o_orderkey, round(o_totalprice) AS price, 'order ' || o_orderpriority AS label, o_orderstatus IN ('F', 'O') AND NOT o_totalprice < 1000 AS ok FROM orders")
def expression_columns(spark, sf_dir):
    column: Callable[[str], Column] = exprs.to_column
    return read_table(spark, sf_dir, "orders").select("o_orderkey", column("round(src.o_totalprice)").alias("price"), column("'order ' + src.o_orderpriority").alias("label"), column("src.o_orderstatus in ('F', 'O') and not src.o_totalprice < 1000").alias("ok"))


from slotweave.plans import more  # noqa: E402, F401  its queries register themselves
from slotweave.plans import statements as _statements  # noqa: E402, F401
from slotweave.plans import files as _files  # noqa: E402, F401
from slotweave.plans import volume as _volume  # noqa: E402, F401
from slotweave.plans import orders as _orders  # noqa: E402, F401
