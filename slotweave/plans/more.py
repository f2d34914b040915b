"""More queries of the mapping engine: readers and writers, stored specs, settings, validation of mappings made from data, and the older run."""

from __future__ import annotations

import json

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions import exprs, names
from slotweave.operators import compile as compiler
from slotweave.operators import execute, legacy, prepare, reshape, validate
from slotweave.plans.catalogue import _BASE, _STATES, _row, _sale, _wide, mapped, query, rows, rows_of, specs_of
from slotweave.plans.schemas import SOURCE, TARGET
from slotweave.sources import specs as stored
from slotweave.sources import tables
from slotweave.sources.local import local_table, work_folder
from slotweave.sources.metadata import Schema
from slotweave.sources.tables import read_table
from slotweave.streaming import run as streaming

# --- readers and writers -------------------------------------------------------------------------------


def _names_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("name"))
    region = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("other"))
    return nation, region


_BOTH_SQL = "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, NULL AS other FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), NULL, r_name FROM region"


@query(_BOTH_SQL)
def rows_from_files(spark, sf_dir):
    """Stripped on the way to a CSV and a TSV file, read back as one sheet."""
    folder = work_folder(spark)
    nation, region = _names_of(spark, sf_dir)
    tables.write_rows(nation, f"{folder}/b.csv")
    tables.write_rows(region, f"{folder}/a.tsv")
    return tables.read_folder(spark, [f"{folder}/b.csv", f"{folder}/a.tsv"]).select("key", "name", "other")


@query(_BOTH_SQL)
def rows_from_yaml(spark, sf_dir):
    folder = work_folder(spark)
    nation, region = _names_of(spark, sf_dir)
    tables.write_rows(nation, f"{folder}/b.yaml")
    tables.write_rows(region, f"{folder}/a.yaml")
    return tables.read_folder(spark, [f"{folder}/b.yaml", f"{folder}/a.yaml"]).select("key", "name", "other")


@query("SELECT n_name AS name, n_regionkey = 0 AS written FROM nation WHERE n_regionkey = 0")
def report_file(spark, sf_dir):
    """A report is written if it has rows."""
    folder = work_folder(spark)
    found = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    none = tables.write_report(found.filter("n_regionkey = 99"), f"{folder}/none.csv")
    some = tables.write_report(found.filter("n_regionkey = 0"), f"{folder}/some.csv")
    return tables.read_rows(spark, f"{folder}/some.csv").select("name", F.lit(some and not none).alias("written"))


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def columns_first(spark, sf_dir):
    return reshape.ordered_columns(read_table(spark, sf_dir, "nation"), ["n_regionkey", "nothing"])


@query("SELECT n_name, 'v1' AS version, n_regionkey * 0 + 7 AS n_regionkey FROM nation")
def constants_on_all_rows(spark, sf_dir):
    one = local_table(spark, [("v1", 7)], "version string, n_regionkey int")
    return reshape.with_constants(read_table(spark, sf_dir, "nation"), one).select("n_name", "version", "n_regionkey")


@query("SELECT n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT NULL UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 2")
def separator_rows(spark, sf_dir):
    """Reports under each other with a blank row between those that have rows."""
    nation = read_table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    parts = [nation.filter(f"n_regionkey = {k}").select("n_name") for k in (1, 77, 2)]
    return reshape.union_all(reshape.with_separators(parts))


@query("SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_brand = 'Brand#5'")
def equal_ignoring_case(spark, sf_dir):
    return reshape.equal_ignoring_case(read_table(spark, sf_dir, "part"), {"p_type": "promo", "p_brand": "BRAND#5"}).select("p_partkey")


@query("SELECT DISTINCT o_orderpriority AS value FROM orders")
def distinct_sorted(spark, sf_dir):
    known = F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderpriority"))
    return reshape.distinct_sorted(read_table(spark, sf_dir, "orders").select(known.alias("value")), "value")


@query("SELECT c_mktsegment, string_agg(n, ';' ORDER BY lower(n), n) AS names FROM (SELECT DISTINCT c_mktsegment, CASE c_nationkey % 3 WHEN 0 THEN lower(n_name) ELSE n_name END AS n FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY c_mktsegment")
def values_in_order_ignoring_case(spark, sf_dir):
    nation = read_table(spark, sf_dir, "nation")
    named = read_table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", F.when(F.col("c_nationkey") % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("n"))
    return named.groupBy("c_mktsegment").agg(F.array_join(reshape.sorted_ignoring_case(F.collect_set("n")), ";").alias("names"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) || '.5' ELSE p_name END AS cell FROM part")
def parse_all_columns(spark, sf_dir):
    cell = F.expr("CASE p_size % 3 WHEN 0 THEN concat(' ', p_size, '.0') WHEN 1 THEN concat(p_size, '.50') ELSE p_name END")
    return names.parse_columns(read_table(spark, sf_dir, "part").select("p_partkey", cell.alias("cell")))


@query("SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN upper(p_type[1]) || lower(p_type[2:]) ELSE p_type END AS class FROM part")
def class_of_cell(spark, sf_dir):
    known = local_table(spark, [("Economy", 0), ("Promo", 1)], "name string, _ord int")
    cells = read_table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit(" [1](2)")).alias("class"))
    return reshape.class_of(cells, "class", known, "name")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE c_name END AS cell, CASE WHEN c_nationkey % 2 = 0 THEN '<blank>' ELSE c_name END AS shown FROM customer")
def empty_and_blank_cells(spark, sf_dir):
    cell = names.empty_sentinel(F.when(F.col("c_nationkey") % 2 == 0, "<empty>").otherwise(F.col("c_name")))
    return read_table(spark, sf_dir, "customer").select("c_custkey", cell.alias("cell"), names.blank_marker(cell).alias("shown"))


@query("SELECT n_nationkey, n_name || printf('[%03d,%04d=%s]', n_regionkey, n_nationkey, 'a-' || lower(n_name) || '-z') AS name, n_name || '_a_b.,c' AS file FROM nation")
def decorated_names(spark, sf_dir):
    decorated = names.decorated_name(F.col("n_name"), F.col("n_regionkey"), F.col("n_nationkey"), F.array(F.lit("z"), F.lower("n_name"), F.lit("a")))
    return read_table(spark, sf_dir, "nation").select("n_nationkey", decorated.alias("name"), names.safe_file_name(F.concat("n_name", F.lit("/a#b.,c"))).alias("file"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_row_per_group(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return reshape.first_rows(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, m AS measure, v AS value FROM (SELECT l_orderkey, l_linenumber, unnest(['quantity', 'tax']) AS m, unnest([l_quantity, l_tax]) AS v FROM lineitem)")
def wide_to_long(spark, sf_dir):
    key = {"l_orderkey": F.col("l_orderkey"), "l_linenumber": F.col("l_linenumber")}
    groups = [{**key, "measure": F.lit(m), "value": F.col(c)} for m, c in (("quantity", "l_quantity"), ("tax", "l_tax"))]
    return reshape.wide_to_long(read_table(spark, sf_dir, "lineitem"), groups)


# --- settings, ranges, scopes and extra slots ---------------------------------------------------------------


def _partly(spark, sf_dir, settings: str):
    one = _sale("o_orderstatus", "state", sourceValue="F", targetValue="closed", enumDerivationSettings=settings)
    return mapped(spark, sf_dir, "orders", "sales", maps=[_sale("o_orderkey", "saleID"), one])


@query("SELECT o_orderkey AS \"saleID\", CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE o_orderstatus END AS state FROM orders")
def enum_mirror_yaml(spark, sf_dir):
    return _partly(spark, sf_dir, "mirror_source: true\nnote: kept")


@query("SELECT 's' || c_custkey AS slot, 'range' AS name, '\"' || c_name || '\"' AS value FROM customer UNION ALL SELECT 's' || c_custkey, 'rank', CAST(c_custkey AS VARCHAR) FROM customer")
def slot_settings(spark, sf_dir):
    """Settings cells of several rows of one slot are merged, later rows win, and are kept in the specs."""
    slot = F.concat(F.lit("s"), "c_custkey")
    maps = rows_of(
        read_table(spark, sf_dir, "customer"), "c_custkey",
        _sale("o_orderkey", slot, slotDerivationSettings=F.concat(F.lit("range: old\nrank: "), "c_custkey")),
        _sale("o_orderkey", slot, slotDerivationSettings=F.concat(F.lit("range: "), "c_name")),
    )
    return specs_of(spark, maps=maps).slots.select(F.col("target_slot").alias("slot"), F.explode("settings").alias("name", "value"))


@query("SELECT c_custkey AS row, CASE WHEN c_nationkey % 5 = 0 THEN 'E_SETTINGS' END AS code FROM customer WHERE c_nationkey % 5 = 0")
def bad_settings(spark, sf_dir):
    cell = F.when(F.col("c_nationkey") % 5 == 0, "just text").otherwise("a: 1")
    maps = rows_of(read_table(spark, sf_dir, "customer"), "c_custkey", _sale("o_orderkey", F.concat(F.lit("s"), "c_custkey"), slotDerivationSettings=cell))
    found = compiler.compile_mapping(spark, Schema.parse(SOURCE), Schema.parse(TARGET), prepare.prepare_maps(maps)).diagnostics
    return found.select(F.col("ord").cast("int").alias("row"), "code")


_TWO_RANGES = SOURCE.replace("o_orderpriority: {range: prioritySet}", "o_orderpriority: {any_of: [{range: firstSet}, {range: restSet}]}").replace("enums:\n", "enums:\n  firstSet: {permissible_values: {1-URGENT: {}, 2-HIGH: {}}}\n  restSet: {permissible_values: {3-MEDIUM: {}, 4-NOT SPECIFIED: {}}}\n")


def _two_ranges(spark, sf_dir, more: list[dict]):
    maps = [_sale("o_orderkey", "saleID"), _sale("o_orderpriority", "origin", sourceValue="1-URGENT", targetValue="high"), *more]
    specs = compiler.compile_mapping(spark, Schema.parse(_TWO_RANGES), Schema.parse(TARGET), prepare.prepare_maps(rows(spark, *maps)), strict=True)
    return execute.execute(specs, {"orders": read_table(spark, sf_dir, "orders")}, Schema.parse(TARGET))["sales"]


@query("SELECT o_orderkey AS \"saleID\", CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN o_orderpriority END AS origin FROM orders")
def enum_two_ranges_one_mirrored(spark, sf_dir):
    """Of two enum ranges one has a derivation; the other's values stand for themselves."""
    return _two_ranges(spark, sf_dir, [])


@query("SELECT o_orderkey AS \"saleID\", CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '3-MEDIUM' THEN 'normal' END AS origin FROM orders")
def enum_two_ranges(spark, sf_dir):
    return _two_ranges(spark, sf_dir, [_sale("o_orderpriority", "origin", sourceValue="3-MEDIUM", targetValue="normal")])


@query("SELECT o_orderkey AS \"saleID\", CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS state, CASE o_orderstatus WHEN 'F' THEN 'shop' WHEN 'O' THEN 'web' END AS origin FROM orders")
def enum_wildcard_scopes(spark, sf_dir):
    """One value list holds for any source of a target slot, another for one source class and a target slot."""
    tab = [{"sourceEnum": "statusSet", "targetEnum": "stateSet", "targetSlot": "state", "targetClass": "", "sourceValue": s, "targetValue": t} for s, t in _STATES]
    tab += [{"sourceClass": "orders", "sourceEnum": "statusSet", "targetEnum": "originSet", "targetSlot": "origin", "sourceValue": s, "targetValue": t} for s, t in (("F", "shop"), ("O", "web"))]
    return mapped(spark, sf_dir, "orders", "sales", maps=[_sale("o_orderkey", "saleID"), _sale("o_orderstatus", "state"), _sale("o_orderstatus", "origin")], enums=tab)


@query("SELECT o_orderkey AS \"saleID\", o_orderstatus || '!' AS \"_extra_Code\" FROM orders")
def extra_slots(spark, sf_dir):
    specs = specs_of(spark, maps=[_sale("o_orderkey", "saleID"), _sale(None, "_extra_Code", targetExpr="src.o_orderstatus + '!'")])
    tables_in = {"orders": read_table(spark, sf_dir, "orders")}
    kept = execute.execute(specs, tables_in, Schema.parse(TARGET), keep_extra=True)["sales"]
    if execute.drop_extra(kept).columns != ["saleID"] or execute.execute(specs, tables_in, Schema.parse(TARGET))["sales"].columns != ["saleID"]:
        raise AssertionError("extra slots are for the processing alone")
    return kept


@query("SELECT l_orderkey AS \"saleID\", CAST(l_linenumber AS BIGINT) AS line, m AS measure, v AS value FROM (SELECT l_orderkey, l_linenumber, unnest(['quantity', 'tax']) AS m, unnest([l_quantity, l_tax]) AS v FROM lineitem)")
def wide_groups_without_names(spark, sf_dir):
    """Rows without a source slot and a group are groups of their own."""
    wide = [_wide("", measure_value=m, value_value="{{" + c + "}}") for m, c in (("quantity", "l_quantity"), ("tax", "l_tax"))]
    return mapped(spark, sf_dir, "lineitem", "measures", maps=_BASE, wide=wide)


# --- stored specs and streams --------------------------------------------------------------------------------


def _stored(spark, sf_dir) -> compiler.Specs:
    """Specs, written as files and read back, that map the statuses of the data but the last."""
    held = [r[0] for r in reshape.distinct_sorted(read_table(spark, sf_dir, "orders"), "o_orderstatus").collect()]
    maps = [_sale("o_orderkey", "saleID", slotDerivationSettings="range: integer"), *(_sale("o_orderstatus", "state", sourceValue=s, targetValue=dict(_STATES)[s]) for s in held[:-1]), _sale(None, "origin", targetExpr="'web'"), _sale("o_orderpriority", "urgency")]
    path = work_folder(spark)
    stored.write_specs(specs_of(spark, maps=maps), path)
    return stored.read_specs(spark, stored.read_documents(spark, path), Schema.parse(SOURCE))


_STORED_SQL = "SELECT o_orderkey AS \"saleID\", CASE WHEN o_orderstatus < (SELECT max(o_orderstatus) FROM orders) THEN CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END END AS state, 'web' AS origin, o_orderpriority AS urgency FROM orders"


@query(_STORED_SQL)
def stored_specs_run(spark, sf_dir):
    """Specs written as files, read back and run."""
    return execute.execute(_stored(spark, sf_dir), {"orders": read_table(spark, sf_dir, "orders")}, Schema.parse(TARGET))["sales"]


@query("SELECT max(o_orderstatus) AS \"sourceEnumValue\", CAST(1 AS BIGINT) AS \"numMappers\", 'statusSet' AS \"sourceEnumName\" FROM orders")
def stored_specs_validated(spark, sf_dir):
    found = validate.validate(_stored(spark, sf_dir), Schema.parse(SOURCE), Schema.parse(TARGET))["missing_source_enum_values"]
    return found.select("sourceEnumValue", "numMappers", "sourceEnumName")


@query("SELECT 'measures' || printf('[000,%04d=%s]', row_number() OVER (PARTITION BY slot ORDER BY s_suppkey) - 1, 'l_linenumber-l_orderkey-' || CASE s_suppkey % 2 WHEN 0 THEN 'l_quantity' ELSE 'l_tax' END) AS target_class, slot AS target_slot, 'lineitem' AS source_class FROM supplier, (VALUES ('saleID'), ('line'), ('measure'), ('value')) s(slot)")
def spec_documents(spark, sf_dir):
    """A wide group of every supplier: documents go by the class, the sheet, the group and its source slots."""
    held = [r[0] for r in read_table(spark, sf_dir, "supplier").select("s_suppkey").orderBy("s_suppkey").collect()]
    wide = [_wide(c := "l_tax" if k % 2 else "l_quantity", wideGroup=f"g{k}", measure_value=f"m{k}", value_value="{{" + c + "}}") for k in held]
    docs = stored.documents(specs_of(spark, maps=_BASE, wide=wide))
    return stored.slot_rows(spark, docs).select("target_class", "target_slot", "source_class")


@query("SELECT 's' || c_custkey AS target_slot, unnest(['o_custkey', 'o_orderkey']) AS source_slot FROM customer")
def slots_read_by_expressions(spark, sf_dir):
    maps = rows_of(read_table(spark, sf_dir, "customer"), "c_custkey", _sale(None, F.concat(F.lit("s"), "c_custkey"), targetExpr=F.concat(F.lit("src.o_orderkey + src.o_custkey * "), "c_custkey")))
    return stored.source_slots(spark, specs_of(spark, maps=maps)).select("target_slot", "source_slot")


@query("SELECT o_orderkey AS \"saleID\", CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS state FROM orders")
def map_stream(spark, sf_dir):
    """The same specs on a streaming table: appended exactly once, until what is there has been read."""
    folder = work_folder(spark)
    orders = read_table(spark, sf_dir, "orders")
    stream = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders.parque[t]")
    specs = specs_of(spark, maps=[_sale("o_orderkey", "saleID"), *(_sale("o_orderstatus", "state", sourceValue=s, targetValue=t) for s, t in _STATES)])
    out = streaming.map_stream(specs, {"orders": stream}, Schema.parse(TARGET))["sales"]
    streaming.start(spark, out, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


# --- validation of a mapping made from tables ------------------------------------------------------------------


def _places(spark, sf_dir) -> tuple[compiler.Specs, Schema, Schema]:
    """Nations and regions as value lists; rows map the even nations and, wrongly, the regions."""
    nation = read_table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    region = read_table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    values = lambda found: {"permissible_values": {v: {} for v in found}}
    source = {
        "name": "places", "classes": {"places": {"slots": ["place", *(f"note_{r['r_regionkey']}" for r in region), *(f"tags_{r['r_regionkey']}" for r in region)]}},
        "slots": {"place": {"range": "natSet"}, **{f"note_{r['r_regionkey']}": {"range": "string"} for r in region}, **{f"tags_{r['r_regionkey']}": {"range": "string", "multivalued": True} for r in region}},
        "enums": {"natSet": values(n["n_name"] for n in nation)},
    }
    coded = [f"{kind}_{r['r_regionkey']}" for kind in ("from_note", "constant") for r in region]
    target = {
        "name": "spots", "classes": {"spots": {"slots": ["spot", *coded, *(f"one_{r['r_regionkey']}" for r in region)]}},
        "slots": {"spot": {"range": "spotSet", "required": True}, **{c: {"range": "spotSet"} for c in coded}, **{f"one_{r['r_regionkey']}": {"range": "string"} for r in region}},
        "enums": {"spotSet": values([*(n["n_name"] for n in nation if n["n_regionkey"] < 2), "AFRICA"])},
    }
    spot = lambda slot, to, **more: _row("places", slot, "spots", to, **more)
    maps = [spot("place", "spot", sourceValue=n["n_name"], targetValue=n["n_name"]) for n in nation if n["n_nationkey"] % 2 == 0]
    maps += [spot("place", "spot", sourceValue=r["r_name"], targetValue=f"r:{r['r_name']}") for r in region]
    maps += [spot(f"note_{r['r_regionkey']}", f"from_note_{r['r_regionkey']}") for r in region] + [spot(f"tags_{r['r_regionkey']}", f"one_{r['r_regionkey']}") for r in region]
    maps += [spot(None, f"constant_{r['r_regionkey']}", targetExpr=f"'{r['r_name']}'") for r in region] + [spot("place", f"lost_{n['n_nationkey']}") for n in nation if n["n_regionkey"] == 0]
    read, aimed = (Schema.parse(yaml.safe_dump(x, sort_keys=False)) for x in (source, target))
    return compiler.compile_mapping(spark, read, aimed, prepare.prepare_maps(rows(spark, *maps)), strict=True), read, aimed


def _report(spark, sf_dir, name: str, *columns: str) -> DataFrame:
    return validate.validate(*_places(spark, sf_dir))[name].select(*columns)


@query("SELECT n_name AS \"sourceEnumValue\", 'natSet' AS \"sourceEnumName\", CAST(1 AS BIGINT) AS \"numMappers\" FROM nation WHERE n_nationkey % 2 = 1")
def missing_source_values(spark, sf_dir):
    return _report(spark, sf_dir, "missing_source_enum_values", "sourceEnumValue", "sourceEnumName", "numMappers")


@query("SELECT r_name AS \"sourceEnumValue\", 'r:' || r_name AS \"targetEnumValue\", 'spot' AS \"targetSlot\" FROM region")
def unrecognized_source_values(spark, sf_dir):
    return _report(spark, sf_dir, "unrecognized_source_enum_values", "sourceEnumValue", "targetEnumValue", "targetSlot")


@query("SELECT v AS \"targetEnumValue\", 'spots' AS \"targetClass\", 'spot' AS \"targetSlot\" FROM (SELECT n_name AS v FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey >= 2 UNION ALL SELECT 'r:' || r_name FROM region)")
def unrecognized_target_values(spark, sf_dir):
    return _report(spark, sf_dir, "unrecognized_target_enum_values", "targetEnumValue", "targetClass", "targetSlot")


@query("SELECT r_name AS \"targetEnumValue\", 'spots' AS \"targetClass\", 'constant_' || r_regionkey AS \"targetSlot\", CAST(1 AS BIGINT) AS \"numMappers\" FROM region WHERE r_name <> 'AFRICA'")
def bad_constants(spark, sf_dir):
    return _report(spark, sf_dir, "unrecognized_constant_values", "targetEnumValue", "targetClass", "targetSlot", "numMappers")


@query("SELECT 'lost_' || n_nationkey AS target_slot, 'natSet[=mirrored=]' AS target_enum FROM nation WHERE n_regionkey = 0")
def missing_derivations(spark, sf_dir):
    return validate.missing_derivations(_places(spark, sf_dir)[0]).select("target_slot", "target_enum")


@query("SELECT 'note_' || r_regionkey AS source_slot, 'from_note_' || r_regionkey AS target_slot FROM region")
def free_text_to_enum(spark, sf_dir):
    return validate.check(*_places(spark, sf_dir), only=["free_text_to_enum"])["free_text_to_enum"].select("source_slot", "target_slot")


@query("SELECT 'tags_' || r_regionkey AS source_slot, 'one_' || r_regionkey AS target_slot FROM region")
def multi_to_single(spark, sf_dir):
    return validate.check(*_places(spark, sf_dir), only=["multi_to_single"])["multi_to_single"].select("source_slot", "target_slot")


@query("SELECT 'place' AS source_slot, 'lost_' || n_nationkey AS target_slot FROM nation WHERE n_regionkey = 0")
def unknown_target_slots(spark, sf_dir):
    return validate.check(*_places(spark, sf_dir), only=["unknown_target_slots"])["unknown_target_slots"].select("source_slot", "target_slot")


@query("SELECT 's' || c_custkey AS \"targetSlot\", 'statusSet' AS \"sourceEnumName\" FROM customer")
def empty_derivations(spark, sf_dir):
    """Enum derivations of stored specs that neither map nor copy values."""
    held = read_table(spark, sf_dir, "customer").orderBy("c_custkey").collect()
    slots = {f"s{n['c_custkey']}": {"populated_from": "o_orderstatus"} for n in held}
    doc = {"class_derivations": {"sales": {"name": "sales", "populated_from": "orders", "slot_derivations": slots}}, "enum_derivations": {"stateSet": {"populated_from": "statusSet", "mirror_source": False}}}
    specs = stored.read_specs(spark, [("mapper-0.yaml", doc)], Schema.parse(SOURCE))
    return validate.empty_derivations(validate.bound_enums(specs)).select("targetSlot", "sourceEnumName")


@query("SELECT 'W_UNKNOWN_CLASS' AS code, 'no source class ' || c_name AS message FROM customer WHERE c_nationkey % 5 = 0 UNION ALL SELECT 'E_UNKNOWN_SLOT', 'no source slot orders.' || c_name FROM customer WHERE c_nationkey % 5 = 1 UNION ALL SELECT 'E_CONFLICT', 'several derivations of sales.c' || c_custkey FROM customer WHERE c_nationkey % 5 = 2")
def diagnostics(spark, sf_dir):
    """Rows of unknown classes, unknown slots and contradicting rows are reported and stop nothing."""
    customer, to = read_table(spark, sf_dir, "customer"), lambda kind: F.concat(F.lit(kind), "c_custkey")
    maps = [rows_of(customer.filter(F.least(F.col("c_nationkey") % 5, F.lit(3)) == k), "c_custkey", *entries, step=2) for k, entries in enumerate((
        [_row(F.col("c_name"), "a", "sales", to("a"))], [_sale(F.col("c_name"), to("b"))], [_sale("o_orderkey", to("c")), _sale("o_custkey", to("c"))],
        [_sale("o_orderkey", to("d")), _sale("o_orderkey", to("d"))],
    ))]
    return compiler.compile_mapping(spark, Schema.parse(SOURCE), Schema.parse(TARGET), prepare.prepare_maps(reshape.union_all(maps))).diagnostics.select("code", "message")


@query("SELECT c_custkey, c_name || ' [X:' || c_custkey || ']' AS full_value FROM customer")
def add_ontology(spark, sf_dir):
    """Bare values get the full spelling of the value list back."""
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    known = {f"{n['c_name']} [X:{n['c_custkey']}]": {} for n in customer.collect()}
    schema = Schema.parse(yaml.safe_dump({"name": "x", "enums": {"natSet": {"permissible_values": known}}}))
    bare = customer.select("c_custkey", F.col("c_name").alias("full_value"), F.lit("natSet").alias("enum"))
    return compiler._full_value(bare, schema, "enum", "full_value", r"\[X:[0-9]+\]").select("c_custkey", "full_value")


# --- the older run ------------------------------------------------------------------------------------------------

_PARTS = """
SELECT p_partkey AS ord, CASE p_size % 5 WHEN 0 THEN 'NA' ELSE p_type END AS tbl, p_brand AS variable, CASE WHEN p_size % 2 = 0 THEN 'variableCategories' ELSE 'tables' END AS location,
       CASE WHEN p_size % 3 = 0 THEN p_name || ';' || p_brand ELSE p_name END AS value, 'e' || p_size % 7 AS target_enum, 'new_' || p_type AS target_class, 'slot_' || p_size % 4 AS target_slot FROM part
"""
_ROLES = {"tables": "tbl", "variable": "variable", "location": "location", "target_enum": "target_enum", "target_value": "target_slot", "value": "value", "target": "target_slot", "source": "variable", "order": "ord"}
_TAKEN = {"PROMO": ["new_PROMO"], "ECONOMY": ["new_ECONOMY", "other"]}


def _older(spark, sf_dir) -> dict[str, DataFrame]:
    parts = read_table(spark, sf_dir, "part").selectExpr(*(x.strip() for x in _split_select(_PARTS))).withColumnRenamed("tbl", "table name")
    overrides = local_table(spark, [("PROMO", "new_PROMO", "slot_0", "given"), ("PROMO", "new_PROMO", "slot_1", None), ("PROMO", "new_PROMO", "slot_9", "added")], "tbl string, target_class string, target_slot string, variable string")
    return legacy.run(parts, {"table name": "tbl"}, ["value"], ["tbl", "target_class"], _ROLES, _TAKEN, overrides)


def _split_select(sql: str) -> list[str]:
    """The select list of the text above (its items are divided by a comma and a space before a name or CASE at depth 0)."""
    body, out, depth = sql.strip().removeprefix("SELECT ").rsplit(" FROM ", 1)[0], [""], 0
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@query(f"SELECT ord, tbl, CASE WHEN value LIKE '%;%' THEN string_split(value, ';')[i] ELSE value END AS value, CASE WHEN location = 'variableCategories' THEN tbl || upper(variable[1]) || variable[2:] END AS enum FROM (SELECT *, unnest(CASE WHEN value LIKE '%;%' THEN [1, 2] ELSE [1] END) AS i FROM ({_PARTS}) WHERE tbl <> 'NA')")
def older_rows(spark, sf_dir):
    return _older(spark, sf_dir)["rows"].select("ord", "tbl", "value", F.col("sourceEnumName").alias("enum"))


_CODED = f"SELECT *, tbl || variable AS enum, unnest(CASE WHEN value LIKE '%;%' THEN string_split(value, ';') ELSE [value] END) AS v FROM ({_PARTS}) WHERE tbl <> 'NA' AND location = 'variableCategories'"


@query(f"SELECT enum, count(DISTINCT target_enum) AS n FROM ({_CODED}) GROUP BY enum HAVING count(DISTINCT target_enum) > 1")
def older_enum_errors(spark, sf_dir):
    return _older(spark, sf_dir)["enum_errors"].select(F.col("sourceEnumName").alias("enum"), "n")


@query(f"SELECT enum, target_enum, target_slot, string_agg(v, '|' ORDER BY ord, v) AS source_values FROM ({_CODED}) WHERE enum NOT IN (SELECT enum FROM ({_CODED}) GROUP BY enum HAVING count(DISTINCT target_enum) > 1) GROUP BY ALL")
def older_enums(spark, sf_dir):
    """Source values of each target value in the order of their rows, repeats kept."""
    found = _older(spark, sf_dir)["enums"]
    return found.select(F.col("sourceEnumName").alias("enum"), "target_enum", "target_slot", F.array_join("values", "|").alias("source_values"))


@query(f"""
WITH r AS (SELECT *, unnest(CASE WHEN value LIKE '%;%' THEN [1, 2] ELSE [1] END) AS i FROM ({_PARTS}) WHERE tbl IN ('PROMO', 'ECONOMY')),
s AS (SELECT tbl, target_class, target_slot, max_by(variable, ord) AS variable FROM r WHERE (tbl, target_class) IN (SELECT (tbl, target_class) FROM r GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
o(tbl, target_class, target_slot, variable) AS (VALUES ('PROMO', 'new_PROMO', 'slot_0', 'given'), ('PROMO', 'new_PROMO', 'slot_1', NULL), ('PROMO', 'new_PROMO', 'slot_9', 'added'))
SELECT * FROM s WHERE (tbl, target_class, target_slot) NOT IN (SELECT (tbl, target_class, target_slot) FROM o) UNION ALL SELECT * FROM o WHERE variable IS NOT NULL
""")
def older_slots(spark, sf_dir):
    """Slots of the class pairs that the run takes, under overrides that set and remove slots."""
    return _older(spark, sf_dir)["slots"].select("tbl", "target_class", "target_slot", "variable")


@query("SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'ECONOMY')")
def rows_with_status(spark, sf_dir):
    return legacy.with_status(read_table(spark, sf_dir, "part").withColumn("p_type", F.concat(F.lit(" "), "p_type")), "p_type", ["PROMO", "ECONOMY"]).select("p_partkey")


@query("SELECT p_partkey, json_extract_string(json_object('n', p_size * 2 + 1, 'label', p_brand || '/' || p_type), '$.n') AS n, p_brand || '/' || p_type AS label, CASE WHEN p_size > 10 THEN 'big' WHEN p_size > 5 THEN 'mid' END AS size FROM part")
def expressions_of_rows(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    told = json.loads('{"n": "str(src.p_size * 2 + 1)", "label": "src.p_brand + \'/\' + src.p_type", "size": "case((src.p_size > 10, \'big\'), (src.p_size > 5, \'mid\'))"}')
    return part.select("p_partkey", *(exprs.to_column(e).alias(c) for c, e in told.items()))

