"""Compilation of mapping rows into relational specs.

Every step is a few joins and aggregations over mapping rows and schemas; broken
rows become diagnostics instead of stopping the run.  Up to ``HELD_ROWS`` rows the
steps are small jobs and the driver holds their results; beyond, the same steps run
like those of data and their results are kept in files.  The result has four tables:

* ``classes``: deriv_id, source_class, target_class, is_wide, ord
* ``slots``: deriv_id, target_slot, kind (copy, expr, const), source_slot, expr, settings, ord
* ``enums``: scope (source_class, target_class, source_slot, target_slot; blank is any), target_enum, source_enum, settings
* ``values``: the same scope and target_enum, target_value, source_values

``settings`` are those of the rows' YAML cells, each value as JSON text; of equal
names the last row's counts.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from dataclasses import dataclass, field

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotweave.functions import names
from slotweave.operators import reshape
from slotweave.sources.local import few, kept, local_table, numbered, settled, small_jobs, spread
from slotweave.sources.metadata import Schema

PAIR = ["sourceClass", "targetClass"]
SCOPE = ["sourceClass", "targetClass", "sourceSlot", "targetSlot"]


SETTINGS = ["slotDerivationSettings", "enumDerivationSettings"]
#: Compiled specs of a session are kept by their rows and schemas.
KEPT_SPECS = 64


class MappingError(ValueError):
    pass


@dataclass(frozen=True)
class Specs:
    classes: DataFrame
    slots: DataFrame
    enums: DataFrame
    values: DataFrame
    bindings: DataFrame
    diagnostics: DataFrame
    #: What execution has read of them, so that it is collected once.
    read: dict = field(default_factory=dict, compare=False, repr=False)
    #: Whether the tables are in files and may be too large for the driver.
    large: bool = False
    #: (enum, pos, value) of source enums whose values are a table.
    listed: DataFrame | None = None


def _note(rows: DataFrame, severity: str, code: str, message: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("_ord").cast("long").alias("ord"), message.alias("message"))


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _settings_cells(rows: list, columns: list[str], ord_at: int | None) -> tuple[list[tuple], list[tuple]]:
    """(rows with YAML settings as JSON objects of JSON texts, diagnostics of cells that aren't mappings)."""
    at = [columns.index(c) for c in SETTINGS if c in columns]
    out, bad = [], []
    for row in map(list, rows):
        for k in at:
            if row[k] is not None and row[k].strip():
                told = _settings_json(row[k])
                if told is None:
                    bad.append(("error", "E_SETTINGS", None if ord_at is None else row[ord_at], f"{_BAD_SETTINGS}{row[k]}"))
                row[k] = told
        out.append(tuple(row))
    return out, bad


#: libyaml's loader where it is there: many times faster.
_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
_BAD_SETTINGS = "settings that are no YAML mapping: "


def _settings_json(cell: str) -> str | None:
    """A YAML mapping as a JSON object of JSON texts; None of what is none."""
    try:
        held = yaml.load(cell, _LOADER)
    except yaml.YAMLError:
        # libyaml refuses a few texts that PyYAML takes
        try:
            held = yaml.safe_load(cell)
        except yaml.YAMLError:
            return None
    return json.dumps({str(n): json.dumps(v, sort_keys=True, default=str) for n, v in sorted(held.items(), key=lambda x: str(x[0]))}) if isinstance(held, dict) else None


def _read_cells(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The same of a large table, by tasks: (rows, diagnostics or None where there are no settings)."""
    @F.pandas_udf("string")
    def told(cells: pd.Series) -> pd.Series:
        known: dict[str, str | None] = {}
        for c in cells:
            if c is not None and c not in known:
                known[c] = _settings_json(c) if c.strip() else c
        return pd.Series([None if c is None else known[c] for c in cells], dtype=object)

    columns = [c for c in SETTINGS if dict(rows.dtypes).get(c) == "string"]
    read = kept((spread(rows) if columns else rows).withColumns({f"_told_{c}": told(c) for c in columns}))
    out = read.withColumns({c: F.col(f"_told_{c}") for c in columns}).select(*rows.columns)
    notes = [_note(read.filter(f"{c} IS NOT NULL AND _told_{c} IS NULL"), "error", "E_SETTINGS", F.concat(F.lit(_BAD_SETTINGS), c)) for c in columns]
    return out, reshape.union_all(notes) if notes else None


def _read_settings(c: Column) -> Column:
    return F.coalesce(F.map_entries(F.from_json(c, "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))


def _last_settings(cells: Column) -> Column:
    """One map of an array of settings cells: of equal names the last counts."""
    merged = F.flatten(F.transform(cells, _read_settings))
    return F.aggregate(merged, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))


def _merged_settings(rows: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """(keys, settings): the settings of all cells of a group as one map, those that come last at its end; of equal names the last row's counts.

    Names are met before the rows of a group are, so however many rows have the same settings nothing grows with them.
    """
    each = rows.filter(_filled(cell)).select(*keys, "_ord", F.posexplode(_read_settings(F.col(cell))).alias("_at", "_e"))
    last = each.groupBy(*keys, F.col("_e.key").alias("_name")).agg(F.max(F.struct("_ord", "_at", F.col("_e.value").alias("value"))).alias("_l"))
    in_order = F.array_sort(F.collect_list(F.struct(F.col("_l._ord").alias("o"), F.col("_l._at").alias("a"), F.col("_name").alias("key"), F.col("_l.value").alias("value"))))
    return last.groupBy(*keys).agg(F.map_from_entries(F.transform(in_order, lambda x: F.struct(x["key"], x["value"]))).alias("settings"))


_NO_SETTINGS = "CAST(map() AS map<string,string>)"


def class_derivations(maps: DataFrame, source: Schema) -> tuple[DataFrame, DataFrame]:
    """(pair slots, diagnostics): one slot derivation for each class pair and target slot."""
    spark = maps.sparkSession
    known = source.class_table(spark).select(F.col("class").alias("sourceClass"))
    slots = source.slot_table(spark).select(F.col("class").alias("sourceClass"), F.col("slot").alias("sourceSlot"))
    rows = maps.join(known, "sourceClass", "left_semi").withColumn("kind", F.when(_filled("targetExpr") | _filled("customData"), "expr").otherwise("copy"))
    lost = _note(maps.join(known, "sourceClass", "left_anti").filter(_filled("sourceClass")), "warning", "W_UNKNOWN_CLASS", F.concat(F.lit("no source class "), F.col("sourceClass")))
    bad = rows.filter("kind = 'copy'").join(slots, ["sourceClass", "sourceSlot"], "left_anti")
    unknown = _note(bad, "error", "E_UNKNOWN_SLOT", F.concat_ws("", F.lit("no source slot "), "sourceClass", F.lit("."), "sourceSlot"))
    # an expression's settings belong to what must not differ; those of copies are merged
    told = F.when((F.col("kind") == "expr") & _filled("slotDerivationSettings"), F.col("slotDerivationSettings"))
    entry = F.struct("kind", F.when(F.col("kind") == "copy", F.col("sourceSlot")).alias("source_slot"), F.when(F.col("kind") == "expr", F.col("targetExpr")).alias("expr"), told.alias("told"))
    folded = (
        rows.withColumn("entry", entry).groupBy(*PAIR, "targetSlot")
        .agg(F.min("entry").alias("e"), F.max("entry").alias("other"), F.min("_ord").alias("_ord"))
    )
    conflict = _note(folded.filter("NOT e <=> other"), "error", "E_CONFLICT", F.concat_ws("", F.lit("several derivations of "), "targetClass", F.lit("."), "targetSlot"))
    settings = _merged_settings(rows, [*PAIR, "targetSlot"], "slotDerivationSettings").withColumnsRenamed({c: f"_{c}" for c in (*PAIR, "targetSlot")})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*PAIR, "targetSlot")]
    out = folded.join(settings, same[0] & same[1] & same[2], "left").select(*PAIR, "targetSlot", "e.kind", "e.source_slot", "e.expr", F.coalesce("settings", F.expr(_NO_SETTINGS)).alias("settings"), "_ord")
    return out, reshape.union_all([lost, unknown, conflict])


def _enum_of(rows: DataFrame, schema: Schema, cls: str, slot: str, value: str, ontology: str | None, out: str) -> DataFrame:
    """Add ``out``: the first enum in the slot's ranges that has the value (by itself or without ontology ids), and ``out``_first: the first enum at all."""
    spark = rows.sparkSession
    enums = schema.range_table(spark).filter("kind = 'enum'").select(F.col("class").alias("_c"), F.col("slot").alias("_s"), F.col("pos").alias("_p"), F.col("range").alias("_e"))
    values = schema.value_table(spark, ontology).select(F.col("enum").alias("_e"), F.col("value").alias("_v"), F.col("stripped").alias("_st"))
    firsts = enums.groupBy("_c", "_s").agg(F.min_by("_e", "_p").alias(f"{out}_first"))
    lookup = enums.join(values, "_e")
    by_value = lookup.select("_c", "_s", "_p", "_e", F.explode(F.array_distinct(F.array("_v", "_st"))).alias("_x")).groupBy("_c", "_s", "_x").agg(F.min_by("_e", "_p").alias(out))
    with_first = rows.join(firsts, (F.col(cls) == F.col("_c")) & (F.col(slot) == F.col("_s")), "left").drop("_c", "_s")
    return with_first.join(by_value, (F.col(cls) == F.col("_c")) & (F.col(slot) == F.col("_s")) & (F.col(value) == F.col("_x")), "left").drop("_c", "_s", "_x")


def _full_value(rows: DataFrame, schema: Schema, enum: str, value: str, ontology: str | None) -> DataFrame:
    """Replace a value by the enum's full value that equals it without ontology ids; others stay."""
    known = schema.value_table(rows.sparkSession, ontology).groupBy(F.col("enum").alias("_e"), F.col("stripped").alias("_st")).agg(F.min_by("value", "pos").alias("_full"))
    joined = rows.join(known, (F.col(enum) == F.col("_e")) & (names.strip_ontology(F.col(value), ontology) == F.col("_st")), "left")
    return joined.withColumn(value, F.coalesce("_full", value)).drop("_e", "_st", "_full")


def enum_derivations(rows: DataFrame, source: Schema, target: Schema, ontology: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(enums, values, diagnostics) of rows with SCOPE, sourceEnum, targetEnum, sourceValue, targetValue, enumDerivationSettings and _ord."""
    cells = ["sourceEnum", "targetEnum", *SCOPE]
    blank = rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in cells})
    told = blank.filter(~names.is_reference(F.col("targetValue")) & ~(~_filled("sourceValue") & ~_filled("targetValue")))
    told = told.withColumns({c: names.empty_sentinel(F.coalesce(F.col(c), F.lit(""))) for c in ("sourceValue", "targetValue")})
    sourced = _enum_of(told, source, "sourceClass", "sourceSlot", "sourceValue", ontology, "_src")
    sourced = sourced.withColumn("source_enum", F.coalesce(F.nullif("sourceEnum", F.lit("")), "_src", "_src_first"))
    not_enum = _note(sourced.filter("source_enum IS NULL"), "error", "E_NOT_ENUM", F.concat_ws("", F.lit("not an enumeration: "), "sourceClass", F.lit("."), "sourceSlot"))
    odd = _note(sourced.filter("source_enum IS NOT NULL AND sourceEnum = '' AND _src IS NULL"), "warning", "W_VALUE_NOT_IN_ENUM", F.concat_ws("", F.lit("source value "), "sourceValue"))
    aimed = _enum_of(sourced.filter("source_enum IS NOT NULL"), target, "targetClass", "targetSlot", "targetValue", ontology, "_tgt")
    by_slot = F.coalesce("_tgt", "_tgt_first", F.concat("targetSlot", F.lit("_from_"), "source_enum"))
    fallback = F.coalesce(F.nullif("targetEnum", F.lit("")), F.concat(F.lit(f"{target.name}_enum_from_"), "source_enum"))
    aimed = aimed.withColumn("target_enum", F.when(_filled("targetClass") & _filled("targetSlot"), by_slot).otherwise(fallback))
    full = _full_value(_full_value(aimed, source, "source_enum", "sourceValue", ontology), target, "target_enum", "targetValue", ontology)
    key = [*SCOPE, "target_enum"]
    enums = full.groupBy(*key).agg(F.min_by("source_enum", "_ord").alias("source_enum"), F.count_distinct("source_enum").alias("_n"), F.min("_ord").alias("_ord"))
    enums = enums.join(_merged_settings(full, key, "enumDerivationSettings"), key, "left").withColumn("settings", F.coalesce("settings", F.expr(_NO_SETTINGS)))
    enums = enums.withColumn("mirror_source", F.coalesce(F.try_element_at("settings", F.lit("mirror_source")).try_cast("boolean"), F.lit(False)))
    two = _note(enums.filter("_n > 1"), "error", "E_TWO_SOURCES", F.concat_ws("", F.lit("several source enums feed "), "target_enum"))
    pairs = full.withColumnRenamed("targetValue", "target_value")
    values = reshape.ordered_fold(pairs, [*key, "target_value"], "sourceValue", "_ord").withColumnRenamed("values", "source_values")
    return enums.drop("_n"), values, reshape.union_all([not_enum, odd, two])


def wide_cells(wide: DataFrame, source_ops: list | None = None) -> DataFrame:
    """Slot entries of the first row of each wide group: group keys, targetSlot, kind, source_slot, expr, rank, pos."""
    keys = ["sourceClass", "sourceSlot", "targetClass", "wideGroup"]
    first = reshape.first_rows(wide, keys, [F.col("_ord")])
    cell_names = [c for c in wide.columns if c.endswith(("_value", "_expr"))]
    cells = reshape.unpivot_cells(reshape.json_cells(first, "wideOtherSlots", cell_names), [*keys, "_ord"])
    other = (
        first.select(*keys, "_ord", F.explode(F.from_json("wideOtherSlots", "map<string,string>")).alias("name", "cell"))
        .filter(names.wide_kind(F.col("name")).isNotNull() & ~F.col("name").isin(cell_names))
        .select(*keys, "_ord", names.strip_wide_suffix(F.col("name")).alias("slot"), names.wide_kind(F.col("name")).alias("kind"), "cell", F.when(names.wide_kind(F.col("name")) == "expr", 2).otherwise(1).alias("rank"), F.lit(len(wide.columns)).alias("pos"))
    )
    both = cells.unionByName(other).join(first.select(*keys, F.col("slotDerivationSettings").alias("told")), keys)
    return _wide_entries(both, keys, source_ops)


def _wide_entries(cells: DataFrame, keys: list[str], source_ops: list | None) -> DataFrame:
    """Slot entries of wide cells (keys, _ord, slot, kind, cell, told, rank, pos): an expression, a copy where the cell refers to a slot, else a constant, under the row's settings."""
    copied = names.variable_reference(F.col("cell"), source_ops)
    kind = F.when(F.col("kind") == "expr", "expr").when(copied.isNotNull(), "copy").otherwise("const")
    expr = F.when(F.col("kind") == "expr", F.col("cell")).when(copied.isNull(), names.empty_sentinel(F.col("cell")))
    settings = F.when(_filled("told"), _last_settings(F.array("told")))
    return cells.select(*keys, "_ord", F.col("slot").alias("targetSlot"), kind.alias("kind"), F.when(kind == "copy", copied).alias("source_slot"), expr.alias("expr"), settings.alias("settings"), "rank", "pos")


def wide_row_cells(wide: DataFrame, source_ops: list | None = None) -> DataFrame:
    """The same of rows that name one slot each: all rows of a ``wideRowNumber`` make one derivation.

    Rows count in the order of their numbers, those of one number in the order of
    the sheet; of rows for one slot the last one counts.  A row's expression
    counts before its value.
    """
    keys = ["sourceClass", "sourceSlot", "targetClass", "wideGroup"]
    number = F.coalesce(F.col("wideRowNumber").try_cast("double"), F.lit(0.0))
    told = wide.select(
        "sourceClass", F.lit("").alias("sourceSlot"), "targetClass", F.format_string("%020.6f", number).alias("wideGroup"), number.cast("long").alias("_ord"), F.coalesce("targetSlot", F.lit("")).alias("slot"),
        F.when(_filled("targetExpr"), "expr").otherwise("value").alias("kind"), F.when(_filled("targetExpr"), F.col("targetExpr")).otherwise(F.coalesce("targetValue", F.lit(""))).alias("cell"),
        F.col("slotDerivationSettings").alias("told"), F.lit(1).alias("rank"), F.col("_ord").alias("pos"),
    )
    return _wide_entries(told, keys, source_ops)


def overlay(base: DataFrame, cells: DataFrame) -> DataFrame:
    """Slots of each wide group: the pair's base slots (rank 0) under the group's cells; the highest rank of a slot stays."""
    keys = ["sourceClass", "sourceSlot", "targetClass", "wideGroup"]
    groups = cells.select(*keys).distinct()
    under = groups.join(base.select(*PAIR, "targetSlot", "kind", "source_slot", "expr", "settings", F.col("_ord").alias("pos")), PAIR).withColumn("rank", F.lit(0))
    both = under.unionByName(cells.select(*keys, "targetSlot", "kind", "source_slot", "expr", "settings", F.col("pos").cast("long").alias("pos"), "rank"))
    w = Window.partitionBy(*keys, "targetSlot")
    ranked = both.withColumn("_n", F.row_number().over(w.orderBy(F.desc("rank"), F.desc("pos")))).withColumn("_first", F.min(F.struct(F.col("rank") > 0, "pos")).over(w))
    return ranked.filter("_n = 1").select(*keys, "targetSlot", "kind", "source_slot", "expr", "settings", "_first")


def bind_enums(slots: DataFrame, enums: DataFrame, source: Schema) -> tuple[DataFrame, DataFrame]:
    """(bindings, diagnostics): the enum derivations of each copied slot with enum ranges, one for each range.

    A scope matches where each of its keys is blank or equal; exactly one match
    binds, none mirrors the range's values, several are an error.  ``mirrored``
    has the values of a range that is mirrored, unless these are a table.
    """
    ranges = source.range_table(slots.sparkSession).filter("kind = 'enum'").select(F.col("class").alias("source_class"), F.col("slot").alias("source_slot"), F.col("range").alias("source_enum"))
    wanted = slots.filter("kind = 'copy'").join(ranges, ["source_class", "source_slot"])
    # each of the sixteen ways to leave keys blank is one key to look up, so scopes are met by equality alone
    own = [F.coalesce(c, F.lit("")) for c in ("source_class", "target_class", "source_slot", "target_slot")]
    ways = F.array_distinct(F.array(*(F.struct(*((v if mask >> k & 1 else F.lit("")).alias(c) for k, (c, v) in enumerate(zip(SCOPE, own, strict=True)))) for mask in reversed(range(1 << len(SCOPE))))))
    keys = ["deriv_id", "target_slot", "source_enum"]
    met = wanted.select(*keys, F.inline(ways)).distinct().join(enums, ["source_enum", *SCOPE])
    # the most specific scope comes first where several fit
    rank = F.struct(*(F.when(F.col(c) == "", 1).otherwise(0) for c in SCOPE), "target_enum")
    found = met.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(F.struct(*SCOPE, "target_enum", "mirror_source", "settings"), rank).alias("b"))
    counted = wanted.groupBy(*keys).agg(F.min("ord").alias("_ord")).join(found, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    many = _note(counted.filter("n > 1"), "error", "E_AMBIGUOUS", F.concat_ws("", F.lit("several enum derivations fit "), "target_slot"))
    known = source.held_values(slots.sparkSession).groupBy(F.col("enum").alias("source_enum")).agg(F.collect_list("value").alias("mirrored"))
    found = F.col("n") == 1
    bound = counted.filter("n <= 1").select(
        "deriv_id", "target_slot", "source_enum", *(F.when(found, F.col(f"b.{c}")).alias(c) for c in SCOPE),
        F.when(found, F.col("b.target_enum")).otherwise(F.concat("source_enum", F.lit("[=mirrored=]"))).alias("target_enum"), F.when(found, F.col("b.mirror_source")).otherwise(True).alias("mirror_source"), F.when(found, F.col("b.settings")).alias("settings"),
    )
    return bound.join(known, "source_enum", "left").withColumn("mirrored", F.when(F.col("mirror_source"), F.col("mirrored"))).select(*bound.columns, "mirrored"), many


def _kept(spark: SparkSession) -> OrderedDict[str, Specs]:
    """The session's compiled specs; they live on the session and go with it."""
    return spark.__dict__.setdefault("_slotweave_specs", OrderedDict())


def forget_specs(spark: SparkSession) -> None:
    """Compile anew from now on."""
    _kept(spark).clear()


def compile_mapping(spark: SparkSession, source: Schema, target: Schema, maps: DataFrame | None = None, wide: DataFrame | None = None, enums: DataFrame | None = None, source_ops: list | None = None, ontology: str | None = None, strict: bool = False) -> Specs:
    """Specs of prepared ``maps``, ``wide`` and ``enums`` rows; ``strict`` raises on the first errors.

    Specs that the session has compiled from the same rows and schemas are used
    again, but for large ones.
    """
    with small_jobs(spark):
        given = {k: (None if x is None else (x, few(x))) for k, x in (("maps", maps), ("wide", wide), ("enums", enums))}
    if source.listed is not None or target.listed is not None or any(x and x[1] is None for x in given.values()):
        specs = _compiled(spark, source, target, {k: x and (x[0], None) for k, x in given.items()}, source_ops, ontology, large=True)
        return _checked(specs) if strict else specs
    with small_jobs(spark):
        told = [(k, x and x[0].dtypes, x and [tuple(r) for r in x[1]]) for k, x in given.items()]
        key = hashlib.sha256(repr((told, source.raw, target.raw, source_ops, ontology, spark.conf.get("spark.sql.session.timeZone"))).encode()).hexdigest()
        kept = _kept(spark)
        specs = kept.get(key)
        if specs is None:
            specs = kept[key] = _compiled(spark, source, target, given, source_ops, ontology)
            while len(kept) > KEPT_SPECS:
                kept.popitem(last=False)
        return _checked(specs) if strict else specs


def _checked(specs: Specs) -> Specs:
    if errors := specs.diagnostics.filter("severity = 'error'").orderBy("ord").limit(20).collect():
        raise MappingError("; ".join(f"{r['code']}: {r['message']}" for r in errors))
    return specs


def _compiled(spark: SparkSession, source: Schema, target: Schema, given: dict[str, tuple[DataFrame, list | None] | None], source_ops: list | None, ontology: str | None, large: bool = False) -> Specs:
    keep = kept if large else settled
    empty = local_table(spark, [], ", ".join(f"{c} string" for c in ("sourceClass", "sourceSlot", "sourceValue", "targetClass", "targetSlot", "targetValue", "targetExpr", "customData", "slotDerivationSettings", "enumDerivationSettings", "sourceEnum", "targetEnum", "wideGroup", "wideOtherSlots")) + ", _ord long")
    tables, bad, notes_of_cells = {"maps": empty, "wide": empty, "enums": None}, [], []
    for name, held in given.items():
        if held is not None:
            frame, rows = held
            if large:
                tables[name], wrong = _read_cells(frame)
                notes_of_cells += [] if wrong is None else [wrong]
                continue
            read, wrong = _settings_cells(rows, frame.columns, frame.columns.index("_ord") if "_ord" in frame.columns else None)
            tables[name] = settled(frame, read)
            bad += wrong
    maps, wide, enums = tables["maps"], tables["wide"], tables["enums"]
    has_wide = given["wide"] is not None and not wide.isEmpty()
    base, notes = class_derivations(maps.filter(_filled("targetSlot") | _filled("targetExpr")), source)
    base = keep(base)
    notes = reshape.union_all([notes, local_table(spark, bad, "severity string, code string, ord long, message string"), *notes_of_cells])
    # a wide row of one slot has its cell in targetValue, so only a source value makes it an enum row
    coded = wide.filter(_filled("sourceValue")) if "wideRowNumber" in wide.columns else wide
    parts = [reshape.pad(x, [*SCOPE, "sourceEnum", "targetEnum", "sourceValue", "targetValue", "enumDerivationSettings", "_ord"]) for x in (maps, enums, coded) if x is not None]
    value_rows = keep(reshape.union_all(parts).filter(_filled("sourceValue") | _filled("targetValue")).withColumn("_ord", F.col("_ord").cast("long")))
    if not value_rows.head(1):
        enum_table = local_table(spark, [], ", ".join(f"{c} string" for c in (*SCOPE, "target_enum", "source_enum")) + ", settings map<string,string>, mirror_source boolean, _ord long")
        values = local_table(spark, [], ", ".join(f"{c} string" for c in (*SCOPE, "target_enum", "target_value")) + ", source_values array<string>")
    else:
        enum_table, values, enum_notes = enum_derivations(value_rows, source, target, ontology)
        enum_table, values, notes = keep(enum_table), keep(values), notes.unionByName(enum_notes)
    keys = ["sourceClass", "sourceSlot", "targetClass", "wideGroup"]
    # a pair with wide groups emits those, not its base
    pairs = base.groupBy(*PAIR).agg(F.min("_ord").alias("ord"))
    everything = pairs.withColumns({"sourceSlot": F.lit(""), "wideGroup": F.lit(""), "is_wide": F.lit(False)})
    cells = None
    if has_wide:
        cells = keep((wide_row_cells if "wideRowNumber" in wide.columns else wide_cells)(wide, source_ops))
        order = cells.groupBy(*keys).agg(F.min("_ord").alias("ord")).withColumn("is_wide", F.lit(True))
        everything = order.unionByName(everything.join(order.select(*PAIR).distinct(), PAIR, "left_anti").select(*order.columns))
    order = [F.desc("is_wide"), F.col("ord"), *map(F.col, keys)]
    placed = numbered(everything, order, "deriv_id").withColumn("deriv_id", F.col("deriv_id").cast("int")) if large else settled(everything.withColumn("deriv_id", F.row_number().over(Window.orderBy(*order)) - 1))
    entry = [F.col("sourceClass").alias("source_class"), F.col("targetClass").alias("target_class"), F.col("targetSlot").alias("target_slot"), "kind", "source_slot", "expr", "settings"]
    slots = base.join(placed.filter("NOT is_wide").select(*PAIR, "deriv_id"), PAIR).select("deriv_id", *entry, F.col("_ord").alias("ord"))
    if cells is not None:
        by_group = overlay(base, cells).join(placed, keys).select("deriv_id", *entry, F.row_number().over(Window.partitionBy("deriv_id").orderBy("_first", "targetSlot")).cast("long").alias("ord"))
        slots = by_group.unionByName(slots)
        notes = notes.unionByName(_note(cells.filter("targetSlot = ''"), "error", "E_EMPTY_SLOT", F.lit("a wide cell without a slot name")))
    slots = keep(slots)
    bindings, many = bind_enums(slots, enum_table, source)
    bindings = keep(bindings)
    diagnostics = keep(notes.unionByName(many))
    classes = placed.select("deriv_id", F.col("sourceClass").alias("source_class"), F.col("targetClass").alias("target_class"), "is_wide", "ord")
    return Specs(classes, slots, enum_table, values, bindings, diagnostics, large=large, listed=source.listed)
