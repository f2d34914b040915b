"""Checks of compiled specs against both schemas, all specs at once, as report tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.functions import exprs, names
from slotweave.functions.names import EXTRA_PREFIX
from slotweave.operators.compile import SCOPE, Specs
from slotweave.sources.local import local_table, small_jobs, work_folder
from slotweave.sources.metadata import Schema

COLUMNS = ["sourceClass", "sourceSlot", "sourceEnumName", "sourceEnumValue", "targetClass", "targetSlot", "targetEnumName", "targetEnumValue", "numMappers", "mapper"]


def bound_enums(specs: Specs) -> DataFrame:
    """Enum derivations as the specs use them: one row for each derivation and target slot."""
    slots = specs.slots.filter("kind = 'copy'").select("deriv_id", "target_slot", "source_class", "target_class", "source_slot")
    used = specs.bindings.withColumnRenamed("target_enum", "_enum").join(slots, ["deriv_id", "target_slot"])
    values = specs.values.groupBy(*SCOPE, "target_enum").agg(F.collect_list(F.struct("target_value", "source_values")).alias("entries"))
    on = [F.col(f"u.{c}").eqNullSafe(F.col(f"v.{c}")) for c in SCOPE]
    joined = used.select("deriv_id", "target_slot", "source_class", "target_class", "source_slot", "source_enum", "mirror_source", "_enum", *SCOPE).alias("u").join(values.alias("v"), on[0] & on[1] & on[2] & on[3] & (F.col("_enum") == F.col("v.target_enum")), "left")
    return joined.select(
        F.col("source_class").alias("sourceClass"), F.col("source_slot").alias("sourceSlot"), F.col("source_enum").alias("sourceEnumName"), F.col("target_class").alias("targetClass"), F.col("target_slot").alias("targetSlot"),
        F.col("_enum").alias("targetEnumName"), "mirror_source", F.col("deriv_id").cast("string").alias("mapper"), "entries",
    )


def _mapped(used: DataFrame) -> DataFrame:
    each = used.select("*", F.explode("entries").alias("x"))
    return each.select(*(c for c in used.columns if c != "entries"), F.col("x.target_value").alias("targetEnumValue"), F.explode_outer("x.source_values").alias("sourceEnumValue"))


def missing_source_values(used: DataFrame, source: Schema) -> DataFrame:
    """Values of a source enum that no entry maps."""
    values = source.value_table(used.sparkSession).select(F.col("enum").alias("sourceEnumName"), F.col("value").alias("sourceEnumValue"))
    wanted = used.filter("entries IS NOT NULL").drop("entries", "mirror_source").join(values, "sourceEnumName")
    return wanted.join(_mapped(used), ["mapper", "targetSlot", "sourceEnumName", "sourceEnumValue"], "left_anti")


def unrecognized_source_values(used: DataFrame, source: Schema) -> DataFrame:
    """Mapped source values that the source enum lacks, with the target value they map to."""
    values = source.value_table(used.sparkSession).select(F.col("enum").alias("sourceEnumName"), F.col("value").alias("sourceEnumValue"))
    return _mapped(used).filter("sourceEnumValue IS NOT NULL").join(values, ["sourceEnumName", "sourceEnumValue"], "left_anti").drop("mirror_source")


def _accepting(target: Schema, spark) -> DataFrame:
    """Target slots with enum values and no free text, and all their values."""
    ranges = target.range_table(spark)
    free = ranges.filter("range = 'string' OR kind = 'type'").select("class", "slot").distinct()
    values = target.value_table(spark).select(F.col("enum").alias("range"), "value")
    return ranges.join(free, ["class", "slot"], "left_anti").join(values, "range").select(F.col("class").alias("targetClass"), F.col("slot").alias("targetSlot"), F.col("value").alias("targetEnumValue"))


def unrecognized_target_values(used: DataFrame, target: Schema) -> DataFrame:
    """Target values that the target slot's enums lack; slots that take free text are left alone."""
    known = _accepting(target, used.sparkSession)
    checked = _mapped(used).join(known.select("targetClass", "targetSlot").distinct(), ["targetClass", "targetSlot"], "left_semi")
    return checked.join(known, ["targetClass", "targetSlot", "targetEnumValue"], "left_anti").drop("mirror_source")


def empty_derivations(used: DataFrame) -> DataFrame:
    """Enum slots without any value entry that don't copy values either."""
    return used.filter((F.coalesce(F.size("entries"), F.lit(0)) <= 0) & ~F.col("mirror_source")).drop("entries", "mirror_source")


def bad_constants(specs: Specs, target: Schema) -> DataFrame:
    """Constants that the target slot's enums lack; blank is fine where the slot isn't required."""
    spark = specs.slots.sparkSession
    known = _accepting(target, spark)
    quoted = names.is_quoted(F.col("expr")) & (F.col("kind") == "expr")
    const = specs.slots.filter((F.col("kind") == "const") | quoted).select(
        F.col("deriv_id").cast("string").alias("mapper"), F.col("source_class").alias("sourceClass"), F.col("target_class").alias("targetClass"), F.col("target_slot").alias("targetSlot"),
        F.when(quoted, names.unquoted(F.col("expr"))).otherwise(F.col("expr")).alias("targetEnumValue"),
    )
    optional = target.slot_table(spark).filter("NOT required").select(F.col("class").alias("targetClass"), F.col("slot").alias("targetSlot"), F.lit("").alias("targetEnumValue"))
    checked = const.join(known.select("targetClass", "targetSlot").distinct(), ["targetClass", "targetSlot"], "left_semi")
    return checked.join(known.unionByName(optional).distinct(), ["targetClass", "targetSlot", "targetEnumValue"], "left_anti")


def missing_derivations(specs: Specs) -> DataFrame:
    """Copied enum slots for which no derivation exists, so values are copied unchanged."""
    return specs.bindings.filter(F.endswith("target_enum", F.lit("[=mirrored=]")))


def simplify(report: DataFrame) -> DataFrame:
    """One row for each finding, with the number of specs that have it and their names in order."""
    keys = [c for c in report.columns if c not in ("mapper", "numMappers")]
    folded = report.groupBy(*keys).agg(F.count("*").alias("numMappers"), F.array_join(F.array_sort(F.collect_list("mapper")), "; ").alias("mapper"))
    return folded.filter(F.coalesce(*(F.col(c).cast("string") for c in keys)).isNotNull())


def presented(report: DataFrame) -> DataFrame:
    """Known columns first, blanks marked, findings in the order of their keys."""
    ordered = report.select(*[c for c in COLUMNS if c in report.columns], *[c for c in report.columns if c not in COLUMNS])
    marked = ordered.withColumns({c: names.blank_marker(F.col(c)) for c in ("sourceEnumValue", "targetEnumValue") if c in ordered.columns})
    keys = sorted(c for c in marked.columns if c in COLUMNS and c not in ("numMappers", "mapper"))
    return marked.orderBy(*keys)


def validate(specs: Specs, source: Schema, target: Schema, simple: bool = True) -> dict[str, DataFrame]:
    used = bound_enums(specs)
    reports = {
        "missing_source_enum_values": missing_source_values(used, source),
        "unrecognized_source_enum_values": unrecognized_source_values(used, source),
        "unrecognized_target_enum_values": unrecognized_target_values(used, target),
        "empty_permissible_value_derivations": empty_derivations(used),
        "unrecognized_constant_values": bad_constants(specs, target),
    }
    return {k: presented(simplify(r) if simple else r) for k, r in reports.items()}


# --- slot checks: name -> (specs, source, target) -> findings -------------------------------------------


def _both_sides(specs: Specs, source: Schema, target: Schema) -> DataFrame:
    """Copied slots with the ranges and the multiplicity of both sides; extra slots are left out."""
    spark = specs.slots.sparkSession

    def side(schema: Schema, cls: str, slot: str, prefix: str) -> DataFrame:
        ranges = schema.range_table(spark).groupBy("class", "slot").agg(F.exists(F.collect_list("kind"), lambda k: k != "enum").alias(f"{prefix}_free"), F.exists(F.collect_list("kind"), lambda k: k == "enum").alias(f"{prefix}_coded"))
        return ranges.join(schema.slot_table(spark).select("class", "slot", F.col("multivalued").alias(f"{prefix}_many")), ["class", "slot"]).withColumnsRenamed({"class": cls, "slot": slot})

    copied = specs.slots.filter((F.col("kind") == "copy") & ~F.startswith("target_slot", F.lit(EXTRA_PREFIX)))
    return copied.join(side(source, "source_class", "source_slot", "src"), ["source_class", "source_slot"]).join(side(target, "target_class", "target_slot", "tgt"), ["target_class", "target_slot"])


def free_text_to_enum(specs: Specs, source: Schema, target: Schema) -> DataFrame:
    return _both_sides(specs, source, target).filter("src_free AND tgt_coded AND NOT tgt_free").select("deriv_id", "source_class", "source_slot", "target_class", "target_slot")


def multi_to_single(specs: Specs, source: Schema, target: Schema) -> DataFrame:
    return _both_sides(specs, source, target).filter("src_many AND NOT tgt_many").select("deriv_id", "source_class", "source_slot", "target_class", "target_slot")


def unknown_target_slots(specs: Specs, source: Schema, target: Schema) -> DataFrame:
    known = target.slot_table(specs.slots.sparkSession).select(F.col("class").alias("target_class"), F.col("slot").alias("target_slot"))
    return specs.slots.filter(~F.startswith("target_slot", F.lit(EXTRA_PREFIX))).join(known, ["target_class", "target_slot"], "left_anti").select("deriv_id", "source_class", "source_slot", "target_class", "target_slot")


def refused_expressions(specs: Specs, source: Schema, target: Schema | None = None) -> DataFrame:
    """(deriv_id, source_class, target_class, target_slot, message) of expressions and statements that cannot be a Column over their source class."""
    spark = specs.slots.sparkSession
    if specs.large:
        return _refused_of_many(specs, source)
    with small_jobs(spark):
        told = specs.slots.filter("kind = 'expr' AND expr IS NOT NULL").select("deriv_id", "source_class", "target_class", "target_slot", "expr").orderBy("deriv_id", "ord").collect()
    known: dict[tuple[str, str], str | None] = {}
    for cls, text in {(r["source_class"], r["expr"]) for r in told}:
        known[cls, text] = exprs.why_refused(text, source.struct(cls))
    rows = [(*r[:4], known[r["source_class"], r["expr"]]) for r in told if known[r["source_class"], r["expr"]]]
    return local_table(spark, rows, "deriv_id int, source_class string, target_class string, target_slot string, message string")


#: Refused texts that the driver holds at once.
REFUSED_AT_ONCE = 10_000


def _refused_of_many(specs: Specs, source: Schema) -> DataFrame:
    """The same of large specs: Columns are made where the session is, so each distinct text passes by the driver once, and refused ones are written as they are found."""
    spark, path, refused = specs.slots.sparkSession, work_folder(specs.slots.sparkSession), []
    told = specs.slots.filter("kind = 'expr' AND expr IS NOT NULL").select("deriv_id", "source_class", "target_class", "target_slot", "expr")
    texts = told.select("source_class", "expr").distinct()

    def write() -> None:
        local_table(spark, refused, "source_class string, expr string, message string").write.mode("append").parquet(path)
        refused.clear()

    structs: dict[str, T.StructType] = {}
    write()
    for cls, text in texts.toLocalIterator():
        if cls not in structs:
            structs[cls] = source.struct(cls)
        if why := exprs.why_refused(text, structs[cls]):
            refused.append((cls, text, why))
            if len(refused) == REFUSED_AT_ONCE:
                write()
    write()
    wrong = spark.read.schema("source_class string, expr string, message string").parquet(path)
    return told.join(wrong, ["source_class", "expr"]).select("deriv_id", "source_class", "target_class", "target_slot", "message")


CHECKS: dict[str, Callable[[Specs, Schema, Schema], DataFrame]] = {"free_text_to_enum": free_text_to_enum, "multi_to_single": multi_to_single, "unknown_target_slots": unknown_target_slots, "refused_expressions": refused_expressions}


def check(specs: Specs, source: Schema, target: Schema, only: list[str] | None = None) -> dict[str, DataFrame]:
    return {k: CHECKS[k](specs, source, target) for k in only or CHECKS}
