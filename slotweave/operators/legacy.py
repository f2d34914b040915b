"""The older parts-list mapping: one sheet whose rows name the old table and column and the new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.functions import names
from slotweave.operators import reshape
from slotweave.sources.local import local_table

HEADERS = ["header", "fk", "pk"]


def named_tables(df: DataFrame, column: str) -> DataFrame:
    """Rows that name a table (not null, not NA)."""
    return df.filter(F.col(column).isNotNull() & (F.lower(column) != "na"))


def with_status(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.filter(F.trim(column).isin(allowed))


def header_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that are a header or a key in any of the table columns."""
    return df.filter(F.exists(F.array(*(F.coalesce(F.lower(c).isin(HEADERS), F.lit(False)) for c in columns)), lambda x: x))


def prepare_parts(df: DataFrame, renames: dict[str, str], multi: list[str], tables: str, variable: str, location: str) -> DataFrame:
    """Rename, keep rows of tables, expand lists, pick one side of ``&``, and name the enum of each row."""
    missing = [c for c in renames if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rows = reshape.expand_multi_rows(named_tables(df.withColumnsRenamed(renames), tables), multi)
    picked = rows.withColumns({c: reshape.select_and_value(F.col(c)) for c in multi})
    return picked.withColumn("sourceEnumName", names.enum_name(F.col(tables), F.col(variable), F.col(location)))


def enum_values(rows: DataFrame, enum: str, target_enum: str, target_value: str, value: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(values, errors): source values by target value, repeats kept; enums that map to several target enums are errors."""
    errors = rows.groupBy(enum).agg(F.count_distinct(target_enum).alias("n")).filter("n > 1")
    good = rows.join(errors, enum, "left_anti")
    return reshape.ordered_fold(good, [enum, target_enum, target_value], value, order, distinct=False), errors


def class_slots(rows: DataFrame, pair: list[str], target: str, source: str, order: str) -> DataFrame:
    """Slots of class pairs with more than one row; of repeated target slots the last counts."""
    several = rows.groupBy(*pair).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(several, pair, "left_semi").groupBy(*pair, target).agg(F.max_by(source, order).alias(source), F.count("*").alias("n"))


def allowed_pairs(rows: DataFrame, pair: list[str], pairs: dict[str, list[str]] | str) -> DataFrame:
    """Rows of the class pairs that a run takes: ``all``, or {source class: target classes}."""
    if pairs == "all":
        return rows
    listed = local_table(rows.sparkSession, [(s, t) for s, targets in pairs.items() for t in targets], ", ".join(f"{c} string" for c in pair))
    return rows.join(F.broadcast(listed), pair, "left_semi")


def overridden(slots: DataFrame, overrides: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Set slots from an override table; a null there removes the slot."""
    return slots.join(overrides.select(*keys), keys, "left_anti").select(*keys, value).unionByName(overrides.filter(F.col(value).isNotNull()).select(*keys, value))


def run(parts: DataFrame, renames: dict[str, str], multi: list[str], pair: list[str], columns: dict[str, str], pairs: dict[str, list[str]] | str = "all", overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole older mapping of a parts sheet: prepared rows, enum values with their errors, and class slots.

    ``columns`` names the roles ``tables``, ``variable``, ``location``, ``target_enum``, ``target_value``, ``value``,
    ``target``, ``source`` and ``order``.  Slots are those of the class pairs that the run takes, under the overrides.
    """
    at = columns
    rows = prepare_parts(parts, renames, multi, at["tables"], at["variable"], at["location"])
    coded = rows.filter(F.col("sourceEnumName").isNotNull() & F.col(at["target_enum"]).isNotNull())
    values, errors = enum_values(coded, "sourceEnumName", at["target_enum"], at["target_value"], at["value"], at["order"])
    slots = class_slots(allowed_pairs(rows, pair, pairs), pair, at["target"], at["source"], at["order"])
    if overrides is not None:
        slots = overridden(slots, overrides, [*pair, at["target"]], at["source"])
    return {"rows": rows, "enums": values, "enum_errors": errors, "slots": slots}
