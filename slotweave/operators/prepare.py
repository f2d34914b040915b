"""Preparation of mapping rows: strip, blank rows, completeness gate, selectors, column sets, slot formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.functions import names, selectors
from slotweave.operators import reshape
from slotweave.sources.tables import strip_cells

#: The columns of prepared rows, in this order.
MAPS = ["sourceClass", "sourceSlot", "sourceValue", "targetClass", "targetSlot", "targetValue", "targetExpr", "customData", "enumDerivationSettings", "slotDerivationSettings"]
ENUMS = ["sourceClass", "sourceSlot", "sourceEnum", "sourceValue", "targetClass", "targetSlot", "targetEnum", "targetValue", "enumDerivationSettings", "slotDerivationSettings"]
WIDE = ["sourceClass", "sourceSlot", "sourceValue", "targetClass", "targetSlot", "targetValue", "wideGroup", "wideOtherSlots", "enumDerivationSettings", "slotDerivationSettings"]


def _shared(rows: DataFrame, run: selectors.RunSelectors | None) -> DataFrame:
    rows = strip_cells(rows)
    rows = reshape.drop_blank_rows(rows, [c for c in rows.columns if c != "_ord"])
    return selectors.apply_selectors(reshape.complete_gate(rows), run or selectors.RunSelectors(), drop=True)


def _formatted(rows: DataFrame, source_ops: list | None, target_ops: list | None) -> DataFrame:
    return rows.withColumns({"sourceSlot": names.format_slot(F.col("sourceSlot"), source_ops), "targetSlot": names.format_slot(F.col("targetSlot"), target_ops)})


def prepare_maps(rows: DataFrame, run: selectors.RunSelectors | None = None, source_ops: list | None = None, target_ops: list | None = None) -> DataFrame:
    return _formatted(reshape.pad(_shared(rows, run), [*MAPS, "_ord"]).withColumn("_ord", F.col("_ord").cast("long")), source_ops, target_ops)


def prepare_enums(rows: DataFrame, run: selectors.RunSelectors | None = None, source_ops: list | None = None, target_ops: list | None = None) -> DataFrame:
    padded = reshape.pad(_shared(rows, run), ENUMS, fill="", keep_others=True)
    return _formatted(padded.select(*ENUMS, F.col("_ord").cast("long").alias("_ord")), source_ops, target_ops)


def prepare_wide(rows: DataFrame, run: selectors.RunSelectors | None = None, source_ops: list | None = None) -> DataFrame:
    """Wide rows keep their value and expression columns; rows without slot and group get a group of their own."""
    shared = _shared(rows, run)
    missing = {c: F.lit(None).cast("string") for c in WIDE if c not in shared.columns}
    padded = shared.withColumns(missing).withColumns({c: F.coalesce(c, F.lit("")) for c in ("sourceSlot", "wideGroup")})
    slot = names.format_slot(F.col("sourceSlot"), source_ops)
    alone = (F.col("sourceSlot") == "") & (F.col("wideGroup") == "")
    return padded.withColumn("wideGroup", F.when(alone, F.concat(F.lit("__auto_"), F.col("_ord").cast("string"))).otherwise(F.col("wideGroup"))).withColumn("sourceSlot", slot)


def prepare_wide_rows(rows: DataFrame, run: selectors.RunSelectors | None = None) -> DataFrame:
    """Wide rows of one slot each, under a ``wideRowNumber`` (0 where there is none)."""
    shared = _shared(rows, run)
    if "wideRowNumber" not in shared.columns:
        shared = shared.withColumn("wideRowNumber", F.lit("0"))
    return reshape.pad(shared, [*MAPS, "wideRowNumber", "_ord"]).withColumn("_ord", F.col("_ord").cast("long"))
