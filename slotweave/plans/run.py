"""A run from files: options, schemas and sheets in; spec files and reports out."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from slotweave.functions import selectors
from slotweave.operators import compile as compiler
from slotweave.operators import prepare, reshape, validate
from slotweave.sources import specs as stored
from slotweave.sources import tables
from slotweave.sources.metadata import Schema

#: Options that a run knows; others are refused by name.
OPTIONS = ("source_schema_file", "target_schema_file", "maps_files", "wide_files", "enums_files", "selectors", "source_slot_format", "target_slot_format", "ontology_pattern", "output_dir", "report_dir", "strict")


@dataclass(frozen=True)
class Run:
    specs: compiler.Specs
    source: Schema
    target: Schema
    reports: dict[str, DataFrame]


def run(spark: SparkSession, options: dict[str, Any]) -> Run:
    """Compile the sheets that the options name, write specs to ``output_dir`` and the reports that have rows to ``report_dir``.

    Sheets of one kind are read in the order of their names.  ``options`` come
    from :func:`slotweave.sources.tables.read_options`.
    """
    if unknown := sorted(set(options) - set(OPTIONS)):
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    chosen = selectors.parse_run(options.get("selectors"))
    source, target = (Schema.read(spark, options[k]) for k in ("source_schema_file", "target_schema_file"))
    ops = options.get("source_slot_format"), options.get("target_slot_format")

    def sheets(kind: str, prepared: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        paths = options.get(f"{kind}_files") or []
        paths = sorted([paths] if isinstance(paths, str) else paths, key=os.path.basename)
        # each sheet by itself: whether it has a mark for complete rows or tags is its own matter
        return reshape.union_all([prepared(tables.read_rows(spark, p, k)) for k, p in enumerate(paths)]) if paths else None

    def wide(rows: DataFrame) -> DataFrame:
        return prepare.prepare_wide_rows(rows, chosen) if "wideRowNumber" in rows.columns else prepare.prepare_wide(rows, chosen, ops[0])

    specs = compiler.compile_mapping(
        spark, source, target, sheets("maps", lambda x: prepare.prepare_maps(x, chosen, *ops)), sheets("wide", wide), sheets("enums", lambda x: prepare.prepare_enums(x, chosen, *ops)),
        ops[0], options.get("ontology_pattern"), bool(options.get("strict")),
    )
    reports = {**validate.validate(specs, source, target), **validate.check(specs, source, target)}
    if options.get("output_dir"):
        stored.write_specs(specs, options["output_dir"])
    if options.get("report_dir"):
        for name, report in reports.items():
            tables.write_report(report, f"{options['report_dir']}/{name}.csv")
    return Run(specs, source, target, reports)
