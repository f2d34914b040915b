"""Specs as YAML documents: one for each derivation, and back."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from slotweave.functions import exprs, names
from slotweave.operators.compile import SCOPE, Specs
from slotweave.sources.files import read_named, write_named
from slotweave.sources.local import local_table, small_jobs, spread
from slotweave.sources.metadata import Schema
from slotweave.sources.tables import SHEET


#: Fixed value: the class that stands for the collection of all tables in a schema.
ROOT = "Container"
#: Spec files that a task writes.
TASK_SPECS = 1000
#: Spec files are written by PyYAML's own code; libyaml's, where it is there, reads them many times faster.
_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def spec_rows(specs: Specs) -> DataFrame:
    """One row of each derivation, with what its document holds: deriv_id, file, name, source_class, slots, enums.

    A derivation of a wide group goes by the class's name with the sheet's number, the
    group's number and its source slots.
    """
    by_order = lambda *cells: F.array_sort(F.collect_list(F.struct(*cells)))
    slots = specs.slots.groupBy("deriv_id").agg(
        by_order("ord", "target_slot", "kind", "source_slot", "expr", F.map_entries("settings").alias("settings")).alias("slots"), F.collect_list(F.when(F.col("kind") == "copy", F.col("source_slot"))).alias("copied")
    )
    bound = specs.bindings.join(specs.values, [*SCOPE, "target_enum"], "left").select("deriv_id", "target_enum", "source_enum", F.coalesce("mirror_source", F.lit(False)).alias("mirror"), F.map_entries("settings").alias("settings"), "target_value", "source_values")
    held = bound.groupBy("deriv_id", "target_enum").agg(F.min(F.struct("source_enum", "mirror", "settings")).alias("told"), F.array_sort(F.collect_set(F.when(F.col("target_value").isNotNull(), F.struct("target_value", "source_values")))).alias("values"))
    enums = held.groupBy("deriv_id").agg(by_order("target_enum", "told", "values").alias("enums"))
    sheet = F.floor(F.coalesce("ord", F.lit(0)) / SHEET)
    if specs.large:
        # only wide groups go by their number: they come first, sheet by sheet, so it is counted from the sheet's first
        firsts = specs.classes.filter("is_wide").groupBy(sheet.alias("_sheet")).agg(F.min("deriv_id").alias("_first"))
        classes = specs.classes.join(F.broadcast(firsts), F.col("is_wide") & (sheet == F.col("_sheet")), "left")
        group = F.col("deriv_id") - F.col("_first")
    else:
        classes, group = specs.classes, F.row_number().over(Window.partitionBy("is_wide", sheet).orderBy("deriv_id")) - 1
    decorated = names.decorated_name(F.col("target_class"), sheet, group, F.coalesce("copied", F.array().cast("array<string>")))
    named = classes.join(slots, "deriv_id", "left").withColumn("name", F.when(F.col("is_wide"), decorated).otherwise(F.col("target_class")))
    file = F.format_string("mapper-%010d-%s-%s.yaml", "deriv_id", names.safe_file_name(F.col("source_class")), names.safe_file_name(F.col("name")))
    return named.join(enums, "deriv_id", "left").select("deriv_id", file.alias("file"), "name", "source_class", "slots", "enums")


def _document(row: Row) -> dict[str, Any]:
    """Document of a row of ``spec_rows``; the root class names its source."""
    told = lambda entries: {e["key"]: json.loads(e["value"]) for e in entries or []}
    slots: dict[str, Any] = {}
    for s in row["slots"] or []:
        entry = {"name": s["target_slot"]}
        if s["kind"] == "copy":
            entry |= {"populated_from": s["source_slot"], **told(s["settings"])}
        else:
            entry |= {**told(s["settings"]), "expr": s["expr"] if s["kind"] == "expr" else repr(s["expr"])}
        slots[s["target_slot"]] = entry
    enums: dict[str, Any] = {}
    for e in row["enums"] or []:
        body = {"name": e["target_enum"], "populated_from": e["told"]["source_enum"], "mirror_source": bool(e["told"]["mirror"]), **told(e["told"]["settings"])}
        if values := {v["target_value"]: list(v["source_values"]) for v in e["values"]}:
            body["permissible_value_derivations"] = {k: {"populated_from": v[0]} if len(v) == 1 else {"sources": v} for k, v in values.items()}
        enums[e["target_enum"]] = body
    name, source = row["name"], row["source_class"]
    classes = {name: {"name": name, "populated_from": source, "slot_derivations": slots}, ROOT: {"name": ROOT, "slot_derivations": {name: {"populated_from": source}}}}
    return {"class_derivations": classes, "enum_derivations": enums}


def documents(specs: Specs) -> list[tuple[str, dict[str, Any]]]:
    """(file name, document) of every derivation, in order, held by the driver."""
    with small_jobs(specs.classes.sparkSession):
        return [(r["file"], _document(r)) for r in spec_rows(specs).orderBy("deriv_id").collect()]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([r["file"] for r in rows], pa.string()), pa.array([yaml.safe_dump(_document(r), sort_keys=False, allow_unicode=True) for r in rows], pa.string())], ["file", "document"])


def write_specs(specs: Specs, path: str, tasks: int = 8) -> None:
    """Write one YAML file for each derivation, from the tasks that hold them; older spec files of the folder go.

    The files appear together when all are written; a failed job leaves the folder as it was.
    """
    if specs.large:
        tasks = max(tasks, specs.classes.count() // TASK_SPECS)
    rows = spec_rows(specs).repartition(tasks, "deriv_id")
    write_named(rows.mapInArrow(_texts, "file string, document string"), path, suffix=".yaml")


def read_documents(spark: SparkSession, path: str) -> list[tuple[str, dict[str, Any]]]:
    """(file name, document) of a folder of spec files, in the order of their names."""
    return [(r["file"], yaml.load(r["document"], _LOADER)) for r in read_named(spark, path, ".yaml").orderBy("file").collect()]


def slot_rows(spark: SparkSession, docs: list[tuple[str, dict[str, Any]]]) -> DataFrame:
    """(file, source_class, target_class, target_slot, source_slot, expr) of spec documents."""
    return local_table(spark, [r[:-1] for f, d in docs for r in _slots_of(f, d)], _SLOT_ROWS)


_SLOT_ROWS = "file string, source_class string, target_class string, target_slot string, source_slot string, expr string"


def _slots_of(file: str, doc: dict[str, Any]) -> list[tuple]:
    return [
        (file, c.get("populated_from"), t, s, (e or {}).get("populated_from"), (e or {}).get("expr"), place)
        for t, c in (doc.get("class_derivations") or {}).items() for place, (s, e) in enumerate((c.get("slot_derivations") or {}).items()) if t != ROOT
    ]


def _in_batches(made: Callable[[dict[str, Any]], list[tuple]], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow``: the rows that ``made`` makes of each row."""
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if rows := [x for r in batch.to_pylist() for x in made(r)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    return run


def stored_slot_rows(spark: SparkSession, path: str) -> DataFrame:
    """``slot_rows`` of a folder's spec files, with each slot's ``place`` in its class: read and parsed by tasks, whatever their number."""
    schema = f"{_SLOT_ROWS}, place int"
    return read_named(spark, path, ".yaml").mapInArrow(_in_batches(lambda r: _slots_of(r["file"], yaml.load(r["document"], _LOADER) or {}), schema), schema)


def read_specs(spark: SparkSession, docs: list[tuple[str, dict[str, Any]]], source: Schema) -> Specs:
    """Specs of documents, to validate or run them: derivations are numbered by file.

    Documents name enum derivations, not the rows' scopes; so each document is a
    scope of its own.  Slots get their ranges from the source schema; a range
    without a derivation is mirrored.
    """
    classes, slots, enums, values, bindings = [], [], [], [], []
    shown = lambda d, *known: {k: json.dumps(v) for k, v in d.items() if k not in known}
    for n, (_, doc) in enumerate(sorted(docs, key=lambda x: x[0])):
        derived = doc.get("enum_derivations") or {}
        for name, body in (doc.get("class_derivations") or {}).items():
            if name == ROOT:
                continue
            cls, target = body.get("populated_from"), name.split("[")[0]
            scope = (cls, target, str(n), "")
            classes.append((n, cls, target, "[" in name, n))
            for at, (slot, entry) in enumerate((body.get("slot_derivations") or {}).items()):
                entry = entry or {}
                kind = "copy" if entry.get("populated_from") is not None else "expr"
                slots.append((n, cls, target, slot, kind, entry.get("populated_from"), entry.get("expr"), list(shown(entry, "name", "populated_from", "expr").items()), at))
                for used in source.enums(cls, entry["populated_from"]) if kind == "copy" and cls in source.classes() and entry["populated_from"] in source.slots(cls) else []:
                    own = [(e, d) for e, d in derived.items() if (d or {}).get("populated_from") == used] or [(f"{used}[=mirrored=]", {"mirror_source": True})]
                    for e, d in own:
                        mirror = bool(d.get("mirror_source"))
                        bindings.append((n, slot, used, *scope, e, mirror, list(shown(d, "name", "populated_from", "permissible_value_derivations", "mirror_source").items()), source.values(used) if mirror else None))
            for e, d in derived.items():
                enums.append((*scope, e, d.get("populated_from"), [], bool(d.get("mirror_source")), n))
                for value, v in (d.get("permissible_value_derivations") or {}).items():
                    v = v or {}
                    values.append((*scope, e, value, v.get("sources") or ([v["populated_from"]] if v.get("populated_from") is not None else [])))
    scoped = ", ".join(f"{c} string" for c in SCOPE)
    return Specs(
        local_table(spark, classes, "deriv_id int, source_class string, target_class string, is_wide boolean, ord long"),
        local_table(spark, slots, "deriv_id int, source_class string, target_class string, target_slot string, kind string, source_slot string, expr string, settings map<string,string>, ord long"),
        local_table(spark, enums, f"{scoped}, target_enum string, source_enum string, settings map<string,string>, mirror_source boolean, _ord long"),
        local_table(spark, values, f"{scoped}, target_enum string, target_value string, source_values array<string>"),
        local_table(spark, bindings, f"deriv_id int, target_slot string, source_enum string, {scoped}, target_enum string, mirror_source boolean, settings map<string,string>, mirrored array<string>"),
        local_table(spark, [], "severity string, code string, ord long, message string"),
        large=source.listed is not None,
        listed=source.listed,
    )


def source_slots(spark: SparkSession, specs: Specs) -> DataFrame:
    """(deriv_id, source_class, target_class, target_slot, source_slot): every source slot that a derivation reads, copied or in an expression."""
    schema = "deriv_id int, source_class string, target_class string, target_slot string, source_slot string"
    told = specs.slots.filter("kind <> 'const'").select("deriv_id", "source_class", "target_class", "target_slot", "kind", "source_slot", "expr")
    if specs.large:
        return spread(told).mapInArrow(_in_batches(_slots_read, schema), schema)
    with small_jobs(spark):
        return local_table(spark, [x for r in told.collect() for x in _slots_read(r.asDict())], schema)


def _slots_read(slot: dict[str, Any]) -> list[tuple]:
    found = [slot["source_slot"]] if slot["kind"] == "copy" else exprs.slots_in(slot["expr"]) if slot["expr"] else []
    return [(slot["deriv_id"], slot["source_class"], slot["target_class"], slot["target_slot"], s) for s in found]
