"""Schemas: YAML descriptions of classes, slots and enums as metadata tables.

A class's slot is the global slot refined by the class's ``slot_usage``.  A
slot's ranges are the non-empty members of ``any_of``, else ``range``, else the
schema's ``default_range``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.functions import names
from slotweave.sources.local import few, kept, local_table

_TYPES = {"integer": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampType(), "decimal": T.DecimalType(38, 10)}


@dataclass(frozen=True)
class Schema:
    """A parsed schema, with lookups for the driver and tables for joins.

    ``listed`` (enum, pos, value) has the permissible values of enums that are too
    large for the driver; ``raw`` has these enums without values.
    """

    name: str
    raw: dict[str, Any]
    listed: DataFrame | None = None

    @classmethod
    def parse(cls, text: str) -> Schema:
        raw = yaml.safe_load(text) or {}
        return cls(str(raw.get("name", "")), raw)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Schema:
        return cls.parse(spark.read.text(path, wholetext=True).first()[0])

    def with_values(self, enum: str, values: DataFrame) -> Schema:
        """The schema with an enum of a table's values (pos, value), each once at its first pos; large ones stay a table."""
        once = values.filter("value IS NOT NULL").groupBy("value").agg(F.min("pos").cast("long").alias("pos"))
        found = few(once)
        own = {r["value"]: {} for r in sorted(found or [], key=lambda r: r["pos"])}
        raw = {**self.raw, "enums": {**(self.raw.get("enums") or {}), enum: {"permissible_values": own}}}
        if found is not None:
            return Schema(self.name, raw, self.listed)
        table = kept(once.select(F.lit(enum).alias("enum"), "pos", "value"))
        return Schema(self.name, raw, table if self.listed is None else self.listed.unionByName(table))

    def dump(self) -> str:
        return yaml.safe_dump(self.raw, sort_keys=False)

    def classes(self) -> list[str]:
        """Classes but the tree root, which stands for the collection of tables."""
        return [c for c, d in (self.raw.get("classes") or {}).items() if not (d or {}).get("tree_root")]

    def slots(self, cls: str) -> dict[str, dict]:
        """Slots of a class as they hold there, in order."""
        body = (self.raw.get("classes") or {}).get(cls) or {}
        usage, common = body.get("slot_usage") or {}, self.raw.get("slots") or {}
        out = {s: {**(common.get(s) or {}), **(usage.get(s) or {})} for s in body.get("slots") or []}
        out |= {s: dict(d or {}) for s, d in (body.get("attributes") or {}).items()}
        return out

    def slot(self, cls: str, slot: str) -> dict:
        try:
            return self.slots(cls)[slot]
        except KeyError:
            raise KeyError(f"class {cls!r} has no slot {slot!r}") from None

    def ranges(self, cls: str, slot: str) -> list[str]:
        d = self.slot(cls, slot)
        union = [x.get("range") for x in d.get("any_of") or [] if x.get("range")]
        return list(dict.fromkeys(str(r) for r in union or [d.get("range") or self.raw.get("default_range") or "string"]))

    def kind(self, name: str) -> str:
        return "enum" if name in (self.raw.get("enums") or {}) else "class" if name in (self.raw.get("classes") or {}) else "type"

    def enums(self, cls: str, slot: str) -> list[str]:
        return [r for r in self.ranges(cls, slot) if self.kind(r) == "enum"]

    def values(self, enum: str) -> list[str]:
        return [str(v) for v in ((self.raw.get("enums") or {}).get(enum) or {}).get("permissible_values") or {}]

    def type_of(self, cls: str, slot: str) -> T.DataType:
        """Spark type of a slot; a union of ranges is text, a multivalued slot an array."""
        kinds = {_TYPES.get(r, T.StringType()) for r in self.ranges(cls, slot)}
        one = kinds.pop() if len(kinds) == 1 else T.StringType()
        return T.ArrayType(one) if self.slot(cls, slot).get("multivalued") else one

    def struct(self, cls: str) -> T.StructType:
        return T.StructType([T.StructField(s, self.type_of(cls, s), not d.get("required", False)) for s, d in self.slots(cls).items()])

    # --- tables -----------------------------------------------------------------------------------

    def class_table(self, spark: SparkSession) -> DataFrame:
        return local_table(spark, [(k, c) for k, c in enumerate(self.classes())], "_ord int, class string")

    def slot_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (c, s, k, bool(d.get("multivalued")), bool(d.get("required")), bool(d.get("identifier")), d.get("pattern"), None if d.get("minimum_value") is None else float(d["minimum_value"]), None if d.get("maximum_value") is None else float(d["maximum_value"]))
            for c in self.classes() for k, (s, d) in enumerate(self.slots(c).items())
        ]
        return local_table(spark, rows, "class string, slot string, pos int, multivalued boolean, required boolean, identifier boolean, pattern string, minimum double, maximum double")

    def range_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, s, k, r, self.kind(r)) for c in self.classes() for s in self.slots(c) for k, r in enumerate(self.ranges(c, s))]
        return local_table(spark, rows, "class string, slot string, pos int, range string, kind string")

    def held_values(self, spark: SparkSession) -> DataFrame:
        """(enum, pos, value) of the enums whose values the driver holds."""
        rows = [(e, k, v) for e in self.raw.get("enums") or {} for k, v in enumerate(self.values(e))]
        return local_table(spark, rows, "enum string, pos long, value string")

    def value_table(self, spark: SparkSession, ontology: str | None = None) -> DataFrame:
        """(enum, pos, value, stripped): permissible values, and what is left of them without ontology identifiers."""
        table = self.held_values(spark)
        if self.listed is not None:
            table = table.unionByName(self.listed)
        return table.withColumn("stripped", names.strip_ontology(table["value"], ontology))
