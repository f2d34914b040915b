"""Execution of specs on data: one lazy plan, one scan of each source table for each target class.

All derivations of a class pair share one read of the source: what they have in
common is computed once for each source row, what differs is taken by position.
Coded values go through value lists of any size (:mod:`slotweave.operators.lists`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.functions import exprs
from slotweave.functions.names import EXTRA_PREFIX
from slotweave.operators import lists
from slotweave.operators.losses import Losses
from slotweave.operators.compile import SCOPE, Specs
from slotweave.sources.local import kept, local_table, small_jobs
from slotweave.sources.metadata import Schema


#: Cells of a fan-out that are computed in one step: keeps each generated method at a size that is compiled to machine code.
STEP_CELLS = 96


def translate(value: Column, mapping: dict[str, str], unmapped: str = "null") -> Column:
    """Values through a map literal; what it lacks becomes null, stays (``keep``), or fails (``error``)."""
    text = value.cast("string")
    return lists.resolved(F.try_element_at(lists.literal_map(mapping), text) if mapping else F.lit(None).cast("string"), text, unmapped)


@dataclass(frozen=True)
class Listed:
    """A value list that stays a table (source_value, target_value); lists of one number are the same."""

    number: int
    values: DataFrame = field(compare=False, repr=False)

    def held(self) -> dict[str, str]:
        return {r["source_value"]: r["target_value"] for r in self.values.collect()}


Values = dict[str, str] | Listed


def _same_list(values: Values):
    return values if isinstance(values, Listed) else frozenset(values.items())


def _value_tables(specs: Specs) -> dict[tuple, tuple[Values, bool]]:
    """``_value_maps`` of large specs: lists that are no literals stay a table, each once however many slots it holds for."""
    spark, own = specs.slots.sparkSession, [*SCOPE, "target_enum"]
    bound: dict[tuple, list[tuple]] = {}
    # as many as the plan has coded slots; their values are not collected
    for r in specs.bindings.select("deriv_id", "target_slot", "source_enum", "mirror_source", *own).collect():
        bound.setdefault((r[0], r[1]), []).append(tuple(r[2:]))
    keys = {at: tuple(sorted(set(b), key=repr)) for at, b in bound.items()}
    numbers = {key: n for n, key in enumerate(dict.fromkeys(keys.values()))}
    mirrored = {key: all(b[1] for b in key) for key in numbers}
    told = local_table(spark, [(n, *b, bool(b[1]) and not mirrored[key]) for key, n in numbers.items() for b in key], f"list int, source_enum string, mirror_source boolean, {', '.join(f'{c} string' for c in own)}, itself boolean")
    mapped = told.join(specs.values, own).select("list", F.explode("source_values").alias("source_value"), "target_value", F.lit(0).alias("rank"))
    parts = [specs.bindings.filter("mirrored IS NOT NULL").groupBy("source_enum").agg(F.first("mirrored").alias("m")).select("source_enum", F.explode("m").alias("value"))]
    parts += [] if specs.listed is None else [specs.listed.select(F.col("enum").alias("source_enum"), "value")]
    for part in parts:
        mapped = mapped.unionByName(told.filter("itself").select("list", "source_enum").distinct().join(part, "source_enum").select("list", F.col("value").alias("source_value"), F.col("value").alias("target_value"), F.lit(1).alias("rank")))
    values = kept(mapped.groupBy("list", "source_value").agg(F.min(F.struct("rank", "target_value"))["target_value"].alias("target_value")))
    sizes = {r[0]: r[1] for r in values.groupBy("list").agg(F.sum(F.length("source_value") + F.coalesce(F.length("target_value"), F.lit(0)) + lists.LITERAL_ENTRY)).collect()}
    literal = {n: {} for n in numbers.values() if sizes.get(n, 0) <= lists.LITERAL_BYTES}
    if sizes:
        for r in values.filter(F.col("list").isin(list(literal))).collect():
            literal[r["list"]][r["source_value"]] = r["target_value"]
    table = lambda n: Listed(n, values.filter(F.col("list") == n).select("source_value", "target_value"))
    found = {n: literal[n] if n in literal else table(n) for n in numbers.values()}
    return {at: (found[numbers[key]], mirrored[key]) for at, key in keys.items()}


def _value_maps(specs: Specs) -> dict[tuple, tuple[dict[str, str], bool]]:
    """(deriv, slot) -> (source value -> target value, mirror). Specs hold as many rows as the mapping sheets.

    Of a slot with several enum ranges each one's derivation maps its values; the
    values of a range that is mirrored stand for themselves, unless another one maps them.
    """
    values = specs.bindings.join(specs.values, [*SCOPE, "target_enum"], "left").select("deriv_id", "target_slot", "source_enum", "mirror_source", "mirrored", "target_value", "source_values")
    mapped: dict[tuple, dict[str, str]] = {}
    kept: dict[tuple, dict[str, tuple[bool, list[str]]]] = {}
    for r in values.collect():
        key = (r["deriv_id"], r["target_slot"])
        kept.setdefault(key, {})[r["source_enum"]] = (bool(r["mirror_source"]), list(r["mirrored"] or []))
        held = mapped.setdefault(key, {})
        for v in r["source_values"] or []:
            held[v] = r["target_value"]
    out = {}
    for key, enums in kept.items():
        mirrors = [m for m, _ in enums.values()]
        own = {v: v for m, values in enums.values() if m and not all(mirrors) for v in values}
        out[key] = (own | mapped[key], all(mirrors))
    return out


@dataclass
class _Source:
    """Rows of a source class, and the columns that large value lists have added to them."""

    data: DataFrame
    schema: T.StructType
    found: dict[tuple, str] = field(default_factory=dict)
    #: (target slot, source slot, list) -> (value, what it becomes) of coded slots whose other values become null
    coded: dict[tuple, tuple[Column, Column]] = field(default_factory=dict)

    def listed(self, slot: str, mapping: Values) -> Column:
        """A slot's values through a list that is too large for a literal: a join, once for each slot and list."""
        key = (slot, _same_list(mapping))
        if key not in self.found:
            out = f"_list{len(self.found)}"
            while out in self.data.columns:
                out = f"_{out}"
            values = mapping.values if isinstance(mapping, Listed) else local_table(self.data.sparkSession, list(mapping.items()), "source_value string, target_value string")
            self.data, self.found[key] = lists.looked_up(self.data, F.col(f"`{slot}`").cast("string"), values, out), out
        return F.col(self.found[key])

    def _told(self, slot, mapping: Values, rule: str, value: Column, hit: Column) -> Column:
        if rule == "null":
            self.coded[slot["target_slot"], slot["source_slot"], _same_list(mapping)] = (value.cast("string"), hit)
        return hit

    def column(self, slot, held: tuple[Values, bool] | None, kind: T.DataType, on_multi: str) -> Column:
        if slot["kind"] == "const":
            return F.lit(slot["expr"]).cast(kind)
        if slot["kind"] == "expr":
            return exprs.slot_expression(slot["expr"], self.schema).try_cast(kind) if slot["expr"] else F.lit(None).cast(kind)
        name = slot["source_slot"]
        c, many = F.col(f"`{name}`"), isinstance(self.schema[name].dataType, T.ArrayType)
        rule = "keep" if held and held[1] else "null"
        if held and not many and (isinstance(held[0], Listed) or not lists.fits_literal(held[0])):
            hit = lists.resolved(self.listed(name, held[0]), c.cast("string"), rule)
            return self._told(slot, held[0], rule, c, hit).try_cast(kind)
        # an array's values go through a literal, whatever the list's size
        if held and isinstance(held[0], Listed):
            held = (held[0].held(), held[1])
        through = (lambda x: translate(x, held[0], rule)) if held else (lambda x: x)
        if not many:
            return (self._told(slot, held[0], rule, c, through(c)) if held else c).try_cast(kind)
        out = F.transform(c, through)
        if isinstance(kind, T.ArrayType):
            return out.cast(kind)
        if on_multi == "error":
            return F.when(F.size(c) > 1, F.raise_error(F.lit(f"several values for {slot['target_slot']}"))).otherwise(F.get(out, 0)).cast(kind)
        return F.get(out, 0).cast(kind)


def _bound(rows: DataFrame, columns: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with a struct of these columns, computed once for each row: a plain projection would be computed again for each row that a later generator makes."""
    return rows.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias(name))


def fan_out(rows: DataFrame, names: list[str], shared: dict[str, Column], constant: dict[str, list[Column]], varying: dict[str, list[Column]], times: int) -> DataFrame:
    """``times`` rows of each row: slots that all of them have, slots with a constant each, and slots with a cell each.

    The shared slots and one array of cells for each varying slot are computed once
    for each source row, ``STEP_CELLS`` cells to a step; the rows made then take
    their cells by position.  The scan is read once.
    """
    mark = "_"
    while any(c.startswith(f"{mark}step") or c == f"{mark}place" for c in rows.columns):
        mark += "_"
    place, held = F.col(f"{mark}place"), {}
    per_step = max(1, STEP_CELLS // times)
    arrays = {n: F.array(*cells) for n, cells in varying.items()}
    parts = [shared, *({n: arrays[n] for n in list(arrays)[k : k + per_step]} for k in range(0, len(arrays), per_step))]
    for k, columns in enumerate(parts):
        if columns:
            rows = _bound(rows, columns, f"{mark}step{k}")
            held |= {n: F.col(f"{mark}step{k}")[n] if k == 0 else F.get(F.col(f"{mark}step{k}")[n], place) for n in columns}
    held |= {n: F.get(F.array(*cells), place) for n, cells in constant.items()}
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(f"{mark}place")).select(*(held[n].alias(n) for n in names))


def execute(specs: Specs, tables: dict[str, DataFrame], target: Schema, on_multi: str = "first", keep_extra: bool = False, losses: Losses | None = None) -> dict[str, DataFrame]:
    """{target class: rows}. Streaming tables work too: the plan has no state.

    ``losses`` is told, while the rows are written, what mapping turns into null.
    """
    groups: dict[tuple[str, str], dict[int, list]] = {}
    if not specs.read and specs.large:
        specs.read.update(maps=_value_tables(specs), slots=specs.slots.orderBy("deriv_id", "ord").collect())
    elif not specs.read:
        with small_jobs(specs.slots.sparkSession):
            specs.read.update(maps=_value_maps(specs), slots=specs.slots.orderBy("deriv_id", "ord").collect())
    maps = specs.read["maps"]
    for r in specs.read["slots"]:
        groups.setdefault((r["source_class"], r["target_class"]), {}).setdefault(r["deriv_id"], []).append(r)
    out: dict[str, DataFrame] = {}
    for (source_class, target_class), derivations in groups.items():
        source = _Source(tables[source_class], tables[source_class].schema)
        known = target.slots(target_class) if target_class in target.classes() else {}
        names = list(dict.fromkeys(r["target_slot"] for d in derivations.values() for r in d))
        names = [n for n in names if keep_extra or not n.startswith(EXTRA_PREFIX)]
        kinds = {n: target.type_of(target_class, n) if n in known else T.StringType() for n in names}
        cells = {d: {r["target_slot"]: r for r in slots} for d, slots in derivations.items()}

        def told(deriv: int, name: str):
            """What makes a cell: equal where the cell is."""
            r = cells[deriv].get(name)  # noqa: B023
            return r and (r["kind"], r["source_slot"], r["expr"], maps.get((deriv, name)) if r["kind"] == "copy" else None)

        def column(deriv: int, name: str) -> Column:
            r = cells[deriv].get(name)  # noqa: B023
            return F.lit(None).cast(kinds[name]) if r is None else source.column(r, maps.get((deriv, name)), kinds[name], on_multi)  # noqa: B023

        if losses is not None:
            read = {x for r in (r for d in derivations.values() for r in d) for x in ([r["source_slot"]] if r["kind"] == "copy" else exprs.slots_in(r["expr"], bare=True) if r["expr"] and r["kind"] == "expr" else [])}
            # observed rows are not pruned below, so only what is read goes in
            source.data = source.data.select(*(F.col(f"`{c}`") for c in source.data.columns if c in read))
        first, *others = derivations
        same = [n for n in names if all(told(d, n) == told(first, n) for d in others)]
        shared = {n: column(first, n) for n in same}
        by_deriv = {n: [column(d, n) for d in derivations] for n in names if n not in shared}
        if losses is not None:
            source.data = losses.watched(source.data, source_class, target_class, source.coded)
        if len(same) == len(names) and not others:
            rows = source.data.select(*(c.alias(n) for n, c in shared.items()))
        else:
            rest = [n for n in names if n not in shared]
            plain = [n for n in rest if all((t := told(d, n)) is None or t[0] == "const" for d in derivations)]
            constant, varying = ({n: c for n, c in by_deriv.items() if (n in plain) is wanted} for wanted in (True, False))
            rows = fan_out(source.data, names, shared, constant, varying, len(derivations))
        if losses is not None:
            rows = losses.required(rows, source_class, target_class, [n for n in names if known.get(n, {}).get("required")])
        out[target_class] = out[target_class].unionByName(rows, allowMissingColumns=True) if target_class in out else rows
    return out


def drop_extra(rows: DataFrame) -> DataFrame:
    return rows.drop(*(c for c in rows.columns if c.startswith(EXTRA_PREFIX)))
