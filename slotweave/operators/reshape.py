"""Row shaping: padding, gates, multi-value expansion, unpivots, ordered folds, first rows, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.functions import names
from slotweave.functions.automaton import longest_of_many

#: So many names are looked for one by one, in generated code.
MOST_TESTS = 24


def ordered_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """Named columns first, the others after them in their order."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *(c for c in df.columns if c not in head))


def pad(df: DataFrame, names: list[str], fill: str | None = None, keep_others: bool = False) -> DataFrame:
    """Exactly these columns (others on demand); missing ones are ``fill``, and where that is text all are text without nulls."""
    def column(n: str) -> Column:
        c = F.col(f"`{n}`") if n in df.columns else F.lit(fill)
        return (c if fill is None else F.coalesce(c.cast("string"), F.lit(fill))).alias(n)

    others = [c for c in df.columns if c not in names] if keep_others else []
    return df.select(*map(column, names), *(F.col(f"`{c}`") for c in others))


def drop_blank_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without rows whose cells are all null or white space."""
    return df.filter(F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns)).isNotNull())


def complete_gate(df: DataFrame, column: str = "Complete") -> DataFrame:
    """Rows marked complete (1 or TRUE), without the mark; all rows where there is no such column."""
    if column not in df.columns:
        return df
    return df.filter(F.upper(F.trim(F.col(column).cast("string"))).isin("1", "1.0", "TRUE")).drop(column)


def expand_multi_rows(df: DataFrame, columns: list[str], separator: str = ";") -> DataFrame:
    """Rows with lists in some columns become one row for each place; shorter lists repeat their last value.

    Rows without a separator stay as they are; in others null counts as empty.
    ``_place`` numbers the rows made from one.
    """
    splits = F.array(*(F.split(F.coalesce(F.col(c), F.lit("")), f"\\{separator}") for c in columns))
    listed = F.exists(F.array(*(F.coalesce(F.contains(F.col(c), F.lit(separator)), F.lit(False)) for c in columns)), lambda x: x)
    most = F.array_max(F.transform("_lists", F.size))
    rows = df.withColumn("_listed", listed).withColumn("_lists", splits).withColumn("_place", F.explode(F.sequence(F.lit(0), F.when(F.col("_listed"), most - 1).otherwise(0))))

    def value(k: int, c: str) -> Column:
        own = F.get("_lists", k)
        return F.when(F.col("_listed"), F.trim(F.get(own, F.least(F.col("_place"), F.size(own) - 1)))).otherwise(F.col(c)).alias(c)

    return rows.select(*(value(columns.index(c), c) if c in columns else F.col(c) for c in df.columns), "_place")


def select_and_value(c: Column) -> Column:
    """``(A & B)`` -> ``A``; other values unchanged."""
    return F.when(F.contains(c, F.lit("&")), F.trim(F.regexp_replace(F.get(F.split(c, "&"), 0), r"^[\s(]+|[\s)]+$", ""))).otherwise(c)


def unpivot_cells(df: DataFrame, ids: list[str], suffixes: tuple[str, ...] = ("_value", "_expr")) -> DataFrame:
    """One row for each wide cell that isn't null: ids, slot, kind (value, expr), cell, rank (1 value, 2 expr) and pos (column place)."""
    cells = [(c, s) for s in suffixes for c in df.columns if c.endswith(s)]
    if not cells:
        return df.select(*ids, *(F.lit(None).cast(t).alias(n) for n, t in (("slot", "string"), ("kind", "string"), ("cell", "string"), ("rank", "int"), ("pos", "int")))).limit(0)
    made = F.array(*(F.struct(F.lit(c[: -len(s)]).alias("slot"), F.lit(s[1:]).alias("kind"), F.col(f"`{c}`").cast("string").alias("cell"), F.lit(suffixes.index(s) + 1).alias("rank"), F.lit(df.columns.index(c)).alias("pos")) for c, s in cells))
    return df.select(*ids, F.inline(made)).filter("cell IS NOT NULL")


def json_cells(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Overwrite columns with the keys that a JSON object in ``column`` has, whatever characters the keys are of."""
    parsed = F.from_json(F.col(column).cast("string"), "map<string,string>")
    held = {n: F.coalesce(F.try_element_at(parsed, F.lit(n)), F.col(f"`{n}`").cast("string") if n in df.columns else F.lit(None).cast("string")) for n in keys}
    return df.withColumns(held)


def wide_to_long(df: DataFrame, groups: list[dict[str, Column]]) -> DataFrame:
    """One row for each source row and group, in one scan; slots that a group lacks are null."""
    slots = list(dict.fromkeys(s for g in groups for s in g))
    structs = [F.struct(*(g.get(s, F.lit(None)).alias(s) for s in slots)) for g in groups]
    return df.select(*(structs[0].getField(s).alias(s) for s in slots)) if len(structs) == 1 else df.select(F.inline(F.array(*structs)))


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each group by a total order; rows with a null key go."""
    w = Window.partitionBy(*keys).orderBy(*order)
    known = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return known.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def ordered_fold(df: DataFrame, keys: list[str], value: str, order: str, distinct: bool = True) -> DataFrame:
    """(keys, values): the values of each group in order, once each unless ``distinct`` is off."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    values = F.transform(pairs, lambda x: x["v"])
    return df.groupBy(*keys).agg((F.array_distinct(values) if distinct else values).alias("values"))


def canonical_case(df: DataFrame, column: str, known: DataFrame, name: str) -> DataFrame:
    """Replace values by the known spelling that differs in case alone (first by ``_ord``); others stay. ``known`` is a metadata table."""
    lowered = known.groupBy(F.lower(name).alias("_low")).agg(F.min_by(name, "_ord").alias("_name"))
    return df.join(F.broadcast(lowered), F.lower(column) == F.col("_low"), "left").withColumn(column, F.coalesce("_name", column)).drop("_low", "_name")


def class_of(df: DataFrame, column: str, known: DataFrame | None, name: str) -> DataFrame:
    """Replace cells that name a class, with what may stand in brackets behind it, by the class as a schema spells it; without a schema by the bare name."""
    bare = df.withColumn(column, F.trim(names.cut_class_name(F.col(column))))
    return bare if known is None else canonical_case(bare, column, known, name)


def longest_contained(df: DataFrame, column: str, names: list[str], out: str) -> DataFrame:
    """Longest of the names that a value contains, case aside (first of equal lengths), null if none; many names become one automaton."""
    if len(names) > MOST_TESTS:
        return longest_of_many(df, column, names, out)
    ranked = sorted(names, key=lambda n: -len(n))
    hits = [F.when(F.contains(F.lower(column), F.lit(n.lower())), F.lit(n)) for n in ranked]
    return df.withColumn(out, F.coalesce(*hits) if hits else F.lit(None).cast("string"))


def equal_ignoring_case(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows whose columns have these values, case aside; null equals nothing."""
    for c, v in wanted.items():
        df = df.filter(F.lower(F.col(c)) == F.lower(F.lit(v)))
    return df


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that aren't null, in order."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def common_values(df: DataFrame, keys: list[str], value: str, one: Column, other: Column) -> DataFrame:
    """(keys, values): of each group the values, in order, that rows of both kinds have; groups without any are left out."""
    sets = df.groupBy(*keys).agg(F.collect_set(F.when(one, F.col(value))).alias("_a"), F.collect_set(F.when(other, F.col(value))).alias("_b"))
    return sets.select(*keys, F.array_sort(F.array_intersect("_a", "_b")).alias("values")).filter(F.size("values") > 0)


def sorted_ignoring_case(values: Column) -> Column:
    """An array of texts in order, case aside; texts that differ in case alone by their own order."""
    keyed = F.transform(values, lambda v: F.struct(F.lower(v).alias("low"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def with_constants(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row (checked) on every row; columns of the same name are replaced."""
    held = row.limit(2).collect()
    if len(held) != 1:
        raise ValueError(f"needs one row, has {'none' if not held else 'more'}")
    return df.withColumns({f.name: F.lit(held[0][f.name]).cast(f.dataType) for f in row.schema})


def with_separators(parts: list[DataFrame]) -> list[DataFrame]:
    """Reports for one sheet: the parts that have rows, with a row of nulls between them; one part alone stays as it is."""
    full = [p for p in parts if not p.isEmpty()]
    if len(full) < 2:
        return full
    blank = [F.lit(None).cast(t).alias(c) for c, t in full[0].dtypes]
    row = full[0].sparkSession.range(1).select(*blank)
    return [x for k, p in enumerate(full) for x in ([row, p] if k else [p])]


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a part lacks are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
