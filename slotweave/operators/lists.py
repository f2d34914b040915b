"""Coded values through value lists of any size.

How a list meets the data follows its measured bytes:

* up to ``LITERAL_BYTES`` it is a map literal in the plan;
* up to ``BROADCAST_BYTES`` it is broadcast, and rows stay where they are;
* beyond, the data's distinct values, counted in one aggregation with partial
  sums, meet the list.  Both sides have each value once, so no value is hot.  What
  the data uses of the list is measured again and broadcast if that is small
  enough.  Else the values that more than a ``HOT_SHARE``-th of all rows have,
  ``HOT_SHARE`` at most, are broadcast, and only the other rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.sources.local import work_folder

LITERAL_BYTES = 16 << 10
BROADCAST_BYTES = 32 << 20
HOT_SHARE = 1000
#: Bytes of a literal's entry besides its texts.
LITERAL_ENTRY = 8
#: Bytes of a row of a hash table besides its texts.
ROW_BYTES = 48


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)) if mapping else F.lit(None).cast("map<string,string>")


def fits_literal(mapping: dict[str, str]) -> bool:
    return sum(len(k) + len(v or "") + LITERAL_ENTRY for k, v in mapping.items()) <= LITERAL_BYTES


def resolved(hit: Column, value: Column, unmapped: str) -> Column:
    """What a value becomes: its translation, else null, itself (``keep``) or a failure (``error``)."""
    if unmapped == "keep":
        return F.coalesce(hit, value)
    if unmapped == "error":
        return F.coalesce(hit, F.when(value.isNotNull(), F.raise_error(F.concat(F.lit("unmapped value: "), value))))
    return hit


def measured(values: DataFrame, *columns: str) -> int:
    """Bytes that a hash table of the rows takes, about."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(ROW_BYTES))
    return values.agg(F.sum(size)).first()[0] or 0


def looked_up(data: DataFrame, value: Column, values: DataFrame, out: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``data`` with ``out``: the translation of ``value`` (a text), null where the list lacks it.

    ``values`` has source_value and target_value; of a source value that comes
    twice the smallest target counts, null source values count for nothing, and
    null values of the data stay null.  A streaming table gets a broadcast list.
    """
    key, hit = _unused(data, "_key"), _unused(data, "_hit")
    known = values.filter("source_value IS NOT NULL").groupBy(F.col("source_value").alias(key)).agg(F.min("target_value").alias(hit))
    keyed = data.withColumn(key, value)
    named = [F.col(f"`{c}`") for c in data.columns]
    joined = lambda rows, table: rows.join(table, key, "left").select(*named, F.col(hit).alias(out))
    if data.isStreaming or measured(known, key, hit) <= broadcast_bytes:
        return joined(keyed, F.broadcast(known))
    n, path = _unused(data, "_n"), work_folder(data.sparkSession)
    # each value of the data once, with how often it occurs and what it becomes; kept, since it is read several times
    counted = keyed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n)).join(known, key, "left")
    counted.write.parquet(path)
    counted = data.sparkSession.read.schema(counted.schema).parquet(path)
    used = counted.filter(F.col(hit).isNotNull())
    if measured(used, key, hit) <= broadcast_bytes:
        return joined(keyed, F.broadcast(used.select(key, hit)))
    total = counted.agg(F.sum(n)).first()[0] or 0
    # at most HOT_SHARE values
    hot = [r[0] for r in counted.filter(F.col(n) > total // HOT_SHARE).select(key).collect()]
    cold = F.col(key).isNotNull() & ~(F.col(key).isin(hot) if hot else F.lit(False))
    common = F.broadcast(used.filter(~cold).select(key, hit))
    # null values meet nothing, so they take no part in the shuffle
    shuffled = joined(keyed.filter(cold).hint("merge"), used.filter(cold).select(key, hit))
    return joined(keyed.filter(F.coalesce(~cold, F.lit(True))), common).unionByName(shuffled)


def translated(data: DataFrame, column: str, values: DataFrame, out: str, unmapped: str = "null", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``data`` with ``out``: the column's values through a list of any size; ``unmapped`` as in :func:`resolved`."""
    value = F.col(f"`{column}`").cast("string")
    hit = _unused(data, "_found")
    found = looked_up(data, value, values, hit, broadcast_bytes)
    return found.withColumn(out, resolved(F.col(hit), value, unmapped)).drop(*([hit] if hit != out else []))


def _unused(data: DataFrame, name: str) -> str:
    taken = {c.lower() for c in data.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


