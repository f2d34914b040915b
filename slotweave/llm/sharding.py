"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by a permutation of its own
(an offset and a step, both from its name).  Shards take turns; at its turn a
shard claims the next free slot of its order.  So shards hold nearly equal
numbers of slots, and when a shard comes or goes few other slots change hands.
A key goes to the shard that holds slot ``hash(key) mod size``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.llm.text import unused

TABLE_SIZE = 65537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def build_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the shard that holds each slot. ``size`` is a prime far above the number of shards."""
    if not shards or len(shards) > size:
        raise ValueError("needs at least one shard, and no more shards than slots")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be prime")
    at = [_number(f"{name}/offset") % size for name in shards]
    step = [_number(f"{name}/step") % (size - 1) + 1 for name in shards]
    table, free = [-1] * size, size
    while free:
        for s in range(len(shards)):
            while table[at[s]] >= 0:
                at[s] = (at[s] + step[s]) % size
            table[at[s]] = s
            free -= 1
            if not free:
                break
    return table


def slot_of(key, size: int = TABLE_SIZE):
    """Slot of a key column: 32 bits of the md5 of its text, modulo the table size (null like an empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % size


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with columns ``slot`` and ``shard`` (an index into ``shards``) added.

    The lookup table has ``size`` rows whatever the data, so it is broadcast and
    placing a row needs no shuffle.  Rows with equal keys share a shard; null
    keys share the shard of the empty text.  Columns named ``slot`` or ``shard``
    are replaced.
    """
    spark: SparkSession = docs.sparkSession
    at, held = unused(docs, "slot_"), unused(docs, "shard_")
    table = spark.createDataFrame(list(enumerate(build_table(shards, size))), f"{at} long, {held} long")
    keyed = docs.withColumn(at, slot_of(F.col(key), size)).drop("slot", "shard")
    return keyed.join(F.broadcast(table), at).withColumns({"slot": F.col(at), "shard": F.col(held)}).drop(at, held)


def write_shards(docs: DataFrame, path: str, shards: list[str], key: str = "doc_id", files_per_shard: int = 8) -> None:
    """Write ``docs`` as Parquet, one folder for each shard, with the column ``slot``.

    A shard's rows are dealt over ``files_per_shard`` tasks by a second hash, so
    a large shard isn't written by one task.  Rows with a null key are written to
    the shard of the empty text.  Of an empty table no folder is made.
    """
    placed = place(docs, shards, key)
    spread = F.pmod(F.xxhash64(*placed.columns), F.lit(files_per_shard))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)
