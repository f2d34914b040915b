"""Metadata tables: mapping rows, specs and schemas. The driver holds small ones; large ones stay in files, like data."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a metadata table that the driver holds at most.
HELD_ROWS = 10_000


def local_table(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """A local relation of one partition."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in struct]
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, to_arrow_schema(struct), strict=True)]
    # one partition: grouping and joining such tables needs no exchange
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=to_arrow_schema(struct)), schema=struct).coalesce(1)


def settled(df: DataFrame, rows: list | None = None) -> DataFrame:
    """The rows of a metadata table (``rows``, where they have been collected) as a local relation, so that later steps don't compute it again."""
    def plain(v):
        if hasattr(v, "asDict"):
            return v.asDict(recursive=True)
        if isinstance(v, dict):
            return list(v.items())
        return v

    return local_table(df.sparkSession, [tuple(plain(v) for v in r) for r in (df.collect() if rows is None else rows)], T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]))


def few(df: DataFrame) -> list[Row] | None:
    """The rows of a table that the driver may hold; None where there are more."""
    found = df.limit(HELD_ROWS + 1).collect()
    return found if len(found) <= HELD_ROWS else None


def kept(df: DataFrame) -> DataFrame:
    """The rows of a large metadata table, written below the work folder and read back, so that later steps don't compute it again."""
    path = work_folder(df.sparkSession)
    typed = df.select(*(F.col(f"`{c}`").cast("string").alias(c) if t == "void" else F.col(f"`{c}`") for c, t in df.dtypes))
    typed.write.parquet(path)
    return df.sparkSession.read.schema(typed.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table whose rows cost much and whose files are few, dealt out to all cores."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


#: Places within a partition, in the ids that Spark gives its rows.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A large table, kept, with each row's place from 0 in a total order: partitions are ranges of it, and only their sizes are collected."""
    ranged = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, _PLACE_BITS)
    before, start = {}, 0
    for p, n in sorted((r[0], r[1]) for r in ranged.groupBy(part).count().collect()):
        before[p], start = start, start + n
    if not before:
        return ranged
    starts = F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair))
    return ranged.withColumn(name, F.element_at(starts, part) + F.col(name).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))


#: Settings under which a job over a few hundred rows costs least: no generated code, no re-planning, one partition.
_SMALL = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1"}


@contextmanager
def small_jobs(spark: SparkSession) -> Iterator[None]:
    """Jobs inside are over metadata tables: plan them for that, and put the session's settings back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _SMALL}
    try:
        for k, v in _SMALL.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def work_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: below ``spark.checkpoint.dir``, or, on a local master, the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{root.rstrip('/')}/mapping-{uuid.uuid4().hex}"
