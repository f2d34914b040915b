"""Specs on streams: mapping has no state, so the batch plan runs on a streaming table in append mode.

``start_many`` feeds the tables of all target classes from one read of the
source.  A micro-batch is kept while its rows are mapped to each class; every
class gets a folder of the batch's number, which a repeated batch overwrites,
and the batch counts once its mark is written after all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotweave.operators.compile import Specs
from slotweave.operators.execute import execute
from slotweave.sources.local import local_table
from slotweave.sources.metadata import Schema

#: Folder of the marks, beside the classes' folders; classes of schemas have no dots in their names.
MARKS = "batches.done"
BATCH = "batch"


def map_stream(specs: Specs, streams: dict[str, DataFrame], target: Schema) -> dict[str, DataFrame]:
    return execute(specs, streams, target)


def start(spark: SparkSession, rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append mapped rows as Parquet, exactly once, and stop when what is there has been read."""
    return rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def start_many(spark: SparkSession, specs: Specs, source_class: str, stream: DataFrame, target: Schema, path: str, checkpoint: str, write: Callable[[DataFrame, str], None] = _write) -> StreamingQuery:
    """Map a stream to all target classes at once, until what is there has been read.

    Rows of a class are below ``path/<class>``; ``read_class`` reads those of
    whole batches.  After a failure the same checkpoint carries on: a batch that
    was cut off is written again over what it left.
    """
    own = replace(specs, **{name: t.filter(F.col("source_class") == source_class) for name, t in (("classes", specs.classes), ("slots", specs.slots))}, read={})

    def batch(rows: DataFrame, number: int) -> None:
        held = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name, mapped in execute(own, {source_class: held}, target).items():
                write(mapped, f"{path}/{name}/{BATCH}={number}")
            local_table(rows.sparkSession, [(number,)], f"{BATCH} long").write.mode("overwrite").parquet(f"{path}/{MARKS}/number={number}")
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_class(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of a target class, of the batches that are whole."""
    done = spark.read.option("basePath", f"{path}/{MARKS}").parquet(f"{path}/{MARKS}").select(BATCH)
    return spark.read.parquet(f"{path}/{name}").join(done, BATCH, "left_semi").drop(BATCH)
