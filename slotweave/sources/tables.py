"""Readers and writers: mapping rows from CSV, TSV, text and YAML; Parquet tables; specs, reports and run options.

Mapping rows are all text, blank cells are null, and ``_ord`` keeps their order.
"""

from __future__ import annotations

import os
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions import names
from slotweave.sources.local import local_table

#: Rows of sheet number n have ``_ord`` from n times this on.
SHEET = 10**9
SEPARATORS = {".csv": ",", ".tsv": "\t", ".txt": "\t"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_rows(spark: SparkSession, path: str, file: int = 0) -> DataFrame:
    """Mapping rows of a file, by its extension (any case); ``_ord`` is file and line."""
    kind = os.path.splitext(path)[1].lower()
    if kind in (".yaml", ".yml"):
        texts = spark.read.text(path, wholetext=True).filter("value <> ''").collect()  # one document, or a folder with one
        table = yaml.safe_load(texts[0][0] if texts else "") or {}
        columns = list(table)
        rows = [tuple(None if v in (None, "") else str(v) for v in r) for r in zip(*table.values(), strict=True)]
    elif kind in SEPARATORS:
        # one file of a few thousand lines: read whole, so that lines keep their order
        frame = spark.read.csv(path, header=True, sep=SEPARATORS[kind], nullValue="", inferSchema=False, multiLine=True, escape='"').coalesce(1)
        return frame.withColumn("_ord", F.monotonically_increasing_id() + F.lit(file * SHEET))
    else:
        raise ValueError(f"unsupported table format: {kind!r}")
    return local_table(spark, [(*r, file * SHEET + k) for k, r in enumerate(rows)], ", ".join([*(f"`{c}` string" for c in columns), "_ord long"]))


def read_folder(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of several files, ordered by file name."""
    parts = [read_rows(spark, p, k) for k, p in enumerate(sorted(paths, key=os.path.basename))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def strip_cells(df: DataFrame) -> DataFrame:
    return df.select(*(names.strip(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))


def write_rows(df: DataFrame, path: str, strip: bool = True) -> None:
    """Write CSV or TSV by the extension; a YAML table holds one list for each column and is for metadata of a few rows."""
    kind = os.path.splitext(path)[1]
    rows = strip_cells(df) if strip else df
    if kind == ".yaml":
        held = [r.asDict() for r in rows.collect()]
        text = yaml.safe_dump({c: [r[c] for r in held] for c in rows.columns}, sort_keys=False, allow_unicode=True)
        local_table(df.sparkSession, [(text,)], "value string").write.mode("overwrite").text(path)
        return
    if kind not in SEPARATORS:
        raise ValueError(f"unsupported table format: {kind!r}")
    rows.write.mode("overwrite").csv(path, header=True, sep=SEPARATORS[kind], quote='"', escape='"')


def write_report(df: DataFrame, path: str) -> bool:
    if df.isEmpty():
        return False
    write_rows(df, path)
    return True


def read_options(text: str, base: str = "", given: dict[str, Any] | None = None) -> dict[str, Any]:
    """Run options of a YAML text: dashes in names become underscores, relative ``*_file``/``*_dir``/``*_path`` values start at ``base``, and ``given`` options replace whole values."""
    def place(key: str, value):
        if isinstance(value, list):
            return [place(key, v) for v in value]
        return os.path.join(base, value) if isinstance(value, str) and base and key.endswith(("_file", "_files", "_dir", "_path")) and "://" not in value else value

    options = {k.replace("-", "_"): v for k, v in (yaml.safe_load(text) or {}).items()}
    return {k: place(k, v) for k, v in options.items()} | {k: v for k, v in (given or {}).items() if v is not None}
