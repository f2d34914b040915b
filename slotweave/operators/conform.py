"""Conformance of data to a schema: required, pattern, range, enum membership, identifiers, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule): one row for each row and rule (a Column that is true where the row is fine) that fails; one pass."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(failed).alias("rule"))


def required(c: str) -> Column:
    return F.col(c).isNotNull()


def matches(c: str, pattern: str) -> Column:
    return F.rlike(F.col(c), F.lit(pattern))


def between(c: str, low: float | None = None, high: float | None = None) -> Column:
    terms = [F.col(c) >= low] * (low is not None) + [F.col(c) <= high] * (high is not None)
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def member(c: str, values: list[str]) -> Column:
    return F.col(c).isin(values)


def repeated_identifiers(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): identifiers that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose reference no row of the other table has."""
    return df.join(other.select(F.col(other_key).alias(key)).distinct(), key, "left_anti")
