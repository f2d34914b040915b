"""Queries whose mapping rows are as many as a table's: the driver never holds them, and results are those of the SQL."""

import duckdb
import pytest

from slotweave.operators import lists
from slotweave.plans import catalogue
from slotweave.sources import local
from tests.test_catalogue import DATA, canon, duck, pytestmark  # noqa: F401

HELD = 8


@pytest.fixture
def collected(spark, monkeypatch):
    """The most rows that were collected at once, where the driver may hold ``HELD``."""
    kind, most = type(spark.range(1)), [0]
    collect = kind.collect

    def watched(self):
        found = collect(self)
        most[0] = max(most[0], len(found))
        return found

    monkeypatch.setattr(local, "HELD_ROWS", HELD)
    monkeypatch.setattr(lists, "LITERAL_BYTES", 64)
    monkeypatch.setattr(kind, "collect", watched)
    return most


@pytest.mark.parametrize("name", [
    "enum_list_of_parts_mirrored", "bad_settings", "diagnostics", "enum_list_of_parts", "refused_expressions", "slot_settings", "slots_read_by_expressions", "spec_files", "run_from_files",
])
def test_rows_stay_out_of_the_driver(spark, duck, collected, tmp_path, name):  # noqa: F811
    catalogue.QUERIES[name](spark, DATA).write.parquet(f"{tmp_path}/out")
    assert collected[0] <= HELD + 1
    ours = duckdb.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'").df()
    assert canon(ours) == canon(duck.sql(catalogue.ORACLE_SQL[name]).df())
