"""Wide rows of one slot each, and runs from files."""

import json

import pytest

from slotweave.functions import names
from slotweave.operators import compile as compiler
from slotweave.operators import prepare
from slotweave.plans.catalogue import _BASE, _wide, rows, specs_of
from slotweave.plans.run import run
from slotweave.plans.schemas import SOURCE, TARGET
from slotweave.sources import tables
from slotweave.sources.metadata import Schema


def row(number, slot, value="", expr="", **more):
    return {"sourceClass": "lineitem", "targetClass": "measures", "wideRowNumber": number, "targetSlot": slot, "targetValue": value, "targetExpr": expr, **more}


def compiled(spark, *wide, strict=True):
    return compiler.compile_mapping(spark, Schema.parse(SOURCE), Schema.parse(TARGET), prepare.prepare_maps(rows(spark, *_BASE)), prepare.prepare_wide_rows(rows(spark, *wide)), strict=strict)


def derivations(specs):
    out = {}
    for r in specs.slots.orderBy("deriv_id", "ord").collect():
        out.setdefault(r["deriv_id"], {})[r["target_slot"]] = (r["kind"], r["source_slot"] or r["expr"], {k: json.loads(v) for k, v in (r["settings"] or {}).items()})
    return [out[k] for k in sorted(out)]


BASE = {"saleID": ("copy", "l_orderkey", {}), "line": ("copy", "l_linenumber", {})}


def test_rows_of_a_number_make_one_derivation(spark):
    found = derivations(compiled(spark, row("2", "measure", "two"), row("1", "measure", "one"), row("2", "value", "{{l_tax}}"), row("1", "value", "{{l_quantity}}"), row("10", "measure", "ten")))
    assert found == [
        {**BASE, "measure": ("const", "one", {}), "value": ("copy", "l_quantity", {})}, {**BASE, "measure": ("const", "two", {}), "value": ("copy", "l_tax", {})}, {**BASE, "measure": ("const", "ten", {})},
    ]


def test_the_last_row_for_a_slot_counts(spark):
    found = derivations(compiled(spark, row("0", "measure", "old", slotDerivationSettings="range: a"), row("0", "measure", "new"), row("0", "line", expr="1 + 1"), row("0", "value", "7", "src.l_tax * 2", slotDerivationSettings="{unit: x, n: 2}"), row("0", "note", "<empty>")))
    assert len(found) == 1 and found[0]["measure"] == ("const", "new", {}) and found[0]["saleID"] == BASE["saleID"]
    assert found[0]["value"] == ("expr", "src.l_tax * 2", {"unit": "x", "n": 2}) and found[0]["line"][0] == "expr" and found[0]["note"] == ("const", "", {})


def test_rows_without_a_slot_are_refused(spark):
    with pytest.raises(compiler.MappingError, match="E_EMPTY_SLOT"):
        compiled(spark, row("0", "", "x"))


def test_settings_of_a_wide_row_are_those_of_its_cells(spark):
    found = derivations(specs_of(spark, maps=_BASE, wide=[_wide("l_tax", measure_value="tax", value_value="{{l_tax}}", slotDerivationSettings="range: float")]))
    assert found == [{**BASE, "measure": ("const", "tax", {"range": "float"}), "value": ("copy", "l_tax", {"range": "float"})}]


# --- runs ----------------------------------------------------------------------------------------------------


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "source.yaml").write_text(SOURCE)
    (tmp_path / "target.yaml").write_text(TARGET)
    (tmp_path / "b.csv").write_text("sourceClass,sourceSlot,targetClass,targetSlot,selectors\norders,o_orderkey,sales,saleID,\norders,o_custkey,sales,buyerID,late\n")
    (tmp_path / "a.csv").write_text("sourceClass,sourceSlot,targetClass,targetSlot,Complete,sourceValue,targetValue\norders,o_orderstatus,sales,state,1,F,closed\norders,o_orderpriority,sales,urgency,0,,\n")
    (tmp_path / "wide.csv").write_text("sourceClass,targetClass,wideRowNumber,targetSlot,targetValue\norders,people,1,note,x\n")
    return tmp_path


OPTIONS = "source-schema-file: source.yaml\ntarget-schema-file: target.yaml\nmaps-files: [b.csv, a.csv]\nwide-files: wide.csv\nselectors: '!late'\noutput-dir: specs\nreport-dir: reports\n"


def test_a_run_from_files(spark, folder):
    done = run(spark, tables.read_options(OPTIONS, base=str(folder)))
    assert sorted((r["target_class"], r["target_slot"]) for r in done.specs.slots.collect()) == [("people", "note"), ("sales", "saleID"), ("sales", "state")]
    assert sorted(f.name for f in (folder / "specs").iterdir() if f.suffix == ".yaml") == ["mapper-0000000000-orders-people_000,0000__.yaml", "mapper-0000000001-orders-sales.yaml"]
    assert {f.name for f in (folder / "reports").iterdir()} == {"missing_source_enum_values.csv"}
    missing = tables.read_rows(spark, str(folder / "reports" / "missing_source_enum_values.csv")).orderBy("_ord").collect()
    assert [r["sourceEnumValue"] for r in missing] == ["O", "P"]


def test_given_options_count_before_those_of_the_file(spark, folder):
    options = tables.read_options(OPTIONS, base=str(folder), given={"selectors": ["late"], "maps_files": [str(folder / "b.csv")], "wide_files": None})
    done = run(spark, options)
    assert sorted(r["target_slot"] for r in done.specs.slots.filter("target_class = 'sales'").collect()) == ["buyerID", "saleID"]


def test_options(spark):
    options = tables.read_options("maps-files: [a.csv, /b.csv, s3://x/c.csv]\noutput-dir: out\nselectors: [a]\n", base="/base", given={"selectors": ["b"], "strict": None})
    assert options == {"maps_files": ["/base/a.csv", "/b.csv", "s3://x/c.csv"], "output_dir": "/base/out", "selectors": ["b"]}
    assert tables.read_options("") == {}
    with pytest.raises(ValueError, match="unknown options: no_such"):
        run(spark, {"no_such": 1})


def test_headers_that_order_classes():
    assert names.order_headers(["siteOrder", "Order", "x", "sampleOrder", "OrderOf"]) == ["site", "sample"]
