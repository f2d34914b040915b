"""Files that Spark writes and reads: one file for each spec, committed together; tabs of workbooks."""

import csv
import io
import os
import zipfile

import pytest
import yaml
from pyspark.sql import functions as F

from slotweave.plans.catalogue import _BASE, _sale, _wide, specs_of
from slotweave.plans.schemas import SOURCE
from slotweave.sources import specs as stored
from slotweave.sources import workbooks
from slotweave.sources.files import NamedFileWriter, Written, write_named
from slotweave.sources.metadata import Schema
from slotweave.sources.tables import read_rows


def files_in(folder):
    return {f: open(f"{folder}/{f}", encoding="utf-8").read() for f in sorted(os.listdir(folder)) if not f.endswith(".crc")}


def wide_specs(spark):
    maps = [_sale("o_orderkey", "saleID", slotDerivationSettings="range: integer"), _sale(None, "origin", targetExpr="'wéb'"), *(_sale("o_orderstatus", "state", sourceValue=s, targetValue=t) for s, t in (("F", "closed"), ("P", "closed"), ("O", "open")))]
    wide = [_wide(c, measure_value=m, value_value="{{" + c + "}}", unit_value="pieces") for m, c in (("quantity", "l_quantity"), ("tax", "l_tax"))]
    return specs_of(spark, maps=[*_BASE, *maps], wide=wide)


def test_spec_files(spark, tmp_path):
    specs, folder = wide_specs(spark), str(tmp_path / "specs")
    stored.write_specs(specs, folder)
    there = files_in(folder)
    wide = [f"mapper-{k:010d}-lineitem-measures_000,{k:04d}_l_linenumber_l_orderkey_{c}_.yaml" for k, c in enumerate(("l_quantity", "l_tax"))]
    assert list(there) == [*wide, "mapper-0000000002-orders-sales.yaml"]
    assert [n.split("-")[1] for n in there] == [f"{k:010d}" for k in range(3)] and all(set(n) <= set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,_-") for n in there)
    assert [yaml.safe_load(t) for t in there.values()] == [d for _, d in stored.documents(specs)]
    docs = [yaml.safe_load(t) for t in there.values()]
    sales = docs[2]
    assert list(sales["class_derivations"]["sales"]["slot_derivations"]) == ["saleID", "origin", "state"]
    assert sales["class_derivations"]["sales"]["slot_derivations"]["saleID"] == {"name": "saleID", "populated_from": "o_orderkey", "range": "integer"}
    assert sales["class_derivations"]["Container"]["slot_derivations"] == {"sales": {"populated_from": "orders"}}
    assert sales["enum_derivations"]["stateSet"]["permissible_value_derivations"] == {"closed": {"sources": ["F", "P"]}, "open": {"populated_from": "O"}}
    assert "wéb" in there[list(there)[2]]
    back = stored.read_specs(spark, stored.read_documents(spark, folder), Schema.parse(SOURCE))
    plain = lambda s: sorted((r["deriv_id"], r["source_class"], r["target_class"], r["target_slot"], r["source_slot"]) for r in s.slots.filter("kind = 'copy'").collect())
    assert plain(back) == plain(specs)


def test_new_specs_replace_older_ones(spark, tmp_path):
    folder = str(tmp_path / "specs")
    stored.write_specs(wide_specs(spark), folder)
    (tmp_path / "specs" / "notes.txt").write_text("mine")
    stored.write_specs(specs_of(spark, maps=[_sale("o_orderkey", "saleID")]), folder)
    assert list(files_in(folder)) == ["mapper-0000000000-orders-sales.yaml", "notes.txt"]


def named(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, document string").repartition(3)


def test_files_are_refused_where_some_are(spark, tmp_path):
    folder = str(tmp_path / "f")
    write_named(named(spark, ("a.txt", "1")), folder, suffix=".txt", overwrite=False)
    with pytest.raises(Exception, match="has files"):
        write_named(named(spark, ("b.txt", "2")), folder, suffix=".txt", overwrite=False)
    assert files_in(folder) == {"a.txt": "1"}


@pytest.mark.parametrize("bad", ["x/y.txt", "", ".hidden", "_staged"])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    folder = str(tmp_path / "f")
    write_named(named(spark, ("a.txt", "old")), folder, suffix=".txt")
    with pytest.raises(Exception, match="not a file name"):
        write_named(named(spark, *((f"n{k}.txt", "new") for k in range(20)), (bad, "new")), folder, suffix=".txt")
    assert files_in(folder) == {"a.txt": "old"}


def test_two_rows_for_one_file(spark, tmp_path):
    folder = str(tmp_path / "f")
    write_named(named(spark, ("a.txt", "old")), folder, suffix=".txt")
    with pytest.raises(Exception, match="several rows for one file: b.txt"):
        write_named(named(spark, ("b.txt", "1"), ("c.txt", "2"), ("b.txt", "3")), folder, suffix=".txt")
    assert files_in(folder) == {"a.txt": "old"}


def test_only_the_attempt_that_is_told_of_is_moved(tmp_path):
    writer = NamedFileWriter(str(tmp_path), ".txt", True)
    first, second = writer.write(iter([{"file": "a.txt", "document": "lost"}])), writer.write(iter([{"file": "a.txt", "document": "kept"}]))
    assert first.folder != second.folder and second == Written(second.folder, ("a.txt",))
    writer.commit([second, None])
    assert files_in(tmp_path) == {"a.txt": "kept"}


def test_nulls_and_bytes(spark, tmp_path):
    folder = str(tmp_path / "f")
    write_named(named(spark, ("a.txt", None), ("b.txt", "é\r\n")), folder)
    assert open(f"{folder}/a.txt", "rb").read() == b"" and open(f"{folder}/b.txt", "rb").read() == "é\r\n".encode()
    write_named(spark.createDataFrame([("c.bin", bytearray(b"\x00\xff"))], "file string, document binary"), folder, suffix=".bin")
    assert open(f"{folder}/c.bin", "rb").read() == b"\x00\xff"


# --- workbooks ---------------------------------------------------------------------------------------------

MAPS = [
    ["sourceClass", "sourceSlot", "Notes", None, "Notes", "n"],
    ["orders", "o_key", "NA", "x", "b & c <d>", 1],
    ["orders", None, "none", None, None, 2.5],
    [None, None, None, None, None, None],
    ["  padded ", "é", "-", None, "NULL", True],
]


def as_csv(rows):
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return out.getvalue()


def write_book(path, tables):
    path.write_bytes(workbooks.workbook(tables))
    return str(path)


def test_a_tab_is_its_export(spark, tmp_path):
    book = write_book(tmp_path / "maps.xlsx", {"maps": MAPS, "other": [["a"], ["1"]]})
    plain = [["sourceClass", "sourceSlot", "Notes", "Notes.1", "n"], ["orders", "o_key", "NA", "b & c <d>", "1"], ["orders", "", "none", "", "2.5"], ["", "", "", "", ""], ["  padded ", "é", "-", "NULL", "TRUE"]]
    (tmp_path / "maps.csv").write_text(as_csv(plain), encoding="utf-8")
    exported = [tuple(r)[:-1] for r in read_rows(spark, str(tmp_path / "maps.csv")).orderBy("_ord").collect()]
    tab = workbooks.tab_rows(spark, book, "maps", default_blank_values=[""])
    assert tab.columns == ["sourceClass", "sourceSlot", "Notes", "Notes.1", "n", "_ord"]
    held = [tuple(r)[:-1] for r in tab.orderBy("_ord").collect()]
    assert [h for h in held if any(h)] == [e for e in exported if any(e)] and len(held) == 4


def test_lists_of_blank_values(spark, tmp_path):
    book = write_book(tmp_path / "maps.xlsx", {"maps": MAPS})
    held = workbooks.tab_rows(spark, book, "maps", blank_values={"maps": {"Notes": ["none", "-"]}}).orderBy("_ord").collect()
    assert [r["Notes"] for r in held] == ["NA", None, None, None] and [r["Notes.1"] for r in held] == ["b & c <d>", None, None, None]
    default = workbooks.tab_rows(spark, book, "maps").orderBy("_ord").collect()
    assert [r["Notes"] for r in default] == [None, "none", None, "-"]


def test_tabs_of_a_folder(spark, tmp_path):
    for name, key in (("b.xlsx", "2"), ("a.XLSX", "1")):
        write_book(tmp_path / name, {"maps": [["k", f"own {key}"], [key, "v"]], "empty": [], "header": [["k"]]})
    (tmp_path / "~$a.xlsx").write_bytes(b"locked")
    (tmp_path / "readme.txt").write_text("no book")
    tabs = workbooks.read_tabs(spark, str(tmp_path))
    assert tabs.rdd.getNumPartitions() == 6
    assert sorted((r["book"], r["file"], r["tab"], r["line"]) for r in tabs.collect()) == [(0, "a.XLSX", "maps", 2), (1, "b.xlsx", "maps", 2)]
    rows = workbooks.tab_rows(spark, str(tmp_path), "maps")
    assert rows.columns == ["k", "own 1", "own 2", "_ord"] and [tuple(r) for r in rows.orderBy("_ord").collect()] == [("1", "v", None, 0), ("2", None, "v", 10**9)]
    assert workbooks.tab_rows(spark, str(tmp_path), "empty").columns == ["_ord"] and workbooks.tab_rows(spark, str(tmp_path), "header").count() == 0


def test_a_tab_that_is_missing(spark, tmp_path):
    book = write_book(tmp_path / "maps.xlsx", {"maps": MAPS})
    with pytest.raises(workbooks.MissingTab, match="maps.xlsx has no tab 'wide'"):
        workbooks.tab_rows(spark, book, "wide")
    assert workbooks.missing_tabs(book, ["maps", "wide"]) == [("maps.xlsx", "wide")]
    assert workbooks.tab_rows(spark, book, "wide", strict=False).count() == 0
    with pytest.raises(Exception, match="nothing.xlsx"):
        workbooks.tab_rows(spark, str(tmp_path / "nothing.xlsx"), "maps")


def test_kinds_of_cells(spark, tmp_path):
    """What other writers put into sheets: runs of text with readings, texts in place, formulas, errors, cells without places, absolute targets."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    book = tmp_path / "odd.xlsx"
    with zipfile.ZipFile(book, "w") as out:
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="t" sheetId="4" r:id="q"/></sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="q" Type="x" Target="/xl/deep/s.xml"/></Relationships>')
        out.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>reading</t></rPh></si><si><t>k</t></si></sst>')
        cells = '<c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>in place</t></is></c><c r="D2" t="str"><f>A1</f><v>made</v></c><c r="E2" t="e"><v>#N/A</v></c><c r="F2"><v>1E3</v></c><c r="G2"><v>0.1</v></c><c r="AB2"><v>7</v></c>'
        head = "".join(f'<c r="{x}1" t="inlineStr"><is><t>{x}</t></is></c>' for x in ("A", "B", "C", "D", "E", "F", "G", "AB"))
        out.writestr("xl/deep/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1">{head}</row><row r="2">{cells}</row><row r="9"><c t="s"><v>1</v></c><c><v>-3</v></c></row></sheetData></worksheet>')
    rows = workbooks.tab_rows(spark, str(book), "t").orderBy("_ord").collect()
    assert tuple(rows[0]) == ("rich", None, "in place", "made", None, "1000", "0.1", "7", 0)
    assert tuple(rows[1])[:2] == ("k", "-3") and rows[1]["_ord"] == 7


def test_a_workbook_compiles(spark, tmp_path):
    from slotweave.operators import compile as compiler
    from slotweave.operators import prepare
    from slotweave.plans.schemas import TARGET

    book = write_book(tmp_path / "m.xlsx", {"maps": [["sourceClass", "sourceSlot", "targetClass", "targetSlot", "Complete"], ["orders", "o_orderkey", "sales", "saleID", 1], ["orders", "o_custkey", "sales", "buyerID", 0]]})
    specs = compiler.compile_mapping(spark, Schema.parse(SOURCE), Schema.parse(TARGET), prepare.prepare_maps(workbooks.tab_rows(spark, book, "maps")), strict=True)
    assert [r["target_slot"] for r in specs.slots.select(F.col("target_slot")).collect()] == ["saleID"]
