"""Workbook tabs as tables: a data source over zipped sheet XML, one partition for each tab.

Only what a tab of mapping rows has is read: texts (shared, in place, of
formulas), numbers, flags and blanks.  The first row names the columns; cells are
text as the sheet holds them, and those in a column's list of blank values are null.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from slotweave.sources.files import open_store
from slotweave.sources.tables import SHEET

FORMAT = "workbook_tabs"

#: Cells that count as blank in columns without a list of their own.
BLANK_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: Names of the workbook format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


class MissingTab(ValueError):
    """A tab that a workbook does not have."""


def _workbook_files(path: str) -> list[str]:
    """The workbook, or all of a folder."""
    store, at = open_store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.Directory:
        return sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.is_file and f.base_name.lower().endswith(".xlsx") and not f.base_name.startswith(("~", ".", "_")))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [at]


def _open(path: str, at: str) -> zipfile.ZipFile:
    with open_store(path)[0].open_input_file(at) as file:
        return zipfile.ZipFile(io.BytesIO(file.read()))


def tabs(book: zipfile.ZipFile) -> dict[str, str]:
    """{tab: member of the archive}, in the order of the tabs."""
    related = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    member = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return {s.get("name"): member(related[s.get(_RELATED)]) for s in sheets}


def _text(node: ElementTree.Element) -> str:
    """All runs of a text, without the readings that some have."""
    return "".join(t.text or "" for child in node if child.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in ([child] if child.tag == f"{_MAIN}t" else child.findall(f"{_MAIN}t")))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, node in ElementTree.iterparse(stream):
            if node.tag == f"{_MAIN}si":
                out.append(_text(node))
                node.clear()
    return out


def _column(reference: str) -> int:
    """Place of a cell named like ``AB12``, from 0."""
    place = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        place = place * 26 + ord(letter) - 64
    return place - 1


def _number(text: str) -> str:
    """A number as a sheet shows it: whole ones without a point."""
    try:
        held = float(text)
    except ValueError:
        return text
    return str(int(held)) if held.is_integer() and abs(held) < 1e15 else repr(held)


def _cell(node: ElementTree.Element, shared: list[str]) -> str | None:
    kind, value = node.get("t", "n"), node.find(f"{_MAIN}v")
    if kind == "inlineStr":
        held = node.find(f"{_MAIN}is")
        return _text(held) if held is not None else None
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "TRUE" if value.text == "1" else "FALSE"
    return value.text if kind in ("str", "e") else _number(value.text)


def cells(book: zipfile.ZipFile, member: str) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a tab, one row at a time; blank rows without cells are left out."""
    shared = _shared(book)
    with book.open(member) as stream:
        last = 0
        for _, node in ElementTree.iterparse(stream):
            if node.tag != f"{_MAIN}row":
                continue
            last = int(node.get("r", last + 1))
            held: list[str | None] = []
            for k, c in enumerate(node.findall(f"{_MAIN}c")):
                at = _column(c.get("r")) if c.get("r") else k
                held += [None] * (at + 1 - len(held))
                held[at] = _cell(c, shared)
            node.clear()
            yield last, held


def _named(header: list[str | None]) -> dict[int, str]:
    """{place: column} of a tab's first row; a name that comes again gets a number."""
    out: dict[int, str] = {}
    for k, name in enumerate(header):
        if name is None or not name.strip():
            continue
        tried, n = name.strip(), 0
        while tried in out.values():
            n += 1
            tried = f"{name.strip()}.{n}"
        out[k] = tried
    return out


@dataclass
class Tab(InputPartition):
    book: int
    file: str
    tab: str
    member: str

    def __init__(self, book: int, file: str, tab: str, member: str):
        super().__init__(f"{file}#{tab}")
        self.book, self.file, self.tab, self.member = book, file, tab, member


class WorkbookTabs(DataSource):
    """``spark.read.format("workbook_tabs")``: (book, file, tab, line, cells); book is the
    workbook's place by name, cells are by column name.

    Options: ``path`` (a workbook or a folder of them), ``tabs`` (JSON list; all
    where it is left out), ``blank_values`` (JSON: tab -> column -> list) and
    ``default_blank_values`` (JSON list).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "book int, file string, tab string, line int, cells map<string,string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        told = lambda name, default: json.loads(self.options[name]) if name in self.options else default
        return TabReader(self.options["path"], told("tabs", None), told("blank_values", {}), told("default_blank_values", list(BLANK_VALUES)))


class TabReader(DataSourceReader):
    def __init__(self, path: str, wanted: list[str] | None, blank: dict[str, dict[str, list[str]]], default: list[str]):
        self.path, self.wanted, self.blank, self.default = path, wanted, blank, frozenset(default)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for n, file in enumerate(_workbook_files(self.path)):
            with _open(self.path, file) as book:
                held = tabs(book)
            out += [Tab(n, file, t, held[t]) for t in (held if self.wanted is None else self.wanted) if t in held]
        return out

    def read(self, partition: Tab | None) -> Iterator[tuple]:
        if partition is None:  # no tabs, no partitions
            return
        blank = {c: frozenset(v) for c, v in self.blank.get(partition.tab, {}).items()}
        with _open(self.path, partition.file) as book:
            rows = cells(book, partition.member)
            _, header = next(rows, (0, []))
            columns = _named(header)
            for line, held in rows:
                out = {}
                for k, name in columns.items():
                    value = held[k] if k < len(held) else None
                    out[name] = None if value is None or value in blank.get(name, self.default) else value
                yield partition.book, partition.file.rpartition("/")[2], partition.tab, line, out


def read_tabs(spark: SparkSession, path: str, wanted: list[str] | None = None, blank_values: dict[str, dict[str, list[str]]] | None = None, default_blank_values: list[str] | None = None) -> DataFrame:
    """(book, file, tab, line, cells) of the tabs wanted (all where none are named) of a workbook or a folder of workbooks."""
    spark.dataSource.register(WorkbookTabs)
    reader = spark.read.format(FORMAT).option("path", path)
    for name, value in (("tabs", wanted), ("blank_values", blank_values), ("default_blank_values", default_blank_values)):
        if value is not None:
            reader = reader.option(name, json.dumps(value))
    return reader.load()


def missing_tabs(path: str, wanted: list[str]) -> list[tuple[str, str]]:
    """(workbook, tab) of wanted tabs that a workbook lacks."""
    out = []
    for file in _workbook_files(path):
        with _open(path, file) as book:
            out += [(file.rpartition("/")[2], t) for t in wanted if t not in tabs(book)]
    return out


def tab_rows(spark: SparkSession, path: str, tab: str, strict: bool = True, **options) -> DataFrame:
    """Rows of one tab (of all workbooks of a folder) with its columns as text and ``_ord``, like the rows of a CSV export.

    A workbook without the tab is an error where ``strict``, else it has no rows.
    """
    if strict and (lost := missing_tabs(path, [tab])):
        raise MissingTab("; ".join(f"{file} has no tab {t!r}" for file, t in lost))
    found = read_tabs(spark, path, [tab], **options)
    columns = [r[0] for r in found.select(F.explode(F.map_keys("cells")).alias("c")).distinct().orderBy("c").collect()]
    first = _header_of(path, tab)
    columns.sort(key=lambda c: first.index(c) if c in first else len(first))
    place = F.col("book").cast("long") * SHEET + F.col("line") - 2
    return found.select(*(F.try_element_at("cells", F.lit(c)).alias(c) for c in columns), place.alias("_ord"))


def _header_of(path: str, tab: str) -> list[str]:
    for file in _workbook_files(path):
        with _open(path, file) as book:
            if tab in (held := tabs(book)):
                return list(_named(next(cells(book, held[tab]), (0, []))[1]).values())
    return []


def workbook(tables: dict[str, list[list[str | float | bool | None]]]) -> bytes:
    """A workbook of these tabs, texts shared: for tests, and for rows that Spark has made."""
    shared: dict[str, int] = {}
    out = io.BytesIO()
    main, officedoc = _MAIN[1:-1], _RELATED[1:].partition("}")[0]

    def letters(k: int) -> str:
        return (letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)

    def cell(k: int, n: int, v: str | float | bool) -> str:
        at = f'<c r="{letters(k)}{n}"'
        if isinstance(v, bool):
            return f'{at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"{at}><v>{v}</v></c>"
        return f'{at} t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'

    def escaped(v: str) -> str:
        return v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for n, rows in enumerate(tables.values(), 1):
            lines = (f'<row r="{k}">{"".join(cell(j, k, v) for j, v in enumerate(row) if v is not None)}</row>' for k, row in enumerate(rows, 1))
            book.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si><t xml:space=\"preserve\">{escaped(v)}</t></si>" for v in shared)}</sst>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{officedoc}"><sheets>{"".join(f"<sheet name=\"{escaped(t)}\" sheetId=\"{n}\" r:id=\"r{n}\"/>" for n, t in enumerate(tables, 1))}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE[1:-1]}">{"".join(f"<Relationship Id=\"r{n}\" Type=\"{officedoc}/worksheet\" Target=\"worksheets/sheet{n}.xml\"/>" for n in range(1, len(tables) + 1))}</Relationships>')
    return out.getvalue()
