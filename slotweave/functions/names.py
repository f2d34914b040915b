"""Column functions on names and cell values: trimming, slot-name formatting, references, class names, numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "<empty>"
EXTRA_PREFIX = "_extra_"
_REFERENCE = r"^\{\{([^}]*)\}\}$"


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode white space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


_FORMATS = {
    "lowercase": F.lower,
    "uppercase": F.upper,
    "alpha_numeric_underscore": lambda c: F.regexp_replace(c, r"[^A-Za-z0-9]", "_"),
    "single_underscores": lambda c: F.regexp_replace(c, r"__+", "_"),
    "trim_trailing_underscores": lambda c: F.rtrim(c, F.lit("_")),
    "trim_whitespace": strip,
    "remove_special": lambda c: F.regexp_replace(c, r"[^A-Za-z0-9\s]", ""),
}


def _format(c: Column, operation: str | dict) -> Column:
    if isinstance(operation, str) and operation.startswith("remove_chars"):
        operation = {"remove_chars": operation.partition(":")[2].strip().strip("\"'")}
    if isinstance(operation, dict) and set(operation) == {"remove_chars"}:
        return F.translate(c, operation["remove_chars"], "")
    if not isinstance(operation, str) or operation not in _FORMATS:
        raise ValueError(f"unknown slot format operation: {operation!r}")
    return _FORMATS[operation](c)


def format_slot(c: Column, operations: list | str | None) -> Column:
    """Apply format operations in order; names with the extra prefix stay as they are."""
    operations = [operations] if isinstance(operations, (str, dict)) else operations or []
    out = reduce(_format, operations, c)
    return F.when(F.startswith(c, F.lit(EXTRA_PREFIX)), c).otherwise(out)


def is_reference(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(_REFERENCE)), F.lit(False))


def variable_reference(c: Column, operations: list | None = None) -> Column:
    """The formatted name in ``{{name}}``, null where the cell is something else."""
    return F.when(is_reference(c), format_slot(strip(F.regexp_extract(c, _REFERENCE, 1)), operations))


def wide_kind(c: Column) -> Column:
    """``value`` or ``expr`` by the column's suffix, else null."""
    return F.when(F.endswith(c, F.lit("_value")), "value").when(F.endswith(c, F.lit("_expr")), "expr")


def strip_wide_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r"_(value|expr)$", "")


def empty_sentinel(c: Column) -> Column:
    return F.when(c == EMPTY, "").otherwise(c)


def strip_ontology(c: Column, pattern: str | None) -> Column:
    """Without every match of the ontology pattern; the value itself where there is no pattern."""
    return c if not pattern else F.trim(F.regexp_replace(F.trim(c), pattern, ""))


def cut_class_name(c: Column) -> Column:
    """Class name up to the first bracket of either kind."""
    return F.get(F.split(c, r"[\[(]"), 0)


def class_of_file(path: Column) -> Column:
    """Class name in a file path: no folders, no last extension, nothing from the first square bracket on."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.get(F.split(base, r"\["), 0)


def parse_integer(c: Column) -> Column:
    """The whole number in a cell, null where there is none."""
    return F.when(F.rlike(c, F.lit(r"^\s*[+-]?[0-9]+\s*$")), F.trim(c).try_cast("long"))


def parse_float(c: Column) -> Column:
    """The number in a cell with a digit, null where there is none."""
    return F.when(F.rlike(c, F.lit(r"[0-9]")), F.trim(c).try_cast("double"))


def blank_marker(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "<blank>").otherwise(c)


def enum_name(table: Column, variable: Column, location: Column) -> Column:
    """Name of the enum of a coded column: the table and the capitalised variable; null for other locations."""
    return F.when(location == "variableCategories", F.concat(table, F.upper(F.substring(variable, 1, 1)), F.substr(variable, F.lit(2))))


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9 .,_]", "_")


def decorated_name(target: Column, file: Column, group: Column, slots: Column) -> Column:
    return F.format_string("%s[%03d,%04d=%s]", target, file, group, F.array_join(F.array_sort(slots), "-"))


def is_quoted(c: Column) -> Column:
    return F.rlike(c, F.lit(r"""^(?s)('.*'|".*")$"""))


def unquoted(c: Column) -> Column:
    return F.substring(c, 2, 1 << 30).substr(F.lit(1), F.length(c) - 2)


def parse_cell(c: Column) -> Column:
    """A cell's number as it is usually written (whole numbers without a fraction), or the cell itself where it holds none."""
    number = parse_float(c)
    return F.coalesce(parse_integer(c).cast("string"), F.when(number == F.floor(number), F.floor(number).cast("string")), number.cast("string"), c)


def parse_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``parse_cell`` on all text columns, or on those named."""
    chosen = [c for c, t in df.dtypes if t == "string"] if columns is None else columns
    return df.withColumns({c: parse_cell(F.col(f"`{c}`")) for c in chosen})


def order_headers(columns: list[str]) -> list[str]:
    """Class names of the headers that end in ``Order``, in their order."""
    return [c.removesuffix("Order") for c in columns if c.endswith("Order") and c != "Order"]
