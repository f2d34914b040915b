"""Selectors: tags on mapping rows that switch them on or off for a run.

A row's selectors are a comma-separated list of include flags, ``!`` exclude
flags and version conditions on modules (``core>=3.0``).  A run gives flags,
``!`` flags and ``module=version`` pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions import versions

#: Fixed value: the form of a version condition, matched at the start of a selector.
CONDITION = r"([A-Za-z0-9_]+)\s*([<>=!~]+)(\s*)([\d\.]+)"
_CONDITION = f"^{CONDITION}"


@dataclass(frozen=True)
class RunSelectors:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    modules: dict[str, tuple[str, ...]] = field(default_factory=dict)


def parse_run(selectors: list[str] | str | None) -> RunSelectors:
    """Selectors of a run: ``flag``, ``!flag`` and ``module=version``."""
    if isinstance(selectors, str):
        selectors = [selectors]
    include, exclude, modules = [], [], {}
    for text in (t.strip() for s in selectors or [] for t in str(s).split(",")):
        if not text:
            continue
        if text.startswith("!"):
            exclude.append(text.lstrip("!").strip())
        elif text.count("=") == 1:
            name, version = (x.strip() for x in text.split("="))
            modules[name] = (*modules.get(name, ()), version)
        elif "=" in text:
            raise ValueError(f"a run names a module's version with one '=': {text!r}")
        else:
            include.append(text)
    return RunSelectors(tuple(include), tuple(exclude), modules)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


#: What a condition says after its module: the operator, then everything behind it.
_TOLD = r"^[A-Za-z0-9_]+\s*([<>=!~]+)\s*(.*)$"


def _condition(selector: Column) -> Column:
    """Operator and version of a module's condition: the whole version where it is one (epochs, wildcards, pre-releases), else its leading digits and dots."""
    whole = F.concat(F.regexp_extract(selector, _TOLD, 1), F.trim(F.regexp_extract(selector, _TOLD, 2)))
    digits = F.concat(F.regexp_extract(selector, _CONDITION, 2), F.regexp_extract(selector, _CONDITION, 4))
    return F.when(versions.valid_condition(whole), whole).otherwise(digits)


def passes(selectors: Column, run: RunSelectors) -> Column:
    """Whether a row with these selectors takes part in the run; blank selectors always do."""
    parts = F.filter(F.transform(F.split(F.coalesce(selectors, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    excluded = F.transform(F.filter(parts, lambda x: F.startswith(x, F.lit("!"))), lambda x: F.trim(F.ltrim(x, F.lit("!"))))
    plain = F.filter(parts, lambda x: ~F.startswith(x, F.lit("!")))
    conditions = F.filter(plain, lambda x: F.rlike(x, F.lit(_CONDITION)))
    included = F.filter(plain, lambda x: ~F.rlike(x, F.lit(_CONDITION)))
    run_in, run_out = _strings(run.include), _strings(run.exclude)
    ok = ~F.arrays_overlap(included, run_out) & ~F.arrays_overlap(excluded, run_in)
    ok &= (F.size(included) == 0) | F.arrays_overlap(included, run_in)

    told = F.transform(conditions, lambda x: F.struct(F.regexp_extract(x, _CONDITION, 1).alias("module"), _condition(x).alias("condition")))
    ok &= F.forall(told, lambda x: x["module"].isin(list(run.modules)))
    odd = F.exists(told, lambda x: ~versions.valid_condition(x["condition"]))
    ok &= F.when(odd, F.raise_error(F.concat(F.lit("invalid version condition in: "), selectors)).cast("boolean")).otherwise(True)
    for module, held in run.modules.items():
        own = F.transform(F.filter(told, lambda x: x["module"] == module), lambda x: x["condition"])  # noqa: B023
        for version in held:
            versions.compare(version, version)  # refuses what is no version
            ok &= (F.size(own) == 0) | versions.meets_all(F.lit(version), own)
    return ok


def apply_selectors(rows: DataFrame, run: RunSelectors, column: str = "selectors", drop: bool = False) -> DataFrame:
    """The rows that take part in the run; a missing selector column counts as blank."""
    if column not in rows.columns:
        rows = rows.withColumn(column, F.lit(None).cast("string"))
    kept = rows.filter(passes(F.col(column), run))
    return kept.drop(column) if drop else kept
