"""Statement expressions: each program against the same text run as Python here, over rows with nulls and odd texts."""

import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from slotweave.functions import exprs, statements
from slotweave.functions.statements import Refused

DDL = "name string, other string, n long, x double, ok boolean, tags array<string>, day date"
ROWS = [
    ("Ada Lovelace", "yes", 3, 1.5, True, ["a", "b"]), ("Ada", "", 0, -2.25, False, []), ("  Jean Luc  Picard ", "no", -7, 0.0, None, ["b"]), ("", None, 12, 1e3, True, ["c", "a", "b"]), ("a.b.c", "A.B", 5, 2.5, False, ["x"]),
    ("É Ü\tz", "yes", 100, 3.5, True, ["", "q"]), (" x", "007", 2, 0.5, False, ["z"] * 4), ("42", "-3", 1, -0.5, True, ["a"]),
]
RAISED = object()
NULLS = (None, None, None, None, None, None)

GET_NAME = """
def get_name(full_name, get_first):
    names = full_name.strip().rsplit(" ", 1)
    idx = 0 if get_first else 1
    return names[idx] if len(names) > idx else ""
target = get_name(src.name, {0})
"""
PROGRAMS = {
    "first name": GET_NAME.format("True"),
    "last name": GET_NAME.format("False"),
    "a or b": "def a_or_b(a, b):\n    if a:\n        return a\n    if b:\n        return b\n    return ''\n\n\ntarget = a_or_b(src.other, src.name)",
    "or as a value": "x = src.other or src.name or 'none'\ntarget = x",
    "and as a value": "y = src.other and src.name\ntarget = y",
    "elif chain": "if src.n > 10:\n    size = 'big'\nelif src.n > 2:\n    size = 'mid'\n    size += '!'\nelif src.n < 0:\n    size = 'none'\nelse:\n    size = 'low'\ntarget = size",
    "reassigned": "target = src.name\nif src.ok:\n    target = target.upper()\nif src.n > 4:\n    target = target + '+' + str(src.n)\ntarget = target.strip()",
    "early return": "def f(a, b=2, c=3):\n    if a == 3:\n        if b == 2:\n            return 'three two'\n        return 'three'\n    if a > c:\n        d = a - c\n    else:\n        return 'low'\n    return 'over ' + str(d)\ntarget = f(src.n, c=1)",
    "function of functions": "def half(v):\n    return v / 2\n\ndef both(v, w):\n    return half(v) + half(w)\ntarget = both(src.n, src.x)",
    "closure sees later names": "k = 1\ndef f(a):\n    return a * k\nif src.ok:\n    k = 5\n    r = f(src.n)\nelse:\n    r = f(src.n) - 1\ntarget = r",
    "arithmetic": "a = src.n * 2 - 1\na -= 3\ntarget = a % 4 + a // 3 + (-a) % 5",
    "negative modulus": "target = src.n % -4\npass",
    "division": "target = 10 / src.n\npass",
    "sums of tests": "target = (src.other == 'yes') + (src.ok == True) + src.ok == 1\npass",
    "comparison chain": "target = 0 < src.n <= 5 < 100\npass",
    "membership": "target = src.other in ('yes', 'no') or 'b' in src.tags or 'v' in src.name\npass",
    "not in": "target = src.other not in ['yes', ''] and src.n not in (1, 2)\npass",
    "none": "if src.other is None:\n    target = 'nothing'\nelif src.other is not None and src.other == '':\n    target = 'blank'\nelse:\n    target = src.other",
    "left alone": "if src.n > 4:\n    target = 'set'",
    "lists": "parts = src.name.split('.')\nif len(parts) > 1:\n    target = parts[-1] + parts[0]\nelse:\n    target = '-'.join(src.tags)",
    "slices": "target = src.name[1:] + '|' + src.name[:2] + '|' + src.name[-2:] + '|' + src.name[1:3]\npass",
    "list slices": "target = '/'.join(src.tags[1:]) + ':' + '/'.join(src.tags[:-1])\npass",
    "unpacked": "a, b = src.n, src.x\na, b = b, a\ntarget = a - b",
    "dictionary": "target = {'yes': 'Y', 'no': 'N'}.get(src.other, '?') + {True: 'T', False: 'F'}.get(src.ok, '?')\npass",
    "texts of values": "target = f'{src.n}/{src.ok}/{src.other}'\npass",
    "str of a number": "target = str(src.n) + ',' + str(src.x > 1)\npass",
    "methods": "target = src.name.lower().replace('a', '(a)').lstrip().rstrip()\npass",
    "splits": "target = '|'.join(src.name.split()) + '#' + '|'.join(src.name.split(' ', 1)) + '#' + '|'.join(src.name.rsplit(' ', 2)) + '#' + '|'.join(src.name.rsplit('.'))\npass",
    "starts and ends": "target = src.name.startswith('A') or src.name.endswith(('c', 'e'))\npass",
    "digits": "target = src.other.zfill(3) if src.other is not None and src.other.isdigit() else 'x'\npass",
    "found": "target = src.name.find('a')\npass",
    "numbers": "target = abs(src.n) + max(src.n, 2, src.x) - min(1, src.n)\npass",
    "rounding": "target = round(src.x) * 10 + round(src.n / 4)\npass",
    "constants alone": "def pick(a, n):\n    return a.split(',')[n]\ntarget = pick('x,y,z', 1) + pick('x,y,z', -1).upper()",
    "case": "target = case((src.n > 3, 'big'), (src.ok, 'yes'), (True, 'no'))\npass",
    "nested tests": "if src.ok:\n    if src.n > 2:\n        v = 1\n    else:\n        v = 2\nelse:\n    if src.other:\n        v = 3\n    else:\n        v = 4\ntarget = v * 10 + v",
    "types meet as text": "if src.n > 2:\n    v = 'many'\nelse:\n    v = src.n\ntarget = str(v)",
}


def case(*pairs):
    return next((v for c, v in pairs if c), None)


def by_python(program, row):
    scope = {"src": SimpleNamespace(**dict(zip(["name", "other", "n", "x", "ok", "tags"], row, strict=True))), "case": case, "target": None}
    try:
        exec(program, scope)  # noqa: S102  the tests' own texts
    except (TypeError, AttributeError, IndexError, ZeroDivisionError, ValueError):
        return RAISED
    return scope["target"]


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


def test_programs(spark):
    rows = spark.createDataFrame([(k, *r, None) for k, r in enumerate([*ROWS, NULLS])], f"k int, {DDL}")
    found = rows.select("k", *(exprs.slot_expression(p, rows.schema).alias(f"p{i}") for i, p in enumerate(PROGRAMS.values()))).orderBy("k").collect()
    for i, (name, program) in enumerate(PROGRAMS.items()):
        for k, row in enumerate(ROWS):
            wanted = by_python(program, row)
            assert wanted is RAISED or same(found[k][f"p{i}"], wanted), (name, row, found[k][f"p{i}"], wanted)


@pytest.mark.parametrize(("name", "wanted"), [("a or b", ""), ("none", "nothing"), ("elif chain", "low"), ("first name", ""), ("left alone", None), ("texts of values", "None/None/None"), ("membership", False), ("division", None), ("arithmetic", None), ("sums of tests", False), ("slices", None), ("unpacked", None), ("found", None)])
def test_rows_of_nulls(spark, name, wanted):
    rows = spark.createDataFrame([(*NULLS, None)], DDL)
    assert rows.select(exprs.slot_expression(PROGRAMS[name], rows.schema).alias("v")).first()["v"] == wanted


def test_statements_make_plain_columns(spark):
    rows = spark.createDataFrame([(*ROWS[0], None)], DDL)
    plan = rows.select(*(exprs.slot_expression(p, rows.schema).alias(f"p{i}") for i, p in enumerate(PROGRAMS.values())))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


@pytest.mark.parametrize(("text", "why"), [
    ("for a in src.tags:\n    target = a", "for a in"), ("while True:\n    target = 1", "while"), ("import os\ntarget = os.getcwd()", "import"), ("target = open('x')\npass", "open"), ("target = src.name.__class__\npass", "not allowed"),
    ("target = src.name.format('x')\npass", "format"), ("target = [t for t in src.tags]\npass", "not allowed"), ("target = (lambda a: a)(1)\npass", "lambda"), ("def f(a):\n    return f(a)\ntarget = f(src.n)", "too often"),
    ("if src.ok:\n    v = 1\ntarget = v", "not assigned on every way"), ("target = v\npass", "unknown name"), ("target = src.nothing\npass", "no source slot"), ("src = 1\ntarget = 2", "not assigned in statements"), ("src.name = 1\ntarget = 2", "not assigned"),
    ("target = 'a' * 1000000000\npass", "times"), ("target = 'a'.zfill(10000000)\npass", "wide"), ("x = src.name\n" + "x = x + x\n" * 40 + "target = x", "operations"), ("try:\n    target = 1\nexcept Exception:\n    pass", "try"),
    ("global target\ntarget = 1", "global"), ("class A:\n    pass\ntarget = 1", "class"), ("def f(*a):\n    return a\ntarget = f(1)", "plain arguments"), ("def f(a):\n    return a\ntarget = f()", "other values"), ("del target\npass", "del"), ("target = eval('1')\npass", "eval"),
    ("with src as s:\n    target = 1", "with"), ("assert src.ok\ntarget = 1", "assert"), ("target = 2 ** 3\npass", "Pow"), ("target = src.tags + 1\npass", "number is needed"), ("raise ValueError\ntarget = 1", "raise"), ("a, b = 1, 2, 3\ntarget = a", "as many names"),
])
def test_refused(spark, text, why):
    rows = spark.createDataFrame([(*ROWS[0], None)], DDL)
    with pytest.raises(Refused, match=why):
        exprs.slot_expression(text, rows.schema)


def test_what_statements_are():
    assert statements.is_statements("target = 1") and statements.is_statements("def f():\n    pass") and not statements.is_statements("src.a + 1") and not statements.is_statements("'x'")
    assert exprs.slots_in(PROGRAMS["a or b"]) == ["other", "name"]


def test_dates_are_texts(spark):
    rows = spark.createDataFrame([(1,)], "k int").select(F.lit("2024-02-03").cast("date").alias("day"))
    assert rows.select(exprs.slot_expression("y = src.day.split('-')\ntarget = int(y[0]) + int(y[1])", rows.schema).alias("v")).first()["v"] == 2026
