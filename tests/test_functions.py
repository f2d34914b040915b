import pytest
from pyspark.sql import functions as F

from slotweave.functions import exprs, names, selectors
from slotweave.operators import reshape


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("ops, value, wanted", [
    (["lowercase"], "AbC", "abc"), (["alpha_numeric_underscore", "single_underscores"], "a--b", "a_b"), (["trim_trailing_underscores"], "a__", "a"),
    ([{"remove_chars": "xy"}], "axbyc", "abc"), ("uppercase", "ab", "AB"), (["lowercase"], "_extra_X", "_extra_X"), ([], "A", "A"),
])
def test_format_slot(spark, ops, value, wanted):
    assert one(spark, lambda c: names.format_slot(c, ops), value) == wanted


def test_unknown_operation():
    with pytest.raises(ValueError):
        names._format(None, "sideways")


def test_cells(spark):
    assert one(spark, names.variable_reference, "{{ a }}") == "a"
    assert one(spark, names.variable_reference, "a") is None
    assert one(spark, names.empty_sentinel, "<empty>") == ""
    assert one(spark, names.cut_class_name, "Measure [1](2)") == "Measure "
    assert one(spark, names.class_of_file, "/a.b/site[0].x.csv") == "site"
    assert one(spark, names.parse_integer, " 12 ") == 12
    assert one(spark, names.parse_float, "x") is None
    assert one(spark, names.strip, "  a\t") == "a"
    assert one(spark, reshape.select_and_value, "(A & B)") == "A"


@pytest.mark.parametrize("row, run, kept", [
    (None, ["b"], True), ("", ["!b"], True), ("amr", [], False), ("amr", ["amr"], True), ("b,c", ["c"], True), ("b", ["!b"], False), ("!b", ["b"], False), ("!b", [], True),
    ("core>=3.0,core<=3.1", ["core=3.0.5"], True), ("core>=3.0,core<=3.1", ["core=3.2"], False), ("core~=2.1", ["core=2.4"], True), ("core~=2.1", ["core=3.0"], False), ("core>3", [], False), ("core!=3", ["core=3.0"], False),
    ("core>=3.0", ["core=3.0rc1"], False), ("core<4", ["core=3.0.dev1"], False), ("b", ["b", "core=3.0rc1"], True), ("core>=3.0", ["core=3.0.post1"], True), ("core>3.0", ["core=3.0.post1"], False), ("core==3.0", ["core=3.0.post1"], False), ("core==3.0", ["core=v3.0+local.1"], True),
    ("core<1.2.3.4.5.6.7.8.9", ["core=1.2.3.4.5.6.7.8.8"], True), ("core<1.2.3.4.5.6.7.8.9", ["core=1.2.3.4.5.6.7.8.9"], False), ("core==3.0.*", ["core=3.0.7"], True), ("core==3.0.*", ["core=3.1"], False), ("core!=3.0.*", ["core=3.0.7"], False), ("core>=1!2.0", ["core=5.0"], False), ("core>=1!2.0", ["core=1!2.1"], True), ("core===3.0", ["core=3.0"], True), ("core===3.0", ["core=3"], False),
    ("core>=3.0rc1", ["core=3.0rc2"], True), ("core>=3.0rc2", ["core=3.0rc1"], False), ("core >= 3.0 beta text", ["core=3.0"], True), ("core~=2.1.4", ["core=2.1.9"], True), ("core~=2.1.4", ["core=2.2"], False),
])
def test_selectors(spark, row, run, kept):
    assert one(spark, lambda c: selectors.passes(c, selectors.parse_run(run)), row) is kept


def test_versions_that_are_none(spark):
    with pytest.raises(ValueError):
        one(spark, lambda c: selectors.passes(c, selectors.parse_run(["core=new"])), "core>=3")
    with pytest.raises(Exception, match="invalid version condition"):
        one(spark, lambda c: selectors.passes(c, selectors.parse_run(["core=3.1"])), "core~=3")


def test_expressions(spark):
    assert exprs.slots_in("case((src.a.strip() == 'x', src.b), (True, src.a))") == ["a", "b"]
    assert one(spark, lambda c: exprs.to_column("'n' if src.c == 'a' else src.c", lambda n: c), "a") == "n"
    for bad in ("__import__('os')", "src.c.split(',')", "[x for x in y]"):
        with pytest.raises(ValueError):
            exprs.to_column(bad, lambda n: F.lit(1))


def test_expand_multi_rows(spark):
    rows = spark.createDataFrame([(1, "a;b;c", "x;y", "z"), (2, "d", None, "w")], "k int, a string, b string, c string")
    out = sorted((r["k"], r["_place"], r["a"], r["b"]) for r in reshape.expand_multi_rows(rows, ["a", "b"]).collect())
    assert out == [(1, 0, "a", "x"), (1, 1, "b", "y"), (1, 2, "c", "y"), (2, 0, "d", None)]
