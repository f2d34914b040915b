"""The longest of many names in a text, against looking for each."""

import random

import pytest

from slotweave.functions.automaton import Automaton, longest_of_many
from slotweave.operators import reshape


def by_force(text, names):
    hits = [n for n in names if text is not None and n.lower() in text.lower()]
    return max(hits, key=lambda n: (len(n), -names.index(n)), default=None)


@pytest.mark.parametrize("seed", range(4))
def test_against_every_name(seed):
    r = random.Random(seed)
    letters = "abAé" if seed % 2 else "abcdefgh"
    names = list(dict.fromkeys("".join(r.choices(letters, k=r.randrange(1, 7))) for _ in range(60)))
    texts = ["".join(r.choices(letters, k=r.randrange(0, 40))) for _ in range(300)] + [None, "", "ÀB" * 50]
    automaton = Automaton.of(names)
    found = automaton.names[automaton.longest([t.lower() if t is not None else None for t in texts])].tolist()
    assert found == [by_force(t, names) for t in texts]


def test_odd_lists():
    for names in ([], [""], ["", "a"], ["a", "A"], ["aa", "a", "aaa"]):
        automaton = Automaton.of(names)
        texts = ["", "b", "baab", None]
        assert automaton.names[automaton.longest(texts)].tolist() == [by_force(t, names) for t in texts]
    assert Automaton.of(["a"]).longest([]).tolist() == []


def test_fifty_thousand_names(spark):
    r = random.Random(7)
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_name")
    texts = {row["p_partkey"]: row["p_name"] for row in part.collect()}
    inside = list({t[a : a + r.randrange(2, 9)] for t in texts.values() for a in (0, 3, 5)})
    names = inside + list({"".join(r.choices("abcdefghijklmnopqrstuvwxyz #", k=r.randrange(3, 14))) for _ in range(50_000 - len(inside))})
    found = {row["p_partkey"]: row["c"] for row in longest_of_many(part, "p_name", names, "c").collect()}
    near = [n for n in names if any(n.lower() in t for t in set(texts.values()))]
    assert found == {k: by_force(t, near) for k, t in texts.items()} and len(names) > 49_000
    plan = longest_of_many(part, "p_name", names, "c")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and len(plan) < 5_000


def test_few_and_many_names_agree(spark, monkeypatch):
    rows = spark.createDataFrame([("Cold Id WIDGET",), ("cold",), ("",), (None,), ("x" * 100_000 + "widgets",)], "t string")
    names = ["id", "cold", "Widget", "idle"]
    few = [r["c"] for r in reshape.longest_contained(rows, "t", names, "c").collect()]
    monkeypatch.setattr(reshape, "MOST_TESTS", 1)
    assert [r["c"] for r in reshape.longest_contained(rows, "t", names, "c").collect()] == few == ["Widget", "cold", None, None, "Widget"]
    assert reshape.longest_contained(rows.limit(0), "t", names, "c").count() == 0
