"""Wildcard scopes: the same bindings as comparing every slot with every scope, in time that grows with both, not with their product."""

import random
import time

import pytest
from pyspark.sql import functions as F

from slotweave.operators import compile as compiler
from slotweave.operators.compile import SCOPE
from slotweave.sources.local import local_table, small_jobs
from slotweave.sources.metadata import Schema

SLOTS = "deriv_id int, source_class string, target_class string, target_slot string, kind string, source_slot string, ord long"
ENUMS = ", ".join(f"{c} string" for c in SCOPE) + ", target_enum string, source_enum string, settings map<string,string>, mirror_source boolean"


def schema(classes, slots):
    return Schema("x", {
        "classes": {f"c{k}": {"slots": [f"s{j}" for j in range(slots)]} for k in range(classes)},
        "slots": {f"s{j}": {"range": f"e{j % 3}"} for j in range(slots)}, "enums": {f"e{k}": {"permissible_values": {f"v{k}": {}}} for k in range(3)},
    })


def bind(spark, slots, enums, source):
    with small_jobs(spark):
        bindings, many = compiler.bind_enums(local_table(spark, slots, SLOTS), local_table(spark, enums, ENUMS), source)
        return bindings.collect(), many.collect()


def by_force(slots, enums):
    bound, many = {}, set()
    for deriv, sc, tc, ts, kind, ss, _ in slots:
        if kind != "copy":
            continue
        used = f"e{int(ss[1:]) % 3}"
        fits = [e for e in enums if e[5] == used and all(k in ("", v) for k, v in zip(e[:4], (sc, tc, ss, ts), strict=True))]
        if len(fits) > 1:
            many.add((deriv, ts))
        else:
            bound[deriv, ts, used] = (*fits[0][:5], False, ()) if fits else (None, None, None, None, f"{used}[=mirrored=]", True, (f"v{used[1]}",))
    return bound, many


@pytest.mark.parametrize("seed", range(3))
def test_same_bindings(spark, seed):
    r = random.Random(seed)
    slots = [(d, f"c{r.randrange(3)}", f"t{r.randrange(3)}", f"x{k}", r.choice(["copy", "copy", "expr"]), f"s{r.randrange(4)}", k) for d in range(12) for k in range(4)]
    scopes = {(r.choice(["", f"c{r.randrange(3)}"]), r.choice(["", f"t{r.randrange(3)}"]), r.choice(["", f"s{r.randrange(4)}"]), r.choice(["", f"x{r.randrange(4)}"]), f"e{r.randrange(3)}") for _ in range((6, 20, 60)[seed])}
    enums = [(*s[:4], f"target{k}", s[4], [], False) for k, s in enumerate(sorted(scopes))]
    bound, many = by_force(slots, enums)
    bindings, notes = bind(spark, slots, enums, schema(3, 4))
    found = {(b["deriv_id"], b["target_slot"], b["source_enum"]): (*(b[c] for c in SCOPE), b["target_enum"], b["mirror_source"], tuple(b["mirrored"] or ())) for b in bindings}
    assert found == bound and len(notes) == len(many) and {n["code"] for n in notes} <= {"E_AMBIGUOUS"}


def test_names_that_are_blank_or_repeat(spark):
    slots = [(0, "c0", "", "x", "copy", "s0", 0), (0, "c0", "", "x", "copy", "s0", 1)]
    bindings, notes = bind(spark, slots, [("c0", "", "", "", "t", "e0", [], False)], schema(1, 1))
    assert len(bindings) == 1 and bindings[0]["target_enum"] == "t" and not notes


def many_scopes(n_slots, n_enums):
    slots = [(k, f"c{k % 50}", "t", f"x{k}", "copy", f"s{k % 40}", k) for k in range(n_slots)]
    enums = [(f"c{k % 50}" if k % 2 else "", "", f"s{k % 40}", f"x{k}", f"target{k}", f"e{k % 40 % 3}", [], False) for k in range(n_enums)]
    return slots, enums


def test_no_slot_is_compared_with_every_scope(spark):
    slots, enums = many_scopes(200, 400)
    bindings, _ = compiler.bind_enums(local_table(spark, slots, SLOTS), local_table(spark, enums, ENUMS), schema(50, 40))
    plan = bindings._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_hundred_thousand_scopes(spark):
    slots, enums = many_scopes(10_000, 100_000)
    began = time.time()
    bindings, many = compiler.bind_enums(local_table(spark, slots, SLOTS), local_table(spark, enums, ENUMS), schema(50, 40))
    assert bindings.filter(F.col("target_enum") == F.concat(F.lit("target"), F.substring("target_slot", 2, 9))).count() == 10_000 and many.count() == 0
    assert time.time() - began < 120  # all pairs would be 10**9
