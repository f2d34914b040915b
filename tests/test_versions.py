"""Version keys and conditions: cases from the public rules, and the public implementation of these rules where it is installed."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from slotweave.functions import versions

#: In order, by the public rules; versions of one line are equal.
ORDERED = [
    ["0.dev1", "0.0.dev1"], ["0.9"], ["1.dev0", "1.0.0.dev"], ["1.0.dev456"], ["1.0a1.dev1"], ["1.0a1", "1.0-alpha.1", "v1.a1", "1.0.ALPHA1"], ["1.0a2.dev456"], ["1.0a12.dev456"], ["1.0a12"], ["1.0b1.dev456"], ["1.0b2", "1.0_beta2"], ["1.0b2.post345.dev456"],
    ["1.0b2.post345"], ["1.0rc1.dev456"], ["1.0rc1", "1.0c1", "1.0-pre-1", "1.0preview1"], ["1.0rc1.post0", "1.0rc1-0"], ["1.0", "1", "1.0.0", "v1", " 1.0 "], ["1.0+abc.5"], ["1.0+abc.7"], ["1.0+abc.7.1"], ["1.0+5", "1+05"], ["1.0+10"], ["1.0.post456.dev34"],
    ["1.0.post456", "1.0-456", "1.0.rev456", "1r456"], ["1.0.1"], ["1.0.10"], ["1.1.dev1"], ["1.1"], ["1.2.3.4.5.6.7.8.9"], ["2"], ["10.0"], ["10.0.1"], ["1!0.1"], ["1!1.0"], ["2!0"],
]
NO_VERSIONS = ["", "x", "1.", "1..2", "1.0-", "1.0+", "a1", "1.0.foo", "1!", "1.0+a_", "01!", None]
CASES = [
    ("3.0", "==3.0.*", True), ("3.0.7", "==3.0.*", True), ("3.0rc1", "==3.0.*", True), ("3.1", "==3.0.*", False), ("3", "==3.0.*", True), ("3.0.7", "!=3.0.*", False), ("2!3.0", "==3.0.*", False), ("2!3.0.4", "==2!3.0.*", True), ("3.00.1", "==3.0.*", True), ("3.10", "==3.1.*", False),
    ("1.0+x", "==1.0", True), ("1.0+x", "==1.0+x", True), ("1.0", "==1.0+x", False), ("1.0+y", "!=1.0+x", True), ("1.0.post1", "==1.0", False), ("1.0.post1", "==1.0.*", True), ("1.7.1", ">1.7", True), ("1.7.0.post1", ">1.7", False), ("1.7+x", ">1.7", False), ("1.7.post2", ">1.7.post1", True),
    ("1.7rc1", "<1.7", False), ("1.6.9", "<1.7", True), ("1.7rc1", "<1.7rc2", True), ("1.7rc1", "<=1.7", True), ("1.7", ">=1.7.0", True), ("1!1.0", ">2.0", True), ("1!1.0", "<=1!1.0", True), ("2.4", "~=2.1", True), ("3.0", "~=2.1", False), ("2.1.9", "~=2.1.4", True), ("2.2", "~=2.1.4", False), ("2.3", "~=2.2.post3", True), ("2.2", "~=2.2.post3", False),
    ("1.0", "===1.0", True), ("1.0", "===1", False), ("wat", "===WAT", True), ("1.0", "=== 1.0 ", True), ("1.0", "~=1", None), ("1.0", "=1.0", None), ("1.0", ">=1.*", None), ("1.0", "==1.0.dev1.*", None), ("1.0a1", "==1.0a1.*", None), ("1.0", ">=1.0+x", None), ("x", ">=1.0", None), ("1.0", "", None), ("1.0", "==", None),
]


def rows(spark, pairs, ddl):
    return spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], f"k int, {ddl}").repartition(2)


def test_keys_are_in_order(spark):
    flat = [(v, k) for k, line in enumerate(ORDERED) for v in line]
    random.Random(1).shuffle(flat)
    found = rows(spark, flat, "v string, place int").select("place", "v", versions.version_key(F.col("v")).alias("key")).collect()
    places = {}
    for r in found:
        assert r["key"] is not None, r["v"]
        places.setdefault(bytes(r["key"]), set()).add(r["place"])
    assert all(len(p) == 1 for p in places.values()) and len(places) == len(ORDERED)
    assert [next(iter(places[k])) for k in sorted(places)] == list(range(len(ORDERED)))


def test_what_is_no_version(spark):
    found = rows(spark, [(v,) for v in NO_VERSIONS], "v string").select("v", versions.version_key(F.col("v")).alias("key")).collect()
    assert all(r["key"] is None for r in found)


def test_comparing_on_the_driver():
    for (i, one), (j, other) in itertools.product(enumerate(ORDERED), repeat=2):
        assert versions.compare(one[0], other[-1]) == (i > j) - (i < j)
    with pytest.raises(ValueError, match="not a version"):
        versions.compare("1.0", "x")


def test_conditions(spark):
    found = rows(spark, [c[:2] for c in CASES], "v string, c string").select("k", versions.meets(F.col("v"), F.col("c")).alias("met")).collect()
    assert {CASES[r["k"]]: r["met"] for r in found} == {c: c[2] for c in CASES}


def test_conditions_against_the_public_implementation(spark):
    specifiers, public = pytest.importorskip("packaging.specifiers"), pytest.importorskip("packaging.version")
    flat = [v.strip() for line in ORDERED for v in line] + ["3.0", "3.0.1", "3.0.5.post2", "3.0a1.post2", "3.1rc1", "1.0.post456+x", "1!3.0rc1"]
    bounds = ["1.0", "1", "1.0a1", "1.0.post456", "1.0rc1", "1.0.dev456", "3.0", "3.0.1", "1!1.0", "10.0.1", "0.9", "1.0b2.post345"]
    conditions = [f"{op}{b}" for op in ("==", "!=", "<=", ">=", "<", ">") for b in bounds] + [f"{op}{b}.*" for op in ("==", "!=") for b in ("1", "1.0", "3.0", "1!1", "10.0", "1.0.0.0")] + ["==1.0+abc.5", "!=1.0+abc.5", "~=1.0", "~=1.0.1", "~=3.0a1", "~=1!1.0", "~=1.0.post456", "===1.0", "===1.0RC1"]
    pairs = [(v, c) for v in flat for c in conditions]
    found = rows(spark, pairs, "v string, c string").select("k", versions.meets(F.col("v"), F.col("c")).alias("met"), versions.meets_all(F.col("v"), F.array("c")).alias("all")).collect()
    wrong = []
    for r in found:
        v, c = pairs[r["k"]]
        wanted = specifiers.Specifier(c).contains(public.Version(v) if not c.startswith("===") else v, prereleases=True)
        if r["met"] is not wanted:
            wrong.append((v, c, r["met"], wanted))
    assert not wrong, (len(wrong), sorted({(c, v) for v, c, *_ in wrong})[:30])


@pytest.mark.parametrize(("version", "conditions", "early", "wanted"), [
    ("3.0rc1", [">=2"], None, False), ("3.0rc1", [">=2"], True, True), ("3.0rc1", [">=3.0a1"], None, True), ("3.0rc1", [">=3.0a1"], False, False), ("3.0rc1", ["!=3.0rc2"], None, False), ("3.1", [">=3.0", "<=3.1"], None, True), ("3.1", [], None, True), ("3.1rc1", [], None, False), ("3.2", [">=3.0", "<=3.1"], None, False),
])
def test_sets_of_conditions(spark, version, conditions, early, wanted):
    row = spark.range(1).select(F.lit(version).alias("v"), F.array(*map(F.lit, conditions)).cast("array<string>").alias("c"))
    assert row.select(versions.meets_all(F.col("v"), F.col("c"), early).alias("m")).first()["m"] is wanted
