from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomtext.functions.values import key_to_double, number_key, time_key, value_key
from loomtext.operators.widetable import pivot_wide

ATTRIBUTES = [("P1", "item", True), ("P2", "quantity", True), ("P3", "string", False), ("P4", "time", True), ("P5", "item", False)]
SAME = lambda k: k
TYPED = {"item": SAME, "string": SAME, "time": SAME, "quantity": key_to_double}


def facts(spark, rows):
    return spark.createDataFrame(rows, "entity string, attr string, key string")


def brute(rows):
    got = defaultdict(lambda: defaultdict(set))
    for e, a, k in rows:
        if e is not None and k is not None and a in dict((x[0], 1) for x in ATTRIBUTES):
            got[e][a].add(k)
    return got


@pytest.mark.parametrize("block", [1, 2, 256])
def test_against_brute_force(spark, block):
    rows = [(f"Q{i % 7}", f"P{i % 6}", f"{i % 5}e{i % 2}") for i in range(200)] + [(None, "P1", "x"), ("Q1", None, "x"), ("Q1", "P1", None), ("hot", "P3", "a")] + [("hot", "P3", f"v{i}") for i in range(3000)]
    want = brute(rows)
    wide = pivot_wide(facts(spark, rows), ATTRIBUTES, TYPED, block).collect()
    assert {r["entity"] for r in wide} == set(want) and len(wide) == len(want)
    for r in wide:
        cells = want[r["entity"]]
        assert r["P1"] == (min(cells["P1"]) if cells["P1"] else None)
        assert (r["P3"] or []) == sorted(cells["P3"])
        assert r["conflicts"] == sorted(a for a in ("P1", "P2", "P4") if len(cells[a]) > 1)


def test_blocks_join_without_exchange(spark):
    """On the final adaptive plan, with blocks too large for a broadcast."""
    rows = spark.range(30000).select(F.concat(F.lit("Q"), F.col("id") % 3000).alias("entity"), F.concat(F.lit("P"), F.col("id") % 5 + 1).alias("attr"), F.concat(F.lit("v"), F.col("id")).alias("key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = pivot_wide(rows, [(a, "string", one) for a, _, one in ATTRIBUTES], TYPED, 2)
        assert df.count() == 3000
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    plan = plan[: plan.index("Initial Plan")]
    # two exchanges in each of three blocks, the gathering and the placing, and those of the entities; none above a join
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning") in (7, 8), plan


def test_thousands_of_attributes(spark):
    n = 3000
    rows = spark.range(20000).select(F.concat(F.lit("Q"), F.col("id") % 50).alias("entity"), F.concat(F.lit("A"), F.col("id") % n).alias("attr"), F.concat(F.lit("v"), F.col("id") % 7).alias("key"))
    got = pivot_wide(rows, [(f"A{i}", "string", True) for i in range(n)], TYPED)
    few = {r["entity"]: r for r in got.select("entity", "A0", "A61", "A62", "A2999", F.size("conflicts").alias("n")).collect()}
    want = defaultdict(set)
    for i in range(20000):
        want[f"Q{i % 50}", f"A{i % n}"].add(f"v{i % 7}")
    assert len(few) == 50
    for e, r in few.items():
        assert r["n"] == sum(len(v) > 1 for (x, _), v in want.items() if x == e)
        for a in ("A0", "A61", "A62", "A2999"):
            assert r[a] == (min(want[e, a]) if want[e, a] else None)


def test_empty(spark):
    wide = pivot_wide(facts(spark, []), ATTRIBUTES, TYPED)
    assert wide.count() == 0 and wide.columns == ["entity", "P1", "P2", "P3", "P4", "P5", "conflicts"]


def test_number_keys(spark):
    same = [("1,234.50", "1234.5"), ("1.3E+1", "13"), ("+5^^xsd:decimal", "5"), ("-0", "0"), ("0.10", "1e-1"), (" 12 ", "12.000"), ("100", "1E2"), ("12345678901234567890123456789012345678901", "12345678901234567890123456789012345678901.0")]
    for a, b in same:
        x, y = spark.createDataFrame([(a, b)], "a string, b string").select(number_key(F.col("a")), number_key(F.col("b"))).first()
        assert x is not None and x == y, (a, b)
    bad = ["1.2.3", "12,34", "--", "", "about a dozen", "1,5", None]
    assert [r[0] for r in spark.createDataFrame([(b,) for b in bad], "a string").select(number_key(F.col("a"))).collect()] == [None] * len(bad)


def test_time_keys(spark):
    rows = [("+1990-05-00T00:00:00Z", "+1990-05-00"), ("May 5, 1990", "+1990-05-05"), ("5 May 1990", "+1990-05-05"), ("1990-05-05T00:00:00Z^^xsd:dateTime", "+1990-05-05"), ("-0774-00-00T00:00:00Z", "-0774-00-00"), ("+0000-00-00T00:00:00Z", None), ("2001-13-45", None), ("2001-02-29", None), ("2000-02-29", "+2000-02-29"), ("early spring", None), ("May 0, 1990", None)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "a string").select(time_key(F.col("a"))).collect()
    assert [g[0] for g in got] == [b for _, b in rows]


def test_value_keys(spark):
    split, whole = "E" + chr(0x301) + "lbe", chr(0xC9) + "lbe"
    rows = [("item", "kb:q12 ", "Q12"), ("item", "http://kb.example.org/entity/Q12", "Q12"), ("item", "see text", None), ("item", "_:b3", None), ("string", f" {split}" + chr(0xA0), whole), ("string", "Unknown", None), ("string", "", None), ("other", "x", None), ("item", None, None)]
    got = spark.createDataFrame([(a, b) for a, b, _ in rows], "k string, v string").select(value_key(F.col("k"), F.col("v"))).collect()
    assert [g[0] for g in got] == [c for _, _, c in rows]
