import itertools
import random
import time

from pyspark.sql import functions as F

from loomtext.llm.mixture import mix, plan_mixture


def test_plan_reaches_shares_with_few_repeats():
    plan = plan_mixture({("a",): 100, ("b",): 1000}, {"a": 0.5, "b": 0.5}, {"a": 3, "b": 1})
    assert plan.total == 600 or plan.total == 601
    assert plan.flow[("a",), "a"] == 300
    plan = plan_mixture({("a",): 10, ("b",): 10, ("a", "b"): 20}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1})
    assert sum(plan.flow.values()) == 40 and plan.quota == {"a": 20, "b": 20}
    assert plan_mixture({}, {"a": 1.0}, {"a": 1}).flow == {}
    assert plan_mixture({("a",): 50}, {"a": 0.4, "none": 0.6}, {"a": 2, "none": 1}, total=70).quota == {"a": 70}


def brute(sizes, shares, repeats):
    """The largest size by trying all sets of sources."""
    present = sorted({s for p in sizes for s in p})
    whole = sum(shares[s] for s in present)
    return min(sum(n * min(repeats[x] for x in p) for p, n in sizes.items() if set(p) & set(c)) * whole / sum(shares[s] for s in c) for k in range(1, len(present) + 1) for c in itertools.combinations(present, k))


def test_overlapping_sources_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        names = "abcde"[: rng.randint(2, 5)]
        sizes = {tuple(sorted(rng.sample(names, rng.randint(1, len(names))))): rng.randint(1, 1000) for _ in range(rng.randint(1, 8))}
        shares, repeats = {s: rng.randint(1, 9) / 10 for s in names}, {s: rng.randint(1, 4) for s in names}
        plan = plan_mixture(sizes, shares, repeats)
        assert abs(plan.total - brute(sizes, shares, repeats)) <= 1
        assert {s: sum(n for (_, x), n in plan.flow.items() if x == s) for s in plan.quota} == plan.quota
        for p, n in sizes.items():
            assert sum(m for (q, _), m in plan.flow.items() if q == p) <= n * min(repeats[s] for s in p)


def test_repeats_are_spread():
    # b alone can serve b, so a's second pass is needed only for what a lacks
    plan = plan_mixture({("a",): 100, ("a", "b"): 100, ("b",): 100}, {"a": 0.5, "b": 0.5}, {"a": 3, "b": 3}, total=300)
    used = {p: sum(n for (q, _), n in plan.flow.items() if q == p) for p in [("a",), ("a", "b"), ("b",)]}
    assert used == {("a",): 100, ("a", "b"): 100, ("b",): 100}


def test_thousands_of_patterns():
    rng = random.Random(6)
    names = [f"s{i}" for i in range(40)]
    sizes = {tuple(sorted(rng.sample(names, rng.randint(1, 4)))): rng.randint(1, 10**9) for _ in range(20000)}
    began = time.time()
    plan = plan_mixture(sizes, {s: rng.random() for s in names}, {s: rng.randint(1, 5) for s in names})
    assert time.time() - began < 120 and sum(plan.flow.values()) == sum(plan.quota.values())


def docs(spark, n=3000):
    rng = random.Random(1)
    rows = [(i, [["a"], ["b"], ["a", "b"], ["c"]][rng.choices(range(4), (60, 20, 10, 10))[0]], rng.randint(0, 30)) for i in range(n)]
    rows += [(n, None, 5), (n + 1, [], 5), (n + 2, ["other", None], 5), (n + 3, ["a", "a"], 7)]
    return rows, spark.createDataFrame(rows, "id long, sources array<string>, tokens long")


def test_mixture(spark):
    rows, df = docs(spark)
    repeats = {"a": 2, "b": 3, "c": 4}
    mixed, plan = mix(df, {"a": 0.3, "b": 0.3, "c": 0.4}, repeats, seed=3)
    got = mixed.collect()
    member = {i: set(s or []) for i, s, _ in rows}
    total = sum(r["copies"] * r["tokens"] for r in got)
    for s, share in (("a", 0.3), ("b", 0.3), ("c", 0.4)):
        assert abs(sum(r["copies"] * r["tokens"] for r in got if r["source"] == s) - plan.quota[s]) <= 60
        assert abs(sum(r["copies"] * r["tokens"] for r in got if r["source"] == s) / total - share) < 0.01
    times = {}
    for r in got:
        assert r["source"] in member[r["id"]] and r["tokens"] > 0
        times[r["id"]] = times.get(r["id"], 0) + r["copies"]
    assert all(n <= min(repeats[s] for s in member[i] if s in repeats) for i, n in times.items())
    again = mix(df.repartition(7), {"a": 0.3, "b": 0.3, "c": 0.4}, repeats, seed=3)[0].collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_nothing_to_mix(spark):
    _, df = docs(spark, 5)
    assert mix(df, {"z": 1.0}, {"z": 2})[0].count() == 0
    assert mix(df.where(F.lit(False)), {"a": 1.0}, {"a": 2})[0].count() == 0
