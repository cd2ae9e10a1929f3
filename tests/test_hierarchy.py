import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

from loomtext.operators import closure
from loomtext.operators.closure import transitive_hull
from loomtext.operators.hierarchy import hierarchy


def run(spark, parents: dict[str, list]):
    df = spark.createDataFrame([(k, v, "x") for k, v in parents.items()] or [], "node string, up array<string>, id string")
    return hierarchy(df, "node", "up")


def brute(parents):
    """Nodes on a cycle; paths of each node, where a cycle node's path is itself."""
    up = {k: sorted({p for p in (v or []) if p in parents}) for k, v in parents.items()}

    def reach(a):
        seen, todo = set(), list(up[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up[x]
        return seen

    cyclic = {k for k in up if k in reach(k)}
    memo = {}

    def paths(k):
        if k not in memo:
            memo[k] = [(k,)] if k in cyclic or not up[k] else [(*p, k) for q in up[k] for p in paths(q)]
        return memo[k]

    return cyclic, {k: sorted(paths(k)) for k in up}


def check(spark, parents):
    h = run(spark, parents)
    cyclic, paths = brute(parents)
    got = {}
    for r in h.paths().collect():
        got.setdefault(r["id"], []).append(tuple(r["path"]))
    assert {r["id"] for r in h.cyclic.collect()} == cyclic
    assert {k: sorted(v) for k, v in got.items()} == paths
    rows = {r["id"]: r for r in h.summary().collect()}
    assert set(rows) == set(paths)
    for k, ways in paths.items():
        r = rows[k]
        assert (r["depth"], r["max_depth"], r["n_paths"]) == (min(map(len, ways)) - 1, max(map(len, ways)) - 1, len(ways)), k
        assert r["roots"] == sorted({w[0] for w in ways}) and r["on_cycle"] == (k in cyclic), k
    want = {}
    for k, ways in paths.items():
        for w in ways:
            for i, a in enumerate(w[:-1]):
                want[a, k] = min(want.get((a, k), len(w)), len(w) - 1 - i)
    below = [(r["id"], r["descendant"], r["distance"]) for r in h.descendants().collect()]
    assert len(below) == len(want) and {(a, b): d for a, b, d in below} == want


def test_random_graphs(spark):
    rng = random.Random(3)
    for n, extra in ((14, 0.05), (40, 0.03)):
        names = [f"n{i}" for i in range(n)]
        parents = {a: [names[rng.randrange(i)]] if i and rng.random() < 0.9 else [] for i, a in enumerate(names)}
        for a in names:
            if rng.random() < extra * 3:
                parents[a].append(rng.choice(names))
        check(spark, parents)


def test_long_chain_and_cycles(spark):
    parents = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(60)}
    parents |= {"a": ["b"], "b": ["c"], "c": ["a"], "d": ["a", "e"], "e": ["e"], "f": ["d"], "t": ["a", "top"], "top": [], "a2": ["d2"], "d2": ["a2", "b"]}
    check(spark, parents)


def test_nulls_repeats_missing_and_clashing_names(spark):
    parents = {"a": None, "b": ["a", "a", None, "gone"], "c": ["gone"], "d": []}
    h = run(spark, parents)
    rows = {r["id"]: r for r in h.summary().collect()}
    assert rows["b"]["depth"] == 1 and rows["b"]["missing"] == 1 and rows["b"]["roots"] == ["a"]
    assert rows["c"]["depth"] == 0 and rows["c"]["missing"] == 1
    assert rows["a"]["n_descendants"] == 1 and not rows["a"]["on_cycle"]


def test_empty(spark):
    h = run(spark, {})
    assert h.paths().count() == 0 and h.cyclic.count() == 0 and h.summary().count() == 0


def test_hot_parent(spark):
    parents = {"r": []} | {f"k{i}": ["r"] for i in range(500)}
    h = run(spark, parents)
    assert h.paths().where(F.size("path") == 2).count() == 500


def test_diamonds_without_listing_paths(spark):
    parents = {"a0": []}
    for i in range(40):
        parents |= {f"b{i}": [f"a{i}"], f"c{i}": [f"a{i}"], f"a{i + 1}": [f"b{i}", f"c{i}"]}
    h = run(spark, parents)
    assert len(h.rounds()) < 25
    rows = {r["id"]: r for r in h.summary().collect()}
    assert (rows["a40"]["depth"], rows["a40"]["n_paths"], rows["a40"]["roots"]) == (80, 2**40, ["a0"])
    assert rows["a0"]["n_descendants"] == 120 and rows["b0"]["n_descendants"] == 118
    far = run(spark, parents | {f"{x}{i}": [f"{y}{i - (x == 'a')}" for y in ys] for i in range(41, 70) for x, ys in (("a", "bc"),)} | {f"{x}{i}": [f"a{i}"] for i in range(40, 70) for x in "bc"})
    assert {r["id"]: r["n"] for r in far.reach().collect()}["a69"] is None


def lanes(n, width=2):
    return {f"{i}.{k}": [f"{(i + 1) % n}.{j}" for j in range(width)] for i in range(n) for k in range(width)}


def test_rings_take_few_tables(spark):
    written = []
    for n in (16, 256):
        h = run(spark, lanes(n))
        assert h.cyclic.count() == 2 * n
        written.append(h.work._n)
    assert written[1] < written[0] + 25, written


def test_cycles_that_hang_together(spark):
    """Rings joined by single links, ladders between them, and cycles with ways out at each node."""
    parents = lanes(5) | {f"x{k}": v for k, v in {f"{i}": [f"x{i - 1}"] for i in range(1, 9)}.items()} | {"x0": ["0.0"]}
    parents["y"] = ["x8", "y2"]
    parents |= {"y2": ["y"], "top": [], "0.0": ["1.0", "1.1", "top"]}
    parents |= {f"z{i}": [f"z{(i + 1) % 12}", "0.1"] for i in range(12)} | {"u": ["z3", "z7"], "v": ["u"], "w": ["v", "y"]}
    cyclic, _ = brute(parents)
    assert {r["id"] for r in run(spark, parents).cyclic.collect()} == cyclic
    rng = random.Random(5)
    for n, m in ((30, 45), (60, 80), (25, 70)):
        names = [f"n{i}" for i in range(n)]
        graph = {a: [] for a in names}
        for _ in range(m):
            graph[rng.choice(names)].append(rng.choice(names))
        cyclic, _ = brute(graph)
        assert {r["id"] for r in run(spark, graph).cyclic.collect()} == cyclic


def test_hull_of_a_long_chain_and_a_cycle(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [("x", None), ("a", "b"), ("b", "a")]
    got = {tuple(r) for r in transitive_hull(spark.createDataFrame(edges, "node string, parent string")).collect()}
    assert got == {(f"n{i}", f"n{j}") for i in range(60) for j in range(i + 1, 61)} | {("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")}
    short = transitive_hull(spark.createDataFrame(edges, "node string, parent string"), steps=2).collect()
    assert len(short) == 60 + 59 + 4


def test_hull_writes_and_shuffles_links_only(spark):
    """A tree of long ways with cycles and cross links, whose pairs are many more than its links."""
    rng = random.Random(3)
    parents = {f"c{i}": [f"c{i - 1}"] for i in range(1, 300)} | {f"leg{i}": [f"c{rng.randrange(300)}", f"c{rng.randrange(300)}"] for i in range(60)}
    parents |= {f"r{i}": [f"r{(i + 1) % 20}"] for i in range(20)} | {"c0": ["r3"], "one": ["one"], "r5": ["r6", "top"]}
    edges = [(a, b) for a, bs in parents.items() for b in bs] * 2
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root))
    hull = transitive_hull(spark.createDataFrame(edges, "node string, parent string"))
    pairs = [tuple(r) for r in hull.collect()]
    true = set()
    for a in parents:
        stack, seen = [a], set()
        while stack:
            new = [p for p in parents.get(stack.pop(), []) if p not in seen]
            seen.update(new)
            stack += new
        true |= {(a, b) for b in seen}
    assert len(pairs) == len(true) and set(pairs) == true
    written = [f"{root}/{d}/{t}" for d in set(os.listdir(root)) - before for t in os.listdir(f"{root}/{d}") if not t.startswith(".")]
    assert sum(spark.read.parquet(t).count() for t in written) <= 2 * len(set(edges)) + 1 < len(pairs) / 50
    assert "Exchange" not in hull._jdf.queryExecution().executedPlan().toString()


def test_hull_with_little_remembered_and_without_links(spark, monkeypatch):
    rng = random.Random(4)
    for n, m in ((40, 45), (40, 90), (200, 230)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        monkeypatch.setattr(closure, "BATCH", 7)
        links = closure.Links(pa.Table.from_batches(closure.numbered(pa.table(dict(zip(("node", "ancestor"), zip(*edges)))))))
        for kept, steps in ((1 << 20, None), (30, None), (0, None), (0, 3)):
            monkeypatch.setattr(closure, "KEPT", kept)
            got = [(r["node"], r["ancestor"]) for part in range(5) for b in links.pairs(links.sources(part, 5), steps) for r in b.to_pylist()]
            true, front = set(edges), set(edges)
            for _ in range(n if steps is None else steps - 1):
                front = {(a, d) for a, b in front for c, d in edges if b == c}
                true |= front
            assert len(got) == len(true) and set(got) == true
    empty = spark.createDataFrame([("a", None)], "node string, parent string")
    assert transitive_hull(empty).collect() == []
