"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow
network leads from the patterns, through one arc per repetition whose cost rises with the
repetition, to the quotas of the sources; so few repetitions are used and those are spread. The
flow is solved on the driver over the patterns, at most one per set of sources whatever the number of
documents. Each pattern's documents are then put on a line in seeded order, as often as they may
be repeated, and the flow to each source takes a stretch of that line.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hash ranges over which the line of a pattern is added up; a range is the unit of one task.
RANGES = 4096


class _Network:
    """Maximum flow that can be raised again after arcs were added; levels and blocking flows, without recursion."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, room: int) -> int:
        i = len(self.to)
        self.to += [b, a]
        self.room += [room, 0]
        self.out[a].append(i)
        self.out[b].append(i + 1)
        return i

    def _levels(self, s: int, back: bool = False) -> list[int]:
        """How many arcs with room lead to each node from s, or from each node to s; -1 where none do."""
        level, todo = [-1] * len(self.out), deque([s])
        level[s] = 0
        while todo:
            a = todo.popleft()
            for i in self.out[a]:
                b = self.to[i]
                if level[b] < 0 and self.room[i ^ back] > 0:
                    level[b] = level[a] + 1
                    todo.append(b)
        return level

    def raise_flow(self, s: int, t: int) -> int:
        """What could be added to the flow from s to t."""
        added = 0
        while (level := self._levels(s))[t] >= 0:
            turn, way, a = [0] * len(self.out), [], s
            while True:
                if a == t:
                    push = min(self.room[i] for i in way)
                    added += push
                    for i in way:
                        self.room[i] -= push
                        self.room[i ^ 1] += push
                    cut = next(k for k, i in enumerate(way) if not self.room[i])
                    a = self.to[way[cut] ^ 1]
                    del way[cut:]
                    continue
                arcs = self.out[a]
                while turn[a] < len(arcs) and not (self.room[arcs[turn[a]]] > 0 and level[self.to[arcs[turn[a]]]] == level[a] + 1):
                    turn[a] += 1
                if turn[a] < len(arcs):
                    way.append(arcs[turn[a]])
                    a = self.to[way[-1]]
                elif way:
                    a = self.to[way.pop() ^ 1]
                    turn[a] += 1
                else:
                    break
        return added


@dataclass
class Plan:
    """total tokens; quota by source; flow by (pattern, source)."""

    total: int
    quota: dict[str, int]
    flow: dict[tuple[tuple[str, ...], str], int]


def _route(sizes: dict, repeats: dict[str, int], quota: dict[str, int]) -> tuple[int, dict, set[str]]:
    """Tokens that reach the quotas at the least cost, by (pattern, source), and the sources that no more can reach.

    Costs lie on the repetitions alone, and a way through the network uses one; so the
    cheapest flow is that of the first passes raised by the second ones, and so on.
    """
    net, ways = _Network(), {}
    start, end = net.node(), net.node()
    at = {s: net.node() for s in quota}
    for s, q in quota.items():
        net.arc(at[s], end, q)
    patterns = {p: net.node() for p in sizes}
    # no document more often than the strictest of its sources allows
    most = {p: min(repeats[s] for s in p) for p in sizes}
    for p, a in patterns.items():
        for s in p:
            ways[p, s] = net.arc(a, at[s], sizes[p] * most[p])
    got = 0
    for turn in range(max(most.values(), default=0)):
        for p, a in patterns.items():
            if turn < most[p]:
                net.arc(start, a, sizes[p])
        got += net.raise_flow(start, end)
    leads = net._levels(end, back=True)
    return got, {k: net.room[i ^ 1] for k, i in ways.items() if net.room[i ^ 1]}, {s for s, n in at.items() if leads[n] >= 0}


def plan_mixture(sizes: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> Plan:
    """Tokens from each pattern to each source.

    sizes: tokens by sorted pattern, of sources that have a share and may be used at least once.
    Sources without documents get nothing, and the shares of the others are scaled to add up to
    1. total is the wished size; by default, and at most, the largest for which every quota can
    be met. Without usable documents the plan is empty.

    The largest size is found from above: sources that a flow leaves short show the set of
    sources whose documents are too few, and the size at which these would suffice is tried next.
    Each try rules out a set, so there are about as many as sources.
    """
    sizes = {p: n for p, n in sizes.items() if n > 0}
    present = {s: Fraction(shares[s]) for p in sizes for s in p}
    whole = sum(present.values())

    def most(sources: set[str]) -> int:
        """The size at which these sources use up all documents they can."""
        held = sum(n * min(repeats[s] for s in p) for p, n in sizes.items() if sources & set(p))
        return int(held * whole / sum(present[s] for s in sources))

    if not sizes:
        return Plan(0, {}, {})
    size = most(set(present)) if total is None else min(total, most(set(present)))
    while True:
        quota = {s: int(size * w / whole) for s, w in sorted(present.items())}
        got, flow, short = _route(sizes, repeats, quota)
        if got == sum(quota.values()):
            return Plan(size, quota, flow)
        size = min(size - 1, most(short))


def mix(docs: DataFrame, shares: dict[str, float], repeats: dict[str, int], seed: int = 0, total: int | None = None) -> tuple[DataFrame, Plan]:
    """(id, source, copies, tokens) of the mixture of docs (id, sources, tokens), and its plan.

    sources is an array. Sources without share or allowed repeats, null sources and documents
    without tokens or sources take no part. A document occurs in a mixture at most as often as
    the strictest of its sources allows; each source meets its quota to within one document per
    pattern. The choice follows a seeded hash of the id, equal hashes by id. Ids are unique.
    """
    usable = [s for s in shares if shares[s] > 0 and repeats.get(s, 0) > 0]
    pattern = F.array_sort(F.array_distinct(F.filter("sources", lambda x: x.isin(usable))))
    hashed = F.xxhash64(F.col("id"), F.lit(seed))
    rows = docs.select("id", "tokens", pattern.alias("pattern"), hashed.alias("h")).where((F.col("tokens") > 0) & (F.size("pattern") > 0))
    rows = rows.withColumn("range", F.pmod(F.shiftrightunsigned("h", 40), F.lit(RANGES)))
    sums = rows.groupBy("pattern", "range").agg(F.sum("tokens").alias("n"))
    sizes = {tuple(r["pattern"]): int(r["n"]) for r in sums.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    plan = plan_mixture(sizes, shares, repeats, total)
    # each source takes the next stretch of its patterns' lines
    stretches, at = [], {}
    for (p, s), n in sorted(plan.flow.items()):
        stretches.append((list(p), s, at.get(p, 0), at.get(p, 0) + n, sizes[p]))
        at[p] = at.get(p, 0) + n
    spark = docs.sparkSession
    taken = spark.createDataFrame(stretches, "pattern array<string>, source string, lo long, hi long, size long")
    before = sums.select("pattern", "range", (F.sum("n").over(Window.partitionBy("pattern").orderBy("range")) - F.col("n")).alias("base"))
    here = F.sum("tokens").over(Window.partitionBy("pattern", "range").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("within", F.coalesce(here, F.lit(0))).join(before, ["pattern", "range"]).select("id", "tokens", "pattern", (F.col("base") + F.col("within")).alias("o"))
    # the passes r for which lo <= r * size + o < hi
    upto = lambda x: F.greatest(F.lit(0), F.ceil((F.col(x) - F.col("o")) / F.col("size"))).cast("int")
    copies = (upto("hi") - upto("lo")).alias("copies")
    return placed.join(taken, "pattern").select("id", "source", copies, "tokens").where("copies > 0"), plan
