"""Synonym clusters of values, and greedy one-to-one matching."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import ratio
from loomtext.workspace import Workspace


def edit_distance(a: str, b: str) -> float:
    """0 for equal strings, 1 for strings with nothing in common."""
    return 1.0 - ratio(a.lower(), b.lower()) / 100.0


def agglomerate(values: list[str], limit: float, linkage: str = "complete", distance: Callable[[str, str], float] = edit_distance) -> list[int]:
    """Cluster numbers of values, merged while the closest clusters are within limit; ties by order of the values."""
    n = len(values)
    d = np.full((n, n), np.inf)
    for i in range(n):
        for j in range(i + 1, n):
            d[i, j] = d[j, i] = distance(values[i], values[j])
    size, label = np.ones(n), list(range(n))
    alive = np.ones(n, bool)
    while alive.sum() > 1:
        masked = np.where(alive[:, None] & alive[None, :], d, np.inf)
        i, j = divmod(int(masked.argmin()), n)
        if masked[i, j] > limit:
            break
        i, j = min(i, j), max(i, j)
        joined = np.maximum(d[i], d[j]) if linkage == "complete" else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = joined, joined
        d[i, i] = np.inf
        size[i] += size[j]
        alive[j] = False
        label = [i if x == j else x for x in label]
    return label


def representative(values: list[str]) -> str:
    """The spelling with the fewest `#`, then the longest, then the first in order."""
    return min(values, key=lambda v: (v.count("#"), -len(v), v))


@lru_cache(maxsize=65536)
def _common(a: int, b: int, limit: float) -> int:
    """How many characters strings of lengths a and b must share to be within limit."""
    return math.ceil((1 - limit) * (a + b) / 2 - 1e-9)


@lru_cache(maxsize=65536)
def _prefix(n: int, limit: float, q: int) -> int:
    """How many of its rarest grams a string of length n must show so that every string within limit shares one of them."""
    partners = [n]
    while partners[-1] and _common(n, partners[-1] - 1, limit) <= partners[-1] - 1:
        partners.append(partners[-1] - 1)
    longer = n + 1
    while _common(n, longer, limit) <= n:
        partners.append(longer)
        longer += 1
    least = min(_common(n, m, limit) if q == 1 else 3 * _common(n, m, limit) + 1 - n - m for m in partners)
    return n + q - 1 - least + 1


def _grams(low: str, q: int) -> list[str]:
    """Characters, or pairs with the ends marked, each with its number among equal ones."""
    whole, seen, out = low if q == 1 else f"\x02{low}\x03", Counter(), []
    for i in range(len(whole) - q + 1):
        g = whole[i : i + q]
        out.append(f"{g}{seen[g]}")
        seen[g] += 1
    return out


def near_values(forms: DataFrame, limit: float) -> DataFrame:
    """(a, b, d): all pairs a < b of the nodes of forms (node, low) whose lower-case forms are within a limit below 1.

    Equal characters stand in the same order in both strings, and each of the others parts at most
    one pair of these, so with their ends marked strings share 3 c + 1 - |a| - |b| of their pairs of
    neighbours, c being the equal characters needed. Above a limit of a third, single characters
    are counted. Grams are ordered from rare to common and only the prefix in which two such strings
    must meet is joined; what is left is measured.
    """
    q = 2 if limit <= 1 / 3 else 1

    @F.pandas_udf("n int, p int, grams array<string>")
    def parts(low: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(x) for x in low], "p": [_prefix(len(x), limit, q) for x in low], "grams": [_grams(x, q) for x in low]})

    @F.pandas_udf("double")
    def measured(a: pd.Series, b: pd.Series) -> pd.Series:
        bound = [1 - SequenceMatcher(None, x, y, autojunk=False).quick_ratio() for x, y in zip(a, b)]
        return pd.Series([edit_distance(x, y) if least <= limit + 1e-9 else 1.0 for x, y, least in zip(a, b, bound)], dtype="float64")

    work = Workspace(forms.sparkSession, "near")
    # a written table, so that the grams are made once
    forms = work.keep(forms.select("node", "low", parts("low").alias("r")).select("node", "low", "r.*"), "grams")
    each = forms.select("node", "n", "p", F.explode("grams").alias("g"))
    counts = each.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    # a gram that one value alone has comes first and meets nothing; it counts in the prefix all the same
    shared = each.join(counts, "g").groupBy("node", "n", "p").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("s"))
    ranked = shared.select("node", "n", (F.col("n") + q - 1).alias("m"), "p", F.posexplode("s").alias("i", "x"), F.size("s").alias("k"))
    ranked = ranked.select("node", "n", "m", "p", (F.col("i") + F.col("m") - F.col("k")).alias("i"), F.col("x.g").alias("g")).where("i < p")
    left, right = (ranked.select("g", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "m", "i")]) for side in "ab")
    common = F.ceil((1 - limit) * (F.col("n_a") + F.col("n_b")) / 2 - 1e-9)
    grams = common if q == 1 else 3 * common + 1 - F.col("n_a") - F.col("n_b")
    fits = (F.col("node_a") < F.col("node_b")) & (F.least("n_a", "n_b") >= common) & (F.col("m_a") - F.col("i_a") >= grams) & (F.col("m_b") - F.col("i_b") >= grams)
    pairs = left.join(right, "g").where(fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    low = lambda c: forms.select(F.col("node").alias(c), F.col("low").alias(f"low_{c}"))
    return work.keep(pairs.join(low("a"), "a").join(low("b"), "b").select("a", "b", measured("low_a", "low_b").alias("d")), "measured").where(F.col("d") <= limit)


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the least node that edges (a, b) connect a node with."""
    work = Workspace(edges.sparkSession, "connected")
    both = work.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    label = work.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "label")
    while True:
        seen = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("next"))
        nearer = label.join(seen, "node").select("node", "comp", F.least("comp", "next").alias("next"))
        # the label of the label halves the way to the least node
        jump = nearer.join(label.select(F.col("node").alias("next"), F.col("comp").alias("beyond")), "next").select("node", "comp", F.least("next", "beyond").alias("next"))
        moved, n = work.measure(jump, n=F.col("next") < F.col("comp"))
        label = moved.select("node", F.col("next").alias("comp"))
        if not n["n"]:
            return label


def complete_linkage(edges: list[tuple[str, str, float]]) -> dict[str, str]:
    """As agglomerate with complete linkage, from the pairs (a, b, distance) within the limit alone: node to the first node of its cluster.

    A pair that isn't there keeps two clusters apart for good, so the work and memory follow the pairs.
    """
    near: dict[str, dict[str, float]] = {}
    for a, b, d in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = d
    heap, head = [(d, a, b) for a, b, d in edges], {x: [x] for x in near}
    heapq.heapify(heap)
    while heap:
        d, a, b = heapq.heappop(heap)
        if a not in near or near[a].get(b) != d:
            continue
        first, second = near[a], near.pop(b)
        for x in second:
            near[x].pop(b)
        head[a] += head.pop(b)
        for x in list(first):
            if x not in second:
                first.pop(x)
                near[x].pop(a)
            elif second[x] > first[x]:
                first[x] = near[x][a] = second[x]
                heapq.heappush(heap, (second[x], min(a, x), max(a, x)))
    return {x: a for a, xs in head.items() for x in xs}


def cluster_values(df: DataFrame, value: str, limit: float = 0.2, linkage: str = "complete") -> DataFrame:
    """(value, rep): each distinct non-null value with the representative of its cluster.

    All pairs within limit are found by an exact filter, and values are clustered within the groups
    that such pairs connect: no cluster reaches beyond one. Values equal but for case are one from
    the start. Complete linkage holds the pairs of one group in a task, average linkage all its
    distances. Runs Spark jobs when called.
    """

    @F.pandas_udf("string")
    def lower(v: pd.Series) -> pd.Series:
        return pd.Series([x.lower() for x in v], dtype="object")

    work = Workspace(df.sparkSession, "cluster")
    values = work.keep(df.select(F.col(value).cast("string").alias("value")).where("value is not null").distinct().select("value", lower("value").alias("low")), "values")
    if limit >= 1:
        heads = values.select("value", F.lit("").alias("head"))
    else:
        forms = work.keep(values.groupBy("low").agg(F.min("value").alias("node")), "forms")
        edges = near_values(forms, limit)
        comp = connected(edges)
        if linkage == "complete":

            def merge(pdf: pd.DataFrame) -> pd.DataFrame:
                got = complete_linkage(list(zip(pdf["a"], pdf["b"], pdf["d"])))
                return pd.DataFrame({"node": list(got), "head": list(got.values())})

            merged = edges.join(comp.withColumnRenamed("node", "a"), "a").groupBy("comp").applyInPandas(merge, "node string, head string")
            heads = values.join(forms, "low").join(merged, "node", "left").select("value", F.coalesce("head", "node").alias("head"))
        else:

            def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
                v = sorted(pdf["value"])
                return pd.DataFrame({"value": v, "head": [v[i] for i in agglomerate(v, limit, linkage)]})

            grouped = values.join(forms, "low").join(comp, "node", "left").select("value", F.coalesce("comp", "node").alias("comp"))
            heads = grouped.groupBy("comp").applyInPandas(cluster, "value string, head string")
    signs = F.length("value") - F.length(F.replace("value", F.lit("#"), F.lit("")))
    heads = work.keep(heads, "heads")
    reps = heads.groupBy("head").agg(F.min(F.struct(signs, -F.length("value"), F.col("value").alias("rep")))["rep"].alias("rep"))
    return heads.join(reps, "head").select("value", "rep")


def greedy_pairs(similarity: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j) by falling similarity, each row and column once, the earlier first among equals; -1 for what is left over."""
    s, out = similarity.astype(float).copy(), []
    rows, columns = s.shape
    while s.size and s.max() > -1:
        i, j = divmod(int(s.argmax()), columns)
        out.append((i, j))
        s[i, :], s[:, j] = -1, -1
    out += [(i, -1) for i in range(rows) if i not in {a for a, _ in out}]
    return out + [(-1, j) for j in range(columns) if j not in {b for _, b in out}]


def match_greedy(predicted: DataFrame, labelled: DataFrame, group: str, name: str, alternatives: str) -> DataFrame:
    """(group, predicted, labelled, similarity): names of a group matched one to one with labels by their likest alternative.

    predicted has (group, name), labelled (group, alternatives: array). What has no partner comes with null. The
    rows of one group, a document, meet in one task.
    """

    def match(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left, right = sorted(a["p"].dropna()), sorted((list(x) for x in b["l"].dropna()), key=lambda x: list(x))
        s = np.array([[max((ratio(p.lower(), q.lower()) for q in qs), default=0.0) for qs in right] for p in left]).reshape(len(left), len(right))
        pairs = greedy_pairs(s)
        first = lambda qs: qs[0] if qs else None
        return pd.DataFrame({
            "g": [key[0]] * len(pairs), "predicted": [left[i] if i >= 0 else None for i, _ in pairs],
            "labelled": [first(right[j]) if j >= 0 else None for _, j in pairs], "similarity": [s[i, j] if i >= 0 and j >= 0 else None for i, j in pairs],
        })

    p = predicted.select(F.col(group).alias("g"), F.col(name).alias("p"))
    q = labelled.select(F.col(group).alias("g"), F.col(alternatives).alias("l"))
    kind = dict(predicted.dtypes)[group]
    return p.groupBy("g").cogroup(q.groupBy("g")).applyInPandas(match, f"g {kind}, predicted string, labelled string, similarity double").withColumnRenamed("g", group)


Rows = Iterator[pd.DataFrame]
