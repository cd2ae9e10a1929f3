"""Closures over parent links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.workspace import Workspace

#: Ancestors that a task remembers, for all nodes together (4 bytes each), and rows in a batch.
KEPT, BATCH = 1 << 23, 1 << 16


def read(files: list[str]) -> pa.Table:
    """Parquet files of the shared folder, in this order, from within a task."""
    tables = []
    for f in files:
        system, path = fs.FileSystem.from_uri(f)
        with system.open_input_file(path) as source:
            tables.append(pq.ParquetFile(source).read())
    return pa.concat_tables(tables)


def numbered(edges: pa.Table) -> Iterator[pa.RecordBatch]:
    """A row per node of the edges (node, ancestor), its number being its place: name, the numbers of its parents, and its depth along first parents.

    Nodes follow their first parents, but for cycles, so neighbours share ancestors.
    """
    kind, rows = edges["node"].type, edges.num_rows
    both = pa.chunked_array([*edges["node"].chunks, *edges["ancestor"].chunks], kind).dictionary_encode().unify_dictionaries()
    del edges
    names = both.chunk(0).dictionary if both.num_chunks else pa.array([], kind)
    codes, n = np.concatenate([np.empty(0, np.int32), *(c.indices.to_numpy() for c in both.chunks)]), len(names)
    del both
    node, parents = codes[:rows], codes[rows:]
    parents, count = parents[np.argsort(node, kind="stable")], np.bincount(node, minlength=n)
    del codes, node
    at = np.concatenate([[0], np.cumsum(count)])
    first = np.full(n + 1, n, np.int32)  # n stands above those without parents
    first[:n][count > 0] = parents[at[:-1][count > 0]]
    kids = np.bincount(first[:n], minlength=n + 1)
    # from the end: those without children, so that the longest ways come last
    below, start = memoryview(np.lexsort((-kids[:n], first[:n])).astype(np.int32)), memoryview(np.concatenate([[0], np.cumsum(kids)]))
    del kids
    depth, order = np.zeros(n + 1, np.int32), np.empty(n + 1, np.int32)
    deep, put, up, seen, i = memoryview(depth), memoryview(order), memoryview(first), bytearray(n + 1), 0
    for top in chain([n], range(n)):
        stack = [] if seen[top] else [top]
        while stack:
            x = stack.pop()
            if not seen[x]:
                seen[x], deep[x], put[i] = 1, deep[up[x]] + 1, x
                i += 1
                stack.extend(below[start[x] : start[x + 1]])
    order = order[1:]  # n is the first
    number = np.empty(n, np.int32)
    number[order] = np.arange(n, dtype=np.int32)
    for i in range(0, n, BATCH):
        own = order[i : i + BATCH]
        ends = np.concatenate([[0], np.cumsum(count[own])])
        links = number[parents[np.repeat(at[own] - ends[:-1], count[own]) + np.arange(ends[-1])]]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(links)), pa.array(depth[own])], ["name", "parents", "depth"])


class Links:
    """What numbered gives, in arrays: the parents of node x are parents[at[x]:at[x + 1]]."""

    def __init__(self, nodes: pa.Table):
        nodes = nodes.combine_chunks()
        if any(c.num_chunks > 1 for c in nodes.columns):
            raise ValueError("the nodes' names or links are too many for one array")
        self.names, up = (nodes[c].chunk(0) if nodes.num_rows else pa.array([], nodes[c].type) for c in ("name", "parents"))
        self.parents, self.at = up.values.to_numpy(), up.offsets.to_numpy()
        self.depth = nodes["depth"].to_numpy()

    def sources(self, part: int, parts: int) -> np.ndarray:
        """One of several parts of the nodes with parents, of about as many pairs each."""
        cost = np.where(np.diff(self.at) > 0, self.depth.astype(np.int64) + 20, 0)  # a node by itself costs as much as some pairs
        before = np.cumsum(cost) - cost
        return np.flatnonzero((cost > 0) & (before * parts // max(1, cost.sum()) == part))

    def above(self, sources: np.ndarray, steps: int | None) -> Iterator[tuple[int, np.ndarray]]:
        """Each source with its ancestors, each once. What is known of an ancestor is taken over whole, up to a bound; without it the links are followed again."""
        parents, at = memoryview(self.parents), memoryview(self.at)
        marks = np.zeros(len(self.names), np.int64)
        mark, used, known, size, inner = memoryview(marks), 0, {}, 0, np.zeros(len(self.names), bool)
        inner[self.parents] = True

        def within(x: int) -> np.ndarray:
            found, front = [], [x]
            for _ in range(max(1, steps)):
                ahead = []
                for y in front:
                    for p in parents[at[y] : at[y + 1]]:
                        if mark[p] != used:
                            mark[p] = used
                            ahead.append(p)
                found, front = found + ahead, ahead
                if not ahead:
                    break
            return np.array(found, np.int32)

        def all_of(x: int) -> np.ndarray:
            nonlocal size
            found, parts, stack = [], [], [x]
            while stack:
                y = stack.pop()
                for p in parents[at[y] : at[y + 1]]:
                    if mark[p] != used:
                        mark[p] = used
                        found.append(p)
                        if (more := known.pop(p, None)) is None:
                            stack.append(p)
                        else:
                            known[p] = more  # now the last to be forgotten
                            new = more[marks[more] != used]
                            marks[new] = used
                            parts.append(new)
            got = np.concatenate([np.array(found, np.int32), *parts])
            if inner[x] and len(got) <= KEPT:
                size += len(got) - len(known.pop(x, ()))
                known[x] = got
                while size > KEPT:
                    size -= len(known.pop(next(iter(known))))
            return got

        for s in sources.tolist():
            if steps is None and (p := parents[at[s]]) not in known:
                used += 1
                all_of(p)
            used += 1
            yield s, within(s) if steps is not None else all_of(s)

    def pairs(self, sources: np.ndarray, steps: int | None) -> Iterator[pa.RecordBatch]:
        def batch(nodes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            ends, every = np.repeat(np.array(nodes, np.int32), [len(s) for s in sets]), np.concatenate(sets)
            for i in range(0, len(every), BATCH):
                yield pa.RecordBatch.from_arrays([self.names.take(pa.array(c[i : i + BATCH])) for c in (ends, every)], ["node", "ancestor"])

        nodes, sets, n = [], [], 0
        for s, found in self.above(sources, steps):
            nodes.append(s)
            sets.append(found)
            n += len(found)
            if n >= BATCH:
                yield from batch(nodes, sets)
                nodes, sets, n = [], [], 0
        if nodes:
            yield from batch(nodes, sets)


def transitive_hull(edges: DataFrame, steps: int | None = None) -> DataFrame:
    """(node, ancestor): all pairs reached over edges (node, parent) in one or more steps, the node itself too where it is on a cycle.

    steps bounds how many, if given. Null ends are left out. Only the links are written and shuffled. One task numbers the nodes; each of the
    others reads the numbered links from the shared folder and lists the pairs of its nodes as they are asked for. So the links must fit into a worker's memory, the pairs nowhere.
    """
    spark = edges.sparkSession
    work = Workspace(spark, "hull")
    base = work.keep(edges.select("node", F.col("parent").alias("ancestor")).where("node is not null and ancestor is not null").distinct())
    kind, files, parts = base.schema["node"].dataType, sorted(base.inputFiles()), 8 * spark.sparkContext.defaultParallelism

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield from numbered(read(files))

    rows = T.StructType().add("name", kind).add("parents", T.ArrayType(T.IntegerType())).add("depth", T.IntegerType())
    nodes = sorted(work.keep(spark.range(0, 1, 1, 1).mapInArrow(number, rows), "nodes").inputFiles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b["id"].to_pylist():
                links = Links(read(nodes))
                yield from links.pairs(links.sources(part, parts), steps)

    return spark.range(0, parts, 1, parts).mapInArrow(run, T.StructType().add("node", kind).add("ancestor", kind))
