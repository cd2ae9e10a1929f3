"""Spans, windows and labels inside texts. Offsets are half-open code points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _starts(gaps: pa.Array, wholes: pa.Array) -> pa.Array:
    """Where matches begin, from the lengths of what lies before each of them and of the matches; in one pass however many there are."""
    n, m = (np.nan_to_num(np.asarray(pc.list_value_length(x).to_numpy(zero_copy_only=False), float)).astype(np.int64) for x in (gaps, wholes))
    g, w = gaps.flatten().to_numpy(zero_copy_only=False).astype(np.int64), wholes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(m)), m)
    at_g, at_w = np.cumsum(n) - n, np.cumsum(m) - m
    sum_g, sum_w = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(w)]
    i = np.arange(len(w)) - at_w[row]
    start = sum_g[at_g[row] + i + 1] - sum_g[at_g[row]] + sum_w[np.arange(len(w))] - sum_w[at_w[row]]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(m)], pa.int32()), pa.array(start, pa.int32()))


def find_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the matches of a regular expression, from the left; empty matches are left out.

    What lies between the matches is split off by the same expression, so places follow from
    lengths alone, whatever the expression looks at around a match. With a group, its value's place is
    the first of that value within the match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    starts = _starts(F.transform(F.split(text, pattern, -1), F.length), F.transform(found, F.length))

    def one(m: Column) -> Column:
        begin = m["at"] + F.position(m["value"], m["whole"]) - 1
        return F.struct(begin.cast("int").alias("start"), (begin + F.length(m["value"])).cast("int").alias("end"), m["value"].alias("value"))

    zipped = F.filter(F.arrays_zip(found.alias("whole"), inner.alias("value"), starts.alias("at")), lambda m: F.length(m["whole"]) > 0)
    return F.when(text.isNotNull(), F.transform(zipped, one))


def without_overlap(spans: Column) -> Column:
    """Of spans (start, end, ...) sorted by start and then longest first, those that don't overlap one kept before."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def keep(acc: Column, s: Column) -> Column:
        clear = (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["end"] <= s["start"])
        return F.when(clear, F.array_append(acc, s)).otherwise(acc)

    return F.aggregate(ordered, F.slice(ordered, 1, 0), keep)


def longest_wins(spans: Column) -> Column:
    """Of spans (start, end, ...) the longest first, ties from the left, those that don't overlap one kept before; in order of start."""
    ordered = F.array_sort(spans, lambda a, b: F.when(b["end"] - b["start"] != a["end"] - a["start"], (b["end"] - b["start"]) - (a["end"] - a["start"])).otherwise(a["start"] - b["start"]))

    def keep(acc: Column, s: Column) -> Column:
        clash = F.exists(acc, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
        return F.when(clash, acc).otherwise(F.array_append(acc, s))

    return F.array_sort(F.aggregate(ordered, F.slice(ordered, 1, 0), keep), lambda a, b: a["start"] - b["start"])


def bio_spans(labels: Column) -> Column:
    """array<struct<start, end>> of an array of B, I and O: a span starts at B and goes on while I follows."""
    start = F.array().cast("array<struct<start:int,end:int>>")
    at = F.sequence(F.lit(0), F.size(labels) - 1)

    def step(acc: Column, i: Column) -> Column:
        label, last = F.get(labels, i), F.try_element_at(acc, F.lit(-1))
        new = F.array_append(acc, F.struct(i.cast("int").alias("start"), (i + 1).cast("int").alias("end")))
        longer = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(last["start"].alias("start"), (i + 1).cast("int").alias("end")))
        return F.when(label == "B", new).when((label == "I") & (last["end"] == i), longer).otherwise(acc)

    return F.when(F.size(labels) > 0, F.aggregate(at, start, step)).otherwise(start)


def token_windows(tokens: Column, size: int, overlap: int) -> Column:
    """array<struct<number, start, tokens>>: windows of at most `size` tokens, each `size - overlap` after the one before; one for an empty array."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.lit(1) + F.ceil((F.size(tokens) - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("number"), (i * step).alias("start"), F.slice(tokens, i * step + 1, size).alias("tokens")))


def token_at(offsets: Column, place: Column, reach: int = 2) -> Column:
    """The number of the token (array of start offsets) at a character place, or the nearest within `reach`; null otherwise."""
    near = F.filter(F.transform(offsets, lambda o, i: F.struct(F.abs(o - place).alias("d"), i.alias("i"))), lambda x: x["d"] <= reach)
    return F.array_min(near)["i"]


def word_start(tokens: Column, at: Column, mark: str = "##") -> Column:
    """The number of the token that begins the word of the token at a place: back over tokens that start with the mark."""
    upto = F.slice(tokens, F.lit(1), at + 1)
    return F.when((at >= 0) & (at < F.size(tokens)), F.greatest(F.lit(0), F.array_max(F.transform(upto, lambda t, i: F.when(~t.startswith(mark), i))))).cast("int")


def merge_pieces(tokens: Column, mark: str = "##") -> Column:
    """array<struct<start, word>>: tokens that start with the mark joined to those before them."""
    start = F.array().cast("array<struct<start:int,word:string>>")
    at = F.sequence(F.lit(0), F.size(tokens) - 1)

    def step(acc: Column, i: Column) -> Column:
        t, last = F.get(tokens, i), F.try_element_at(acc, F.lit(-1))
        longer = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(last["start"].alias("start"), F.concat(last["word"], F.substring(t, F.lit(len(mark) + 1), F.length(t))).alias("word")))
        return F.when(t.startswith(mark) & (F.size(acc) > 0), longer).otherwise(F.array_append(acc, F.struct(i.cast("int").alias("start"), t.alias("word"))))

    return F.when(F.size(tokens) > 0, F.aggregate(at, start, step)).otherwise(start)


def in_window(spans: Column, offsets: Column, first: Column, size: int) -> Column:
    """Spans (start, end) in characters as tokens (start, end) of a window of `size` tokens from `first`, offsets being where tokens begin.

    A span's tokens are those that begin before its end, from the last that begins at or before its start; parts outside the window are cut off, and spans outside left out.
    """
    at = lambda place: F.size(F.filter(offsets, lambda o: o <= place)) - 1
    placed = F.transform(spans, lambda s: F.struct((F.greatest(at(s["start"]), F.lit(0)) - first).alias("start"), (at(s["end"] - 1) + 1 - first).alias("end")))
    cut = F.transform(placed, lambda s: F.struct(F.greatest(s["start"], F.lit(0)).cast("int").alias("start"), F.least(s["end"], F.lit(size)).cast("int").alias("end")))
    return F.filter(cut, lambda s: s["start"] < s["end"])


def gaps_and_islands(ids: Column) -> Column:
    """array<struct<start, end>> of half-open runs of consecutive numbers of an array; repeats count once."""
    ordered = F.array_sort(F.array_distinct(F.array_compact(ids)))
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        x = x.cast("long")
        longer = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(last["start"].alias("start"), (x + 1).alias("end")))
        return F.when(last["end"] == x, longer).otherwise(F.array_append(acc, F.struct(x.alias("start"), (x + 1).alias("end"))))

    return F.aggregate(ordered, start, step)
