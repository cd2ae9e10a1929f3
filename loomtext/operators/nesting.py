"""Nested documents: lookups, upserts, grouping and dependent rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.ranking import top_per_group
from loomtext.workspace import Workspace


def nest_lookup(left: DataFrame, right: DataFrame, on: str, foreign: str, fields: Sequence[str], as_name: str) -> DataFrame:
    """left with the matching rows of right as a sorted array of structs; empty where none match, and for a null key."""
    nested = right.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias("__k")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(as_name))
    kind = nested.schema[as_name].dataType
    return left.join(nested, left[on] == F.col("__k"), "left").drop("__k").withColumn(as_name, F.coalesce(as_name, F.array().cast(kind)))


def nest_lookup_any(left: DataFrame, right: DataFrame, key: str, elements: str, foreign: str, fields: Sequence[str], as_name: str) -> DataFrame:
    """As nest_lookup, where any element of left's array may match; a row of right counts once."""
    pairs = left.select(key, F.explode(F.array_distinct(elements)).alias("__e")).join(right.select(F.col(foreign).alias("__e"), F.struct(*fields).alias("__s")), "__e")
    nested = pairs.groupBy(key).agg(F.array_sort(F.collect_set("__s")).alias(as_name))
    kind = nested.schema[as_name].dataType
    return left.join(nested, key, "left").withColumn(as_name, F.coalesce(as_name, F.array().cast(kind)))


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of base replaced or joined by the last change of each key (by `order`, a tie broken by it too); missing columns become null."""
    last = top_per_group(changes, keys, order)
    return base.join(last.select(*keys), list(keys), "left_anti").unionByName(last, allowMissingColumns=True)


def dependent(rows: DataFrame, group: str, key: str, refers: str) -> DataFrame:
    """(group, key, child): rows of the same group whose `refers` names the row's key, other than itself and not pointing back at each other."""
    a = rows.select(group, F.col(key).alias("key"), F.col(refers).alias("r"))
    b = rows.select(group, F.col(key).alias("child"), F.col(refers).alias("parent"))
    pair = a.join(b, (a[group] == b[group]) & (F.col("key") == F.col("parent"))).select(a[group], "key", "child", "r")
    return pair.where((F.col("key") != F.col("child")) & (F.col("r").isNull() | (F.col("r") != F.col("child")))).select(group, "key", "child")


def group_into_tables(rows: DataFrame, key: str, labels: Sequence[str], extra: str, rounds: int = 3, least: int = 5, most: int = 50) -> DataFrame:
    """(key, table, round): rows grouped by their rarest frequent label.

    `labels` are array columns, used in turn, `rounds` rounds each. In a round each row left
    takes the rarest of its labels that more than `least` rows have (ties by name); where that
    label has more than `most` rows, the rarest value of array `extra` is added. Groups of two and more are
    kept and the others tried again; the last round keeps everything. Counts are over all rows.
    """
    work = Workspace(rows.sparkSession, "grouping")
    left = work.keep(rows.select(key, *labels, extra))
    out, total = [], len(labels) * rounds
    for turn in range(total):
        label = labels[turn // rounds]
        flat = left.select(key, F.explode_outer(F.array_distinct(label)).alias("l"))
        counts = flat.where("l is not null").groupBy("l").agg(F.count("*").alias("n"))
        best = flat.join(counts, "l", "left").groupBy(key).agg(F.min(F.when(F.col("n") > least, F.struct("n", "l"))).alias("b"))
        more = left.select(key, F.explode_outer(F.array_distinct(extra)).alias("x"))
        extra_n = more.where("x is not null").groupBy("x").agg(F.count("*").alias("m"))
        rare = more.join(extra_n, "x", "left").groupBy(key).agg(F.min(F.when(F.col("x").isNotNull(), F.struct("m", "x"))).alias("r"))
        named = best.join(rare, key).select(key, F.concat_ws("/", F.coalesce("b.l", F.lit("")), F.when(F.col("b.n") > most, F.col("r.x"))).alias("table"))
        sizes = named.groupBy("table").agg(F.count("*").alias("size"))
        placed = work.keep(named.join(sizes, "table").select(key, "table", "size"))
        done = placed if turn == total - 1 else placed.where("size > 1")
        out.append(done.select(key, "table", F.lit(turn).alias("round")))
        if turn < total - 1:
            left, n = work.measure(left.join(done.select(key), key, "left_anti"), n=F.lit(True))
            if not n["n"]:
                break
    found = out[0]
    for d in out[1:]:
        found = found.unionByName(d)
    return found
