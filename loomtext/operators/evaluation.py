"""Comparison of predicted with labelled tables, groups and spans, and of runs with each other."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomtext.functions.text import counts_of_words, match_form
from loomtext.operators.metrics import chrf, scores


def matched_groups(predicted: DataFrame, labelled: DataFrame, by: Sequence[str], name: str, names: str) -> DataFrame:
    """(by..., name, label, other...): groups of an aggregation matched with labelled groups, which have a set of names.

    predicted (by..., name, ...), labelled (by..., names, ...). A predicted group takes a labelled one that has its
    name in match form; of several, the one whose sorted names come first, and a labelled group goes to the first predicted name only. Groups without
    a partner have a null on the other side. A group is named, not listed in pairs with all others.
    """
    have = labelled.withColumn("label", F.array_join(F.array_sort(F.col(names)), "|"))
    forms = have.select(*by, "label", F.explode(F.array_distinct(F.transform(names, match_form))).alias("__f"))
    mine = predicted.withColumn("__f", match_form(F.col(name)))
    first = mine.join(forms, [*by, "__f"]).groupBy(*by, name).agg(F.min("label").alias("label"))
    taken = first.groupBy(*by, "label").agg(F.min(name).alias(name))
    left = predicted.join(taken, [*by, name], "left")
    clash = [c for c in labelled.columns if c not in by and c != names]
    return left.join(have.select(*by, "label", *[F.col(c).alias(f"label_{c}") for c in clash]), [*by, "label"], "full")


def document_statistics(counts: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """counts (key, tp, fp, fn, ...) with precision, recall, f1 and the words, characters and sentences of the document; zero counts for documents without any."""
    own = scores(F.col("tp"), F.col("fp"), F.col("fn"))
    per = texts.select(key, counts_of_words(F.coalesce(text, F.lit(""))).alias("words"), F.length(F.coalesce(text, F.lit(""))).alias("characters"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[.!?](\s|$)")).alias("sentences"))
    sums = counts.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    every = per.join(sums, key, "left").select(key, "words", "characters", "sentences", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return every.select("*", *[c.alias(n) for n, c in own.items()])


def table_scores(predicted: Column, target: Column, row_header: bool = True, column_header: bool = True) -> Column:
    """struct<rows, columns, cells> of struct<tp, fp, fn>: how two tables (array<array<string>>) agree in row headers, column headers and cells.

    The first row and the first entry of each row are headers, if said so. A cell counts with the
    headers it stands under, once per occurrence; names are compared as they are, trimmed.
    """

    def body(t: Column) -> Column:
        return F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))) if column_header else t

    def tidy(x: Column) -> Column:
        return F.coalesce(F.trim(x), F.lit(""))

    def rows(t: Column) -> Column:
        return F.transform(body(t), lambda r: tidy(F.get(r, F.lit(0)))) if row_header else F.array().cast("array<string>")

    def columns(t: Column) -> Column:
        names = F.transform(F.get(t, F.lit(0)), tidy)
        return F.filter(F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))) if row_header else names, lambda x: x != "") if column_header else F.array().cast("array<string>")

    def cells(t: Column) -> Column:
        head = F.get(t, F.lit(0))
        of = lambda r: F.filter(F.transform(r, lambda c, j: F.concat_ws("\x1f", tidy(F.get(r, F.lit(0))) if row_header else F.lit(""), tidy(F.get(head, j)) if column_header else j.cast("string"), F.when((j > 0) | F.lit(not row_header), tidy(c)))), lambda s: F.size(F.split(s, "\x1f")) == 3)
        return F.filter(F.flatten(F.transform(body(t), of)), lambda s: F.element_at(F.split(s, "\x1f"), 3) != "")

    def counted(f) -> Column:
        a, b = F.coalesce(f(predicted), F.array().cast("array<string>")), F.coalesce(f(target), F.array().cast("array<string>"))
        a, b = numbered(a), numbered(b)
        hit = F.size(F.array_intersect(a, b))
        return F.struct(hit.alias("tp"), (F.size(a) - hit).alias("fp"), (F.size(b) - hit).alias("fn"))

    return F.struct(counted(rows).alias("rows"), counted(columns).alias("columns"), counted(cells).alias("cells"))


def numbered(values: Column) -> Column:
    """Strings of an array, each with its number among equal ones, so that sets of them count repeats."""
    return F.transform(values, lambda v, i: F.concat(v, F.lit("\x1e"), F.size(F.filter(F.slice(values, F.lit(1), i), lambda u: u == v)).cast("string")))


@F.pandas_udf(T.DoubleType())
def chrf_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Character n-gram F-score, 0 to 1; null if either is null."""
    return pd.Series([None if x is None or y is None else chrf(x, y) for x, y in zip(a, b)], dtype="float64")


def _answers(labels: Column) -> Column:
    """Spans of an array of 2 (begins), 1 (goes on) and 0, as text `start-end`."""
    start = F.array().cast("array<struct<start:int,end:int>>")
    at = F.sequence(F.lit(0), F.size(labels) - 1)

    def step(acc: Column, i: Column) -> Column:
        x, last = F.get(labels, i), F.try_element_at(acc, F.lit(-1))
        new = F.array_append(acc, F.struct(i.cast("int").alias("start"), (i + 1).cast("int").alias("end")))
        longer = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(last["start"].alias("start"), (i + 1).cast("int").alias("end")))
        return F.when(x == 2, new).when((x == 1) & (last["end"] == i), longer).otherwise(acc)

    spans = F.when(F.size(labels) > 0, F.aggregate(at, start, step)).otherwise(start)
    return F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))


def span_counts(predicted: Column, labelled: Column) -> Column:
    """struct<a_tp, a_fp, a_fn, t_tp, t_fp, t_fn> of two arrays of 0, 1 and 2: whole answers, and tokens of either label."""
    a, b = _answers(predicted), _answers(labelled)
    hit = F.size(F.array_intersect(a, b))
    both = F.arrays_zip(predicted.alias("p"), labelled.alias("l"))
    n = lambda test: F.size(F.filter(both, test))
    some = lambda x: F.coalesce(x > 0, F.lit(False))
    same = lambda z: F.coalesce(z["p"] == z["l"], F.lit(False))
    return F.struct(
        hit.alias("a_tp"), (F.size(a) - hit).alias("a_fp"), (F.size(b) - hit).alias("a_fn"),
        n(lambda z: some(z["p"]) & same(z)).alias("t_tp"), n(lambda z: some(z["p"]) & ~same(z)).alias("t_fp"), n(lambda z: some(z["l"]) & ~same(z)).alias("t_fn"),
    )


def accuracy(df: DataFrame, by: Sequence[str], predicted: Column, labelled: Column, counts: Column | None = None) -> DataFrame:
    """(by..., n, accuracy): in how many of the rows that count, and where both are given, the two are equal."""
    on = predicted.isNotNull() & labelled.isNotNull() & (F.lit(True) if counts is None else F.coalesce(counts, F.lit(False)))
    return df.where(on).groupBy(*by).agg(F.count("*").alias("n"), F.avg((predicted == labelled).cast("double")).alias("accuracy"))


def compared_runs(runs: DataFrame, query: Sequence[str], variant: str, seconds: str, quality: str) -> DataFrame:
    """(query..., variant, runs, least, most, mean, quality, best, slowdown, is_best): runs of variants of queries.

    best is the greatest quality of any variant of the query, slowdown the variant's mean time over the least mean of the query.
    """
    per = runs.groupBy(*query, variant).agg(F.count("*").alias("runs"), F.min(seconds).alias("least"), F.max(seconds).alias("most"), F.avg(seconds).alias("mean"), F.max(quality).alias("quality"))
    top = per.groupBy(*query).agg(F.max("quality").alias("best"), F.min("mean").alias("__fast"))
    out = per.join(top, list(query))
    return out.select(*query, variant, "runs", "least", "most", "mean", "quality", "best", (F.col("mean") / F.nullif(F.col("__fast"), F.lit(0))).alias("slowdown"), (F.col("quality") == F.col("best")).alias("is_best"))


def bucketed(df: DataFrame, by: Sequence[str], value: str, n: int) -> DataFrame:
    """df with `bucket`: one of n ranges of equal width between the least and greatest value of its group, from 0; null for a null value."""
    ends = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    at = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(F.least(F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * n), F.lit(n - 1)))
    return df.join(ends, list(by)).withColumn("bucket", F.when(F.col(value).isNotNull(), at).cast("int")).drop("__lo", "__hi")


def bucket_ranges(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., bucket, n, low, high, centre): what lies in each bucket."""
    return df.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).withColumn("centre", (F.col("low") + F.col("high")) / 2)


def level_statistics(df: DataFrame, value: str, levels: Sequence[Sequence[str]]) -> DataFrame:
    """(level, group, value, n): values per group of each level are first made one, and groups with the same counted.

    A numeric value is summed over the group; of others the least is taken.
    """
    numeric = dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint", "float", "double") or dict(df.dtypes)[value].startswith("decimal")
    out = None
    for columns in levels:
        per = df.groupBy(*columns).agg((F.sum(value) if numeric else F.min(value)).cast("string").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
        one = per.select(F.lit(",".join(columns)).alias("level"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


def ranked_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """df with its place from 1 within its group; groups are meant to be small, such as the runs of a query."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
