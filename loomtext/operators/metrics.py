"""Quality of extracted values against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import match_form


def value_counts(predicted: Column, labelled: Column) -> Column:
    """struct<tp, fp, fn> of predicted strings and labelled sets (array<array<string>>).

    Values are compared in match form. In order, each predicted value takes the first set left
    that holds it; what is left over is a false positive or a false negative. Empty values and null arrays don't count.
    """
    values = F.filter(F.coalesce(predicted, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    sets = F.transform(F.coalesce(labelled, F.array().cast("array<array<string>>")), lambda s: F.transform(s, match_form))
    start = F.struct(F.lit(0).alias("tp"), F.transform(sets, lambda s: s).alias("left"))

    def step(acc: Column, v: Column) -> Column:
        form = match_form(v)
        places = F.transform(acc["left"], lambda s, i: F.when(F.array_contains(s, form), i))
        at = F.array_min(F.array_compact(places))
        rest = F.filter(acc["left"], lambda s, i: i != at)
        return F.struct(F.when(at.isNull(), acc["tp"]).otherwise(acc["tp"] + 1).alias("tp"), F.when(at.isNull(), acc["left"]).otherwise(rest).alias("left"))

    tp = F.aggregate(values, start, step, lambda acc: acc["tp"])
    return F.struct(tp.alias("tp"), (F.size(values) - tp).alias("fp"), (F.size(sets) - tp).alias("fn"))


def scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and f1; 0 where undefined, with 1e-8 against division by zero."""
    p, r = tp / (tp + fp + F.lit(1e-8)), tp / (tp + fn + F.lit(1e-8))
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r + F.lit(1e-8))}


def summarise(per_document: DataFrame, by: Sequence[str]) -> DataFrame:
    """Micro scores, and the mean, quartiles, least and greatest of the documents' F1, for documents with any value."""
    own = scores(F.col("tp"), F.col("fp"), F.col("fn"))
    docs = per_document.where("tp + fp + fn > 0").withColumn("own", own["f1"])
    q = F.percentile("own", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = docs.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("own").alias("mean_f1"), q.alias("q"), F.min("own").alias("min_f1"), F.max("own").alias("max_f1"))
    micro = scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select(*by, "tp", "fp", "fn", *[c.alias(n) for n, c in micro.items()], "mean_f1", F.get("q", F.lit(0)).alias("q1_f1"), F.get("q", F.lit(1)).alias("median_f1"), F.get("q", F.lit(2)).alias("q3_f1"), "min_f1", "max_f1")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def table_f1(predicted: Column, target: Column) -> dict[str, Column]:
    """Precision, recall and f1 of the distinct cells (any comparable items) of two arrays."""
    hit = F.size(F.array_intersect(predicted, target)).cast("double")
    return scores(hit, F.size(F.array_distinct(predicted)) - hit, F.size(F.array_distinct(target)) - hit)


def chrf(a: str, b: str, most: int = 6, beta: float = 2.0) -> float:
    """Character n-gram F-score of two strings, 0 to 1; spaces don't count."""
    from collections import Counter

    a, b, precisions, recalls = a.replace(" ", ""), b.replace(" ", ""), [], []
    for n in range(1, most + 1):
        x, y = Counter(a[i : i + n] for i in range(len(a) - n + 1)), Counter(b[i : i + n] for i in range(len(b) - n + 1))
        if x and y:
            common = sum((x & y).values())
            precisions.append(common / sum(x.values()))
            recalls.append(common / sum(y.values()))
    if not precisions:
        return float(a == b)
    p, r = sum(precisions) / len(precisions), sum(recalls) / len(recalls)
    return (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0


def histogram(df: DataFrame, value: str, levels: Sequence[Sequence[str]]) -> DataFrame:
    """(level, group, value, n): how often each value occurs in each group of every level, a level being some columns; nulls are left out."""
    out = None
    for columns in levels:
        group = F.concat_ws("|", *[F.col(c).cast("string") for c in columns]) if columns else F.lit("")
        one = df.where(F.col(value).isNotNull()).groupBy(F.lit(",".join(columns)).alias("level"), group.alias("group"), F.col(value).cast("string").alias("value")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
