"""Joins and restrictions that plain equality doesn't give, by equi-joins with bounded partners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.ranking import global_rank


def nest_correlated(left: DataFrame, right: DataFrame, on: str, foreign: str, test: Column, fields: Sequence[str], as_name: str, totals: dict[str, Column] | None = None) -> DataFrame:
    """left with the rows of right of the same key that pass a test, as a sorted array of structs, or as aggregates.

    The test may use columns of both sides, those of right by the prefix `r_`. totals: aggregates by
    name instead of the array; count-like ones are null where no row passes. Left rows, equal ones too, are all kept.
    """
    mine = left.withColumn("__n", F.monotonically_increasing_id())
    other = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    met = mine.join(other, mine[on] == F.col(f"r_{foreign}"), "left")
    passed = F.when(F.coalesce(test, F.lit(False)), F.struct(*[F.col(f"r_{f}").alias(f) for f in fields]))
    made = [F.array_sort(F.array_compact(F.collect_list(passed))).alias(as_name)] if totals is None else [c.alias(n) for n, c in totals.items()]
    if totals is not None:
        met = met.select(*mine.columns, *[F.when(F.coalesce(test, F.lit(False)), F.col(f"r_{c}")).alias(f"r_{c}") for c in right.columns])
    return met.groupBy("__n", *left.columns).agg(*made).drop("__n")


def contained(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Each row of points with each row of spans of its key whose half-open range holds its place.

    A span is put under every range of `width` places that it touches, a point under its own, and these meet by
    equality; width should be about the usual length of a span. Clashing names other than the key are an error.
    """
    cells = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    wide = spans.where(F.col(start) < F.col(end)).withColumn("__c", F.explode(cells))
    return points.withColumn("__c", F.floor(F.col(at) / width)).join(wide, [key, "__c"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__c")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, fields: Sequence[str], within: float) -> DataFrame:
    """left with the fields of the row of right of the same key that is nearest in `at`, at most `within` away, and `distance`; null without one. Ties go to the lower place, then by the fields.

    Places are cut into ranges of `within`, so that a partner can only lie in the same range or the next to it.
    """
    mine = left.withColumn("__n", F.monotonically_increasing_id())
    cell = F.floor(F.col(at) / within)
    there = right.where(F.col(at).isNotNull()).select(F.col(key), F.col(at).alias("__at"), F.struct(*fields).alias("__f"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("__c"))
    gap = F.abs(F.col(at) - F.col("__at"))
    best = mine.withColumn("__c", cell).join(there, [key, "__c"]).where(gap <= within).groupBy("__n").agg(F.min(F.struct(gap.alias("d"), "__at", "__f")).alias("b"))
    out = mine.join(best, "__n", "left")
    return out.select(*left.columns, *[F.col(f"b.__f.{f}").alias(f) for f in fields], F.col("b.d").alias("distance"))


def only_tagged(df: DataFrame, names: str) -> DataFrame:
    """Rows whose array of names holds any."""
    return df.where(F.size(F.array_compact(names)) > 0)


def restricted(df: DataFrame, key: str, ids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The key and those of the columns that there are, for the rows whose key is among ids (key); repeated rows stay."""
    return df.join(ids.select(key).distinct(), key, "left_semi").select(key, *[c for c in columns if c in df.columns and c != key])


def without_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose value doesn't match a regular expression anywhere; nulls stay."""
    return df.where(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def without_conflicts(pairs: DataFrame, a: str, b: str, same: str) -> DataFrame:
    """(a, b, same): distinct pairs, in either order, marked the same or different; those marked both ways are left out."""
    one = pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b), same).where(f"{a} is not null and {b} is not null and {same} is not null")
    return one.groupBy(a, b).agg(F.min(same).alias(same), F.max(same).alias("__x")).where(F.col(same) == F.col("__x")).drop("__x")


def page(df: DataFrame, order: Sequence[Column], skip: int, most: int) -> DataFrame:
    """Rows skip + 1 to skip + most in an order without ties, found by their rank, so no task sorts all."""
    return global_rank(df, order, "__rank").where((F.col("__rank") > skip) & (F.col("__rank") <= skip + most)).drop("__rank")


def averaged(rows: DataFrame, name: str, values: str, source: str) -> DataFrame:
    """(name, values): arrays of the same name, element by element the mean over sources.

    Every source must have the same names with arrays of the same lengths; otherwise `agrees` is false for the names concerned, and their values are null.
    """
    sources = rows.agg(F.count_distinct(source).alias("__all"))
    per = rows.groupBy(name).agg(F.count("*").alias("__k"), F.min(F.size(values)).alias("__lo"), F.max(F.size(values)).alias("__hi"))
    means = rows.select(name, F.posexplode(values).alias("__i", "__v")).groupBy(name, "__i").agg(F.avg("__v").alias("__m")).groupBy(name).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda x: x["__m"]).alias("__means"))
    # a single row of a count
    judged = per.withColumn("__one", F.lit(1)).join(sources.withColumn("__one", F.lit(1)), "__one").join(means, name, "left")
    agrees = (F.col("__k") == F.col("__all")) & (F.col("__lo") == F.col("__hi"))
    return judged.select(name, F.when(agrees, F.col("__means")).alias(values), agrees.alias("agrees"))
