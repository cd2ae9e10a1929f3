"""The current version of each keyed row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: Column, order: Sequence[Column], keep: dict[str, Column]) -> DataFrame:
    """One row per non-null key: that with the greatest `order`, compared in turn, nulls lowest.

    Columns: `key` and those of `keep`. Ties on `order` are broken by the kept values, so the
    result doesn't depend on partitioning. The maximum is combined before the shuffle, so a hot
    key sends one row per task. An empty table gives an empty one.
    """
    kept = F.struct(*[c.alias(n) for n, c in keep.items()])
    whole = df.select(key.alias("key"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], kept.alias("kept")).alias("row"))
    best = whole.where("key is not null").groupBy("key").agg(F.max("row").alias("row"))
    return best.select("key", *[F.col(f"row.kept.`{n}`").alias(n) for n in keep])
