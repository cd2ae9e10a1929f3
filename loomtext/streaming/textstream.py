"""Latent tables over streams of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.cells import cell_text
from loomtext.plans.catalog import TextCollection, TextView
from loomtext.plans.nodes import extract


def stream_scan(documents: DataFrame, key: str, text: str, view: TextView, attributes: Sequence[str]) -> DataFrame:
    """The rows of a latent table for streamed documents: extraction is a projection and keeps no state."""
    collection = TextCollection(view.collection.name, documents.select(key, text), key)
    over = TextView(view.name, collection, view.attributes, view.extractor, view.identifying, view.pending, view.only)
    return extract(over, attributes)


def stream_counts(documents: DataFrame, key: str, text: str, at: str, view: TextView, attribute: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(start, value, n): documents per value and event-time window; rows later than `late` behind the newest are dropped. The view's predicates hold here too."""
    rows = documents.select(key, text, at).withWatermark(at, late)
    for other, test in view.pending:
        rows = rows.where(test(view.extractor.cell(F.col(text), other)))
    if view.only is not None:
        rows = rows.join(view.only.select(key), key, "left_semi")
    cells = view.extractor.cell(F.col(text), attribute)
    each = rows.select(F.col(at), F.explode(cells).alias("v")).select(at, F.col("v.normed").alias("value"))
    return each.groupBy(F.window(at, window), "value").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "value", "n")


def shown(df: DataFrame) -> DataFrame:
    """Cells as text."""
    return df.select(*[cell_text(F.col(c)).alias(c) if t.startswith("array<struct<normed") else F.col(c) for c, t in df.dtypes])
