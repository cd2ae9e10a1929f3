"""Engines that fill latent tables from texts.

An extractor gives, for a column of texts, a cell per attribute (one row per document) or an
array of rows (several rows per document). Both are expressions, so filters and limits on other
columns are pushed below them and unused attributes are pruned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions.cells import cell_of, cell_of_text, empty_cell
from loomtext.operators.tabletext import completion_rows, parse_tables


class Extractor:
    """cells for single-row views; rows for views with an identifying attribute."""

    def prepare(self, docs: DataFrame, key: str) -> DataFrame:
        """docs with whatever columns the extractor needs beside the text."""
        return docs

    def cell(self, text: Column, attribute: str) -> Column:
        raise NotImplementedError

    def rows(self, text: Column, attributes: Sequence[str], identifying: str) -> Column:
        """array<struct<identifying, attributes...>>."""
        raise NotImplementedError


@dataclass
class PatternExtractor(Extractor):
    """patterns: regular expression and group by attribute; kinds: the same for (identifying value -> pattern) of multi-row views.

    In a multi-row view, a row stands for one kind with its distinct values; kinds without a match have no row.
    """

    patterns: dict[str, tuple[str, int]] = field(default_factory=dict)
    kinds: dict[str, tuple[str, int]] = field(default_factory=dict)
    value: str = "value"

    def cell(self, text: Column, attribute: str) -> Column:
        pattern, group = self.patterns[attribute]
        return cell_of(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))

    def rows(self, text: Column, attributes: Sequence[str], identifying: str) -> Column:
        each = []
        for kind, (pattern, group) in self.kinds.items():
            cell = cell_of(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
            each.append(F.struct(F.lit(kind).alias(identifying), *[(cell if a == self.value else empty_cell()).alias(a) for a in attributes]))
        return F.filter(F.array(*each), lambda r: F.size(r[self.value]) > 0 if self.value in attributes else F.lit(True))


@dataclass
class LexiconExtractor(Extractor):
    """Terms by attribute and normalised value; a document's cell lists the values one of whose terms stands in it as a word."""

    terms: dict[str, dict[str, list[str]]]

    def cell(self, text: Column, attribute: str) -> Column:
        low = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "), F.lit(" "))
        found = [F.when(F.greatest(*[low.contains(f" {t.lower()} ").cast("int") for t in ts], F.lit(0)) == 1, F.lit(v)) for v, ts in sorted(self.terms[attribute].items())]
        return cell_of(F.array_compact(F.array(*found)))


@dataclass
class LabelExtractor(Extractor):
    """The oracle: cells from labels (doc key, row_key, attribute, pos, normed, start, end) with [start, end) code points.

    A value's spellings are its normalised form and the surface forms, in lower case, in order of
    their place. row_key is null in single-row views. Labels are put to the documents by one
    aggregation and one join on the key.
    """

    labels: DataFrame
    key: str

    def prepare(self, docs: DataFrame, key: str) -> DataFrame:
        span = F.struct("pos", F.coalesce("row_key", F.lit("")).alias("row_key"), "attribute", "normed", "start", "end")
        mine = self.labels.groupBy(F.col(self.key).alias("__lk")).agg(F.array_sort(F.collect_list(span)).alias("__labels"))
        return docs.join(mine, docs[key] == F.col("__lk"), "left").drop("__lk")

    @staticmethod
    def _combine(text: Column, spans: Column) -> Column:
        normed = F.array_distinct(F.transform(spans, lambda s: F.lower(s["normed"])))

        def spellings(v: Column) -> Column:
            mine = F.filter(spans, lambda s: F.lower(s["normed"]) == v)
            surface = F.transform(mine, lambda s: F.lower(F.substring(text, s["start"] + 1, s["end"] - s["start"])))
            return F.struct(v.alias("normed"), F.array_distinct(F.concat(F.array(v), F.array_compact(surface))).alias("alts"))

        return F.coalesce(F.transform(F.array_compact(normed), spellings), empty_cell())

    def cell(self, text: Column, attribute: str) -> Column:
        return self._combine(text, F.filter("__labels", lambda s: (s["attribute"] == attribute) & (s["row_key"] == "")))

    def rows(self, text: Column, attributes: Sequence[str], identifying: str) -> Column:
        names = F.array_distinct(F.transform(F.filter("__labels", lambda s: s["row_key"] != ""), lambda s: s["row_key"]))

        def mine(r: Column, attribute: str) -> Column:
            return self._combine(text, F.filter("__labels", lambda s: (s["attribute"] == attribute) & (s["row_key"] == r)))

        def one(r: Column) -> Column:
            return F.struct(r.alias(identifying), *[mine(r, a).alias(a) for a in attributes])

        return F.coalesce(F.transform(names, one), F.array())


@dataclass
class CompletionExtractor(Extractor):
    """Parses completions (delimited tables) that a model gave for a text; `complete` turns the text's column into theirs."""

    complete: Callable[[Column], Column]
    header: Sequence[str]
    single: Sequence[str] = ()

    def cell(self, text: Column, attribute: str) -> Column:
        first = F.get(completion_rows(self.complete(text), self.header), F.lit(0))
        return F.when(first.isNull(), empty_cell()).otherwise(cell_of_text(first[attribute], attribute in self.single))

    def rows(self, text: Column, attributes: Sequence[str], identifying: str) -> Column:
        rows = F.filter(completion_rows(self.complete(text), self.header), lambda r: F.coalesce(r[identifying] != "", F.lit(False)))
        first = F.filter(rows, lambda r: r[identifying].isNotNull())
        cells = F.transform(first, lambda r: F.struct(r[identifying].alias(identifying), *[cell_of_text(r[a], a in self.single).alias(a) for a in attributes]))
        # the first row of an identifying value counts
        return F.filter(cells, lambda r, i: ~F.exists(F.slice(cells, F.lit(1), i), lambda q: q[identifying] == r[identifying]))


@dataclass
class TableTextExtractor(Extractor):
    """Reads a serialised table of a given name out of the text itself."""

    table: str

    def cell(self, text: Column, attribute: str) -> Column:
        pairs = F.filter(parse_tables(text, self.table), lambda r: F.lower(F.get(r, F.lit(0))) == attribute.lower())
        return F.coalesce(cell_of_text(F.get(F.get(pairs, F.lit(0)), F.lit(1))), empty_cell())

    def rows(self, text: Column, attributes: Sequence[str], identifying: str) -> Column:
        table = parse_tables(text, self.table)
        header, body = F.transform(F.get(table, F.lit(0)), F.lower), F.slice(table, F.lit(2), F.greatest(F.size(table) - 1, F.lit(0)))
        at = lambda r, a: F.coalesce(F.try_element_at(r, F.nullif(F.array_position(header, a.lower()), F.lit(0)).cast("int")), F.lit(""))
        return F.transform(body, lambda r: F.struct(F.get(r, F.lit(0)).alias(identifying), *[cell_of_text(at(r, a)).alias(a) for a in attributes]))


@dataclass
class CallableExtractor(Extractor):
    """Any Python function from a text to {attribute: list of values}, run in Arrow batches; one call per text for all attributes."""

    function: Callable[[str | None], dict[str, list[str]]]
    attributes: Sequence[str]

    def prepare(self, docs: DataFrame, key: str) -> DataFrame:
        function, names = self.function, list(self.attributes)
        kind = T.StructType([T.StructField(a, T.ArrayType(T.StringType())) for a in names])

        @F.pandas_udf(kind)
        def call(text: pd.Series) -> pd.DataFrame:
            got = [function(t) for t in text]
            return pd.DataFrame({a: [g.get(a, []) for g in got] for a in names})

        text = [c for c in docs.columns if c != key][0]
        return docs.withColumn("__called", call(F.col(text)))

    def cell(self, text: Column, attribute: str) -> Column:
        return cell_of(F.col("__called")[attribute])
