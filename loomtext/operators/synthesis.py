"""Training and test samples out of documents, their tables and the answers found in them.

An answer is a place of a text that fills a cell: (table, doc, row, column, start, end). Choices
follow seeded hashes, so a sample doesn't depend on how the rows are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import counts_of_words
from loomtext.operators.corpussteps import shuffled
from loomtext.operators.nesting import dependent

_CELL = ("table", "doc", "row", "column")


def tagged_names(texts: DataFrame, names: DataFrame, tags: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, surface, found): the given tags (key, start, end), and for documents without one the first place at which one of their names (key, name) stands as words.

    The longest of the names that begin there is taken. Documents without a tag or a name in the text have no row.
    """
    have = tags.select(key, "start", "end").where("start is not null").distinct()
    listed = names.where("name is not null and name <> ''").groupBy(key).agg(F.collect_set("name").alias("__names"))
    lone = texts.where(F.col(text).isNotNull()).join(have.select(key).distinct(), key, "left_anti").join(listed, key)
    edge = lambda at, n: ~F.coalesce(F.substring(F.col(text), at - 1, F.when(at > 1, 1).otherwise(0)).rlike(r"^[\p{L}\p{N}]$"), F.lit(False)) & ~F.coalesce(F.substring(F.col(text), at + n, F.lit(1)).rlike(r"^[\p{L}\p{N}]$"), F.lit(False))
    place = lambda n: F.position(n, F.col(text))
    spots = F.transform("__names", lambda n: F.when((place(n) > 0) & edge(place(n), F.length(n)), F.struct(place(n).alias("at"), (-F.length(n)).alias("len"), n.alias("n"))))
    best = F.array_min(F.array_compact(spots))
    found = lone.select(key, best.alias("b")).where("b is not null").select(key, (F.col("b.at") - 1).cast("int").alias("start"), (F.col("b.at") - 1 - F.col("b.len")).cast("int").alias("end"), F.lit(True).alias("found"))
    every = have.select(key, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(False).alias("found")).unionByName(found)
    return every.join(texts.select(key, text), key).select(key, "start", "end", F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")).alias("surface"), "found")


def headers(answers: DataFrame) -> DataFrame:
    """(table, header): the columns of each table, in order of their name; as wide as the table."""
    return answers.groupBy("table").agg(F.array_sort(F.collect_set("column")).alias("header"))


def training_samples(answers: DataFrame, refers: DataFrame | None = None, empty: int = 1, seed: int = 0) -> DataFrame:
    """(table, doc, row, column, kind, answers): what a model is asked of each row, and the places that answer it.

    kinds: `regular`, a cell and its places; `empty`, up to `empty` columns of the table that the row has no answer for, chosen by hash;
    `header`, one per table and document (row and column null) with the columns that it answers; `dependent`, given refers
    (doc, row, parent): the cells of rows that another row of their document is named by, under the parent's row. answers is an array of text.
    """
    good = answers.where("table is not null and doc is not null and row is not null and column is not null").distinct()
    cell = F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))
    regular = good.groupBy(*_CELL).agg(F.array_sort(F.collect_set(cell)).alias("answers")).select(*_CELL, F.lit("regular").alias("kind"), "answers")
    rows = good.groupBy("table", "doc", "row").agg(F.collect_set("column").alias("__have")).join(headers(good), "table")
    lacking = shuffled(F.array_sort(F.array_except("header", "__have")), F.concat_ws("|", "doc", "row"), seed)
    none = F.array().cast("array<string>")
    empties = rows.select("table", "doc", "row", F.explode(F.slice(lacking, F.lit(1), F.lit(empty))).alias("column")).select(*_CELL, F.lit("empty").alias("kind"), none.alias("answers"))
    null = F.lit(None).cast("string")
    heads = good.groupBy("table", "doc").agg(F.array_sort(F.collect_set("column")).alias("answers")).select("table", "doc", null.alias("row"), null.alias("column"), F.lit("header").alias("kind"), "answers")
    out = regular.unionByName(empties).unionByName(heads)
    if refers is not None:
        pairs = dependent(refers, "doc", "row", "parent").select("doc", F.col("key").alias("__p"), F.col("child").alias("row")).distinct()
        under = regular.join(pairs, ["doc", "row"]).select("table", "doc", F.col("__p").alias("row"), F.concat_ws("/", "row", "column").alias("column"), F.lit("dependent").alias("kind"), "answers")
        out = out.unionByName(under)
    return out


def test_samples(answers: DataFrame, kind: str, least: int = 2) -> DataFrame:
    """(table, group, asked, given, n): samples that imitate an operation on tables.

    `join`: a column is asked of all rows of a table, the other columns are given. `union`: all cells of a document are asked, the
    header is given. `multi-union`: as union, for documents with at least `least` rows, whose row names are asked as well. n counts the cells asked.
    """
    good = answers.select(*_CELL).where("table is not null and doc is not null and row is not null and column is not null").distinct()
    every = headers(good)
    if kind == "join":
        per = good.groupBy("table", "column").agg(F.count("*").alias("n")).join(every, "table")
        return per.select("table", F.col("column").alias("group"), F.array("column").alias("asked"), F.array_except("header", F.array("column")).alias("given"), "n")
    per = good.groupBy("table", "doc").agg(F.count("*").alias("n"), F.count_distinct("row").alias("rows"), F.array_sort(F.collect_set("column")).alias("__c")).join(every, "table")
    if kind == "union":
        return per.select("table", F.col("doc").alias("group"), F.col("__c").alias("asked"), F.col("header").alias("given"), "n")
    many = per.where(F.col("rows") >= least)
    return many.select("table", F.col("doc").alias("group"), F.array_append(F.col("__c"), F.lit("row")).alias("asked"), F.col("header").alias("given"), (F.col("n") + F.col("rows")).alias("n"))


def sample_statistics(samples: DataFrame, texts: DataFrame, answers: DataFrame, size: int = 64, overlap: int = 16) -> DataFrame:
    """(statistic, value, n): how many things have which number: rows, columns and documents of tables, answers of samples, tables of documents, windows of texts, and how often columns are asked and each kind occurs.

    texts (doc, text); a document's windows have at most `size` words, `overlap` of them shared.
    """

    def spread(df: DataFrame, by: Sequence[str], count: Column, name: str) -> DataFrame:
        return df.groupBy(*by).agg(count.cast("string").alias("value")).groupBy("value").agg(F.count("*").alias("n")).select(F.lit(name).alias("statistic"), "value", "n")

    def often(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("statistic"), "value", "n")

    cells = samples.where("kind = 'regular'")
    windows = F.greatest(F.lit(1), F.lit(1) + F.ceil((counts_of_words(F.coalesce("text", F.lit(""))) - size) / (size - overlap)))
    answered = samples.where("kind <> 'header'").select(F.concat_ws(":", "kind", F.size("answers").cast("string")).alias("a"))
    places = answers.where("start is not null").select((F.col("end") - F.col("start")).cast("string").alias("l"))
    parts = [
        spread(cells, ["table"], F.count_distinct("row"), "rows of tables"), spread(cells, ["table"], F.count_distinct("column"), "columns of tables"), spread(cells, ["table"], F.count_distinct("doc"), "documents of tables"),
        spread(cells, ["table", "doc"], F.count_distinct("row"), "rows of documents"), spread(cells, ["doc", "row"], F.count("*"), "cells of rows"), spread(cells, ["doc"], F.count_distinct("table"), "tables of documents"),
        spread(texts, ["doc"], F.max(windows), "windows of texts"), often(answered, "a", "answers of samples"), often(places, "l", "lengths of answers"), often(cells, "column", "columns asked"), often(samples, "kind", "kinds"), often(samples.where("kind = 'header'").select(F.size("answers").cast("string").alias("h")), "h", "columns of headers"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def linked_tables(parts: dict[str, DataFrame], doc: str, name: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Per kind of entity a table (id, name) of its distinct names, and links (doc, kind, id, number): which documents have which entity, in order of name.

    parts: rows (doc, name, ...) by kind; the id is a hash of kind and name, the same in every run.
    """
    tables, links = {}, None
    for kind, df in parts.items():
        rows = df.where(F.col(name).isNotNull() & F.col(doc).isNotNull()).select(doc, name).distinct().withColumn("id", F.substring(F.md5(F.concat_ws("|", F.lit(kind), F.col(name))), 1, 16))
        tables[kind] = rows.select("id", name).distinct()
        per = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(name, "id"))).alias("xs")).select(doc, F.lit(kind).alias("kind"), F.posexplode("xs").alias("number", "x")).select(doc, "kind", F.col("x.id").alias("id"), "number")
        links = per if links is None else links.unionByName(per)
    return tables, links


def assembled(rows: DataFrame, answers: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, columns...): one row per key of rows or of answers (key, column, value), its values listed by commas in order; empty text where neither says anything.

    Values of rows (key, columns...) come first; answers fill what is null there.
    """
    wide = answers.where(F.col("column").isin(list(columns)) & F.col("value").isNotNull()).groupBy(key, "column").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("v")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("column", "v"))).alias("__m"))
    both = rows.select(key, *columns).join(wide, key, "full")
    return both.select(key, *[F.coalesce(F.col(c).cast("string"), F.try_element_at("__m", F.lit(c)), F.lit("")).alias(c) for c in columns])
