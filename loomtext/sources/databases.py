"""Whole databases of tables and labelled text collections out of folders of JSON files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.extractors import LabelExtractor
from loomtext.plans.catalog import Catalog
from loomtext.sources.readers import json_tables


def read_splits(spark: SparkSession, folder: str, split: str) -> dict[str, DataFrame]:
    """The tables in `folder/split`, and with the prefix `train_` those in `folder/train`."""
    return {**{f"train_{n}": df for n, df in json_tables(spark, f"{folder}/train").items()}, **json_tables(spark, f"{folder}/{split}")}


def remapped(df: DataFrame, names: DataFrame) -> DataFrame:
    """df with whole values of text columns replaced by those that names (value, name) gives for them."""
    for c, kind in df.dtypes:
        if kind == "string":
            by = names.select(F.col("value").alias(c), F.col("name").alias("__to"))
            df = df.join(by, c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to").select(*df.columns)
    return df


def renamed(df: DataFrame, drop: Sequence[str] = (), names: dict[str, str] | None = None) -> DataFrame:
    """df without some columns and with others under new names; columns that it lacks are passed over."""
    return df.drop(*drop).withColumnsRenamed(names or {})


def before_all(df: DataFrame, key: str) -> DataFrame:
    """df with keys moved below zero, the greatest to -1, so that they never clash with those of another split."""
    top = df.agg(F.max(key).alias("__top"))
    return df.withColumn("__one", F.lit(1)).join(top.withColumn("__one", F.lit(1)), "__one").withColumn(key, F.col(key) - F.col("__top") - 1).select(*df.columns)


def inconsistent(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of some columns that one of two tables has more often than the other, with `side`; none if they agree."""
    one, two = a.select(*columns), b.select(*columns)
    return one.exceptAll(two).withColumn("side", F.lit("first")).unionByName(two.exceptAll(one).withColumn("side", F.lit("second")))


def span_labels(labels: DataFrame, places: DataFrame, key: str, row: str | None, attributes: Sequence[str]) -> DataFrame:
    """(key, row_key, attribute, pos, normed, start, end) of a table of values and one of places.

    places has the same keys; a place is [start, end] or a list of such. A value without place, or an empty one, gives no label.
    """
    keys = [key] if row is None else [key, row]
    value = labels.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"`{a}`").cast("string").alias("normed")) for a in attributes])).alias("v")).select(*keys, "v.*")

    kinds = dict(places.dtypes)

    def spans(a: str):
        return F.col(f"`{a}`").cast("array<array<bigint>>") if kinds[a].startswith("array<array") else F.when(F.size(f"`{a}`") > 0, F.array(F.col(f"`{a}`").cast("array<bigint>")))

    place = places.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), spans(a).alias("spans")) for a in attributes])).alias("p")).select(*keys, "p.attribute", F.posexplode("p.spans").alias("pos", "s"))
    at = lambda i: F.get("s", F.lit(i)).cast("int")
    return value.where("normed <> ''").join(place, [*keys, "attribute"]).select(key, (F.lit(None).cast("string") if row is None else F.col(row)).alias("row_key"), "attribute", "pos", "normed", at(0).alias("start"), at(1).alias("end"))


def games_database(spark: SparkSession, folder: str, split: str, key: str = "Game ID") -> Catalog:
    """Statistics, information and link tables of players and teams, and reports with the latent tables Player and Team.

    Statistics are those of the training split, with ids below zero; reports, labels and information
    those of `split`. Teams go by their short names everywhere.
    """
    raw = read_splits(spark, folder, split)
    teams = raw["train_team_evidence"].select(F.col("Team Name").alias("value"), "name").where("value is not null").dropDuplicates(["value"])
    t = {n: renamed(remapped(df, teams), ["name"], {"Player Name": "name", "Team Name": "name"}) for n, df in raw.items()}
    c = Catalog(spark)
    reports = c.collection("reports", t["reports_table"].select(key, next(x for x in t["reports_table"].columns if x != key)), key)
    for kind in ("player", "team"):
        c.table(f"{kind}_stats", before_all(t[f"train_{kind}_labels"], key), [key])
        c.table(f"{kind}_info", t[f"{kind}_evidence"], ["name"])
        c.table(f"{kind}_to_reports", t[f"{kind}_to_reports"], ["name", key])
        columns = t[f"train_{kind}_labels"].columns
        attributes = [x for x in columns if x not in (key, "name")]
        places = t[f"{kind}_alignments"]
        labels = span_labels(t[f"{kind}_labels"], places, key, "name", attributes)
        reports.view(kind.title(), ["name", *attributes], LabelExtractor(labels, key), identifying="name")
    return c


def facts_database(spark: SparkSession, folder: str, split: str, tables: Sequence[str], key: str = "index") -> Catalog:
    """Tables named `collection-table` of facts and their reports: `-union` tables of the training split, `-join` tables of `split`, and a latent table for each.

    Tables of one collection must have the same reports; otherwise this is an error that counts what differs.
    """
    raw, c = read_splits(spark, folder, split), Catalog(spark)
    for name in tables:
        first = next(n for n in tables if n.split("-")[0] == name.split("-")[0])
        text = raw[f"{first}-reports"]
        differ = inconsistent(text, raw[f"{name}-reports"], text.columns).count()
        if differ:
            raise ValueError(f"{first} and {name} differ in {differ} reports")
        c.table(f"{name}-union", raw[f"train_{name}-labels"], [key])
        c.table(f"{name}-join", raw[f"{name}-labels"], [key])
        if name == first:
            c.collection(f"{name.split('-')[0]}_reports", text.select(key, next(x for x in text.columns if x != key)), key)
        attributes = [x for x in raw[f"{name}-labels"].columns if x != key]
        labels = span_labels(raw[f"{name}-normed"], raw[f"{name}-alignment"], key, None, attributes)
        c.texts[f"{name.split('-')[0]}_reports"].view(name.split("-")[1], attributes, LabelExtractor(labels, key))
    return c


def join_evidence(base: DataFrame, evidence: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """base with the columns of tables of evidence, each by its key; rows without evidence stay, and columns that base has already are not taken again."""
    for df, key in evidence:
        base = base.join(df.select(key, *[x for x in df.columns if x != key and x not in base.columns]), key, "left")
    return base


def union_evidence(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables of evidence; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
