"""Knowledge-base entities out of dump lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import short_uri, words_of_date

_SNAK = "struct<datatype:string,datavalue:struct<type:string,value:string>>"
_CLAIMS = f"map<string,array<struct<mainsnak:{_SNAK},rank:string,qualifiers:map<string,array<{_SNAK}>>>>>"

_WORDS = "struct<en:struct<value:string>>"
_ENTITY = f"struct<id:string,labels:{_WORDS},descriptions:{_WORDS},aliases:struct<en:array<struct<value:string>>>,claims:{_CLAIMS}>"


def _claims(entity: Column) -> Column:
    return F.from_json(F.get_json_object(entity, "$.claims"), _CLAIMS)


def _best(claims: Column) -> Column:
    """The preferred claims of a property, or else those that aren't deprecated."""
    preferred = F.filter(claims, lambda c: c["rank"] == "preferred")
    return F.when(F.size(preferred) > 0, preferred).otherwise(F.filter(claims, lambda c: c["rank"] != "deprecated"))


def _items(claims: Column) -> Column:
    """Ids of the items that claims name."""
    named = F.filter(claims, lambda c: (c["mainsnak"]["datatype"] == "wikibase-item") & c["mainsnak"]["datavalue"].isNotNull())
    return F.transform(named, lambda c: F.get_json_object(c["mainsnak"]["datavalue"]["value"], "$.id"))


def shred_entities(df: DataFrame, entity: str) -> DataFrame:
    """(wikidata_id, label, description, aliases, types, superclasses, neighbors) of entities as JSON text; English texts.

    Types and superclasses are P31 and P279, neighbours all items named by the best claims.
    """
    # one parse of each entity gives all of it
    e = df.select(F.from_json(entity, _ENTITY).alias("e")).select("e", F.col("e.claims").alias("c"))
    items = lambda p: F.coalesce(_items(_best(F.try_element_at("c", F.lit(p)))), F.array().cast("array<string>"))
    pairs = F.flatten(F.transform(F.map_entries("c"), lambda x: F.transform(_items(_best(x["value"])), lambda o: F.struct(o.alias("o"), x["key"].alias("p")))))
    aliases = F.transform("e.aliases.en", lambda a: a["value"])
    return e.select(
        F.col("e.id").alias("wikidata_id"), F.col("e.labels.en.value").alias("label"), F.col("e.descriptions.en.value").alias("description"),
        F.coalesce(aliases, F.array().cast("array<string>")).alias("aliases"), items("P31").alias("types"), items("P279").alias("superclasses"), F.coalesce(pairs, F.array().cast("array<struct<o:string,p:string>>")).alias("neighbors"),
    )


def properties(df: DataFrame, entity: str) -> DataFrame:
    """(wikidata_id, property, pos, kind, value, qualifiers): the best claims that have a value; value and qualifiers' values are JSON or plain text."""
    each = df.select(F.get_json_object(entity, "$.id").alias("wikidata_id"), F.explode(_claims(F.col(entity))).alias("property", "claims"))
    one = each.select("wikidata_id", "property", F.posexplode(_best(F.col("claims"))).alias("pos", "c")).where("c.mainsnak.datavalue is not null")
    plain = F.transform_values("c.qualifiers", lambda k, v: F.transform(v, lambda s: s["datavalue"]["value"]))
    return one.select("wikidata_id", "property", "pos", F.col("c.mainsnak.datavalue.type").alias("kind"), F.col("c.mainsnak.datavalue.value").alias("value"), plain.alias("qualifiers"))


def names_of(ids: DataFrame, labels: DataFrame, aliases: DataFrame, seed: int | None = None) -> DataFrame:
    """ids (id, ...) with `label` and `term`: the label of labels (id, label), or else the id itself; and one of the label and aliases (id, aliases), by seeded hash of the id, or the label without a seed."""
    named = ids.join(labels.select("id", "label").dropDuplicates(["id"]), "id", "left").join(aliases.select("id", F.col("aliases").alias("__a")).dropDuplicates(["id"]), "id", "left")
    label = F.coalesce("label", "id")
    terms = F.array_distinct(F.concat(F.array(label), F.coalesce(F.array_compact("__a"), F.array().cast("array<string>"))))
    term = label if seed is None else F.get(terms, F.pmod(F.xxhash64("id", F.lit(seed)), F.size(terms)).cast("int"))
    return named.select(*ids.columns, label.alias("label"), term.alias("term"))


def value_text(values: DataFrame, labels: DataFrame, style: str = "default", aliases: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """values (kind, value, ...) with `text`: in style default as words, with labels (id, label) for items and units; in style rand_term with one of
    the label and aliases (id, aliases) by seeded hash; in style uri as a URI, null for kinds without one.
    """
    get = lambda path: F.get_json_object("value", path)
    kind = F.col("kind")
    if style == "uri":
        text = F.when(kind == "time", F.concat(get("$.time"), F.lit("^^http://www.w3.org/2001/XMLSchema#dateTime"))).when(kind == "wikibase-entityid", F.concat(F.lit("http://www.wikidata.org/entity/"), get("$.id")))
        return values.withColumn("text", text)
    if style == "rand_term":
        every = labels.select("id").unionByName(aliases.select("id")).distinct() if aliases is not None else labels.select("id").distinct()
        labels = names_of(every, labels, aliases if aliases is not None else labels.select("id", F.array().cast("array<string>").alias("aliases")), seed).select("id", F.col("term").alias("label"))
    wanted = F.when(kind == "wikibase-entityid", get("$.id")).when(kind == "quantity", short_uri(get("$.unit")))
    named = values.withColumn("__id", wanted).join(labels.select(F.col("id").alias("__id"), F.col("label").alias("__label")), "__id", "left")
    text = (
        F.when(kind == "time", words_of_date(get("$.time"))).when(kind == "wikibase-entityid", F.coalesce("__label", "__id"))
        .when(kind == "quantity", F.concat(get("$.amount"), F.coalesce("__label", F.lit("")))).when(kind == "globecoordinate", F.concat_ws(", ", get("$.longitude"), get("$.latitude")))
        .when(kind == "monolingualtext", F.when(get("$.language") == "en", get("$.text")).otherwise("")).otherwise(F.col("value"))
    )
    return named.withColumn("text", text).drop("__id", "__label")


def class_rows(entities: DataFrame) -> DataFrame:
    """(node, parent) of entities' superclasses."""
    return entities.select(F.col("wikidata_id").alias("node"), F.explode("superclasses").alias("parent"))
