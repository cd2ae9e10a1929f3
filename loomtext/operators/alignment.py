"""Alignment of values with the entities and columns that a text says them of. Places are half-open code points."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import counts_of_words
from loomtext.operators.joins import nearest
from loomtext.operators.spans import find_spans

#: Kinds of spans that a value is measured against, and the units of the measures.
KINDS, UNITS = ("name", "column", "team"), ("characters", "words", "sentences")
_WORD, _SENTENCE, _NAME = r"(?<!\S)\S", r"[.!?]+\s+", r"[A-Z][a-z]+ [A-Z][a-z]+"
#: Pronouns that stand for the last person named.
PERSONS = "He|She|he|she|him|her|His|Her|his"


def words_between(text: Column, a: Column, b: Column) -> Column:
    """How many words begin between two places, whichever comes first."""
    low, high = F.least(a, b), F.greatest(a, b)
    return counts_of_words(F.substring(text, low.cast("int") + 1, (high - low).cast("int"))).cast("int")


def align_qualifiers(qualifiers: DataFrame, mentions: DataFrame, texts: DataFrame, doc: str, most: int = 30, reach: int = 2000) -> DataFrame:
    """(doc, subject, property, value, start, end, characters, words, after): mentions of qualifiers' values that belong to a mention of their subject.

    qualifiers (doc, subject, property, value) are distinct, mentions (doc, uri, start, end), texts (doc, text). Each
    mention of the value is put to the nearest mention of the subject, at most `reach` characters away, and kept if at most `most` words lie between; after tells
    that it follows the subject.
    """
    said = mentions.select(F.col(doc), F.col("uri").alias("value"), "start", "end").distinct()
    asked = qualifiers.select(doc, "subject", "property", "value").where("subject is not null and value is not null").distinct().join(said, [doc, "value"])
    key = F.concat_ws("\x1f", F.col(doc).cast("string"), F.col("__s"))
    mine = asked.withColumn("__s", F.col("subject")).withColumn("__k", key)
    there = mentions.withColumn("__s", F.col("uri")).withColumn("__k", key).select("__k", "start", F.col("start").alias("at")).distinct()
    met = nearest(mine, there, "__k", "start", ["at"], reach).where("at is not null").join(texts.select(doc, "text"), doc)
    words = words_between(F.col("text"), F.col("start"), F.col("at"))
    out = met.select(doc, "subject", "property", "value", "start", "end", F.col("distance").alias("characters"), words.alias("words"), (F.col("start") > F.col("at")).alias("after"))
    return out.where(F.col("words") <= most)


def _gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), b["start"] - a["end"], a["start"] - b["end"])


def distance_features(df: DataFrame, text: str, value: str, spans: dict[str, str]) -> DataFrame:
    """df with `features`: map of how far a value's span (struct start, end) is from the spans of each kind (arrays of such structs).

    Of each kind the nearest span is taken (ties to the earlier one); features are its distance in each unit, whether it comes
    first and whether it is in the same sentence, and how many there are; also where in the text the value stands. Kinds without spans give null.
    """
    upto = lambda rx, at: F.regexp_count(F.substring(F.col(text), F.lit(1), at), F.lit(rx))
    number = {"words": lambda at: upto(_WORD, at + 1), "sentences": lambda at: upto(_SENTENCE, at)}
    v = F.col(value)
    own = {unit: f(v["start"]) for unit, f in number.items()}
    pairs: list[Column] = [F.lit("place"), (v["start"] / F.greatest(F.length(text), F.lit(1))).cast("double")]
    for kind, column in spans.items():
        best = F.array_min(F.transform(F.col(column), lambda s: F.struct(_gap(v, s).alias("d"), s["start"].alias("start"), s["end"].alias("end"))))
        far = {"characters": best["d"]} | {unit: F.abs(f(best["start"]) - own[unit]) for unit, f in number.items()}
        for unit in UNITS:
            pairs += [F.lit(f"{kind}_{unit}"), far[unit].cast("double")]
        pairs += [F.lit(f"{kind}_first"), (best["start"] < v["start"]).cast("double"), F.lit(f"{kind}_same_sentence"), (far["sentences"] == 0).cast("double"), F.lit(f"{kind}_count"), F.size(F.coalesce(F.col(column), F.array().cast("array<struct<start:int,end:int>>"))).cast("double")]
    return df.withColumn("features", F.create_map(*pairs))


def nearer(a: Column, b: Column) -> Column:
    """Whether the candidate of features a beats that of b: by sentences, then words, from the name; then from the column."""
    score = lambda m: F.struct(*[F.coalesce(m[f"{k}_{u}"], F.lit(1e9)).alias(f"{k}_{u}") for k in ("name", "column") for u in ("sentences", "words", "characters")])
    return score(a) < score(b)


def tournament(candidates: DataFrame, by: Sequence[str], candidate: str, features: str, beats: Callable[[Column, Column], Column] = nearer) -> DataFrame:
    """(by..., candidate, wins): of the candidates for one value that which beats most others; ties go to the lesser candidate.

    A value's candidates are few, the mentions of one document; `beats` may be any model of two maps of features.
    """
    held = candidates.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(candidate).alias("c"), F.map_entries(features).alias("f")))).alias("__cs"))
    maps = F.transform("__cs", lambda x: F.struct(x["c"].alias("c"), F.map_from_entries(x["f"]).alias("f")))
    wins = F.transform("__ms", lambda a: F.struct(F.size(F.filter("__ms", lambda b: F.coalesce(beats(a["f"], b["f"]), F.lit(False)))).alias("wins"), a["c"].alias("c")))
    best = F.aggregate(wins, F.get(wins, F.lit(0)), lambda acc, w: F.when(w["wins"] > acc["wins"], w).otherwise(acc))
    return held.withColumn("__ms", maps).select(*by, best.alias("b")).select(*by, F.col("b.c").alias(candidate), F.col("b.wins").alias("wins"))


def extracted_relations(docs: DataFrame, key: str, text: str, units: dict[str, str], names: str = _NAME) -> DataFrame:
    """(key, entity, relation, value, start): numbers that a text says of someone, by templates of one or two words.

    units: relation by the one or two words behind the number, such as {"points": "PTS", "field goals": "FGM"}; two words
    win over one. The entity is the last name before the number; a pronoun between them stands for the last name before it, so the name
    is the same. Numbers before any name have a null entity.
    """
    ordered = sorted(units, key=lambda u: (-u.count(" "), u))
    rx = rf"\b[0-9]+(?= (?:{'|'.join(ordered)})\b)"
    each = docs.select(key, text, F.explode(find_spans(F.col(text), rx)).alias("n"))
    behind = F.substring(F.col(text), F.col("n.end") + 2, F.lit(80))
    unit = F.coalesce(*[F.when(behind.rlike(rf"^{u}\b"), F.lit(units[u])) for u in ordered])
    before = F.substring(F.col(text), F.lit(1), F.col("n.start"))
    entity = F.try_element_at(F.regexp_extract_all(before, F.lit(f"({names})"), F.lit(1)), F.lit(-1))
    return each.select(key, entity.alias("entity"), unit.alias("relation"), F.col("n.value").cast("bigint").alias("value"), F.col("n.start").alias("start"))


def with_persons(docs: DataFrame, key: str, text: str, names: str = _NAME) -> DataFrame:
    """(key, start, end, surface, entity): names and the pronouns that stand for persons, each with the last name at or before it; pronouns before any name are left out."""
    found = docs.select(key, text, F.explode(find_spans(F.col(text), rf"{names}|\b(?:{PERSONS})\b")).alias("s"))
    upto = F.substring(F.col(text), F.lit(1), F.col("s.end"))
    entity = F.try_element_at(F.regexp_extract_all(upto, F.lit(f"({names})"), F.lit(1)), F.lit(-1))
    return found.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("surface"), entity.alias("entity")).where("entity is not null")
