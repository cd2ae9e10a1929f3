"""Steps that build a training corpus from facts, mentions and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.ranking import global_rank, hash_share, top_per_group

# Surface forms that name no subject of their own.
PRONOUNS = ["he", "she", "it", "him", "her", "they", "them", "none"]


def with_reflexive(facts: DataFrame, subject: str, attribute: str, answer: str, surface: str, placed: Column | None = None) -> DataFrame:
    """facts and, for each distinct subject with a surface form that is no pronoun, a row of attribute `id` whose answer is the subject itself; only where `placed`, that the surface form has a place in the text, holds if it is given."""
    own = facts.where(F.col(subject).isNotNull() & F.col(surface).isNotNull() & ~F.lower(surface).isin(PRONOUNS))
    own = own if placed is None else own.where(placed)
    reflexive = own.select(subject, surface).distinct().select(subject, F.lit("id").alias(attribute), F.col(subject).alias(answer), surface)
    return facts.unionByName(reflexive, allowMissingColumns=True)


def assign_splits(facts: DataFrame, document: str, attribute: str, tests: dict[str, Column], unseen: Sequence[str], development: float = 0.03, seed: int = 0) -> DataFrame:
    """facts with `split`: 3 and on for the named tests in order, 1 for unseen attributes, 2 for a share of (attribute, document) pairs, else 0."""
    out = None
    for i, test in enumerate(tests.values()):
        out = F.when(test, 3 + i) if out is None else out.when(test, 3 + i)
    pair = F.concat_ws("|", F.col(attribute).cast("string"), F.col(document).cast("string"))
    unseen_test, dev_test = F.col(attribute).isin(list(unseen)) if unseen else F.lit(False), hash_share(pair, seed) < development
    out = F.when(unseen_test, 1) if out is None else out.when(unseen_test, 1)
    return facts.withColumn("split", out.when(dev_test, 2).otherwise(0))


def without_pairs(rows: DataFrame, pairs: Sequence[tuple[str, str]], a: str, b: str) -> DataFrame:
    """rows whose (a, b) isn't one of the listed pairs; rows with nulls stay."""
    listed = rows.sparkSession.createDataFrame([*pairs], f"{a} string, {b} string") if pairs else None
    return rows if listed is None else rows.join(F.broadcast(listed), [a, b], "left_anti")


def group_mentions(rows: DataFrame, document: Sequence[str], query: Sequence[str], answer: Sequence[str], mention: Sequence[str]) -> DataFrame:
    """(document..., queries): queries of a document, in them answers, in them distinct mentions; all sorted. Rows with a null document column are left out."""
    for c in document:
        rows = rows.where(F.col(c).isNotNull())
    mentions = rows.groupBy(*document, *query, *answer).agg(F.array_sort(F.collect_set(F.struct(*mention))).alias("mentions"))
    answers = mentions.groupBy(*document, *query).agg(F.array_sort(F.collect_list(F.struct(*answer, "mentions"))).alias("answers"))
    return answers.groupBy(*document).agg(F.array_sort(F.collect_list(F.struct(*query, "answers"))).alias("queries"))


def confusion_texts(texts: DataFrame, key: str, types: str, split: str, seed: int = 0, width: int = 4) -> DataFrame:
    """(key, other): for each text another one of the same split that shares a type, chosen by seeded hash; null where there is none.

    No pairs of all texts of a type are formed: the texts of a type and split stand in a line in
    hash order, and each text's candidates are the `width` before and behind it there. The places come
    from one range-partitioned order of all, so a hot type is spread over as many tasks as it needs.
    """
    flat = texts.select(key, split, F.explode(F.array_distinct(types)).alias("type")).where("type is not null")
    place = hash_share(F.concat_ws("|", F.col(key).cast("string"), "type"), seed)
    line = global_rank(flat.withColumn("__u", place), [F.col(split), F.col("type"), F.col("__u"), F.col(key)], "__i")
    steps = F.array(*[F.lit(i) for i in range(-width, width + 1) if i])
    asks = line.select(key, split, "type", F.explode(F.transform(steps, lambda d: F.col("__i") + d)).alias("__i"))
    there = line.select(F.col(split).alias("__s"), F.col("type").alias("__t"), "__i", F.col(key).alias("other"))
    found = asks.join(there, "__i").where(F.col(split).eqNullSafe(F.col("__s")) & (F.col("type") == F.col("__t")) & (F.col("other") != F.col(key)))
    order = hash_share(F.concat_ws("|", F.col(key).cast("string"), F.col("other").cast("string")), seed)
    best = found.groupBy(key).agg(F.min_by("other", F.struct(order, "other")).alias("other"))
    return texts.select(key).distinct().join(best, key, "left")


def enrich(queries: DataFrame, texts: DataFrame, neighbors: DataFrame, key: str, most: int = 2) -> DataFrame:
    """queries with the text of the key and at most `most` neighbours (key, p, o) in order of p and o."""
    near = top_per_group(neighbors.where("o is not null"), [key], [F.col("p"), F.col("o")], most)
    lists = near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", "o"))).alias("evidence"))
    return queries.join(texts, key, "left").join(lists, key, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(lists.schema["evidence"].dataType)))


def named_neighbors(neighbors: DataFrame, names: DataFrame, key: str, most: int = 2) -> DataFrame:
    """(key, evidence, types): up to `most` neighbours (key, p, o) in order of p and o, with their label, description and types from names (id, label, description, types); types are those of all of these, sorted."""
    near = top_per_group(neighbors.where("o is not null").distinct(), [key], [F.col("p"), F.col("o")], most)
    told = near.join(names.select(F.col("id").alias("o"), "label", "description", "types"), "o", "left")
    words = F.concat_ws(", ", F.coalesce("label", "o"), "description")
    return told.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", "o", words.alias("text")))).alias("evidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("types", F.array().cast("array<string>")))))).alias("types"))


def prepared_texts(texts: DataFrame, facts: DataFrame, tests: Sequence[int], key: str = "doc") -> DataFrame:
    """(key, text, covers, testset, is_test): texts (key, text) with the distinct facts (key, s, p, o, start, end, split) that have a place, in order of it, the greatest split of any of their facts, and whether that is one of the tests. Texts without facts have none and split 0."""
    placed = facts.where("start is not null and end is not null").select(key, F.struct("start", "end", "s", "p", "o").alias("c")).distinct()
    covers = placed.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("covers"))
    splits = facts.groupBy(key).agg(F.max("split").alias("testset"))
    out = texts.join(covers, key, "left").join(splits, key, "left")
    split = F.coalesce("testset", F.lit(0))
    return out.select(key, "text", F.coalesce("covers", F.array().cast(covers.schema["covers"].dataType)).alias("covers"), split.alias("testset"), split.isin(list(tests)).alias("is_test"))


def cut_out(names: Column, key: Column, share: float, seed: int) -> Column:
    """Names of columns, of which a share is null by seeded hash of key and place."""
    return F.transform(names, lambda n, i: F.when(F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(100_000)) / 100_000.0 >= share, n))


def relevant_texts(asked: DataFrame, answers: DataFrame, by: Sequence[str], doc: str) -> DataFrame:
    """asked (by..., doc, ...) with `relevant`: whether answers (by..., doc) has one from that document."""
    have = answers.select(*by, doc).distinct().withColumn("__r", F.lit(True))
    return asked.join(have, [*by, doc], "left").withColumn("relevant", F.coalesce("__r", F.lit(False))).drop("__r")


def date_patterns(stamp: Column) -> Column:
    """A stamp at its own and all coarser precisions, finest first: full, minute, hour, day, month, year."""
    at = lambda n, rest: F.concat(F.substring(stamp, 1, n), F.lit(rest))
    forms = F.array(stamp, at(17, "00Z"), at(14, "00:00Z"), at(11, "00:00:00Z"), at(8, "00T00:00:00Z"), at(5, "00-00T00:00:00Z"))
    return F.when(stamp.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"), F.array_distinct(forms))


def match_dates(wanted: DataFrame, there: DataFrame, key: str, stamp: str) -> DataFrame:
    """(key, stamp, found): dates of `wanted` (key, stamp) with the finest pattern of theirs that `there` (key, stamp) holds."""
    each = wanted.select(key, stamp, F.posexplode(date_patterns(F.col(stamp))).alias("i", "found"))
    hit = each.join(there.select(key, F.col(stamp).alias("found")).distinct(), [key, "found"])
    return hit.groupBy(key, stamp).agg(F.min_by("found", "i").alias("found"))


def last_ends(rows: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Of answers that start at the same place, the longest."""
    return top_per_group(rows, [*by, start], [F.col(end).desc()])


def balanced(columns: Sequence[str], most: int = 7) -> list[list[str]]:
    """Columns in as few slices of at most `most` as there can be, as even as can be."""
    n = max(1, -(-len(columns) // most))
    size = -(-len(columns) // n) if columns else 0
    return [list(columns[i : i + size]) for i in range(0, len(columns), size)] if columns else []


def shuffled(values: Column, key: Column, seed: int) -> Column:
    """An array in an order that depends on key and seed alone."""
    tagged = F.transform(values, lambda v, i: F.struct(F.xxhash64(key, i, F.lit(seed)).alias("h"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(tagged), lambda x: x["v"])


def masked(tokens: Column, key: Column, share: float, mask: str, other: Column, seed: int) -> Column:
    """array<struct<token, target>>: a share of tokens hidden, of which 8 in 10 become `mask`, 1 in 10 another token and 1 in 10 stay; target is null elsewhere."""

    def one(t: Column, i: Column) -> Column:
        u = F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(100_000)) / 100_000.0
        v = F.pmod(F.xxhash64(key, i, F.lit(seed + 1)), F.lit(10))
        strange = F.get(other, F.pmod(F.xxhash64(key, i, F.lit(seed + 2)), F.size(other)).cast("int"))
        shown = F.when(u >= share, t).when(v < 8, F.lit(mask)).when(v == 8, strange).otherwise(t)
        return F.struct(shown.alias("token"), F.when(u < share, t).alias("target"))

    return F.transform(tokens, one)


def column_kind(value: Column) -> Column:
    """real for numbers, date for dates, else text; null for null."""
    return F.when(value.rlike(r"^\s*[+-]?[0-9][0-9,]*(\.[0-9]+)?%?\s*$"), "real").when(value.rlike(r"(?i)^\s*(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{1,2} [a-z]+ \d{4}|[a-z]+ \d{1,2}, \d{4})\s*$"), "date").when(value.isNotNull(), "text")


def column_kinds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, sample, kind): a least non-empty value of each column and the kind it has."""
    row = df.agg(*[F.min(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("sample")) for c in columns])
    return row.select(F.explode(pairs).alias("x")).select("x.*").withColumn("kind", column_kind(F.col("sample")))


def evidence_of(df: DataFrame, keys: Sequence[str], queried: Sequence[str], row_id: str, mode: str) -> DataFrame:
    """What of a table a model sees: `full` the queried columns and the row id, `row-id` queried cells as null, `none` no row at all."""
    shown = df.select(*keys, row_id, *[F.lit(None).cast(dict(df.dtypes)[c]).alias(c) if mode == "row-id" else F.col(c) for c in queried if c != row_id])
    return shown.where("false") if mode == "none" else shown


def name_pieces(df: DataFrame, name: str) -> DataFrame:
    """(piece): names and each of their words, distinct."""
    return df.select(F.explode(F.array_union(F.array(F.col(name)), F.split(name, " +"))).alias("piece")).where("piece is not null and piece <> ''").distinct()


def hypothesis_lines(df: DataFrame, line: str) -> DataFrame:
    """(number, text) of generator output lines `H-<number>\\t<score>\\t<text>`, by number; other lines are left out."""
    rx = r"^H-([0-9]+)\t[^\t]*\t(.*)$"
    return df.where(F.col(line).rlike(rx)).select(F.regexp_extract(line, rx, 1).cast("long").alias("number"), F.regexp_extract(line, rx, 2).alias("text"))


def boxscore_tables(df: DataFrame, key: str, scores: str) -> DataFrame:
    """(key, player, cells: map) of box scores held as map<statistic, map<player number, value>>; `N/A` and empty values are left out."""
    each = df.select(key, F.explode(scores).alias("stat", "by")).select(key, "stat", F.explode("by").alias("player", "value")).where("value is not null and value <> 'N/A' and value <> ''")
    return each.groupBy(key, "player").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stat", "value")))).alias("cells"))


def distances(a_start: Column, a_end: Column, spans: Column) -> Column:
    """The least distance in code points between a span and any of an array of spans (start, end); 0 where they touch, null without any."""
    gap = lambda s: F.greatest(F.lit(0), s["start"] - a_end, a_start - s["end"])
    return F.array_min(F.transform(spans, gap))


def align_values(values: DataFrame, names: DataFrame, columns: DataFrame, doc: str) -> DataFrame:
    """(doc, start, end, value, name, column): each number of a text with the nearest name and the nearest column word.

    values (doc, start, end, value), names (doc, start, end, name) and columns (doc, start, end, column) are spans; ties go to the earlier span. A
    document's names and columns are put to it once, as arrays.
    """
    listed = lambda df, what: df.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", "end", what))).alias(f"{what}s"))
    both = values.join(listed(names, "name"), doc, "left").join(listed(columns, "column"), doc, "left")

    def nearest(spans: str, what: str) -> Column:
        far = F.transform(spans, lambda s: F.struct(F.greatest(F.lit(0), s["start"] - F.col("end"), F.col("start") - s["end"]).alias("d"), s["start"].alias("at"), s[what].alias("v")))
        return F.array_min(far)["v"]

    return both.select(doc, "start", "end", "value", nearest("names", "name").alias("name"), nearest("columns", "column").alias("column"))
