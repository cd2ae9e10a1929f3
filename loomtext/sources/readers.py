"""Readers of text and document sources; each gives a lazy DataFrame."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions.text import camel_words
from loomtext.operators.tabletext import parse_tables

MENTIONS = "map<string,array<struct<mention:string,start:int,length:int>>>"
ANNOTATED = f"text string, report_number string, id string, mentions {MENTIONS}, mentions_diff_value {MENTIONS}"


def stem(path: Column) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(name, text): one row per file, read whole; empty files give none."""
    return spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(stem(F.input_file_name()).alias("name"), F.col("value").alias("text"))


def annotated_documents(spark: SparkSession, folder: str, test_names: Sequence[str] = (), test: bool | None = None) -> DataFrame:
    """(report_number, text, mentions, is_test) of annotated JSON files; `test` keeps the files named in test_names, or the others."""
    raw = spark.read.schema(ANNOTATED).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    named = raw.select(F.coalesce("report_number", "id").alias("report_number"), "text", "mentions", stem(F.input_file_name()).isin(list(test_names)).alias("is_test") if test_names else F.lit(False).alias("is_test"))
    return named if test is None else named.where(F.col("is_test") == F.lit(test))


def mention_labels(docs: DataFrame, key: str) -> DataFrame:
    """(key, row_key, attribute, pos, normed, start, end) of `mentions`; the longest mention of an attribute, the first among equals, is the normalised value of all."""
    each = docs.select(key, F.explode("mentions").alias("attribute", "ms"))
    longest = F.array_sort("ms", lambda a, b: F.when(F.length(a["mention"]) != F.length(b["mention"]), F.length(b["mention"]) - F.length(a["mention"])).otherwise(a["start"] - b["start"]))
    one = each.select(key, "attribute", F.get(longest, F.lit(0))["mention"].alias("normed"), F.posexplode("ms").alias("pos", "m"))
    return one.select(key, F.lit(None).cast("string").alias("row_key"), "attribute", "pos", "normed", F.col("m.start").alias("start"), (F.col("m.start") + F.col("m.length")).alias("end"))


def mention_evidence(docs: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """One row per document with the longest mention of each attribute, empty text where there is none."""
    longest = lambda a: F.get(F.array_sort(F.try_element_at("mentions", F.lit(a)), lambda x, y: F.when(F.length(x["mention"]) != F.length(y["mention"]), F.length(y["mention"]) - F.length(x["mention"])).otherwise(x["start"] - y["start"])), F.lit(0))["mention"]
    return docs.select(key, *[F.coalesce(longest(a), F.lit("")).alias(a) for a in attributes])


def json_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A DataFrame per *.json file of a folder; each file holds records, one per line or as a list."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(str(f.getPath().getName()) for f in files if str(f.getPath().getName()).endswith(".json"))
    return {n[:-5]: spark.read.option("multiLine", True).json(f"{folder}/{n}") for n in names}


def negated(df: DataFrame, key: str) -> DataFrame:
    """df with negative ids (-1 - id), so that rows of another database never clash."""
    return df.withColumn(key, -F.col(key) - 1)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, line): lines of one file by number from 0.

    The file is read in blocks by as many tasks. A line's number is its place in its block and the lines of the blocks before it.
    """
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = raw.groupBy("block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    # a row per block of the file
    before = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n") - F.col("first")).alias("shift"))
    return raw.join(before, "block").select((F.col("id") + F.col("shift")).alias("number"), "line")


def paired_lines(spark: SparkSession, data: str, text: str) -> DataFrame:
    """(number, data, text): two files zipped by line number; a line without partner is left out."""
    return lines(spark, data).withColumnRenamed("line", "data").join(lines(spark, text).withColumnRenamed("line", "text"), "number")


def pipe_tables(df: DataFrame, key: str, text: str, table: str) -> DataFrame:
    """(key, row, cells: map): rows of a named table in text; the first column is `Name` where its header is empty."""
    rows = parse_tables(F.col(text), table)
    header = F.transform(F.get(rows, F.lit(0)), lambda h: F.when(h == "", "Name").otherwise(h))
    body = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    each = df.select(key, header.alias("h"), F.posexplode(body).alias("row", "r"))
    fitted = F.slice(F.concat("r", F.array_repeat(F.lit(""), F.greatest(F.size("h") - F.size("r"), F.lit(0)))), F.lit(1), F.size("h"))
    return each.select(key, "row", F.map_from_arrays("h", fitted).alias("cells"))


def meaning_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(ref, cells: map) of a CSV with `mr` (`name[Alimentum], eatType[pub]`) and `ref`."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    parts = F.regexp_extract_all("mr", F.lit(r"([A-Za-z ]+)\[([^\]]*)\]"), F.lit(0))
    entry = lambda p: F.struct(camel_words(F.trim(F.regexp_extract(p, r"([A-Za-z ]+)\[", 1))).alias("key"), F.regexp_extract(p, r"\[([^\]]*)\]", 1).alias("value"))
    return raw.select("ref", F.map_from_entries(F.transform(parts, entry)).alias("cells"))


def infobox_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, cells: map) of one JSON object per line; `<none>` and null values are left out, lines that are no object give no row."""
    cells = F.from_json("line", "map<string,string>")
    kept = F.map_filter(cells, lambda k, v: v.isNotNull() & (v != "<none>"))
    return lines(spark, path).select("number", kept.alias("cells")).where("cells is not null")


def marked_rows(spark: SparkSession, path: str) -> DataFrame:
    """(number, cells: map, text) of lines `key||value||key||value<TAB>text`."""
    parts = F.split(F.get(F.split("line", "\t"), F.lit(0)), r"\|\|")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda i: F.struct(F.trim(F.get(parts, i * 2)).alias("key"), F.trim(F.get(parts, i * 2 + 1)).alias("value")))
    return lines(spark, path).where(F.size(parts) > 1).select("number", F.map_from_entries(pairs).alias("cells"), F.get(F.split("line", "\t"), F.lit(1)).alias("text"))


def dictionary_lines(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of one JSON object per line, all merged; the last line that holds a key counts."""
    each = lines(spark, path).select("number", F.explode(F.from_json("line", "map<string,string>")).alias("key", "value"))
    return each.groupBy("key").agg(F.max_by("value", "number").alias("value"))


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """(entity): JSON text of the entities of a dump, one per line between brackets, also bz2; unreadable lines are left out."""
    line = F.regexp_replace(F.trim("value"), ",$", "")
    return spark.read.text(path).select(line.alias("entity")).where(F.col("entity").startswith("{") & F.get_json_object("entity", "$.id").isNotNull())


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, text): the files of zip archives. An archive is opened where it lies, and one member at a time unpacked."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["path"]:
                system, at = FileSystem.from_uri(name if "://" in name else name.replace("file:/", "file:///", 1))
                with system.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    for member in z.namelist():
                        if not member.endswith("/"):
                            yield pd.DataFrame({"archive": [name], "member": [member], "text": [z.read(member).decode("utf-8", "replace")]})

    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    return names.mapInPandas(unpack, "archive string, member string, text string")


_LINE = r"^\d+\. (.+?) was diagnosed with (.+?) and (?:his|her) computer was diagnosed with (.+?)\.$"


def diagnosis_documents(df: DataFrame, number: str, line: str, per_document: int = 2) -> tuple[DataFrame, DataFrame]:
    """Documents (doc, text) of `per_document` lines each and their labels (doc, row_key, attribute, pos, normed, start, end).

    A line names a person, their diagnosis and their computer's; others give no labels but stay
    in the text. Offsets are those in the document. Lines are numbered from 0.
    """
    doc = F.floor(F.col(number) / per_document).cast("long")
    grouped = df.select(doc.alias("doc"), F.struct(F.col(number).alias("n"), F.col(line).alias("s")).alias("x")).groupBy("doc").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    docs = grouped.select("doc", F.array_join(F.transform("xs", lambda x: x["s"]), " ").alias("text"))
    before = lambda i: F.aggregate(F.slice("xs", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x["s"]) + 1)
    each = grouped.select("doc", F.explode(F.transform("xs", lambda x, i: F.struct(x["s"].alias("s"), before(i).alias("off")))).alias("x")).select("doc", "x.*").where(F.col("s").rlike(_LINE))
    name, ill, pc = (F.regexp_extract("s", _LINE, i) for i in (1, 2, 3))
    at_name = F.position(name, F.col("s")) - 1
    at_ill = F.position(F.concat(F.lit("diagnosed with "), ill), F.col("s")) - 1 + len("diagnosed with ")
    at_pc = F.length("s") - 1 - F.length(pc)
    labels = F.array(*[F.struct(F.lit(a).alias("attribute"), v.alias("normed"), (F.col("off") + p).alias("start")) for a, v, p in (("name", name, at_name), ("diagnosis", ill, at_ill), ("computer", pc, at_pc))])
    out = each.select("doc", name.alias("row_key"), F.posexplode(labels).alias("pos", "l"))
    return docs, out.select("doc", "row_key", "l.attribute", "pos", "l.normed", F.col("l.start").cast("int").alias("start"), (F.col("l.start") + F.length("l.normed")).cast("int").alias("end"))


def made_diagnoses(spark: SparkSession, n: int, names: Sequence[str], illnesses: Sequence[str], faults: Sequence[str]) -> DataFrame:
    """(number, line): n lines in the form diagnosis_documents reads, made from lists in turn."""
    pick = lambda xs, k: F.get(F.array(*[F.lit(x) for x in xs]), ((F.col("number") * k) % len(xs)).cast("int"))
    number = spark.range(n).withColumnRenamed("id", "number")
    return number.select("number", F.concat((F.col("number") + 1).cast("string"), F.lit(". "), pick(names, 1), F.lit(" was diagnosed with "), pick(illnesses, 3), F.lit(" and "), F.when(F.col("number") % 2 == 0, "his").otherwise("her"), F.lit(" computer was diagnosed with "), pick(faults, 5), F.lit(".")).alias("line"))


# parsers of infobox fields


def height_feet(text: Column) -> Column:
    """Feet as a decimal from `6 ft 7 in` or separate template fields `|ft=6|in=7`; null otherwise."""
    feet = F.coalesce(*[F.nullif(F.regexp_extract(text, rx, 1), F.lit("")) for rx in (r"(\d+) *ft", r"ft *= *(\d+)")])
    inch = F.coalesce(*[F.nullif(F.regexp_extract(text, rx, 1), F.lit("")) for rx in (r"(\d+) *in\b", r"in *= *(\d+)")], F.lit("0"))
    return F.round(feet.try_cast("double") + inch.try_cast("double") / 12, 2)


def birth_date(text: Column) -> Column:
    """A date from a template such as `{{birth date and age|1984|12|30}}`; null otherwise."""
    part = lambda i: F.regexp_extract(text, r"(?i)birth[ _]date[^|}]*\|(?:[a-z]+=[a-z]+\|)?(\d{4})\|(\d{1,2})\|(\d{1,2})", i)
    return F.when(part(1) != "", F.try_to_timestamp(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), F.lit("yyyy-MM-dd")).cast("date"))


def without_links(text: Column) -> Column:
    """`[[target|shown]]` as `shown` and `[[target]]` as `target`."""
    return F.regexp_replace(text, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")


def positions(text: Column) -> Column:
    """A player's positions, without links, split at slashes, commas and `and`."""
    return F.filter(F.transform(F.split(without_links(text), r" */ *| *, *| and "), lambda x: F.trim(x)), lambda p: p != "")


def years(text: Column, open_end: int) -> Column:
    """Every year of `2010–2014`, `2010` or `2010–present`; empty for other texts."""
    first = F.regexp_extract(text, r"(\d{4})", 1).try_cast("int")
    second = F.when(F.lower(text).contains("present"), open_end).otherwise(F.coalesce(F.nullif(F.regexp_extract(text, r"\d{4} *[–-] *(\d{4})", 1), F.lit("")).try_cast("int"), first))
    return F.when(first.isNotNull() & (second >= first), F.sequence(first, second)).otherwise(F.array().cast("array<int>"))


def teams_by_year(fields: Column, open_end: int) -> Column:
    """array<struct<year, team>> of an infobox's fields (map): `team1` with `years1` and on, or `coach_team1` where there is one; links and arrows are taken off, and a team without readable years is left out."""
    names = F.map_keys(fields)
    prefix = F.when(F.exists(names, lambda k: k.startswith("coach_team")), "coach_team").otherwise("team")
    mine = F.array_sort(F.filter(names, lambda k: k.startswith(prefix) & F.substring(k, F.length(prefix) + 1, F.length(k)).rlike("^[0-9]*$")))

    def one(k: Column) -> Column:
        span = F.coalesce(F.try_element_at(fields, F.concat(F.lit("years"), F.substring(k, F.length(prefix) + 1, F.length(k)))), F.lit(""))
        team = F.trim(F.regexp_replace(F.split_part(F.regexp_replace(F.try_element_at(fields, k), r"\[\[|\]\]", ""), F.lit("|"), F.lit(1)), "→", ""))
        return F.transform(years(span, open_end), lambda y: F.struct(y.alias("year"), team.alias("team")))

    return F.array_sort(F.flatten(F.transform(mine, one)))


def infer_view(rows: DataFrame, key: str) -> tuple[bool, str | None]:
    """Whether a table has several rows per document, and the column that tells them apart best: the most values distinct within a document, the first among equals."""
    columns = [c for c in rows.columns if c != key]
    per = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(c) for c in columns])
    got = per.agg(F.max("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).collect()[0]
    multi = (got["n"] or 0) > 1
    return multi, max(columns, key=lambda c: (got[c] or 0, -columns.index(c))) if multi and columns else None
