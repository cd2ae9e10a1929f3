"""Queries p1, p2 and p4 over the knowledge-base tables and delivered reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.ids import kb_id
from loomtext.functions.values import key_to_double, value_key
from loomtext.operators.hierarchy import Hierarchy, hierarchy
from loomtext.operators.latest import latest_rows
from loomtext.operators.reports import ReportTables
from loomtext.operators.widetable import pivot_wide
from loomtext.queries.tables import table


def current_entities(spark: SparkSession, folder: str) -> DataFrame:
    """(id, parents): the current row of each entity, ids as Q and digits."""
    e = table(spark, folder, "entities")
    parents = F.array_compact(F.array_distinct(F.transform("superclasses", lambda x: kb_id(x, "Q"))))
    now = latest_rows(e, kb_id(F.col("wikidata_id"), "Q"), [F.col("modified_at"), F.col("ingested_at")], {"parents": F.array_sort(parents)})
    return now.select(F.col("key").alias("id"), "parents")


def entity_hierarchy(spark: SparkSession, folder: str) -> Hierarchy:
    return hierarchy(current_entities(spark, folder), "id", "parents")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return entity_hierarchy(spark, folder).cyclic.select(F.col("id").alias("wikidata_id"))


def p1_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    out = entity_hierarchy(spark, folder).summary()
    return out.select(F.col("id").alias("wikidata_id"), "depth", "max_depth", "n_paths", F.array_join("roots", ",").alias("roots"), "on_cycle", "under_cycle", "n_descendants", "missing")


def p1_paths(spark: SparkSession, folder: str) -> DataFrame:
    return entity_hierarchy(spark, folder).paths().select(F.col("id").alias("wikidata_id"), F.array_join("path", "/").alias("path"), F.get("path", F.lit(0)).alias("root"), (F.size("path") - 1).alias("depth"))


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return entity_hierarchy(spark, folder).descendants().select(F.col("id").alias("wikidata_id"), F.col("descendant").alias("descendant_id"), "distance")


def facts(spark: SparkSession, folder: str) -> tuple[DataFrame, list[tuple[str, str, bool]]]:
    """Facts (entity, attr, key) of raw_queries, and the attributes in order of their id."""
    a = table(spark, folder, "attributes").select("attr_id", "value_type", "single_valued")
    names = sorted((r["attr_id"], r["value_type"], bool(r["single_valued"])) for r in a.where("attr_id is not null").collect())
    # without null attributes the join needs no test of them, which would read the ids twice
    q = table(spark, folder, "raw_queries").select(kb_id(F.col("_subject_uri"), "Q").alias("entity"), F.coalesce(kb_id(F.col("_attr_uri"), "P"), F.lit("")).alias("attr"), F.col("_answer_uri").alias("answer"))
    typed = q.join(a.select(F.col("attr_id").alias("attr"), F.col("value_type").alias("kind")), "attr")
    return typed.select("entity", "attr", value_key(F.col("kind"), F.col("answer")).alias("key")), names


#: Attributes in a block: three blocks of the tables' 24.
BLOCK = 8


def wide(spark: SparkSession, folder: str, block_size: int = BLOCK) -> DataFrame:
    rows, names = facts(spark, folder)
    same = lambda key: key
    return pivot_wide(rows, names, {"item": same, "time": same, "string": same, "quantity": key_to_double}, block_size)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return wide(spark, folder).select(F.col("entity").alias("subject_id"), F.explode("conflicts").alias("attr_id")).distinct()


def p2_wide(spark: SparkSession, folder: str) -> DataFrame:
    return wide(spark, folder).withColumnRenamed("entity", "subject_id")


def p2_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The filled cells of the wide table as text, lists in order by commas, quantities with six decimals; null where a single-valued cell has a conflict."""
    w = wide(spark, folder)
    plain = lambda x: x.cast("decimal(38,6)").cast("string")
    flat = {"array<string>": lambda c: F.array_join(F.array_sort(c), ","), "array<double>": lambda c: F.array_join(F.transform(F.array_sort(c), plain), ","), "double": lambda c: plain(F.col(c))}
    cells = [F.struct(F.lit(c).alias("attr_id"), flat.get(kind, F.col)(c).alias("value"), F.array_contains("conflicts", c).alias("conflict")) for c, kind in w.dtypes if c not in ("entity", "conflicts")]
    each = w.select(F.col("entity").alias("subject_id"), F.explode(F.filter(F.array(*cells), lambda x: x["value"].isNotNull())).alias("x"))
    return each.select("subject_id", "x.attr_id", F.when(~F.col("x.conflict"), F.col("x.value")).alias("value"), "x.conflict")


def p2_many(spark: SparkSession, folder: str, copies: int = 20) -> DataFrame:
    """Hundreds of attributes: each fact is put under one of `copies` versions of its attribute, by its subject; per attribute, the subjects that have it and the conflicts."""
    rows, names = facts(spark, folder)
    number = F.pmod(F.regexp_extract("entity", "([0-9]+)", 1).cast("long"), F.lit(copies))
    many = rows.withColumn("attr", F.concat("attr", F.lit("_"), number.cast("string")))
    same = lambda key: key
    w = pivot_wide(many, [(f"{a}_{i}", kind, one) for i in range(copies) for a, kind, one in names], {"item": same, "time": same, "string": same, "quantity": key_to_double}, 60)
    # the columns are counted at once and turned into rows at the end
    counts = w.agg(F.array(*[F.struct(F.lit(c).alias("attr_id"), F.count(f"`{c}`").alias("n")) for c in w.columns if c not in ("entity", "conflicts")]).alias("c"))
    bad = w.select(F.explode("conflicts").alias("attr_id")).groupBy("attr_id").agg(F.count("*").alias("n_conflicts"))
    return counts.select(F.explode("c").alias("x")).select("x.attr_id", F.col("x.n").alias("n_subjects")).where("n_subjects > 0").join(bad, "attr_id", "left").select("attr_id", "n_subjects", F.coalesce("n_conflicts", F.lit(0)).cast("long").alias("n_conflicts"))


def reports(spark: SparkSession, folder: str) -> ReportTables:
    return ReportTables(table(spark, folder, "annotated_reports"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return reports(spark, folder).mentions().where("located and not agrees").select("report_number", "attribute", "pos")


def p4_reports(spark: SparkSession, folder: str) -> DataFrame:
    return reports(spark, folder).reports.select("report_number", "revision", "file_id", "text")


def p4_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return reports(spark, folder).mentions()


def p4_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return reports(spark, folder).rounds()


def p4_checks(spark: SparkSession, folder: str) -> DataFrame:
    return reports(spark, folder).checks()


def p4_bridge(spark: SparkSession, folder: str) -> DataFrame:
    return reports(spark, folder).bridge().select(F.hex("parent").alias("parent"), "field", "ordinal", "place", F.hex("child").alias("child"), "value")


def p4_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return reports(spark, folder).occurrences.select("file_id", "at", F.hex("hash").alias("hash"), "root", "parent")


def p4_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Per file its objects, and those at the top."""
    return reports(spark, folder).occurrences.groupBy("file_id").agg(F.count("*").alias("n_objects"), F.count("root").alias("n_roots"))


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """How often an object stands in another one under each field, by the bridge of contents and their occurrences."""
    t = reports(spark, folder)
    times = t.occurrences.groupBy(F.col("hash").alias("parent")).agg(F.count("*").alias("times"))
    return t.bridge().where("child is not null").groupBy("parent", "field").agg(F.count("*").alias("n")).join(times, "parent").groupBy("field").agg(F.sum(F.col("n") * F.col("times")).alias("n_links"))


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_paths, p1_descendants, p2_found, p2_wide, p2_cells, p2_many, p4_found, p4_reports, p4_mentions, p4_rounds, p4_checks, p4_bridge, p4_occurrences, p4_objects, p4_links)}

_ID = r"upper(regexp_extract({0}, '(?i)^(?:.*[/:#])?\s*({1}[0-9]+)\s*$', 1))"
_NOW = f"""
 now as (select id, superclasses from (
   select {_ID.format('wikidata_id', 'Q')} as id, superclasses,
     row_number() over (partition by {_ID.format('wikidata_id', 'Q')} order by modified_at desc nulls last, ingested_at desc nulls last) as rn
   from entities) where rn = 1 and id <> ''),
 raw_edges as (select distinct id as c, {_ID.format('p', 'Q')} as p from (select id, unnest(superclasses) as p from now)),
 edges as (select c, p from raw_edges where p in (select id from now))"""
_REACH = f"""with recursive {_NOW},
 reach as (select c, p from edges union select r.c, e.p from reach r join edges e on r.p = e.c),
 cyc as (select c as id from reach where c = p)"""
# links above a cycle node aren't followed: its own path starts there
_PATHS = f"""{_REACH},
 up as (select c, p from edges where c not in (select id from cyc)),
 paths as (
   select id, id as path, id as root, 0 as depth from now where id not in (select c from up)
   union all
   select u.c, x.path || '/' || u.c, x.root, x.depth + 1 from paths x join up u on u.p = x.id)"""

_ANSWERS = f"""
 f as (select {_ID.format('_subject_uri', 'Q')} as s, {_ID.format('_attr_uri', 'P')} as a, _answer_uri as v from raw_queries),
 t as (select s, a, value_type as k, single_valued, v from f join attributes on attr_id = a
   where s <> '' and v is not null and lower(trim(v)) not in ('', '-', '--', '?', 'n/a', 'na', 'nan', 'nil', 'none', 'novalue', 'null', 'somevalue', 'unknown') and not trim(v) like '\\_:%' escape '\\'),
 keyed as (select s, a, single_valued, k, case
   when k = 'item' then nullif({_ID.format('v', 'Q')}, '')
   when k = 'quantity' then case when regexp_matches(v, '^\\s*[+-]?([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)(\\.[0-9]*)?([eE][+-]?[0-9]+)?(\\^\\^.*)?\\s*$') then cast(cast(replace(regexp_replace(v, '\\^\\^.*$', ''), ',', '') as double) as varchar) end
   when k = 'string' then nfc_normalize(trim(v, E' \\t\\n\\r\\u00a0'))
   else case
     when regexp_matches(v, '^\\s*[+-]?[0-9]+-[0-9]{{2}}-[0-9]{{2}}') then case
       when cast(regexp_extract(v, '^\\s*[+-]?([0-9]+)-', 1) as int) = 0 or cast(regexp_extract(v, '-([0-9]{{2}})-[0-9]{{2}}', 1) as int) > 12 or cast(regexp_extract(v, '-[0-9]{{2}}-([0-9]{{2}})', 1) as int) > 31 then null
       else (case when ltrim(v) like '-%' then '-' else '' end) || cast(cast(regexp_extract(v, '^\\s*[+-]?([0-9]+)-', 1) as int) as varchar) || '|' || regexp_extract(v, '-([0-9]{{2}}-[0-9]{{2}})', 1) end
     else coalesce(strftime(try_strptime(trim(v), '%B %d, %Y'), '%Y|%m-%d'), strftime(try_strptime(trim(v), '%d %B %Y'), '%Y|%m-%d')) end
   end as key from t)"""

_RECORDS = """
 valid as (select file_id, received_at, payload::json as j from annotated_reports where payload is not null and trim(payload) <> '' and json_valid(payload)),
 cand as (
   select file_id, received_at, case when json_type(j) = 'OBJECT' and json_extract(j, '$.batch.document') is not null then json_extract(j, '$.batch.document') else j end as r from valid where json_type(j) = 'OBJECT'
   union all
   select file_id, received_at, unnest(json_extract(j, '$[*]')) from valid where json_type(j) = 'ARRAY'),
 rec as (select try_cast(trim(coalesce(json_extract_string(r, '$.report_number'), json_extract_string(r, '$.id'))) as bigint) as report_number, try_cast(json_extract_string(r, '$.revision') as bigint) as revision, received_at, file_id, r from cand where json_type(r) = 'OBJECT'),
 best as (select * from (select *, row_number() over (partition by report_number order by revision desc nulls last, received_at desc, file_id desc) as rn from rec where report_number is not null) where rn = 1),
 attrs as (select report_number, json_extract_string(r, '$.text') as text, json_extract(r, '$.mentions') as m, unnest(json_keys(json_extract(r, '$.mentions'))) as attribute from best),
 vals as (select report_number, text, attribute, json_extract(m, '$."' || attribute || '"') as x from attrs),
 els as (
   select report_number, text, attribute, 0 as pos, x as e from vals where json_type(x) = 'OBJECT'
   union all
   select report_number, text, attribute, cast(i as int) as pos, json_extract(x, '$[' || i || ']') as e from (select *, unnest(range(cast(json_array_length(x) as bigint))) as i from vals where json_type(x) = 'ARRAY')),
 ment as (select report_number, attribute, pos, text, json_extract_string(e, '$.mention') as mention, json_extract_string(e, '$.start') as s, json_extract_string(e, '$.length') as l from els where json_type(e) = 'OBJECT'),
 placed as (select *, cast(try_cast(trim(s) as double) as bigint) as st, cast(try_cast(trim(l) as double) as bigint) as le from ment)"""

_ROUNDS = """
 evals as (select report_number, json_extract(r, '$.evaluation.rounds') as x from best),
 rounds as (select report_number, cast(i as int) as round, json_extract(x, '$[' || i || ']') as e from (select *, unnest(range(cast(json_array_length(x) as bigint))) as i from evals where json_type(x) = 'ARRAY'))"""

SQL = {
    "p1_found": f"{_REACH} select id as wikidata_id from cyc",
    "p1_paths": f"{_PATHS} select id as wikidata_id, path, root, depth from paths",
    "p1_hierarchy": f"""{_PATHS},
 anc as (select c, p, 1 as d from up),
 closure as (select c, p from up union select x.c, u.p from closure x join up u on x.p = u.c),
 below as (select p as id, count(*) as n from closure group by p),
 miss as (select c as id, count(*) as n from raw_edges where p <> '' and p not in (select id from now) group by c),
 per as (select id, min(depth) as depth, max(depth) as max_depth, count(*) as n_paths, string_agg(distinct root, ',' order by root) as roots, bool_or(root in (select id from cyc)) as headed from paths group by id)
 select p.id as wikidata_id, depth, max_depth, n_paths, roots, p.id in (select id from cyc) as on_cycle, headed and p.id not in (select id from cyc) as under_cycle, coalesce(below.n, 0) as n_descendants, coalesce(miss.n, 0) as missing
 from per p left join below using (id) left join miss using (id)""",
    "p1_descendants": f"""{_PATHS},
 dist as (select c, p, 1 as d from up union select x.c, u.p, x.d + 1 from dist x join up u on x.p = u.c)
 select p as wikidata_id, c as descendant_id, min(d) as distance from dist group by p, c""",
    "p2_found": f"with {_ANSWERS} select s as subject_id, a as attr_id from keyed where single_valued and key is not null group by s, a having count(distinct key) > 1",
    "p2_cells": f"""with {_ANSWERS}, shown as (select s, a, single_valued, k, key, case
   when k = 'quantity' then cast(cast(try_cast(key as double) as decimal(38,6)) as varchar)
   when k = 'time' then (case when key like '-%' then '-' else '+' end) || lpad(split_part(ltrim(key, '-'), '|', 1), 4, '0') || '-' || split_part(key, '|', 2) else key end as v from keyed where key is not null),
 each as (select distinct s, a, single_valued, k, key, v from shown)
 select s as subject_id, a as attr_id, case when single_valued and count(*) > 1 then null when k = 'quantity' then string_agg(v, ',' order by try_cast(key as double)) else string_agg(v, ',' order by v) end as value, single_valued and count(*) > 1 as conflict
 from each group by s, a, single_valued, k""",
    "p2_many": f"""with {_ANSWERS}, m as (select s, single_valued, key, a || '_' || cast(cast(s[2:] as bigint) % 20 as varchar) as a from keyed where key is not null),
 n as (select s, a, single_valued and count(distinct key) > 1 as bad from m group by s, a, single_valued)
 select a as attr_id, count(*) as n_subjects, count(*) filter (bad) as n_conflicts from n group by a""",
    "p4_found": f"with {_RECORDS} select report_number, attribute, pos from placed where s is not null and l is not null and coalesce(not (st >= 0 and le >= 0 and st + le <= length(text) and substring(text, st + 1, le) = mention), true)",
    "p4_mentions": f"with {_RECORDS} select report_number, attribute, pos, mention, st as start, le as length, s is not null and l is not null as located, coalesce(st >= 0 and le >= 0 and st + le <= length(text) and substring(text, st + 1, le) = mention, false) as agrees from placed",
    "p4_reports": f"with {_RECORDS} select report_number, revision, file_id, coalesce(json_extract_string(r, '$.text'), '') as text from best",
    "p4_rounds": f"with {_RECORDS}, {_ROUNDS} select report_number, round, json_extract_string(e, '$.annotator') as annotator from rounds",
    "p4_checks": f"""with {_RECORDS}, {_ROUNDS},
 checks as (select report_number, round, cast(i as int) as "check", json_extract(e, '$.checks[' || i || ']') as c from (select *, unnest(range(coalesce(cast(json_array_length(e, '$.checks') as bigint), 0))) as i from rounds))
 select report_number, round, "check", json_extract_string(c, '$.attr') as attribute, json_extract_string(c, '$.ok') = 'true' as ok, cast(json_extract(c, '$.hits') as varchar) as hits from checks""",
    "p4_links": r"""with valid as (select payload::json as j from annotated_reports where payload is not null and trim(payload) <> '' and json_valid(payload)),
 n as (select regexp_extract(t.fullkey, '\."?([^."\[\]]+)"?(?:\[[0-9]+\])*$', 1) as field from valid, json_tree(j) t where t.type = 'OBJECT')
 select field, count(*) as n_links from n where field <> '' group by field""",
    "p4_objects": """with valid as (select file_id, payload::json as j from annotated_reports where payload is not null and trim(payload) <> '' and json_valid(payload)),
 tops as (select file_id, case when json_type(j) = 'OBJECT' then 1 else len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) = 'OBJECT')) end as n_roots from valid)
 select o.file_id, n_objects, n_roots from (select file_id, count(*) as n_objects from valid, json_tree(j) t where t.type = 'OBJECT' group by file_id) o join tops on tops.file_id = o.file_id""",
}
