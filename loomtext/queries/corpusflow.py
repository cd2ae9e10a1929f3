"""Queries of the steps that build a training corpus, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.operators import corpussteps as cs
from loomtext.operators import metrics
from loomtext.operators.ranking import top_per_group
from loomtext.queries.corpus import _RECORDS
from loomtext.queries.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def raw(spark, folder):
    return table(spark, folder, "raw_queries").select(F.col("_doc").alias("doc"), F.col("_subject_uri").alias("s"), F.col("_attr_uri").alias("a"), F.col("_answer_uri").alias("o"), F.col("_subject_label").alias("label"), F.col("_answer_start").alias("start"), F.col("_answer_end").alias("end"))


@query("""with q as (select _subject_uri as s, _attr_uri as a, _answer_uri as o, _subject_label as label, _answer_start as start from raw_queries)
select a, count(*) as n from (select a from q union all select 'id' from (select distinct s, label from q where s is not null and start is not null and label is not null and lower(label) not in ('he','she','it','him','her','they','them','none'))) group by a""")
def flow_reflexive(spark, folder):
    return cs.with_reflexive(raw(spark, folder).select("s", "a", "o", "label", "start"), "s", "a", "o", "label", F.col("start").isNotNull()).groupBy("a").agg(F.count("*").alias("n"))


@query("""with q as (select _doc as doc, _attr_uri as a, ('0x' || substring(md5(concat_ws('|', _attr_uri, _doc) || '|4'), 1, 8))::bigint / 4294967296.0 as u from raw_queries)
select doc, a, case when doc like '%7' then 3 when doc like '%8' then 4 when a = 'P105' then 1 when u < 0.03 then 2 else 0 end as split, count(*) as n from q group by all""")
def flow_splits(spark, folder):
    tests = {"sevens": F.col("doc").endswith("7"), "eights": F.col("doc").endswith("8")}
    return cs.assign_splits(raw(spark, folder).select("doc", "a"), "doc", "a", tests, ["P105"], 0.03, 4).groupBy("doc", "a", "split").agg(F.count("*").alias("n"))


@query("""with m as (select distinct _doc as doc, _attr_uri as a, _answer_uri as o, _answer_start as s, _answer_end as e from raw_queries where _doc is not null)
select doc, count(distinct coalesce(a, '~')) as n_queries, (select count(*) from (select distinct coalesce(a, '~'), coalesce(o, '~') from m x where x.doc = m.doc)) as n_answers, count(*) as n_mentions from m group by doc""")
def flow_group_mentions(spark, folder):
    g = cs.group_mentions(raw(spark, folder), ["doc"], ["a"], ["o"], ["start", "end"])
    total = lambda q: F.aggregate(q["answers"], F.lit(0).cast("long"), lambda n, x: n + F.size(x["mentions"]))
    add = lambda f: F.aggregate("queries", F.lit(0).cast("long"), lambda n, q: n + f(q))
    return g.select("doc", F.size("queries").cast("long").alias("n_queries"), add(lambda q: F.size(q["answers"])).alias("n_answers"), add(total).alias("n_mentions"))


def _share(key: str, seed: int) -> str:
    return f"('0x' || substring(md5({key} || '|{seed}'), 1, 8))::bigint / 4294967296.0"


@query(f"""with t as (select text_idx, source, coalesce(_testset, 0) as split from (select text_idx, source, _testset, row_number() over (partition by text_idx order by source desc nulls last, coalesce(_testset, 0) desc) as rn from texts where text_idx is not null) where rn = 1),
 r as (select text_idx, source, split, row_number() over (partition by split, source order by {_share("text_idx || '|' || source", 3)}, text_idx) as i from t where source is not null),
 f as (select a.text_idx, b.text_idx as other from r a join r b on a.split = b.split and a.source = b.source and a.text_idx <> b.text_idx and b.i between a.i - 4 and a.i + 4),
 m as (select text_idx, arg_min(other, ({_share("text_idx || '|' || other", 3)}, other)) as other from f group by text_idx)
select t.text_idx, m.other from t left join m using (text_idx)""")
def flow_confusion(spark, folder):
    """For each text, another of its split and source."""
    t = table(spark, folder, "texts").where("text_idx is not null").groupBy("text_idx").agg(F.max(F.struct("source", F.coalesce("_testset", F.lit(0)).alias("split"))).alias("r"))
    return cs.confusion_texts(t.select("text_idx", F.array("r.source").alias("types"), F.col("r.split").alias("split")), "text_idx", "types", "split", 3)


@query("""with e as (select wikidata_id, label from (select *, row_number() over (partition by wikidata_id order by modified_at desc, ingested_at desc) as rn from entities where wikidata_id is not null) where rn = 1),
 n as (select distinct wikidata_id, x.p as p, x.o as o from (select wikidata_id, unnest(neighbors) as x from entities) where x.o is not null),
 r as (select *, row_number() over (partition by wikidata_id order by p, o) as rn from n)
select e.wikidata_id, e.label, coalesce(string_agg(r.p || '=' || r.o, ',' order by r.p, r.o), '') as evidence from e left join r on r.wikidata_id = e.wikidata_id and rn <= 2 group by all""")
def flow_enrich(spark, folder):
    e = table(spark, folder, "entities").where("wikidata_id is not null")
    now = top_per_group(e.select("wikidata_id", "label", "modified_at", "ingested_at"), ["wikidata_id"], [F.desc("modified_at"), F.desc("ingested_at")])
    near = e.select("wikidata_id", F.explode("neighbors").alias("x")).select("wikidata_id", "x.p", "x.o").distinct()
    got = cs.enrich(now.select("wikidata_id"), now.select("wikidata_id", "label"), near, "wikidata_id")
    return got.select("wikidata_id", "label", F.array_join(F.transform("evidence", lambda x: F.concat(x["p"], F.lit("="), x["o"])), ",").alias("evidence"))


_STAMP = "^[+]?([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z)(\\^\\^.*)?$"
_STAMPS = f"select distinct _subject_uri as s, regexp_extract(_answer_uri, '{_STAMP}', 1) as d from raw_queries where _subject_uri is not null and regexp_matches(_answer_uri, '{_STAMP}')"


@query(f"""with w as ({_STAMPS}), p as (select s, d, unnest([d, substring(d, 1, 17) || '00Z', substring(d, 1, 14) || '00:00Z', substring(d, 1, 11) || '00:00:00Z', substring(d, 1, 8) || '00T00:00:00Z', substring(d, 1, 5) || '00-00T00:00:00Z']) as f, unnest([1, 2, 3, 4, 5, 6]) as i from w),
 h as (select distinct s, d as f from w where d like '%T00:00:00Z')
select s, d, arg_min(f, i) as found from p join h using (s, f) group by s, d""")
def flow_match_dates(spark, folder):
    """Every stamp with the finest of its forms that is a date of its subject without a time of day."""
    q = raw(spark, folder).where("s is not null").select("s", F.regexp_extract("o", _STAMP, 1).alias("d")).where("d <> ''").distinct()
    return cs.match_dates(q, q.where(F.col("d").endswith("T00:00:00Z")), "s", "d")


@query("""select doc, start, end_pos from (select _doc as doc, _answer_start as start, _answer_end as end_pos, row_number() over (partition by _doc, _answer_start order by _answer_end desc) as rn from raw_queries where _answer_start is not null) where rn = 1""")
def flow_longest_answers(spark, folder):
    return cs.last_ends(raw(spark, folder).where("start is not null").select("doc", "start", F.col("end").alias("end_pos")), ["doc"], "start", "end_pos")


@query("""select 'event_date' as "column", min(event_date) filter (trim(event_date) <> '') as sample, 'date' as kind from incidents union all
select 'airport_code', min(airport_code) filter (trim(airport_code) <> ''), 'text' from incidents union all select 'report_number', min(report_number::varchar), 'real' from incidents""")
def flow_column_kinds(spark, folder):
    return cs.column_kinds(table(spark, folder, "incidents"), ["event_date", "airport_code", "report_number"])


@query("""select distinct piece from (select location_city as piece from incidents union all select unnest(regexp_split_to_array(location_city, ' +')) from incidents) where piece <> ''""")
def flow_name_pieces(spark, folder):
    return cs.name_pieces(table(spark, folder, "incidents"), "location_city")


def _places(name: str, rx: str, value: str) -> str:
    return f"""{name}_s as (select doc_id, regexp_extract_all(text, '{rx}') as m, regexp_split_to_array(text, '{rx}') as g from documents where text is not null),
 {name}_e as (select *, unnest(range(1, len(m) + 1)) as i from {name}_s),
 {name} as (select doc_id, m[i] as {value}, cast(list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) as int) as s, length(m[i]) as l from {name}_e)"""


def _nearest(spans: str, value: str) -> str:
    return f"(select arg_min(x.{value}, (greatest(0, x.s - v.s - v.l, v.s - x.s - x.l), x.s, x.{value})) from {spans} x where x.doc_id = v.doc_id)"


@query(f"""with {_places('v', '[0-9]+', 'value')}, {_places('n', '[A-Z][a-z]+ [A-Z][a-z]+', 'name')}, {_places('c', 'points|assists|rebounds|steals', 'col')}
select doc_id, s as start, cast(s + l as int) as "end", value, {_nearest('n', 'name')} as name, {_nearest('c', 'col')} as "column" from v""")
def flow_alignment(spark, folder):
    """Numbers of reports of games with the nearest name and statistic."""
    from loomtext.operators.spans import find_spans

    d = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    at = lambda rx, what: d.select("doc_id", F.explode(find_spans(F.col("text"), rx)).alias("x")).select("doc_id", "x.start", "x.end", F.col("x.value").alias(what))
    return cs.align_values(at("[0-9]+", "value"), at("[A-Z][a-z]+ [A-Z][a-z]+", "name"), at("points|assists|rebounds|steals", "column"), "doc_id")


@query("""select reviewer, count(*) as n, round(1.0 * count(*) filter (abusive = hateful) / count(*), 6) as accuracy from review_labels where abusive is not null and hateful is not null and reviewer is not null group by reviewer""")
def flow_token_accuracy(spark, folder):
    r = table(spark, folder, "review_labels").where("abusive is not null and hateful is not null and reviewer is not null")
    return r.groupBy("reviewer").agg(F.count("*").alias("n"), F.round(F.avg((F.col("abusive") == F.col("hateful")).cast("double")), 6).alias("accuracy"))


@query()
def flow_fuzzy(spark, folder):
    """Labels of answers against their surface forms: likeness and the place of the surface form in the label."""
    e = table(spark, folder, "entities").where("label is not null").select("label", F.explode("aliases").alias("alias")).where("alias is not null").distinct()
    return e.select("label", "alias", tx.fuzzy_ratio(F.col("label"), F.col("alias")).alias("likeness"), tx.fuzzy_position(2)(F.col("label"), F.col("alias")).alias("place"))


def _scored(pairs: str, by: str) -> str:
    """SQL of metrics.summarise over pairs (by, value, forms) of one predicted value and the sets that it may be in."""
    return f"""counted as (select {by}, cast(coalesce(list_contains(forms, value), false) as int) as tp, cast(coalesce(value, '') <> '' as int) as has, n_sets from ({pairs})),
 own as (select {by}, tp, has - tp as fp, n_sets - tp as fn, tp / (has + 1e-8) as p, tp / (n_sets + 1e-8) as r from counted where has + n_sets > 0),
 f as (select *, 2 * p * r / (p + r + 1e-8) as own from own),
 g as (select {by}, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tp) / (sum(tp) + sum(fp) + 1e-8) as precision, sum(tp) / (sum(tp) + sum(fn) + 1e-8) as recall, avg(own) as mean_f1, quantile_cont(own, 0.25) as q1_f1, quantile_cont(own, 0.5) as median_f1, quantile_cont(own, 0.75) as q3_f1, min(own) as min_f1, max(own) as max_f1 from f group by {by})
 select {by}, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, round(precision, 6) as precision, round(recall, 6) as recall, round(2 * precision * recall / (precision + recall + 1e-8), 6) as f1, round(mean_f1, 6) as mean_f1, round(q1_f1, 6) as q1_f1, round(median_f1, 6) as median_f1, round(q3_f1, 6) as q3_f1, round(min_f1, 6) as min_f1, round(max_f1, 6) as max_f1 from g"""


_FORM = "replace(strip_accents(replace(lower({0}), ' ', '')), 'ß', 'ss')"


@query(f"""with {_RECORDS}, labels as (select report_number, list(distinct {_FORM.format('mention')}) as forms, count(distinct mention) as n_sets from ment where attribute = 'location_city' group by report_number),
 {_scored(f"select i.location_state, {_FORM.format('location_city')} as value, forms, n_sets from (select distinct * from incidents) i join labels using (report_number)", 'location_state')}""")
def flow_value_counts(spark, folder):
    """Cities of incidents against the cities their reports name, as found values and misses, per state."""
    from loomtext.queries.corpus import reports

    labels = reports(spark, folder).mentions().where("attribute = 'location_city'").groupBy("report_number").agg(F.array_distinct(F.collect_list(F.array("mention"))).alias("sets"))
    both = table(spark, folder, "incidents").distinct().join(labels, "report_number").select("location_state", "report_number", metrics.value_counts(F.array("location_city"), F.col("sets")).alias("c"))
    return metrics.rounded(metrics.summarise(both.select("location_state", "report_number", "c.*"), ["location_state"]))
