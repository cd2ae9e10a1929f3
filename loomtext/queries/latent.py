"""Queries of windowed views, special joins, evaluation, alignment and sample synthesis, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.operators import alignment, evaluation, joins, spans, synthesis, tabletext, wikidata
from loomtext.operators import corpussteps as cs
from loomtext.operators.extractors import PatternExtractor
from loomtext.operators.ranking import top_per_group
from loomtext.plans.catalog import evidence_columns
from loomtext.plans.nodes import Project, Select, TextAggregate, TextJoin, TextScan, TextSelect, TextUnion
from loomtext.queries.tables import table
from loomtext.queries.texttables import _FLIGHT, _MENTION, PATTERNS, flat, texts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_SPACED = r"with documents as (select doc_id, regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g') as text from main.documents) "


@query(_SPACED + _FLIGHT)
def text_scan_windows(spark, folder):
    """A latent table read window by window."""
    c = texts(spark, folder)
    c.texts["documents"].view("long", ["airport", "runway", "wind"], PatternExtractor(PATTERNS), window=(64, 16))
    return flat(TextScan("documents.long").run(c))


@query(_SPACED + _MENTION)
def text_scan_window_rows(spark, folder):
    """Rows of a document put together from its windows."""
    c = texts(spark, folder)
    c.texts["documents"].view("rows", ["kind", "value"], PatternExtractor(kinds=PATTERNS), identifying="kind", window=(64, 16))
    return flat(TextScan("documents.rows").run(c))


@query("""with v as (select doc_id, coalesce(regexp_extract_all(text, 'Z[A-Z]{3}'), []) as l from documents)
select doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ', ') as airport, len(list_distinct(l)) > 0 as one from v""")
def text_scan_forced(spark, folder):
    """An attribute forced to one value, in the only table of its collection."""
    c = texts(spark, folder)
    c.texts["documents"].view("one", ["airport"], PatternExtractor(PATTERNS), single=("airport",), one_table=True)
    assert list(c.texts["documents"].views) == ["one"]
    got = TextScan("documents.one").run(c)
    return got.select("doc_id", F.array_join(F.transform("airport", lambda v: v["normed"]), "#").alias("airport"), (F.size("airport") == 1).alias("one"))


@query(f"select f.* from ({_FLIGHT}) f where list_has_any(string_split(wind, '|'), ['10', '12'])")
def text_select_synonyms(spark, folder):
    """Documents with a value or another known to mean the same, by the index."""
    same = spark.createDataFrame([("10", "ten"), ("12", "ten")], "value string, rep string")
    return flat(TextScan(TextSelect("documents.flight", "wind", constant="ten", indexed=True, synonyms=same)).run(texts(spark, folder)))


@query("select * from (values ('reviews', 'abusive'), ('reviews', 'reviewer'), ('asked', 'kind'), ('known', 'airport'), ('known', 'wind'), ('named', 'source'), ('named', 'lang')) t(tab, col)")
def plan_evidence(spark, folder):
    """What of each table is evidence."""
    c = texts(spark, folder)
    named = c.table("named", table(spark, folder, "documents").select("source", "doc_id", "lang", "text"), ["source", "doc_id"])
    rows = [(n, e) for n in ("reviews", "asked", "known") for e in evidence_columns(c.get(n).df, c.get(n).keys)] + [("named", e) for e in evidence_columns(named.df, named.keys, "text")]
    return spark.createDataFrame(rows, "tab string, col string")


@query("""select * from (values ('(reviews ⨝ documents.flight)', '$(reviews \\bowtie documents.flight)$'), ('(known ∪ σ wind (documents.flight))', '$(known \\cup \\sigma wind (documents.flight))$'),
 ('π abusive (σ 0.5 (reviews))', '$\\pi abusive (\\sigma 0.5 (reviews))$'), ('G runway (scan(documents.flight))', '$G runway (scan(documents.flight))$')) t(name, latex)""")
def plan_names(spark, folder):
    """Names of plans, and as formulas."""
    plans = [TextJoin("reviews", "documents.flight", "doc_id"), TextUnion("known", TextSelect("documents.flight", "wind")), Project(Select("reviews", 0.5), ("abusive",)), TextAggregate(TextScan("documents.flight"), "runway")]
    return spark.createDataFrame([(p.name(), p.latex()) for p in plans], "name string, latex string")


@query("select p_partkey, p_name as again, 2 * (len(string_split(p_name, ' ')) - 1) as last_word from part")
def span_words(spark, folder):
    """Names cut in two pieces a word and put together again, and where the last piece's word begins."""
    pieces = F.flatten(F.transform(F.split("p_name", " "), lambda w: F.array(F.substring(w, 1, 2), F.concat(F.lit("##"), F.substring(w, F.lit(3), F.length(w))))))
    p = table(spark, folder, "part").select("p_partkey", pieces.alias("t"))
    return p.select("p_partkey", F.array_join(F.transform(spans.merge_pieces(F.col("t")), lambda x: x["word"]), " ").alias("again"), spans.word_start(F.col("t"), F.size("t") - 1).cast("long").alias("last_word"))


@query("select wikidata_id, modified_at from entities where len(list_filter(aliases, lambda x: x is not null)) > 0 and not coalesce(regexp_matches(label, '^[A-M]'), false) and wikidata_id in (select _subject_uri from raw_queries)")
def filter_tagged(spark, folder):
    """Entities that have other names, whose label isn't of the first half of the alphabet, and of which there are facts."""
    e = joins.without_matching(joins.only_tagged(table(spark, folder, "entities"), "aliases"), "label", "^[A-M]")
    return joins.restricted(e, "wikidata_id", table(spark, folder, "raw_queries").select(F.col("_subject_uri").alias("wikidata_id")), ["modified_at", "gone"])


@query("""select c_custkey, count(o_orderkey) as n, max(o_totalprice) as top from customer left join orders on o_custkey = c_custkey and o_totalprice > 20 * c_acctbal group by c_custkey""")
def join_correlated_totals(spark, folder):
    """Per customer the orders above what their account allows."""
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    got = joins.nest_correlated(c, o, "c_custkey", "o_custkey", F.col("r_o_totalprice") > 20 * F.col("c_acctbal"), ["o_orderkey"], "rows", {"n": F.count("r_o_orderkey"), "top": F.max("r_o_totalprice")})
    return got.select("c_custkey", "n", "top")


@query("""select c_custkey, coalesce(string_agg(o_orderkey || '', ',' order by o_orderkey), '') as keys from customer left join orders on o_custkey = c_custkey and o_totalprice > 20 * c_acctbal group by c_custkey""")
def join_correlated_nest(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    got = joins.nest_correlated(c, o, "c_custkey", "o_custkey", F.col("r_o_totalprice") > 20 * F.col("c_acctbal"), ["o_orderkey"], "rows")
    return got.select("c_custkey", F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("keys"))


_COVERS = "select distinct text_idx, c.s as s, c.p as p, c.o as o, c.start_pos as a, c.end_pos as b from (select distinct text_idx, unnest(covers) as c from texts)"


def _covers(spark, folder):
    return table(spark, folder, "texts").select("text_idx", F.explode("covers").alias("c")).select("text_idx", "c.s", "c.p", "c.o", F.col("c.start_pos").alias("a"), F.col("c.end_pos").alias("b")).distinct()


@query(f"with c as ({_COVERS}), q as (select _doc as text_idx, _answer_start as place from raw_queries where _answer_start is not null) select text_idx, place, count(*) as n from q join c using (text_idx) where place >= a and place < b group by all")
def join_contained(spark, folder):
    """Places of answers in the covered parts of their texts."""
    q = table(spark, folder, "raw_queries").where("_answer_start is not null").select(F.col("_doc").alias("text_idx"), F.col("_answer_start").alias("place"))
    return joins.contained(q, _covers(spark, folder), "text_idx", "place", "a", "b", 32).groupBy("text_idx", "place").agg(F.count("*").alias("n"))


@query("""with p as (select event_id, user_id, epoch(ts) as t from events where event_type = 'purchase'), v as (select user_id, epoch(ts) as t, event_id as other from events where event_type <> 'purchase')
select p.event_id, arg_min(v.other, (abs(p.t - v.t), v.t, v.other)) filter (abs(p.t - v.t) <= 86400) as other, min(abs(p.t - v.t)) filter (abs(p.t - v.t) <= 86400) as distance from p left join v using (user_id) group by p.event_id""")
def join_nearest_within(spark, folder):
    """For each purchase the nearest other event of its user, at most a day away."""
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    got = joins.nearest(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'").select("user_id", "t", F.col("event_id").alias("other")), "user_id", "t", ["other"], 86400.0)
    return got.select("event_id", "other", "distance")


@query("""with x as (select least(l_suppkey, l_partkey) as a, greatest(l_suppkey, l_partkey) as b, l_returnflag = 'R' as same from lineitem where l_returnflag <> 'N')
select a, b, bool_and(same) as same from x group by a, b having bool_and(same) = bool_or(same)""")
def set_without_conflicts(spark, folder):
    li = table(spark, folder, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), (F.col("l_returnflag") == "R").alias("same"))
    return joins.without_conflicts(li, "a", "b", "same")


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 50 offset 100")
def win_page(spark, folder):
    """The third page of fifty of the dearest parts."""
    return joins.page(table(spark, folder, "part").select("p_partkey", "p_retailprice"), [F.col("p_retailprice").desc(), F.col("p_partkey")], 100, 50)


@query("""with v as (select c_mktsegment as name, c_nationkey % 3 as source, [min(c_custkey), max(c_custkey), count(*)] as vals from customer where c_mktsegment <> 'BUILDING' or c_nationkey % 3 > 0 group by 1, 2)
select name, count(*) = 3 as agrees, case when count(*) = 3 then round(avg(vals[1]), 6) end as a, case when count(*) = 3 then round(avg(vals[2]), 6) end as b, case when count(*) = 3 then round(avg(vals[3]), 6) end as c from v group by name""")
def agg_averaged_arrays(spark, folder):
    """Arrays of three sources averaged; one source lacks a name."""
    c = table(spark, folder, "customer").where("c_mktsegment <> 'BUILDING' or c_nationkey % 3 > 0")
    v = c.groupBy(F.col("c_mktsegment").alias("name"), (F.col("c_nationkey") % 3).alias("source")).agg(F.array(F.min("c_custkey"), F.max("c_custkey"), F.count("*")).alias("vals"))
    got = joins.averaged(v, "name", "vals", "source")
    return got.select("name", "agrees", *[F.round(F.get("vals", F.lit(i)), 6).alias(n) for i, n in enumerate("abc")])


@query("""with p as (select l_suppkey % 10 as q, l_returnflag as v, count(*) as runs, min(l_quantity) as least, max(l_quantity) as most, avg(l_quantity) as mean, max(l_extendedprice) as quality from lineitem group by 1, 2)
select q, v, runs, least, most, round(mean, 6) as mean, quality, max(quality) over (partition by q) as best, round(mean / min(mean) over (partition by q), 6) as slowdown, quality = max(quality) over (partition by q) as is_best from p""")
def agg_compared_runs(spark, folder):
    """Return flags as variants of groups of suppliers: spread, best and slowdown."""
    li = table(spark, folder, "lineitem").select((F.col("l_suppkey") % 10).alias("q"), F.col("l_returnflag").alias("v"), "l_quantity", "l_extendedprice")
    got = evaluation.compared_runs(li, ["q"], "v", "l_quantity", "l_extendedprice")
    return got.withColumn("mean", F.round("mean", 6)).withColumn("slowdown", F.round("slowdown", 6))


@query("""with b as (select *, case when max(p_retailprice) over w = min(p_retailprice) over w then 0 else least(floor((p_retailprice - min(p_retailprice) over w) / (max(p_retailprice) over w - min(p_retailprice) over w) * 4), 3) end as bucket from part window w as (partition by p_brand))
select p_brand, cast(bucket as int) as bucket, count(*) as n, min(p_retailprice) as low, max(p_retailprice) as high, (min(p_retailprice) + max(p_retailprice)) / 2 as centre from b group by p_brand, bucket""")
def agg_bucket_ranges(spark, folder):
    p = table(spark, folder, "part").select("p_brand", "p_retailprice")
    return evaluation.bucket_ranges(evaluation.bucketed(p, ["p_brand"], "p_retailprice", 4), ["p_brand"], "p_retailprice")


@query("""select 'p_brand' as level, v as value, count(*) as n from (select p_brand, cast(sum(p_size) as varchar) as v from part group by 1) group by v union all
select 'p_brand,p_type', v, count(*) from (select p_brand, p_type, cast(sum(p_size) as varchar) as v from part group by 1, 2) group by v""")
def agg_level_sums(spark, folder):
    return evaluation.level_statistics(table(spark, folder, "part"), "p_size", [["p_brand"], ["p_brand", "p_type"]])


@query("""select 'x' as r, lower(replace(n_name, ' ', '')) as name, case when n_regionkey > 0 then least(n_name, 'zz') || '|zz' end as label, n_nationkey as n, case when n_regionkey > 0 then n_regionkey end as label_m from nation
 union all select 'x', null, 'nobody', null, 99""")
def eval_groups(spark, folder):
    """Groups by name matched with sets of names."""
    n = table(spark, folder, "nation")
    predicted = n.select(F.lit("x").alias("r"), F.lower(F.replace("n_name", F.lit(" "))).alias("name"), F.col("n_nationkey").alias("n"))
    labelled = n.where("n_regionkey > 0").select(F.lit("x").alias("r"), F.array("n_name", F.lit("zz")).alias("names"), F.col("n_regionkey").alias("m"))
    labelled = labelled.unionByName(n.limit(1).select(F.lit("x").alias("r"), F.array(F.lit("nobody")).alias("names"), F.lit(99).alias("m")))
    return evaluation.matched_groups(predicted, labelled, ["r"], "name", "names").select("r", "name", "label", "n", "label_m")


@query("""with c as (select doc_id, sum(coalesce(abusive, 0)) as tp, sum(coalesce(hateful, 0)) as fp, sum(coalesce(sexual, 0)) as fn from review_labels group by doc_id)
select doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) as words, length(coalesce(text, '')) as characters, cast(coalesce(tp, 0) as bigint) as tp, cast(coalesce(fp, 0) as bigint) as fp, cast(coalesce(fn, 0) as bigint) as fn,
 round(coalesce(tp, 0) / (coalesce(tp, 0) + coalesce(fp, 0) + 1e-8), 6) as precision from documents left join c using (doc_id)""")
def eval_documents(spark, folder):
    """Counts and sizes per document."""
    counts = table(spark, folder, "review_labels").select("doc_id", F.coalesce("abusive", F.lit(0)).alias("tp"), F.coalesce("hateful", F.lit(0)).alias("fp"), F.coalesce("sexual", F.lit(0)).alias("fn"))
    got = evaluation.document_statistics(counts, table(spark, folder, "documents"), "doc_id", "text")
    return got.select("doc_id", F.col("words").cast("long").alias("words"), F.col("characters").cast("long").alias("characters"), "tp", "fp", "fn", F.round("precision", 6).alias("precision"))


@query("""select p_partkey, cast(p_size % 3 > 0 as int) as rows_tp, cast(p_size % 3 = 0 as int) as rows_fp, 1 as columns_tp, 1 as columns_fp, 1 as columns_fn, cast(p_size % 3 > 0 as int) as cells_tp, 1 + cast(p_size % 3 = 0 as int) as cells_fp, 1 + cast(p_size % 3 = 0 as int) as cells_fn from part""")
def eval_tables(spark, folder):
    """Two tables of each part: their row headers, column headers and cells."""
    p = table(spark, folder, "part")
    size, none = F.col("p_size").cast("string"), F.lit("")
    name = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    a = F.array(F.array(none, F.lit("size"), F.lit("brand")), F.array(name, size, F.col("p_brand")))
    b = F.array(F.array(none, F.lit("size"), F.lit("type")), F.array(F.col("p_name"), size, F.col("p_type")))
    s = p.select("p_partkey", evaluation.table_scores(a, b).alias("s"))
    return s.select("p_partkey", F.col("s.rows.tp").alias("rows_tp"), F.col("s.rows.fp").alias("rows_fp"), *[F.col(f"s.{k}.{x}").alias(f"{k}_{x}") for k in ("columns", "cells") for x in ("tp", "fp", "fn")])


@query("select p_partkey, case when p_size % 2 = 0 then 2 else 1 end as a_tp, p_size % 2 as a_fp, p_size % 2 as a_fn, case when p_size % 2 = 0 then 3 else 2 end as t_tp, p_size % 2 as t_fp, 0 as t_fn from part")
def eval_spans(spark, folder):
    """Answers and tokens of two labellings."""
    mine = F.array(*[F.lit(x) for x in (2, 1, 0, 2)])
    other = F.array(F.lit(2), F.when(F.col("p_size") % 2 == 0, 1).otherwise(0), F.lit(0), F.lit(2))
    return table(spark, folder, "part").select("p_partkey", evaluation.span_counts(mine, other).alias("c")).select("p_partkey", "c.*")


@query("select reviewer, count(*) as n, round(avg((abusive = hateful)::int), 6) as accuracy from review_labels where abusive is not null and hateful is not null group by reviewer")
def eval_accuracy(spark, folder):
    return evaluation.accuracy(table(spark, folder, "review_labels"), ["reviewer"], F.col("abusive"), F.col("hateful")).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""with c as ({_COVERS}), m as (select distinct text_idx, o as uri, a, b from c where o is not null union select text_idx, s, min(a), min(b) from c where s is not null group by text_idx, s), q as (select distinct text_idx, s, p, o from c where s is not null and o is not null),
 t as (select text_idx, max(text) as text from texts group by text_idx),
 x as (select q.*, v.a, v.b, n.a as place, row_number() over (partition by q.text_idx, q.s, q.p, q.o, v.a, v.b order by abs(v.a - n.a), n.a) as rn from q join m v on v.text_idx = q.text_idx and v.uri = q.o join m n on n.text_idx = q.text_idx and n.uri = q.s and abs(v.a - n.a) <= 2000)
select text_idx, s, p, o, a, b, place, w from (select x.*, len(list_filter(string_split_regex(substring(text, least(a, place) + 1, abs(a - place)), '[ \\t\\n\\r\\f\\x0B]+'), lambda y: y <> '')) as w from x join t using (text_idx) where rn = 1) where w <= 30""")
def flow_qualifiers(spark, folder):
    """Facts of texts whose value stands within thirty words of their subject, which is taken to stand where its first fact does."""
    c = _covers(spark, folder)
    mentions = c.where("o is not null").select("text_idx", F.col("o").alias("uri"), F.col("a").alias("start"), F.col("b").alias("end"))
    first = c.where("s is not null").groupBy("text_idx", F.col("s").alias("uri")).agg(F.min("a").alias("start"), F.min("b").alias("end"))
    mentions = mentions.unionByName(first).distinct()
    q = c.select("text_idx", F.col("s").alias("subject"), F.col("p").alias("property"), F.col("o").alias("value"))
    t = table(spark, folder, "texts").groupBy("text_idx").agg(F.max("text").alias("text"))
    got = alignment.align_qualifiers(q, mentions, t, "text_idx")
    place = F.when(F.col("after"), F.col("start") - F.col("characters")).otherwise(F.col("start") + F.col("characters"))
    return got.select("text_idx", F.col("subject").alias("s"), F.col("property").alias("p"), F.col("value").alias("o"), F.col("start").alias("a"), F.col("end").alias("b"), place.cast("int").alias("place"), F.col("words").cast("long").alias("w"))


_SAID = {"points": "PTS", "rebounds": "REB", "assists": "AST", "knots": "WIND", "years old": "AGE"}


@query(r"""with d as (select doc_id, text, regexp_extract_all(text, '\b[0-9]+ (?:years old|assists|knots|points|rebounds)\b') as m, regexp_split_to_array(text, '\b[0-9]+ (?:years old|assists|knots|points|rebounds)\b') as g from documents where text is not null),
 e as (select *, unnest(range(1, len(m) + 1)) as i from d), p as (select doc_id, text, m[i] as x, cast(list_sum([length(y) for y in g[1:i]]) + coalesce(list_sum([length(y) for y in m[1:i - 1]]), 0) as int) as start from e)
select doc_id, list_extract(regexp_extract_all(substring(text, 1, start), '[A-Z][a-z]+ [A-Z][a-z]+'), -1) as entity, case split_part(x, ' ', 2) when 'points' then 'PTS' when 'rebounds' then 'REB' when 'assists' then 'AST' when 'knots' then 'WIND' else 'AGE' end as relation, cast(split_part(x, ' ', 1) as bigint) as value, start from p""")
def flow_relations(spark, folder):
    """Numbers with what they count and of whom they are said."""
    return alignment.extracted_relations(table(spark, folder, "documents").where("text is not null"), "doc_id", "text", _SAID)


@query()
def flow_tournament(spark, folder):
    """Of the names in a document that which beats the others for each of its numbers of points."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    places = lambda rx: F.transform(spans.find_spans(F.col("text"), rx), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    n = d.select("doc_id", "text", F.explode(places(r"[0-9]+(?= points)")).alias("v"), places("[A-Z][a-z]+ [A-Z][a-z]+").alias("names"), places("points|rebounds").alias("columns"))
    each = n.select("doc_id", "text", F.struct("v.start", "v.end").alias("v"), F.explode(F.array_distinct(F.transform("names", lambda x: x["value"]))).alias("name"), "names", F.transform("columns", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("columns"))
    mine = each.withColumn("mine", F.transform(F.filter("names", lambda x: x["value"] == F.col("name")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    f = alignment.distance_features(mine, "text", "v", {"name": "mine", "column": "columns"})
    return alignment.tournament(f.select("doc_id", F.col("v.start").alias("start"), "name", "features"), ["doc_id", "start"], "name", "features")


_NAMES = "select distinct _doc as text_idx, _subject_label as name from raw_queries where _doc is not null and _subject_label <> ''"


@query(f"""with t as (select text_idx, max(text) as text from texts where text_idx is not null group by text_idx having max(text) is not null), g as (select distinct _doc as text_idx, _answer_start as s, _answer_end as e from raw_queries where _doc like '%7' and _answer_start is not null),
 n as ({_NAMES}), x as (select text_idx, text, name, strpos(text, name) as p from n join t using (text_idx) where text_idx not in (select text_idx from g)),
 y as (select text_idx, text, name, p, row_number() over (partition by text_idx order by p, length(name) desc) as rn from x where p > 0 and not (p > 1 and regexp_matches(substring(text, p - 1, 1), '^[\\p{{L}}\\p{{N}}]$')) and not regexp_matches(substring(text, p + length(name), 1), '^[\\p{{L}}\\p{{N}}]$'))
select text_idx, p - 1 as start, p - 1 + length(name) as "end", name as surface, true as found from y where rn = 1 union all
select text_idx, s, e, substring(text, s + 1, e - s), false from g join t using (text_idx)""")
def flow_tagged_names(spark, folder):
    """Tags of some documents' answers, and in the others the first place of one of their subjects' names."""
    t = table(spark, folder, "texts").where("text_idx is not null").groupBy("text_idx").agg(F.max("text").alias("text"))
    q = table(spark, folder, "raw_queries").where("_doc is not null").withColumn("text_idx", F.col("_doc"))
    tags = q.where(F.col("_doc").endswith("7")).select("text_idx", F.col("_answer_start").alias("start"), F.col("_answer_end").alias("end"))
    got = synthesis.tagged_names(t, q.select("text_idx", F.col("_subject_label").alias("name")), tags, "text_idx", "text")
    return got.select("text_idx", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "surface", "found")


def _answers(spark, folder):
    q = table(spark, folder, "raw_queries")
    return q.select(F.coalesce("_annotator", F.lit("none")).alias("table"), F.col("_doc").alias("doc"), F.col("_subject_uri").alias("row"), F.col("_attr_uri").alias("column"), F.col("_answer_start").alias("start"), F.col("_answer_end").alias("end"))


_ANSWERS = """a as (select distinct coalesce(_annotator, 'none') as t, _doc as d, _subject_uri as r, _attr_uri as c, _answer_start as s, _answer_end as e from raw_queries where _doc is not null and _subject_uri is not null and _attr_uri is not null),
 cells as (select distinct t, d, r, c from a), wide as (select t, count(distinct c) as w from a group by t), have as (select t, d, r, count(*) as h from cells group by t, d, r)"""


@query(f"""with {_ANSWERS} select t as tab, 'regular' as kind, count(*) as n, cast(sum(k) as bigint) as places from (select t, d, r, c, count(distinct concat_ws('-', s, e)) as k from a group by t, d, r, c) group by t
 union all select t, 'empty', count(*), 0 from have join wide using (t), unnest(range(cast(least(2, w - h) as bigint))) u(i) group by t
 union all select t, 'header', count(*), cast(sum(k) as bigint) from (select t, d, count(distinct c) as k from a group by t, d) group by t""")
def synth_training(spark, folder):
    """Samples per table and kind, and the answers they hold."""
    s = synthesis.training_samples(_answers(spark, folder), empty=2, seed=3)
    return s.groupBy(F.col("table").alias("tab"), "kind").agg(F.count("*").alias("n"), F.sum(F.size("answers")).alias("places"))


@query(f"""with {_ANSWERS} select 'join' as op, t as tab, c as grp, 1 as asked, w - 1 as given, count(*) as n from cells join wide using (t) group by t, c, w
 union all select 'union', t, d, count(distinct c), w, count(*) from cells join wide using (t) group by t, d, w
 union all select 'multi-union', t, d, count(distinct c) + 1, w, count(*) + count(distinct r) from cells join wide using (t) group by t, d, w having count(distinct r) >= 2""")
def synth_test(spark, folder):
    """Samples that imitate joins and unions."""
    out = None
    for op in ("join", "union", "multi-union"):
        one = synthesis.test_samples(_answers(spark, folder), op).select(F.lit(op).alias("op"), F.col("table").alias("tab"), F.col("group").alias("grp"), F.size("asked").cast("long").alias("asked"), F.size("given").cast("long").alias("given"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _spread(name: str, by: str, count: str, source: str = "cells") -> str:
    return f"select '{name}' as statistic, cast(v as varchar) as value, count(*) as n from (select {count} as v from {source} group by {by}) group by v"


@query(f"""with {_ANSWERS}, x as (select _doc as doc, max(len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> ''))) as k from (select text_idx as _doc, text from texts where text_idx is not null) group by 1),
 reg as (select t, d, r, c, count(distinct concat_ws('-', s, e)) as k from a group by t, d, r, c), heads as (select t, d, count(distinct c) as k from a group by t, d), emp as (select t from have join wide using (t), unnest(range(cast(least(1, w - h) as bigint))) u(i))
 {_spread('rows of tables', 't', 'count(distinct r)')} union all {_spread('columns of tables', 't', 'count(distinct c)')} union all {_spread('documents of tables', 't', 'count(distinct d)')} union all {_spread('rows of documents', 't, d', 'count(distinct r)')}
 union all {_spread('cells of rows', 'd, r', 'count(*)')} union all {_spread('tables of documents', 'd', 'count(distinct t)')}
 union all select 'windows of texts', cast(cast(greatest(1, 1 + ceil((k - 64) / 48.0)) as bigint) as varchar), count(*) from x group by 2
 union all select 'answers of samples', 'regular:' || k, count(*) from reg group by k union all select 'answers of samples', 'empty:0', count(*) from emp having count(*) > 0
 union all select 'lengths of answers', cast(e - s as varchar), count(*) from (select * from (select coalesce(_annotator, 'none') as t, _answer_start as s, _answer_end as e from raw_queries) where s is not null) group by e - s
 union all select 'columns asked', c, count(*) from reg group by c
 union all select 'kinds', 'regular', count(*) from reg union all select 'kinds', 'header', count(*) from heads union all select 'kinds', 'empty', count(*) from emp having count(*) > 0
 union all select 'columns of headers', cast(k as varchar), count(*) from heads group by k""")
def synth_statistics(spark, folder):
    """How many things of samples, tables and texts have which number."""
    a = _answers(spark, folder)
    t = table(spark, folder, "texts").where("text_idx is not null").select(F.col("text_idx").alias("doc"), "text")
    return synthesis.sample_statistics(synthesis.training_samples(a, empty=1), t, a)


@query("""with x as (select 'city' as kind, report_number as doc, location_city as name from incidents union all select 'airport', report_number, airport_name from incidents),
 y as (select distinct * from x where name is not null and doc is not null)
select doc, kind, name, substring(md5(kind || '|' || name), 1, 16) as id, cast(row_number() over (partition by doc, kind order by name) - 1 as int) as number from y""")
def synth_linked(spark, folder):
    """Tables of cities and airports, and which report has which."""
    i = table(spark, folder, "incidents").withColumnRenamed("report_number", "doc")
    tables, links = synthesis.linked_tables({"city": i.select("doc", F.col("location_city").alias("name")), "airport": i.select("doc", F.col("airport_name").alias("name"))}, "doc", "name")
    named = None
    for kind, t in tables.items():
        one = t.select(F.lit(kind).alias("kind"), "id", "name")
        named = one if named is None else named.unionByName(one)
    return links.join(named, ["kind", "id"]).select("doc", "kind", "name", "id", "number")


@query("""with r as (select report_number, nullif(max(location_city), '') as city, nullif(max(aircraft_damage), '') as damage from incidents where report_number % 3 > 0 group by 1), a as (select report_number, 'city' as c, location_city as v from incidents union all select report_number, 'state', location_state from incidents),
 w as (select report_number, c, array_to_string(list_sort(list_distinct(list(v))), ', ') as v from a where v is not null group by 1, 2)
select report_number, coalesce(r.city, c.v, '') as city, coalesce(r.damage, '') as damage, coalesce(s.v, '') as state from r full join (select distinct report_number from w) k using (report_number) left join w c on c.report_number = coalesce(r.report_number, k.report_number) and c.c = 'city' left join w s on s.report_number = coalesce(r.report_number, k.report_number) and s.c = 'state'""")
def synth_assembled(spark, folder):
    """Rows of reports filled up with values found elsewhere."""
    i = table(spark, folder, "incidents")
    none = lambda c: F.nullif(F.max(c), F.lit(""))
    rows = i.where("report_number % 3 > 0").groupBy("report_number").agg(none("location_city").alias("city"), none("aircraft_damage").alias("damage"), F.lit(None).cast("string").alias("state"))
    answers = i.select("report_number", F.explode(F.array(F.struct(F.lit("city").alias("column"), F.col("location_city").alias("value")), F.struct(F.lit("state").alias("column"), F.col("location_state").alias("value")))).alias("x")).select("report_number", "x.*")
    return synthesis.assembled(rows, answers, "report_number", ["city", "damage", "state"])


@query(r"""select _answer_uri as v, count(*) as n, _answer_uri is null or lower(_answer_uri) = 'n/a' or not regexp_matches(_answer_uri, '[0-9A-Za-z\x{80}-\x{10FFFF}]') as nothing from raw_queries group by _answer_uri""")
def fn_says_nothing(spark, folder):
    return table(spark, folder, "raw_queries").groupBy(F.col("_answer_uri").alias("v")).agg(F.count("*").alias("n")).withColumn("nothing", tx.says_nothing(F.col("v")))


@query("select doc_id, case lower(trim(source)) when 'game_reports' then contains(lower(coalesce(text, '')), 'points') or contains(lower(coalesce(text, '')), 'rebounds') when 'aviation_reports' then contains(lower(coalesce(text, '')), 'runway') else true end as ok from documents where source is not null")
def fn_rule_filter(spark, folder):
    rules = {"game_reports": ["points", "rebounds"], "aviation_reports": ["runway"]}
    d = table(spark, folder, "documents").where("source is not null")
    return d.select("doc_id", tx.rule_filter(F.lower(F.trim("source")), F.coalesce("text", F.lit("")), rules).alias("ok"))


@query("""select d.doc_id, 'wind' as v, contains(lower(text), 'knots') as long_in, list_contains(string_split_regex(lower(text), '[^0-9a-z]+'), 'of') as short_in from documents d where text is not null""")
def fn_value_in_text(spark, folder):
    """Long values are looked for anywhere, short ones as words."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", F.lit("wind").alias("v"), tx.value_in_text(F.lit("k"), F.lit("Knots"), F.col("text")).alias("long_in"), tx.value_in_text(F.lit("k"), F.lit("Of"), F.col("text")).alias("short_in"))


@query("""with now as (select wikidata_id, label, description, types from (select *, row_number() over (partition by wikidata_id order by modified_at desc, ingested_at desc, label, description) as rn from entities where wikidata_id is not null) where rn = 1),
 n as (select distinct wikidata_id, x.p as p, x.o as o from (select wikidata_id, unnest(neighbors) as x from entities where wikidata_id is not null) where x.o is not null),
 r as (select *, row_number() over (partition by wikidata_id order by p, o) as rn from n), t as (select r.*, label, description, types from r left join now on now.wikidata_id = r.o where rn <= 2)
select wikidata_id, string_agg(p || '=' || concat_ws(', ', coalesce(label, o), description), ';' order by p, o) as evidence, (select coalesce(string_agg(distinct y, ',' order by y), '') from (select unnest(types) as y, wikidata_id as w from t) z where z.w = t.wikidata_id) as types from t group by wikidata_id""")
def flow_named_neighbors(spark, folder):
    """Entities with what their first neighbours are called and described as, and these neighbours' types."""
    e = table(spark, folder, "entities").where("wikidata_id is not null")
    now = top_per_group(e, ["wikidata_id"], [F.desc("modified_at"), F.desc("ingested_at"), F.col("label"), F.col("description")]).select(F.col("wikidata_id").alias("id"), "label", "description", "types")
    near = e.select("wikidata_id", F.explode("neighbors").alias("x")).select("wikidata_id", "x.p", "x.o")
    got = cs.named_neighbors(near, now, "wikidata_id")
    return got.select("wikidata_id", F.array_join(F.transform("evidence", lambda x: F.concat(x["p"], F.lit("="), x["text"])), ";").alias("evidence"), F.array_join(F.array_compact("types"), ",").alias("types"))


_SPLIT = "case when _doc like '%7' then 3 when _doc like '%8' then 4 when _attr_uri like '%5' then 1 else 0 end"


@query(f"""with t as (select text_idx as doc, max(text) as text from texts where text_idx is not null group by 1), f as (select *, {_SPLIT} as split from raw_queries),
 c as (select _doc as doc, count(*) as n from (select distinct _doc, _answer_start, _answer_end, _subject_uri, _attr_uri, _answer_uri from f where _answer_start is not null and _answer_end is not null) group by 1), m as (select _doc as doc, max(split) as s from f group by 1)
select t.doc, length(text) as n_chars, coalesce(n, 0) as n_covers, coalesce(s, 0) as testset, coalesce(s, 0) in (3, 4) as is_test from t left join c using (doc) left join m using (doc)""")
def flow_prepared_texts(spark, folder):
    """Texts with the facts that cover them and the split they go to."""
    t = table(spark, folder, "texts").where("text_idx is not null").groupBy(F.col("text_idx").alias("doc")).agg(F.max("text").alias("text"))
    f = table(spark, folder, "raw_queries").select(F.col("_doc").alias("doc"), F.col("_subject_uri").alias("s"), F.col("_attr_uri").alias("p"), F.col("_answer_uri").alias("o"), F.col("_answer_start").alias("start"), F.col("_answer_end").alias("end"), F.expr(_SPLIT).alias("split"))
    got = cs.prepared_texts(t, f, [3, 4])
    return got.select("doc", F.length("text").cast("long").alias("n_chars"), F.size("covers").cast("long").alias("n_covers"), "testset", "is_test")


@query("""with a as (select distinct _subject_uri as s, _attr_uri as a from raw_queries), h as (select distinct _subject_uri as s, _attr_uri as a, _doc as doc from raw_queries where _answer_start is not null)
select a.s, a.a, d.doc, h.s is not null as relevant from a, (values ('T000000007'), ('T000000042')) d(doc) left join h on h.s = a.s and h.a = a.a and h.doc = d.doc where a.s is not null and a.a is not null""")
def flow_relevant_texts(spark, folder):
    """Which of two texts answers each question."""
    q = table(spark, folder, "raw_queries").select(F.col("_subject_uri").alias("s"), F.col("_attr_uri").alias("a"), F.col("_doc").alias("doc"), F.col("_answer_start").alias("start"))
    asked = q.where("s is not null and a is not null").select("s", "a").distinct().withColumn("doc", F.explode(F.array(F.lit("T000000007"), F.lit("T000000042"))))
    return cs.relevant_texts(asked, q.where("start is not null"), ["s", "a"], "doc")


@query("""select wikidata_id, label_of as label, term_of as term, true as among from (select id as wikidata_id, coalesce(min(label), id) as label_of, coalesce(min(label), id) as term_of from (select distinct wikidata_id as id from entities where wikidata_id is not null union select distinct c from (select unnest(superclasses) as c from entities) where c is not null) left join (select wikidata_id as id, min(label) as label from entities group by 1) using (id) group by id)""")
def flow_names(spark, folder):
    """Ids with their label or else themselves; a term by chance is the label or another name."""
    e = table(spark, folder, "entities").where("wikidata_id is not null")
    ids = e.select(F.col("wikidata_id").alias("id")).union(e.select(F.explode("superclasses")).where("col is not null")).distinct()
    labels, aliases = e.groupBy(F.col("wikidata_id").alias("id")).agg(F.min("label").alias("label")), e.groupBy(F.col("wikidata_id").alias("id")).agg(F.max("aliases").alias("aliases"))
    plain = wikidata.names_of(ids, labels, aliases)
    other = wikidata.names_of(ids, labels, aliases, seed=5).select("id", F.col("term").alias("t")).join(aliases, "id", "left")
    among = other.join(labels, "id", "left").select("id", (F.coalesce("label", "id") == F.col("t")) .alias("same"), F.coalesce(F.array_contains("aliases", F.col("t")), F.lit(False)).alias("alias"))
    return plain.join(among, "id").select(F.col("id").alias("wikidata_id"), "label", "term", (F.col("same") | F.col("alias")).alias("among"))


@query("""select p_partkey, case p_size % 5 when 0 then '|' when 1 then '|,word' when 2 then '|,<NEWLINE>,word' when 3 then '<NEWLINE>' else 'bad' end as may from part""")
def tabletext_allowed(spark, folder):
    """What may follow beginnings of tables of at most two columns."""
    begun = [[], ["|", "a"], ["|", "a", "|"], ["|", "a", "|", "b", "|"], ["|", "a", "|", "<NEWLINE>", "|", "b", "|", "c"]]
    prefix = F.get(F.array(*[F.array(*[F.lit(t) for t in x]).cast("array<string>") for x in begun]), (F.col("p_size") % 5).cast("int"))
    return table(spark, folder, "part").select("p_partkey", F.coalesce(F.array_join(tabletext.allowed_tokens(prefix, 2), ","), F.lit("bad")).alias("may"))
