"""Queries over latent tables, text formats, string functions and quality metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.functions.numbers import number_words
from loomtext.operators import metrics, spans, tabletext
from loomtext.operators.clustering import cluster_values, match_greedy
from loomtext.operators.extractors import LabelExtractor, PatternExtractor
from loomtext.operators.nesting import nest_lookup
from loomtext.operators.ranking import hash_share, top_per_group
from loomtext.operators.reports import ReportTables
from loomtext.plans.catalog import Catalog
from loomtext.plans.nodes import Select, TextAggregate, TextJoin, TextScan, TextSelect, TextUnion, closest_value, value_index
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


PATTERNS = {"airport": ("Z[A-Z]{3}", 0), "runway": ("runway ([0-9]+)", 1), "wind": ("([0-9]+) knots", 1)}


def texts(spark, folder) -> Catalog:
    """documents with the latent tables flight (single-row) and mention (multi-row by kind), and tables about documents."""
    c = Catalog(spark)
    documents = c.collection("documents", table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    documents.view("flight", ["airport", "runway", "wind"], PatternExtractor(PATTERNS))
    documents.view("mention", ["kind", "value"], PatternExtractor(kinds=PATTERNS), identifying="kind")
    reviews = table(spark, folder, "review_labels").select("doc_id", "abusive", "reviewer")
    c.table("reviews", reviews, ["doc_id"])
    c.table("asked", reviews.select("doc_id", F.explode(F.array(F.lit("airport"), F.lit("wind"))).alias("kind")), ["doc_id"])
    c.table("known", table(spark, folder, "documents").select((-F.col("doc_id") - 1).alias("doc_id"), F.upper(F.substring("source", 1, 4)).alias("airport"), F.col("lang").alias("wind")), ["doc_id"])
    return c


def listed(cell: Column) -> Column:
    """Values of a cell in order, listed with |."""
    return F.coalesce(F.array_join(F.array_sort(F.transform(cell, lambda v: v["normed"])), "|"), F.lit(""))


def flat(df: DataFrame) -> DataFrame:
    return df.select(*[listed(F.col(c)).alias(c) if t.startswith("array<struct<normed") else F.col(c) for c, t in df.dtypes])


def _x(name: str) -> str:
    pattern, group = PATTERNS[name]
    return f"array_to_string(list_sort(list_distinct(coalesce(regexp_extract_all(text, '{pattern}', {group}), []))), '|')"


_FLIGHT = f"select doc_id, {_x('airport')} as airport, {_x('runway')} as runway, {_x('wind')} as wind from documents"
_MENTION = " union all ".join(f"select doc_id, '{k}' as kind, {_x(k)} as value from documents" for k in PATTERNS)
_MENTION = f"select * from ({_MENTION}) where value <> ''"


@query(_FLIGHT)
def text_scan_single(spark, folder):
    return flat(TextScan("documents.flight").run(texts(spark, folder)))


@query(f"select doc_id, wind, airport from ({_FLIGHT})")
def text_scan_project(spark, folder):
    return flat(TextScan("documents.flight", ("wind", "airport")).run(texts(spark, folder)))


@query(f"select * from ({_FLIGHT}) order by doc_id limit 50")
def text_scan_limit(spark, folder):
    return flat(TextScan("documents.flight", limit=50).run(texts(spark, folder)))


@query(_MENTION)
def text_scan_multirow(spark, folder):
    return flat(TextScan("documents.mention").run(texts(spark, folder)))


@query(f"select r.doc_id, abusive, reviewer, airport, runway, wind from review_labels r join ({_FLIGHT}) using (doc_id)")
def text_join_table(spark, folder):
    return flat(TextJoin("reviews", "documents.flight", "doc_id").run(texts(spark, folder)))


@query(f"select doc_id, wind, reviewer from review_labels join ({_FLIGHT}) using (doc_id)")
def text_join_project(spark, folder):
    return flat(TextJoin("reviews", "documents.flight", "doc_id", ("wind", "reviewer")).run(texts(spark, folder)))


@query(f"""with k as (select doc_id from review_labels order by doc_id limit (select greatest(cast(floor(count(*) * 0.3) as bigint), 1) from review_labels))
select doc_id, abusive, reviewer, airport, runway, wind from k join review_labels using (doc_id) join ({_FLIGHT}) using (doc_id)""")
def text_join_selected(spark, folder):
    return flat(TextJoin(Select("reviews", 0.3), "documents.flight", "doc_id").run(texts(spark, folder)))


@query(f"with a as (select doc_id, unnest(['airport', 'wind']) as kind from review_labels) select a.doc_id, a.kind, coalesce(value, '') as value from a join documents using (doc_id) left join ({_MENTION}) m on m.doc_id = a.doc_id and m.kind = a.kind")
def text_join_conditioned(spark, folder):
    return flat(TextJoin("asked", "documents.mention", "doc_id").run(texts(spark, folder)))


_KNOWN = "select -doc_id - 1 as doc_id, coalesce(upper(substring(source, 1, 4)), '') as airport, coalesce(lang, '') as wind from documents"


@query(f"{_KNOWN} union all select doc_id, airport, wind from ({_FLIGHT})")
def text_union_all(spark, folder):
    return flat(TextUnion("known", "documents.flight").run(texts(spark, folder)))


@query(f"select doc_id, airport, wind from ({_FLIGHT})")
def text_union_extracted_only(spark, folder):
    return flat(TextUnion("known", "documents.flight", extracted_only=True).run(texts(spark, folder)))


@query(f"select doc_id, airport from ({_KNOWN}) union all select doc_id, airport from ({_FLIGHT})")
def text_union_project(spark, folder):
    from loomtext.plans.nodes import Project

    return flat(TextUnion(Project("known", ("airport",)), "documents.flight").run(texts(spark, folder)))


_WIND = """with v as (select distinct doc_id, unnest(regexp_extract_all(text, '([0-9]+) knots', 1)) as w from documents),
 c as (select w from v group by w order by abs(count(*) / (select count(*) from documents) - 0.002), w limit 1)"""


@query(f"{_WIND} select f.* from ({_FLIGHT}) f where doc_id in (select doc_id from v where w in (select w from c))")
def text_select_delayed(spark, folder):
    return flat(TextScan(TextSelect("documents.flight", "wind", 0.002)).run(texts(spark, folder)))


@query(f"{_WIND} select f.* from ({_FLIGHT}) f where doc_id in (select doc_id from v where w in (select w from c))")
def text_select_indexed(spark, folder):
    return flat(TextScan(TextSelect("documents.flight", "wind", 0.002, indexed=True)).run(texts(spark, folder)))


@query(f"{_WIND} select w as value from c")
def text_select_constant(spark, folder):
    c = texts(spark, folder)
    view = c.get("documents.flight")
    value = closest_value(value_index(view, "wind"), view.collection.df.count(), 0.002)
    return spark.createDataFrame([(value,)], "value string")


@query(f"{_KNOWN} union all select doc_id, airport, wind from ({_FLIGHT}) where list_contains(string_split(airport, '|'), 'ZPVL')")
def text_union_select(spark, folder):
    return flat(TextUnion("known", TextSelect("documents.flight", "airport", constant="ZPVL")).run(texts(spark, folder)))


@query("""with s as (select doc_id, max(w) as rep from (select doc_id, unnest(regexp_extract_all(text, 'runway ([0-9]+)', 1)) as w from documents) group by doc_id),
 a as (select distinct s.rep, x.a from s join (select doc_id, unnest(regexp_extract_all(text, 'Z[A-Z]{3}')) as a from documents) x using (doc_id))
select rep as runway, (select count(*) from s t where t.rep = s.rep) as n_docs, (select coalesce(string_agg(a, '|' order by a), '') from a where a.rep = s.rep) as airports from (select distinct rep from s) s""")
def text_aggregate_exact(spark, folder):
    got = TextAggregate(TextScan("documents.flight"), "runway").run(texts(spark, folder))
    return got.select("runway", F.size("doc_id").cast("long").alias("n_docs"), listed(F.col("airport")).alias("airports"))


@query("""with s as (select doc_id, max(w) as w from (select doc_id, unnest(regexp_extract_all(text, '([0-9]+) knots', 1)) as w from documents) group by doc_id)
select w as wind, count(*) as n_docs from s group by w""")
def text_aggregate_lastwins(spark, folder):
    got = TextAggregate(TextScan("documents.flight", ("wind",)), "wind").run(texts(spark, folder))
    return got.select("wind", F.size("doc_id").cast("long").alias("n_docs"))


@query("""with s as (select doc_id, max(w) as w from (select doc_id, unnest(regexp_extract_all(text, 'Z[A-Z]{3}')) as w from documents) group by doc_id)
select w as airport, count(*) as n_docs from s group by w""")
def text_aggregate_synonyms(spark, folder):
    """Documents by airport, spellings within a fifth of each other taken as one."""
    c = texts(spark, folder)
    index = value_index(c.get("documents.flight"), "airport")
    got = TextAggregate(TextScan("documents.flight", ("airport",)), "airport", cluster_values(index, "normed", 0.2)).run(c)
    return got.select("airport", F.size("doc_id").cast("long").alias("n_docs"))


@query()
def text_aggregate_spellings(spark, folder):
    """Reports by city as they mention it, spellings within a fifth of each other taken as one."""
    c = incident_reports(spark, folder)
    index = value_index(c.get("reports.incident"), "location_city")
    got = TextAggregate(TextScan("reports.incident", ("location_city",)), "location_city", cluster_values(index, "normed", 0.2)).run(c)
    return got.select("location_city", F.size("report_number").cast("long").alias("n_reports"))


def incident_reports(spark, folder) -> Catalog:
    """reports with the latent table incident, filled by the oracle from their mentions, and the table incidents."""
    c = Catalog(spark)
    t = ReportTables(table(spark, folder, "annotated_reports"))
    reports = c.collection("reports", t.reports.select("report_number", "text"), "report_number")
    labels = t.mentions().where("located and agrees").select("report_number", F.lit(None).cast("string").alias("row_key"), "attribute", "pos", F.col("mention").alias("normed"), F.col("start").cast("int").alias("start"), (F.col("start") + F.col("length")).cast("int").alias("end"))
    attributes = ["event_date", "location_city", "location_state", "airport_code", "airport_name", "aircraft_damage", "weather_condition"]
    reports.view("incident", attributes, LabelExtractor(labels, "report_number"))
    c.table("incidents", table(spark, folder, "incidents").distinct(), ["report_number"])
    c.table("damage", table(spark, folder, "incidents").distinct().select("report_number", F.col("aircraft_damage").alias("known_damage")), ["report_number"])
    return c


def _oracle(columns: str) -> str:
    from loomtext.queries.corpus import _RECORDS

    return f"""with {_RECORDS}, good as (select report_number, attribute, lower(mention) as v from placed where st >= 0 and le >= 0 and st + le <= length(text) and substring(text, st + 1, le) = mention),
 b as (select report_number from best),
 o as (select b.report_number{''.join(f", coalesce(string_agg(distinct v, '|' order by v) filter (attribute = '{c}'), '') as {c}" for c in columns.split())} from b left join good using (report_number) group by b.report_number)"""


@query(f"{_oracle('event_date location_city airport_code')} select * from o")
def label_oracle_scan(spark, folder):
    return flat(TextScan("reports.incident", ("event_date", "location_city", "airport_code")).run(incident_reports(spark, folder)))


@query(f"{_oracle('location_city weather_condition')} select i.report_number, i.aircraft_damage as known_damage, o.location_city, o.weather_condition from (select distinct * from incidents) i join o using (report_number)")
def label_oracle_join(spark, folder):
    return flat(TextJoin("damage", "reports.incident", "report_number", ("known_damage", "location_city", "weather_condition")).run(incident_reports(spark, folder)))


def _oracle_scores() -> str:
    from loomtext.queries.corpus import _RECORDS
    from loomtext.queries.corpusflow import _FORM, _scored

    cols = ("event_date", "location_city", "location_state", "airport_code", "airport_name")
    rows = " union all ".join(f"select report_number, '{c}' as attribute, {_FORM.format(c)} as value from (select distinct * from incidents)" for c in cols)
    good = f"select report_number, attribute, list(distinct {_FORM.format('mention')}) as forms, count(distinct lower(mention)) as n_sets from placed where st >= 0 and le >= 0 and st + le <= length(text) and substring(text, st + 1, le) = mention group by 1, 2"
    return f"with {_RECORDS}, labels as ({good}), given as ({rows}), {_scored('select attribute, value, coalesce(forms, []) as forms, coalesce(n_sets, 0) as n_sets from given join best using (report_number) left join labels using (report_number, attribute)', 'attribute')}"


@query(_oracle_scores())
def label_oracle_scores(spark, folder):
    """Rows of incidents as predictions against the oracle's cells, per attribute."""
    c = incident_reports(spark, folder)
    cols = ["event_date", "location_city", "location_state", "airport_code", "airport_name"]
    truth = TextScan("reports.incident", tuple(cols)).run(c).select("report_number", *[F.transform(a, lambda v: v["alts"]).alias(f"t_{a}") for a in cols])
    both = c.get("incidents").df.select("report_number", *cols).join(truth, "report_number")
    each = None
    for a in cols:
        one = both.select("report_number", F.lit(a).alias("attribute"), metrics.value_counts(F.array(a), F.col(f"t_{a}")).alias("c")).select("attribute", "report_number", "c.*")
        each = one if each is None else each.unionByName(one)
    return metrics.rounded(metrics.summarise(each, ["attribute"]))


_TABLE = "'| name | size | <NEWLINE> | ' || p_name || ' | ' || p_size || ' | <NEWLINE> | ' || p_brand || ' | '"


def _part_tables(spark, folder) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return p.withColumn("t", F.concat(F.lit("| name | size | <NEWLINE> | "), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" | <NEWLINE> | "), "p_brand", F.when(F.col("p_size") % 2 == 0, " | 1 |").otherwise(" |")))


@query("select p_partkey, 3 as n_rows, p_name as first_name, p_brand as second_name, case when p_size % 2 = 0 then '1' else '' end as second_size from part")
def tabletext_parse(spark, folder):
    rows = tabletext.parse_table(F.col("t"))
    at = lambda i, j: F.get(F.get(rows, F.lit(i)), F.lit(j))
    return _part_tables(spark, folder).select("p_partkey", F.size(rows).alias("n_rows"), at(1, 0).alias("first_name"), at(2, 0).alias("second_name"), at(2, 1).alias("second_size"))


@query("select p_partkey, p_size % 2 = 0 as ok from part")
def tabletext_wellformed(spark, folder):
    return _part_tables(spark, folder).select("p_partkey", tabletext.well_formed(F.col("t")).alias("ok"))


@query("select p_partkey, '| name | size | <NEWLINE> | ' || p_name || ' | ' || p_size || ' | <NEWLINE> | ' || p_brand || ' | ' || case when p_size % 2 = 0 then '1' else '' end || ' |' as again from part")
def tabletext_roundtrip(spark, folder):
    return _part_tables(spark, folder).select("p_partkey", tabletext.table_text(tabletext.parse_table(F.col("t"))).alias("again"))


@query("select p_partkey, p_name as name, p_size || '' as size, '' as colour from part union all select p_partkey, p_brand, '', '' from part where p_size % 3 = 0")
def csv_completion_parse(spark, folder):
    p = table(spark, folder, "part")
    answer = F.concat(F.lit("Sure:\n"), F.when(F.col("p_size") % 2 == 0, "Name;Size\n").otherwise(""), "p_name", F.lit("; "), F.col("p_size").cast("string"), F.lit(".0"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("\n"), "p_brand", F.lit(";"))).otherwise(""))
    rows = tabletext.completion_rows(answer, ["name", "size", "colour"])
    return p.select("p_partkey", F.explode(rows).alias("r")).select("p_partkey", "r.*")


@query("""select doc_id, md5('List airport, wind of the following text as a table with ; between cells.' || chr(10) || coalesce(text, '')) as prompt from documents""")
def prompt_build(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(tabletext.prompt(F.col("text"), ["airport", "wind"]).cast("binary")).alias("prompt"))


@query("select lang, cast(sum(len([w for w in string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+') if w <> ''])) * 5 as bigint) as dollars_e7 from documents group by lang")
def cost_estimate(spark, folder):
    """Price of reading the documents at 0.0005 dollars a thousand words, in ten-millionths of a dollar."""
    dollars = F.sum(tabletext.cost([F.col("text")], [], 0.0005, 0.0015))
    return table(spark, folder, "documents").groupBy("lang").agg(F.round(dollars * 1e7).cast("long").alias("dollars_e7"))


@query("""select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by ('0x' || substring(md5(doc_id || '|11'), 1, 8))::bigint, doc_id) as rn from documents) where rn <= 3""")
def fewshot_topk(spark, folder):
    return top_per_group(table(spark, folder, "documents").select("lang", "doc_id"), ["lang"], [hash_share(F.col("doc_id"), 11), F.col("doc_id")], 3)


@query("""with t as (select doc_id, [w for w in string_split(coalesce(text, ''), ' ') if w <> ''] as w from documents), n as (select doc_id, w, greatest(1, 1 + cast(ceil((len(w) - 64) / 48.0) as bigint)) as k from t)
select doc_id, cast(i as int) as number, cast(len(w[i * 48 + 1 : i * 48 + 64]) as int) as n_tokens, coalesce(w[i * 48 + 1], '') as first_token from n, unnest(range(k)) u(i)""")
def win_text_windows(spark, folder):
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    w = table(spark, folder, "documents").select("doc_id", tokens.alias("w")).select("doc_id", F.explode(spans.token_windows(F.col("w"), 64, 16)).alias("x"))
    return w.select("doc_id", "x.number", F.size("x.tokens").alias("n_tokens"), F.coalesce(F.get("x.tokens", F.lit(0)), F.lit("")).alias("first_token"))


@query(r"""with d as (select doc_id, regexp_extract_all(text, '[A-Z]{2,6}') as m, regexp_split_to_array(text, '[A-Z]{2,6}') as g from documents where text is not null),
 e as (select *, unnest(range(1, len(m) + 1)) as i from d), p as (select doc_id, m[i] as value, cast(list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) as int) as start from e)
select doc_id, start, start + cast(length(value) as int) as "end", value from p""")
def span_places(spark, folder):
    """Places of runs of capitals in documents."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(spans.find_spans(F.col("text"), "[A-Z]{2,6}")).alias("s")).select("doc_id", "s.start", "s.end", "s.value")


@query()
def span_offsets(spark, folder):
    """Places of airport codes and numbers in documents, the longest kept where they overlap."""
    both = F.concat(spans.find_spans(F.col("text"), "Z[A-Z]{3}"), spans.find_spans(F.col("text"), "[A-Z]{2,6}"))
    each = table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(spans.longest_wins(both)).alias("s"))
    return each.select("doc_id", "s.start", "s.end", "s.value")


_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety"


@query("select p_partkey, p_size as n, 1000 * p_size + p_size + 100 as big from part")
def fn_number_words(spark, folder):
    """Phrases put together here from the words of units and tens, read as numbers."""
    p = table(spark, folder, "part")
    units, tens = F.split(F.lit(_UNITS), " "), F.split(F.lit(_TENS), " ")
    low = lambda n: F.get(units, n)
    ten = F.get(tens, F.floor(F.col("p_size") / 10).cast("int") - 2)
    phrase = F.when(F.col("p_size") < 20, low(F.col("p_size"))).otherwise(F.concat(ten, F.when(F.col("p_size") % 10 > 0, F.concat(F.lit("-"), low(F.col("p_size") % 10))).otherwise("")))
    big = F.concat(phrase, F.lit(" thousand one hundred and "), phrase)
    return p.select("p_partkey", number_words(phrase).cast("int").alias("n"), number_words(big).cast("int").alias("big"))


@query(r"""with v as (select _answer_uri as stamp, count(*) as n from raw_queries where _answer_uri is not null group by 1),
 p as (select *, regexp_extract(stamp, '^[+-]?([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})Z$', ['y', 'm', 'd', 'h', 'i', 's']) as x,
   regexp_extract(stamp, '^[+-]?[0-9]+-([0-9]{2})-([0-9]{2})(?:T([0-9:]*)Z?)?$', ['m', 'd', 't']) as z, case when starts_with(stamp, '-') then ' bc' else '' end as era from v)
select stamp, n, case when x.y <> '' and x.m <= '12' and x.d <= '31' and not (x.m = '00' and x.d <> '00')
   then concat_ws(' ', case when x.h <> '00' or x.i <> '00' then x.h || ':' || x.i end, case when x.d <> '00' then x.d end, case when x.m <> '00' then ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][try_cast(x.m as int)] end, x.y || era)
   else split_part(regexp_replace(stamp, '^[+-]', ''), '-', 1) || era end as words,
 case when z.m = '' then null when z.m = '00' then 'year' when z.d = '00' then 'month' when z.t in ('', '00:00:00') then 'day' else 'time' end as precision from p""")
def fn_partial_date(spark, folder):
    """All answers as words of dates, whatever they are."""
    q = table(spark, folder, "raw_queries").where("_answer_uri is not null")
    return q.groupBy(F.col("_answer_uri").alias("stamp")).agg(F.count("*").alias("n")).select("stamp", "n", tx.words_of_date(F.col("stamp")).alias("words"), tx.date_precision(F.col("stamp")).alias("precision"))


@query("select _subject_uri, split_part(_subject_uri, '/', -1) as short, count(*) as n from raw_queries where _subject_uri is not null group by all")
def fn_uri_short(spark, folder):
    q = table(spark, folder, "raw_queries").where("_subject_uri is not null").groupBy("_subject_uri").agg(F.count("*").alias("n"))
    return q.select("_subject_uri", "n", tx.short_uri(F.col("_subject_uri")).alias("short"))


@query("select wikidata_id, replace(strip_accents(label), 'ß', 'ss') as plain, modified_at from entities where label is not null")
def fn_accent_fold(spark, folder):
    return table(spark, folder, "entities").where("label is not null").select("wikidata_id", tx.fold_accents(F.col("label")).alias("plain"), "modified_at")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def fn_json_get(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("""with m as (select text_idx, c.s as s, c.p as p, c.start_pos as a, c.end_pos as b from (select distinct text_idx, unnest(covers) as c from texts))
select x.text_idx, count(*) as n_pairs, count(*) filter (x.s = y.s) as n_same from m x join m y on x.text_idx = y.text_idx and x.p = y.p and (x.a, x.b) < (y.a, y.b) group by x.text_idx""")
def dedup_pairs(spark, folder):
    m = table(spark, folder, "texts").select("text_idx", F.explode("covers").alias("c")).select("text_idx", "c.s", "c.p", F.struct(F.col("c.start_pos").alias("a"), F.col("c.end_pos").alias("b")).alias("at")).distinct()
    o = m.select("text_idx", "p", F.col("s").alias("s2"), F.col("at").alias("at2"))
    return m.join(o, ["text_idx", "p"]).where("at < at2").groupBy("text_idx").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("s").eqNullSafe(F.col("s2"))).alias("n_same"))


@query("""with v as (select 'part' as level, p_brand || '' as grp, p_size || '' as value from part)
select 'p_brand' as level, p_brand as group_name, cast(p_size as varchar) as value, count(*) as n from part group by all
union all select 'p_type', p_type, cast(p_size as varchar), count(*) from part group by all
union all select '', '', cast(p_size as varchar), count(*) from part group by all""")
def agg_levels_histogram(spark, folder):
    return metrics.histogram(table(spark, folder, "part"), "p_size", [["p_brand"], ["p_type"], []]).withColumnRenamed("group", "group_name")


@query("""with d as (select reviewer, doc_id, coalesce((abusive = 1 and sexual = 0)::int, 0) as tp, coalesce((abusive = 1 and sexual = 1)::int, 0) as fp, coalesce((abusive = 0 and hateful = 1)::int, 0) as fn from review_labels)
select reviewer, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, round(sum(tp) / (sum(tp) + sum(fp) + 1e-8), 6) as precision, round(quantile_cont(2.0 * tp / (2 * tp + fp + fn), 0.5), 6) as median_f1
from d where tp + fp + fn > 0 group by reviewer""")
def agg_metric_quantiles(spark, folder):
    n = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    d = table(spark, folder, "review_labels").select("reviewer", n((F.col("abusive") == 1) & (F.col("sexual") == 0)).alias("tp"), n((F.col("abusive") == 1) & (F.col("sexual") == 1)).alias("fp"), n((F.col("abusive") == 0) & (F.col("hateful") == 1)).alias("fn"))
    s = metrics.summarise(d, ["reviewer"])
    return s.select("reviewer", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("median_f1", 6).alias("median_f1"))


@query("""with a as (select p_brand, list(distinct p_size) as x from part where p_retailprice < 970 group by 1), b as (select p_brand, list(distinct p_size) as y from part where p_retailprice > 930 group by 1)
select p_brand, round(len(list_intersect(x, y)) / (len(x) + 1e-8), 6) as precision, round(len(list_intersect(x, y)) / (len(y) + 1e-8), 6) as recall from a join b using (p_brand)""")
def agg_metrics_prf(spark, folder):
    p = table(spark, folder, "part")
    a = p.where("p_retailprice < 970").groupBy("p_brand").agg(F.collect_set("p_size").alias("x"))
    b = p.where("p_retailprice > 930").groupBy("p_brand").agg(F.collect_set("p_size").alias("y"))
    s = metrics.table_f1(F.col("x"), F.col("y"))
    return a.join(b, "p_brand").select("p_brand", F.round(s["precision"], 6).alias("precision"), F.round(s["recall"], 6).alias("recall"))


@query()
def match_rows(spark, folder):
    """Cities of incidents matched one to one, per report, with the cities that it mentions, all of them as alternatives in order of their place."""
    t = ReportTables(table(spark, folder, "annotated_reports"))
    city = t.mentions().where("attribute = 'location_city' and mention is not null")
    cities = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mention"))), lambda m: m["mention"]))
    labels = city.groupBy("report_number").agg(cities.alias("cities"))
    predicted = table(spark, folder, "incidents").distinct().join(labels.select("report_number"), "report_number", "left_semi").select("report_number", "location_city")
    return match_greedy(predicted, labels, "report_number", "location_city", "cities")


@query("""select text_idx, count(*) as n from texts group by text_idx""")
def lookup_count(spark, folder):
    t = table(spark, folder, "texts").select("text_idx", "ingested_at")
    return nest_lookup(t.select("text_idx").distinct(), t, "text_idx", "text_idx", ["ingested_at"], "rows").select("text_idx", F.size("rows").cast("long").alias("n"))


@query("""with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, md5(substring(t, 1, list_max(list_filter(range(0, cast(least(length(t), 40) as bigint) + 1), lambda i: octet_length(encode(substring(t, 1, i))) <= 40)))) as head from d""")
def fn_bytes_bound(spark, folder):
    """The longest beginning of at most 40 bytes."""
    return table(spark, folder, "documents").select("doc_id", F.md5(tx.within_bytes(F.coalesce("text", F.lit("")), 40)).alias("head"))
