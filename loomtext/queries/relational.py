"""Queries of the relational operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions.ids import kb_id
from loomtext.operators.closure import transitive_hull
from loomtext.operators.nesting import dependent, group_into_tables, nest_lookup, nest_lookup_any, upsert
from loomtext.operators.ranking import chunk, global_rank, group_rank, rank_buckets, split_name, top_per_group, weighted_sample
from loomtext.plans.catalog import Catalog
from loomtext.plans.nodes import Join, Project, Select
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


def trade(spark: SparkSession, folder: str) -> Catalog:
    c = Catalog(spark)
    c.table("customer", table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")), ["custkey"])
    c.table("orders", table(spark, folder, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")), ["orderkey"])
    c.table("lineitem", table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("status")), ["orderkey", "line"])
    c.table("part", table(spark, folder, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")), ["partkey"])
    return c


@query("select o_custkey as custkey, o_orderkey as orderkey, o_orderstatus as status, o_totalprice as price, c_name as name, c_nationkey as nation from orders join customer on o_custkey = c_custkey")
def join_inner_keys(spark, folder):
    return Join("customer", "orders", "custkey").run(trade(spark, folder))


@query("select l_orderkey as orderkey, l_linenumber as line, l_quantity as quantity, l_returnflag as status_x, o_custkey as custkey, o_orderstatus as status_y, o_totalprice as price from lineitem join orders on l_orderkey = o_orderkey")
def join_multi_key_demote(spark, folder):
    return Join("orders", "lineitem", "orderkey").run(trade(spark, folder))


@query("select d.doc_id, d.lang, r.abusive, r.reviewer from documents d left join review_labels r on d.doc_id = r.doc_id")
def join_left_evidence(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "review_labels").select("doc_id", "abusive", "reviewer"), "doc_id", "left")


@query("select c_custkey, count(o_orderkey) as n_orders, min(o_orderkey) as first_order, max(o_totalprice) as top_price from customer left join orders on c_custkey = o_custkey group by c_custkey")
def join_nest_lookup(spark, folder):
    nested = nest_lookup(table(spark, folder, "customer").select("c_custkey"), table(spark, folder, "orders"), "c_custkey", "o_custkey", ["o_orderkey", "o_totalprice"], "orders")
    return nested.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), F.array_min(F.transform("orders", lambda o: o["o_orderkey"])).alias("first_order"), F.array_max(F.transform("orders", lambda o: o["o_totalprice"])).alias("top_price"))


@query("""with e as (select wikidata_id, unnest(list_distinct(types)) as t from entities), n as (select t, count(distinct wikidata_id) as n from e group by t)
select e.wikidata_id, cast(max(n.n) as bigint) as n_most, count(*) as n_types from (select distinct * from e) e join n using (t) where e.wikidata_id is not null group by e.wikidata_id""")
def join_nest_lookup_any(spark, folder):
    e = table(spark, folder, "entities").where("wikidata_id is not null").groupBy("wikidata_id").agg(F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"))
    kinds = e.select("wikidata_id", F.explode("types").alias("t")).groupBy("t").agg(F.countDistinct("wikidata_id").alias("n"))
    nested = nest_lookup_any(e, kinds, "wikidata_id", "types", "t", ["t", "n"], "kinds").where(F.size("kinds") > 0)
    return nested.select("wikidata_id", F.array_max(F.transform("kinds", lambda k: k["n"])).alias("n_most"), F.size("kinds").cast("long").alias("n_types"))


@query("select o_custkey, count(*) as n_above from orders o where o_totalprice > (select avg(o_totalprice) from orders i where i.o_custkey = o.o_custkey) group by o_custkey")
def join_correlated_lookup(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_totalprice")
    own = F.avg("o_totalprice").over(Window.partitionBy("o_custkey"))
    return o.withColumn("own", own).where("o_totalprice > own").groupBy("o_custkey").agg(F.count("*").alias("n_above"))


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders)")
def join_semi_lookup(spark, folder):
    return table(spark, folder, "customer").join(table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
def join_anti_lookup(spark, folder):
    return table(spark, folder, "customer").join(table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


_ID = r"upper(regexp_extract({0}, '(?i)^(?:.*[/:#])?\s*({1}[0-9]+)\s*$', 1))"


@query(f"""with q as (select distinct _doc as doc, {_ID.format('_answer_uri', 'Q')} as answer, {_ID.format('_subject_uri', 'Q')} as subject from raw_queries where _doc is not null),
 r as (select * from q where answer <> '' and subject <> '')
select a.doc, a.answer as key, b.answer as child from r a join r b on a.doc = b.doc and a.answer = b.subject where a.answer <> b.answer and a.subject <> b.answer""")
def join_self_dependent(spark, folder):
    q = table(spark, folder, "raw_queries").select(F.col("_doc").alias("doc"), kb_id(F.col("_answer_uri"), "Q").alias("answer"), kb_id(F.col("_subject_uri"), "Q").alias("subject"))
    return dependent(q.where("doc is not null and answer is not null and subject is not null").distinct(), "doc", "answer", "subject")


@query("""with b as (select i as bucket, i * 50.0 as lo, (i + 1) * 50.0 as hi from range(0, 20) t(i))
select cast(bucket as int) as bucket, event_type, count(*) as n from events join b on value >= lo and value < hi group by all""")
def join_range_containment(spark, folder):
    # twenty fixed intervals
    b = spark.range(20).select(F.col("id").cast("int").alias("bucket"), (F.col("id") * 50.0).alias("lo"), ((F.col("id") + 1) * 50.0).alias("hi"))
    return table(spark, folder, "events").join(F.broadcast(b), (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi"))).groupBy("bucket", "event_type").agg(F.count("*").alias("n"))


@query("""select c_custkey, o_orderkey from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by abs(o_totalprice - c_acctbal), o_orderkey) as rn
from customer join orders on c_custkey = o_custkey) where rn = 1""")
def join_nearest(spark, folder):
    both = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy("c_custkey").agg(F.min_by("o_orderkey", F.struct(F.abs(F.col("o_totalprice") - F.col("c_acctbal")), "o_orderkey")).alias("o_orderkey"))


@query("select p_partkey as partkey, p_name as name, p_brand as brand from part order by p_partkey limit (select greatest(cast(floor(count(*) * 0.05) as bigint), 1) from part)")
def select_prefix_unique(spark, folder):
    return Select("part", 0.05).run(trade(spark, folder))


@query("""with k as (select l_orderkey as k from lineitem order by 1 limit (select greatest(cast(floor(count(*) * 0.01) as bigint), 1) from lineitem))
select l_orderkey as orderkey, l_quantity as quantity from k join lineitem on l_orderkey = k""")
def select_prefix_dupkeys(spark, folder):
    c = Catalog(spark)
    c.table("lines", table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_quantity").alias("quantity")), ["orderkey"])
    return Select("lines", 0.01).run(c)


@query("select o_orderkey as orderkey, o_totalprice as price from orders")
def project_keys_kept(spark, folder):
    return Project("orders", ("price",)).run(trade(spark, folder))


@query("select event_id, event_type, user_id % 10 as digit from events where (event_type, user_id % 10) not in (('view', 1), ('click', 2), ('click', 3))")
def filter_tuple_not_in(spark, folder):
    out = spark.createDataFrame([("view", 1), ("click", 2), ("click", 3)], "event_type string, digit long")
    return table(spark, folder, "events").select("event_id", "event_type", (F.col("user_id") % 10).alias("digit")).join(F.broadcast(out), ["event_type", "digit"], "left_anti")


@query("""select text_idx, case when _testset >= 3 then 'test' when _testset = 2 then 'development' when _testset = 1 then 'unseen' when is_test then 'test' else 'train' end as split, count(*) as n from texts group by all""")
def filter_switch_split(spark, folder):
    split = F.when(F.col("_testset") >= 3, "test").when(F.col("_testset") == 2, "development").when(F.col("_testset") == 1, "unseen").when(F.col("is_test"), "test").otherwise("train")
    return table(spark, folder, "texts").groupBy("text_idx", split.alias("split")).agg(F.count("*").alias("n"))


@query("select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as priorities from orders group by o_custkey")
def agg_addtoset(spark, folder):
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("""with i as (select l_orderkey, count(*) as n, sum(l_quantity) as q from lineitem group by l_orderkey)
select o_custkey, count(*) as n_orders, cast(sum(n) as bigint) as n_lines, round(max(q), 4) as most from orders join i on l_orderkey = o_orderkey group by o_custkey""")
def agg_push_two_level(spark, folder):
    lines = nest_lookup(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), table(spark, folder, "lineitem"), "o_orderkey", "l_orderkey", ["l_linenumber", "l_quantity"], "lines").where(F.size("lines") > 0)
    nested = lines.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "lines")).alias("orders"))
    total = lambda o: F.aggregate(o["lines"], F.lit(0.0), lambda a, x: a + x["l_quantity"])
    return nested.select("o_custkey", F.size("orders").cast("long").alias("n_orders"), F.aggregate("orders", F.lit(0).cast("long"), lambda a, o: a + F.size(o["lines"])).alias("n_lines"), F.round(F.array_max(F.transform("orders", total)), 4).alias("most"))


@query("select p_type, count(*) as n from part group by p_type having count(*) > 5")
def agg_count_having(spark, folder):
    return table(spark, folder, "part").groupBy("p_type").agg(F.count("*").alias("n")).where("n > 5")


@query("select o_custkey, max(o_orderstatus = 'F') as any_done from orders group by o_custkey having max(o_totalprice) > 1000")
def agg_bool_max(spark, folder):
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("any_done"), F.max("o_totalprice").alias("m")).where("m > 1000").drop("m")


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) where rn = 1")
def agg_first_per_group(spark, folder):
    return top_per_group(table(spark, folder, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("select l_orderkey, string_agg(l_returnflag || l_linestatus, ' ' order by l_linenumber, l_returnflag || l_linestatus) as flags from lineitem group by l_orderkey")
def agg_text_merge(spark, folder):
    flags = F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("f"))))
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(flags, lambda x: x["f"]), " ").alias("flags"))


@query("select label, p as pos, round(avg(v), 5) as mean from (select label, unnest(embedding) as v, unnest(range(len(embedding))) as p from embeddings) group by label, p")
def agg_keyed_mean(spark, folder):
    each = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return each.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


@query("""with v as (select o_custkey as k, o_orderpriority as p, count(*) as n from orders group by all)
select k, p from (select a.k, a.p, row_number() over (partition by a.k order by count(*) filter (where a.n > b.n or (a.n = b.n and a.p < b.p)) desc, a.p) as rn from v a left join v b on a.k = b.k and a.p <> b.p group by a.k, a.p) where rn = 1""")
def agg_pairwise_majority(spark, folder):
    v = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    # five priorities a key: the pairs of a key are few
    w = v.select("k", F.col("p").alias("q"), F.col("n").alias("m"))
    wins = v.join(w, "k").groupBy("k", "p").agg(F.count_if((F.col("p") != F.col("q")) & ((F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("p") < F.col("q"))))).alias("wins"))
    return top_per_group(wins, ["k"], [F.col("wins").desc(), F.col("p")]).select("k", "p")


@query("select p_brand, cast(pow(2, count(distinct p_type)) as double) as weight from part group by p_brand")
def agg_power_weight(spark, folder):
    return table(spark, folder, "part").groupBy("p_brand").agg(F.pow(F.lit(2), F.countDistinct("p_type")).alias("weight"))


@query("""with r as (select lang, doc_id, row_number() over (partition by lang order by length(coalesce(text, '')), doc_id) - 1 as pos, count(*) over (partition by lang) as n from documents)
select lang, doc_id, cast(floor((n - 1 - pos) / 50) as bigint) as bucket from r""")
def win_rank_bucket(spark, folder):
    d = table(spark, folder, "documents").select("lang", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("len"))
    return rank_buckets(d, ["lang"], [F.col("len"), F.col("doc_id")], 50).select("lang", "doc_id", "bucket")


@query("select l_orderkey, l_linenumber, l_partkey, cast(coalesce(sum(length(l_returnflag || l_linestatus) + 1) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding), 0) as bigint) as start_at from lineitem")
def win_running_offset(spark, folder):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.sum(F.length(F.concat("l_returnflag", "l_linestatus")) + 1).over(w), F.lit(0)).cast("long").alias("start_at"))


@query("""with n as (select p_type, count(*) as n from part group by p_type)
select p_brand, p_type from (select p.p_brand, p.p_type, row_number() over (partition by p.p_brand order by n.n, p.p_type) as rn from part p join n using (p_type)) where rn = 1""")
def win_top1_rarest(spark, folder):
    p = table(spark, folder, "part").select("p_brand", "p_type")
    n = p.groupBy("p_type").agg(F.count("*").alias("n"))
    return p.join(n, "p_type").groupBy("p_brand").agg(F.min(F.struct("n", "p_type"))["p_type"].alias("p_type"))


@query("""with r as (select wikidata_id, modified_at, (label is not null)::int + (description is not null)::int + (len(coalesce(aliases, [])) > 0)::int as filled from entities)
select wikidata_id, filled from (select *, row_number() over (order by filled desc, wikidata_id, modified_at desc) as rn from r) where rn <= 2""")
def win_fullest_examples(spark, folder):
    filled = F.col("label").isNotNull().cast("int") + F.col("description").isNotNull().cast("int") + (F.size(F.coalesce("aliases", F.array())) > 0).cast("int")
    return table(spark, folder, "entities").select("wikidata_id", "modified_at", filled.alias("filled")).orderBy(F.desc("filled"), "wikidata_id", F.desc("modified_at")).limit(2).select("wikidata_id", "filled")


@query("select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as place from orders")
def win_global_rank(spark, folder):
    return global_rank(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


_U = "(('0x' || substring(md5({0} || '|{1}'), 1, 8))::bigint / 4294967296.0)"


@query(f"with u as (select doc_id, {_U.format('doc_id', 5)} as u from documents) select doc_id, case when u < 0.9 then 'train' when u < 0.93 then 'valid' else 'test' end as split from u")
def sample_hash_split(spark, folder):
    return table(spark, folder, "documents").select("doc_id", split_name(F.col("doc_id"), {"train": 0.9, "valid": 0.03, "test": 0.07}, 5).alias("split"))


@query(f"select p_brand, p_partkey, cast(floor((row_number() over (partition by p_brand order by {_U.format('p_partkey', 3)}, p_partkey) - 1) / 3) as bigint) as chunk from part")
def chunk_groups(spark, folder):
    return chunk(table(spark, folder, "part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 3, 3)


@query(f"select p_partkey from part order by -ln(greatest({_U.format('p_partkey', 1)}, 1e-12)) / p_retailprice, p_partkey limit 40")
def sample_weighted(spark, folder):
    return weighted_sample(table(spark, folder, "part"), F.col("p_partkey"), F.col("p_retailprice"), 40, 1).select("p_partkey")


@query("select size, count(*) as n from (values (4), (16), (64), (256)) s(size) join customer on c_custkey <= size group by size")
def sample_nested(spark, folder):
    sizes = F.filter(F.array(*[F.lit(s) for s in (4, 16, 64, 256)]), lambda s: F.col("c_custkey") <= s)
    return table(spark, folder, "customer").select(F.explode(sizes).alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query("""select n_nationkey as k, n_name as name, cast(null as varchar) as segment from nation union all select c_custkey, c_name, c_mktsegment from customer""")
def set_union_missing(spark, folder):
    a = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    b = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("select distinct event_type, user_id from events")
def set_distinct(spark, folder):
    return table(spark, folder, "events").select("event_type", "user_id").distinct()


@query("""with a as (select p_brand as k, list(distinct p_size) as s from part group by 1), b as (select coalesce(list(distinct p_size), []) as t from part where p_retailprice > 990)
select k, array_to_string(list_sort(list_intersect(s, t)), ',') as both, array_to_string(list_sort([x for x in s if not list_contains(t, x)]), ',') as rest, cast(len(list_distinct(list_concat(s, t))) as int) as n_either from a, b""")
def set_array_algebra(spark, folder):
    p = table(spark, folder, "part")
    a = p.groupBy(F.col("p_brand").alias("k")).agg(F.collect_set("p_size").alias("s"))
    b = p.where("p_retailprice > 990").agg(F.collect_set("p_size").alias("t"))
    both = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one")  # a single row
    text = lambda x: F.array_join(F.array_sort(x).cast("array<string>"), ",")
    return both.select("k", text(F.array_intersect("s", "t")).alias("both"), text(F.array_except("s", "t")).alias("rest"), F.size(F.array_union("s", "t")).alias("n_either"))


@query("(select o_custkey as k from orders where o_totalprice > 200000 intersect select c_custkey from customer where c_acctbal > 0) except select c_custkey from customer where c_nationkey < 5")
def set_intersect_except(spark, folder):
    c = table(spark, folder, "customer")
    big = table(spark, folder, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return big.intersect(c.where("c_acctbal > 0").select("c_custkey")).subtract(c.where("c_nationkey < 5").select("c_custkey"))


@query(f"""with recursive e as (select distinct id as node, {_ID.format('p', 'Q')} as parent from (select {_ID.format('wikidata_id', 'Q')} as id, unnest(superclasses) as p from entities) where id <> '' and {_ID.format('p', 'Q')} <> ''),
 h as (select node, parent as ancestor from e union select h.node, e.parent from h join e on h.ancestor = e.node)
select node, ancestor from h""")
def graph_hull(spark, folder):
    e = table(spark, folder, "entities").select(kb_id(F.col("wikidata_id"), "Q").alias("node"), F.explode("superclasses").alias("p")).select("node", kb_id(F.col("p"), "Q").alias("parent"))
    return transitive_hull(e)


@query("""select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""")
def upsert_keep_last(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value", "ts")
    newest = [F.col("ts").desc(), F.col("event_id").desc()]
    old = top_per_group(e.where("event_type = 'view'"), ["user_id"], newest)
    return upsert(old, e, ["user_id"], newest).drop("ts")


@query()
def group_tables(spark, folder):
    """Entities grouped into tables by their rarest frequent type, then superclass."""
    e = table(spark, folder, "entities").where("wikidata_id is not null").groupBy("wikidata_id").agg(F.max(F.struct("modified_at", "types", "superclasses", F.transform("neighbors", lambda n: n["p"]).alias("p"))).alias("r"))
    rows = e.select("wikidata_id", F.coalesce("r.types", F.array()).cast("array<string>").alias("types"), F.coalesce("r.superclasses", F.array()).cast("array<string>").alias("superclasses"), F.coalesce("r.p", F.array()).cast("array<string>").alias("neighbors"))
    return group_into_tables(rows, "wikidata_id", ["types", "superclasses"], "neighbors").withColumnRenamed("table", "group_name")


@query("select p_brand, cast(i as bigint) as run_start, cast(j + 1 as bigint) as run_end from (select p_brand, min(k) as i, max(k) as j from (select distinct p_brand, p_size as k, p_size - dense_rank() over (partition by p_brand order by p_size) as g from part) group by p_brand, g)")
def runs_of_ids(spark, folder):
    from loomtext.operators.spans import gaps_and_islands

    p = table(spark, folder, "part").groupBy("p_brand").agg(F.collect_set("p_size").alias("s"))
    return p.select("p_brand", F.explode(gaps_and_islands(F.col("s"))).alias("r")).select("p_brand", F.col("r.start").alias("run_start"), F.col("r.end").alias("run_end"))


@query("select a.user_id, a.event_type, count(e.event_id) as n from (select * from (select distinct user_id from events), (select distinct event_type from events)) a left join events e on a.user_id = e.user_id and a.event_type = e.event_type group by all")
def zero_filled_counts(spark, folder):
    e = table(spark, folder, "events")
    kinds = e.select("event_type").distinct().agg(F.collect_set("event_type").alias("kinds")).withColumn("one", F.lit(1))  # one row of a few kinds
    every = e.select("user_id").distinct().withColumn("one", F.lit(1)).join(kinds, "one").select("user_id", F.explode("kinds").alias("event_type"))
    counts = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return every.join(counts, ["user_id", "event_type"], "left").select("user_id", "event_type", F.coalesce("n", F.lit(0)).alias("n"))


@query("select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) - 1 as row_id from part")
def row_ids_per_table(spark, folder):
    p = table(spark, folder, "part").select("p_brand", "p_partkey")
    return group_rank(p, ["p_brand"], [F.col("p_partkey")]).select("p_brand", "p_partkey", (F.col("rank") - 1).alias("row_id"))


