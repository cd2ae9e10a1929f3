"""Round trips of sources and sinks: tables are written in each format and read back by its reader, with the SQL of what must come out."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.cells import cell_text
from loomtext.operators import corpussteps as cs
from loomtext.operators import wikidata
from loomtext.plans.nodes import TextScan
from loomtext.sources import databases, readers, sinks
from loomtext.queries.tables import table
from loomtext.workspace import Workspace

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def folder_of(spark: SparkSession, name: str) -> str:
    return Workspace(spark, name).root


def written(df: DataFrame, name: str, *order: str) -> str:
    """Path of one text file with the lines of the column `value` in some order."""
    path = f"{folder_of(df.sparkSession, name)}/lines"
    df.repartition(1).sortWithinPartitions(*order).select("value").write.text(path)
    return path


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(content))
    out.close()


def nations(spark: SparkSession, folder: str) -> list:
    """The 25 rows of a table of fixed size."""
    return table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()


@query("select n_name as name, 'Nation ' || n_name || chr(10) || 'of region ' || n_regionkey as text from nation")
def src_text_files(spark, folder):
    where = folder_of(spark, "texts")
    for r in nations(spark, folder):
        put(spark, f"{where}/{r['n_name']}.txt", f"Nation {r['n_name']}\nof region {r['n_regionkey']}".encode())
    return readers.text_files(spark, where)


@query("select row_number() over (order by p_partkey) - 1 as number, p_name as line from part")
def src_lines(spark, folder):
    return readers.lines(spark, written(table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("value")), "lines", "p_partkey"))


@query("select row_number() over (order by p_partkey) - 1 as number, p_brand as data, p_name as text from part")
def src_paired_lines(spark, folder):
    p = table(spark, folder, "part")
    one = lambda c: written(p.select("p_partkey", F.col(c).alias("value")), c, "p_partkey")
    return readers.paired_lines(spark, one("p_brand"), one("p_name"))


@query("select p_partkey, 0 as row, p_name as name, p_brand as brand from part union all select p_partkey, 1, p_type, '' from part where p_size % 2 = 0")
def src_pipe_tables(spark, folder):
    p = table(spark, folder, "part")
    text = F.concat(F.lit("Other: <NEWLINE> | x | <NEWLINE> Parts: <NEWLINE> | | brand | <NEWLINE> | "), "p_name", F.lit(" | "), "p_brand", F.lit(" |"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" <NEWLINE> | "), "p_type", F.lit(" |"))).otherwise(""))
    return readers.pipe_tables(p.select("p_partkey", text.alias("t")), "p_partkey", "t", "parts").select("p_partkey", "row", F.col("cells")["Name"].alias("name"), F.col("cells")["brand"].alias("brand"))


@query("select 'Part \"' || p_partkey || '\", made by ' || p_brand as ref, p_name as eat_name, p_brand as brand, 3 - 2 * (p_size % 2) as n from part")
def src_meaning_pairs(spark, folder):
    p = table(spark, folder, "part")
    mr = F.concat(F.lit("eatName["), "p_name", F.lit("], brand["), "p_brand", F.lit("]"))
    ref = F.concat(F.lit('Part "'), "p_partkey", F.lit('", made by '), "p_brand")
    path = f"{folder_of(spark, 'meanings')}/csv"
    p.select(mr.alias("mr"), ref.alias("ref"), (3 - 2 * (F.col("p_size") % 2)).alias("n")).write.option("header", True).option("escape", '"').csv(path)
    n = spark.read.option("header", True).option("escape", '"').csv(path).select("ref", F.col("n").cast("int").alias("n"))
    return readers.meaning_pairs(spark, path).join(n, "ref").select("ref", F.col("cells")["eat name"].alias("eat_name"), F.col("cells")["brand"].alias("brand"), "n")


@query("select number, name, size, n from (select row_number() over (order by p_partkey) - 1 as number, p_name as name, p_size || '' as size, case when p_size % 3 = 0 then 2 else 3 end as n, p_size from part) where p_size % 7 <> 0")
def src_infobox_lines(spark, folder):
    p = table(spark, folder, "part")
    brand = F.when(F.col("p_size") % 3 == 0, "<none>").otherwise(F.col("p_brand"))
    value = F.when(F.col("p_size") % 7 == 0, "no object").otherwise(F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("size"), brand.alias("brand"))))
    got = readers.infobox_lines(spark, written(p.select("p_partkey", value.alias("value")), "infobox", "p_partkey"))
    return got.select("number", F.col("cells")["name"].alias("name"), F.col("cells")["size"].alias("size"), F.size("cells").alias("n"))


@query("select row_number() over (order by p_partkey) - 1 as number, p_name as name, p_brand as brand, 'A ' || p_type as text from part")
def src_marked_rows(spark, folder):
    value = F.concat(F.lit("name||"), "p_name", F.lit("||brand || "), "p_brand", F.lit("\tA "), "p_type")
    got = readers.marked_rows(spark, written(table(spark, folder, "part").select("p_partkey", value.alias("value")), "marked", "p_partkey"))
    return got.select("number", F.col("cells")["name"].alias("name"), F.col("cells")["brand"].alias("brand"), "text")


@query("select p_brand as key, arg_max(p_name, p_partkey) as value from part group by p_brand")
def src_dictionary_lines(spark, folder):
    p = table(spark, folder, "part")
    return readers.dictionary_lines(spark, written(p.select("p_partkey", F.to_json(F.create_map("p_brand", "p_name")).alias("value")), "dictionary", "p_partkey"))


def _dump(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a dump with an entity per supplier: its label, its type Q1, its nation as class and neighbour, and a deprecated claim."""
    s = table(spark, folder, "supplier")
    snak = lambda item, rank: f'{{"mainsnak":{{"datatype":"wikibase-item","datavalue":{{"type":"wikibase-entityid","value":{{"id":"{item}"}}}}}},"rank":"{rank}"}}'
    claims = F.concat(F.lit('{"P31":[' + snak("Q1", "normal") + "," + snak("Q9", "deprecated") + '],"P279":['), F.replace(F.lit(snak("Q5@", "preferred")), F.lit("@"), F.col("s_nationkey").cast("string")), F.lit("," + snak("Q77", "normal") + "]}"))
    aliases = F.concat(F.lit('{"en":[{"value":"the '), "s_name", F.lit('"}]}'))
    entity = F.concat(F.lit('{"id":"Q'), F.col("s_suppkey") + 1000, F.lit('","labels":{"en":{"value":"'), "s_name", F.lit('"}},"descriptions":{},"aliases":'), aliases, F.lit(',"claims":'), claims, F.lit("},"))
    return s.select("s_suppkey", entity.alias("value")).unionByName(spark.createDataFrame([(-1, "["), (1 << 60, "]"), (1 << 61, "{broken")], "s_suppkey long, value string"))


@query("select 'Q' || (s_suppkey + 1000) as wikidata_id, s_name as label, 'the ' || s_name as alias, 'Q1' as types, 'Q5' || s_nationkey as superclasses, 'P279=Q5' || s_nationkey || ',P31=Q1' as neighbors from supplier")
def src_dump(spark, folder):
    """Entities of a dump, of which the best claims count."""
    got = wikidata.shred_entities(readers.dump_lines(spark, written(_dump(spark, folder), "dump", "s_suppkey")), "entity")
    near = F.array_join(F.array_sort(F.transform("neighbors", lambda x: F.concat(x["p"], F.lit("="), x["o"]))), ",")
    return got.select("wikidata_id", "label", F.get("aliases", F.lit(0)).alias("alias"), F.array_join("types", ",").alias("types"), F.array_join("superclasses", ",").alias("superclasses"), near.alias("neighbors"))


@query("select 'Q' || (s_suppkey + 1000) as wikidata_id, 'P279' as property, n_name as text from supplier join nation on n_nationkey = s_nationkey union all select 'Q' || (s_suppkey + 1000), 'P31', 'Q1' from supplier")
def src_claims(spark, folder):
    """The values of the best claims as words, by labels of the items that have one."""
    p = wikidata.properties(readers.dump_lines(spark, written(_dump(spark, folder), "dump", "s_suppkey")), "entity")
    labels = table(spark, folder, "nation").select(F.concat(F.lit("Q5"), "n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return wikidata.value_text(p, labels).select("wikidata_id", "property", "text")


@query("select 'n/' || n_name || '.txt' as member, n_name || ' ' || n_nationkey as text from nation")
def src_zip(spark, folder):
    where, whole = folder_of(spark, "archives"), io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("n/", "")
        for r in nations(spark, folder):
            z.writestr(f"n/{r['n_name']}.txt", f"{r['n_name']} {r['n_nationkey']}")
    put(spark, f"{where}/all.zip", whole.getvalue())
    return readers.zip_members(spark, where).select("member", "text")


@query("select n_name as report_number, 'airport' as attribute, cast(i as int) as pos, n_name || ' field' as normed, case i when 0 then 3 else 3 + length(n_name) + 6 + 5 end as start from nation, (values (0), (1)) t(i)")
def src_annotated(spark, folder):
    """Mention labels of annotated documents; the longest mention stands for both."""
    where = folder_of(spark, "annotated")
    for r in nations(spark, folder):
        n = r["n_name"]
        text = f"At {n} field and {n} too."
        mentions = f'{{"airport": [{{"mention": "{n} field", "start": 3, "length": {len(n) + 6}}}, {{"mention": "{n}", "start": {3 + len(n) + 11}, "length": {len(n)}}}]}}'
        put(spark, f"{where}/{n}.json", f'{{"text": "{text}",\n "report_number": "{n}", "mentions": {mentions}}}'.encode())
    docs = readers.annotated_documents(spark, where)
    return readers.mention_labels(docs, "report_number").select("report_number", "attribute", "pos", "normed", "start")


@query("select i as line, 'Name' || (i % 7) as name, 'ill' || ((i * 3) % 5) as diagnosis, 'fault' || ((i * 5) % 3) as computer from (select row_number() over () - 1 as i from customer)")
def src_diagnoses(spark, folder):
    """Made lines read back: the labels of every line, by their places in documents of two lines."""
    n = table(spark, folder, "customer").count()
    lines = readers.made_diagnoses(spark, n, [f"Name{i}" for i in range(7)], [f"ill{i}" for i in range(5)], [f"fault{i}" for i in range(3)])
    docs, labels = readers.diagnosis_documents(lines, "number", "line")
    each = labels.join(docs, "doc").select("doc", "attribute", F.expr("substring(text, start + 1, end - start)").alias("v"), F.size(F.split(F.expr("substring(text, 1, start)"), r"(?:^|\. )[0-9]+\. ")).alias("nth"))
    wide = each.groupBy("doc", "nth").pivot("attribute", ["name", "diagnosis", "computer"]).agg(F.first("v"))
    return wide.select((F.col("doc") * 2 + F.col("nth") - 2).alias("line"), "name", "diagnosis", "computer")


@query("select o_orderkey as game, 'home' as player, cast(round(o_totalprice) as bigint) || '' as pts, null as reb from orders union all select o_orderkey, 'away', null, 'x' from orders where o_orderstatus = 'F'")
def src_boxscores(spark, folder):
    o = table(spark, folder, "orders")
    scores = F.create_map(F.lit("pts"), F.create_map(F.lit("home"), F.round("o_totalprice").cast("long").cast("string"), F.lit("away"), F.lit("N/A")), F.lit("reb"), F.create_map(F.lit("home"), F.lit(""), F.lit("away"), F.when(F.col("o_orderstatus") == "F", "x").otherwise("N/A")))
    got = cs.boxscore_tables(o.select(F.col("o_orderkey").alias("game"), scores.alias("s")), "game", "s")
    return got.select("game", "player", F.try_element_at("cells", F.lit("pts")).alias("pts"), F.try_element_at("cells", F.lit("reb")).alias("reb"))


@query("select n_nationkey, case when n_nationkey = 3 then 'X' when n_nationkey = 4 then 'new' else n_name end as name from nation where n_regionkey <> 2 union all select 99, 'late'")
def store_tables(spark, folder):
    """A table set, changed, thinned and read through a store."""
    store = sinks.Store(spark, folder_of(spark, "store"))
    n = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_name").alias("name"), "n_regionkey")
    store.set("db/nation", n)
    changes = spark.createDataFrame([(4, "old", 1), (4, "new", 2), (99, "late", 1), (3, "X", 1)], "n_nationkey long, name string, at int")
    store.upsert("db/nation", changes.join(n.select("n_nationkey", "n_regionkey"), "n_nationkey", "left"), ["n_nationkey"], [F.col("at").desc()])
    store.delete_many("db/nation", F.col("n_regionkey") == 2)
    assert store.keys("db") == ["db/nation"] and store.find_one("db/nation", "n_nationkey = 99")["name"] == "late"
    return store.find("db/nation", columns=["n_nationkey", "name"])


@query("select distinct p_brand from part")
def store_distinct(spark, folder):
    store = sinks.Store(spark, folder_of(spark, "store"))
    return store.distinct(*(store.set("part", table(spark, folder, "part")) or ("part", "p_brand")))


@query("select p_brand, count(*) as n, 2 as times from part group by p_brand")
def store_cached(spark, folder):
    """A result kept under its request: asked for twice, made once."""
    store, made = sinks.Store(spark, folder_of(spark, "cache")), []

    def make() -> DataFrame:
        made.append(1)
        return table(spark, folder, "part").groupBy("p_brand").agg(F.count("*").alias("n"))

    got = [store.cached(("brands", folder), make) for _ in range(2)]
    return got[1].withColumn("times", F.lit(3 - len(made)))


@query("select p_partkey, p_name, n from part, (values (1), (2)) t(n)")
def sink_append(spark, folder):
    path = f"{folder_of(spark, 'append')}/t"
    for i in (1, 2):
        sinks.append_checked(table(spark, folder, "part").select("p_partkey", "p_name", F.lit(i).alias("n")), path)
    return spark.read.parquet(path)


@query("select p_partkey, p_name, p_retailprice from part")
def sink_json_csv(spark, folder):
    """A table by JSON lines and on by CSV."""
    where = folder_of(spark, "formats")
    sinks.write_json({"part": table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")}, where, "train")
    sinks.write_csv(spark.read.schema("p_partkey long, p_name string, p_retailprice double").json(f"{where}/train/part"), f"{where}/csv")
    return spark.read.option("header", True).schema("p_partkey long, p_name string, p_retailprice double").csv(f"{where}/csv")


@query("select 'system' as r1, p_brand as user, p_name as assistant from part where p_size % 5 > 0")
def sink_chat(spark, folder):
    path = f"{folder_of(spark, 'chat')}/t"
    p = table(spark, folder, "part").select(F.when(F.col("p_size") % 5 > 0, F.col("p_brand")).alias("u"), "p_name")
    sinks.write_chat(p, "u", "p_name", path, "be brief")
    m = F.from_json("value", "struct<messages:array<struct<role:string,content:string>>>")["messages"]
    return spark.read.text(path).select(m[0]["role"].alias("r1"), m[1]["content"].alias("user"), m[2]["content"].alias("assistant"))


@query("select p_brand, count(*) as n, max(p_retailprice) as top from part where p_size > 10 group by p_brand")
def steps_run(spark, folder):
    """Named steps, each from the outputs of those before."""
    steps = sinks.Steps(sinks.Store(spark, folder_of(spark, "steps")))
    steps.add("base", lambda: table(spark, folder, "part"))
    steps.add("large", lambda base: base.where("p_size > 10"), ("base",))
    steps.add("brands", lambda large: large.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("top")), ("large",))
    steps.run()
    assert steps.run() == []
    return steps.store.get("brands")


@query("""select p_partkey, round(p_size % 8 + (p_size % 12) / 12.0, 2) as feet, make_date(1950 + p_size, p_size % 12 + 1, p_size % 28 + 1) as born, 'guard|forward' as places, 1 + p_size % 3 as n_years from part""")
def src_infobox_fields(spark, folder):
    """Heights, dates of birth, positions and years out of template fields."""
    p = table(spark, folder, "part")
    size = F.col("p_size")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    height = F.when(size % 2 == 0, text("", size % 8, " ft ", size % 12, " in")).otherwise(text("{{height|ft=", size % 8, "|in=", size % 12, "}}"))
    born = text("{{birth date and age|", size + 1950, "|", size % 12 + 1, "|", size % 28 + 1, "}}")
    span = F.when(size % 3 == 0, text("", size + 1950)).otherwise(text("", size + 1950, "–", size + 1950 + size % 3))
    places = readers.positions(F.lit("[[Point guard|guard]] / [[forward]]"))
    return p.select("p_partkey", readers.height_feet(height).alias("feet"), readers.birth_date(born).alias("born"), F.array_join(places, "|").alias("places"), F.size(readers.years(span, 2020)).alias("n_years"))


@query("select 'l_orderkey' as key, true as multi_row, 'l_linenumber' as identifying")
def src_infer_view(spark, folder):
    """Lines of an order are told apart by their number alone."""
    multi, name = readers.infer_view(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey")
    return spark.createDataFrame([("l_orderkey", multi, name)], "key string, multi_row boolean, identifying string")


@query("select -n_nationkey - 1 as n_nationkey, n_name from nation union all select n_nationkey, n_name from nation")
def src_negated(spark, folder):
    """Two databases in one, the ids of the first negative."""
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return readers.negated(n, "n_nationkey").unionByName(n)


@query("select h.number, h.text from (select row_number() over (order by p_partkey) - 1 as number, p_name as text from part) h")
def src_hypotheses(spark, folder):
    p = table(spark, folder, "part")
    value = F.explode(F.array(F.concat(F.lit("S-"), "p_partkey", F.lit("\tx")), F.concat(F.lit("H-"), "p_partkey", F.lit("\t-0.5\t"), "p_name")))
    lines = readers.lines(spark, written(p.select("p_partkey", value.alias("value")), "hypotheses", "p_partkey", "value"))
    first = table(spark, folder, "part").agg(F.min("p_partkey").alias("m")).first()["m"]
    return cs.hypothesis_lines(lines, "line").select((F.col("number") - first).alias("number"), "text")


def _put_json(spark: SparkSession, path: str, rows: list[dict]) -> None:
    put(spark, path, json.dumps(rows).encode())


def _games(spark: SparkSession, folder: str) -> str:
    """A database of a game per nation: a player with points and rebounds, and the region as the team."""
    where = folder_of(spark, "games")
    teams = {r["r_regionkey"]: r["r_name"] for r in table(spark, folder, "region").collect()}
    frames: dict[str, list] = {n: [] for n in ("player_labels", "team_labels", "player_alignments", "team_alignments", "player_evidence", "team_evidence", "player_to_reports", "team_to_reports", "reports_table")}
    for r in sorted(nations(spark, folder)):
        game, player, team = r["n_nationkey"], r["n_name"].title(), teams[r["n_regionkey"]]
        text = f"{player} had {game + 3} points, {game} rebounds. {team} won {game + 90} to 80."
        at = lambda s, after=0: [text.index(s, after), text.index(s, after) + len(s)]
        points, reb = at(f"{game + 3} points")[0], at(f"{game} rebounds")[0]
        frames["player_labels"].append({"Game ID": game, "Player Name": player, "Points": f"{game + 3}", "Rebounds": f"{game}" if game else ""})
        frames["player_alignments"].append({"Game ID": game, "Player Name": player, "Name_Matched": at(player), "Points": [[points, points + len(str(game + 3))]], "Rebounds": [[reb, reb + len(str(game))]]})
        frames["team_labels"].append({"Game ID": game, "Team Name": team, "Wins": f"{game + 90}"})
        frames["team_alignments"].append({"Game ID": game, "Team Name": team, "Name_Matched": at(team), "Wins": [at(f"{game + 90} to")[0], at(f"{game + 90} to")[0] + len(str(game + 90))]})
        frames["player_evidence"].append({"Player Name": player, "born": 1950 + game})
        frames["player_to_reports"].append({"Player Name": player, "Game ID": game})
        frames["team_to_reports"].append({"Team Name": team, "Game ID": game})
        frames["reports_table"].append({"Game ID": game, "Report": text})
    frames["team_evidence"] = [{"Team Name": t, "name": t.lower(), "key": k} for k, t in teams.items()]
    for split in ("train", "test"):
        for n, rows in frames.items():
            _put_json(spark, f"{where}/{split}/{n}.json", rows)
    return where


@query("""select n_nationkey as game, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(n_name, ' ')], ' ') as name, (n_nationkey + 3) || '' as points, case when n_nationkey > 0 then n_nationkey || '' else '' end as rebounds from nation""")
def db_players(spark, folder):
    """The latent table of players of a loaded database, by its labels."""
    got = TextScan("reports.Player").run(databases.games_database(spark, _games(spark, folder), "test"))
    return got.select(F.col("Game ID").alias("game"), "name", cell_text(F.col("Points")).alias("points"), cell_text(F.col("Rebounds")).alias("rebounds"))


@query("""select n_nationkey - (select max(n_nationkey) from nation) - 1 as game, lower(r_name) as name, (n_nationkey + 90) || '' as wins, r_regionkey as key from nation join region on r_regionkey = n_regionkey""")
def db_team_stats(spark, folder):
    """Statistics of the training split with the evidence of the teams, under their short names."""
    c = databases.games_database(spark, _games(spark, folder), "test")
    got = databases.join_evidence(c.get("team_stats").df, [(c.get("team_info").df, "name")])
    return got.select(F.col("Game ID").alias("game"), "name", F.col("Wins").alias("wins"), "key")


@query("""select n_nationkey as index, 'Politics' as tab, n_name as name, (1800 + n_nationkey) || '' as fact from nation union all select n_nationkey, 'Geography', n_name, 'R' || n_regionkey from nation""")
def db_facts(spark, folder):
    """Two latent tables of one collection whose reports agree, and an error where they don't."""
    where = folder_of(spark, "facts")
    for name, column in (("countries-Politics", "founded"), ("countries-Geography", "region")):
        labels, normed, places, reports = [], [], [], []
        for r in sorted(nations(spark, folder)):
            n, country = r["n_nationkey"], r["n_name"]
            text, value = f"{country} of {1800 + n} lies in R{r['n_regionkey']}.", f"{1800 + n}" if column == "founded" else f"R{r['n_regionkey']}"
            labels.append({"index": n, "name": country, column: value})
            normed.append({"index": n, "name": country, column: value})
            places.append({"index": n, "name": [[0, len(country)]], column: [[text.rindex(value), text.rindex(value) + len(value)]]})
            reports.append({"index": n, "text": text})
        for split in ("train", "test", "bad"):
            some = [*reports[:-1], {"index": -1, "text": "another"}] if split == "bad" and column == "region" else reports
            for part, rows in (("labels", labels), ("normed", normed), ("alignment", places), ("reports", some)):
                _put_json(spark, f"{where}/{split}/{name}-{part}.json", rows)
    names = ["countries-Politics", "countries-Geography"]
    try:
        databases.facts_database(spark, where, "bad", names)
        raise AssertionError("differing reports were taken")
    except ValueError:
        pass
    c = databases.facts_database(spark, where, "test", names)
    parts = [TextScan(f"countries_reports.{t}").run(c).select(F.col("index").cast("long").alias("index"), F.lit(t).alias("tab"), F.upper(cell_text(F.col("name"))).alias("name"), F.upper(cell_text(F.col(a))).alias("fact")) for t, a in (("Politics", "founded"), ("Geography", "region"))]
    return databases.union_evidence(parts)


@query("""select p_partkey, cast(y as int) as year, case when y < 1952 + p_size then 'Hawks' else 'Bulls' end as team from part, unnest(range(1950 + p_size, 1954 + p_size)) t(y)""")
def src_teams_by_year(spark, folder):
    """Teams of each year out of numbered fields."""
    size = F.col("p_size").cast("int")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    fields = F.create_map(F.lit("team1"), F.lit("[[Atlanta|x]]"), F.lit("coach_team1"), F.lit("→[[Hawks|Atlanta Hawks]]"), F.lit("coach_team2"), F.lit("Bulls"), F.lit("years1"), text("", size + 1950, "–", size + 1951), F.lit("years2"), text("{{nbay|", size + 1952, "–", size + 1953, "}}"), F.lit("coach_team3"), F.lit("None"))
    p = table(spark, folder, "part")
    return p.select("p_partkey", F.explode(readers.teams_by_year(fields, 2020)).alias("x")).select("p_partkey", "x.year", "x.team")
