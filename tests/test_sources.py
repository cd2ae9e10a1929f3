import bz2
import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomtext.operators.nesting import dependent, group_into_tables, nest_lookup, upsert
from loomtext.operators.wikidata import class_rows, properties, shred_entities, value_text
from loomtext.sources import readers, sinks
from loomtext.sources.sinks import Steps, Store


def put(folder, **files):
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def test_text_files_and_pairs(spark, tmp_path):
    where = put(tmp_path, a__txt="x\ny", b__txt="", c__md="no")
    assert sorted(tuple(r) for r in readers.text_files(spark, where).collect()) == [("a", "x\ny")]
    put(tmp_path, p__data="1\n2\n3\n", p__text="one\ntwo\n")
    assert sorted(tuple(r) for r in readers.paired_lines(spark, f"{where}/p.data", f"{where}/p.text").collect()) == [(0, "1", "one"), (1, "2", "two")]


def test_annotated_documents(spark, tmp_path):
    one = {"text": "He flew a jet, a big jet", "report_number": "7", "mentions": {"craft": [{"mention": "jet", "start": 10, "length": 3}, {"mention": "big jet", "start": 17, "length": 7}], "city": []}}
    where = put(tmp_path, a__json=json.dumps(one, indent=1), b__json=json.dumps({"text": "t", "id": 8}))
    docs = readers.annotated_documents(spark, where, ["a"])
    assert {(r["report_number"], r["is_test"]) for r in docs.collect()} == {("7", True), ("8", False)}
    assert readers.annotated_documents(spark, where, ["a"], test=False).count() == 1
    labels = readers.mention_labels(docs, "report_number").collect()
    assert [(r["normed"], r["start"], r["end"]) for r in labels] == [("big jet", 10, 13), ("big jet", 17, 24)]
    ev = {r["report_number"]: (r["craft"], r["city"]) for r in readers.mention_evidence(docs, "report_number", ["craft", "city"]).collect()}
    assert ev == {"7": ("big jet", ""), "8": ("", "")}


def test_delimited(spark, tmp_path):
    where = put(tmp_path, e__csv='mr,ref\n"name[A B], eatType[pub]",A B is a pub\n', i__jsonl='{"a": "1", "b": "<none>"}\nbad\n{"a": "2"}\n', w__tsv="k || v||x||y\thello\nnone\n")
    assert readers.meaning_pairs(spark, f"{where}/e.csv").first()["cells"] == {"name": "A B", "eat type": "pub"}
    assert [(r["number"], r["cells"]) for r in readers.infobox_lines(spark, f"{where}/i.jsonl").orderBy("number").collect()] == [(0, {"a": "1"}), (2, {"a": "2"})]
    assert [(r["cells"], r["text"]) for r in readers.marked_rows(spark, f"{where}/w.tsv").collect()] == [({"k": "v", "x": "y"}, "hello")]
    assert {r["key"]: r["value"] for r in readers.dictionary_lines(spark, f"{where}/i.jsonl").collect()} == {"a": "2", "b": "<none>"}


def test_pipe_tables(spark):
    df = spark.createDataFrame([(1, "Team: <NEWLINE> | | Pts | <NEWLINE> | Hawks | 9 | <NEWLINE> Player: <NEWLINE> | | Ast | <NEWLINE> | Ann |"), (2, None)], "id int, t string")
    assert [tuple(r) for r in readers.pipe_tables(df, "id", "t", "Team").collect()] == [(1, 0, {"Name": "Hawks", "Pts": "9"})]
    assert readers.pipe_tables(df, "id", "t", "player").first()["cells"] == {"Name": "Ann", "Ast": ""}


def snak(kind, value):
    return {"mainsnak": {"datatype": kind, "datavalue": {"type": kind, "value": value}}, "rank": "normal"}


ENTITY = {
    "id": "Q1", "type": "item", "labels": {"en": {"value": "one"}}, "descriptions": {"en": {"value": "d"}}, "aliases": {"en": [{"value": "uno"}]},
    "claims": {
        "P31": [{"mainsnak": {"datatype": "wikibase-item", "datavalue": {"type": "wikibase-entityid", "value": {"id": "Q5"}}}, "rank": "normal"}],
        "P279": [{"mainsnak": {"datatype": "wikibase-item", "datavalue": {"type": "wikibase-entityid", "value": {"id": "Q6"}}}, "rank": "preferred"}, {"mainsnak": {"datatype": "wikibase-item", "datavalue": {"type": "wikibase-entityid", "value": {"id": "Q7"}}}, "rank": "normal"}, {"mainsnak": {"datatype": "wikibase-item"}, "rank": "preferred"}],
        "P9": [snak("time", {"time": "+1990-00-00T00:00:00Z"}) | {"qualifiers": {"P8": [{"datatype": "string", "datavalue": {"type": "string", "value": "q"}}]}}], "P10": [snak("quantity", {"amount": "+5", "unit": "http://x/Q11"})], "P11": [snak("string", "s")],
        "P12": [snak("monolingualtext", {"text": "hallo", "language": "de"})], "P13": [snak("globecoordinate", {"longitude": 1.5, "latitude": 2})],
    },
}


def test_dump_and_entities(spark, tmp_path):
    (tmp_path / "d.json.bz2").write_bytes(bz2.compress(("[\n" + json.dumps(ENTITY) + ",\n{bad\n]\n").encode()))
    dump = readers.dump_lines(spark, str(tmp_path / "d.json.bz2"))
    assert dump.count() == 1
    e = shred_entities(dump, "entity")
    r = e.first()
    assert (r["wikidata_id"], r["label"], r["aliases"], r["types"], r["superclasses"]) == ("Q1", "one", ["uno"], ["Q5"], ["Q6"])
    assert {(n["p"], n["o"]) for n in r["neighbors"]} == {("P31", "Q5"), ("P279", "Q6")}
    labels = spark.createDataFrame([("Q5", "five"), ("Q11", "metre")], "id string, label string")
    p = properties(dump, "entity")
    shown = {r["property"]: r["text"] for r in value_text(p, labels, "default").collect()}
    assert shown == {"P31": "five", "P279": "Q6", "P9": "1990", "P10": "+5metre", "P11": "s", "P12": "", "P13": "1.5, 2"}
    uri = {r["property"]: r["text"] for r in value_text(p, labels, "uri").collect()}
    assert uri["P31"] == "http://www.wikidata.org/entity/Q5" and uri["P10"] is None and uri["P9"].startswith("+1990-00-00T00:00:00Z^^")
    assert [r["qualifiers"] for r in p.where("property = 'P9'").collect()] == [{"P8": ["q"]}]
    assert sorted(tuple(x) for x in class_rows(e).collect()) == [("Q1", "Q6")]


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/x.json", "{}")
        z.writestr("b.json", "[1]")
    assert sorted((r["member"], r["text"]) for r in readers.zip_members(spark, str(tmp_path)).collect()) == [("a/x.json", "{}"), ("b.json", "[1]")]


def test_diagnoses(spark):
    made = readers.made_diagnoses(spark, 5, ["Ann Lee", "Bo"], ["flu", "a cold"], ["a worm", "lag"])
    docs, labels = readers.diagnosis_documents(made, "number", "line")
    texts = {r["doc"]: r["text"] for r in docs.collect()}
    assert len(texts) == 3
    got = labels.collect()
    assert len(got) == 15 and all(texts[r["doc"]][r["start"] : r["end"]] == r["normed"] for r in got)


def test_infobox_fields(spark):
    row = spark.range(1).select(
        readers.height_feet(F.lit("6 ft 6 in")).alias("a"), readers.height_feet(F.lit("|ft=6|in=9")).alias("b"), readers.height_feet(F.lit("tall")).alias("c"),
        readers.birth_date(F.lit("{{birth date and age|1984|12|30}}")).alias("d"), readers.birth_date(F.lit("?")).alias("e"),
        readers.without_links(F.lit("[[A B|shown]] and [[C]]")).alias("f"), readers.positions(F.lit("[[Guard]] / [[X|Forward]]")).alias("g"), readers.years(F.lit("2012–2014"), 2016).alias("h"), readers.years(F.lit("2015–present"), 2016).alias("i"), readers.years(F.lit("?"), 2016).alias("j"),
    ).first()
    assert tuple(row) == (6.5, 6.75, None, datetime.date(1984, 12, 30), None, "shown and C", ["Guard", "Forward"], [2012, 2013, 2014], [2015, 2016], [])


def test_infer_view(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "c", "y")], "doc int, name string, team string")
    assert readers.infer_view(df, "doc") == (True, "name")
    assert readers.infer_view(df.where("doc = 2"), "doc") == (False, None)


def test_store_and_steps(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    steps, ran = Steps(store), []
    steps.add("base", lambda: ran.append("base") or spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    steps.add("split/next", lambda base: ran.append("next") or base.where("k = 1"), ("base",))
    assert steps.run() == ["base", "split/next"] and steps.run() == [] and ran == ["base", "next"]
    assert store.keys() == ["base", "split/next"] and store.get("split/next").count() == 1
    change = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, at int")
    store.upsert("base", change, ["k"], [F.col("at").desc()])
    assert {(r["k"], r["v"]) for r in store.get("base").collect()} == {(1, "a"), (2, "y"), (3, "z")}
    made = []
    for _ in range(2):
        assert store.cached(("q", 1), lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "q", "a"), (2, None, "b")], "id int, u string, s string")
    sinks.write_json({"t": df}, str(tmp_path / "db"), "train")
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.write_chat(df, "u", "s", str(tmp_path / "chat"), "be brief")
    assert spark.read.json(str(tmp_path / "db/train/t")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    line = json.loads(spark.read.text(str(tmp_path / "chat")).first()[0])
    assert [m["role"] for m in line["messages"]] == ["system", "user", "assistant"]
    sinks.append_checked(df, str(tmp_path / "p"))
    sinks.append_checked(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    with pytest.raises(ValueError):
        sinks.append_checked(df.select("id"), str(tmp_path / "p"))


def test_nesting(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "f int, v string")
    assert {r["k"]: [v["v"] for v in r["vs"]] for r in nest_lookup(a, b, "k", "f", ["v"], "vs").collect()} == {1: ["x", "y"], 2: [], None: []}
    base, ch = spark.createDataFrame([(1, "a", 0)], "k int, v string, at int"), spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], "k int, v string, at int")
    assert {(r["k"], r["v"]) for r in upsert(base, ch, ["k"], [F.col("at").desc()]).collect()} == {(1, "c"), (2, "d")}
    q = spark.createDataFrame([("d", "A", "S"), ("d", "B", "A"), ("d", "A2", "B"), ("e", "X", "Y"), ("e", "Y", "X")], "g string, k string, r string")
    assert {tuple(r) for r in dependent(q, "g", "k", "r").collect()} == {("d", "A", "B"), ("d", "B", "A2")}


def test_grouping(spark):
    rows = [(i, ["common"] + (["rare"] if i < 8 else []), ["s"], [f"n{i % 2}"]) for i in range(70)] + [(100, [], [], []), (101, None, None, None)]
    df = spark.createDataFrame(rows, "id int, types array<string>, sup array<string>, nb array<string>")
    got = {r["id"]: r["table"] for r in group_into_tables(df, "id", ["types", "sup"], "nb").collect()}
    assert len(got) == 72 and got[0] == "rare" and got[20] in ("common/n0", "common/n1")


def test_lines_of_several_blocks(spark, tmp_path):
    want = [f"line {i} " + "x" * (i % 50) for i in range(20000)]
    (tmp_path / "l.txt").write_text("\n".join(want) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = readers.lines(spark, str(tmp_path / "l.txt"))
        assert got.rdd.getNumPartitions() > 1
        assert [r["line"] for r in got.orderBy("number").collect()] == want and got.agg(F.max("number")).first()[0] == 19999
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_store_finds_and_thins(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.set("a/t", spark.createDataFrame([(1, "x"), (2, None), (3, "x")], "k int, v string"))
    assert store.find("a/t", "k > 1", ["k"]).count() == 2 and store.find_one("a/t", "k = 2") == {"k": 2, "v": None} and store.find_one("a/t", "k = 9") is None
    assert [r[0] for r in store.distinct("a/t", "v").collect()] == ["x"] and list(store.all()) == ["a/t"]
    store.delete_many("a/t", F.col("v") == "x")
    assert [r["k"] for r in store.get("a/t").collect()] == [2]
    # a version that isn't complete doesn't count
    (tmp_path / "a/t/v9").mkdir()
    assert store.get("a/t").count() == 1
    store.drop("a/t")
    assert store.keys() == []
    with pytest.raises(KeyError):
        store.get("a/t")


def test_scratch_is_removed(spark):
    import os

    from loomtext.workspace import Workspace, scratch

    with scratch(spark):
        work = Workspace(spark, "t")
        work.keep(spark.range(3))
        assert os.path.isdir(work.root.replace("file:", ""))
    assert not os.path.isdir(work.root.replace("file:", ""))
