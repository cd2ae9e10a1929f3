import pytest
from pyspark.sql import functions as F

from loomtext.functions.cells import cell_text, merge_cells
from loomtext.operators.extractors import CallableExtractor, CompletionExtractor, LabelExtractor, LexiconExtractor, PatternExtractor, TableTextExtractor
from loomtext.plans.catalog import Catalog, Table, TextCollection
from loomtext.plans.nodes import Join, Project, Select, TextAggregate, TextJoin, TextScan, TextSelect, TextUnion, value_index

DOCS = [(1, "Ann met Bob in Rome. Rome is old."), (2, "Bob saw Oslo"), (3, None), (4, ""), (5, "Ann and Ann")]


@pytest.fixture(scope="module")
def catalog(spark):
    c = Catalog(spark)
    docs = c.collection("docs", spark.createDataFrame(DOCS, "id long, text string"), "id")
    docs.view("people", ["person", "city"], PatternExtractor({"person": ("Ann|Bob", 0), "city": ("Rome|Oslo", 0)}))
    docs.view("facts", ["kind", "value"], PatternExtractor(kinds={"person": ("Ann|Bob", 0), "city": ("Rome|Oslo", 0)}), identifying="kind")
    labels = [(1, None, "person", 0, "Anna", 0, 3), (1, None, "person", 1, "Bob", 8, 11), (1, None, "person", 2, "Anna", 15, 19), (2, None, "person", 0, "BOB", 0, 3), (5, "x", "note", 0, "n", 0, 3), (5, "y", "note", 0, "m", 8, 11)]
    frame = spark.createDataFrame(labels, "id long, row_key string, attribute string, pos int, normed string, start int, end int")
    docs.view("truth", ["person"], LabelExtractor(frame, "id"))
    docs.view("notes", ["who", "note"], LabelExtractor(frame, "id"), identifying="who")
    c.table("t", spark.createDataFrame([(1, "a", "Bonn"), (1, "b", None), (2, "c", ""), (9, "d", "x")], "id long, tag string, city string"), ["id"])
    c.table("asked", spark.createDataFrame([(1, "city"), (2, "person"), (5, "city"), (9, "city")], "id long, kind string"), ["id"])
    c.table("link", spark.createDataFrame([(1, 7, "z"), (2, 8, "w")], "id long, other long, tag string"), ["id", "other"])
    return c


def rows(df):
    shown = df.select(*[cell_text(F.col(c)).alias(c) if t.startswith("array<struct<normed") else F.col(c) for c, t in df.dtypes])
    return sorted((tuple(r) for r in shown.collect()), key=repr)


def test_scan(catalog):
    assert rows(TextScan("docs.people").run(catalog)) == [(1, "Ann, Bob", "Rome"), (2, "Bob", "Oslo"), (3, "", ""), (4, "", ""), (5, "Ann", "")]
    assert TextScan("docs.people", ("city", "person")).run(catalog).columns == ["id", "city", "person"]
    assert [r[0] for r in rows(TextScan("docs.people", limit=2).run(catalog))] == [1, 2]
    assert rows(TextScan("docs.facts").run(catalog)) == [(1, "city", "Rome"), (1, "person", "Ann, Bob"), (2, "city", "Oslo"), (2, "person", "Bob"), (5, "person", "Ann")]
    with pytest.raises(ValueError):
        TextScan("docs.people", ("height",)).run(catalog)


def test_unused_attributes_are_not_extracted(catalog):
    plan = TextScan("docs.people", ("city",)).run(catalog)._jdf.queryExecution().optimizedPlan().toString()
    assert "Rome|Oslo" in plan and "Ann|Bob" not in plan


def test_join(catalog):
    # the table has `city` itself, so only `person` is extracted
    got = TextJoin("t", "docs.people", "id").run(catalog)
    assert got.columns == ["id", "tag", "city", "person"]
    assert rows(got) == [(1, "a", "Bonn", "Ann, Bob"), (1, "b", None, "Ann, Bob"), (2, "c", "", "Bob")]
    assert rows(TextJoin("asked", "docs.facts", "id").run(catalog)) == [(1, "city", "Rome"), (2, "person", "Bob"), (5, "city", "")]
    assert rows(TextJoin("t", "docs.people", "id", ("tag",)).run(catalog)) == [(1, "a"), (1, "b"), (2, "c")]


def test_union(catalog):
    got = TextUnion("t", "docs.people").run(catalog)
    assert rows(got)[:3] == [(1, "a", "Bonn"), (1, "b", ""), (1, None, "Rome")]
    assert got.count() == 4 + 5
    assert TextUnion("t", "docs.people", extracted_only=True).run(catalog).columns == ["id", "city"]


@pytest.mark.parametrize("indexed", [False, True])
def test_select(catalog, indexed):
    assert [r[0] for r in rows(TextScan(TextSelect("docs.people", "person", 0.6, indexed=indexed)).run(catalog))] == [1, 5]
    assert [r[0] for r in rows(TextScan(TextSelect("docs.people", "person", constant="bob", indexed=indexed), ("city",)).run(catalog))] == [1, 2]
    assert rows(TextScan(TextSelect("docs.facts", "kind", constant="city", indexed=indexed)).run(catalog)) == [(1, "city", "Rome"), (2, "city", "Oslo")]
    assert TextScan(TextSelect("docs.people", "person", constant="Zoe", indexed=indexed)).run(catalog).count() == 0


def test_synonyms_by_index(catalog):
    assert [r[0] for r in rows(TextScan(TextSelect("docs.truth", "person", constant="anna", indexed=True)).run(catalog))] == [1]
    index = value_index(catalog.get("docs.truth"), "person")
    assert {(r["normed"], r["spelling"]) for r in index.collect()} == {("anna", "anna"), ("anna", "ann"), ("anna", DOCS[0][1][15:19].lower()), ("bob", "bob")}


def test_more_spellings_than_a_list_would_hold(spark):
    n = 1200
    c = Catalog(spark)
    docs = c.collection("d", spark.createDataFrame([(i, f"s{i:04d} other") for i in range(n)], "id long, text string"), "id")
    labels = [(i, str(r), "who", 0, "zed" if r == 0 else "other", 0 if r == 0 else 6, 5 if r == 0 else 11) for i in range(n) for r in range(2)]
    frame = spark.createDataFrame(labels, "id long, row_key string, attribute string, pos int, normed string, start int, end int")
    docs.view("many", ["row", "who"], LabelExtractor(frame, "id"), identifying="row")
    ways = [TextScan(TextSelect("d.many", "who", constant="zed", indexed=i)).run(c) for i in (False, True)]
    assert [w.columns for w in ways] == [["id", "row", "who"]] * 2
    got = [sorted((r["id"], r["row"]) for r in w.collect()) for w in ways]
    assert got[0] == got[1] == [(i, "0") for i in range(n)]


def test_oracle(catalog):
    cells = {r["id"]: r["person"] for r in TextScan("docs.truth").run(catalog).collect()}
    assert [(v["normed"], v["alts"]) for v in cells[1]] == [("anna", ["anna", "ann", DOCS[0][1][15:19].lower()]), ("bob", ["bob"])]
    assert cells[3] == [] and [v["normed"] for v in cells[2]] == ["bob"]
    assert rows(TextScan("docs.notes").run(catalog)) == [(5, "x", "n"), (5, "y", "m")]


def test_aggregate(catalog):
    got = {r["person"]: r for r in TextAggregate(TextScan("docs.people"), "person").run(catalog).collect()}
    # document 1 has two values and goes with the last
    assert {k: r["id"] for k, r in got.items()} == {"Bob": [1, 2], "Ann": [5]}
    assert [v["normed"] for v in got["Bob"]["city"]] == ["Rome", "Oslo"]


def test_relational(catalog, spark):
    got = Join("t", "link", "id").run(catalog)
    assert got.columns == ["id", "other", "tag_x", "tag_y", "city"] and got.count() == 3
    assert Project("link", ("tag",)).run(catalog).columns == ["id", "other", "tag"]
    # the key 1 occurs twice among the first two keys, each time with its two rows
    assert rows(Select("t", 0.5).run(catalog)) == sorted([(1, "a", "Bonn"), (1, "b", None)] * 2, key=repr)
    assert Select("t", 0.0).run(catalog).count() == 2
    assert TextJoin(Select("link", 0.5), "docs.people", "id").run(catalog).count() == 1


def test_names(catalog):
    plan = TextAggregate(TextScan(TextSelect("docs.people", "city", 0.1), ("a", "b", "c", "d", "e")), "person")
    assert plan.name() == "G person (π a, b, c, d… (scan(σ city (docs.people))))"
    assert r"\bowtie" in TextJoin("t", "docs.people", "id").latex()


def test_other_extractors(spark):
    c = Catalog(spark)
    text = "Sure:\nName;Age\nAnn; 31.0; x\nBob\nAnn;40\nEve;"
    table = "Team: <NEWLINE> | | Pts | <NEWLINE> | Hawks | 9, 8 | <NEWLINE> Player: <NEWLINE> | | Pts | <NEWLINE> | Ann | 3 |"
    docs = c.collection("d", spark.createDataFrame([(1, text), (2, table), (3, None)], "id long, text string"), "id")
    docs.view("done", ["name", "age"], CompletionExtractor(lambda t: t, ["name", "age"]), identifying="name")
    docs.view("team", ["name", "pts"], TableTextExtractor("team"), identifying="name")
    docs.view("call", ["n", "never"], CallableExtractor(lambda t: {"n": [str(len(t or ""))]}, ["n", "never"]))
    docs.view("words", ["mood"], LexiconExtractor({"mood": {"sure": ["sure"], "sad": ["sad", "blue"]}}))
    assert [r for r in rows(TextScan("d.done").run(c)) if r[0] == 1] == [(1, "Ann", "31"), (1, "Eve", "")]
    assert rows(TextScan("d.team").run(c)) == [(2, "Hawks", "9, 8")]
    assert rows(TextScan("d.call").run(c))[2] == (3, "0", "")
    assert rows(TextScan("d.words").run(c)) == [(1, "sure"), (2, ""), (3, "")]


def test_bad_tables(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(ValueError):
        Table("x", df, ("nope",))
    with pytest.raises(ValueError):
        TextCollection("x", df.withColumn("more", F.lit(1)), "id")
    with pytest.raises(KeyError):
        Catalog(spark).get("nothing")


def test_merge_cells(spark):
    c = "array<struct<normed:string,alts:array<string>>>"
    df = spark.createDataFrame([([[("a", ["a"]), ("b", ["b"])], [("a", ["x"])]],)], f"cs array<{c}>")
    got = df.select(merge_cells(F.col("cs")).alias("m")).first()["m"]
    assert [(v["normed"], v["alts"]) for v in got] == [("a", ["a", "x"]), ("b", ["b"])]


def test_streaming_scan(spark, tmp_path, catalog):
    from loomtext.streaming.textstream import shown, stream_counts, stream_scan

    docs = spark.createDataFrame([(1, "Ann", "2024-01-01 10:00:00"), (2, "Bob Ann", "2024-01-01 11:00:00"), (3, "Bob", "2024-01-03 11:00:00")], "id long, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    docs.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    view = catalog.get("docs.people")
    q = shown(stream_scan(live, "id", "text", view, ["person"])).writeStream.format("memory").queryName("scanned").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("select id, person from scanned").collect()) == [(1, "Ann"), (2, "Bob, Ann"), (3, "Bob")]
    q = stream_counts(live, "id", "text", "at", view, "person").writeStream.outputMode("update").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["value"], r["n"]) for r in spark.sql("select value, max(n) as n from counted group by value, start").collect()} == {("Ann", 2), ("Bob", 1)}


def test_equal_rows_stay_apart(spark):
    c = Catalog(spark)
    c.table("t", spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (3, None)], "k int, v string"), ["k"])
    same = spark.createDataFrame([("x", "y")], "value string, rep string")
    for rep in (None, same):
        assert [r["k"] for r in TextAggregate("t", "v", rep).run(c).collect()] == [[1, 1, 2]]


def test_places_of_matches_that_look_around(spark):
    from loomtext.operators.spans import find_spans

    df = spark.createDataFrame([("ab b xb b",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(find_spans(F.col("t"), r"(?<= )b\b")).collect()]
    assert [tuple(s) for s in got[0]] == [(3, 4, "b"), (8, 9, "b")] and got[1] == [] and not got[2]
