from pyspark.sql import functions as F

from loomtext.operators import corpussteps as cs


def test_reflexive_and_splits(spark):
    df = spark.createDataFrame([("Q1", "P1", "Q2", "Rome"), ("Q3", "P2", "Q4", "He"), (None, "P1", "Q5", "x")], "s string, a string, o string, f string")
    got = cs.with_reflexive(df, "s", "a", "o", "f")
    assert [tuple(r) for r in got.where("a = 'id'").collect()] == [("Q1", "id", "Q1", "Rome")] and got.count() == 4
    split = {r["s"]: r["split"] for r in cs.assign_splits(df, "s", "a", {"t": F.col("s") == "Q1", "u": F.col("s") == "Q3"}, ["P1"], 0.0).collect()}
    assert split == {"Q1": 3, "Q3": 4, None: 1}
    assert {r["split"] for r in cs.assign_splits(df, "s", "a", {}, [], 1.0).collect()} == {2}
    assert cs.without_pairs(df, [("Q1", "P1")], "s", "a").count() == 2


def test_group_mentions(spark):
    df = spark.createDataFrame([("d", "q", "a", 1, 2), ("d", "q", "a", 1, 2), ("d", "q", "b", 3, 4), ("d", "r", "a", 5, 6), (None, "q", "a", 1, 2)], "doc string, q string, a string, s int, e int")
    got = cs.group_mentions(df, ["doc"], ["q"], ["a"], ["s", "e"]).collect()
    assert len(got) == 1 and [(q["q"], [(a["a"], len(a["mentions"])) for a in q["answers"]]) for q in got[0]["queries"]] == [("q", [("a", 1), ("b", 1)]), ("r", [("a", 1)])]


def test_confusion(spark):
    df = spark.createDataFrame([(i, ["x"] if i < 3000 else ["y"], i % 2) for i in range(3001)] + [(9999, None, 0)], "k int, types array<string>, split int")
    got = {r["k"]: r["other"] for r in cs.confusion_texts(df, "k", "types", "split").collect()}
    assert len(got) == 3002 and got[3000] is None and got[9999] is None
    assert all(o is not None and o != k and o % 2 == k % 2 for k, o in got.items() if k < 3000)


def test_enrich_and_dates(spark):
    q, t = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "text")], "k int, text string")
    n = spark.createDataFrame([(1, "P2", "b"), (1, "P1", "a"), (1, "P3", "c")], "k int, p string, o string")
    got = {r["k"]: (r["text"], [e["o"] for e in r["evidence"]]) for r in cs.enrich(q, t, n, "k").collect()}
    assert got == {1: ("text", ["a", "b"]), 2: (None, [])}
    w = spark.createDataFrame([(1, "1990-05-06T00:00:00Z"), (2, "1990-05-06T00:00:00Z"), (3, "x")], "k int, d string")
    h = spark.createDataFrame([(1, "1990-05-00T00:00:00Z"), (1, "1990-00-00T00:00:00Z"), (2, "1991-00-00T00:00:00Z")], "k int, d string")
    assert [(r["k"], r["found"]) for r in cs.match_dates(w, h, "k", "d").collect()] == [(1, "1990-05-00T00:00:00Z")]


def test_small_steps(spark):
    assert cs.balanced(list("abcdefgh"), 7) == [list("abcd"), list("efgh")] and cs.balanced([]) == []
    df = spark.createDataFrame([(1, 0, 3), (1, 0, 5), (1, 4, 5)], "d int, s int, e int")
    assert sorted(tuple(r) for r in cs.last_ends(df, ["d"], "s", "e").collect()) == [(1, 0, 5), (1, 4, 5)]
    values = F.array(*[F.lit(i) for i in range(50)])
    a, b = spark.range(1).select(cs.shuffled(values, F.lit("k"), 1), cs.shuffled(values, F.lit("k"), 2)).first()
    assert sorted(a) == sorted(b) == list(range(50)) and a != b
    m = spark.range(1).select(cs.masked(F.array(*[F.lit("t")] * 2000), F.lit(1), 0.15, "[M]", F.array(F.lit("z")), 3)).first()[0]
    hidden = [x for x in m if x["target"] is not None]
    assert 200 < len(hidden) < 400 and 0.7 < sum(x["token"] == "[M]" for x in hidden) / len(hidden) < 0.9 and all(x["token"] == "t" for x in m if x["target"] is None)
    kinds = {r["column"]: r["kind"] for r in cs.column_kinds(spark.createDataFrame([("", "1,200", "May 5, 1990", None)], "a string, b string, c string, d string"), ["a", "b", "c", "d"]).collect()}
    assert kinds == {"a": None, "b": "real", "c": "date", "d": None}
    t = spark.createDataFrame([(1, "n", "v")], "k int, name string, x string")
    assert cs.evidence_of(t, ["k"], ["x"], "name", "row-id").first()["x"] is None and cs.evidence_of(t, ["k"], ["x"], "name", "none").count() == 0 and cs.evidence_of(t, ["k"], ["x"], "name", "full").first()["x"] == "v"
    assert {r[0] for r in cs.name_pieces(spark.createDataFrame([("Ann Lee",), (None,)], "n string"), "n").collect()} == {"Ann Lee", "Ann", "Lee"}
    lines = spark.createDataFrame([("H-2\t-0.1\tb",), ("H-1\t-0.1\ta",), ("S-1\tx",)], "l string")
    assert [tuple(r) for r in cs.hypothesis_lines(lines, "l").orderBy("number").collect()] == [(1, "a"), (2, "b")]
    box = spark.createDataFrame([(1, {"PTS": {"0": "9", "1": "N/A"}, "AST": {"0": "2"}})], "g int, b map<string,map<string,string>>")
    assert [(r["player"], r["cells"]) for r in cs.boxscore_tables(box, "g", "b").collect()] == [("0", {"PTS": "9", "AST": "2"})]


def test_alignment(spark):
    v = spark.createDataFrame([(1, 10, 12, "25"), (1, 40, 41, "3"), (2, 0, 1, "9")], "d int, start int, end int, value string")
    n = spark.createDataFrame([(1, 0, 5, "Ann"), (1, 30, 35, "Bob")], "d int, start int, end int, name string")
    c = spark.createDataFrame([(1, 13, 19, "PTS"), (1, 42, 49, "AST")], "d int, start int, end int, column string")
    got = {(r["d"], r["value"]): (r["name"], r["column"]) for r in cs.align_values(v, n, c, "d").collect()}
    assert got == {(1, "25"): ("Ann", "PTS"), (1, "3"): ("Bob", "AST"), (2, "9"): (None, None)}


def test_names_and_terms(spark):
    from loomtext.operators.wikidata import names_of, value_text

    ids = spark.createDataFrame([("Q1",), ("Q2",), ("Q3",)], "id string")
    labels = spark.createDataFrame([("Q1", "one"), ("Q1", "one"), ("Q2", None)], "id string, label string")
    aliases = spark.createDataFrame([("Q1", ["uno", "eins"]), ("Q2", [None, "zwei"])], "id string, aliases array<string>")
    assert {r["id"]: (r["label"], r["term"]) for r in names_of(ids, labels, aliases).collect()} == {"Q1": ("one", "one"), "Q2": ("Q2", "Q2"), "Q3": ("Q3", "Q3")}
    seen = set()
    for seed in range(12):
        got = {r["id"]: r["term"] for r in names_of(ids, labels, aliases, seed).collect()}
        assert got["Q1"] in ("one", "uno", "eins") and got["Q2"] in ("Q2", "zwei") and got["Q3"] == "Q3"
        seen.add(got["Q1"])
    assert len(seen) > 1
    values = spark.createDataFrame([("wikibase-entityid", '{"id": "Q1"}'), ("time", '{"time": "+1990-05-00T00:00:00Z"}'), ("string", "x")], "kind string, value string")
    got = {r["kind"]: r["text"] for r in value_text(values, labels, "rand_term", aliases, 1).collect()}
    assert got["wikibase-entityid"] in ("one", "uno", "eins") and got["time"] == "May 1990" and got["string"] == "x"


def test_cut_out_names(spark):
    df = spark.range(400).select("id", F.array(F.lit("a"), F.lit("b")).alias("n"))
    got = df.select("n", cs.cut_out(F.col("n"), F.col("id"), 0.25, 3).alias("c")).collect()
    lost = sum(x is None for r in got for x in r["c"])
    assert all(x in (None, y) for r in got for x, y in zip(r["c"], r["n"])) and 140 < lost < 260
    assert all(r["c"] == r["n"] for r in df.select("n", cs.cut_out(F.col("n"), F.col("id"), 0.0, 3).alias("c")).collect())


def test_candidates_do_not_depend_on_others(spark):
    rows = [(f"t{i}", ["x"], 0) for i in range(3000)] + [("lone", ["y"], 0), ("none", None, 0)]
    df = spark.createDataFrame(rows, "k string, types array<string>, split int")
    got = {r["k"]: r["other"] for r in cs.confusion_texts(df, "k", "types", "split", 1).collect()}
    assert len(got) == 3002 and got["lone"] is None and got["none"] is None
    assert all(v is not None and v != k for k, v in got.items() if k.startswith("t"))


def test_group_ranks_with_null_groups(spark):
    from loomtext.operators.ranking import group_rank

    rows = [(None, 3), (None, 1), ("a", 2), ("a", 9), ("a", 5)]
    got = {(r["g"], r["v"]): (r["rank"], r["n"]) for r in group_rank(spark.createDataFrame(rows, "g string, v int"), ["g"], [F.col("v")], size="n").collect()}
    assert got == {(None, 1): (1, 2), (None, 3): (2, 2), ("a", 2): (1, 3), ("a", 5): (2, 3), ("a", 9): (3, 3)}


def test_entities_are_parsed_once_and_odd_ones_kept(spark):
    from loomtext.operators.wikidata import shred_entities

    df = spark.createDataFrame([('{"id": "Q1", "labels": {"en": {"value": "x"}}, "claims": []}',), ('{"id": "Q2", "aliases": {}, "claims": {"P31": [{"mainsnak": {"datatype": "wikibase-item", "datavalue": {"type": "t", "value": {"id": "Q5"}}}, "rank": "normal"}]}}',)], "e string")
    got = {r["wikidata_id"]: r for r in shred_entities(df, "e").collect()}
    assert got["Q1"]["label"] == "x" and got["Q1"]["types"] == [] and got["Q2"]["types"] == ["Q5"] and got["Q2"]["aliases"] == []
