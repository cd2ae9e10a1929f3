import pytest
from pyspark.sql import functions as F

from loomtext.operators import alignment, evaluation, joins, spans, synthesis


def test_spans_in_windows(spark):
    df = spark.createDataFrame([([0, 4, 8, 12], [(4, 7), (5, 13), (12, 14)])], "o array<int>, s array<struct<start:int,end:int>>")
    got = df.select(spans.in_window(F.col("s"), F.col("o"), F.lit(0), 4), spans.in_window(F.col("s"), F.col("o"), F.lit(2), 2)).first()
    assert [tuple(x) for x in got[0]] == [(1, 2), (1, 4), (3, 4)] and [tuple(x) for x in got[1]] == [(0, 2), (1, 2)]
    t = spark.createDataFrame([(["a", "##b", "##c", "d"], 2), (["##x"], 0), ([], 0)], "t array<string>, i int")
    got = t.select(spans.word_start(F.col("t"), F.col("i")), F.transform(spans.merge_pieces(F.col("t")), lambda x: x["word"])).collect()
    assert [tuple(r) for r in got] == [(0, ["abc", "d"]), (0, ["##x"]), (None, [])]


def test_many_matches_are_linear(spark):
    n = 200_000
    got = spark.createDataFrame([("ab " * n,)], "t string").select(spans.find_spans(F.col("t"), "b").alias("s")).select(F.size("s"), F.element_at("s", -1)["start"]).first()
    assert tuple(got) == (n, 3 * n - 2)


def test_tournament_prefers_the_nearest_name(spark):
    text = "Ann Lee won. Bob Ray had 12 points and Cy Doe had 7 rebounds."
    place = lambda s: (text.index(s), text.index(s) + len(s))
    rows = [(name, text, place("12"), [place(name)], [place("points")]) for name in ("Ann Lee", "Bob Ray", "Cy Doe")]
    span = "struct<start:int,end:int>"
    df = spark.createDataFrame(rows, f"name string, text string, v {span}, names array<{span}>, columns array<{span}>").withColumn("k", F.lit(1))
    f = alignment.distance_features(df, "text", "v", {"name": "names", "column": "columns", "team": "columns"})
    bob = f.where("name = 'Bob Ray'").first()["features"]
    assert bob["name_words"] == 3 and bob["name_sentences"] == 0 and bob["name_first"] == 1 and bob["column_first"] == 0 and bob["team_count"] == 1 and bob["name_characters"] == 5
    assert f.where("name = 'Ann Lee'").first()["features"]["name_sentences"] == 1
    assert tuple(alignment.tournament(f, ["k"], "name", "features").first()) == (1, "Bob Ray", 2)


def test_persons(spark):
    df = spark.createDataFrame([(1, "He ran. Ann Lee won and she sang. Bob Ray lost; his day.")], "k int, t string")
    got = [(r["surface"], r["entity"]) for r in alignment.with_persons(df, "k", "t").orderBy("start").collect()]
    assert got == [("Ann Lee", "Ann Lee"), ("she", "Ann Lee"), ("Bob Ray", "Bob Ray"), ("his", "Bob Ray")]


def test_dependent_samples(spark):
    answers = spark.createDataFrame([("t", "d", "r1", "c1", 0, 1), ("t", "d", "r2", "c2", 2, 3), ("t", "d", "r2", "c2", 2, 3), ("t", None, "r", "c", 0, 1)], "table string, doc string, row string, column string, start int, end int")
    refers = spark.createDataFrame([("d", "r1", None), ("d", "r2", "r1")], "doc string, row string, parent string")
    got = {(r["kind"], r["row"], r["column"]): r["answers"] for r in synthesis.training_samples(answers, refers).collect()}
    assert got == {("regular", "r1", "c1"): ["0-1"], ("regular", "r2", "c2"): ["2-3"], ("empty", "r1", "c2"): [], ("empty", "r2", "c1"): [], ("header", None, None): ["c1", "c2"], ("dependent", "r1", "r2/c2"): ["2-3"]}
    assert synthesis.training_samples(answers.where("false")).count() == 0


def test_groups_take_one_partner(spark):
    p = spark.createDataFrame([(1, "a"), (1, "A "), (1, "z"), (1, None)], "k int, g string")
    lab = spark.createDataFrame([(1, ["a", "b"]), (1, ["q"])], "k int, s array<string>")
    got = sorted((r["g"] or "", r["label"] or "") for r in evaluation.matched_groups(p, lab, ["k"], "g", "s").collect())
    assert got == [("", ""), ("", "q"), ("A ", "a|b"), ("a", ""), ("z", "")]


def test_chrf_and_nulls(spark):
    df = spark.createDataFrame([("abc", "abc"), ("abc", None), ("abc", "xyz")], "a string, b string")
    assert [r[0] for r in df.select(evaluation.chrf_score("a", "b")).collect()] == [1.0, None, 0.0]


def test_nearest_ties_and_bounds(spark):
    a = spark.createDataFrame([("k", 5.0), ("k", 5.0), ("k", None), ("x", 1.0)], "k string, t double")
    b = spark.createDataFrame([("k", 3.0, "lo"), ("k", 7.0, "hi"), ("k", 99.0, "far")], "k string, t double, v string")
    got = sorted(((r["t"], r["v"], r["distance"]) for r in joins.nearest(a, b, "k", "t", ["v"], 2.0).collect()), key=repr)
    assert got == sorted([(5.0, "lo", 2.0), (5.0, "lo", 2.0), (None, None, None), (1.0, None, None)], key=repr)
    assert [r["v"] for r in joins.nearest(a, b, "k", "t", ["v"], 1.5).collect()] == [None] * 4


def test_views_are_checked(spark):
    from loomtext.operators.extractors import PatternExtractor
    from loomtext.plans.catalog import Catalog

    docs = Catalog(spark).collection("d", spark.createDataFrame([(1, "x")], "k int, t string"), "k")
    with pytest.raises(ValueError):
        docs.view("v", ["a"], PatternExtractor({"a": ("x", 0)}), single=("b",))
    with pytest.raises(ValueError):
        docs.view("v", ["a"], PatternExtractor({"a": ("x", 0)}), window=(4, 4))
