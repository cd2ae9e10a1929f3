import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.functions.numbers import number_of, number_phrase
from loomtext.operators import metrics, spans, tabletext
from loomtext.operators.clustering import agglomerate, cluster_values, greedy_pairs, match_greedy, representative


def value(spark, column):
    return spark.range(1).select(column).first()[0]


WORDS = [("one", 1), ("twenty nine", 29), ("three hundred", 300), ("twelve hundred", 1200), ("nineteen hundred eighty four", 1984), ("one thirty", 130), ("six sixty two", 662), ("ten twelve", 1012), ("nineteen ten", 1910), ("twenty twenty one", 2021), ("fifty sixty three", 5063), ("twelve thousand three hundred four", 12304), ("six million four hundred thousand five", 6400005), ("one hundred twenty three billion four hundred fifty six million seven hundred eighty nine thousand twelve", 123456789012), ("one hundred and five", 105), ("zero", 0), ("one thirty thousand", None), ("nineteen eighty thousand", None), ("hundred", None), ("thousand million", None), ("banana", None), ("", None), ("one zero", None)]


@pytest.mark.parametrize("words,n", WORDS)
def test_number_words(words, n):
    assert number_of(words) == n


def test_number_phrases_round_trip():
    for n in [*range(1, 2000, 7), 10**6, 123456, 10**9 + 1]:
        assert number_of(number_phrase(n)) == n


def test_dates(spark):
    rows = [("+1990-00-00T00:00:00Z", "1990"), ("-0044-03-15T00:00:00Z", "15 March 0044 bc"), ("+1990-05-00T00:00:00Z", "May 1990"), ("+2001-02-03T11:30:00Z", "11:30 03 February 2001"), ("+13798000000-00-00T00:00:00Z", "13798000000"), ("odd", "odd"), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "d string").select(tx.words_of_date(F.col("d"))).collect()
    assert [g[0] for g in got] == [b for _, b in rows]


def test_strings(spark):
    assert value(spark, tx.fold_accents(F.lit("Élbe Straße"))) == "Elbe Strasse"
    assert value(spark, tx.short_uri(F.lit("http://x/Q5^^http://t"))) == "Q5"
    assert int(value(spark, tx.answer_number(F.lit("Q12")))) == 112 and value(spark, tx.answer_number(F.lit("x"))) is None
    for t in ("añb", "", "aaaa", "\U0001f600\U0001f600", "ñ"):
        for most in (0, 1, 3, 4, 5, 9):
            got = value(spark, tx.within_bytes(F.lit(t), most))
            assert t.startswith(got) and len(got.encode()) <= most and (got == t or len((t[: len(got) + 1]).encode()) > most)
    assert value(spark, tx.initials(F.lit("James Earl Ray Jr."))) == ["James Earl Ray Jr.", "James Earl Ray", "J. E. Ray", "Ray"]
    assert value(spark, tx.detokenise(F.lit("I do n't , ( well ) go ."))) == "I don't, (well) go."
    assert tx.fuzzy_find("the quikc fox", "quick") == 4 and tx.fuzzy_find("abc", "zzzzz") is None
    assert value(spark, tx.value_in_text(F.lit("k"), F.lit("New York"), F.lit("in new york city"))) and not value(spark, tx.value_in_text(F.lit("k"), F.lit("5"), F.lit("55")))
    assert value(spark, tx.says_nothing(F.lit("--"))) and value(spark, tx.says_nothing(F.lit("N/A"))) and not value(spark, tx.says_nothing(F.lit("x")))
    assert value(spark, tx.camel_words(F.lit("priceRange"))) == "price range"


def test_spans(spark):
    got = value(spark, spans.find_spans(F.lit("é ab xab"), "[a-z]*b", 0))
    assert [(s["start"], s["end"], s["value"]) for s in got] == [(2, 4, "ab"), (5, 8, "xab")]
    raw = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in [(0, 3), (2, 9), (8, 10), (0, 2)]])
    assert [tuple(s) for s in value(spark, spans.without_overlap(raw))] == [(0, 3), (8, 10)]
    assert [tuple(s) for s in value(spark, spans.longest_wins(raw))] == [(0, 2), (2, 9)]
    assert [tuple(s) for s in value(spark, spans.bio_spans(F.array(*map(F.lit, "OBIIOBBIO"))))] == [(1, 4), (5, 6), (6, 8)]
    assert value(spark, spans.bio_spans(F.array().cast("array<string>"))) == []
    w = value(spark, spans.token_windows(F.array(*[F.lit(str(i)) for i in range(10)]), 4, 1))
    assert [x["start"] for x in w] == [0, 3, 6] and sorted({t for x in w for t in x["tokens"]}, key=int) == [str(i) for i in range(10)]
    assert len(value(spark, spans.token_windows(F.array().cast("array<string>"), 4, 1))) == 1
    assert [tuple(r) for r in value(spark, spans.gaps_and_islands(F.array(*map(F.lit, [5, 1, 2, 2, 3, 9]))))] == [(1, 4), (5, 6), (9, 10)]
    assert value(spark, spans.token_at(F.array(*map(F.lit, [0, 5, 9])), F.lit(6))) == 1 and value(spark, spans.token_at(F.array(F.lit(0)), F.lit(9))) is None


def test_table_text(spark):
    t = "| a | b | <NEWLINE> | 1 | <NEWLINE> | 2 | 3 | 4 |"
    assert value(spark, tabletext.parse_table(F.lit(t))) == [["a", "b"], ["1", ""], ["2", "3"]]
    assert value(spark, tabletext.parse_table(F.lit(t), strict=True)) is None
    assert not value(spark, tabletext.well_formed(F.lit(t))) and not value(spark, tabletext.well_formed(F.lit("")))
    assert value(spark, tabletext.split_outputs(F.lit("Output 1:\na\nOutput 2:\nb\n"), 3)) == ["a", "b", ""]
    assert value(spark, tabletext.fit_budget(F.array(*map(F.lit, ["a b c", "d", "e f"])), 3)) == ["d", "e f"]


def test_value_counts(spark):
    def counts(p, labels):
        arr = F.array(*[F.array(*map(F.lit, s)) for s in labels]) if labels else F.array().cast("array<array<string>>")
        c = value(spark, metrics.value_counts(F.array(*map(F.lit, p)).cast("array<string>"), arr))
        return c["tp"], c["fp"], c["fn"]

    assert counts(["New York", "x", "x"], [["newyork", "nyc"], ["X"], ["z"]]) == (2, 1, 1)
    assert counts([], [["a"]]) == (0, 0, 1) and counts(["a", ""], []) == (0, 1, 0)
    assert counts(["é", "e"], [["E"], ["e"]]) == (2, 0, 0)
    assert metrics.chrf("abc", "abc") == pytest.approx(1) and metrics.chrf("abc", "xyz") == 0


def test_clusters(spark):
    assert agglomerate(["aaaa", "aaab", "zzzz"], 0.3) == [0, 0, 2]
    assert representative(["b##", "bb", "bbb", "abc"]) == "abc"
    df = spark.createDataFrame([("Boston",), ("boston",), ("Bostan",), ("Berlin",), (None,), ("Boston",)], "v string")
    got = {r["value"]: r["rep"] for r in cluster_values(df, "v", 0.2).collect()}
    assert got["boston"] == got["Boston"] == got["Bostan"] and got["Berlin"] == "Berlin" and len(got) == 4
    assert cluster_values(df.where("false"), "v").count() == 0


@pytest.mark.parametrize(("limit", "linkage"), [(0.2, "complete"), (0.34, "complete"), (0.25, "average")])
def test_clusters_against_all_pairs(spark, limit, linkage):
    import random

    rng = random.Random(6)
    names = [" ".join(rng.choice(["north", "new", "port", "saint", "lake"]) + rng.choice(["ville", "ton", "", "field"]) for _ in range(rng.randint(1, 2))) for _ in range(25)]
    values = {"x", "", "kopenhagen", "copenhagen", "Øst#"} | set(names)
    for n in names:
        i = rng.randrange(len(n))
        values |= {n[:i] + rng.choice("aeix") + n[i + 1 :], n[:i] + n[i + 1 :], n.upper()}
    values = sorted(values)
    labels = agglomerate(values, limit, linkage)
    want = {v: representative([w for w, m in zip(values, labels) if m == c]) for v, c in zip(values, labels)}
    got = cluster_values(spark.createDataFrame([(v,) for v in values], "v string"), "v", limit, linkage)
    assert {r["value"]: r["rep"] for r in got.collect()} == want
    assert want["kopenhagen"] == want["copenhagen"]


def test_clusters_of_a_large_block(spark):
    # more than 2000 values with one 14-letter beginning, each with its one near spelling
    values = [f"international {i:05d} {x}" for i in range(1100) for x in (f"{i * 7919 % 99991:05d}{i * 104729 % 99991:05d}{i * 31337 % 99989:05d}" * 2,)]
    values += [v + "x" for v in values]
    got = {r["value"]: r["rep"] for r in cluster_values(spark.createDataFrame([(v,) for v in values], "v string"), "v", 0.02).collect()}
    assert len(got) == 2200 and all(got[v] == got[v + "x"] == v + "x" for v in values[:1100])


def test_matching(spark):
    import numpy as np

    assert greedy_pairs(np.array([[1.0, 5], [5, 2]])) == [(0, 1), (1, 0)]
    assert greedy_pairs(np.zeros((2, 0))) == [(0, -1), (1, -1)]
    p = spark.createDataFrame([(1, "Jon Smith"), (1, "Ann"), (2, "Zed")], "g int, n string")
    q = spark.createDataFrame([(1, ["John Smith", "J. Smith"]), (3, ["Kim"])], "g int, a array<string>")
    got = {(r["g"], r["predicted"]): r["labelled"] for r in match_greedy(p, q, "g", "n", "a").collect()}
    assert got == {(1, "Jon Smith"): "John Smith", (1, "Ann"): None, (2, "Zed"): None, (3, None): "Kim"}
