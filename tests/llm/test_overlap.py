import random

from pyspark.sql import functions as F

from loomtext.llm.overlap import CrossSplit, words

VOCABULARY = [f"w{i}" for i in range(30)]


def brute(rows, k=3):
    sets = {}
    for i, t, held in rows:
        w = words(t) if t else []
        if len(w) >= k:
            sets[i] = (frozenset(zip(*(w[j:] for j in range(k)))), bool(held))
    out = {}
    for a, (x, h) in sets.items():
        for b, (y, g) in sets.items():
            if h and not g and 2 * len(x & y) >= len(x | y):
                out[a, b] = len(x & y) / len(x | y)
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "id string, text string, held boolean")
    return {(r["held_id"], r["train_id"]): r["similarity"] for r in CrossSplit(df).pairs().collect()}


def test_words():
    assert words("Été l'ﬁn! ＡＢ x́y 1½") == ["ete", "l", "fin", "ab", "xy", "11", "2"]
    assert words("İstanbul_A") == ["istanbul", "a"]


def test_against_brute_force(spark):
    rng, rows = random.Random(5), []
    for i in range(60):
        base = [rng.choice(VOCABULARY) for _ in range(rng.randint(4, 25))]
        for j in range(3):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            rows.append((f"t{i}-{j}", (" " if j else ", ").join(w).upper() if j == 2 else " ".join(w), rng.random() < 0.4))
    rows += [("n", None, True), ("e", "", True), ("s", "a b", None)] + [(f"hot{i}", "the very same text again and again", i % 2 == 0) for i in range(40)]
    want, got = brute(rows), run(spark, rows)
    assert set(got) == set(want) and len(want) > 400
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_threshold_is_inclusive(spark):
    # 3 of 6 runs in common
    assert len(run(spark, [("a", "a b c d e x y", True), ("b", "a b c d e", False)])) == 1
    assert run(spark, [("a", "a b c d e x y z", True), ("b", "a b c d e", False)]) == {("a", "b"): 0.5}
    assert run(spark, [("a", "a b c d e x y z q", True), ("b", "a b c d e", False)]) == {}


def test_empty(spark):
    assert run(spark, []) == {}


def test_equal_runs_are_not_equal_texts(spark):
    rows = [("a", "x y z x y z", True), ("b", "x y z x y z x y z", False), ("c", "X, y z! x y Z", False), ("d", "hi", True), ("e", "Hi!", False), ("f", None, True)]
    df = spark.createDataFrame(rows, "id string, text string, held boolean").withColumn("g", F.lit("g"))
    cross = CrossSplit(df, about={"g": F.col("g")})
    assert {(r["held_id"], r["train_id"]): r["similarity"] for r in cross.pairs().collect()} == {("a", "b"): 1.0, ("a", "c"): 1.0}
    assert [tuple(r) for r in cross.counts(["g"], ["g"]).collect()] == [("g", "g", 3, 2, 2)]
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in cross.membership().collect()}
    assert got == {"a": ("a", 2), "b": ("b", 1), "c": ("a", 1), "d": ("d", 1), "e": ("d", 1), "f": (None, 0)}


def test_many_copies_are_counted_without_pairs(spark):
    n = 100_000
    df = spark.range(2 * n).select(F.col("id").cast("string").alias("id"), F.lit("one text that was copied very often").alias("text"), (F.col("id") < n).alias("held"), F.lit("s").alias("s"))
    cross = CrossSplit(df, about={"s": F.col("s")})
    assert [tuple(r) for r in cross.counts(["s"], ["s"]).collect()] == [("s", "s", n * n, n, n * n)]
    assert cross.links().count() == 1 and cross.membership().where("class_id = '0' and n_links = 1").count() == 2 * n


def test_the_latest_row_of_an_id_counts(spark):
    rows = [("a", "one two three four", True, 1), ("a", "five six seven eight", True, 2), ("b", "one two three four", False, None), ("c", "five six seven eight", False, 1), (None, "one two three four", True, 3)]
    df = spark.createDataFrame(rows, "id string, text string, held boolean, at int")
    assert [(r["held_id"], r["train_id"]) for r in CrossSplit(df, order=F.col("at")).pairs().collect()] == [("a", "c")]
