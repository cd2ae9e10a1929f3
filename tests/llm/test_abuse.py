import random

import numpy as np
from pyspark.sql import functions as F

from loomtext.llm import abuse

CLEAN = ["the bridge opened in {n} after long repairs", "the home team won {n} to {n} in front of a crowd", "a dumb terminal fault was found in unit {n}", "wind from the north at {n} knots", "the play was boring and far too long"]
BAD = {"abusive": ["you are a worthless idiot", "shut up, you stupid clown"], "hateful": ["those people are vermin and must go", "all of them are born thieves"], "sexual": ["hot naked singles want you now", "uncut porn leaked, watch it live"]}


def made(n, seed):
    rng = random.Random(seed)
    texts, y = [], np.zeros((n, 3), int)
    for i in range(n):
        parts = [rng.choice(CLEAN).format(n=rng.randint(1, 99)) for _ in range(rng.randint(2, 6))]
        if rng.random() < 0.3:
            c = rng.randrange(3)
            s = rng.choice(BAD[abuse.CLASSES[c]])
            if rng.random() < 0.3:
                w = rng.choice([x for x in s.split() if len(x) > 4])
                s = s.replace(w, rng.choice([".".join(w), w.upper(), w[:2] + "​" + w[2:], w.replace("o", "0").replace("i", "1")]))
            parts.insert(rng.randrange(len(parts)), s)
            y[i, c] = 1
        texts.append(". ".join(parts) + ".")
    return texts, y


def test_normalise():
    assert abuse.normalise("V.E.R.M.I.N and v e r m i n") == "vermin and vermin"
    assert abuse.normalise("fiiiicken іdiot 1dio7a fünf") == "ficken idiot idiota funf"
    assert abuse.sentences(None) == abuse.sentences("") == abuse.sentences(" \n ") == []
    assert max(map(len, abuse.sentences("x y " * 5000))) <= abuse.SPAN + 2


def test_held_out_accuracy():
    texts, y = made(700, 1)
    noisy = y.copy()
    noisy[::40, 0] = 1 - noisy[::40, 0]
    noisy[5, 1] = -1
    model = abuse.fit(texts, noisy)
    more, truth = made(400, 2)
    found = (model.documents(more) >= model.threshold).any(1)
    want = truth.any(1)
    assert (found & want).sum() / found.sum() > 0.95 and (found & want).sum() / want.sum() > 0.95


def test_rows(spark):
    texts, y = made(200, 3)
    model = abuse.fit(texts, y)
    df = spark.createDataFrame([(None,), ("",), (" ",), (texts[0] * 3000,)], "text string")
    got = df.select(abuse.scores(spark, model, F.col("text")).alias("s")).collect()
    assert [r["s"]["abusive"] for r in got[:3]] == [0, 0, 0] and not got[0]["s"]["found"]
    assert df.where("false").select(abuse.scores(spark, model, F.col("text"))).count() == 0


def test_no_labels():
    model = abuse.fit(["a text."], np.zeros((1, 3), int))
    assert not (model.documents(["a text."]) >= model.threshold).any()
    assert not (abuse.fit([], np.zeros((0, 3), int)).documents(["x"]) >= 0.5).any()


def test_threshold_of_a_thinned_sample():
    rng = np.random.default_rng(4)
    p, y = np.r_[rng.beta(4, 2, 300), rng.beta(2, 4, 9000)], np.r_[np.ones(300, int), np.zeros(9000, int)]
    whole = abuse._best_threshold(p, y, np.ones(len(p)))
    kept = (y == 1) | (np.arange(len(p)) % 9 == 0)
    thinned = abuse._best_threshold(p[kept], y[kept], np.where(y[kept] == 1, 1.0, 9.0))
    bare = abuse._best_threshold(p[kept], y[kept], np.ones(kept.sum()))
    assert abs(thinned - whole) < 0.05 < whole - bare


def test_sample_stands_for_all_labels(spark, tmp_path, monkeypatch):
    from loomtext.llm import queries

    labels = [(i, int(i % 10 == 0), 0, 0) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, abusive int, hateful int, sexual int").write.parquet(str(tmp_path / "review_labels.parquet"))
    spark.createDataFrame([(i, f"text {i}.") for i in range(200)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(abuse, "MAX_POSITIVE", 16)
    monkeypatch.setattr(abuse, "MAX_NEGATIVE", 18)
    seen = {}
    monkeypatch.setattr(abuse, "fit", lambda texts, y, **more: seen.update(more, y=y))
    queries.abuse_model(spark, str(tmp_path))
    bad = seen["y"][:, 0] == 1
    assert seen["weight"][bad].tolist() == [20 / 16] * 16 and seen["weight"][~bad].tolist() == [10.0] * 18
