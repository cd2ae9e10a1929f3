import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm.bpe import Encoder, default_vocabulary, token_counts, token_ids

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    import public_tokenizers as p

    raw = open(default_vocabulary(), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return Encoder(raw), tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_tiktoken(both):
    mine, theirs = both

    @settings(max_examples=500, deadline=None)
    @given(st.text(max_size=60))
    def same(text):
        assert mine.encode(text) == theirs.encode_ordinary(text)

    same()
    for text in ("<|endoftext|> it's 1234 \r\n　x", "a" * 30000, "ab" * 10000, "é" * 5000, "naïve  café\n\n\n"):
        assert mine.encode(text) == theirs.encode_ordinary(text)


def test_rows(spark, both):
    texts = [None, "", " ", "Hello world", "\U0001f600" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = df.select("doc_id", token_ids(spark, F.col("text")).alias("ids"), token_counts(spark, F.col("text")).alias("n")).orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == [both[1].encode_ordinary(t or "") for t in texts]
    assert [r["n"] for r in got] == [len(r["ids"]) for r in got]
    assert df.where("false").select(token_ids(spark, F.col("text"))).count() == 0
