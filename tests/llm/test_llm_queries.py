from pathlib import Path

import pytest

from loomtext.llm import queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no tables")


@pytest.mark.parametrize("name", queries.QUERIES)
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    df.write.format("noop").mode("overwrite").save()


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", queries.SQL)
def test_against_sql(spark, con, name):
    from tools_compare import rows

    df = queries.QUERIES[name](spark, FOLDER)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())


def test_shares_add_up(spark):
    got = queries.p7_shares(spark, FOLDER).collect()
    assert abs(sum(r["actual_share"] for r in got) - 1) < 1e-9 and all(r["most_copies"] <= r["max_repeats"] for r in got)


def test_shared_texts_serve_several_sources(spark, tmp_path):
    rows = [(1, "one text here", "a"), (2, "One text, here!", "b"), (3, "only here", "a"), (4, None, "b"), (5, "... !", "a"), (6, "??", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(" A", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    docs = {r["id"]: set(r["sources"]) for r in queries._mixture(spark, str(tmp_path), shared=True)[1].collect()}
    assert docs[1] == {"a", "b"} and docs[3] == {"a"} and 2 not in docs and docs[5] == {"a"} and docs[6] == {"b"}
    assert all(r["met"] and r["kept"] for r in queries.p7_checks(spark, str(tmp_path)).collect())


def test_model_is_kept_for_the_same_files(spark):
    assert queries.abuse_model(spark, FOLDER) is queries.abuse_model(spark, FOLDER)
