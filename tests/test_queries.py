"""Registered queries against their SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from loomtext.queries import corpus, corpusflow, latent, relational, sources, texttables
from tools_compare import rows

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODULES = [corpus, relational, texttables, corpusflow, sources, latent]
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.SQL])
def test_against_sql(spark, con, name):
    module = next(m for m in MODULES if name in m.SQL)
    df = module.QUERIES[name](spark, FOLDER)
    cur = con.execute(module.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.QUERIES if n not in m.SQL])
def test_runs(spark, name):
    module = next(m for m in MODULES if name in m.QUERIES)
    module.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()


def test_entry_lists_every_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {n for m in MODULES for n in m.QUERIES} <= set(e.queries())


def test_nothing_else_imports_llm():
    root = Path(corpus.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts[len(root.parts) :]:
            assert "loomtext.llm" not in p.read_text(), p


def test_match_rows_takes_all_cities(spark, tmp_path, monkeypatch):
    mentions = [("r1", "location_city", 0, "Bonn"), ("r1", "location_city", 1, "Oslo"), ("r1", "location_state", 0, "Ohio"), ("r2", "location_city", 1, "Rome")]
    frame = spark.createDataFrame(mentions, "report_number string, attribute string, pos int, mention string")
    monkeypatch.setattr(texttables, "ReportTables", lambda df: type("T", (), {"mentions": lambda self: frame})())
    frame.write.parquet(str(tmp_path / "annotated_reports.parquet"))
    spark.createDataFrame([("r1", "Oslo"), ("r2", "Rome")], "report_number string, location_city string").write.parquet(str(tmp_path / "incidents.parquet"))
    got = {tuple(r) for r in texttables.match_rows(spark, str(tmp_path)).collect()}
    assert got == {("r1", "Oslo", "Bonn", 100.0), ("r2", "Rome", "Rome", 100.0)}
