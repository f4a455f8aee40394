import duckdb
import pytest

from narrate_spark.operators import ordered, sizes
from narrate_spark.plans import registry
from tools.check import TABLES, frame

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_matches_its_sql(spark, con, name):
    mine = frame(registry.QUERIES[name](spark, SF).toPandas())
    theirs = frame(con.execute(registry.ORACLES[name]).df())
    assert list(mine.columns) == list(theirs.columns)
    assert mine.map(str).equals(theirs.map(str))


@pytest.mark.parametrize("name", ["segment_index", "chapter_timeline", "pause_formats", "job_transitions"])
def test_scans_match_over_many_ranges(spark, con, monkeypatch, name):
    scan = ordered._scan
    monkeypatch.setattr(ordered, "_scan", lambda rows, keys, order, parts, **rules: scan(rows, keys, order, 13, **rules))
    test_query_matches_its_sql(spark, con, name)


def test_nothing_is_spread_when_inputs_are_large(spark, monkeypatch):
    monkeypatch.setattr(sizes, "SPREAD_BYTES_PER_CORE", 0)
    plan = registry.QUERIES["plan_events"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan
    flagship = registry.QUERIES["analyze_chapters"](spark, SF)._jdf.queryExecution()
    assert "Exchange" not in flagship.executedPlan().toString()
