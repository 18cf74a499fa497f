"""Every query with SQL gives what DuckDB gives."""

import math
import os

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
base = pytest.importorskip("quern.queries")
pytest.importorskip("quern.edge_queries")


def plain(v):
    if v is None or v != v or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, float) and not math.isnan(v) and v.is_integer():
        return int(v)
    return v.item() if hasattr(v, "item") else v


def rows(frame, columns):
    return sorted(repr(tuple(map(plain, r))) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(base.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = base.QUERIES[name](spark, SF).toPandas(), duck.sql(base.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert base.QUERIES[name](spark, SF).limit(20).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_headings_with_addresses_and_quotes(spark, tmp_path):
    pages = [(1, '<article><h1>a &amp; x.42@mail8.example.com b</h1></article>'), (2, "<h1>token = &quot;7f\\ &amp;amp</h1>"), (3, "<p>none</p>")]
    spark.createDataFrame(pages, "page_id int, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(base.ORACLE_SQL["html_headings"]).fetchall()
    assert sorted(map(tuple, base.QUERIES["html_headings"](spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.parametrize("name", ["json_roundtrip", "toml_tree_roundtrip", "yaml_tree_roundtrip", "image_chain_lossless", "text_markdown_text"])
def test_chains_take_one_python_process_a_task(spark, name):
    plan = base.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
