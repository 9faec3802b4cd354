import duckdb
import pytest

import __spark_entry__ as entry_point
from catalog.derived import TABLES

# Each of these stands for a family of queries; the full set is checked at the next scale.
FAMILIES = ("host_overview", "sitemap_urls", "canonical_urls", "page_assets", "page_records", "run_caps",
            "frontier_bfs", "asset_outcomes", "host_gaps", "sink_csv", "stream_stats")


def test_every_query_has_a_counterpart():
    without = set(entry_point.queries()) - set(entry_point.oracle_sql())
    assert not {name for name in without if name != "pipeline" and not name.startswith("op")}
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["domain", "pages", "links_inside", "links_outside", "distinct_targets"]
    assert df.count() > 0


@pytest.mark.parametrize("name", FAMILIES)
def test_agrees_with_plain_sql(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cursor = con.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    df = entry_point.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want and got
