"""Registered queries against their SQL in DuckDB.

By default the quick ones on the smallest tables. ``ORACLE_QUERIES=all`` runs
every query, ``ORACLE_SF`` picks the tables.
"""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from checks.queries import REGISTRY

SF = f"/root/testdata/{os.environ.get('ORACLE_SF', 'sf0.001')}"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUICK = (
    "scan_pages extract_pages upsert_pages page_links backfill_domain parse_seed_list extract_domain "
    "allowed_domain_filter resolve_links canonical_url page_outlinks clean_text ngrams term_freq "
    "vocabulary tfidf_postings search search_empty total_found bfs_parents dfs_crawl page_routes "
    "crawl_status crawl_eta recommend_traversal cache_upsert cache_lookup history_view stats_counts "
    "domain_stats"
).split()
ORACLE = driver.oracle_sql()
NAMES = sorted(ORACLE) if os.environ.get("ORACLE_QUERIES") == "all" else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def content(table):
    names = sorted(table.column_names)
    types = [str(table.schema.field(n).type).replace("large_", "") for n in names]
    rows = sorted(zip(*[table.column(n).to_pylist() for n in names]), key=repr)
    return names, types, rows


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = content(driver.queries()[name](spark, SF).toArrow())
    assert got == content(duck.sql(ORACLE[name]).to_arrow_table())


def test_every_query_is_known():
    assert set(ORACLE) <= set(driver.queries())
    assert set(REGISTRY) == set(ORACLE) & set(REGISTRY)
