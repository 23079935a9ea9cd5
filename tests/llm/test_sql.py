"""Queries of the operators against their SQL."""

import duckdb
import pytest

from pagewright.llm.queries import ORACLE_SQL, REGISTRY

TINY = "/root/testdata/sf0.001"


def content(table):
    names = sorted(table.column_names)
    types = [str(table.schema.field(n).type).replace("large_", "") for n in names]
    return names, types, sorted(zip(*[table.column(n).to_pylist() for n in names]), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{TINY}/{table}.parquet'")
    assert content(REGISTRY[name](spark, TINY).toArrow()) == content(con.sql(ORACLE_SQL[name]).to_arrow_table())
