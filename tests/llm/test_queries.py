"""Queries of the numbered operators that have SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from marginalia.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    ours, theirs = Q.QUERIES[name](spark, SF).toPandas(), con.sql(Q.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    key = sorted(ours.columns)
    assert sorted(map(tuple, ours[key].astype(object).to_numpy().tolist())) == sorted(map(tuple, theirs[key].astype(object).to_numpy().tolist()))


def test_ten_queries_by_their_numbers():
    numbered = [n for n in Q.QUERIES if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in numbered] == list(range(1, 11))
