"""Queries over documents that SQL can express equal their SQL."""

import duckdb
import pytest

from tallyhouse.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op6_substring_dedup", "op7_ngram_jaccard_join", "op13_minhash"])
def test_twin(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    theirs = con.sql(ORACLE_SQL[name])
    found = QUERIES[name](spark, SF).select(*theirs.columns).collect()
    assert sorted(map(tuple, found)) == sorted(theirs.fetchall())


def test_sql_belongs_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
