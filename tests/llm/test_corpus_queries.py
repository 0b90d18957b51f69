"""The registered queries, over whole small tables; those that SQL can express against DuckDB."""

import re

import __spark_entry__ as entry
import duckdb
import pytest

from beaconloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(lake, name):
    documents = duckdb.sql(f"SELECT count(*) FROM '{FOLDER}/documents.parquet'").fetchall()[0][0]
    rows = QUERIES[name](lake, FOLDER).collect()
    assert len(rows) == documents if name not in ("op6_neighbours", "op7_packing", "op11_centroids", "op13_spelling") else rows
    if name in ORACLES:
        for source in ("documents", "embeddings"):
            duckdb.sql(f"CREATE OR REPLACE VIEW {source} AS SELECT * FROM '{FOLDER}/{source}.parquet'")
        result = duckdb.sql(ORACLES[name])
        assert sorted(map(tuple, rows)) == sorted(tuple(r) for r in result.fetchall()) and list(rows[0].__fields__) == list(result.columns)


def test_pipeline(lake):
    rows = entry.queries()["pipeline"](lake, FOLDER).collect()
    assert rows and list(rows[0].__fields__)[:3] == ["doc_id", "start", "length"]
