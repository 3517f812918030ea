import duckdb
import pytest

from paperlode.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, key):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    cur = duck.execute(ORACLE_SQL[key])
    names = sorted(x[0] for x in cur.description)
    want = [dict(zip([x[0] for x in cur.description], r)) for r in cur.fetchall()]
    df = QUERIES[key](spark, DIR)
    assert sorted(df.columns) == names
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted((tuple(r[c] for c in names) for r in want), key=str)
