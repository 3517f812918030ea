import pytest
from pyspark.sql import functions as F

from paperlode.operators import pages as P
from paperlode.sources import chunk_store

PAGES = "doc_id long, page_number long, text string, extraction_failed boolean"


def state(store):
    return sorted(map(tuple, store.states().collect())), sorted((r.doc_id, r.run, r.page_number, r.content) for r in store.chunks().collect())


def words(n, w="w"):
    return " ".join(f"{w}{i}" for i in range(n))


def test_chunks_are_replaced_twice_and_purged_once(spark):
    chunk = lambda df: P.chunk(df, 4, 1)
    store = chunk_store.create(spark, buckets=3)
    store.reingest(spark.createDataFrame([(d, 1, words(6, f"a{d}_"), False) for d in range(8)], PAGES), chunk)
    assert state(store)[0] == [(d, "indexed", 1) for d in range(8)] and len(state(store)[1]) == 16

    # second run: one document shorter, one longer, one that fails altogether, one with a failed page, one new
    again = [(0, 1, words(2, "b"), False), (1, 1, words(9, "b"), False), (2, 1, words(5), True), (2, 2, words(5), True), (3, 1, words(3), True), (3, 2, words(3, "c"), False), (90, 1, words(2, "n"), False)]
    store.reingest(spark.createDataFrame(again, PAGES), chunk)
    states, chunks = state(store)
    assert dict((d, (s, r)) for d, s, r in states) == {0: ("indexed", 2), 1: ("indexed", 2), 2: ("failed", 2), 3: ("indexed", 2), 90: ("indexed", 2), **{d: ("indexed", 1) for d in range(4, 8)}}
    assert [c for c in chunks if c[0] in (0, 2, 3, 90)] == [(0, 2, 1, "b0 b1"), (3, 2, 2, "c0 c1 c2"), (90, 2, 1, "n0 n1")]
    assert sum(c[0] == 1 for c in chunks) == 3 and all(c[1] == 1 for c in chunks if 4 <= c[0] < 8)

    # third run: the failed document comes back, an empty one has no chunks
    store.reingest(spark.createDataFrame([(2, 1, "back", False), (5, 1, " ", False)], PAGES), chunk)
    states, chunks = state(store)
    assert {d: s for d, s, _ in states}[2] == "indexed" and {d: s for d, s, _ in states}[5] == "failed"
    assert (2, 3, 1, "back") in chunks and not [c for c in chunks if c[0] == 5] and len(states) == 9


def test_a_run_that_breaks_changes_nothing(spark):
    store = chunk_store.create(spark, buckets=2)
    store.reingest(spark.createDataFrame([(1, 1, "one two", False)], PAGES), lambda df: P.chunk(df, 4, 1))
    before = state(store)

    def broken(df):
        return P.chunk(df, 4, 1).withColumn("content", F.raise_error(F.lit("no model")))

    with pytest.raises(Exception, match="no model"):
        store.reingest(spark.createDataFrame([(1, 1, "three", False), (2, 1, "four", False)], PAGES), broken)
    assert state(store) == before


def test_no_documents(spark):
    store = chunk_store.create(spark)
    assert state(store) == ([], [])
    store.reingest(spark.createDataFrame([], PAGES), lambda df: P.chunk(df, 4, 1))
    assert state(store) == ([], [])
