from paperlode.operators import postings, search

ITEMS = "item_id long, tenant_id long, content string"


def found(leg):
    return sorted((r.query_id, r["rank"], r.item_id, r.score) for r in leg.collect())


def corpus(n=60):
    words = ["walking", "walked", "the", "land", "owners", "owner", "survey", "Élan", "गाव"]
    return [(i, i % 2, " ".join(words[(i * 7 + j * j) % len(words)] for j in range(i % 13))) for i in range(n)]


QUERIES = [(1, 0, "walks land"), (2, 1, "the owner"), (3, 0, "गाव"), (4, 1, ""), (5, 0, "the"), (6, 1, "absent land"), (7, 0, "Élan survey")]


def test_equals_the_leg_over_texts_after_each_update(spark):
    q = spark.createDataFrame(QUERIES, "query_id long, tenant_id long, query string")
    rows = {r[0]: r for r in corpus()}
    table = postings.create(spark.createDataFrame(list(rows.values()), ITEMS), buckets=8)
    assert found(table.search(q)) == found(search.keyword_leg(q, spark.createDataFrame(list(rows.values()), ITEMS)))

    changed = [(i, i % 2, "land of the owner गाव") for i in range(0, 60, 9)] + [(100, 0, "survey Élan survey"), (101, 1, None)]
    rows |= {r[0]: r for r in changed}
    del rows[4], rows[7]
    table.update(spark.createDataFrame(changed, ITEMS), removed=spark.createDataFrame([(4,), (7,)], "item_id long"))
    want = found(search.keyword_leg(q, spark.createDataFrame(list(rows.values()), ITEMS)))
    assert found(table.search(q)) == want and want

    compact = table.compact()
    assert found(compact.search(q)) == want
    compact.update(spark.createDataFrame([(4, 0, "गाव")], ITEMS))
    assert (3, 4) in {(q, i) for q, _, i, _ in found(compact.search(q))}


def test_a_search_reads_partitions_of_its_terms_and_no_text(spark):
    table = postings.create(spark.createDataFrame(corpus(), ITEMS), buckets=16)
    q = spark.createDataFrame([(1, 0, "survey")], "query_id long, tenant_id long, query string")
    plan = table.search(q)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "bucket" in plan.split("PartitionFilters")[1].split("\n")[0] and "content" not in plan


def test_a_version_that_was_not_recorded_is_not_seen(spark):
    table = postings.create(spark.createDataFrame([(1, 0, "land")], ITEMS), buckets=2)
    lost = spark.createDataFrame([(9, 1, 0, "simple", "land", 50, 0)], postings.COUNTS)
    lost.write.mode("append").partitionBy("bucket").parquet(f"{table.at}/counts")
    q = spark.createDataFrame([(1, 0, "land")], "query_id long, tenant_id long, query string")
    assert [(i, s) for _, _, i, s in found(table.search(q))] == [(1, 1.0)]


def test_empty(spark):
    table = postings.create(spark.createDataFrame([], ITEMS), buckets=2)
    assert table.search(spark.createDataFrame(QUERIES, "query_id long, tenant_id long, query string")).collect() == []
