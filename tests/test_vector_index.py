import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlode.operators import graph, search, vector_index

SCHEMA = "tenant_id long, item_id long, embedding array<double>"


def clustered(n=1500, dim=24, groups=30, spread=0.25, seed=4):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((groups, dim))
    return centre[r.integers(0, groups, n)] + spread * r.standard_normal((n, dim))


def table(spark, x, tenants=2):
    return spark.createDataFrame([(i % tenants, i, v.tolist()) for i, v in enumerate(x)], SCHEMA)


def nearest(x, k, every, tenants=2):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in range(0, len(x), every):
        own = np.arange(i % tenants, len(x), tenants)
        s = np.round(u[own] @ u[i], 6)
        out[i] = [(int(own[j]), float(s[j])) for j in np.lexsort((own, -s))[:k]]
    return out


def asked(df, every):
    return df.filter(f"item_id % {every} = 0").selectExpr("item_id AS query_id", "0 AS variant", "tenant_id", "embedding")


def got(leg):
    out = {}
    for r in leg.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(rows)] for q, rows in out.items()}


@pytest.mark.parametrize("x", [clustered(), np.random.default_rng(1).standard_normal((700, 8)), np.ones((40, 3)), clustered()[:3]], ids=["clustered", "isotropic", "equal", "few"])
def test_exact_search_equals_brute_force(spark, x):
    df = table(spark, x)
    assert got(search.vector_leg(asked(df, 7), df)) == nearest(x, 20, 7)


def test_exact_search_leaves_lists_out(spark):
    x = clustered(3000, 24, 40, 0.15)
    df = table(spark, x)
    index = vector_index.build(df)
    scored = index.search(asked(df, 50), 20)
    assert "list=" in "".join(r.f for r in index.items.select(F.input_file_name().alias("f")).limit(1).collect())  # partitioned by centroid
    q = asked(df, 50).select("query_id", "variant", "tenant_id", vector_index.unit(df.embedding).alias("u"))
    assert index.share_of(index.nearby(q, 0.1)) < 0.15
    assert got(search.ranked(scored.selectExpr("query_id", "variant", "item_id", "round(s, 6) AS score"), ["query_id", "variant"])) == nearest(x, 20, 50)
    assert index.share_of(index.within(q, 0.92)) < 0.2


def test_approximate_search_by_share(spark):
    x = clustered(3000, 24, 40, 0.4)
    df = table(spark, x)
    leg = search.vector_leg(asked(df, 30), df, exact=False, share=0.2)
    want, have = nearest(x, 20, 30), got(leg)
    recall = np.mean([len({i for i, _ in want[q]} & {i for i, _ in have[q]}) / 20 for q in want])
    assert recall >= 0.9


def test_near_pairs_lose_none(spark):
    x = clustered(600, 16, 60, 0.12)
    x[300:320] = x[0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = set()
    for i in range(len(x)):
        near = sorted((-round(s[i, j], 6), j) for j in range(i % 2, len(x), 2) if j != i and s[i, j] >= 0.92 and j % 11)
        want |= {(i, j) for _, j in near[:10]}
    df = table(spark, x).selectExpr("tenant_id", "item_id AS doc_id", "embedding AS e", "item_id % 11 <> 0 AS can_match")
    assert {(r.doc_id, r.other_id) for r in graph.fuzzy_duplicates(df).collect()} == want and len(want) > 500


def test_null_zero_and_no_vectors(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, [0.0, 0.0]), (1, 3, [1.0, 2.0]), (2, 4, [1.0, 2.0])], SCHEMA)
    assert got(search.vector_leg(df.selectExpr("item_id AS query_id", "0 AS variant", "tenant_id", "embedding"), df)) == {3: [(3, 1.0)], 4: [(4, 1.0)]}
    none = df.limit(0)
    assert search.vector_leg(none.selectExpr("item_id AS query_id", "0 AS variant", "tenant_id", "embedding"), none).collect() == []
