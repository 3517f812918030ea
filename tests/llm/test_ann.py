import numpy as np
import pytest

from paperlode.llm import ann


def brute(rows, every, k):
    ok = {}
    for i, e in rows:
        if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            ok.setdefault(i, []).append(np.array(e, float))
    flat = [(i, e) for i, es in ok.items() for e in {tuple(x): x for x in es}.values()]
    out = {}
    for i, q in flat:
        if i % every == 0:
            s = sorted((-float((q * e).sum()), j) for j, e in flat if j != i and len(e) == len(q))
            out[i] = [(r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return out


def as_lists(df):
    out = {}
    for x in sorted(df.collect(), key=lambda x: (x.query_id, x.rank)):
        out.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2.0) for i, e in rows], "vec_id long, embedding array<float>, rank int, score double")


def test_all_buckets_visited_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 5)]) for i in range(160)]
    rows += [(200 + i, [1.0, 2.0, 0.0, 0.0, 1.0]) for i in range(60)]
    rows += [(300, None), (320, []), (340, [0.0] * 5), (360, [1.0, None, 0.0, 0.0, 0.0]), (380, [float("nan")] * 5), (400, [float("inf")] * 5), (None, [1.0] * 5), (420, [1.0, 2.0]), (421, [2.0, 1.0]), (20, rows[20][1]), (440, [7.0])]
    plan = ann.Plan(tables=2, hashes=1, width=100.0, probes=3, part_rows=50, together=3)
    got, want = as_lists(ann.nearest(table(spark, rows), 20, 20, plan)), brute(rows, 20, 20)
    assert set(want) - set(got) == {440}
    for q in got:
        assert [x[:2] for x in got[q]] == [x[:2] for x in want[q]], q
        assert np.allclose([x[2] for x in got[q]], [x[2] for x in want[q]], rtol=1e-14, atol=0)


def recall(got, want):
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items() if x}
    return np.mean([len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) / len(want[q]) for q in want if want[q]])


def lengths(kind, r, n):
    return {"equal": np.ones(n), "near": 50 * r.uniform(0.9, 1, n), "lognormal": r.lognormal(0, 0.7, n), "outlier": np.where(np.arange(n) == 7, 100.0, 1.0)}[kind]


@pytest.mark.parametrize("kind", ["equal", "near", "lognormal", "outlier"])
def test_recall(spark, kind):
    r = np.random.default_rng(4)
    x = r.standard_normal((3000, 64))
    x *= (lengths(kind, r, 3000) / np.linalg.norm(x, axis=1))[:, None]
    rows = list(enumerate(x.astype(np.float32).tolist()))
    assert recall(as_lists(ann.nearest(table(spark, rows))), brute(rows, 20, 20)) >= 0.9


@pytest.mark.parametrize("n", [1, 15, 22, 25])
def test_small_tables_give_all_there_is(spark, n):
    r = np.random.default_rng(n)
    rows = list(enumerate(r.standard_normal((n, 64)).astype(np.float32).tolist()))
    got, want = as_lists(ann.nearest(table(spark, rows))), brute(rows, 20, 20)
    assert n == 1 and not got or recall(got, want) >= 0.9


def test_a_hot_bucket_is_dealt_in_pieces(spark):
    r = np.random.default_rng(2)
    near = np.ones((900, 8)) + 1e-3 * r.standard_normal((900, 8))
    rows = list(enumerate(np.vstack([near, r.standard_normal((100, 8))]).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plan = ann.Plan(part_rows=200, together=7)
    assert recall(as_lists(ann.nearest(df, plan=plan)), brute(rows, 20, 20)) >= 0.99


def test_probes_start_at_home_and_never_cross_both_sides():
    sets = ann.probe_order(6, 200)
    assert sets[0] == () and len(set(sets)) == 200
    assert all(11 - x not in s for s in sets for x in s)


def test_empty_table(spark):
    assert ann.nearest(table(spark, [])).collect() == []


@pytest.mark.parametrize("dim, n", [(256, 1000), (1024, 300)])
def test_recall_of_more_dimensions(spark, dim, n):
    r = np.random.default_rng(6)
    x = r.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(enumerate(x.astype(np.float32).tolist()))
    assert recall(as_lists(ann.nearest(table(spark, rows))), brute(rows, 20, 20)) >= 0.9


def test_unit_vectors_are_one_band(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((400, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True).astype(np.float32)
    norms = np.linalg.norm(x.astype(np.float64), axis=1)
    assert norms.min() < 1 < norms.max() and len(set(np.floor(2 * np.log2(norms) + 0.5))) == 1


def test_clusters_need_few_probes_and_a_small_share():
    r = np.random.default_rng(2)
    x = r.standard_normal((40, 64))[r.integers(0, 40, 1500)] + 0.3 * r.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert ann.needed_probes(ann.Plan(), x, {0: 1.0}, np.zeros(len(x), int), 20) == ann.PROBES[0]
    h = ann.Hasher(ann.Plan(probes=ann.PROBES[0]), 64)
    keys = h.keys(ann._unit(x, 1.0))
    share = np.mean([np.isin(keys[:, 0], h.probed(ann._directions(q[None]))[0, 0]).mean() for q in x[:40]])
    assert share < 0.8
