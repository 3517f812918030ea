import random

import numpy as np

from paperlode.llm import toxicity as T


def corpus(n, seed=0):
    r = random.Random(seed)
    plain, bad = [f"word{i:03d}x" for i in range(400)], ["vile", "nasty", "horrid", "awful"]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        words = r.choices(plain, k=r.randrange(5, 600))
        for _ in range(r.randrange(1, 5) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad).title() + ",")
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t, _ in rows] + [(None, "vile nasty horrid awful", 0, "x"), (5000, None, 0, "x"), (5001, "", 0, "x"), (5002, "...", 0, "x"), (7, rows[7][1], 0, "x")], "doc_id long, text string, toxic int, grade string")
    labels = spark.createDataFrame([(i, x, 1) for i, _, x in rows[:1000]] + [(None, 1, 1), (3, None, 1), (0, 0, 1)], "doc_id long, toxic int, text int")
    got = T.score(docs, T.fit_toxicity(docs, labels)).collect()
    assert len(got) == 1505
    by = {x.doc_id: x for x in got}
    held = [(by[i].toxic, bool(x)) for i, _, x in rows[1000:]]
    assert np.mean([a == b for a, b in held]) > 0.99
    assert by[None].toxic and by[None].grade == 2 and not any(by[i].toxic for i in (5000, 5001, 5002))
    assert all(0 <= x.expected_severity <= 2 and 0 <= x.p_toxic <= 1 for x in got)


def test_thresholds_are_ordered_and_shared():
    r = np.random.default_rng(1)
    rows = [[int(f) for f in r.integers(10, 60, 8)] + [1] * int(k) for k in r.integers(0, 4, 900)]
    grades = np.array([row.count(1) for row in rows])
    m = T.fit(T.rows_of(rows), grades, penalty=0.001)
    assert m.thresholds == sorted(m.thresholds) and len(m.thresholds) == 3
    e, p = m.severity(np.array([m.weights.get(1, 0) * k for k in range(4)]))
    assert list(e) == sorted(e) and e[0] < 0.6 and e[3] > 2.2 and p[0] < 0.5 < p[3]


def test_no_graded_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [(x.expected_severity, x.toxic) for x in T.score(docs, T.fit_toxicity(docs, labels)).collect()] == [(0.0, False)] * 2
    assert T.score(docs.limit(0), T.fit_toxicity(docs, labels.limit(0))).collect() == []


def test_fit_stays_small_beside_its_rows():
    import tracemalloc

    r = np.random.default_rng(1)
    n, each = 3000, 1500
    index = np.concatenate([np.sort(r.choice(6000, each, False)) for _ in range(n)]).astype(np.int32)
    rows = T.Rows(index, np.ones(len(index), np.int8), np.arange(n + 1) * each)
    toxic = (np.arange(n) % 4 == 0).astype(np.int64)
    tracemalloc.start()
    model = T.fit(rows, T.severity_grades(rows, toxic), rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.thresholds) >= 1
    assert peak < 3 * (index.nbytes + len(index)) + 6 * 8 * T.FEATURES, peak  # the rows a few times, and what has one number a feature


def test_blocks_of_rows_give_whole_sums(monkeypatch):
    lists = [[1, 1, 2], [], [5], [2, 5, 5, 7], [], [9] * 3, []]
    rows = T.rows_of(lists)
    w = np.arange(10, dtype=float)
    monkeypatch.setattr(T, "ENTRIES_EACH", 2)
    assert rows.dot(w).tolist() == [float(sum(x)) for x in lists]
    assert rows.back(np.arange(1.0, 8.0), 10).tolist() == [float(sum((i + 1) * x.count(f) for i, x in enumerate(lists))) for f in range(10)]
    kept = rows.only(np.isin(np.arange(T.FEATURES), [2, 5]))
    assert (kept.index.tolist(), kept.begin.tolist()) == ([0, 1, 0, 1], [0, 1, 1, 2, 4, 4, 4, 4])
    assert rows.counts(np.arange(7) > 0)[:10].tolist() == [0, 0, 1, 0, 0, 2, 0, 1, 0, 1]
