import random

import corpus_pipeline as P
from paperlode.llm import decontaminate, substring_dedup

from .test_simhash import slow_components
from .test_substring_dedup import brute


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_each_stage_against_brute_force(spark, tmp_path):
    r = random.Random(2)
    w = lambda n: " ".join(f"v{r.randrange(900)}" for _ in range(n))
    shared, item = w(60), w(25)
    rows = [(i, w(r.randrange(40, 120))) for i in range(120)]
    rows += [(200 + i, rows[i][1] + (" vile nasty" if i % 2 else " awful vile horrid")) for i in range(0, 40)]
    rows += [(300 + i, w(50) + " " + shared + " " + w(50)) for i in range(3)] + [(310, w(40) + " " + item.upper() + " " + w(40)), (320, rows[5][1]), (321, rows[5][1]), (330, None), (331, ""), (5, rows[5][1])]
    docs = make(spark, rows)
    d = f"file://{tmp_path}"
    spark.createDataFrame([(i, int(200 <= i < 300)) for i, _ in rows if i % 3], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs.write.parquet(f"{d}/documents.parquet")

    clean = P.drop_toxic(spark, docs, d)
    ids = {x.doc_id for x in clean.collect()}
    assert ids == {i for i, _ in rows if not 200 <= i < 300} and clean.columns == docs.columns
    clean.write.parquet(f"{d}/1")
    clean = spark.read.parquet(f"{d}/1")

    kept = P.drop_near_copies(spark, clean, d)
    assert kept.columns == docs.columns
    kept.write.parquet(f"{d}/2")
    kept = spark.read.parquet(f"{d}/2")
    want = {c for _, _, c in slow_components_five([(x.doc_id, x.text) for x in clean.collect()])}
    assert sorted(x.doc_id for x in kept.collect()) == sorted(want)

    left = P.drop_repeated_passages(spark, kept, d)
    assert left.columns == docs.columns
    left.write.parquet(f"{d}/3")
    left = spark.read.parquet(f"{d}/3")
    got = {x.doc_id: x for x in substring_dedup.remove_repeats(kept).collect()}
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got.values()), key=str) == brute([(x.doc_id, x.text) for x in kept.collect()], 35)
    assert all(len((x.text or "").split()) == got[x.doc_id].n_words - got[x.doc_id].n_removed and x.n_chars == (None if x.text is None else len(x.text)) for x in left.collect())
    assert not any(shared in (x.text or "") for x in left.collect())

    safe = P.drop_benchmark_leaks(spark, left, d)
    assert {x.doc_id for x in left.collect()} - {x.doc_id for x in safe.collect()} == {310} and safe.columns == docs.columns
    packed = P.run(spark, d).collect()
    assert {x.doc_id for x in packed} == {x.doc_id for x in safe.collect()}


def slow_components_five(rows):
    from . import test_simhash as T

    plain = T.slow_fingerprint
    try:
        T.slow_fingerprint = lambda text, k=5: plain(text, 5)
        return slow_components(rows)
    finally:
        T.slow_fingerprint = plain


def test_filters_keep_odd_rows(spark):
    odd = make(spark, [(None, None), (None, "a b"), (1, ""), (1, "x y z")])
    items = spark.createDataFrame([(1, "some words that stand nowhere")], "item_id long, text string")
    assert decontaminate.keep_clean(odd, items).count() == 4
    # rows without words are one group, as are the rows without an id of another
    assert P.drop_near_copies(spark, odd, "").count() >= 2
    assert P.drop_near_copies(spark, odd.limit(0), "").count() == 0
