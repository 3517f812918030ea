import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from paperlode.llm import substring_dedup as S


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[j : j + window]) for _, w in words for j in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = True
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60, vocabulary=40):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(vocabulary)]
    shared = [" ".join(r.choices(v, k=r.choice([10, 11, 12, 14, 30]))) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "a " * 60), (4, "a " * 7 + "b " + "a " * 12), (5, "a b " * 40), (6, "x"), (7, "a b c " * 9), (7, "a b c " * 9), (8, "one text under one id " * 4), (8, "another text under one id " * 3), (None, "no id at all here " * 5), (None, "no id at all here " * 5)]
    for i in range(9, n):
        parts = [" ".join(r.choices(v, k=r.randrange(0, 40))) for _ in range(3)]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(3), r.choice(shared))
        rows.append((i, "\n".join(parts)))
    return rows


@pytest.mark.parametrize("seed,window", [(1, 12), (2, 12), (3, 35), (4, 5)])
def test_equals_brute_force(spark, seed, window):
    rows = corpus(seed, vocabulary=3 if seed == 2 else 40)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, k int, spans string")
    got = sorted(map(tuple, S.remove_repeats(df, window).collect()), key=str)
    assert got == brute(rows, window)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_text_kept_as_it_was_where_nothing_goes(spark):
    df = spark.createDataFrame([(1, "a  b\nc", "s", 0), (2, None, "s", 0), (3, "p q r s t u", None, 9), (4, "z p q r s t u", "s", 0), (None, "y y", "s", 0)], "doc_id long, text string, spans string, n_chars long")
    got = {tuple(r) for r in S.strip_repeats(df, 6).collect()}
    assert got == {(1, "a  b\nc", "s", 6), (2, None, "s", None), (3, "", None, 0), (4, "z", "s", 1), (None, "y y", "s", 3)}


def test_every_window_is_stood_for_by_its_own_words():
    rng = np.random.default_rng(0)
    names = S._mix(rng.integers(0, 6, 3000).astype(np.uint64) + np.uint64(1))
    doc, bounds = np.zeros(3000, np.int64), np.array([0, 3000])
    _, _, first, last, lone = S.represent(names, doc, bounds, 20)
    held = np.zeros(3000, bool)
    for a, b in zip(first, last):
        held[a : b + 1] = True
    held[lone] = True
    assert held[: 3000 - 19].all()


def test_many_rows_without_ids_repeated_ids_and_long_windows(spark):
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(None, f"{r.randrange(10**9)} {passage} {i}") for i in range(10_000)] + [(None, f"s{i} t{i}") for i in range(10_000)]
    rows += [(5, f"q{i} " * 3 + passage) for i in range(200)] + [(6, f"u{i} " * 50) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.remove_repeats(df, 35).collect()), key=str) == brute(rows, 35)
    long = [f"z{i}" for i in range(400)]
    rows = [(1, " ".join(long)), (2, "a " + " ".join(long[:300])), (3, " ".join(long[:299])), (4, "one " * 700), (4, "two " * 301)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.remove_repeats(df, 300).collect()), key=str) == brute(rows, 300)
