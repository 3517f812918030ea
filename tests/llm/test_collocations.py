import random
import re
from collections import Counter

import numpy as np
import pytest

from paperlode.llm import collocations as M


def slow(rows, least, longest=5, top=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    often = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    dropped = set()
    for (lang, p), a in often.items():
        for s in range(2, len(p)):
            for i in range(len(p) - s + 1):
                if (lang, p[i : i + s]) in often and a >= often[lang, p[i : i + s]]:
                    dropped.add((lang, p[i : i + s]))
    out = {}
    for (lang, p), a in often.items():
        if (lang, p) not in dropped:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def texts(n=400):
    r = random.Random(3)
    common = [f"w{i}" for i in range(12)] + ["Élan", "x y", "A", "a"]
    for i in range(n):
        words = [r.choice(common) if r.random() < 0.8 else f"rare{r.randrange(5000)}" for _ in range(r.randrange(0, 60))]
        text = r.choice(["", "the quick brown fox jumps over "]) + "".join(w + r.choice([" ", " ", " ", "\t", ", ", ".", "\n", "\r\n", "  "]) for w in words)
        yield text, r.choice(["en", "en", "en", "de", None])


@pytest.mark.parametrize("sizes", [{}, {"part_bytes": 2_000, "tile_entries": 50}, {"part_bytes": 1}])
def test_equals_brute_force(spark, sizes):
    rows = [*texts(60 if sizes.get("part_bytes") == 1 else 400), (None, "en"), ("", None), ("one", "fr"), ("na na na na na na na " * 40, "en"), ("x y . " * 30, "es")]
    df = spark.createDataFrame([(t, lang, 7, "p", None) for t, lang in rows], "text string, lang string, rank int, phrase string, doc_id long").repartition(3)
    got = M.collocations(df, least=20, **sizes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == slow(rows, 20)


def test_top_and_long_text(spark):
    r = random.Random(9)
    rows = [(" ".join(f"v{min(r.randrange(40), r.randrange(40))}" for _ in range(60_000)), "en"), ("v1 v2 v3", "en")]
    got = M.collocations(spark.createDataFrame(rows, "text string, lang string"), least=30, top=50, tile_entries=100)
    assert sorted(map(tuple, got.collect())) == slow(rows, 30, top=50)


def test_tiles_deal_every_pair_once_and_stay_small():
    i, j = np.meshgrid(np.arange(300), np.arange(300), indexing="ij")
    tiles = M.tile_of(i.ravel(), j.ravel(), 4)
    f = 1 / (1 + i.ravel()) / (1 + j.ravel())  # by Zipf's law
    share = np.bincount(np.unique(tiles, return_inverse=True)[1], weights=f) / f.sum()
    assert share.max() < 0.07


def test_sparse_and_dense_sums_agree(monkeypatch):
    r = np.random.default_rng(1)
    codes = r.integers(0, 50, 4000) << 32 | r.integers(100, 5000, 4000)
    counts = r.integers(1, 9, 4000)
    dense = M.tile_sums(codes, counts)
    monkeypatch.setattr(M, "DENSE_CELLS", 0)
    sparse = M.tile_sums(codes, counts)
    assert all((a == b).all() for a, b in zip(dense, sparse)) and sparse[1].sum() == counts.sum()


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_000, 4_000_000_000_000, 3_000_000_000_000, 3_500_000_000_000)], "a long, n long, l long, r long")
    got = df.selectExpr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(15,0)) * CAST(n AS DECIMAL(15,0))) DIV (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0))) AS s").first().s
    assert got == 1000 * 3_000_000_000_000 * 4_000_000_000_000 // (3_000_000_000_000 * 3_500_000_000_000)


def test_nothing_frequent_and_empty_table(spark):
    assert M.collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).collect() == []
    assert M.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
