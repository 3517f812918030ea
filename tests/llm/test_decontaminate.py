import random

import pytest

from paperlode.llm import decontaminate as D


def edits(a, b):
    """Least edits from a to any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j - 1] + (x != y), row[j] + 1, now[-1] + 1))
        row = now
    return min(row)


@pytest.mark.parametrize("seed", range(4))
def test_myers_against_dynamic_programming(seed):
    r = random.Random(seed)
    for _ in range(60):
        a = "".join(r.choice("abc ") for _ in range(r.randrange(1, 90)))
        b = "".join(r.choice("abc ") for _ in range(r.randrange(0, 160)))
        distance, end = D.myers(D.masks(a), len(a), b)
        assert distance == edits(a, b)
        if end:
            assert edits(a, b[:end]) == distance


def test_pieces_make_up_the_item():
    for m in (1, 2, 7, 100):
        for k in range(m):
            parts = D.pieces("x" * m, k)
            assert len(parts) == k + 1 and all(p for _, p in parts) and "".join(p for _, p in parts) == "x" * m


def spoil(r, text, n):
    t = list(text)
    for _ in range(n):
        i, how = r.randrange(len(t)), r.randrange(3)
        if how == 0:
            t[i] = r.choice("abcdef")
        elif how == 1:
            del t[i]
        else:
            t.insert(i, r.choice("abcdef"))
    return "".join(t)


@pytest.mark.parametrize("block_chars", [4_000_000, 900])
def test_equals_brute_force(spark, block_chars):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)] + [(12, None), (13, ""), (14, "Hi!"), (3, "ab cd")]
    items[7] = (7, items[0][1] + " tail")
    docs = [(0, None), (1, ""), (2, "... hi ..."), (None, items[1][1]), (3, items[2][1].upper().replace(" ", ",\n")), (3, items[2][1])]
    for i in range(4, 60):
        parts = [" ".join(word() for _ in range(20)) for _ in range(2)]
        for _ in range(r.randrange(3)):
            parts.insert(1, spoil(r, r.choice(items[:12])[1], r.randrange(0, 16)))
        docs.append((i, " ".join(parts)))
    got = D.find_leaks(
        spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int"),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"), block_chars=block_chars,
    ).collect()
    want = []
    for i, t in docs:
        for j, u in items:
            a, b = D.normal(u), D.normal(t)
            if a and b and edits(a, b) <= D.budget(len(a), 0.06):
                want.append((i, j, edits(a, b)))
    assert sorted(((x.doc_id, x.item_id, x.distance) for x in got), key=str) == sorted(want, key=str)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(D.normal(t))
    for x in got:
        assert any(edits(a, t[x.start : x.end]) == x.distance for a in (D.normal(u) for j, u in items if j == x.item_id) for t in texts[x.doc_id])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert D.find_leaks(none, items).collect() == []
    assert D.find_leaks(items.withColumnRenamed("item_id", "doc_id"), none.withColumnRenamed("doc_id", "item_id")).collect() == []
