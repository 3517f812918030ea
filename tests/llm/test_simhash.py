import random

import pytest
import xxhash

from paperlode.llm import simhash as M


def slow_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, distance=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_equals_brute_force(spark):
    r = random.Random(5)
    base = [[f"t{r.randrange(3000)}" for _ in range(300)] for _ in range(12)]
    rows = [(900, None), (901, ""), (902, "  \n"), (903, "One"), (904, "one"), (905, "a b c"), (906, "a b c"), (None, "x y z q r"), (None, "x y z q r")]
    for i in range(150):
        w = list(base[i % 12])
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(7, rows[16][1])]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    assert sorted(map(tuple, M.near_duplicates(df).collect()), key=str) == slow_components(rows)


@pytest.mark.parametrize("n", [10, 10**5, 10**7, 10**9])
def test_some_mask_agrees(n):
    r, masks = random.Random(n), M.block_masks(n, 4)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_long_and_short_texts_agree_with_the_plain_rule():
    for n in (1, 3, 4, 5, 399, 402, 403, 404, 5000):
        text = " ".join(f"W{i * i % 977}" for i in range(n))
        assert M.fingerprint(text, 4) == slow_fingerprint(text)


def test_chain_of_links_without_common_hub(spark):
    fps = [0]
    for i in range(12):
        fps.append(fps[-1] ^ (0xF << (4 * i)))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert {r.root for r in M.links(df).collect()} == {min(fps)}


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
