import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from paperlode.llm import packing
from paperlode.llm.token_ids import vocabulary


def check_plan(counts, capacity):
    used, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in packing.plan(counts, capacity):
        ranks[length] += range(rank, rank + n)
        for s in range(first, first + n):
            used[s].append((offset, length))
    for length, n in counts.items():
        assert sorted(ranks[length]) == list(range(n))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def best_fit(counts, capacity):
    free = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [(f, i) for i, f in enumerate(free) if f >= length]
            if fits:
                free[min(fits)[1]] -= length
            else:
                free.append(capacity - length)
    return len(free)


def test_plan_is_best_fit_decreasing():
    r = random.Random(3)
    for capacity in (1, 5, 16, 40):
        for _ in range(40):
            counts = {k: r.randrange(1, 30) for k in r.sample(range(1, capacity + 1), r.randrange(1, min(capacity, 12) + 1))}
            n = check_plan(counts, capacity)
            assert n <= best_fit(counts, capacity) * 1.02 + 1
            assert n >= -(-sum(k * v for k, v in counts.items()) // capacity)
    assert packing.plan({}, 8) == []


def test_plan_does_not_follow_the_counts():
    r = random.Random(4)
    counts = {k: r.randrange(1, 50) for k in range(1, 1025)}
    small, large = packing.plan(counts, 1024), packing.plan({k: v * 10**6 for k, v in counts.items()}, 1024)
    assert len(large) < 20 * len(small) + 20_000


def test_pack_against_the_library(spark):
    path, r = vocabulary("byte_bpe_50k.json"), random.Random(9)
    rows = [(0, None), (1, ""), (2, "word"), (None, "no id"), (3, "twice"), (3, "twice"), (4, "long text " * 300)]
    rows += [(i, " ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(1, 90)))) for i in range(5, 120)]
    df = spark.createDataFrame([(i, t, 5, "c") for i, t in rows], "doc_id long, text string, length int, part string")
    got = packing.pack(df, path, capacity=64, end_id=2, with_ids=True).collect()
    tok, want = Tokenizer.from_file(path), []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 64 or 64
        cuts = [0, *range(head, len(ids) + 1, 64)]
        want += [(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), np.array(ids[a:b], "<u4").tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32, bytes(x.ids)) for x in got), key=str) == sorted(want, key=str)
    rooms = defaultdict(list)
    for x in got:
        rooms[x.sequence_id].append((x.offset, x.length))
    for parts in rooms.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_ranks_span_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 3)
    df = spark.createDataFrame([(i, "a") for i in range(100)], "doc_id long, text string")
    got = packing.pack(df, vocabulary("byte_bpe_50k.json"), capacity=8).collect()
    assert len({(x.sequence_id, x.offset) for x in got}) == 100 and len({x.sequence_id for x in got}) == 25


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), vocabulary("byte_bpe_50k.json")).collect() == []
