import hashlib
import zlib

import pytest

from paperlode.llm import merkle as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level, i):
    """The siblings of the i-th node, with their side, up to the root; and the root."""
    path = []
    while len(level) > 1:
        j = i ^ 1
        path.append((None, "") if j >= len(level) else ("left" if j < i else "right", level[j]))
        level, i = [sha("".join(level[k : k + 2])) for k in range(0, len(level), 2)], i // 2
    return path, level[0]


def slow(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subroots = [climb([leaf(r) for r in by[x]], 0)[1] for x in order]
    out = []
    for k, x in enumerate(order):
        leaves = [leaf(r) for r in by[x]]
        for i, r in enumerate(by[x]):
            path = climb(leaves, i)[0]
            over, root = climb(subroots, k)
            path = path + over
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf((r[0], r[1], r[2], r[3] + 1, r[4])) if bad else leaves[i]
            for side, s in path:
                h = sha(s + h if side == "left" else h + s)
            out.append((r[0], leaves[i], subroots[k], root, sha("".join(s for _, s in path)), h, h == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, t int, n string"


def run(spark, rows):
    got = M.manifest(spark.createDataFrame([(*r, "x", 5, "y") for r in rows], SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=str)


def table():
    rows = [(i, f"src{i % 3}", ["en", "en", "en", "dé", "z"][i % 5], i * 7, f"text é {i}" * (i % 9)) for i in range(1500)]
    rows += [(5000, "s", "alone", 1, "only one of its lang"), (None, None, None, None, None), (None, "s", None, 3, ""), (7, "s", None, None, "tie"), (7, "s", None, None, "tie"), (7, "t", None, 2**63 - 1, "tie")]
    rows += [(14, "s", "en", None, None), (9001, "s", "", 0, "x" * 200_000)]
    return rows


def test_equals_brute_force(spark):
    got = run(spark, table())
    assert got == slow(table())
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("n", [1, 3, 1024, 1025])
def test_sizes_around_blocks(spark, n):
    rows = [(i, "s", "en", 1, "t") for i in range(n)]
    assert run(spark, rows) == slow(rows)


def test_shuffled_rounds_agree(spark, monkeypatch):
    monkeypatch.setattr(M, "FEW_ROWS", 0)
    assert run(spark, table()[1200:]) == slow(table()[1200:])


def test_narrow_bands_agree(spark, monkeypatch):
    monkeypatch.setattr(M, "BAND", 3)
    assert run(spark, table()[:300]) == slow(table()[:300])


def test_empty_table(spark):
    assert run(spark, []) == []
