import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from paperlode.llm import token_store as S
from paperlode.llm.token_ids import vocabulary

from .test_token_ids import TEXTS


@pytest.mark.parametrize("high", [1, 2, 9, 300, 49408, 65536, 2**32])
@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_round_trip(n, high):
    r = np.random.default_rng(n + high)
    ids = r.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[::17] = r.integers(0, min(high, 4), len(ids[::17]))
    seg = S.Segment(S.encode_segment(ids))
    assert (seg.ids() == ids).all()
    for _ in range(20):
        a, b = sorted(r.integers(0, n + 1, 2))
        assert (seg.ids(int(a), int(b)) == ids[a:b]).all()


def test_outliers_are_patched_not_widened():
    ids = np.full(1280, 7, np.uint32)
    ids[5] = 40000
    seg = S.Segment(S.encode_segment(ids))
    assert seg.width.max() == 0 and len(seg.value) == 1 and (seg.ids() == ids).all()


def test_files_against_the_library(spark, tmp_path):
    path, r = vocabulary("word_bpe_49k.json"), random.Random(8)
    rows = [(i * 7 % 101, t) for i, t in enumerate(TEXTS)] + [(200 + i, " ".join(r.choices(["Alpha", "beta,", "x1", "ñandú"], k=r.randrange(50)))) for i in range(80)] + [(300, "same"), (300, "same"), (None, "no id")]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in rows], "doc_id long, text string, payload string, shard string")
    to = f"file://{tmp_path}/ids"
    S.write_ids(df, to, path, end_id=1, segment_ids=50)
    tok = Tokenizer.from_file(path)
    got = sorted(S.read_ids(spark, to, with_ids=True).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == [x[0] for x in sorted(rows, key=lambda x: (x[0] is not None, x[0]))]
    at, texts = 0, {}
    for i, t in rows:
        texts.setdefault(i, []).append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    for x in got:
        assert x.start == at and bytes(x.ids) in texts[x.doc_id] and x.n_tokens == len(x.ids) // 4 and x.ids_crc32 == zlib.crc32(x.ids)
        at += x.n_tokens


def test_empty_table(spark, tmp_path):
    S.write_ids(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none", vocabulary("word_bpe_49k.json"), 1)
    assert S.read_ids(spark, f"file://{tmp_path}/none").collect() == []
