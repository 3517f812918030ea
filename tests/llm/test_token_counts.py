import random

import sentencepiece
from tokenizers import Tokenizer

from paperlode.llm import token_counts
from paperlode.llm.token_ids import vocabulary

from .test_token_ids import TEXTS


def test_equals_the_library(spark):
    path, r = vocabulary("byte_bpe_50k.json"), random.Random(2)
    texts = TEXTS + ["".join(r.choice(" \n\t.,'abE9é \x1c\x85²́") for _ in range(60)) for _ in range(400)] + ["x<|endoftext|><|endoftext|>", "the and of " * 5000]
    rows = [(i if i else None, t, "c") for i, t in enumerate(texts)] + [(5, texts[5], "c")]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_bytes string"), path).collect()
    tok = Tokenizer.from_file(path)
    want = []
    for i, t, _ in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert sorted((tuple(x)[:4] for x in got), key=str) == sorted(want, key=str)


def test_every_code_point(spark):
    path = vocabulary("byte_bpe_50k.json")
    count = token_counts._counter(path, token_counts.prove_whole(path))
    tok = Tokenizer.from_file(path)
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    for glue in ("a{0}b", " {0} .", "1{0}", ".{0}"):
        texts = [glue.format(c) for c in points]
        assert [t for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)) if count(t)[0] != len(e.ids)] == []


def test_proof_holds_and_is_wide():
    path = vocabulary("byte_bpe_50k.json")
    whole = token_counts.prove_whole(path)
    tok = Tokenizer.from_file(path)
    assert " the" in whole and "the" in whole and "<|endoftext|>" not in whole
    assert len(whole) > 45_000
    assert all(len(tok.encode(t, add_special_tokens=False).ids) == 1 for t in list(whole)[:2000])


def test_sentencepiece_model(spark):
    path = vocabulary("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "Hello there, world"), (2, None)], "doc_id long, text string")
    got = {x.doc_id: x.n_tokens for x in token_counts.count_tokens(df, path).collect()}
    assert got == {1: len(sentencepiece.SentencePieceProcessor(model_file=path).encode("Hello there, world")), 2: 0}


def test_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), vocabulary("byte_bpe_50k.json")).collect() == []
