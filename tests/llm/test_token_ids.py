import random

import numpy as np
import pytest

from paperlode.llm.token_ids import IdEncoder, vocabulary

TEXTS = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a \n b", "\n\na", "it's 'S don't we'll 'tis", "x<|endoftext|>y <|startoftext|>", "½ ²x 3x4 naïve ÉCOLE İstanbul Σίσυφος ΣΑΣ",
    "tab\tand\x0bmore\x0c\r\nends", "nb\xa0sp wide　x y", "a\x1cb\x1dc\x1e\x1fd", "\U0001f600 emoji\U0001f600\U0001f600", "é combining ́alone", "A" * 500, "ab " * 400,
    "%%% !!! &&& *** ,,, a,%%% b.*** c$$$ _x_ __ 'quoted' ''", "\x85next​zero᠎vowel﻿bom", "日本語 テキスト 한국어 العربية हिन्दी", "end \n", "end\n", "a ²b ¼c", "ﬁ ǅ ŉ ß ẞ",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_equals_the_library(name):
    e = IdEncoder(vocabulary(name), cap=300)
    r = random.Random(1)
    letters = "abcdefghijklmnoprstuvéèñüßÀÉ"
    made = ["".join(r.choice(letters) for _ in range(r.randrange(1, 12))) + r.choice(["", "", ",", ".", "%%%", "'s", "'ll", "!?", "9"]) for _ in range(3000)]
    texts = TEXTS + [r.choice([" ", "\n", "  "]).join(r.choices(made, k=60)) for _ in range(60)]
    texts += ["".join(r.choice(" \n\t.,'ab9é \x1c\x85²") for _ in range(40)) for _ in range(400)]
    want = [e.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for at in range(0, len(texts), 50):
        got = [np.frombuffer(b, "<u2").tolist() for b in e.encode(texts[at : at + 50])]
        for t, g, w in zip(texts[at : at + 50], got, want[at : at + 50]):
            assert g == w, repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cuts_before_white_space_at_every_code_point(name):
    e = IdEncoder(vocabulary(name))
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    for glue in ("{0}", "a{0}", "{0}b", "a{0}b", "a {0}", "{0} b", ".{0}.", "1{0}"):
        texts = [glue.format(c) for c in points]
        want = [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
        got = [np.frombuffer(b, "<u2").tolist() for b in e.encode(texts)]
        assert [t for t, g, w in zip(texts, got, want) if g != w] == []
