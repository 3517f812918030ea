"""Token counts by the whole-token shortcut.

Offline, each vocabulary string is encoded alone; those that come out as the one token they are, and that the
pre-tokenizer leaves whole, are proven. In a text, pre-tokens that are proven count one each; only the rest is merged.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Memo, held
from .token_ids import groups

#: The byte-level pre-tokenizer's pattern, a fixed value of the vocabulary, with white space written out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def prove_whole(path: str) -> frozenset[str]:
    """The vocabulary strings that encode alone as one token, themselves. Bounded by the vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    pattern, ids, texts = regex.compile(PATTERN), [], []
    for token, i in tok.get_vocab().items():
        text = tok.decode([i], skip_special_tokens=False)
        if token not in special and "�" not in text and pattern.fullmatch(text) and pattern.findall(text) == [text]:
            ids.append(i)
            texts.append(text)
    found = tok.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, i, e in zip(texts, ids, found) if e.ids == [i])


def _counter(path: str, whole: frozenset[str]):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    # longest first, as a text may hold one that begins another
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    find = regex.compile(PATTERN).findall
    merged = Memo(lambda p: len(tok.encode(p, add_special_tokens=False).ids), 400_000)

    def count(text: str) -> tuple[int, int]:
        n = direct = 0
        parts = [text]
        if cut and any(s in text for s in special):
            n, parts = len(cut.findall(text)), cut.split(text)
        for part in parts:
            pre = find(part)
            rest = [p for p in pre if p not in whole]
            direct += len(pre) - len(rest)
            n += len(pre) - len(rest) + sum(map(merged.__getitem__, rest))
        return n, direct

    return count


def _library_counter(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: (len(model.encode(text, num_threads=1)), 0)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), n_whole (counted directly).

    docs: doc_id, text (null: empty); other columns are left out, rows may repeat, a null doc_id stays null. path: a
    byte-level BPE file of the tokenizers library, or a sentencepiece .model, which has no pre-tokens and is encoded
    whole. Special tokens' strings in a text count one each, as the library has it.
    """
    byte_level = not path.endswith(".model")
    proven = docs.sparkSession.sparkContext.broadcast(prove_whole(path)) if byte_level else None
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_whole", pa.int64())])

    def run(batches):
        count = held(("counts", path), lambda: _counter(path, proven.value) if byte_level else _library_counter(path))
        for batch in batches:
            for a, b in groups(batch):
                ids, n_bytes = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                got = [count(t) if t else (0, 0) for t in batch.column(2).slice(a, b - a).to_pylist()]
                n = [x[0] for x in got]
                yield pa.record_batch([ids, n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n]), pa.array([x[1] for x in got], pa.int64())], schema=schema)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long")
