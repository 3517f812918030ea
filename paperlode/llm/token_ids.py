"""Ids of whole texts by the tokenizers library, each distinct piece of text encoded once a task.

A text is cut before each run of white space. Neither tokenizer ever joins characters across such a cut, so the ids
of the pieces, one after another, are the ids of the text. Unknown pieces go to the library joined, many at a time.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import WHITE, Memo, held, trim

#: Texts within this range, whose only white space is single spaces and single line ends, are cut by str.split.
_HARD = re.compile(r"[\t\x0b-\x0d\x1c-\x1f\x85\xa0İ-\U0010ffff]")
_SPACES = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{WHITE}]", chr(c)))
_LETTERS = r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+"
_MARKS = r"[!-&(-/:-@\[-`{-~]+"
_ONE, _TWO = re.compile(f"{_LETTERS}|{_MARKS}"), re.compile(f"{_LETTERS}{_MARKS}")


class IdEncoder:
    """encode(texts) -> little-endian unsigned 16-bit ids of each text, as bytes; vocabularies of at most 65,536 ids."""

    def __init__(self, path: str, cap: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.drops_space = self.tok.normalizer is not None
        vocab = self.tok.get_vocab()
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("ids above 65,535")
        self.marks = np.zeros(1 << 16, bool)  # ids that end a word, or that begin with white space
        for token, i in vocab.items():
            self.marks[i] = token.endswith("</w>") if self.drops_space else token[0] in "ĠĊ"
        self.pieces = re.compile(f"[^{WHITE}]+" if self.drops_space else f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.memo = Memo(self._of_key, cap)
        self.heads = Memo(self.alone, 10_000)

    def alone(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _of_key(self, key: str) -> bytes:
        """A key is a piece; where space counts, a key that begins with none stands for itself after a space."""
        return self.alone(key if self.drops_space or key[:1] in _SPACES else " " + key)

    def _cut(self, text: str) -> tuple[str, list[str]] | None:
        """The first piece where it has no space before it, and the keys of the others."""
        if "<|" in text:
            return None
        if self.drops_space:
            return "", text.lower().split() if not _HARD.search(text) else self.pieces.findall(text)
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _HARD.search(text) or text[:1] in " \n":
            found = self.pieces.findall(text)
            head = "" if found[0][0] in _SPACES else found.pop(0)
            return head, [p[1:] if p[0] == " " and p[1:2] not in _SPACES and p[1:] else p for p in found]
        head, *keys = text.replace("\n", " \n").split(" ")
        return head, keys

    def _joined(self, pieces: list[str], ends: list[int], glue: str) -> None:
        """Keys that, joined by glue, are told apart by self.marks in the ids; ends: how many marks each has."""
        step = 64
        for at in range(0, len(pieces), step * 32):
            some, many = pieces[at : at + step * 32], np.array(ends[at : at + step * 32])
            lead = "" if self.drops_space else glue
            lines = [lead + glue.join(some[i : i + step]) for i in range(0, len(some), step)]
            ids = [np.array(e.ids, "<u2") for e in self.tok.encode_batch_fast(lines, add_special_tokens=False)]
            for i, line in enumerate(ids):
                own, n = some[i * step : i * step + step], many[i * step : i * step + step]
                found = np.flatnonzero(self.marks[line])
                if len(found) != n.sum():  # never seen; the library then encodes them one by one
                    self.memo.update((p, self._of_key(p)) for p in own)
                    continue
                at_mark = np.cumsum(n)
                edges = np.append(0, found[at_mark - 1] + 1) if self.drops_space else np.append(found[at_mark - n], len(line))
                raw, cuts = line.tobytes(), (2 * edges).tolist()
                self.memo.update(zip(own, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))

    def _learn(self, fresh: set[str]) -> None:
        short = [p for p in fresh if len(p) <= 64]
        if self.drops_space:
            one, two = [p for p in short if _ONE.fullmatch(p)], [p for p in short if _TWO.fullmatch(p)]
            self._joined(one + two, [1] * len(one) + [2] * len(two), " ")
        else:
            plain = [p for p in short if p[0] not in _SPACES]
            self._joined(plain, [1] * len(plain), " ")
            line = [p for p in short if p[0] == "\n" and p[1:2] not in _SPACES]
            self._joined(line, [1] * len(line), "")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self._cut(t) if t else ("", []) for t in texts]
        get, known, old = self.memo.get, self.memo.__getitem__, self.memo.old
        found = [list(map(get, c[1])) if c else [] for c in cut]
        fresh = {k for c, values in zip(cut, found) if None in values for k, v in zip(c[1], values) if v is None}
        fresh.discard("")
        self.memo.make_room(len(fresh))
        for k in fresh & old.keys() if old else ():
            self.memo[k] = old[k]
            fresh.discard(k)
        self._learn(fresh)
        out = []
        for t, c, values in zip(texts, cut, found):
            if c is None:
                out.append(self.alone(t))
                continue
            if None in values:
                values = [known(k) if v is None else v for k, v in zip(c[1], values)]
            out.append((self.heads[c[0]] if c[0] else b"") + b"".join(values))
        return out


def encoder(path: str) -> IdEncoder:
    """The one of a vocabulary file in this Python worker."""
    return held(("ids", path), lambda: IdEncoder(path))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def groups(batch, at: int = -1, size: int = 1 << 20):
    """(first row, end row) of pieces of an Arrow batch of about `size` characters each in its text column, `at`."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.utf8_length(batch.column(at % batch.num_columns)), 0).to_numpy(zero_copy_only=False)
    begin = 0
    sums = np.cumsum(lengths)
    while begin < len(lengths):
        base = sums[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sums, base + size, "right")))
        yield begin, end
        begin = end
    trim()
