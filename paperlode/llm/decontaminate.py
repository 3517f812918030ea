"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may stand in a document with up to k edits. Cut into k + 1 pieces, at least one piece then
stands there unchanged. An automaton over the pieces of a block of items finds all exact piece hits; each hit places
the item, and Myers' bit-parallel distance over the text around that place decides.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, stage
from .token_ids import groups

#: Characters of items matched in one pass over the documents; a larger benchmark takes several passes.
BLOCK_CHARS = 4_000_000

_WORD = re.compile(r"\w+")


def normal(text: str | None) -> str:
    """Lower case, words joined by one space, with one at either end: a match begins and ends at words."""
    words = _WORD.findall(text.lower()) if text else ()
    return f" {' '.join(words)} " if words else ""


def budget(m: int, rate: float) -> int:
    return min(int(m * rate), m - 1) if m else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(place, piece) of k + 1 pieces that make up the item."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the best and then first place in text where the pattern of m characters ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        found: dict[str, list[tuple[int, int]]] = {}
        self.items = []
        for item_id, text in items:
            if not text:
                continue
            k, i = budget(len(text), rate), len(self.items)
            self.items.append((item_id, text, k, masks(text), masks(text[::-1])))
            for at, piece in pieces(text, k):
                found.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def matches(self, text: str):
        """(item_id, distance, budget, start, end) of each item within its budget: its best, then first place."""
        if self.empty or not text:
            return
        windows: dict[int, list[list[int]]] = {}
        for last, (size, uses) in self.automaton.iter(text):
            for i, at in uses:
                k, m = self.items[i][2], len(self.items[i][1])
                begin = last - size + 1 - at
                a, b = max(0, begin - k), min(len(text), begin + m + k)
                own = windows.setdefault(i, [])
                # hits arrive by their ends; a window that meets the last one joins it
                if own and a <= own[-1][1] and own[-1][0] <= b:
                    own[-1][0], own[-1][1] = min(a, own[-1][0]), max(b, own[-1][1])
                else:
                    own.append([a, b])
        for i, own in windows.items():
            item_id, item, k, peq, back = self.items[i]
            best = None
            for a, b in own:
                distance, end = myers(peq, len(item), text[a:b])
                if distance <= k and (best is None or (distance, a + end) < best):
                    best = (distance, a + end)
            if best:
                distance, end = best
                _, length = myers(back, len(item), text[max(0, end - len(item) - k) : end][::-1])
                yield item_id, distance, k, end - length, end


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def _matcher(key: str, shipped, rate: float) -> Matcher:
    return held(("items", key), lambda: Matcher(shipped.value, rate))


def _blocks(items: DataFrame, block_chars: int):
    """How many blocks of about block_chars characters there are, and a function that ships one:
    its key and the broadcast of (item_id, normalised text)."""
    spark = items.sparkSession
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-(wanted.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))

    def ship(b: int):
        block = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        return uuid.uuid4().hex, spark.sparkContext.broadcast([(r.item_id, normal(r.text)) for r in block.collect()])

    return blocks, ship


def keep_clean(docs: DataFrame, items: DataFrame, rate: float = 0.06, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, that no item leaks into; rate and blocks as in find_leaks.

    A text that is null, empty or without words stays. With several blocks each but the last is applied and written
    before the next is shipped.
    """
    at = docs.columns.index("text")
    blocks, ship = _blocks(items, block_chars)
    for b in range(blocks):
        key, shipped = ship(b)

        def run(batches, key=key, shipped=shipped):
            matcher = _matcher(key, shipped, rate)
            for batch in batches:
                for a, z in groups(batch, at):
                    some = batch.slice(a, z - a)
                    yield some.filter(pa.array([next(matcher.matches(normal(t)), None) is None for t in some.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if b < blocks - 1:
            docs = stage(docs, "clean")
            shipped.destroy()
    return docs


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.06, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per (document, item) that leaks: doc_id, item_id, distance, budget, start, end (in the normalised document).

    docs: doc_id, text; items: item_id, text; other columns are left out. Texts are compared in lower case, words
    joined by one space; null, empty or wordless texts match nothing. An item leaks where some passage is within
    `rate` of its length in edits; its nearest and then first place is given. Rows that repeat count each; items that
    repeat give a row each. Items are matched in blocks of about `block_chars` characters, one after another, so that what
    the driver and tasks hold is bounded; every block passes over all documents.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    blocks, ship = _blocks(items, block_chars)
    for b in range(blocks):
        key, shipped = ship(b)

        def run(batches, key=key, shipped=shipped):
            matcher = _matcher(key, shipped, rate)
            for batch in batches:
                for a, z in groups(batch):
                    rows = []
                    for doc_id, text in zip(*(batch.column(i).slice(a, z - a).to_pylist() for i in range(2))):
                        rows += [(doc_id, *x) for x in matcher.matches(normal(text))]
                    if rows:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

        found = own.mapInArrow(run, "doc_id long, item_id long, distance int, budget int, start long, end long")
        if b < blocks - 1:
            found = stage(found, "leaks")
            shipped.destroy()
        out = found if out is None else out.union(found)
    return out
