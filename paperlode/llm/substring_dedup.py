"""Exact substring dedup by recompression.

Words are named by 64-bit fingerprints. Rounds then rename: first runs of one token, then pairs whose left symbol
falls in the round's left half of the alphabet and whose right symbol falls in its right half. A name is a
fingerprint of what it spells, so a round names runs and pairs alike over the whole corpus without a dictionary,
and equal substrings get equal symbols inside. For each symbol the words that decided it are tracked; where they lie
inside a window, every equal window holds the same symbol at the same place. Each window is represented by the
smallest such symbol name, so a window can repeat only where its symbol repeats, with the words that decided it:

1. every document emits its representative symbols (spelled with those words), with the windows they stand for and a
   fingerprint of them all;
2. Spark counts symbols and keeps the repeated ones;
3. occurrences that spell the same words throughout are repeated as a whole; the rest are verified window by window,
   one document for each spelling;
4. words covered by repeated windows leave their documents.

A window in which no symbol is decided (long runs of one word) represents itself, so nothing is lost. Two windows are
equal where both their symbols (from the names of words) and a hash of their bytes agree: 128 bits of two kinds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, release, stage
from .token_ids import groups

#: Pair rounds, and the length in words from which a symbol is left alone. Both only steer how much is verified.
ROUNDS, FULL = 5, 5
#: Words handled at once by a task.
BATCH_WORDS = 200_000

_M1, _M2, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x5851F42D4C957F2D)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_NONE = np.uint64(2**64 - 1)
#: A salt for each round.
_M2s = np.array([(2 * r + 1) * int(_M2) % 2**64 for r in range(64)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and \\t\\n\\v\\f\\r."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Spelling:
    """Fingerprints of any range of a sequence of names, in constant time each."""

    def __init__(self, names: np.ndarray):
        n = len(names)
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(names * np.multiply.accumulate(power)[:n], out=self.sums[1:])
        power[1:] = _BASE_INV
        self.inverse = np.multiply.accumulate(power)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _M2)


def parse(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS, full: int = FULL):
    """Symbols of the last round: name, start, end, and the range [lo, hi) of words that decided it.

    names: of words, of one document after another; doc: each word's document. A symbol that some word beyond its
    document's end had to decide has lo below 0 or hi above the number of words by far.
    """
    n = len(names)
    far = 1 << 40
    # runs of one token
    head = np.ones(n, bool)
    head[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    start, end = at, np.append(at[1:], n)
    name, d, length = names[at], doc[at], end - start
    is_run = length > 1
    name = np.where(is_run, _mix(name + length.astype(np.uint64) * _M1), name)
    lo, hi = start - 1, end + 1  # the words before and after end the run
    long = length > full
    lo, hi = np.where(long, -far, lo), np.where(long, far, hi)
    for r in range(rounds):
        if len(name) < 2:
            break
        side = (_mix(name + _M2s[r]) >> np.uint64(63)).astype(bool)
        free = (end - start) < full
        follows = np.append(d[1:] == d[:-1], False)
        open_left = np.append(side[:-1] & free[:-1] & ~side[1:] & free[1:], False) & follows
        taken = np.append(False, open_left[:-1])
        # a symbol that stays was decided by the neighbour it might have paired with
        nlo, nhi = lo.copy(), hi.copy()
        right = np.flatnonzero(side & free & ~open_left)
        ok = follows[right]
        nlo[right[ok]] = np.minimum(lo[right[ok]], lo[right[ok] + 1])
        nhi[right[ok]] = np.maximum(hi[right[ok]], hi[right[ok] + 1])
        nhi[right[~ok]] = far
        left = np.flatnonzero(~side & free & ~taken)
        ok = np.append(False, follows[:-1])[left]
        nlo[left[ok]] = np.minimum(lo[left[ok]], lo[left[ok] - 1])
        nhi[left[ok]] = np.maximum(hi[left[ok]], hi[left[ok] - 1])
        nlo[left[~ok]] = -far
        p = np.flatnonzero(open_left)
        nlo[p], nhi[p] = np.minimum(lo[p], lo[p + 1]), np.maximum(hi[p], hi[p + 1])
        name = name.copy()
        name[p] = _mix(name[p] * _M1 + _mix(name[p + 1] + np.uint64(r + 1)))
        end = end.copy()
        end[p] = end[p + 1]
        stay = ~taken
        name, start, end, lo, hi, d = name[stay], start[stay], end[stay], nlo[stay], nhi[stay], d[stay]
    return name, start, end, lo, hi, d


def represent(names: np.ndarray, doc: np.ndarray, bounds: np.ndarray, window: int, rounds: int = ROUNDS, full: int = FULL):
    """(start and end of the words that decided a symbol, first window, last window) so that each window of each
    document is stood for, by a rule that reads nothing but the window's own words; and the windows that are not.
    bounds: where documents begin, and the end."""
    n = len(names)
    first_ok = np.zeros(n, bool)
    for_doc = bounds[1:] - bounds[:-1] >= window
    starts, stops = bounds[:-1][for_doc], bounds[1:][for_doc] - window + 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    first_ok = np.cumsum(edge[:-1]) > 0
    sym, _, _, lo, hi, d = parse(names, doc, rounds, full)
    a = np.maximum(hi - window, bounds[:-1][d])
    b = np.minimum(lo, bounds[1:][d] - window)
    use = np.flatnonzero(a <= b)
    sym, a, b, lo, hi = sym[use], a[use], b[use], lo[use], hi[use]
    best = np.full(n, _NONE, np.uint64)
    who = np.full(n, len(sym), np.int64)
    if len(a):
        spans = range(int((b - a).max()) + 1)
        for k in spans:
            i = np.flatnonzero(a + k <= b)
            np.minimum.at(best, a[i] + k, sym[i])
        for k in spans:
            i = np.flatnonzero(a + k <= b)
            i = i[best[a[i] + k] == sym[i]]
            np.minimum.at(who, a[i] + k, i)
    w = np.flatnonzero(first_ok)
    lone = w[who[w] == len(sym)]
    w = w[who[w] < len(sym)]
    owner, first = np.unique(who[w], return_index=True)
    last = np.zeros(len(sym) + 1, np.int64)
    last[who[w]] = w  # the last one written stays: w ascends
    return lo[owner], hi[owner], w[first], last[owner], lone


def _batches(docs):
    """docs: (key..., words). Groups of documents of about BATCH_WORDS words."""
    held("substrings", dict)  # what this worker holds of other work goes
    group, size = [], 0
    for x in docs:
        group.append(x)
        size += len(x[-1])
        if size >= BATCH_WORDS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _names(group):
    import xxhash

    hashed = xxhash.xxh64_intdigest
    bounds = np.cumsum([0, *(len(x[-1]) for x in group)])
    names = np.fromiter((hashed(w) for x in group for w in x[-1]), np.uint64, bounds[-1])
    return names, np.repeat(np.arange(len(group)), bounds[1:] - bounds[:-1]), bounds


_MORE = (1 << 32) - 1
def _bytes_hashed(group, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 of the words themselves, joined by one space, of each range of words of a group."""
    import xxhash

    joined = b" ".join(w for x in group for w in x[-1])
    at = np.cumsum([0, *(len(w) + 1 for x in group for w in x[-1])])
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], 7) for a, b in zip(at[begin].tolist(), (at[end] - 1).tolist())), np.uint64, len(begin))


_ANCHOR = "sym long, spell long, k long, tag long, pos long"
_WINDOWS = _ANCHOR + ", single boolean"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _anchors(window: int):
    schema = pa.schema([(c, pa.int64()) for c in ("sym", "spell", "k", "tag", "pos")])

    def run(batches):
        def docs():
            for batch in batches:
                for a, b in groups(batch):
                    for k, tag, text in zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(3))):
                        if text and len(words := _words(text)) >= window:
                            yield k, tag, words

        for group in _batches(docs()):
            names, doc, bounds = _names(group)
            lo, hi, first, last, lone = represent(names, doc, bounds, window)
            spelled = Spelling(names)
            sym = np.concatenate([spelled(lo, hi), _mix(spelled(lone, lone + window) + _M1)])
            first, last = np.concatenate([first, lone]), np.concatenate([last, lone])
            spell = _bytes_hashed(group, first, last + window)
            d = doc[first]
            k, tag = np.array([x[0] for x in group], np.int64)[d], np.array([x[1] for x in group], np.int64)[d]
            # first window and how many more share one long
            pos = ((first - bounds[d]) << 32) | (last - first)
            yield pa.record_batch([pa.array(_signed(sym)), pa.array(_signed(spell)), pa.array(k), pa.array(tag), pa.array(pos)], schema=schema)

    return run


def _fine(window: int):
    schema = pa.schema([*((c, pa.int64()) for c in ("sym", "spell", "k", "tag", "pos")), ("single", pa.bool_())])

    def run(batches):
        def docs():
            for batch in batches:
                for a, b in groups(batch):
                    for k, tag, todo, text in zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(4))):
                        yield k, tag, todo, _words(text)

        for group in _batches(docs()):
            bounds = np.cumsum([0, *(len(x[-1]) for x in group)])
            todo = [(i, t["sym"], t["pos"], t["single"]) for i, x in enumerate(group) for t in x[2]]
            i, sym, pos, single = (np.array(c, t) for c, t in zip(zip(*todo), (np.int64, np.int64, np.int64, bool)))
            many = (pos & _MORE) + 1
            row = np.repeat(np.arange(len(i)), many)
            at = (pos >> 32)[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            begin = bounds[i[row]] + at
            k, tag = (np.array([x[c] for x in group], np.int64)[i[row]] for c in (0, 1))
            out = [sym[row], _signed(_bytes_hashed(group, begin, begin + window)), k, tag, at << 32]
            yield pa.record_batch([*map(pa.array, out), pa.array(single[row])], schema=schema)

    return run


def cover(n_words: int, spans, window: int) -> np.ndarray:
    """Which words the windows [first .. first + more] of spans (packed positions) cover."""
    edge = np.zeros(n_words + 1, np.int64)
    pos = np.asarray(spans, np.int64)
    np.add.at(edge, pos >> 32, 1)
    np.add.at(edge, (pos >> 32) + (pos & _MORE) + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(text: str | None, spans, window: int) -> tuple[int, list[bytes]]:
    """How many words text has, and those that stay."""
    words = _words(text)
    if not spans:
        return len(words), words
    return len(words), [w for w, gone in zip(words, cover(len(words), spans, window)) if not gone]


def _digest(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for a, b in groups(batch, 1):
                rows = []
                for doc_id, text, spans in zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(3))):
                    n, kept = _kept(text, spans, window)
                    rows.append((doc_id, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _rewrite(window: int, text_at: int, chars_at: int | None, names: list[str]):
    def run(batches):
        for whole in batches:
            for a, b in groups(whole, text_at):
                batch, texts = whole.slice(a, b - a), []
                for text, spans in zip(batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                    texts.append(b" ".join(_kept(text, spans, window)[1]).decode("utf-8", "surrogatepass") if spans else text)
                columns = batch.columns[:-1]
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if chars_at is not None:
                    columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], columns[chars_at].type)
                yield pa.record_batch(columns, names=names)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of a row's text: its doc_id (where null, a hash of the text) and another hash of the text.

    Rows with one key hold one text, so what repeats in one of them repeats in all.
    """
    text = F.col("text").cast("string")
    return docs.withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("text"), text)), "__tag": F.xxhash64(text)})


def repeat_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """(__k, __tag, spans) of every text of docs (doc_id, text) that holds repeated windows, as packed positions."""
    own = _keyed(docs.select("doc_id", "text")).select(F.col("__k").alias("k"), F.col("__tag").alias("tag"), F.col("text").cast("string").alias("text"))
    found = stage(own.mapInArrow(_anchors(window), _ANCHOR), "anchors")
    # keys are written before they are joined: Spark can then split a hot key's rows in the join
    again = stage(found.groupBy("sym").agg(F.count("*").alias("n")).filter("n > 1").select("sym"), "again")
    shared = stage(found.join(again, "sym"), "shared")
    release(found, again)

    spellings = shared.groupBy("sym", "spell").agg(F.count("*").alias("n"), F.min(F.struct("k", "tag", "pos")).alias("one"))
    spellings = stage(spellings.select("sym", "spell", "n", "one.k", "one.tag", "one.pos"), "spellings")
    several = stage(spellings.groupBy("sym").agg(F.count("*").alias("c")).filter("c > 1").select("sym"), "several")
    todo = spellings.join(several, "sym").select("k", "tag", "sym", "pos", (F.col("n") == 1).alias("single"))
    per_doc = todo.groupBy("k", "tag").agg(F.collect_list(F.struct("sym", "pos", "single")).alias("todo"))
    # rows that repeat in full hold one text: any of them will do
    windows = own.join(per_doc, ["k", "tag"]).select("k", "tag", "todo", "text").mapInArrow(_fine(window), _WINDOWS)
    windows = stage(windows, "windows")
    place = F.struct("k", "tag", "pos")
    twice = stage(windows.groupBy("sym", "spell").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("sym", "spell"), "twice")
    fine = windows.filter("single").join(twice, ["sym", "spell"]).select("k", "tag", "pos")
    whole = shared.join(spellings.filter("n > 1").select("sym", "spell"), ["sym", "spell"]).select("k", "tag", "pos")
    return whole.union(fine).groupBy(F.col("k").alias("__k"), F.col("tag").alias("__tag")).agg(F.collect_set("pos").alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256.

    docs: doc_id, text; other columns are left out. Null or empty text: no words. Every row counts as a document,
    also one that repeats a doc_id; a null doc_id stays null.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = _keyed(own).join(repeat_spans(own, window), ["__k", "__tag"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_digest(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """docs with all their columns, text without the words that remove_repeats removes.

    A text from which nothing goes is unchanged; any other is its kept words joined by one space. Where docs have
    n_chars, it is that of the text.
    """
    rest = docs.withColumnRenamed("spans", "__spans") if "spans" in docs.columns else docs
    joined = _keyed(rest).join(repeat_spans(docs, window), ["__k", "__tag"], "left").drop("__k", "__tag")
    # spans come last
    return joined.select(*rest.columns, "spans").mapInArrow(_rewrite(window, docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None, docs.columns), docs.schema)
