"""Phrase collocations counted in tiles of frequency-ranked ids.

Texts become sequences of local word ids, one row for each part (a stretch of documents of one lang). Words that occur
often enough get ids by frequency rank. Two neighbouring ids are a pair; a pair falls into the tile of the ranks of
both, and tiles are summed one by one: dense ones by bincount over all their cells, sparse ones as sorted coordinates.
Pairs that occur often enough are ranked in turn and become the ids of the next round: a pair of overlapping phrases
of n words is a phrase of n + 1 words. A part learns the ids of what occurs in it, so no dictionary is held whole.
Words are counted alike, by buckets of a hash.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.staging import numbered
from .common import release, stage, trim

#: Bytes of text in a part.
PART_BYTES = 16_000_000
#: Pairs that the narrowest grid of tiles takes; more pairs make narrower tiles. Under Zipf's law the largest tile holds
#: a fiftieth of this, with equally frequent words a quarter.
TILE_ENTRIES = 128_000_000
#: Ranks below which a part counts its pairs by bincount, before they are dealt to tiles.
HEAD = 1_024
#: Cells up to which a tile is summed by bincount whatever it holds.
DENSE_CELLS = 1 << 20

#: Buckets of words at least, and words of all parts that one should hold at most.
BUCKETS, BUCKET_WORDS = 16, 4_000_000

#: Ends of pieces, and the other white space between words, as they are mapped before a split.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b"\t"
TRANSLATED = bytes.maketrans(ENDS + BLANKS, b"\n" * len(ENDS) + b" " * len(BLANKS))


def pieces(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with b"\\n" at ends of pieces."""
    return [w for w in text.lower().translate(TRANSLATED).replace(b"\n", b" \n ").split(b" ") if w]


def pack(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: ranks and gaps are mostly small."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(raw: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


_PARTS = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])


def _to_parts(part_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        held: dict[str, tuple[dict, list]] = {}
        size, made = 0, TaskContext.get().partitionId() << 32

        def rows():
            nonlocal size, made
            out = []
            for lang, (words, docs) in held.items():
                ids = np.concatenate(docs)
                counts = np.bincount(ids[ids >= 0], minlength=len(words))
                out.append((made, lang, int(counts.sum()), list(words), counts, pack(ids)))
                made += 1
            held.clear()
            size = 0
            for row in out:
                yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _PARTS)], schema=_PARTS)
            trim()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or b""
                words, docs = held.setdefault(lang, ({}, []))
                docs.append(np.array([-1 if w == b"\n" else words.setdefault(w, len(words)) for w in pieces(text)] + [-1], np.int32))
                size += len(text)
                if size >= part_bytes:
                    yield from rows()
        yield from rows()

    return run


def tile_of(i: np.ndarray, j: np.ndarray, steps: int) -> np.ndarray:
    """The tile of each pair of ranks: `steps` rows of tiles for each doubling of the first rank, and as many columns
    for the second, more where the first is so frequent that its row holds one rank."""
    row = np.floor(steps * np.log2(1.0 + i)).astype(np.int64)
    across = np.maximum(steps, steps * steps // (1 + i))
    return row << 32 | np.floor(across * np.log2(1.0 + j)).astype(np.int64)


def part_pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of neighbouring ids as i << 32 | j, and how often each occurs."""
    a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    both = (a >= 0) & (b >= 0)
    a, b = a[both], b[both]
    head = (a < HEAD) & (b < HEAD)
    dense = np.bincount(a[head] * HEAD + b[head]) if head.any() else np.zeros(0, np.int64)
    cells = np.flatnonzero(dense)
    codes, counts = np.unique((a << 32 | b)[~head], return_counts=True)
    return np.concatenate([cells // HEAD << 32 | cells % HEAD, codes]), np.concatenate([dense[cells], counts])


_ENTRIES = pa.schema([("lang", pa.string()), ("tile", pa.int64()), ("part", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])


def _to_tiles(steps: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, lang = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                codes, counts = part_pairs(unpack(batch.column(2)[k].as_py(), np.int32))
                tiles = tile_of(codes >> 32, codes & 0xFFFFFFFF, steps)
                order = np.lexsort((codes, tiles))
                codes, counts, tiles = codes[order], counts[order], tiles[order]
                cuts = np.flatnonzero(np.diff(tiles)) + 1
                starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(tiles)]])
                if len(tiles):
                    cells = [[pack(np.diff(codes[s:e], prepend=0)), pack(counts[s:e].astype(np.int32))] for s, e in zip(starts, ends)]
                    n = len(starts)
                    yield pa.record_batch([pa.array([lang] * n), pa.array(tiles[starts]), pa.array([part] * n, pa.int64()), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], schema=_ENTRIES)
            trim()

    return run


def tile_sums(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code of a tile and the sum of its counts: by bincount where the tile's cells are few or well filled."""
    i, j = codes >> 32, codes & 0xFFFFFFFF
    rows, width = int(i.max() - i.min()) + 1, int(j.max() - j.min()) + 1
    if rows * width <= max(DENSE_CELLS, 4 * len(codes)):
        cell = (i - i.min()) * width + (j - j.min())
        total = np.bincount(cell, weights=counts).astype(np.int64)  # doubles are exact to 2^53
        at = np.flatnonzero(total)
        return (at // width + i.min()) << 32 | (at % width + j.min()), total[at]
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first, dtype=np.int64)


_FOUND = pa.schema([("lang", pa.string()), ("tile", pa.int64()), ("part", pa.int64()), ("codes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("known", pa.binary())])


def _sum_tile(least: int):
    """One tile: its frequent pairs with their counts, and for each part those of them that occur there."""

    def run(key, table):
        parts = table.column("part").to_pylist()
        codes = [np.cumsum(unpack(x.as_py(), np.int64)) for x in table.column("codes")]
        every, total = tile_sums(np.concatenate(codes), np.concatenate([unpack(x.as_py(), np.int32) for x in table.column("counts")]))
        often = total >= least
        every, total = every[often], total[often]
        rows = [(None, every, total, None)] if len(every) else []
        for part, own in zip(parts, codes):
            if len(every) and len(known := own[held_in(every, own)[1]]):
                rows.append((part, None, None, pack(np.diff(known, prepend=0))))
        columns = [[key[0].as_py()] * len(rows), [key[1].as_py()] * len(rows), *(zip(*rows) if rows else [[]] * 4)]
        return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    return run


def held_in(every: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where own numbers stand in `every`, which ascends, and whether they do."""
    at = np.minimum(np.searchsorted(every, own), len(every) - 1)
    return at, every[at] == own


_NAMED = pa.schema([("part", pa.int64()), ("names", pa.binary()), ("to", pa.binary())])


def _name_tile(key, known, numbers):
    """The pairs of a tile that occur in each part, and their ids."""
    parts = known.column("part").to_pylist() if numbers.num_rows else []
    codes, ids = (numbers.column(c).to_numpy() for c in ("code", "id"))
    order = np.argsort(codes)
    codes, ids = codes[order], ids[order].astype(np.int32)
    own = [np.cumsum(unpack(x.as_py(), np.int64)) for x in known.column("known")] if parts else []
    to = [pack(ids[held_in(codes, x)[0]]) for x in own]
    return pa.table([pa.array(parts, pa.int64()), pa.array([pack(np.diff(x, prepend=0)) for x in own], pa.binary()), pa.array(to, pa.binary())], schema=_NAMED)


_WORDS = pa.schema([("lang", pa.string()), ("tile", pa.int64()), ("part", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("names", pa.binary())])


def _to_buckets(buckets: int):
    """A part's words by a hash of them: a row for each bucket."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, lang = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                words, counts = batch.column(2)[k].values, batch.column(3)[k].values
                own = np.array([zlib.crc32(w) for w in words.to_pylist()], np.int64) % buckets
                order = np.argsort(own, kind="stable")  # local ids ascend in a bucket
                cuts = np.searchsorted(own[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    names = order[cuts[b] : cuts[b + 1]]
                    at = pa.array(names)
                    row = [lang, int(b), part, words.take(at), counts.take(at), pack(np.diff(names, prepend=0))]
                    yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _WORDS)], schema=_WORDS)
            trim()

    return run


_HELD_WORDS = pa.schema([("lang", pa.string()), ("tile", pa.int64()), ("part", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("names", pa.binary()), ("which", pa.binary())])


def _sum_words(least: int):
    """One bucket: its frequent words with their counts, and for each part the local ids of those that it has and which
    of them they are."""

    def run(key, table):
        lang, tile = key[0].as_py(), key[1].as_py()
        lists = table.column("words").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        codes, total = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, codes, table.column("counts").combine_chunks().flatten().to_numpy())
        often = total >= least
        place = np.cumsum(often) - 1
        rows = [(lang, tile, None, coded.dictionary.filter(pa.array(often)), total[often], None, None)] if often.any() else []
        ends = np.cumsum(lists.value_lengths().to_numpy())
        for part, start, end, names in zip(table.column("part").to_pylist(), [0, *ends], ends, table.column("names")):
            own = codes[start:end]
            if often[own].any():
                local = np.cumsum(unpack(names.as_py(), np.int64))[often[own]]
                rows.append((lang, tile, part, None, None, pack(np.diff(local, prepend=0)), pack(place[own[often[own]]].astype(np.int32))))
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, _HELD_WORDS)], schema=_HELD_WORDS)

    return run


def _name_words(key, known, numbers):
    """The words of a bucket that each part has, by their local ids, and their ids."""
    ids = np.zeros(numbers.num_rows, np.int32)
    ids[numbers.column("code").to_numpy()] = numbers.column("id").to_numpy()
    to = [pack(ids[unpack(x.as_py(), np.int32)]) for x in known.column("which")]
    return pa.table([known.column("part"), known.column("names"), pa.chunked_array([pa.array(to, pa.binary())])], schema=_NAMED)


def _renamed(words: bool):
    """Rows part, lang, ids and what is known (names: local word ids or pair codes, to: their ids) -> the next ids."""
    out = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids = unpack(batch.column(2)[k].as_py(), np.int32)
                names = np.concatenate([np.cumsum(unpack(x.as_py(), np.int64)) for x in batch.column(3)[k].values])
                to = np.concatenate([unpack(x.as_py(), np.int32) for x in batch.column(4)[k].values])
                if words:
                    have = ids >= 0
                    asked = ids[have].astype(np.int64)
                else:
                    have = (ids[:-1] >= 0) & (ids[1:] >= 0)
                    asked = ids[:-1][have].astype(np.int64) << 32 | ids[1:][have]
                order = np.argsort(names)
                at, known = held_in(names[order], asked)
                new = np.full(len(ids), -1, np.int32)
                new[np.flatnonzero(have)[known]] = to[order][at[known]]
                yield pa.record_batch([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([pack(new)], pa.binary())], schema=out)
            trim()

    return run


def _ranked(counted: DataFrame, *names: str) -> DataFrame:
    """counted (lang, names, a) with id, the place by a downwards within its lang, numbered over ranges."""
    of = numbered(counted, "lang", -F.col("a"), *names)
    first = of.groupBy("lang").agg(F.min("n").alias("__first"))
    return of.join(first, "lang").withColumn("id", F.col("n") - F.col("__first")).drop("n", "__first")


def _by_tile(held: DataFrame, columns: tuple, numbers: DataFrame, name) -> DataFrame:
    """part, names, to: what the parts of a tile hold meets the tile's ids."""
    left = held.filter("part IS NOT NULL").select("lang", "tile", *columns).groupBy("lang", "tile")
    return left.cogroup(numbers.select("lang", "tile", "code", "id").groupBy("lang", "tile")).applyInArrow(name, "part long, names binary, to binary")


def _next(parts: DataFrame, occurs: DataFrame, words: bool, label: str) -> DataFrame:
    """parts with their ids renamed by occurs: part, names, to."""
    own = occurs.groupBy("part").agg(F.collect_list(F.struct("names", "to")).alias("x")).select("part", F.col("x.names").alias("names"), F.col("x.to").alias("to"))
    rows = parts.select("part", "lang", "ids").join(own, "part")
    return stage(rows.mapInArrow(_renamed(words), "part long, lang string, ids binary"), label)


def _steps(entries: int, tile_entries: int) -> int:
    return max(1, math.ceil(math.sqrt(entries / tile_entries)))


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, part_bytes: int = PART_BYTES, tile_entries: int = TILE_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(n by lang, all phrases of 2 to `longest` words that occur at least `least` times).

    The second has lang, size, id, i, j (ids of the phrase without its last and without its first word, of the size
    before), phrase, a, and pre and suf: how often its first, and its last, 1 to size - 1 words occur.
    """
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    parts = stage(own.mapInArrow(_to_parts(part_bytes), "part long, lang string, n long, words array<binary>, counts array<long>, ids binary"), "phrase-parts")
    totals = stage(parts.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")

    vocabulary = parts.agg(F.sum(F.size("words"))).first()[0] or 0
    buckets = max(BUCKETS, math.ceil(vocabulary / BUCKET_WORDS))
    words = parts.select("part", "lang", "words", "counts").mapInArrow(_to_buckets(buckets), "lang string, tile long, part long, words array<binary>, counts array<long>, names binary")
    held = stage(words.groupBy("lang", "tile").applyInArrow(_sum_words(least), "lang string, tile long, part long, words array<binary>, counts array<long>, names binary, which binary"), "phrase-held")
    often = held.filter("part IS NULL").select("lang", "tile", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "x")).select("lang", "tile", "code", F.col("x.words").alias("word"), F.col("x.counts").alias("a"))
    known = stage(_ranked(often, "word"), "phrase-words")
    ids = _next(parts, _by_tile(held, ("part", "names", "which"), known, _name_words), True, "phrase-ids")
    release(held)
    release(parts)
    none = F.array().cast("array<long>")
    level = known.select("lang", "id", F.col("a"), F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last"), none.alias("pre"), none.alias("suf"))

    found = None
    for size in range(2, longest + 1):
        mass = level.agg(F.sum("a")).first()[0] or 0
        entries = ids.mapInArrow(_to_tiles(_steps(mass, tile_entries)), "lang string, tile long, part long, codes binary, counts binary")
        summed = stage(entries.groupBy("lang", "tile").applyInArrow(_sum_tile(least), "lang string, tile long, part long, codes array<long>, counts array<long>, known binary"), "phrase-tiles")
        pairs = summed.filter("part IS NULL").select("lang", "tile", F.explode(F.arrays_zip("codes", "counts")).alias("x")).select("lang", "tile", F.col("x.codes").alias("code"), F.col("x.counts").alias("a"))
        numbers = stage(_ranked(pairs, "code"), "phrase-ranks")
        i, j = F.shiftright("code", 32).alias("i"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("j")
        left = level.select("lang", F.col("id").alias("i"), F.col("phrase").alias("start"), F.concat("pre", F.array("a")).alias("pre"))
        right = level.select("lang", F.col("id").alias("j"), "last", F.concat("suf", F.array("a")).alias("suf"))
        level = stage(
            numbers.select("lang", "id", "a", i, j).join(left, ["lang", "i"]).join(right, ["lang", "j"])
            .select("lang", F.lit(size).alias("size"), "id", "i", "j", "a", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "pre", "suf"),
            "phrase-level",
        )
        found = level if found is None else found.unionByName(level)
        if size < longest:
            occurs = _by_tile(summed, ("part", "known"), numbers, _name_tile)
            before, ids = ids, _next(ids, occurs, False, "phrase-ids")
            release(before)
    release(ids)
    return totals, found.drop("last")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, **sizes: int) -> DataFrame:
    """The `top` phrases of each lang by score: lang, rank (from 1), phrase, a, l, r, n, score.

    docs: text (null or empty: no words) and lang (null: `und`); other columns are left out and rows that repeat count
    again, whatever their ids. A phrase has 2 to `longest` words, which follow each other inside a piece, and occurs
    a >= least times. Cut after its first k words it scores floor(1000 a n / (l r)) with the counts l and r of both
    sides and n, all words of the lang; its lowest-scoring cut counts, the first of equals. A phrase that occurs no
    more often than a longer one around it is dropped; it is enough to look one word further, as counts only fall.
    Equal scores are ordered by a, then by the bytes of the phrase. Products are decimals of 38 digits: exact up to
    10^14 words a lang. A table without frequent pairs gives no rows. sizes: part_bytes, tile_entries.
    """
    totals, found = phrases(docs, least, longest, **sizes)
    longer = found.select("lang", (F.col("size") - 1).alias("size"), "a", "i", "j")
    around = longer.select("lang", "size", F.explode(F.array("i", "j")).alias("id"), "a").groupBy("lang", "size", "id").agg(F.max("a").alias("longer"))
    kept = found.join(around, ["lang", "size", "id"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).join(totals, "lang")
    cut = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(F.element_at("pre", k).alias("l"), F.element_at("suf", F.col("size") - k).alias("r"), k.alias("k")))
    cuts = kept.select("lang", "phrase", "a", "n", F.explode(cut).alias("c")).select("lang", "phrase", "a", "n", "c.*")
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(15,0)) * CAST(n AS DECIMAL(15,0))) DIV (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    scored = cuts.withColumn("score", score.cast("long"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
