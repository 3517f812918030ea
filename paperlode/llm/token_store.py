"""Token ids in binary segments of patched frame-of-reference blocks.

A segment holds the ids of whole documents. Its ids stand in blocks of 128. Of each block the least id is taken off;
the rest is packed at the width that a percentile of the block needs; ids that need more keep their low bits in place
and stand in full in the segment's exception list. An index gives every block's start, so a block is read alone.

Layout, little-endian: b"PFR1", u32 ids, u32 blocks, u32 exceptions; then per block u32 start (bytes into the packed
part), u32 least, u8 width, u8 exceptions; then the packed part; then per exception u8 place and u32 value.

Segments are rows of a Parquet dataset (shard, inside: ids before it in the shard, n_ids, doc_ids, lengths, payload), so Spark's committer and any store
Spark writes will do. Shards follow each other in ascending doc_id, as do segments in a shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .token_ids import encoder, groups

BLOCK, PERCENTILE, SEGMENT_IDS = 128, 95, 1 << 17
_MAGIC = np.frombuffer(b"PFR1", np.uint8)


def _width_of(x: np.ndarray) -> np.ndarray:
    """Bits that values below 2**32 need."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def encode_segment(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    x = np.empty(blocks * BLOCK, np.uint32)
    x[:n] = ids
    x[n:] = ids[-1] if n else 0
    x = x.reshape(blocks, BLOCK)
    least = x.min(axis=1, initial=2**32 - 1) if blocks else np.zeros(0, np.uint32)
    over = x - least[:, None]
    at = (BLOCK * percentile + 99) // 100 - 1
    width = _width_of(np.partition(over, at, axis=1)[:, at]) if blocks else np.zeros(0, np.uint8)
    block, place = np.nonzero(over >> width[:, None].astype(np.uint32)) if blocks else (np.zeros(0, int),) * 2
    sizes = width.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(sizes) - sizes
    packed = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if w:
            if w == 16:
                bits = (over[own] & 0xFFFF).astype("<u2").view(np.uint8)
            else:
                raw = (over[own] & np.uint32((1 << int(w)) - 1)).astype("<u4").view(np.uint8).reshape(-1, BLOCK, 4)
                bits = np.packbits(np.unpackbits(raw, axis=2, bitorder="little")[:, :, :w].reshape(len(own), -1), axis=1, bitorder="little")
            packed[starts[own][:, None] + np.arange(bits.shape[1])] = bits
    many = np.bincount(block, minlength=blocks).astype(np.uint8)
    head = np.array([n, blocks, len(block)], "<u4")
    parts = (_MAGIC, head, starts.astype("<u4"), least.astype("<u4"), width, many, packed, place.astype(np.uint8), x[block, place].astype("<u4"))
    return b"".join(p.tobytes() for p in parts)


class Segment:
    """A segment's header and index; blocks(a, b) reads blocks a to b alone."""

    def __init__(self, payload: bytes):
        raw = np.frombuffer(payload, np.uint8)
        if raw[:4].tobytes() != b"PFR1":
            raise ValueError("not a segment")
        self.n, blocks, exceptions = map(int, raw[4:16].view("<u4"))
        at = 16
        self.starts, at = raw[at : at + 4 * blocks].view("<u4").astype(np.int64), at + 4 * blocks
        self.least, at = raw[at : at + 4 * blocks].view("<u4"), at + 4 * blocks
        self.width, at = raw[at : at + blocks], at + blocks
        self.many, at = raw[at : at + blocks].astype(np.int64), at + blocks
        size = int(self.width.astype(np.int64).sum()) * (BLOCK // 8)
        self.packed, at = raw[at : at + size], at + size
        self.place, at = raw[at : at + exceptions], at + exceptions
        self.value = np.frombuffer(payload, "<u4", exceptions, at)

    def blocks(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = len(self.width) if b is None else b
        out = np.zeros((b - a, BLOCK), np.uint32)
        width, starts = self.width[a:b], self.starts[a:b]
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            if w:
                bits = self.packed[starts[own][:, None] + np.arange(int(w) * (BLOCK // 8))]
                if w == 16:
                    out[own] = bits.view("<u2")
                else:
                    wide = np.zeros((len(own), BLOCK, 32), np.uint8)
                    wide[:, :, :w] = np.unpackbits(bits, axis=1, bitorder="little").reshape(len(own), BLOCK, w)
                    out[own] = np.packbits(wide, axis=2, bitorder="little").view("<u4")[:, :, 0]
        out += self.least[a:b, None]
        before = int(self.many[:a].sum())
        row = np.repeat(np.arange(b - a), self.many[a:b])
        out[row, self.place[before : before + len(row)]] = self.value[before : before + len(row)]
        return out

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n if end is None else end
        first = start // BLOCK
        return self.blocks(first, -(-end // BLOCK)).ravel()[start - first * BLOCK : end - first * BLOCK]


_SEGMENTS = "shard int, inside long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def _segments(path: str, end_id: int, segment_ids: int):
    list_type = pa.list_(pa.int64())
    schema = pa.schema([("shard", pa.int32()), ("inside", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", list_type), ("lengths", list_type), ("payload", pa.binary())])

    def run(batches):
        encode, end, shard = encoder(path).encode, np.array([end_id], "<u2").tobytes(), TaskContext.get().partitionId()
        held, docs, lengths, size, inside = [], [], [], 0, 0

        def row():
            payload = encode_segment(np.frombuffer(b"".join(held), "<u2"))
            columns = ([shard], [inside], [size], [docs], [lengths], [payload])
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for a, b in groups(batch):
                for doc_id, raw in zip(batch.column(0).slice(a, b - a).to_pylist(), encode(batch.column(1).slice(a, b - a).to_pylist())):
                    held.append(raw + end)
                    docs.append(doc_id)
                    lengths.append(len(raw) // 2 + 1)
                    size += lengths[-1]
                    if size >= segment_ids:
                        yield row()
                        inside += size
                        held, docs, lengths, size = [], [], [], 0
        if docs:
            yield row()

    return run


def write_ids(docs: DataFrame, to: str, path: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of docs (doc_id, text; null text: empty) in ascending doc_id, null first, to the folder `to`.

    Texts are dealt by ranges of doc_id and sorted there; no range is one task's alone unless one doc_id holds it.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # hash of the text: rows that repeat a doc_id follow each other in one order at every attempt
    dealt = own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(_segments(path, end_id, segment_ids), _SEGMENTS).write.option("compression", "uncompressed").parquet(to)


def _documents(with_ids: bool):
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches):
        for batch in batches:
            for base, docs, lengths, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = Segment(payload).ids().astype("<u4").tobytes()
                cuts = np.cumsum([0, *lengths])
                own = [raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]
                columns = [docs, cuts[:-1] + base, lengths, [zlib.crc32(x) for x in own]] + [own] * with_ids
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def read_ids(spark: SparkSession, at: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32, and the ids with with_ids."""
    found = spark.read.schema(_SEGMENTS).parquet(at)
    shards = found.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each written file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = found.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("inside")).alias("start"), "doc_ids", "lengths", "payload")
    return rows.mapInArrow(_documents(with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
