"""Best-fit packing planned on the length histogram.

Best-fit decreasing runs over counts of lengths, of which there are at most `capacity`, never over documents: a group
of equally filled sequences is one entry, and a plan row gives `n` consecutive pieces of one length the same offset in
`n` consecutive sequences. Pieces then take their slots by joining on their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .token_ids import encoder, groups

#: Rows that take their ranks in one sort; a length with more of them is ranked in several parts.
RANKED_TOGETHER = 2_000


def plan(counts: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, n, first sequence, offset): ranks first..first+n-1 of a length go to as many sequences.

    counts: pieces of each length from 1 to capacity.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, sequences)
    rows, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            free = next((r for r in range(length, capacity) if room.get(r)), capacity)
            each = free // length
            if free == capacity:
                at, have = opened, -(-left // each)
                opened += have
            else:
                at, have = room[free].pop()
            full = min(have, left // each)
            parts = [(at, full, each)] if full else []
            if full < have and (rest := left - full * each):
                parts.append((at + full, 1, rest))
            for first, n, times in parts:
                for i in range(times):
                    rows.append((length, rank, n, first, capacity - free + i * length))
                    rank += n
                left -= n * times
                if free - times * length:
                    room.setdefault(free - times * length, []).append((first, n))
            used = sum(n for _, n, _ in parts)
            if used < have:
                room.setdefault(free, []).append((at + used, have - used))
    return rows


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches):
        encode, end = encoder(path).encode, np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for a, b in groups(batch):
                rows = []
                doc_ids, texts = (batch.column(i).slice(a, b - a).to_pylist() for i in range(2))
                for doc_id, raw in zip(doc_ids, encode(texts)):
                    ids = np.frombuffer(raw + end, "<u2").astype("<u4")
                    head = len(ids) % capacity
                    cuts = [0, *range(head or capacity, len(ids) + 1, capacity)]
                    for piece, (start, stop) in enumerate(zip(cuts, cuts[1:])):
                        own = ids[start:stop].tobytes()
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(own)) + (own,) * with_ids)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Place every document's tokens in sequences of at most `capacity` tokens.

    docs: doc_id, text (null: empty); other columns are left out. path: a tokenizers file. Returns per piece doc_id,
    piece, start, length, ids_crc32, sequence_id and offset, and with with_ids the ids as little-endian unsigned
    32-bit integers. Longer documents are cut so that only their first piece is shorter than `capacity`. Every row is
    a document, also one that repeats another; a null doc_id stays null. The length histogram and the plan are all
    that the driver sees: at most `capacity` counts, and a few rows of the plan for each.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = stage(own.mapInArrow(_pieces(path, end_id, capacity, with_ids), columns), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = spark.createDataFrame(plan(counts, capacity) or [(0, 0, 0, 0, 0)], "length long, first long, n long, sequence long, offset long")
    parts = spark.createDataFrame([(k, -(-n // RANKED_TOGETHER)) for k, n in counts.items()] or [(0, 1)], "length long, parts long")

    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "parts")).drop("parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = dealt.withColumn("within", F.row_number().over(order) - 1).join(bases, ["length", "part"])
    rank = F.col("base") + F.col("within")
    ranked = ranked.withColumn("rank", rank).drop("base", "within", "part")
    # at most one plan row fits a rank; the plan's size follows the capacity, not the data
    slots = F.broadcast(slots.withColumnRenamed("length", "of"))
    placed = ranked.join(slots, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    sequence = (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence, "offset", *["ids"] * with_ids)
