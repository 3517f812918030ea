"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are dealt to bands of nearly one length. In a band they are scaled to at most unit length and given one more
coordinate that makes them unit vectors, so that the largest inner product is the smallest distance. In each table a
vector's bucket is floor((a.x + b) / w) for a few normal vectors a. A query visits its own bucket and those next to
it, in the order of estimated success: a step across a nearer boundary first. Buckets of a table are dealt to parts of
a bounded number of vectors; in a part every visited bucket is scored exactly, by blocks, and the best of each query
are merged over parts, tables and bands. The longest bands, up to a fifth of all vectors, are what most queries find
in when lengths differ, at wide angles that hashing does not favour: they are visited whole. A query that finds fewer than it asked for is scored against all vectors.

Equal vectors are one entry, with its smallest ids: no more of them can be among a query's nearest.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


#: One part in so many of all vectors, the longest, is visited whole where lengths differ.
WHOLE = 5


class Plan(NamedTuple):
    """tables, hashes in each, bucket width and buckets visited in a table (None: as many as a sample needs); vectors that one part of a table holds,
    and queries that are answered together."""

    tables: int = 2
    hashes: int = 12
    width: float = 4.0
    probes: int | None = None  # chosen by a sample
    part_rows: int = 20_000
    together: int = 2_000
    seed: int = 7


def probe_order(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of boundaries to cross, in the order of their expected squared distance; boundaries are ranked by nearness.

    Of rank i and 2 * hashes - 1 - i, the two sides of one hash, a set holds one at most.
    """
    j, m = np.arange(1, hashes + 1), hashes
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    cost = np.concatenate([near, (1 - j / (m + 1) + j * (j + 1) / (4 * (m + 1) * (m + 2)))[::-1]])
    heap, out = [(cost[0], (0,))], [()]
    while heap and len(out) < probes:
        s, a = heapq.heappop(heap)
        if all(2 * m - 1 - x not in a for x in a):
            out.append(a)
        if a[-1] + 1 < 2 * m:
            heapq.heappush(heap, (s - cost[a[-1]] + cost[a[-1] + 1], (*a[:-1], a[-1] + 1)))
            heapq.heappush(heap, (s + cost[a[-1] + 1], (*a, a[-1] + 1)))
    return out


class Hasher:
    """The hashes of vectors of one dimension, the same in every task."""

    def __init__(self, plan: Plan, dim: int):
        r = np.random.default_rng([plan.seed, dim])
        self.plan = plan
        self.a = r.standard_normal((dim + 1, plan.tables, plan.hashes))
        self.b = r.random((plan.tables, plan.hashes)) * plan.width
        self.mix = r.integers(1, 2**62, plan.hashes) | 1
        self.sets = probe_order(plan.hashes, plan.probes or PROBES[0])

    def _places(self, x: np.ndarray) -> np.ndarray:
        return (np.tensordot(x, self.a, 1) + self.b) / self.plan.width

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables): each vector's bucket."""
        return (np.floor(self._places(x)).astype(np.int64) * self.mix).sum(axis=2)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables, probes): the buckets that queries visit."""
        m, at = self.plan.hashes, self._places(x)
        low = np.floor(at).astype(np.int64)
        order = np.argsort(np.concatenate([at - low, low + 1 - at], axis=2), axis=2)
        step = np.where(order < m, -1, 1) * self.mix[order % m]
        own = (low * self.mix).sum(axis=2)
        return np.stack([own + step[:, :, list(s)].sum(axis=2) for s in self.sets], axis=2)


#: Buckets visited in a table: the first of these with which a sample reaches the recall. The sample has so many vectors
#: at most, and so many bytes, and so many of them ask.
PROBES, RECALL, SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_QUERIES = (300, 600, 1200, 2400, 4096), 0.92, 2_000, 16_000_000, 200


def needed_probes(plan: Plan, x: np.ndarray, longest: dict[int, float], band: np.ndarray, k: int) -> int:
    """The fewest probes of PROBES with which queries from the sample x reach the recall against all of x, if any do.

    Few vectors lie farther apart than many, so a sample asks for no fewer probes than the whole.
    """
    h = Hasher(plan._replace(probes=PROBES[-1]), x.shape[1])
    keys = np.concatenate([h.keys(_unit(x[i : i + 1], longest[int(b)])) for i, b in enumerate(band)])
    asked = np.linspace(0, len(x) - 1, min(SAMPLE_QUERIES, len(x))).astype(int)
    first = np.full((len(asked), k), len(h.sets))  # the probe that meets a neighbour
    for i, q in enumerate(asked):
        s = x @ x[q]
        s[q] = -np.inf
        near = np.argsort(-s, kind="stable")[: min(k, len(x) - 1)]
        visits = h.probed(_directions(x[q : q + 1]))[0]
        for t in range(plan.tables):
            order = np.argsort(visits[t], kind="stable")
            at = np.minimum(np.searchsorted(visits[t][order], keys[near, t]), len(order) - 1)
            met = np.where(visits[t][order][at] == keys[near, t], order[at], len(h.sets))
            first[i, : len(near)] = np.minimum(first[i, : len(near)], met)
        first[i, len(near) :] = 0
    return next((p for p in PROBES if (first < p).mean() >= RECALL), PROBES[-1])


def _unit(x: np.ndarray, longest: float) -> np.ndarray:
    """Scaled by the longest vector's length, with the coordinate that completes them to unit length."""
    y = x / longest
    return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1, keepdims=True)))])


def _directions(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])


_DEALT = "part long, rid long, query boolean, e array<double>, keys array<bigint>"
_DEALT_SCHEMA = pa.schema([("part", pa.int64()), ("rid", pa.int64()), ("query", pa.bool_()), ("e", pa.list_(pa.float64())), ("keys", pa.list_(pa.int64()))])


def _vectors(batches, dim: int, rows: int = 500):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            some = batch.slice(at, rows)
            rid = some.column(0).to_numpy(zero_copy_only=False)
            yield rid, np.array(some.column(1).to_pylist(), bool), some.column(3).to_numpy(zero_copy_only=False), some.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(rid), dim)


class Parts(NamedTuple):
    """Of one dimension: band -> (longest vector, first part, parts of a table, whether it is visited whole); and part -> pieces of it, where it
    holds more vectors than it should."""

    bands: dict[int, tuple[float, int, int, bool]]
    pieces: dict[int, int]


def _homes(h: Hasher, plan: Plan, parts: Parts, rid: np.ndarray, band: np.ndarray, x: np.ndarray):
    """(rows, parts, keys) of each table, for vectors at home."""
    for b in np.unique(band):
        longest, first, many, whole = parts.bands[int(b)]
        own = np.flatnonzero(band == b)
        if whole:
            yield own, first + _spread(rid[own], np.full(len(own), many)), np.zeros(len(own), np.int64)
            continue
        keys = h.keys(_unit(x[own], longest))
        for t in range(plan.tables):
            yield own, first + t * many + keys[:, t] % many, keys[:, t]


def _counted(plan: Plan, dim: int, parts: Parts):
    def run(batches):
        h = Hasher(plan, dim)
        for rid, _, band, x in _vectors(batches, dim):
            yield pa.record_batch([pa.array(np.concatenate([p for _, p, _ in _homes(h, plan, parts, rid, band, x)]))], ["part"])

    return run


_PIECE = 1 << 20  # a part's pieces are numbered below this


def _spread(rid: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    return ((rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % pieces.astype(np.uint64)).astype(np.int64)


def _deal(plan: Plan, dim: int, parts: Parts):
    def run(batches):
        h = Hasher(plan, dim)
        for rid, asks, band, x in _vectors(batches, dim):
            rows = []
            for own, part, keys in _homes(h, plan, parts, rid, band, x):
                piece = _spread(rid[own], np.array([parts.pieces.get(p, 1) for p in part.tolist()], np.int64))
                rows += zip((part * _PIECE + piece).tolist(), rid[own].tolist(), [False] * len(own), x[own], keys[:, None])
            if asks.any():
                q, ids = x[asks], rid[asks].tolist()
                for i, visits in enumerate(h.probed(_directions(q))):
                    for _, first, many, whole in parts.bands.values():
                        for t, own in enumerate(visits[:0] if whole else visits):
                            at = own % many
                            for p in np.unique(at):
                                part, keys = int(first + t * many + p), own[at == p]
                                rows += [(part * _PIECE + c, ids[i], True, q[i], keys) for c in range(parts.pieces.get(part, 1))]
                        if whole:
                            rows += [(p * _PIECE + c, ids[i], True, q[i], [0]) for p in range(first, first + many) for c in range(parts.pieces.get(p, 1))]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _DEALT_SCHEMA)], schema=_DEALT_SCHEMA)

    return run


def _deal_to_all(dim: int, blocks: int):
    """Vectors to blocks, queries to every block: all under one key. A row asks, or is a vector."""

    def run(batches):
        for rid, asks, _, x in _vectors(batches, dim):
            home = _spread(rid, np.full(len(rid), blocks)).tolist()
            rows = [(b, rid[i], bool(asks[i]), x[i], [0]) for i in range(len(rid)) for b in (range(blocks) if asks[i] else home[i : i + 1])]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _DEALT_SCHEMA)], schema=_DEALT_SCHEMA)

    return run


def _best(q: np.ndarray, score: np.ndarray, rid: np.ndarray, k: int):
    """The first k rows of each q by score downwards, then rid."""
    order = np.lexsort((rid, -score, q))
    q = q[order]
    head = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
    return order[rank < k]


def _search_part(vectors, vids, vkeys, queries, qids, qkeys, k: int):
    """Rows (query rid, rid, score) of one part, its vectors in the order of keys: each query's k best of the buckets it visits."""
    who = np.repeat(np.arange(len(qids)), [len(x) for x in qkeys])
    visited = np.concatenate(qkeys)
    order = np.argsort(visited, kind="stable")
    who, visited = who[order], visited[order]
    keys, begins = np.unique(visited, return_index=True)
    ends = np.append(begins[1:], len(visited))
    lows, highs = np.searchsorted(vkeys, keys, "left"), np.searchsorted(vkeys, keys, "right")
    floor = np.full(len(qids), -np.inf)
    held, size = [], 0

    def compact():
        q, v, s = (np.concatenate(c) for c in zip(*held))
        keep = _best(q, s, vids[v], k)
        q, v, s = q[keep], v[keep], s[keep]
        full = np.flatnonzero(np.bincount(q, minlength=len(qids)) >= k)
        lowest = np.full(len(qids), np.inf)
        np.minimum.at(lowest, q, s)
        floor[full] = lowest[full]
        return [(q, v, s)], 0

    for a, b, low, high in zip(begins, ends, lows, highs):
        rows = max(1, 2_000_000 // max(high - low, 1))
        for at in range(a, b if high > low else a, rows):
            own = who[at : min(b, at + rows)]
            s = queries[own] @ vectors[low:high].T
            i, j = np.nonzero(s >= floor[own][:, None] - 1e-9)
            held.append((own[i], j + low, s[i, j]))
            size += len(i)
            if size > max(100_000, 64 * len(qids)):
                held, size = compact()
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, v, _ = (np.concatenate(c) for c in zip(*held))
    s = np.empty(len(q))
    for at in range(0, len(q), 100_000):  # one sum for a pair, whatever the block it was found in
        s[at : at + 100_000] = (queries[q[at : at + 100_000]] * vectors[v[at : at + 100_000]]).sum(axis=1)
    keep = _best(q, s, vids[v], k)
    return qids[q[keep]], vids[v[keep]], s[keep]


def _search(dim: int, k: int, together: int):
    schema = pa.schema([("qid", pa.int64()), ("rid", pa.int64()), ("score", pa.float64())])

    def run(batches):
        # rows come sorted by part, vectors first; of the queries only some are held at a time
        part, held, vectors, n = None, [], None, 0

        def taken():
            table = pa.Table.from_batches(held)
            e = table.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), dim)
            keys = table.column("keys").combine_chunks()
            return e, table.column("rid").to_numpy(), keys.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(keys.value_lengths().to_numpy(zero_copy_only=False)))

        def sorted_by_key():
            e, rid, keys, _ = taken()
            order = np.argsort(keys, kind="stable")
            return e[order], rid[order], keys[order]

        def answer():
            e, rid, keys, cuts = taken()
            found = _search_part(*vectors, e, rid, [keys[a:b] for a, b in zip(cuts, cuts[1:])], k)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(found, schema)], schema=schema)

        for batch in batches:
            parts, asks = batch.column(0).to_numpy(), np.array(batch.column(2).to_pylist(), bool)
            edges = np.flatnonzero(np.append(True, (parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1]))) if len(parts) else []
            for a, b in zip(edges, [*edges[1:], len(parts)]):
                if parts[a] != part:
                    if held and vectors is not None:
                        yield answer()
                    part, held, vectors, n = parts[a], [], None, 0
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if vectors is None:
                    if not held:
                        continue  # a part without vectors
                    vectors, held = sorted_by_key(), []
                for at in range(a, b, together):
                    held.append(batch.slice(at, min(together, b - at)))
                    n += held[-1].num_rows
                    if n >= together:
                        yield answer()
                        held, n = [], 0
        if held and vectors is not None:
            yield answer()

    return run


def _answers(dealt: DataFrame, parts: int, dim: int, k: int, together: int) -> DataFrame:
    met = dealt.repartition(max(1, parts), "part").sortWithinPartitions("part", "query", "rid")
    return met.mapInArrow(_search(dim, k, together), "qid long, rid long, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, plan: Plan = Plan()) -> DataFrame:
    """For each vector whose vec_id is divisible by `every`, its k nearest found: query_id, rank, vec_id, score.

    vectors: vec_id, embedding; other columns are left out. Nearness: largest inner product of the original vectors,
    in double precision; ties go to the smaller vec_id; a query's own row is no candidate. Rows take no part whose
    vec_id or vector is null, or whose vector is empty, zero or holds null or non-finite components; equal rows count
    once; vectors of different lengths never meet. A query that finds fewer than k is scored against all rows, in
    blocks. The driver learns the lengths and bands that occur, how many distinct vectors each has, the longest of each,
    and which parts hold more than part_rows vectors.
    """
    e = F.col("embedding").cast("array<double>")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).filter("vec_id is not null and size(e) > 0")
    own = own.filter(~bad & F.exists("e", lambda x: x != 0.0)).distinct()
    reps = stage(own.groupBy("e").agg(F.min("vec_id").alias("rid"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("asks")), "vectors")
    members = stage(own.join(reps, "e").select("rid", "vec_id"), "members")
    # by the largest component, so that no square is too large or too small
    top = F.array_max(F.transform("e", lambda x: F.abs(x)))
    norm = top * F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + (x / top) * (x / top)))
    band = F.floor(2 * F.log2(norm) + 0.5)  # lengths near 1 are amid a band
    # two bands for each doubling of length: a bounded number of rows
    shapes = reps.groupBy(F.size("e").alias("dim"), band.alias("band")).agg(F.count("*").alias("n"), F.max(norm).alias("longest")).collect()

    found = None
    for dim in sorted({x.dim for x in shapes}):
        rows = reps.filter(F.size("e") == dim).select("rid", (F.col("asks") == 1).alias("query"), "e", band.alias("band"))
        bands, parts = {}, 0
        total, seen = sum(x.n for x in shapes if x.dim == dim), 0
        for x in sorted((x for x in shapes if x.dim == dim), key=lambda x: -x.band):
            many, seen = max(1, -(-x.n // plan.part_rows)), seen + x.n
            bands[x.band] = (x.longest, parts, many, seen * WHOLE <= total)
            parts += many * (1 if bands[x.band][3] else plan.tables)
        if plan.probes is None:
            some = min(SAMPLE_ROWS, max(2, SAMPLE_BYTES // (8 * dim)))
            sample = rows.orderBy(F.xxhash64("rid")).limit(some).select("e", "band").toArrow()
            x = sample.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            chosen = plan._replace(probes=needed_probes(plan, x, {b: v[0] for b, v in bands.items()}, sample.column("band").to_numpy(), k))
        else:
            chosen = plan
        layout = Parts(bands, {})
        sizes = rows.mapInArrow(_counted(chosen, dim, layout), "part long").groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > plan.part_rows)
        layout = Parts(bands, {x.part: -(-x.n // plan.part_rows) for x in sizes.collect()})
        dealt = rows.mapInArrow(_deal(chosen, dim, layout), _DEALT)
        one = _answers(dealt, parts + sum(layout.pieces.values()), dim, k + 1, plan.together)
        one = stage(one.groupBy("qid", "rid").agg(F.max("score").alias("score")), "found")
        # queries that found fewer than there are to find
        enough = one.groupBy("qid").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k + 1, total)).select(F.col("qid").alias("rid"))
        short = stage(rows.filter("query").join(enough, "rid", "left_anti"), "short")
        blocks = max(1, -(-total // plan.part_rows))
        if not short.isEmpty():
            against = rows.withColumn("query", F.lit(False)).unionByName(short)
            one = one.unionByName(_answers(against.mapInArrow(_deal_to_all(dim, blocks), _DEALT), blocks, dim, k + 1, plan.together))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    # one more than asked for, as the query's own vector is among them
    best = found.groupBy("qid", "rid").agg(F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rid"))).filter(F.col("r") <= k + 1)
    ids = members.withColumn("r", F.row_number().over(Window.partitionBy("rid").orderBy("vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    lists = best.drop("r").join(ids, "rid").withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    lists = lists.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    asking = members.filter(F.col("vec_id") % every == 0).select(F.col("rid").alias("qid"), F.col("vec_id").alias("query_id"))
    mine = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return asking.join(lists, "qid").select("query_id", F.posexplode(mine).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
