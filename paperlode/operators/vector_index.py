"""A coarse vector index as a table: trained centroids and an inverted file partitioned by centroid.

Vectors are compared by cosine, so they are kept at unit length and distances are angles. A list knows the largest
angle between its centroid and its vectors. By the triangle inequality no vector of a list is nearer to a query than
their centroid's angle less that radius, which tells the lists that an exact search may leave out; an approximate
search visits a stated share of the vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import folder, stage

#: Vectors that the centroids are trained on, at most: this many, and this many bytes of them.
SAMPLE_ROWS, SAMPLE_BYTES = 8_192, 32_000_000
#: Lists at most, so that the centroids stay small enough to ship to every task.
MOST_LISTS = 1_024
#: Rows of one side of a block that is scored at once.
BLOCK_ROWS = 3_000
#: Lists that a search by threshold meets in one block, and the queries of such a block; a score matrix stays far smaller.
GROUP, GROUP_QUERIES = 16, 12_000
#: Lists of an index for which no number is asked: these, or as many as leave a tenant a block in each.
LISTS = 64
#: What angles may be off by, in radians.
SLACK = 1e-6


def unit(e: Column) -> Column:
    """A vector at unit length, in double precision; null for a zero vector."""
    x = e.cast("array<double>")
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(n > 0, F.transform(x, lambda v: v / n))


def train(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids of unit length by spherical k-means, from rows spread over the sample; the same for the same rows."""
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ c.T, -1, 1))


@dataclass
class VectorIndex:
    """items: tenant_id, list, part, item_id, first (order of ties; null: no candidate), u. lists: list, n, radius, parts."""

    spark: SparkSession
    at: str | None
    items: DataFrame
    lists: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray

    @property
    def size(self) -> int:
        return int(self.sizes.sum())

    def _probes(self, queries: DataFrame, choose, extra: list[str]) -> DataFrame:
        """queries (query_id, variant, tenant_id, u, extra) with the lists that choose(angles, extra values) picks, and
        least, the first of the extra values: what a score must reach (null: anything)."""
        c, sizes, radii = self.centroids, self.sizes, self.radii
        rows = queries.select("query_id", "variant", "tenant_id", "u", *extra)
        kept = pa.schema([("query_id", pa.int64()), ("variant", pa.int32()), ("tenant_id", pa.int64()), ("u", pa.list_(pa.float64())), ("list", pa.int32()), ("least", pa.float64())])

        def run(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, BLOCK_ROWS):
                    some = batch.slice(a, BLOCK_ROWS)
                    off = some.column(3).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                    picked = choose(angles(off, c), sizes, radii, *(some.column(4 + i).to_numpy(zero_copy_only=False) for i in range(len(extra))))
                    q, at = np.nonzero(picked)
                    for b in range(0, len(q), 10 * BLOCK_ROWS):
                        own = pa.array(q[b : b + 10 * BLOCK_ROWS])
                        yield pa.record_batch([*(some.column(i).take(own).cast(kept.field(i).type) for i in range(4)), pa.array(at[b : b + 10 * BLOCK_ROWS].astype(np.int32)), some.column(4).take(own) if extra else pa.nulls(len(own), pa.float64())], schema=kept)

        return rows.mapInArrow(run, "query_id long, variant int, tenant_id long, u array<double>, list int, least double")

    def score(self, probes: DataFrame, k: int, least: float = -2.0, decimals: int = 6) -> DataFrame:
        """query_id, variant, tenant_id, item_id, s: the k best of each block for each of its probes, of at least
        `least` and of what the probe asks for, by rounded score and order of ties. A block of items meets a block of
        queries; both are bounded."""
        most = probes.groupBy("tenant_id", "list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("js"))
        asked = F.pmod(F.xxhash64("query_id", "variant"), "js").cast("int").alias("j")
        # lists has a row for each list, of which there are MOST_LISTS at most
        right = probes.join(most, ["tenant_id", "list"]).join(F.broadcast(self.lists.select("list", "parts")), "list")
        right = right.select("tenant_id", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), asked, "query_id", "variant", "u", F.coalesce("least", F.lit(least)).alias("least"))
        left = self.items.filter("first IS NOT NULL").join(most, ["tenant_id", "list"])
        left = left.select("tenant_id", "list", "part", F.explode(F.sequence(F.lit(0), F.col("js") - 1)).alias("j"), "item_id", "first", "u")

        def run(some: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            if not len(some) or not len(asking):
                return pd.DataFrame({"query_id": [], "variant": [], "tenant_id": [], "item_id": [], "s": []})
            some = some.sort_values("first", kind="stable")
            s = np.stack(asking.u.to_list()) @ np.stack(some.u.to_list()).T
            order = np.argsort(-np.round(s, decimals), axis=1, kind="stable")[:, :k]
            i, j = np.repeat(np.arange(len(asking)), order.shape[1]), order.ravel()
            # what rounding may make equal to the score asked for is kept
            kept = s[i, j] >= np.maximum(least, asking.least.to_numpy() - 2 * 10.0**-decimals)[i]
            i, j = i[kept], j[kept]
            return pd.DataFrame({"query_id": asking.query_id.to_numpy()[i], "variant": asking.variant.to_numpy()[i], "tenant_id": some.tenant_id.iloc[0], "item_id": some.item_id.to_numpy()[j], "s": s[i, j]})

        block = ["tenant_id", "list", "part", "j"]
        return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(run, "query_id long, variant int, tenant_id long, item_id long, s double")

    def nearby(self, queries: DataFrame, share: float) -> DataFrame:
        """The nearest lists of each query that hold this share of all vectors, one list at least."""

        def choose(a, sizes, radii):
            order = np.argsort(a, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            out = np.zeros(a.shape, bool)
            np.put_along_axis(out, order, before < max(1.0, share * sizes.sum()), axis=1)
            return out

        return self._probes(queries, choose, [])

    def within(self, queries: DataFrame, least: float) -> DataFrame:
        """All lists that may hold a vector with a cosine of at least `least` to the query. A vector's centroid is its
        nearest, so it also lies on its centroid's side of the plane between any two."""
        return self._probes(queries, self._within(least), [])

    def _within(self, least: float):
        c = self.centroids
        apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
        reach, chord = math.acos(min(1.0, least)), math.sqrt(2 - 2 * min(1.0, least))

        def choose(a, sizes, radii):
            cos, own = np.cos(a), a.argmin(axis=1)
            beyond = np.take_along_axis(cos, own[:, None], axis=1) - cos  # how far the query lies on the own side
            return (a <= radii + reach + SLACK) & (beyond <= apart[own] * chord + SLACK) & (sizes > 0)

        return choose

    def near(self, queries: DataFrame, k: int, least: float, decimals: int = 6) -> DataFrame:
        """What score(within(queries, least), k, least) finds. A query goes once to each group of lists, with a bit for
        each list that may hold a vector that near, and a group is met by many queries at once: vectors that travel for
        every pair of lists would take many times the disk."""
        groups, bits, choose = -(-len(self.centroids) // GROUP), 2 ** np.arange(GROUP), self._within(least)
        c, sizes, radii = self.centroids, self.sizes, self.radii

        def probe(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, BLOCK_ROWS):
                    some = batch.slice(a, BLOCK_ROWS)
                    picked = choose(angles(some.column(3).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1), c), sizes, radii)
                    wanted = np.pad(picked, ((0, 0), (0, groups * GROUP - picked.shape[1]))).reshape(len(picked), groups, GROUP) @ bits
                    for g in np.flatnonzero(wanted.any(axis=0)):
                        own = np.flatnonzero(wanted[:, g])
                        columns = [some.column(i).take(pa.array(own)) for i in range(4)]
                        yield pa.record_batch([*columns, pa.array(np.full(len(own), g, np.int32)), pa.array(wanted[own, g].astype(np.int32))], names=[*some.schema.names, "g", "lists"])

        rows = queries.select("query_id", F.col("variant").cast("int").alias("variant"), F.col("tenant_id").cast("long").alias("tenant_id"), "u")
        probes = rows.mapInArrow(probe, "query_id long, variant int, tenant_id long, u array<double>, g int, lists int")
        # parts of a group: a list that is dealt to several parts has one in each of as many blocks
        items = self.items.filter("first IS NOT NULL").withColumn("g", F.floor(F.col("list") / GROUP).cast("int"))
        most = queries.groupBy(F.col("tenant_id").cast("long").alias("tenant_id")).agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("js"))
        most = stage(most, "vector-parts")
        parts = stage(items.groupBy("tenant_id", "g").agg((F.max("part") + 1).alias("parts")), "vector-groups")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = items.join(most, "tenant_id").select("tenant_id", "g", "part", every("js").alias("j"), "list", "item_id", "first", "u")
        right = probes.join(most, "tenant_id").join(parts, ["tenant_id", "g"]).select("tenant_id", "g", every("parts").alias("part"), F.pmod(F.xxhash64("query_id", "variant"), "js").cast("int").alias("j"), "query_id", "variant", "u", "lists")

        def run(some: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(some) and len(asking):
                some = some.sort_values("first", kind="stable")
                u, lists, asked = np.stack(some.u.to_list()), some.list.to_numpy(), asking.lists.to_numpy()
                off = np.stack(asking.u.to_list())
                for own in np.unique(lists):
                    here, queries_ = np.flatnonzero(lists == own), np.flatnonzero(asked & bits[own % GROUP])
                    for a in range(0, len(queries_), 1_000):
                        q = queries_[a : a + 1_000]
                        s = off[q] @ u[here].T
                        near = s >= least
                        for r in np.flatnonzero(near.sum(axis=1) > k):  # of more than k the first by score, then as they stand
                            held = np.flatnonzero(near[r])
                            near[r, held[np.argsort(-np.round(s[r, held], decimals), kind="stable")[k:]]] = False
                        i, j = np.nonzero(near)
                        found.append((q[i], here[j], s[i, j]))
            if not found:
                return pd.DataFrame({"query_id": [], "variant": [], "tenant_id": [], "item_id": [], "s": []})
            i, j, s = (np.concatenate(x) for x in zip(*found))
            return pd.DataFrame({"query_id": asking.query_id.to_numpy()[i], "variant": asking.variant.to_numpy()[i], "tenant_id": some.tenant_id.iloc[0], "item_id": some.item_id.to_numpy()[j], "s": s})

        block = ["tenant_id", "g", "part", "j"]
        return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(run, "query_id long, variant int, tenant_id long, item_id long, s double")

    def search(self, queries: DataFrame, k: int, share: float = 0.1, exact: bool = True) -> DataFrame:
        """query_id, variant, item_id, s: candidates that hold the k best of each query (exact), or those that the
        nearest lists with this share of the vectors have. queries: query_id, variant, tenant_id, embedding.

        Exact search scores the nearest lists first; then a list is scored if its bound reaches the k-th best so far.
        """
        q = queries.select("query_id", F.col("variant").cast("int").alias("variant"), F.col("tenant_id").cast("long").alias("tenant_id"), unit(F.col("embedding")).alias("u")).filter("u IS NOT NULL")
        q = stage(q, "vector-queries")
        found = stage(self.score(self.nearby(q, share), k), "vector-hits")
        if not exact:
            return found
        key = ["query_id", "variant"]
        worst = found.groupBy(*key).agg(F.array_sort(F.collect_list("s"), lambda x, y: F.when(x > y, -1).when(x < y, 1).otherwise(0)).alias("best"))
        q = q.join(worst, key, "left").withColumn("kth", F.coalesce(F.try_element_at("best", F.lit(k)), F.lit(-1.0)))

        def choose(a, sizes, radii, kth):
            order = np.argsort(a, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            seen = np.zeros(a.shape, bool)
            np.put_along_axis(seen, order, before < max(1.0, share * sizes.sum()), axis=1)
            return ~seen & (sizes > 0) & (np.cos(np.maximum(a - radii - SLACK, 0)) >= kth[:, None] - 1e-6)

        return found.unionByName(self.score(self._probes(q, choose, ["kth"]), k))

    def share_of(self, probes: DataFrame) -> float:
        """Which share of all pairs of queries and vectors the probes score (tenants taken together)."""
        work = probes.join(F.broadcast(self.lists.select("list", "n")), "list").agg(F.sum("n").alias("n"), F.count_distinct("query_id", "variant").alias("q")).first()
        return (work.n or 0) / max(1, work.q * self.size)


def build(vectors: DataFrame, lists: int | None = None, write: bool = True) -> VectorIndex:
    """vectors: tenant_id, item_id, embedding, and first where ties have an order of their own (null: no candidate).

    Zero and null vectors take no part. lists: how many; else few, since a query is sent to each list that it
    visits. The sample that trains the centroids is bounded and drawn by a hash of the id; every vector is indexed. write: whether lists are
    written as partitions, for searches to come; an index for one search deals its rows as it goes.
    """
    spark = vectors.sparkSession
    order = F.col("first") if "first" in vectors.columns else F.col("item_id")
    rows = stage(vectors.select(F.col("tenant_id").cast("long").alias("tenant_id"), "item_id", order.alias("first"), unit(F.col("embedding")).alias("u")).filter("u IS NOT NULL"), "vectors")
    n, dim, tenants = rows.agg(F.count("*"), F.max(F.size("u")), F.count_distinct("tenant_id")).first()
    some = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * (dim or 1))))
    sample = _matrix(rows.orderBy(F.xxhash64("item_id"), "tenant_id").limit(some).select("u").toArrow().column("u").combine_chunks()) if n else np.zeros((1, 1))
    c = train(sample, max(1, min(MOST_LISTS, len(sample), lists or min(round(math.sqrt(n)), max(LISTS, n // (BLOCK_ROWS * max(1, tenants)))))))

    def assign(batches):
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, c.shape[1]))
            a = angles(x, c)
            own = a.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(a[np.arange(len(own)), own])], names=[*batch.schema.names, "list", "angle"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = stage(rows.mapInArrow(assign, f"{fields}, list int, angle double"), "vectors-placed")
    known = placed.groupBy("list", "tenant_id").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    known = known.groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("n").alias("most")).collect()  # a row for each list
    facts = spark.createDataFrame([(r.list, r.n, r.radius, -(-r.most // BLOCK_ROWS)) for r in known], "list int, n long, radius double, parts int")
    dealt = placed.join(F.broadcast(facts.select("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("item_id"), "parts").cast("int")).drop("parts", "angle")
    at, items = None, dealt
    if write:
        at = folder(spark, "vector-index")
        dealt.repartition("list", "part").sortWithinPartitions("list", "tenant_id").write.partitionBy("list").parquet(at)
        items = spark.read.schema(dealt.schema).parquet(at)
    sizes, radii = np.zeros(len(c)), np.zeros(len(c))
    for r in known:
        sizes[r.list], radii[r.list] = r.n, r.radius
    return VectorIndex(spark, at, items, facts, c, sizes, radii)
