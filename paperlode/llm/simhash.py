"""SimHash near-duplicates: pigeonhole blocks, joined and verified by Hamming distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, release, stage, trim
from .components import components

_BITS = np.array([[x >> b & 1 for b in range(8)] for x in range(256)], np.int64)


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 (seed 42) of every run of `shingle` words, repeats included; texts of fewer words are one run."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    k = min(shingle, len(words))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(words) - k + 1
    return np.fromiter((digest(join(x), 42) for x in zip(*(words[i : i + n] for i in range(k)))), np.uint64, n)


def majority(found: np.ndarray) -> int:
    """64 bits, each set where more than half of the hashes have it; no hashes: 0."""
    n = len(found)
    if n < 400:
        ones = np.unpackbits(found.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        columns = found.view(np.uint8).reshape(n, 8)
        ones = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """The majority bits of a text's hashes."""
    return majority(hashes(text, shingle))


def _fingerprints(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        held("fingerprints", dict)  # what this worker holds of other work goes
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([ids, pa.array(found.view(np.int64))], schema=schema)
        trim()

    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def block_masks(n: int, distance: int) -> list[int]:
    """Masks of which one at least agrees between any two fingerprints within `distance` bits.

    With `distance + j` blocks every set of j blocks is a mask; j grows with the number of fingerprints n, so that a
    masked value is shared by few of them by chance. Any j finds the same links.
    """
    blocks = distance + 1
    while 2.0 ** (64 * (blocks - distance) / blocks) < n / 4 and blocks < 2 * distance:
        blocks += 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(parts, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(node, root) for each distinct fingerprint of fps (column fp) linked to a smaller root.

    In every block bucket each fingerprint is first compared with two hubs, which joins groups of near copies without
    their pairs. Only buckets that still hold several components are then compared across components, all but their
    largest component against every row; so no link is lost, and no pair inside a component is formed.
    """
    fps = fps.select("fp")
    masks = [signed(m) for m in block_masks(fps.count(), distance)]
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)))).alias("b")).select("fp", "b.t", "b.key")
    order = F.struct(F.xxhash64("fp", "t"), "fp")
    hubs = keyed.groupBy("t", "key").agg(F.min(order)["fp"].alias("h1"), F.max(order)["fp"].alias("h2")).filter("h1 <> h2")
    rows = stage(keyed.join(hubs, ["t", "key"]), "blocks")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    hub = rows.filter(near("fp", "h1")).select(F.col("fp").alias("u"), F.col("h1").alias("v")).union(rows.filter(near("fp", "h2")).select("fp", "h2"))
    first = components(hub)

    named = rows.select("t", "key", "fp").join(first.select(F.col("node").alias("fp"), "root"), "fp", "left")
    named = stage(named.select("t", "key", "fp", F.coalesce("root", "fp").alias("c")), "named")
    sizes = named.groupBy("t", "key", "c").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("t", "key").agg(F.max_by("c", F.struct("n", "c")).alias("major"), F.count("*").alias("cs")).filter("cs > 1").select("t", "key", "major")
    shared = stage(named.join(mixed, ["t", "key"]), "mixed")
    minor = shared.filter("c <> major").select("t", "key", F.col("fp").alias("fp1"), F.col("c").alias("u"))
    every = shared.select("t", "key", F.col("fp").alias("fp2"), F.col("c").alias("v"))
    across = minor.join(every, ["t", "key"]).filter(near("fp1", "fp2") & (F.col("u") != F.col("v"))).select("u", "v")
    own = first.select(F.col("node").alias("u"), F.col("root").alias("v"))
    out = components(own.union(across))
    release(rows, named, shared)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    docs: doc_id, text; other columns are ignored. Text null, empty or without words: fingerprint zero, linked like
    any other. Each row counts, also repeats; a null doc_id is kept and never names a component that has another id.
    """
    found = stage(fingerprints(docs, shingle), "fingerprints")
    classes = stage(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    linked = links(classes, distance)
    rooted = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
