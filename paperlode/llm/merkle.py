"""Merkle manifest of a dataset, with a proof for each row made by pointer jumping.

Rows become leaves, numbered in order within their lang. A tree's levels are folded in blocks of 1,024 nodes, ten
levels at a time, and each node notes the step to its parent: its sibling and the side it stands on. From then on a
node holds a segment of steps and points to where the segment ends. Joining the nodes with themselves by that pointer
doubles the distance and puts two segments together, until each leaf's segment reaches its root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import numbered
from .common import release, stage

#: Levels folded at once; a block has two to this power nodes.
BAND = 10
#: Rows and bytes up to which the ancestors of a round, or the trees, are broadcast.
FEW_ROWS, FEW_BYTES = 50_000, 8_000_000
#: A step: 0, 1 or 2 for no sibling, one on the left, one on the right; and its 32 bytes.
STEP = 33


def canonical(*columns: Column) -> Column:
    """`-` for a null, else the number of UTF-8 bytes, a colon and the value, one after another."""
    text = [c.cast("string") for c in columns]
    return F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text])


_NODES = pa.schema([("t", pa.int64()), ("n", pa.int64()), ("lev", pa.int32()), ("idx", pa.int64()), ("h", pa.string()), ("step", pa.binary())])


def _fold(base: int):
    """One block of nodes of level `base` -> all nodes of BAND levels with their steps, and those of the next level
    without; a tree's root has an empty step."""

    def run(key, table):
        t, n, block = (k.as_py() for k in key)
        table = table.sort_by("idx")
        level, first, rows = table.column("h").to_pylist(), block << BAND, []
        for lev in range(base, base + BAND):
            if n <= 1 << lev:
                rows.append((lev, 0, level[0], b""))
                break
            above = []
            for k in range(0, len(level), 2):
                a, b = level[k], level[k + 1] if k + 1 < len(level) else ""
                rows.append((lev, first + k, a, b"\2" + bytes.fromhex(b) if b else bytes(STEP)))
                if b:
                    rows.append((lev, first + k + 1, b, b"\1" + bytes.fromhex(a)))
                above.append(hashlib.sha256((a + b).encode()).hexdigest())
            level, first = above, first >> 1
        else:
            rows += [(base + BAND, first + k, h, None) for k, h in enumerate(level)]
        columns = [[t] * len(rows), [n] * len(rows), *zip(*rows)]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _NODES)], schema=_NODES)

    return run


def _few(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, broadcast if a count shows that it is small."""
    few = min(FEW_ROWS, FEW_BYTES // row_bytes)
    return F.broadcast(df) if df.limit(few + 1).count() <= few else df


def proofs(leaves: DataFrame, band_label: str = "merkle") -> tuple[DataFrame, DataFrame]:
    """leaves: t (tree), n (its leaves), idx (from 0), h (hex). Returns (t, root) and (t, idx, steps): the steps of
    each leaf up to its root as STEP bytes each."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes, level, base = None, leaves.select("t", "n", "idx", "h"), 0
    while base == 0 or most > 1 << (base - 1):
        blocks = level.withColumn("block", F.shiftright("idx", BAND)).groupBy("t", "n", "block")
        folded = stage(blocks.applyInArrow(_fold(base), "t long, n long, lev int, idx long, h string, step binary"), f"{band_label}-levels")
        done = folded.filter("step IS NOT NULL")
        nodes = done if nodes is None else nodes.unionByName(done)
        level, base = folded.filter("step IS NULL"), base + BAND
    roots = nodes.filter(F.octet_length("step") == 0).select("t", F.col("h").alias("root"))
    depth = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    to = F.when(F.col("lev") + 1 < depth, F.col("lev") + 1)  # the level where a segment ends; null: the root
    jumps, staged = nodes.select("t", "lev", "idx", F.col("step").alias("steps"), to.alias("to")), []
    reach, deepest = 1, (most - 1).bit_length() if most > 1 else 0
    while reach < deepest:
        ends = jumps.filter(F.col("lev") >= reach).select("t", F.col("lev").alias("__lev"), F.col("idx").alias("__idx"), F.col("steps").alias("__more"), F.col("to").alias("__to"))
        going = jumps.filter("to IS NOT NULL").withColumn("__lev", F.col("to")).withColumn("__idx", F.expr("shiftright(idx, to - lev)"))
        further = going.join(_few(ends, 64 + STEP * reach), ["t", "__lev", "__idx"]).select("t", "lev", "idx", F.concat("steps", "__more").alias("steps"), F.col("__to").alias("to"))
        reach *= 2
        # later rounds end at this level or above
        of = jumps.filter("to IS NULL").unionByName(further).filter((F.col("lev") == 0) | (F.col("lev") >= reach))
        jumps = stage(of, f"{band_label}-jumps")
        staged.append(jumps)
        if len(staged) > 1:
            release(staged[-2])
    return roots, jumps.filter("lev = 0").select("t", "idx", "steps")


def _step(i: Column) -> tuple[Column, Column]:
    """The kind of the i-th step of `steps`, and its sibling in hex."""
    kind = F.hex(F.col("steps").substr(i * STEP + 1, F.lit(1)))
    return kind, F.lower(F.hex(F.col("steps").substr(i * STEP + 2, F.lit(STEP - 1))))


def folded(leaf: Column) -> Column:
    """The root that a leaf and `steps` lead to."""

    def up(h: Column, i: Column) -> Column:
        kind, sibling = _step(i)
        return F.sha2(F.when(kind == "00", h).when(kind == "01", F.concat(sibling, h)).otherwise(F.concat(h, sibling)), 256)

    return F.aggregate(_places(), leaf, up)


def _places() -> Column:
    n = F.floor(F.octet_length("steps") / STEP).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def siblings() -> Column:
    """All siblings of `steps` in hex, put together."""
    one = F.transform(_places(), lambda i: F.when(_step(i)[0] != "00", _step(i)[1]).otherwise(F.lit("")))
    return F.array_join(one, "")


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    docs: doc_id, source, lang, n_chars, text, any of them null; other columns are left out. A leaf is the SHA-256
    (hex) of the five values in canonical form. The leaves of a lang ascend by doc_id (null first), equal ones by leaf;
    rows that repeat altogether are leaves of their own. Two consecutive nodes become one, a last one alone too, until
    one is left: the subroot of the lang, a lone leaf itself. Subroots in order of lang (null first, by bytes) lead to
    the root in the same way. proof_sha256 is the hash of the siblings on the way up, of nothing for a lone row. To show
    that changes are found, n_chars is raised by one (a null stays) where 7 divides the CRC-32 of the doc_id;
    folded_root is what such a leaf and the siblings give, and verified whether it is the root. An empty table has no
    rows.
    """
    doc_id, n_chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    other = n_chars.cast("decimal(20,0)") + 1
    leaf = lambda n: F.sha2(canonical(doc_id, F.col("source"), F.col("lang"), n, F.col("text")), 256)
    changed = (F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0) & n_chars.isNotNull()
    rows = docs.select(F.col("lang").cast("string").alias("lang"), doc_id.alias("doc_id"), leaf(n_chars).alias("leaf"), F.when(changed, leaf(other)).alias("changed"))
    # rows that repeat may be many: their place in the input tells them apart, so that ranges can split them
    placed = rows.withColumn("__at", F.monotonically_increasing_id())
    placed = stage(numbered(placed, "lang", "doc_id", "leaf", "__at").drop("__at"), "merkle-leaves")
    trees = stage(placed.groupBy("lang").agg(F.min("n").alias("t"), F.count("*").alias("size"), F.max(F.octet_length("lang")).alias("width")), "merkle-trees")
    width = trees.agg(F.max("width")).first()[0] or 0
    of = _few(trees.select(F.col("lang").alias("__lang"), "t", "size"), 64 + width)
    leaves = placed.join(of, F.col("lang").eqNullSafe(F.col("__lang"))).select("t", F.col("size").alias("n"), (F.col("n") - F.col("t")).alias("idx"), "doc_id", "leaf", "changed")
    subroots, up = proofs(leaves.withColumnRenamed("leaf", "h"))
    top = stage(numbered(subroots, "t"), "merkle-top")
    roots, over = proofs(top.select(F.lit(-1).cast("long").alias("t"), F.lit(trees.count()).cast("long").alias("n"), F.col("n").alias("idx"), F.col("root").alias("h")), "merkle-top")
    root = roots.first()  # one hash for the whole table
    last = top.select("t", F.col("root").alias("subroot"), "n").join(over.select(F.col("idx").alias("n"), F.col("steps").alias("__over")), "n").drop("n")
    last = stage(last.withColumn("root", F.lit(root.root if root else None).cast("string")), "merkle-roots")
    whole = leaves.join(up, ["t", "idx"]).join(_few(last, 256 + STEP * 64), "t").withColumn("steps", F.concat("steps", "__over"))
    whole = whole.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(), 256).alias("proof_sha256"), folded(F.coalesce("changed", "leaf")).alias("folded_root"))
    return whole.withColumn("verified", F.col("folded_root") == F.col("root"))
