"""Folder trees as adjacency tables. Paths upwards are followed by doubling: each round joins what is known with itself,
so that a tree of any depth takes as many rounds as its depth has bits. Rounds are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import stage


def ancestors(spark: SparkSession, folders: DataFrame) -> DataFrame:
    """(folder_id, ancestor_id, depth): each folder with itself at depth 0 and all above it, each once at its least depth."""
    known = stage(folders.select("folder_id", F.col("folder_id").alias("ancestor_id"), F.lit(0).alias("depth")), "above")
    jump = folders.filter("parent_id is not null").select(F.col("folder_id").alias("ancestor_id"), F.col("parent_id").alias("next"))
    step, n = 1, known.count()
    while True:
        further = known.join(jump, "ancestor_id").select("folder_id", F.col("next").alias("ancestor_id"), (F.col("depth") + step).alias("depth"))
        known = stage(known.unionByName(further).groupBy("folder_id", "ancestor_id").agg(F.min("depth").alias("depth")), "above")
        before, n = n, known.count()
        if n == before:
            return known
        jump = stage(jump.join(jump.select(F.col("ancestor_id").alias("next"), F.col("next").alias("after")), "next").select("ancestor_id", F.col("after").alias("next")), "jump")
        step *= 2


def _rooted(links: DataFrame) -> DataFrame:
    """folder_id of links (folder_id, up) from which following up ends; those that a cycle holds are left out."""
    now, left = stage(links, "up"), None
    while True:
        beyond = now.select(F.col("folder_id").alias("up"), F.col("up").alias("after"))
        now = stage(now.join(beyond, "up", "left").select("folder_id", F.col("after").alias("up")), "up")
        before, left = left, now.filter("up is not null").count()
        if left == before or not left:
            return now.filter("up is null").select("folder_id")


def tree(spark: SparkSession, folders: DataFrame) -> DataFrame:
    """folder_id, root_id, depth, path of live folders; one whose parent is missing or trashed is a root. Folders that
    only a cycle leads to have no root and are left out."""
    live = folders.filter("not is_trashed").select("folder_id", "parent_id", "name")
    parents = live.select(F.col("folder_id").alias("parent_id"), F.col("folder_id").alias("up"))
    links = live.join(parents, "parent_id", "left").select("folder_id", "up", "name")
    links = links.join(_rooted(links.select("folder_id", "up")), "folder_id", "left_semi")
    now = stage(links.select("folder_id", "up", F.col("folder_id").alias("root_id"), F.lit(0).alias("depth"), F.col("name").alias("path")), "tree")
    while not now.filter("up is not null").isEmpty():
        above = now.select(F.col("folder_id").alias("up"), F.col("up").alias("next"), F.col("root_id").alias("top"), F.col("depth").alias("more"), F.col("path").alias("head"))
        one = F.col("top").isNotNull()
        now = now.join(above, "up", "left").select(
            "folder_id", F.col("next").alias("up"), F.coalesce("top", "root_id").alias("root_id"), F.when(one, F.col("depth") + F.col("more") + 1).otherwise(F.col("depth")).alias("depth"),
            F.when(one, F.concat("head", F.lit("/"), "path")).otherwise(F.col("path")).alias("path"),
        )
        now = stage(now, "tree")
    return now.select("folder_id", "root_id", "depth", "path")


def judge_moves(spark: SparkSession, folders: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (folder_id, new_parent) with an outcome: self, cross_tenant, cycle or accepted."""
    above = ancestors(spark, folders).select(F.col("folder_id").alias("new_parent"), F.col("ancestor_id").alias("folder_id"), F.lit(True).alias("below"))
    tenants = folders.select("folder_id", "tenant_id")
    out = moves.join(above, ["folder_id", "new_parent"], "left").join(tenants, "folder_id").join(tenants.select(F.col("folder_id").alias("new_parent"), F.col("tenant_id").alias("other")), "new_parent", "left")
    outcome = F.when(F.col("folder_id") == F.col("new_parent"), "self").when(F.col("tenant_id") != F.col("other"), "cross_tenant").when(F.col("below"), "cycle").otherwise("accepted")
    return out.select("folder_id", "new_parent", outcome.alias("outcome"))
