"""Tables written to the shared folder and read again, and rows numbered over ranges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir; where that is unset and all tasks run
    on this machine, it is set here. A cluster must name one, as its executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="paperlode-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/paperlode-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends in files that every executor sees."""
    at = folder(df.sparkSession, label)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def numbered(df: DataFrame, *order: str | Column, by: str | None = None) -> DataFrame:
    """df with n, the place of a row from 0 in the given order (with by: the sum of that column before the row).

    Rows are dealt by ranges and written; each range is summed, and starts where those before it end. No task sees
    more than a range. The order must be total.
    """
    names = [f"__o{i}" for i in range(len(order))]
    dealt = df.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(n) for o, n in zip(order, names)])
    dealt = stage(dealt.repartitionByRange(*names).withColumn("__part", F.spark_partition_id()), "ranges")
    weight = F.col(by).cast("long") if by else F.lit(1).cast("long")
    sums = dealt.groupBy("__part").agg(F.sum(weight).alias("__sum"))  # a row for each range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("__at", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(F.broadcast(starts), "__part")
    return out.withColumn("n", F.col("__start") + F.col("__at")).drop("__part", "__start", "__at", *names)
