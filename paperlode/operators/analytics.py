"""Operational counts: single-pass aggregates, top-k by window limits, per-tenant joins of small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import numbered


def top(df: DataFrame, k: int, order: list, by: list[str] | None = None) -> DataFrame:
    """The first k rows of each group (of all rows without groups); the order must be total."""
    w = Window.partitionBy(*by).orderBy(*order) if by else None
    if w is None:
        return df.orderBy(*order).limit(k)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def counts_by(df: DataFrame, key: Column | str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def overview(parts: dict[str, DataFrame]) -> DataFrame:
    """tenant_id and one count for each part (tenant_id, n); a tenant missing in a part has 0 there."""
    rows = None
    for name, part in parts.items():
        one = part.select("tenant_id", *[(F.col("n") if p == name else F.lit(0).cast("long")).alias(p) for p in parts])
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("tenant_id").agg(*[F.sum(p).alias(p) for p in parts])


def status_class(code: Column) -> Column:
    return F.when(code < 300, "2xx").when(code < 400, "3xx").when(code < 500, "4xx").otherwise("5xx")


def api_overview(log: DataFrame, as_of: str) -> DataFrame:
    today = F.to_date("created_at") == F.lit(as_of).cast("date")
    bad = F.count_if(F.col("status_code") >= 400)
    return log.agg(F.count("*").alias("total"), F.count_if(today).alias("today"), F.round(F.avg("response_time_ms"), 2).alias("avg_ms"), F.round(100.0 * bad / F.count("*"), 2).alias("error_rate"))


def endpoints(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "path").agg(F.count("*").alias("calls"), F.round(F.avg("response_time_ms"), 2).alias("avg_ms"), F.max("response_time_ms").alias("max_ms"))


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """min, max, mean and nearest-rank percentiles: the value at place int(n * p), the last at most."""
    n = df.filter(F.col(value).isNotNull()).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 4).alias("mean"))
    # ranks come from counts of equal values, summed over ranges
    values = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ranked = numbered(values, "v", by="c").select("v", (F.col("n") + F.col("c")).alias("upto"), "c")
    at = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1) + 1
    hit = lambda p: F.max(F.when((at(p) <= F.col("upto")) & (at(p) > F.col("upto") - F.col("c")), F.col("v")))
    return ranked.crossJoin(F.broadcast(n)).groupBy("n", "min", "max", "mean").agg(*[hit(p).alias(k) for k, p in shares.items()])
