"""Postings of the keyword leg kept as a table: term counts of documents, partitioned by a hash of the term.

A search reads the partitions of its terms alone and never the texts. An update appends the counts of the documents it
brings, and a version for each of them; counts of earlier versions no longer match and are left out by a join of hits
with versions, which are small rows. `compact` writes the table anew without them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import LIMIT, TERM, item_terms, keyword_hits, query_terms
from .staging import folder

COUNTS = "version long, item_id long, tenant_id long, analyzer string, term string, tf long, bucket int"
VERSIONS = "version long, item_id long, live boolean"


@dataclass
class Postings:
    """A table of postings at a shared folder; `buckets` partitions by term."""

    spark: SparkSession
    at: str
    buckets: int = 64
    version: int = 0

    def update(self, items: DataFrame, removed: DataFrame | None = None) -> Postings:
        """Index items (item_id, tenant_id, content), in place of what earlier updates hold of them; removed: item_id.

        Counts are written before versions: a search in between sees the state before, and so does one after a failed
        update, as rows of a version that was never recorded match nothing.
        """
        self.version += 1
        # dealt by item before they are taken apart, texts are shuffled once and their counts need no shuffle of their own
        counts = item_terms(items.repartition("item_id")).groupBy("item_id", *TERM).agg(F.count("*").alias("tf"))
        counts = counts.withColumn("version", F.lit(self.version).cast("long")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        counts.repartition("bucket", F.pmod(F.xxhash64("item_id"), F.lit(8))).write.mode("append").partitionBy("bucket").parquet(f"{self.at}/counts")
        versions = items.select("item_id").withColumn("live", F.lit(True))
        if removed is not None:
            versions = versions.unionByName(removed.select("item_id").withColumn("live", F.lit(False)))
        versions.distinct().withColumn("version", F.lit(self.version).cast("long")).write.mode("append").parquet(f"{self.at}/versions")
        return self

    def _counts(self) -> DataFrame:
        return self.spark.read.schema(COUNTS).parquet(f"{self.at}/counts")

    def current(self) -> DataFrame:
        """item_id and version of all items that are not removed; each item's latest version counts."""
        rows = self.spark.read.schema(VERSIONS).parquet(f"{self.at}/versions")
        last = rows.groupBy("item_id").agg(F.max(F.struct("version", "live")).alias("v"))
        return last.filter("v.live").select("item_id", "v.version")

    def search(self, queries: DataFrame, k: int = LIMIT) -> DataFrame:
        """The keyword leg of queries (query_id, tenant_id, query) over the current items."""
        q = query_terms(queries)
        wanted = [r[0] for r in q.select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).distinct().collect()]  # `buckets` at most
        asked = self._counts().filter(F.col("bucket").isin(wanted)).drop("bucket")
        found = asked.join(q.select(*TERM).distinct(), TERM, "left_semi").join(self.current(), ["item_id", "version"])
        return keyword_hits(q, found.select("item_id", *TERM, "tf"), k)

    def compact(self) -> Postings:
        """The current state as a new table."""
        new = Postings(self.spark, folder(self.spark, "postings"), self.buckets, 1)
        live = self.current()
        counts = self._counts().join(live, ["item_id", "version"], "left_semi").withColumn("version", F.lit(1).cast("long"))
        counts.repartition("bucket", F.pmod(F.xxhash64("item_id"), F.lit(8))).write.partitionBy("bucket").parquet(f"{new.at}/counts")
        live.select("item_id", F.lit(True).alias("live"), F.lit(1).cast("long").alias("version")).write.parquet(f"{new.at}/versions")
        return new


def create(items: DataFrame, buckets: int = 64) -> Postings:
    """Postings of all items (item_id, tenant_id, content)."""
    spark = items.sparkSession
    return Postings(spark, folder(spark, "postings"), buckets).update(items)
