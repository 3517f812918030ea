"""Chunks of documents as a table whose documents are replaced whole.

A document lives in the partition of its id's hash, as one state row and its chunk rows. Ingesting documents again
writes their partitions anew by dynamic partition overwrite: what other documents have there is kept, old chunks of
these go, and a document that failed keeps its state row alone. As each document has a state row, no partition that
must change is left out; a job that fails changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import folder, stage

ROWS = "doc_id long, status string, run long, page_number long, chunk_index long, token_count long, content string, bucket int"


@dataclass
class ChunkStore:
    spark: SparkSession
    at: str
    buckets: int = 32
    runs: int = 0

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(self.at)

    def states(self) -> DataFrame:
        """doc_id, status (indexed or failed), run: of all documents ever ingested and not removed."""
        return self._rows().filter("status IS NOT NULL").select("doc_id", "status", "run") if self.runs else self.spark.createDataFrame([], "doc_id long, status string, run long")

    def chunks(self) -> DataFrame:
        rows = self._rows() if self.runs else self.spark.createDataFrame([], ROWS)
        return rows.filter("status IS NULL").select("doc_id", "run", "page_number", "chunk_index", "token_count", "content")

    def reingest(self, pages: DataFrame, chunk: Callable[[DataFrame], DataFrame]) -> ChunkStore:
        """Replace the documents of pages (doc_id, page_number, text, extraction_failed) by chunks of their good pages.

        A document without chunks, or whose pages all failed, is purged and marked failed. pages are read twice and must
        be the same each time.
        """
        run = self.runs + 1
        pages = pages.select("doc_id", "page_number", "text", "extraction_failed")
        columns = [c.split()[0] for c in ROWS.split(", ")]
        # each task writes one bucket: their number is a multiple of the buckets, which are numbered as tasks are
        tasks = self.buckets * max(1, -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets))
        bucket = F.pmod(F.hash("doc_id"), F.lit(self.buckets)).cast("int")

        def made(pages: DataFrame) -> DataFrame:
            return chunk(pages.filter(~F.col("extraction_failed"))).select("doc_id", "page_number", "chunk_index", "token_count", "content")

        # no text is shuffled or written for the states; then each text is shuffled once, as pages, and its chunks are written
        status = F.when(F.col("held").isNull(), "failed").otherwise("indexed")
        held = made(pages).select("doc_id").distinct().withColumn("held", F.lit(True))
        states = pages.select("doc_id").distinct().join(held, "doc_id", "left").select("doc_id", status.alias("status"), F.lit(run).cast("long").alias("run"))
        states = stage(states, "ingest-states")
        new = made(pages.repartition(tasks, "doc_id")).withColumn("run", F.lit(run).cast("long"))
        rows = states.repartition(self.buckets, "doc_id").unionByName(new, allowMissingColumns=True).withColumn("bucket", bucket)
        if self.runs:
            touched = [r[0] for r in states.select(bucket.alias("b")).distinct().collect()]  # `buckets` at most
            old = self._rows().filter(F.col("bucket").isin(touched)).repartition(tasks, "doc_id")
            rows = rows.unionByName(old.join(states.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti"))
        rows.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(self.at)
        self.runs = run
        return self


def create(spark: SparkSession, buckets: int = 32) -> ChunkStore:
    return ChunkStore(spark, folder(spark, "chunk-store"), buckets)
