"""Streaming twins of the batch operators. Each runs over what is there (availableNow) and keeps its checkpoint beside
its output, so that a restart goes on where it stopped; started with another trigger they run on."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.governance import build_chain
from ..operators.staging import folder  # noqa: F401


#: Files that one micro-batch reads.
FILES_EACH = 16


def read(spark: SparkSession, sf_dir: str, table: str, at_once: bool = False) -> DataFrame:
    """A table as a stream. at_once: all files that are there are one batch, for what is ordered across them."""
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema)
    # else a batch is bounded by its files, whatever has piled up
    return (stream if at_once else stream.option("maxFilesPerTrigger", FILES_EACH)).parquet(f"{sf_dir}/{table}.parquet*")


def run(stream: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """Write a stream's rows to Parquet until its input is used up, and read them back."""
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    else:
        # a complete result replaces the one before it
        put = lambda df, _: df.write.mode("overwrite").parquet(f"{at}/rows")
        stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def ingest(stream: DataFrame, at: str, chunks_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Documents (doc_id, text, file_hash) once for each content hash, chunked: chunks with their file_hash.

    The hashes seen are state, so a batch reads nothing of earlier ones; of equal documents the first to arrive stays,
    any of those that arrive together. Batches are stored under their number, so a repeated batch replaces itself.

    What a batch brings is written before it is used twice: read from the state again, another of the documents that
    arrived together may come first, and the chunks of one would meet the hash of the other.
    """
    spark = keyed_state(stream.sparkSession)

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/fresh/batch={batch}")
        df = spark.read.schema(df.schema).parquet(f"{at}/fresh/batch={batch}")
        made = chunks_of(df.select("doc_id", "text")).join(df.select("doc_id", "file_hash"), "doc_id")
        made.write.mode("overwrite").parquet(f"{at}/chunks/batch={batch}")

    fresh = stream.select("doc_id", "text", "file_hash").dropDuplicates(["file_hash"])
    fresh.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/chunks")


def keyed_state(spark: SparkSession) -> SparkSession:
    """The session, with state kept in RocksDB beside the checkpoint rather than in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def stability_guard(stream: DataFrame, grace: float = 2 * 86_400, interval: float = 86_400) -> DataFrame:
    """path, poll_no, size when a file first has the size of the poll before and its last change is `grace` seconds old.

    stream: path, poll_no, size, mtime, poll_ts; polls are `interval` seconds apart and come in order, those of one
    batch in any. A file that a poll misses is forgotten: if it comes back it is another one. State of a path: its last
    poll, size, and whether it was taken; it comes and goes with the rows of many paths at once, and ends by a timeout
    once a poll is missed.
    """
    keyed_state(stream.sparkSession)
    grace_us, interval_us = int(grace * 1e6), int(interval * 1e6)
    columns = ["poll_no", "size", "mtime_us", "poll_us"]

    def run(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        polls = sorted(p for pdf in pdfs for p in zip(*(pdf[c].tolist() for c in columns)))
        last, size, done = state.get if state.exists else (None, None, False)
        out = []
        for poll, now, mtime, at in polls:
            if last is not None and poll <= last:
                continue  # told before
            if last is None or poll != last + 1:
                size, done = None, False  # it was gone in between, so this is another file
            if not done and now == size and at - mtime >= grace_us:
                out, done = [*out, (key[0], int(poll), int(now))], True
            last, size = int(poll), int(now)
        state.update((last, size, done))
        state.setTimeoutTimestamp(int(max(p[3] for p in polls) + 2 * interval_us) // 1000)
        if out:
            yield pd.DataFrame(out, columns=["path", "poll_no", "size"])

    rows = stream.select("path", "poll_no", "size", "poll_ts", F.unix_micros("mtime").alias("mtime_us"), F.unix_micros("poll_ts").alias("poll_us"))
    rows = rows.withWatermark("poll_ts", "0 seconds").groupBy("path")
    return rows.applyInPandasWithState(run, "path string, poll_no long, size long", "poll_no long, size long, done boolean", "append", "EventTimeTimeout")


#: What a batch of the audit chain leaves: its chained and late rows, those that wait, and the state of each tenant.
CHAIN = {
    "chain": "id long, tenant_id long, previous_hash string, event_hash string, ordinal string",
    "late": "id long, tenant_id long",
    "waiting": "tenant_id long, id long, at long, payload string",
    "tails": "tenant_id long, event_hash string, at long, id long, seen long",
}


def audit_chain(stream: DataFrame, at: str, delay: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(chain, late): the audit chain per tenant by time and id, and the rows that came too late to be in it.

    stream: id, tenant_id, created_at, payload; or at, a number that orders rows, in place of created_at. A row is chained once a row of its tenant is `delay` seconds later; until
    then it waits, so rows may come in any order within that time. What comes after its place in the chain was passed
    goes to the late table, as a chain cannot be ordered anew. A row without id tells the time alone.

    A batch reads what the one before it left: the tail of each tenant and the rows that wait. Spark sorts its rows, and
    they stream through the tenant's task, which keeps the last hash alone. Batches are stored under their number, so a
    repeated batch replaces itself.
    """
    spark, wait = stream.sparkSession, int(delay * 1e6)
    where = lambda kind, batch: f"{at}/{kind}/batch={batch}"
    for kind, schema in CHAIN.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(where(kind, -1))

    def put(df: DataFrame, batch: int) -> None:
        session = df.sparkSession
        left = lambda kind, n: session.read.schema(CHAIN[kind]).parquet(where(kind, n))
        keep = lambda rows, kind: rows.write.mode("overwrite").parquet(where(kind, batch))
        df.write.mode("overwrite").parquet(where("fresh", batch))
        df = session.read.schema(df.schema).parquet(where("fresh", batch))
        before = left("tails", batch - 1)
        seen = before.select("tenant_id", "seen").unionByName(df.select("tenant_id", F.col("at").alias("seen"))).groupBy("tenant_id").agg(F.max("seen").alias("seen"))
        tails = seen.join(before.drop("seen").withColumnsRenamed({"at": "tail_at", "id": "tail_id"}), "tenant_id", "left")
        columns = ["tenant_id", "id", "at", "payload"]
        rows = df.filter("id IS NOT NULL").select(*columns, F.lit(True).alias("fresh")).unionByName(left("waiting", batch - 1).select(*columns, F.lit(False).alias("fresh"))).join(tails, "tenant_id")
        passed = F.coalesce(F.col("fresh") & (F.struct("at", "id") <= F.struct(F.col("tail_at").alias("at"), F.col("tail_id").alias("id"))), F.lit(False))
        ready = F.col("at") <= F.col("seen") - wait
        keep(rows.filter(passed).select("id", "tenant_id"), "late")
        keep(rows.filter(~passed & ~ready).select(*columns), "waiting")
        # times as texts of one length, which sort as the times do
        due = rows.filter(~passed & ready).select("tenant_id", "id", (F.col("at") + 2**62).cast("string").alias("ordinal"), "payload")
        keep(build_chain(due, before.filter("event_hash IS NOT NULL").select("tenant_id", "event_hash")).select("id", "tenant_id", "previous_hash", "event_hash", "ordinal"), "chain")
        last = left("chain", batch).groupBy("tenant_id").agg(F.max_by(F.struct("event_hash", (F.col("ordinal").cast("long") - 2**62).alias("at"), "id"), F.struct("ordinal", "id")).alias("x"))
        new = lambda c, old: F.coalesce(f"x.{c}", old).alias(c)
        keep(tails.join(last, "tenant_id", "left").select("tenant_id", new("event_hash", "event_hash"), new("at", "tail_at"), new("id", "tail_id"), "seen"), "tails")

    rows = stream.select("tenant_id", "id", F.col("at") if "at" in stream.columns else F.unix_micros("created_at").alias("at"), "payload")
    rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    made = lambda kind, columns: spark.read.schema(CHAIN[kind]).parquet(f"{at}/{kind}").select(*columns)
    return made("chain", ["id", "tenant_id", "previous_hash", "event_hash"]), made("late", ["id", "tenant_id"])


def windowed_metrics(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window_start, calls, errors, avg_ms of tumbling windows. stream: created_at, status_code, response_time_ms."""
    g = stream.withWatermark("created_at", late).groupBy(F.window("created_at", width).alias("w"))
    out = g.agg(F.count("*").alias("calls"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.avg("response_time_ms").alias("avg_ms"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("window_start"), "calls", "errors", F.round("avg_ms", 4).alias("avg_ms"))
