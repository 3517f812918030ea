"""Governance: audit chains, completeness, retention, scope and metering."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "genesis:"
#: Names and bounds of confidence: fixed values.
BUCKETS = [("0.00-0.50", 0.0, 0.5), ("0.50-0.70", 0.5, 0.7), ("0.70-0.85", 0.7, 0.85), ("0.85-0.95", 0.85, 0.95), ("0.95-1.00", 0.95, 1.01)]


def payload(*columns: str) -> Column:
    """The canonical text of an audit row: its columns, nulls empty, joined by a bar."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def build_chain(rows: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """id, tenant_id, ordinal, payload, previous_hash, event_hash of rows (tenant_id, ordinal, id, payload), chained
    per tenant from its last hash (tenant_id, event_hash) on, or from its genesis.

    A hash needs the one before it, so a tenant is one sequence; rows are sorted by Spark and stream through the
    tenant's task batch by batch, which keeps only the last hash. The rows are dealt by a hash of the tenant: by the tenant
    itself Spark would leave that out after a join by tenant, and such a join may give a large tenant to several tasks.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    start = F.sha2(F.concat(F.lit(GENESIS), F.col("tenant_id").cast("string")), 256)
    if last is not None:
        rows = rows.join(last.select("tenant_id", F.col("event_hash").alias("start")), "tenant_id", "left")
        start = F.coalesce("start", start)
    sorted_rows = rows.select("tenant_id", "ordinal", "id", "payload", start.alias("start")).repartition(parts, F.xxhash64("tenant_id")).sortWithinPartitions("tenant_id", "ordinal", "id", "payload")

    def run(batches):
        tenant, last = None, ""
        for pdf in batches:
            before, after = [], []
            for t, text, start in zip(pdf["tenant_id"], pdf["payload"], pdf["start"]):
                if t != tenant:
                    tenant, last = t, start
                before.append(last)
                last = hashlib.sha256((last + text).encode()).hexdigest()
                after.append(last)
            yield pd.DataFrame({"id": pdf["id"], "tenant_id": pdf["tenant_id"], "ordinal": pdf["ordinal"], "payload": pdf["payload"], "previous_hash": before, "event_hash": after})

    return sorted_rows.mapInPandas(run, "id long, tenant_id long, ordinal string, payload string, previous_hash string, event_hash string")


def verify_chain(chain: DataFrame) -> DataFrame:
    """tenant_id, checked, unchained, first_bad, reason: broken_link or altered; rows without a hash are not chained."""
    w = Window.partitionBy("tenant_id").orderBy("ordinal", "id")
    rows = chain.filter("event_hash is not null")
    want = F.coalesce(F.lag("event_hash").over(w), F.sha2(F.concat(F.lit(GENESIS), F.col("tenant_id").cast("string")), 256))
    rows = rows.withColumn("want", want).withColumn("n", F.row_number().over(w))
    bad = F.when(F.col("previous_hash") != F.col("want"), "broken_link").when(F.sha2(F.concat("previous_hash", "payload"), 256) != F.col("event_hash"), "altered")
    rows = rows.withColumn("bad", bad)
    out = rows.groupBy("tenant_id").agg(F.count("*").alias("checked"), F.min(F.when(F.col("bad").isNotNull(), F.struct("n", "id", "bad"))).alias("f"))
    loose = chain.filter("event_hash is null").groupBy("tenant_id").agg(F.count("*").alias("unchained"))
    return out.join(loose, "tenant_id", "left").select("tenant_id", "checked", F.coalesce("unchained", F.lit(0)).alias("unchained"), F.col("f.id").alias("first_bad"), F.col("f.bad").alias("reason"))


def admit_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted, refused) audit events: one without an actor is refused, a policy's too; a policy_version is merged into
    the details (a JSON object, or null), so that the chain covers it."""
    plain = F.regexp_replace(F.coalesce("details", F.lit("{}")), r"\s*\}\s*$", "")
    merged = F.concat(plain, F.when(plain.rlike(r"^\s*\{$"), "").otherwise(", "), F.lit('"policy_version": "'), F.col("policy_version"), F.lit('"}'))
    rows = events.withColumn("details", F.when(F.col("policy_version").isNotNull(), merged).otherwise(F.col("details")))
    return rows.filter("actor_id IS NOT NULL"), rows.filter("actor_id IS NULL").withColumn("reason", F.lit("actor"))


def completeness(docs: DataFrame, pages: DataFrame, loss: DataFrame, furniture: DataFrame) -> DataFrame:
    """Per tenant and corpus (folder, or root), without trashed documents: documents, pages, failed_pages, with_failures,
    loss_words, with_loss, with_furniture. pages: doc_id, extraction_failed; loss: doc_id, missing; furniture: doc_id."""
    of = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("extraction_failed").alias("failed_pages"))
    rows = docs.filter("NOT is_trashed").select("tenant_id", F.coalesce("folder_id", F.lit("root")).alias("corpus"), "doc_id")
    rows = rows.join(of, "doc_id", "left").join(loss.select("doc_id", "missing"), "doc_id", "left").join(furniture.select("doc_id").distinct().withColumn("furnished", F.lit(True)), "doc_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy("tenant_id", "corpus").agg(
        F.count("*").alias("documents"), total("pages").alias("pages"), total("failed_pages").alias("failed_pages"), F.count_if(F.col("failed_pages") > 0).alias("with_failures"),
        total("missing").alias("loss_words"), F.count_if(F.col("missing") > 0).alias("with_loss"), F.count_if("furnished").alias("with_furniture"),
    )


def bucket(confidence: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, low, high in BUCKETS:
        out = F.when((confidence >= low) & (confidence < high), name).otherwise(out)
    return out


def sweep_documents(docs: DataFrame, classes: DataFrame, actors: DataFrame, as_of: str) -> DataFrame:
    """tenant_id, doc_id, outcome (protected, pending, purge, skipped) and days remaining of trashed documents."""
    trashed = docs.filter("is_trashed and trashed_at is not null").join(F.broadcast(classes), docs.retention_class == classes.class_name, "left").join(actors, "tenant_id", "left")
    elapsed = F.datediff(F.lit(as_of).cast("date"), "trashed_at")
    outcome = F.when(F.col("retention_days").isNull(), "protected").when(elapsed < F.col("retention_days"), "pending").when(F.col("actor_id").isNull(), "skipped").otherwise("purge")
    remaining = F.when(outcome == "pending", F.greatest(F.col("retention_days") - elapsed, F.lit(0)).cast("long"))
    return trashed.select("tenant_id", "doc_id", outcome.alias("outcome"), remaining.alias("days_remaining"))


def policy_actors(users: DataFrame) -> DataFrame:
    """tenant_id, actor_id: an it_admin with the smallest id, else the smallest id."""
    return users.groupBy("tenant_id").agg(F.min_by("user_id", F.struct(F.col("role") != "it_admin", "user_id")).alias("actor_id"))


def meter(usage: DataFrame, plans: DataFrame, as_of: str) -> DataFrame:
    """usage (tenant_id, plan_key, status, trial_ends_at, docs, bytes) with the first decision that holds."""
    u = usage.join(F.broadcast(plans), "plan_key", "left")
    decision = (
        F.when((F.col("status") == "trialing") & (F.col("trial_ends_at") < F.lit(as_of).cast("date")), "expired").when(F.col("status").isin("expired", "canceled"), F.col("status"))
        .when(F.col("docs") >= F.col("max_documents"), "document_limit").when(F.col("bytes") >= F.col("max_storage_bytes"), "storage_limit").otherwise("allowed")
    )
    return u.select("tenant_id", "plan_key", "docs", "bytes", decision.alias("decision"))
