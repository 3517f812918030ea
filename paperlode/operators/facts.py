"""Fact verification: a state table joined with an action table gives new state and an outcome for each action.

Several actions on one fact are folded in order inside a sorted array, so a fact is one row and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTINELS = ["_marginalia", "_join_mismatch", "_stitch_ambiguous"]


def classify(confidence: Column, handwritten: Column, auto_commit: Column | float = 0.85) -> Column:
    return F.when(handwritten | confidence.isNull(), "in_review").when(confidence >= auto_commit, "machine").otherwise("in_review")


def fold_claims(actions: DataFrame) -> DataFrame:
    """fact_id, holder, conflicts: claims and releases in order; the first claimant holds, only the holder releases.

    actions: fact_id, acted, user_id, kind (claim or release).
    """
    ordered = F.array_sort(F.collect_list(F.struct("acted", "user_id", "kind")))
    start = F.struct(F.lit(None).cast("long").alias("holder"), F.lit(0).cast("long").alias("conflicts"))

    def step(s: Column, a: Column) -> Column:
        free, mine = s["holder"].isNull(), s["holder"] == a["user_id"]
        claim = F.when(free | mine, F.struct(a["user_id"].alias("holder"), s["conflicts"].alias("conflicts"))).otherwise(F.struct(s["holder"].alias("holder"), (s["conflicts"] + 1).alias("conflicts")))
        release = F.when(~free & mine, F.struct(F.lit(None).cast("long").alias("holder"), s["conflicts"].alias("conflicts"))).otherwise(F.struct(s["holder"].alias("holder"), (s["conflicts"] + 1).alias("conflicts")))
        return F.when(a["kind"] == "claim", claim).otherwise(release)

    out = actions.groupBy("fact_id").agg(F.aggregate(ordered, start, step).alias("s"))
    return out.select("fact_id", "s.holder", "s.conflicts")


def bulk_confirm(facts: DataFrame, docs: DataFrame, calibrated: DataFrame, threshold: float) -> DataFrame:
    """facts with status verified where the document's folder is calibrated, review is open, confidence is enough and
    nothing is handwritten; and the folder as batch."""
    out = facts.join(docs.select("doc_id", "folder_id"), "doc_id", "left").join(F.broadcast(calibrated.select("folder_id", F.lit(True).alias("cal"))), "folder_id", "left")
    passes = F.coalesce(F.col("cal"), F.lit(False)) & (F.col("status") == "in_review") & (F.col("confidence") >= threshold) & ~F.col("is_handwritten")
    passes = F.coalesce(passes, F.lit(False))
    return out.withColumn("batch", F.when(passes, F.col("folder_id"))).withColumn("status", F.when(passes, "verified").otherwise(F.col("status"))).drop("cal")


def queue(facts: DataFrame, docs: DataFrame, trust: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Open facts of each category by confidence, nulls first, from place offset + 1 on, with the category's total, the
    document's title and what is known of the field (trust: field_name, confirmed, corrected). Every open fact is in
    low_confidence; the handwritten ones but marginalia, and each kind of sentinel, are categories too."""
    sentinel = F.when(F.col("field_name").isin(*SENTINELS), F.substring("field_name", 2, 99))
    hand = F.when(F.col("is_handwritten") & (F.col("field_name") != SENTINELS[0]), "handwritten")
    rows = facts.filter("status = 'in_review'").withColumn("category", F.explode(F.array_compact(F.array(F.lit("low_confidence"), hand, sentinel))))
    totals = rows.groupBy("tenant_id", "category").agg(F.count("*").alias("total"))
    order = Window.partitionBy("tenant_id", "category").orderBy(F.asc_nulls_first("confidence"), "fact_id")
    page = rows.withColumn("place", F.row_number().over(order).cast("long")).filter((F.col("place") > offset) & (F.col("place") <= offset + limit))
    return page.join(totals, ["tenant_id", "category"]).join(docs.select("doc_id", "title"), "doc_id", "left").join(trust, "field_name", "left")


def preview_edits(facts: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (fact_id, new_value) with outcome not_found, no_op or changed, old value, and whether it corrects a review."""
    out = edits.join(facts.select("fact_id", "value", "status", "is_handwritten"), "fact_id", "left")
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("value").eqNullSafe(F.col("new_value")), "no_op").otherwise("changed")
    return out.select("fact_id", "new_value", F.col("value").alias("old_value"), F.col("status").alias("old_status"), outcome.alias("outcome"), ((outcome == "changed") & (F.col("status") == "in_review") & ~F.col("is_handwritten")).alias("correction"))


def apply_edits(facts: DataFrame, preview: DataFrame) -> DataFrame:
    changed = preview.filter("outcome = 'changed'").select("fact_id", "new_value", F.lit(True).alias("edited"))
    out = facts.join(changed, "fact_id", "left")
    return out.withColumn("value", F.when(F.col("edited"), F.col("new_value")).otherwise(F.col("value"))).withColumn("status", F.when(F.col("edited"), "in_review").otherwise(F.col("status"))).drop("new_value", "edited")
