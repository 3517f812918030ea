"""Records: append-only amendments replayed into states. A field's last write is one partial aggregate, not a sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ["in force", "under stay", "set aside", "superseded"]


def fields_of(records: DataFrame, fields: list[str]) -> DataFrame:
    """record_id, field, value of base rows."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return records.select("record_id", F.explode(pairs).alias("p")).select("record_id", "p.field", "p.value")


def replay(base: DataFrame, amendments: DataFrame) -> DataFrame:
    """record_id, field, value, provenance: the last write of each field, in the order of effective and creation date."""
    first = base.select("record_id", "field", F.struct("value", F.lit("base").alias("provenance")).alias("v"), F.struct(F.lit(None).cast("date").alias("effective_date"), F.lit(-1).cast("long").alias("created_order"), F.lit(-1).cast("long").alias("amendment_id")).alias("o"))
    later = amendments.select("record_id", "field", F.struct("value", F.concat(F.lit("amendment "), F.col("amendment_id").cast("string")).alias("provenance")).alias("v"), F.struct("effective_date", F.col("created_order").cast("long").alias("created_order"), F.col("amendment_id").cast("long").alias("amendment_id")).alias("o"))
    out = first.unionByName(later).groupBy("record_id", "field").agg(F.max_by("v", "o").alias("v"))
    return out.select("record_id", "field", "v.value", "v.provenance")


def latest_status(records: DataFrame, amendments: DataFrame) -> DataFrame:
    """record_id, status: the last status that is not null, else `in force`."""
    last = amendments.filter("legal_status is not null").groupBy("record_id").agg(F.max_by("legal_status", F.struct("effective_date", "created_order")).alias("s"))
    return records.select("record_id").join(last, "record_id", "left").select("record_id", F.coalesce("s", F.lit(STATUSES[0])).alias("status"))
