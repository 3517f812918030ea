"""G: records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as O
from .registry import op
from .views import view

BASE = "SELECT record_id, 'total' AS field, total AS value FROM v_records UNION ALL SELECT record_id, 'priority', priority FROM v_records UNION ALL SELECT record_id, 'order_status', order_status FROM v_records"
REPLAY = "SELECT record_id, field, arg_max(value, (e, c, a)) AS value, arg_max(p, (e, c, a)) AS provenance FROM (SELECT *, DATE '1900-01-01' AS e, CAST(-1 AS BIGINT) AS c, CAST(-1 AS BIGINT) AS a, 'base' AS p FROM ({base}) UNION ALL SELECT record_id, field, value, effective_date, created_order, amendment_id, concat('amendment ', amendment_id) FROM v_amendments WHERE {when}) GROUP BY 1, 2"
_FIELDS = ["total", "priority", "order_status"]


def base(spark, d):
    return O.fields_of(view(spark, d, "v_records"), _FIELDS)


@op("G1", "SELECT amendment_id, CASE WHEN record_id % 13 = 0 THEN 'creator' WHEN amendment_id % 17 = 0 THEN 'evidence' WHEN value = '0' THEN 'no_change' WHEN legal_status = 'superseded' AND amendment_id % 5 = 0 THEN 'legal_status' END AS reason FROM v_amendments")
def g1(spark, d):
    a = view(spark, d, "v_amendments").select(
        "amendment_id", F.when(F.col("record_id") % 13 != 0, 1).alias("creator"), F.when(F.col("amendment_id") % 17 != 0, 1).alias("evidence"), F.when(F.col("value") != "0", F.col("value")).alias("change"),
        F.when((F.col("legal_status") == "superseded") & (F.col("amendment_id") % 5 == 0), "unknown").otherwise(F.col("legal_status")).alias("legal_status"))
    bad = F.col("legal_status").isNotNull() & ~F.col("legal_status").isin(*O.STATUSES)
    return a.select("amendment_id", F.when(F.col("creator").isNull(), "creator").when(F.col("evidence").isNull(), "evidence").when(F.col("change").isNull(), "no_change").when(bad, "legal_status").alias("reason"))


@op("G2", "SELECT v.doc_id, CASE WHEN v.doc_id IN (SELECT f.doc_id FROM v_records AS r JOIN v_facts AS f ON f.fact_id = r.evidence_fact_id WHERE r.record_type = 'title') THEN 'statutory_record' ELSE v.retention_class END AS retention_class FROM v_docs AS v")
def g2(spark, d):
    facts = view(spark, d, "v_facts").select(F.col("fact_id").alias("evidence_fact_id"), "doc_id")
    held = view(spark, d, "v_records").filter("record_type = 'title'").join(facts, "evidence_fact_id").select("doc_id", F.lit(True).alias("held")).distinct()
    return view(spark, d, "v_docs").join(held, "doc_id", "left").select("doc_id", F.when(F.col("held"), "statutory_record").otherwise(F.col("retention_class")).alias("retention_class"))


@op("G3", REPLAY.format(base=BASE, when="true"))
def g3(spark, d):
    return O.replay(base(spark, d), view(spark, d, "v_amendments"))


@op("G4", f"SELECT record_id, field, value FROM ({BASE})")
def g4(spark, d):
    return base(spark, d)


@op("G5", "SELECT record_id, count(*) AS changes, string_agg(concat(effective_date, ' ', field, '=', value), ';' ORDER BY effective_date, created_order) AS history FROM v_amendments GROUP BY 1")
def g5(spark, d):
    rows = view(spark, d, "v_amendments").groupBy("record_id").agg(F.count("*").alias("changes"), F.array_sort(F.collect_list(F.struct("effective_date", "created_order", "field", "value"))).alias("x"))
    line = lambda r: F.concat(r["effective_date"].cast("string"), F.lit(" "), r["field"], F.lit("="), r["value"])
    return rows.select("record_id", "changes", F.array_join(F.transform("x", line), ";").alias("history"))


@op("G6", " UNION ALL ".join(f"SELECT DATE '{y}' AS as_of, record_id, field, value, provenance FROM ({REPLAY.format(base=BASE, when=f'''effective_date <= DATE '{y}' ''')})" for y in ("1996-01-01", "1999-06-30")))
def g6(spark, d):
    out = None
    for day in ("1996-01-01", "1999-06-30"):
        at = F.lit(day).cast("date")
        one = O.replay(base(spark, d), view(spark, d, "v_amendments").filter(F.col("effective_date") <= at)).select(at.alias("as_of"), "record_id", "field", "value", "provenance")
        out = one if out is None else out.unionByName(one)
    return out


STATUS = "SELECT r.record_id, coalesce(s.status, 'in force') AS status FROM v_records AS r LEFT JOIN (SELECT record_id, arg_max(legal_status, (effective_date, created_order)) AS status FROM v_amendments WHERE legal_status IS NOT NULL GROUP BY 1) AS s USING (record_id)"


@op("G7", STATUS)
def g7(spark, d):
    return O.latest_status(view(spark, d, "v_records"), view(spark, d, "v_amendments"))


@op("G8", f"SELECT t.status, count(s.record_id) AS n FROM (VALUES ('in force'), ('under stay'), ('set aside'), ('superseded'), ('quashed')) AS t(status) LEFT JOIN ({STATUS}) AS s USING (status) GROUP BY 1")
def g8(spark, d):
    # counts of four statuses and one that never occurs: zero rows stay
    all_ = spark.createDataFrame([(s,) for s in [*O.STATUSES, "quashed"]], "status string")
    n = g7(spark, d).groupBy("status").agg(F.count("*").alias("n"))
    return all_.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
