"""F: fact verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as O
from .registry import ORACLE_SQL, op
from .views import spark_sql, view

CLAIMS = "SELECT CAST(floor(event_id / 8) AS BIGINT) AS fact_id, ts AS acted, user_id % 3 AS user_id, CASE WHEN event_type = 'click' THEN 'release' ELSE 'claim' END AS kind FROM events"


@op("F1", f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY acted, user_id, kind) AS r FROM ({CLAIMS})),
  s(fact_id, r, holder, conflicts) AS (SELECT DISTINCT fact_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM a
   UNION ALL SELECT s.fact_id, a.r, CASE WHEN a.kind = 'claim' THEN coalesce(s.holder, a.user_id) WHEN s.holder = a.user_id THEN NULL ELSE s.holder END, s.conflicts + CASE WHEN a.kind = 'claim' THEN CASE WHEN s.holder <> a.user_id THEN 1 ELSE 0 END ELSE CASE WHEN s.holder = a.user_id THEN 0 ELSE 1 END END
   FROM s JOIN a ON a.fact_id = s.fact_id AND a.r = s.r + 1)
  SELECT fact_id, arg_max_null(holder, r) AS holder, arg_max(conflicts, r) AS conflicts FROM s GROUP BY 1""")
def f1(spark, d):
    return O.fold_claims(spark_sql(spark, d, CLAIMS))


@op("F2", f"SELECT f.fact_id, CASE WHEN f.status = 'in_review' THEN 'confirmed' ELSE concat('conflict_', f.status) END AS outcome, f.status = 'in_review' AND NOT f.is_handwritten AS trusted, CASE WHEN f.status <> 'in_review' THEN c.holder END AS holder FROM v_facts AS f LEFT JOIN ({ORACLE_SQL['F1']}) AS c ON c.fact_id = f.fact_id WHERE f.fact_id % 3 = 0")
def f2(spark, d):
    """A confirmed fact loses its claim; one that cannot be confirmed keeps its holder."""
    from ..operators.graph import confirm

    facts = view(spark, d, "v_facts")
    acts = facts.filter("fact_id % 3 = 0").select("fact_id", "is_handwritten", F.lit("u").alias("user"))
    out = confirm(facts, acts.select("fact_id", "user"), "fact_id", "in_review", F.col("user"))
    claims = O.fold_claims(spark_sql(spark, d, CLAIMS)).select("fact_id", "holder")
    out = out.join(acts.select("fact_id", "is_handwritten"), "fact_id").join(claims, "fact_id", "left")
    confirmed = F.col("outcome") == "confirmed"
    return out.select("fact_id", "outcome", (confirmed & ~F.col("is_handwritten")).alias("trusted"), F.when(~confirmed, F.col("holder")).alias("holder"))


@op("F3", "SELECT fact_id, CASE WHEN field_name <> '_marginalia' THEN 'not_ambiguous' WHEN fact_id % 4 = 3 THEN 'bad_relation' ELSE 'resolved' END AS outcome, CASE WHEN field_name = '_marginalia' AND fact_id % 4 <> 3 THEN CASE fact_id % 4 WHEN 0 THEN 'vertical' WHEN 1 THEN 'horizontal' ELSE 'unrelated' END END AS human_decision FROM v_facts WHERE status = 'in_review'")
def f3(spark, d):
    relation = F.element_at(F.array(*map(F.lit, ["vertical", "horizontal", "unrelated", "diagonal"])), (F.col("fact_id") % 4 + 1).cast("int"))
    open_ = view(spark, d, "v_facts").filter("status = 'in_review'").withColumn("relation", relation)
    # marginalia stand for the ambiguous rows here, as the register makes none with facts
    outcome = F.when(F.col("field_name") != "_marginalia", "not_ambiguous").when(~F.col("relation").isin("vertical", "horizontal", "unrelated"), "bad_relation").otherwise("resolved")
    return open_.select("fact_id", outcome.alias("outcome"), F.when(outcome == "resolved", F.col("relation")).alias("human_decision"))


@op("F4", "SELECT fact_id, true AS is_handwritten, CASE WHEN status = 'machine' THEN 'in_review' ELSE status END AS status FROM v_facts WHERE fact_id % 7 = 0")
def f4(spark, d):
    marked = view(spark, d, "v_facts").filter("fact_id % 7 = 0")
    return marked.select("fact_id", F.lit(True).alias("is_handwritten"), F.when(F.col("status") == "machine", "in_review").otherwise(F.col("status")).alias("status"))


@op("F5", "SELECT f.fact_id, CASE WHEN c.folder_id IS NOT NULL AND f.status = 'in_review' AND f.confidence >= 0.4 AND NOT f.is_handwritten THEN 'verified' ELSE f.status END AS status, CASE WHEN c.folder_id IS NOT NULL AND f.status = 'in_review' AND f.confidence >= 0.4 AND NOT f.is_handwritten THEN d.folder_id END AS batch FROM v_facts AS f LEFT JOIN v_docs AS d USING (doc_id) LEFT JOIN v_calibration AS c ON c.folder_id = d.folder_id")
def f5(spark, d):
    return O.bulk_confirm(view(spark, d, "v_facts"), view(spark, d, "v_docs"), view(spark, d, "v_calibration"), 0.4).select("fact_id", "status", "batch")


TRUST = "SELECT field_name, count(*) FILTER (status = 'verified') AS confirmed, count(*) FILTER (status = 'in_review') AS corrected FROM v_facts WHERE substring(field_name, 1, 1) <> '_' AND NOT is_handwritten GROUP BY 1"


@op("F6", f"""WITH q AS (SELECT *, unnest(list_filter(['low_confidence', CASE WHEN is_handwritten AND field_name <> '_marginalia' THEN 'handwritten' END, CASE WHEN field_name IN ('_marginalia', '_join_mismatch', '_stitch_ambiguous') THEN substring(field_name, 2) END], lambda x: x IS NOT NULL)) AS category FROM v_facts WHERE status = 'in_review'),
  p AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, category ORDER BY confidence NULLS FIRST, fact_id) AS place, count(*) OVER (PARTITION BY tenant_id, category) AS total FROM q)
  SELECT p.tenant_id, p.category, p.fact_id, p.place, p.total, d.title, t.confirmed, t.corrected FROM p LEFT JOIN v_docs AS d USING (doc_id) LEFT JOIN ({TRUST}) AS t USING (field_name) WHERE place > 10 AND place <= 60""")
def f6(spark, d):
    facts = view(spark, d, "v_facts")
    known = facts.filter(~F.startswith("field_name", F.lit("_")) & ~F.col("is_handwritten")).groupBy("field_name").agg(F.count_if(F.col("status") == "verified").alias("confirmed"), F.count_if(F.col("status") == "in_review").alias("corrected"))
    return O.queue(facts, view(spark, d, "v_docs"), known, 50, 10).select("tenant_id", "category", "fact_id", "place", "total", "title", "confirmed", "corrected")


EDITS = "SELECT fact_id + CASE WHEN fact_id % 11 = 0 THEN 99 ELSE 0 END AS fact_id, CASE WHEN fact_id % 2 = 0 THEN value ELSE '7' END AS new_value FROM v_facts WHERE fact_id % 5 = 0"


@op("F7", f"SELECT e.fact_id, e.new_value, f.value AS old_value, CASE WHEN f.fact_id IS NULL THEN 'not_found' WHEN f.value = e.new_value THEN 'no_op' ELSE 'changed' END AS outcome, CASE WHEN f.fact_id IS NOT NULL AND f.value <> e.new_value AND f.status = 'in_review' THEN NOT f.is_handwritten ELSE false END AS correction FROM ({EDITS}) AS e LEFT JOIN v_facts AS f USING (fact_id)")
def f7(spark, d):
    return O.preview_edits(view(spark, d, "v_facts"), spark_sql(spark, d, EDITS)).select("fact_id", "new_value", "old_value", "outcome", F.coalesce("correction", F.lit(False)).alias("correction"))


@op("F8", "SELECT fact_id, value, status FROM v_facts")
def f8(spark, d):
    """Apply the edits, log them as JSON, and revert the batch from the log: the state is what it was."""
    facts = view(spark, d, "v_facts")
    preview = O.preview_edits(facts, spark_sql(spark, d, EDITS))
    log = preview.filter("outcome = 'changed'").select(F.to_json(F.struct(F.lit("b1").alias("batch_id"), "fact_id", "old_value", "old_status")).alias("details"))
    now = O.apply_edits(facts, preview)
    field = lambda n: F.get_json_object("details", f"$.{n}")
    undo = log.filter(field("batch_id") == "b1").select(field("fact_id").cast("long").alias("fact_id"), field("old_value").alias("old_value"), field("old_status").alias("old_status"))
    return now.join(undo, "fact_id", "left").select("fact_id", F.coalesce("old_value", "value").alias("value"), F.coalesce("old_status", "status").alias("status"))


@op("F9", "SELECT field_name, count(*) FILTER (status = 'verified') AS confirmed, count(*) FILTER (status = 'in_review') AS corrected FROM v_facts WHERE field_name NOT LIKE '\\_%' ESCAPE '\\' AND NOT is_handwritten GROUP BY 1")
def f9(spark, d):
    rows = view(spark, d, "v_facts").filter(~F.startswith("field_name", F.lit("_")) & ~F.col("is_handwritten"))
    return rows.groupBy("field_name").agg(F.count_if(F.col("status") == "verified").alias("confirmed"), F.count_if(F.col("status") == "in_review").alias("corrected"))


@op("F10", "SELECT f.fact_id, f.field_name, string_agg(concat(r.page_number, '@', CAST(round(r.y0 * 1000) AS BIGINT)), ',' ORDER BY r.page_number, r.y0) AS regions FROM v_facts AS f JOIN v_regions AS r USING (fact_id) WHERE r.page_number <= 3 GROUP BY ALL")
def f10(spark, d):
    regions = view(spark, d, "v_regions").filter("page_number <= 3").groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "y0"))).alias("x"))
    shown = F.array_join(F.transform("x", lambda r: F.concat(r["page_number"].cast("string"), F.lit("@"), F.round(r["y0"] * 1000).cast("long").cast("string"))), ",")
    return view(spark, d, "v_facts").join(regions, "fact_id").select("fact_id", "field_name", shown.alias("regions"))
