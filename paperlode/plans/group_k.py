"""K: templates and classification."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import op
from .views import view


@op("K1", "SELECT form, CASE WHEN n_fields = 0 THEN 'empty' WHEN missing > 0 THEN 'name_missing' WHEN dups > 0 THEN 'duplicate_name' WHEN layout NOT IN ('single_page', 'spread') THEN 'layout' WHEN form % 4 = 1 AND form > 1 THEN 'not_unique' END AS violation FROM (SELECT p_size AS form, count(*) FILTER (p_partkey % 3 <> 0) AS n_fields, count(*) FILTER (p_partkey % 3 <> 0 AND p_partkey % 91 = 1) AS missing, count(p_name) FILTER (p_partkey % 3 <> 0 AND p_partkey % 91 <> 1) - count(DISTINCT p_name) FILTER (p_partkey % 3 <> 0 AND p_partkey % 91 <> 1) AS dups, CASE WHEN p_size % 5 = 0 THEN 'poster' ELSE 'spread' END AS layout FROM part GROUP BY p_size)")
def k1(spark, d):
    """Field schemas made of parts: a template for each size, whose fields are its part names."""
    p = view(spark, d, "part")
    name = F.when(F.col("p_partkey") % 91 != 1, F.col("p_name"))
    listed = F.col("p_partkey") % 3 != 0
    t = p.groupBy(F.col("p_size").alias("form")).agg(F.count_if(listed).alias("n"), F.count_if(listed & name.isNull()).alias("missing"), (F.count(F.when(listed, name)) - F.count_distinct(F.when(listed, name))).alias("dups"))
    layout = F.when(F.col("form") % 5 == 0, "poster").otherwise("spread")
    key = F.when(F.col("form") % 4 == 1, 1).otherwise(F.col("form"))  # form and era of the template
    first = F.row_number().over(Window.partitionBy(key).orderBy("form")) == 1
    t = t.withColumn("first", first)
    return t.select("form", F.when(F.col("n") == 0, "empty").when(F.col("missing") > 0, "name_missing").when(F.col("dups") > 0, "duplicate_name").when(~layout.isin("single_page", "spread"), "layout").when(~F.col("first"), "not_unique").alias("violation"))


RULES = "SELECT * FROM (VALUES ('owner', true, 'string', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), '[1-3]', CAST(NULL AS STRING)), ('area', true, 'number', 5.0, 40.0, CAST(NULL AS STRING), CAST(NULL AS STRING)), ('village', false, 'string', NULL, NULL, NULL, '|1|2|3|4|5|11|22|33|44|'), ('survey_no', false, 'integer', 0.0, 30.0, NULL, NULL)) AS t(field_name, required, kind, low, high, pattern, allowed)"


@op("K2", f"SELECT fact_id, CASE WHEN v IS NULL THEN CASE WHEN required THEN 'required' END WHEN kind <> 'string' AND try_cast(v AS DOUBLE) IS NULL THEN 'type' WHEN try_cast(v AS DOUBLE) < low AND kind <> 'string' THEN 'below_min' WHEN try_cast(v AS DOUBLE) > high AND kind <> 'string' THEN 'above_max' WHEN pattern IS NOT NULL AND NOT regexp_matches(v, concat('^(?:', pattern, ')')) THEN 'pattern' WHEN allowed IS NOT NULL AND NOT contains(allowed, concat('|', v, '|')) THEN 'not_allowed' END AS violation FROM (SELECT fact_id, field_name, CASE WHEN fact_id % 29 = 0 THEN NULL WHEN fact_id % 31 = 0 THEN 'x' ELSE value END AS v FROM v_facts) AS f JOIN ({RULES}) AS r USING (field_name)")
def k2(spark, d):
    v = F.when(F.col("fact_id") % 29 == 0, None).when(F.col("fact_id") % 31 == 0, "x").otherwise(F.col("value"))
    f = view(spark, d, "v_facts").select("fact_id", "field_name", v.alias("v")).join(F.broadcast(spark.sql(RULES)), "field_name")
    number, typed = F.expr("try_cast(v AS DOUBLE)"), F.col("kind") != "string"
    pattern = F.col("pattern").isNotNull() & ~F.expr("v rlike concat('^(?:', pattern, ')')")
    allowed = F.col("allowed").isNotNull() & ~F.contains("allowed", F.concat(F.lit("|"), "v", F.lit("|")))
    reason = F.when(F.col("v").isNull(), F.when(F.col("required"), "required")).when(typed & number.isNull(), "type").when(typed & (number < F.col("low")), "below_min").when(typed & (number > F.col("high")), "above_max").when(pattern, "pattern").when(allowed, "not_allowed")
    return f.select("fact_id", reason.alias("violation"))


LABELS = ["deed | old", "deed | new", "register | any", "map | any"]


@op("K3", f"SELECT doc_id, list_filter([{', '.join(repr(x) for x in LABELS)}], lambda t: contains(reply, t))[1] AS label, CASE WHEN len(list_filter([{', '.join(repr(x) for x in LABELS)}], lambda t: contains(reply, t))) > 0 THEN 'classified' ELSE 'unclassified' END AS status FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'deed | old' WHEN 1 THEN 'it is a deed | new, or map | any' WHEN 2 THEN 'none' WHEN 3 THEN 'register | any' WHEN 4 THEN 'map | any' ELSE 'deed' END AS reply FROM documents)")
def k3(spark, d):
    tails = F.array(*map(F.lit, ["deed | old", "it is a deed | new, or map | any", "none", "register | any", "map | any", "deed"]))
    docs = view(spark, d, "documents").select("doc_id", F.concat(F.lit("thinking: map | any\n"), F.element_at(tails, (F.col("doc_id") % 6 + 1).cast("int"))).alias("reply"))
    last = F.element_at(F.split(F.trim("reply"), "\n"), -1)
    label = F.coalesce(*[F.when((last == t) | F.contains(last, F.lit(t)), t) for t in LABELS])
    return docs.select("doc_id", label.alias("label"), F.when(label.isNotNull(), "classified").otherwise("unclassified").alias("status"))


@op("K4", "SELECT doc_id, place, total, CASE doc_id % 3 WHEN 0 THEN 'classified' WHEN 1 THEN 'dismissed' ELSE 'unclassified' END AS after FROM (SELECT doc_id, tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, doc_id DESC) AS place, count(*) OVER (PARTITION BY tenant_id) AS total FROM v_docs WHERE doc_id % 6 IN (2, 5) AND NOT is_trashed) WHERE place <= 50")
def k4(spark, d):
    open_ = view(spark, d, "v_docs").filter("doc_id % 6 IN (2, 5) AND NOT is_trashed")
    totals = open_.groupBy("tenant_id").agg(F.count("*").alias("total"))
    order = Window.partitionBy("tenant_id").orderBy(F.desc("created_at"), F.desc("doc_id"))
    page = open_.withColumn("place", F.row_number().over(order).cast("long")).filter("place <= 50").join(totals, "tenant_id")
    action = F.when(F.col("doc_id") % 3 == 0, "classified").when(F.col("doc_id") % 3 == 1, "dismissed").otherwise("unclassified")
    return page.select("doc_id", "place", "total", action.alias("after"))
