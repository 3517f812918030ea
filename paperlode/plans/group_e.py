"""E: duplicates and entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.staging import stage
from .registry import op
from .views import spark_sql, view

COS = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) / sqrt(list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[])))"


def vectors(spark, d):
    # every tenth document stands for a second upload of the one four before it
    docs, e = view(spark, d, "v_docs"), view(spark, d, "embeddings")
    first = F.when(docs.doc_id % 10 == 4, docs.doc_id - 4).otherwise(docs.doc_id)
    return docs.join(e, first == e.vec_id).select("tenant_id", "doc_id", (~F.col("is_trashed")).alias("can_match"), F.col("embedding").alias("e"))


@op("E1", f"""WITH v AS (SELECT tenant_id, doc_id, is_trashed, embedding FROM v_docs JOIN embeddings ON vec_id = CASE WHEN doc_id % 10 = 4 THEN doc_id - 4 ELSE doc_id END), p AS (SELECT a.tenant_id, a.doc_id, b.doc_id AS other_id, {COS.format('a.embedding', 'b.embedding')} AS s FROM v AS a JOIN v AS b ON a.tenant_id = b.tenant_id AND a.doc_id <> b.doc_id AND NOT b.is_trashed)
  SELECT tenant_id, doc_id, other_id, round_even(s, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, doc_id ORDER BY round(s, 6) DESC, other_id) AS r FROM p WHERE s >= 0.92) WHERE r <= 10""")
def e1(spark, d):
    return G.fuzzy_duplicates(vectors(spark, d))


@op("E2", "SELECT tenant_id, file_hash, count(*) AS copies, arg_min(doc_id, (created_at, doc_id)) AS keep FROM v_docs GROUP BY 1, 2 HAVING count(*) > 1")
def e2(spark, d):
    return view(spark, d, "v_docs").groupBy("tenant_id", "file_hash").agg(F.count("*").alias("copies"), F.min_by("doc_id", F.struct("created_at", "doc_id")).alias("keep")).filter("copies > 1")


@op("E3", r"""WITH n AS (SELECT * FROM v_nodes), l AS (SELECT DISTINCT tenant_id, entity_type, label FROM n),
  w AS (SELECT *, concat('  ', unnest(list_filter(string_split_regex(lower(label), '[^\p{L}\p{N}]+'), lambda x: x <> '')), ' ') AS w FROM l),
  g AS (SELECT DISTINCT tenant_id, entity_type, label, substring(w, i, 3) AS g FROM (SELECT *, unnest(range(1, length(w) - 1)) AS i FROM w)),
  c AS (SELECT tenant_id, entity_type, label, count(*) AS size FROM g GROUP BY ALL),
  p AS (SELECT a.tenant_id, a.entity_type, a.label, b.label AS other, count(*) AS n FROM g AS a JOIN g AS b USING (tenant_id, entity_type, g) GROUP BY ALL),
  s AS (SELECT p.*, p.n / CAST(ca.size + cb.size - p.n AS DOUBLE) AS s FROM p JOIN c AS ca ON (p.tenant_id, p.entity_type, p.label) = (ca.tenant_id, ca.entity_type, ca.label) JOIN c AS cb ON (p.tenant_id, p.entity_type, p.other) = (cb.tenant_id, cb.entity_type, cb.label)),
  m AS (SELECT a.tenant_id, a.entity_type, a.node_id, b.node_id AS other_id, s.s, row_number() OVER (PARTITION BY a.tenant_id, a.entity_type, a.node_id ORDER BY s.s DESC, b.node_id) AS r FROM s JOIN n AS a ON (s.tenant_id, s.entity_type, s.label) = (a.tenant_id, a.entity_type, a.label) JOIN n AS b ON (s.tenant_id, s.entity_type, s.other) = (b.tenant_id, b.entity_type, b.label) WHERE s.s >= 0.45 AND a.node_id <> b.node_id)
  SELECT tenant_id, entity_type, node_id, other_id, round_even(s, 4) AS similarity FROM m WHERE r <= 5""")
def e3(spark, d):
    return G.similar_labels(view(spark, d, "v_nodes"))


ASKS = ["r#00000001", "ring", "0001", "SMALL"]


@op("E4", f"SELECT query, node_id, label FROM (SELECT q.query, n.node_id, n.label, row_number() OVER (PARTITION BY q.query ORDER BY n.label, n.node_id) AS r FROM (VALUES {', '.join(f'({a!r})' for a in ASKS)}) AS q(query) JOIN v_nodes AS n ON contains(lower(n.label), lower(q.query))) WHERE r <= 20")
def e4(spark, d):
    from ..operators.analytics import top

    asked = spark.createDataFrame([(a,) for a in ASKS], "query string")  # the queries: a fixed list
    hits = view(spark, d, "v_nodes").join(F.broadcast(asked), F.contains(F.lower("label"), F.lower("query")))
    return top(hits.select("query", "node_id", "label"), 20, ["label", "node_id"], ["query"])


@op("E5", "SELECT node_id, CASE WHEN trim(t) = '' THEN 'entity_type' WHEN trim(l) = '' THEN 'label' WHEN actor IS NULL THEN 'actor' END AS reason FROM (SELECT node_id, CASE WHEN length(label) % 7 = 0 THEN ' ' ELSE entity_type END AS t, CASE WHEN length(node_id) % 4 = 1 THEN '' ELSE label END AS l, CASE WHEN tenant_id = 2 THEN NULL ELSE 1 END AS actor FROM v_nodes)")
def e5(spark, d):
    n = view(spark, d, "v_nodes").select("node_id", F.when(F.length("label") % 7 == 0, " ").otherwise(F.col("entity_type")).alias("t"), F.when(F.length("node_id") % 4 == 1, "").otherwise(F.col("label")).alias("l"), F.when(F.col("tenant_id") != 2, 1).alias("actor"))
    return n.select("node_id", F.when(F.trim("t") == "", "entity_type").when(F.trim("l") == "", "label").when(F.col("actor").isNull(), "actor").alias("reason"))


@op("E6", "SELECT edge_id, CASE WHEN t NOT BETWEEN 1 AND 4 THEN 'tier' WHEN ty NOT IN ('entity', 'fact') THEN 'target_type' WHEN edge_id % 19 = 0 THEN 'creator' END AS reason, CASE WHEN t NOT BETWEEN 1 AND 4 OR ty NOT IN ('entity', 'fact') OR edge_id % 19 = 0 THEN 'rejected' WHEN t <= 2 THEN 'machine' ELSE 'held' END AS status FROM (SELECT edge_id, CASE WHEN edge_id % 31 = 0 THEN 7 ELSE tier END AS t, CASE WHEN edge_id % 23 = 0 THEN 'page' ELSE target_type END AS ty FROM v_edges)")
def e6(spark, d):
    e = view(spark, d, "v_edges").select("edge_id", F.when(F.col("edge_id") % 31 == 0, 7).otherwise(F.col("tier")).alias("tier"), F.when(F.col("edge_id") % 23 == 0, "page").otherwise(F.col("target_type")).alias("target_type"), F.when(F.col("edge_id") % 19 != 0, 1).alias("created_by"), F.lit(None).alias("policy_version"))
    return G.admit_edges(e).select("edge_id", "reason", "status")


@op("E7", "SELECT edge_id, CASE WHEN status = 'held' THEN 'confirmed' ELSE concat('conflict_', status) END AS outcome, CASE WHEN status = 'held' THEN actor END AS verified_by FROM (SELECT user_id * 100 + min(event_id % 100) AS id, user_id AS actor FROM events GROUP BY user_id) AS a JOIN v_edges ON edge_id = id")
def e7(spark, d):
    acts = view(spark, d, "events").groupBy("user_id").agg(F.min(F.col("event_id") % 100).alias("m")).select((F.col("user_id") * 100 + F.col("m")).alias("edge_id"), "user_id")
    return G.confirm(view(spark, d, "v_edges"), acts, "edge_id", "held", F.col("user_id")).filter("outcome <> 'not_found'")


#: One action for each calibrated folder: the smallest user of tenant 0 confirms from 0.6 on.
ACTIONS = "SELECT folder_id AS corpus, (SELECT min(user_id) FROM v_users WHERE tenant_id = 0) AS actor_id, CAST(0.6 AS DOUBLE) AS threshold, 'policy-1' AS policy_version FROM v_calibration"
CONFIRMED = f"""act AS ({ACTIONS}), ok AS (SELECT e.edge_id, e.status, e.confidence, a.*, coalesce(e.status = 'held' AND e.confidence >= a.threshold, false) AS ok FROM v_edges AS e LEFT JOIN v_facts AS f ON f.fact_id = e.evidence_fact_id LEFT JOIN v_docs AS d ON d.doc_id = f.doc_id LEFT JOIN act AS a ON a.corpus = d.folder_id),
  done AS (SELECT edge_id, CASE WHEN ok THEN 'verified' ELSE status END AS status, CASE WHEN ok THEN actor_id END AS verified_by, CASE WHEN ok THEN threshold END AS threshold, CASE WHEN ok THEN corpus END AS corpus, CASE WHEN ok THEN policy_version END AS policy_version, CASE WHEN ok THEN sha256(concat_ws('|', corpus, actor_id, '0.6', policy_version)) END AS batch_id FROM ok)"""


def _confirmed(spark, d):
    e = view(spark, d, "v_edges").select("edge_id", "status", "confidence", F.col("evidence_fact_id").alias("fact_id"))
    of = view(spark, d, "v_facts").select("fact_id", "doc_id").join(view(spark, d, "v_docs").select("doc_id", F.col("folder_id").alias("corpus")), "doc_id")
    return G.bulk_confirm(e.join(of, "fact_id", "left"), spark_sql(spark, d, ACTIONS))


@op("E8", f"WITH {CONFIRMED} SELECT * FROM done")
def e8(spark, d):
    return _confirmed(spark, d)


_BACK = "(edge_id % 3 = 0 OR coalesce(corpus IN (SELECT corpus FROM act WHERE CAST(substring(corpus, 4, 9) AS INT) % 4 = 0), false)) AND status = 'verified'"


@op("E9", f"WITH {CONFIRMED}, r AS (SELECT *, {_BACK} AS back FROM done) SELECT edge_id, CASE WHEN back THEN 'held' ELSE status END AS status, CASE WHEN NOT back THEN verified_by END AS verified_by, CASE WHEN NOT back THEN threshold END AS threshold, CASE WHEN NOT back THEN corpus END AS corpus, CASE WHEN NOT back THEN policy_version END AS policy_version, CASE WHEN NOT back THEN batch_id END AS batch_id FROM r")
def e9(spark, d):
    """Every third edge is reverted by name, and the batches of every second calibrated folder as a whole."""
    edges = stage(_confirmed(spark, d), "confirmed")
    batches = edges.filter("CAST(substring(corpus, 4, 9) AS INT) % 4 = 0").select("batch_id").distinct()
    return G.revert(edges, edges.filter("edge_id % 3 = 0").select("edge_id"), batches)


ALL_EDGES = "SELECT source_node AS node_id, edge_id, 'outgoing' AS direction, target_node AS other_node, target_fact FROM v_edges UNION ALL SELECT target_node, edge_id, 'incoming', source_node, NULL FROM v_edges WHERE target_type = 'entity' AND source_node <> target_node"


@op("E10", f"SELECT a.*, n.label AS other_label, f.doc_id, d.title FROM ({ALL_EDGES}) AS a LEFT JOIN v_nodes AS n ON n.node_id = a.other_node LEFT JOIN v_facts AS f ON f.fact_id = a.target_fact LEFT JOIN v_docs AS d ON d.doc_id = f.doc_id")
def e10(spark, d):
    both = G.view_360(view(spark, d, "v_nodes"), view(spark, d, "v_edges"))
    return G.with_titles(both, view(spark, d, "v_facts"), view(spark, d, "v_docs")).select("node_id", "edge_id", "direction", "other_node", "target_fact", "other_label", "doc_id", "title")


@op("E11", "SELECT r.subject_node, count(*) AS records, string_agg(concat(r.record_id, ':', coalesce(a.v, r.total), '/', r.total), ';' ORDER BY r.record_id) AS states FROM v_records AS r LEFT JOIN (SELECT record_id, arg_max(value, (effective_date, created_order)) AS v FROM v_amendments WHERE field = 'total' GROUP BY 1) AS a USING (record_id) GROUP BY 1")
def e11(spark, d):
    now = view(spark, d, "v_amendments").filter("field = 'total'").groupBy("record_id").agg(F.max_by("value", F.struct("effective_date", "created_order")).alias("v"))
    r = view(spark, d, "v_records").join(now, "record_id", "left").select("subject_node", F.struct("record_id", F.concat(F.col("record_id").cast("string"), F.lit(":"), F.coalesce("v", "total"), F.lit("/"), "total").alias("s")).alias("x"))
    return r.groupBy("subject_node").agg(F.count("*").alias("records"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), ";").alias("states"))


_EXPORT = "SELECT 'general_export' AS mode, 'fact' AS kind, fact_id AS id, CASE WHEN status = 'verified' THEN 'human_verified' ELSE 'unconfirmed_machine_suggested' END AS label FROM v_facts UNION ALL SELECT 'certificate', 'fact', fact_id, 'human_verified' FROM v_facts WHERE status = 'verified' UNION ALL SELECT 'general_export' AS mode, 'edge', edge_id, CASE WHEN status = 'verified' THEN 'human_verified' ELSE 'unconfirmed_machine_suggested' END AS label FROM v_edges UNION ALL SELECT 'certificate', 'edge', edge_id, 'human_verified' FROM v_edges WHERE status = 'verified'"


@op("E12", _EXPORT)
def e12(spark, d):
    rows = view(spark, d, "v_edges").select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), "status").unionByName(view(spark, d, "v_facts").select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id"), "status"))
    modes = [G.for_export(rows, m).select(F.lit(m).alias("mode"), "kind", "id", "label") for m in ("general_export", "certificate")]
    return modes[0].unionByName(modes[1])


@op("E13", """SELECT node_id, string_agg(line, chr(10) ORDER BY sec, seq) AS report FROM (
  SELECT source_node AS node_id, 1 AS sec, edge_id AS seq, concat(CASE WHEN status = 'verified' THEN '' ELSE 'UNVERIFIED ' END, edge_type, ' -> ', coalesce(target_node, concat('fact ', target_fact))) AS line FROM v_edges
  UNION ALL SELECT source_node, 0, 0, concat('Report for ', source_node) FROM v_edges GROUP BY source_node
  UNION ALL SELECT source_node, 2, 0, concat(count(*) FILTER (status = 'verified'), ' of ', count(*)) FROM v_edges GROUP BY source_node) GROUP BY 1""")
def e13(spark, d):
    e = view(spark, d, "v_edges")
    tag = F.when(F.col("status") == "verified", "").otherwise("UNVERIFIED ")
    line = F.concat(tag, "edge_type", F.lit(" -> "), F.coalesce("target_node", F.concat(F.lit("fact "), F.col("target_fact").cast("string"))))
    per = e.groupBy("source_node").agg(F.array_sort(F.collect_list(F.struct("edge_id", line.alias("line")))).alias("x"), F.count_if(F.col("status") == "verified").alias("v"), F.count("*").alias("n"))
    lines = F.concat(F.array(F.concat(F.lit("Report for "), "source_node")), F.transform("x", lambda r: r["line"]), F.array(F.concat(F.col("v").cast("string"), F.lit(" of "), F.col("n").cast("string"))))
    return per.select(F.col("source_node").alias("node_id"), F.array_join(lines, "\n").alias("report"))
