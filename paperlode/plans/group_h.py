"""H: governance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folders as FO
from ..operators import governance as O
from .group_b import PAGES, pages
from .registry import ORACLE_SQL, QUERIES, op
from .views import AS_OF, spark_sql, view

AUDIT = "SELECT id, tenant_id, concat('', CAST(id + 1000000 AS STRING)) AS ordinal, concat(CAST(actor_id AS STRING), '|', action, '|', details) AS payload FROM v_audit"
CHAIN = f"""r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ordinal, id) AS n FROM ({AUDIT} WHERE {{0}})),
  c(id, tenant_id, n, payload, previous_hash, event_hash) AS (SELECT id, tenant_id, n, payload, SHA256(concat('genesis:', tenant_id)), SHA256(concat(SHA256(concat('genesis:', tenant_id)), payload)) FROM r WHERE n = 1
    UNION ALL SELECT r.id, r.tenant_id, r.n, r.payload, c.event_hash, SHA256(concat(c.event_hash, r.payload)) FROM c JOIN r ON r.tenant_id = c.tenant_id AND r.n = c.n + 1)"""


#: Every 97th event has no actor; errors are a policy's doing.
EVENTS = "SELECT id, tenant_id, CASE WHEN id % 97 <> 0 THEN actor_id END AS actor_id, action, details, CASE WHEN action = 'error' THEN 'retention-1' END AS policy_version FROM v_audit"
_ADMITTED = f"SELECT id, tenant_id, CAST(id + 1000000 AS STRING) AS ordinal, concat(CAST(actor_id AS STRING), '|', action, '|', CASE WHEN policy_version IS NULL THEN details ELSE concat(left(details, length(details) - 1), ', \"policy_version\": \"retention-1\"}}') END) AS payload FROM ({EVENTS}) AS ev"


@op("H1", f"WITH RECURSIVE {CHAIN.format('true').replace(AUDIT + ' WHERE true', _ADMITTED + ' WHERE actor_id IS NOT NULL')} SELECT id, tenant_id, previous_hash, event_hash, NULL AS reason FROM c UNION ALL SELECT id, tenant_id, NULL, NULL, 'actor' FROM ({EVENTS}) AS x WHERE actor_id IS NULL")
def h1(spark, d):
    """The chain of admitted events, and the events that are refused."""
    admitted, refused = O.admit_events(spark_sql(spark, d, EVENTS))
    rows = admitted.select("id", "tenant_id", (F.col("id") + 1000000).cast("string").alias("ordinal"), O.payload("actor_id", "action", "details").alias("payload"))
    chain = O.build_chain(rows).select("id", "tenant_id", "previous_hash", "event_hash", F.lit(None).cast("string").alias("reason"))
    none = F.lit(None).cast("string")
    return chain.unionByName(refused.select("id", "tenant_id", none.alias("previous_hash"), none.alias("event_hash"), "reason"))


@op("H2", f"""WITH RECURSIVE {CHAIN.format('id % 50 <> 13')},
  v AS (SELECT tenant_id, n, id, SHA256(concat(previous_hash, CASE WHEN id >= 5000 THEN concat(payload, '!') ELSE payload END)) <> event_hash AS bad FROM c)
  SELECT v.tenant_id, count(*) AS checked, max(l.loose) AS unchained, arg_min(v.id, v.n) FILTER (v.bad) AS first_bad, CASE WHEN bool_or(v.bad) THEN 'altered' END AS reason
  FROM v JOIN (SELECT tenant_id, count(*) FILTER (id % 50 = 13) AS loose FROM v_audit GROUP BY 1) AS l USING (tenant_id) GROUP BY 1""")
def h2(spark, d):
    """The chain of the rows that are chained, with every payload from id 5000 on altered after the fact."""
    rows = view(spark, d, "v_audit")
    rows = rows.select("id", "tenant_id", (F.col("id") + 1000000).cast("string").alias("ordinal"), O.payload("actor_id", "action", "details").alias("payload"))
    chained = O.build_chain(rows.filter("id % 50 <> 13")).withColumn("payload", F.when(F.col("id") >= 5000, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    loose = rows.filter("id % 50 = 13").select("id", "tenant_id", "ordinal", "payload", F.lit(None).cast("string").alias("previous_hash"), F.lit(None).cast("string").alias("event_hash"))
    return O.verify_chain(chained.unionByName(loose))


_LOSS, _LINES = ORACLE_SQL["B6"], ORACLE_SQL["B5"]


@op("H3", f"""SELECT d.tenant_id, coalesce(d.folder_id, 'root') AS corpus, count(*) AS documents, CAST(coalesce(sum(p.pages), 0) AS BIGINT) AS pages, CAST(coalesce(sum(p.failed), 0) AS BIGINT) AS failed_pages, count(*) FILTER (p.failed > 0) AS with_failures, CAST(coalesce(sum(l.missing), 0) AS BIGINT) AS loss_words, count(*) FILTER (l.missing > 0) AS with_loss, count(f.doc_id) AS with_furniture
  FROM v_docs AS d LEFT JOIN (SELECT doc_id, count(*) AS pages, count(*) FILTER (extraction_failed) AS failed FROM ({PAGES}) AS pp GROUP BY 1) AS p ON p.doc_id = d.doc_id LEFT JOIN ({_LOSS}) AS l ON l.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM ({_LINES}) AS ll) AS f ON f.doc_id = d.doc_id WHERE NOT d.is_trashed GROUP BY 1, 2""")
def h3(spark, d):
    return O.completeness(view(spark, d, "v_docs"), pages(spark, d), QUERIES["B6"](spark, d), QUERIES["B5"](spark, d))


@op("H4", """SELECT coalesce(folder_id, 'root') AS corpus, CAST(sum(machine) AS BIGINT) AS machine, CAST(sum(in_review) AS BIGINT) AS in_review, CAST(sum(verified) AS BIGINT) AS verified, CAST(sum(held_edges) AS BIGINT) AS held_edges FROM (
  SELECT d.folder_id, count(*) FILTER (f.status = 'machine') AS machine, count(*) FILTER (f.status = 'in_review') AS in_review, count(*) FILTER (f.status = 'verified') AS verified, 0 AS held_edges FROM v_facts AS f JOIN v_docs AS d USING (doc_id) GROUP BY 1
  UNION ALL SELECT d.folder_id, 0, 0, 0, count(*) FILTER (e.status = 'held') FROM v_edges AS e JOIN v_facts AS f ON f.fact_id = e.evidence_fact_id JOIN v_docs AS d USING (doc_id) GROUP BY 1) GROUP BY 1""")
def h4(spark, d):
    folder = view(spark, d, "v_docs").select("doc_id", F.coalesce("folder_id", F.lit("root")).alias("corpus"))
    facts = view(spark, d, "v_facts")
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    by_fact = facts.join(folder, "doc_id").groupBy("corpus").agg(count("machine"), count("in_review"), count("verified"))
    edges = view(spark, d, "v_edges").filter("status = 'held'").select(F.col("evidence_fact_id").alias("fact_id")).join(facts.select("fact_id", "doc_id"), "fact_id").join(folder, "doc_id")
    by_edge = edges.groupBy("corpus").agg(F.count("*").alias("held_edges"))
    return by_fact.join(by_edge, "corpus", "full").na.fill(0)


_B = "CASE WHEN confidence < 0.5 THEN '0.00-0.50' WHEN confidence < 0.7 THEN '0.50-0.70' WHEN confidence < 0.85 THEN '0.70-0.85' WHEN confidence < 0.95 THEN '0.85-0.95' WHEN confidence < 1.01 THEN '0.95-1.00' END"


@op("H5", f"SELECT b.bucket, count(f.bucket) AS n FROM (VALUES ('0.00-0.50'), ('0.50-0.70'), ('0.70-0.85'), ('0.85-0.95'), ('0.95-1.00')) AS b(bucket) LEFT JOIN (SELECT {_B} AS bucket FROM v_facts WHERE confidence IS NOT NULL) AS f USING (bucket) GROUP BY 1")
def h5(spark, d):
    names = spark.createDataFrame([(b[0],) for b in O.BUCKETS], "bucket string")
    n = view(spark, d, "v_facts").groupBy(O.bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"))
    return names.join(n, "bucket", "left").na.fill(0)


REQUIRED = "SELECT * FROM (VALUES ('en', 'owner'), ('en', 'area'), ('fr', 'village'), ('de', 'survey_no'), ('es', 'valuation'), ('es', 'owner')) AS t(form, field_name)"


@op("H6", f"SELECT d.doc_id, r.field_name FROM v_docs AS d JOIN ({REQUIRED}) AS r ON r.form = d.doc_type WHERE d.status = 'indexed' AND NOT EXISTS (SELECT 1 FROM v_facts AS f WHERE f.doc_id = d.doc_id AND f.field_name = r.field_name AND f.fact_id % 3 = 0)")
def h6(spark, d):
    need = view(spark, d, "v_docs").filter("status = 'indexed'").select("doc_id", "doc_type").join(F.broadcast(spark.sql(REQUIRED)), F.col("doc_type") == F.col("form")).select("doc_id", "field_name")
    return need.join(view(spark, d, "v_facts").filter("fact_id % 3 = 0").select("doc_id", "field_name"), ["doc_id", "field_name"], "left_anti")


@op("H7", "SELECT 'failed_documents' AS category, doc_id AS id FROM v_docs WHERE status = 'failed' AND NOT is_trashed UNION ALL SELECT 'with_loss', d.doc_id FROM v_docs AS d JOIN (@@LOSS) AS l ON l.doc_id = d.doc_id WHERE l.missing > 0 AND NOT d.is_trashed UNION ALL SELECT 'in_review', fact_id FROM v_facts WHERE status = 'in_review' UNION ALL SELECT 'handwritten', fact_id FROM v_facts WHERE is_handwritten UNION ALL SELECT 'low_confidence', fact_id FROM v_facts WHERE confidence < 0.5 UNION ALL SELECT 'held_edges', edge_id FROM v_edges WHERE status = 'held'".replace("@@LOSS", _LOSS))
def h7(spark, d):
    docs, facts = view(spark, d, "v_docs").filter("not is_trashed"), view(spark, d, "v_facts")
    one = lambda name, df, key: df.select(F.lit(name).alias("category"), F.col(key).alias("id"))
    parts = [one("failed_documents", docs.filter("status = 'failed'"), "doc_id"), one("with_loss", docs.join(QUERIES["B6"](spark, d).filter("missing > 0").select("doc_id"), "doc_id"), "doc_id"), one("in_review", facts.filter("status = 'in_review'"), "fact_id"), one("handwritten", facts.filter("is_handwritten"), "fact_id"), one("low_confidence", facts.filter("confidence < 0.5"), "fact_id"), one("held_edges", view(spark, d, "v_edges").filter("status = 'held'"), "edge_id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@op("H8", "SELECT user_id % 20 AS folder, arg_max(user_id, (ts, event_id)) AS attested_by, count(*) AS attestations FROM events WHERE event_type = 'signup' GROUP BY 1")
def h8(spark, d):
    e = view(spark, d, "events").filter("event_type = 'signup'")
    return e.groupBy((F.col("user_id") % 20).alias("folder")).agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("attested_by"), F.count("*").alias("attestations"))


@op("H9", f"SELECT d.tenant_id, d.doc_id, CASE WHEN r.retention_days IS NULL THEN 'protected' WHEN DATE '{AS_OF}' - d.trashed_at < r.retention_days THEN 'pending' WHEN a.actor_id IS NULL THEN 'skipped' ELSE 'purge' END AS outcome, CASE WHEN DATE '{AS_OF}' - d.trashed_at < r.retention_days THEN CAST(greatest(r.retention_days - (DATE '{AS_OF}' - d.trashed_at), 0) AS BIGINT) END AS days_remaining FROM v_docs AS d LEFT JOIN v_retention AS r ON r.class_name = d.retention_class LEFT JOIN (SELECT tenant_id, min(user_id) AS actor_id FROM v_users WHERE tenant_id < 3 GROUP BY 1) AS a USING (tenant_id) WHERE d.is_trashed")
def h9(spark, d):
    actors = O.policy_actors(view(spark, d, "v_users").filter("tenant_id < 3"))
    return O.sweep_documents(view(spark, d, "v_docs"), view(spark, d, "v_retention"), actors, AS_OF)


CONTENT = "SELECT doc_id, concat('n', CAST(doc_id % 25 AS STRING)) AS folder_id, retention_class FROM v_docs"


@op("H10", f"WITH RECURSIVE a(folder_id, ancestor_id) AS (SELECT folder_id, folder_id FROM v_folders UNION ALL SELECT a.folder_id, f.parent_id FROM a JOIN v_folders AS f ON f.folder_id = a.ancestor_id WHERE f.parent_id IS NOT NULL), x AS (SELECT DISTINCT a.folder_id FROM a JOIN v_folders AS f ON f.folder_id = a.ancestor_id WHERE f.is_trashed AND f.trashed_at < DATE '{AS_OF}' - 30) SELECT c.doc_id, x.folder_id, r.retention_days IS NULL AS protected FROM x JOIN ({CONTENT}) AS c USING (folder_id) LEFT JOIN v_retention AS r ON r.class_name = c.retention_class")
def h10(spark, d):
    folders = view(spark, d, "v_folders")
    due = folders.filter(F.col("is_trashed") & (F.col("trashed_at") < F.date_sub(F.lit(AS_OF).cast("date"), 30))).select(F.col("folder_id").alias("ancestor_id"))
    gone = FO.ancestors(spark, folders).join(due, "ancestor_id").select("folder_id").distinct()
    docs = spark_sql(spark, d, CONTENT).join(gone, "folder_id")
    classes = view(spark, d, "v_retention")
    return docs.join(F.broadcast(classes), docs.retention_class == classes.class_name, "left").select("doc_id", "folder_id", F.col("retention_days").isNull().alias("protected"))


@op("H11", "SELECT tenant_id, arg_min(user_id, (role <> 'it_admin', user_id)) AS actor_id FROM v_users GROUP BY 1")
def h11(spark, d):
    return O.policy_actors(view(spark, d, "v_users"))


@op("H12", "SELECT doc_id, CASE WHEN is_trashed AND retention_class = 'operational_trash' THEN 'unclassified_permanent' WHEN NOT is_trashed AND retention_class = 'unclassified_permanent' THEN 'operational_trash' ELSE retention_class END AS retention_class FROM v_docs WHERE doc_id % 2 = 0")
def h12(spark, d):
    toggled = view(spark, d, "v_docs").filter("doc_id % 2 = 0")
    c = F.col("retention_class")
    return toggled.select("doc_id", F.when(F.col("is_trashed") & (c == "operational_trash"), "unclassified_permanent").when(~F.col("is_trashed") & (c == "unclassified_permanent"), "operational_trash").otherwise(c).alias("retention_class"))


_SCOPE = "CASE WHEN role IN ('it_admin', 'auditor', 'head') THEN 'all' ELSE concat('department ', CAST(user_id % 5 AS STRING)) END"


@op("H13", f"""WITH u AS (SELECT user_id, tenant_id, {_SCOPE} AS scope FROM v_users), s AS (SELECT DISTINCT tenant_id, scope FROM u)
  SELECT s.tenant_id, s.scope, CAST(NULL AS BIGINT) AS user_id, coalesce(d.folder_id, 'root') AS folder, count(*) AS visible FROM s JOIN v_docs AS d USING (tenant_id) WHERE s.scope = 'all' OR d.folder_id IS NULL OR concat('department ', CAST(CAST(substring(d.folder_id, 4, 9) AS BIGINT) % 5 AS STRING)) = s.scope GROUP BY ALL
  UNION ALL SELECT tenant_id, scope, user_id, NULL, NULL FROM u""")
def h13(spark, d):
    """What each scope of a tenant sees, by folder, and who has the scope: never users times folders."""
    users, per = view(spark, d, "v_users"), view(spark, d, "v_docs").groupBy("tenant_id", "folder_id").agg(F.count("*").alias("visible"))
    everything = F.col("role").isin("it_admin", "auditor", "head")
    members = users.select("tenant_id", F.when(everything, "all").otherwise(F.concat(F.lit("department "), (F.col("user_id") % 5).cast("string"))).alias("scope"), "user_id")
    scopes = members.select("tenant_id", "scope").distinct()
    granted = F.concat(F.lit("department "), (F.substring("folder_id", 4, 9).cast("long") % 5).cast("string"))
    seen = scopes.filter("scope = 'all'").join(per, "tenant_id")
    some = scopes.filter("scope <> 'all'")
    root = some.join(per.filter("folder_id is null"), "tenant_id")
    own = some.join(per.filter("folder_id is not null").withColumn("scope", granted), ["tenant_id", "scope"])
    pick = lambda df: df.select("tenant_id", "scope", F.lit(None).cast("long").alias("user_id"), F.coalesce("folder_id", F.lit("root")).alias("folder"), "visible")
    roll = members.select("tenant_id", "scope", "user_id", F.lit(None).cast("string").alias("folder"), F.lit(None).cast("long").alias("visible"))
    return pick(seen).unionByName(pick(root)).unionByName(pick(own)).unionByName(roll)


@op("H14", "SELECT doc_id, title FROM v_docs WHERE tenant_id = 2")
def h14(spark, d):
    return view(spark, d, "v_docs").filter("tenant_id = 2").select("doc_id", "title")


USAGE = "SELECT user_id AS tenant_id, CASE user_id % 4 WHEN 0 THEN 'trial' WHEN 1 THEN 'starter' WHEN 2 THEN 'professional' ELSE 'enterprise' END AS plan_key, CASE user_id % 5 WHEN 0 THEN 'trialing' WHEN 1 THEN 'canceled' ELSE 'active' END AS status, DATE '2024-01-20' + CAST(user_id % 30 AS INT) AS trial_ends_at, docs, bytes FROM (SELECT user_id, count(*) * 2 AS docs, CAST(floor(sum(value)) AS BIGINT) * 1000000 AS bytes FROM events GROUP BY 1) AS u"


@op("H15", f"SELECT u.tenant_id, u.plan_key, u.docs, u.bytes, CASE WHEN status = 'trialing' AND trial_ends_at < DATE '{AS_OF}' THEN 'expired' WHEN status IN ('expired', 'canceled') THEN status WHEN docs >= max_documents THEN 'document_limit' WHEN bytes >= max_storage_bytes THEN 'storage_limit' ELSE 'allowed' END AS decision FROM ({USAGE}) AS u LEFT JOIN v_plans AS p USING (plan_key)")
def h15(spark, d):
    # floor tells sums of doubles apart by the order of addition: values are added one by one, as their ids stand
    by_id = Window.partitionBy("user_id").orderBy("event_id", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = view(spark, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id", "value")).alias("n"), F.sum("value").over(by_id).alias("s"))
    total = so_far.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("s", "n").alias("s"))
    usage = USAGE[: USAGE.index("count(*)")] + "n * 2 AS docs, CAST(floor(s) AS BIGINT) * 1000000 AS bytes FROM total) AS u"
    return O.meter(spark_sql(spark, d, usage, total=total), view(spark, d, "v_plans"), AS_OF)


@op("H16", f"SELECT user_id, CASE WHEN NOT ok AND seen + 7 >= DATE '{AS_OF}' THEN 'grace' WHEN NOT ok THEN 'blocked' WHEN expires >= DATE '{AS_OF}' THEN 'valid' WHEN expires + 14 >= DATE '{AS_OF}' THEN 'grace' ELSE 'expired' END AS decision FROM (SELECT user_id, arg_max(event_type <> 'error', (ts, event_id)) AS ok, CAST(max(ts) AS DATE) AS seen, CAST(arg_max(ts, (ts, event_id)) AS DATE) - 20 + CAST(user_id % 40 AS INT) AS expires FROM events GROUP BY 1)")
def h16(spark, d):
    last = view(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("x"))
    now, seen = F.lit(AS_OF).cast("date"), F.to_date("x.ts")
    expires = F.date_add(F.date_sub(seen, 20), (F.col("user_id") % 40).cast("int"))
    ok = F.col("x.event_type") != "error"
    return last.select("user_id", F.when(~ok & (F.date_add(seen, 7) >= now), "grace").when(~ok, "blocked").when(expires >= now, "valid").when(F.date_add(expires, 14) >= now, "grace").otherwise("expired").alias("decision"))


@op("H17", "SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'it_admin' WHEN 1 THEN 'operator' ELSE 'reviewer' END AS role, CASE WHEN tenant_id % 2 = 0 THEN 'existing' ELSE 'trial' END AS subscription FROM v_users")
def h17(spark, d):
    legacy = F.element_at(F.array(F.lit("admin"), F.lit("user"), F.lit("reviewer")), (F.col("user_id") % 3 + 1).cast("int"))
    u = view(spark, d, "v_users").select("user_id", "tenant_id", legacy.alias("role"))
    have = u.filter("tenant_id % 2 = 0").select("tenant_id", F.lit("existing").alias("have")).distinct()
    role = F.when(F.col("role") == "admin", "it_admin").when(F.col("role") == "user", "operator").otherwise(F.col("role"))
    return u.join(have, "tenant_id", "left").select("user_id", role.alias("role"), F.coalesce("have", F.lit("trial")).alias("subscription"))


@op("H18", f"SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 3 THEN 'no_current_version' WHEN NOT c.bad THEN 'certified' ELSE 'chain_broken' END AS outcome, CASE WHEN d.doc_id % 4 <> 3 THEN d.file_hash END AS file_hash, c.checked FROM v_docs AS d JOIN (SELECT tenant_id, count(*) AS checked, tenant_id = 1 AS bad FROM ({AUDIT}) GROUP BY 1) AS c USING (tenant_id)")
def h18(spark, d):
    rows = view(spark, d, "v_audit")
    rows = rows.select("id", "tenant_id", (F.col("id") + 1000000).cast("string").alias("ordinal"), O.payload("actor_id", "action", "details").alias("payload"))
    chain = O.build_chain(rows).withColumn("payload", F.when(F.col("tenant_id") == 1, F.lit("?")).otherwise(F.col("payload")))
    state = O.verify_chain(chain).select("tenant_id", "checked", "reason")
    current = F.col("doc_id") % 4 != 3
    out = F.when(~current, "no_current_version").when(F.col("reason").isNull(), "certified").otherwise("chain_broken")
    return view(spark, d, "v_docs").join(state, "tenant_id").select("doc_id", out.alias("outcome"), F.when(current, F.col("file_hash")).alias("file_hash"), "checked")
