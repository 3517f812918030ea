"""A: scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as P
from ..operators.staging import folder, stage
from ..sources import chunk_store
from ..sources import files as S
from .group_b import CH, PG
from .registry import op
from .views import spark_sql, view


_FILE = "SELECT doc_id, tenant_id, CASE WHEN doc_id % 9 = 0 THEN concat(doc_id, '.exe') WHEN doc_id % 9 = 1 THEN concat(doc_id, '.json') ELSE title END AS path, CASE WHEN is_trashed THEN NULL WHEN doc_id % 9 = 1 AND doc_id % 2 = 0 THEN concat('{\"id\": ', doc_id, '}') ELSE text END AS body FROM v_docs"


@op("A1", f"""SELECT doc_id, path, reason, CASE WHEN reason IS NULL THEN sha256(body) END AS file_hash, CAST(strlen(body) AS BIGINT) AS length FROM (
  SELECT *, CASE WHEN path LIKE '%.exe' THEN 'type' WHEN body IS NULL THEN 'unreadable' WHEN strlen(body) > 5000 THEN 'size' WHEN body = '' THEN 'empty' WHEN path LIKE '%.json' AND NOT json_valid(body) THEN 'json' END AS reason FROM ({_FILE}))""")
def a1(spark, d):
    """Documents as files of at most 5000 bytes, some of other types, without content, or called JSON."""
    files = spark_sql(spark, d, _FILE).withColumn("content", F.encode("body", "UTF-8"))
    return S.accept(files, max_bytes=5000).select("doc_id", "path", "reason", "file_hash", "length")


#: Half of each tenant's documents are stored, the other half come in.
STORED, NEW = "CAST(floor(doc_id / 4) AS BIGINT) % 2 = 0", "CAST(floor(doc_id / 4) AS BIGINT) % 2 = 1"
INCOMING = f"SELECT doc_id AS id, tenant_id, file_hash, doc_id % 10 = 0 AS force FROM v_docs WHERE {NEW}"


def _incoming(spark, d):
    docs = view(spark, d, "v_docs")
    incoming = docs.filter(NEW).select(F.col("doc_id").alias("id"), "tenant_id", "file_hash", (F.col("doc_id") % 10 == 0).alias("force"))
    return incoming, docs.filter(STORED)


@op("A2", f"SELECT i.id, CASE WHEN s.existing IS NOT NULL AND NOT i.force THEN 'conflict' ELSE 'accepted' END AS outcome, CASE WHEN NOT i.force THEN s.existing END AS existing, CASE WHEN NOT i.force THEN s.title END AS existing_title FROM ({INCOMING}) AS i LEFT JOIN (SELECT tenant_id, file_hash, min(doc_id) AS existing, arg_min(title, doc_id) AS title FROM v_docs WHERE {STORED} AND NOT is_trashed GROUP BY 1, 2) AS s USING (tenant_id, file_hash)")
def a2(spark, d):
    ok, bad = S.exact_gate(*_incoming(spark, d), count_trashed=False)
    return ok.select("id", F.lit("accepted").alias("outcome"), F.lit(None).cast("long").alias("existing"), F.lit(None).cast("string").alias("existing_title")).unionByName(bad.select("id", F.lit("conflict").alias("outcome"), "existing", "existing_title"))


@op("A3", f"SELECT min(i.id) AS id, i.tenant_id, i.file_hash FROM ({INCOMING}) AS i WHERE NOT EXISTS (SELECT 1 FROM v_docs AS s WHERE {STORED} AND s.tenant_id = i.tenant_id AND s.file_hash = i.file_hash) GROUP BY 2, 3")
def a3(spark, d):
    incoming, stored = _incoming(spark, d)
    fresh = incoming.join(stored.select("tenant_id", "file_hash"), ["tenant_id", "file_hash"], "left_anti")
    return fresh.groupBy("tenant_id", "file_hash").agg(F.min("id").alias("id"))


@op("A4", "SELECT doc_id, text AS page FROM documents")
def a4(spark, d):
    raw = view(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return raw.select("doc_id", S.decode_text(F.col("content")).alias("page"))


@op("A5", "SELECT page_number, string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT concat_ws(' | ', CAST(c_custkey AS STRING), c_name, c_mktsegment) AS line, row_number() OVER (ORDER BY c_custkey) AS i, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 + 1 AS page_number FROM customer) GROUP BY 1")
def a5(spark, d):
    rows = view(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("k"), "c_name", "c_mktsegment")
    return S.csv_pages(rows, ["k", "c_name", "c_mktsegment"], ["c_custkey"])


@op("A6")
def a6(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, F.substring("props", 2, 99)).otherwise(F.col("props"))
    return view(spark, d, "events").select("event_id", S.json_page(text).alias("page"))


@op("A7", """WITH RECURSIVE p AS (SELECT doc_id, list_transform(string_split(replace(text, chr(10), concat(chr(10), chr(10))), concat(chr(10), chr(10))), lambda x: length(x)) AS ls FROM documents),
  f(doc_id, i, acc, page, closed) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(NULL AS BIGINT) FROM p UNION ALL SELECT f.doc_id, f.i + 1, CASE WHEN f.acc + p.ls[f.i + 1] >= 1500 THEN 0 ELSE f.acc + p.ls[f.i + 1] END, CASE WHEN f.closed IS NOT NULL THEN f.page + 1 ELSE f.page END, CASE WHEN f.acc + p.ls[f.i + 1] >= 1500 THEN f.acc + p.ls[f.i + 1] END FROM f JOIN p USING (doc_id) WHERE f.i < len(p.ls))
  SELECT doc_id, page AS page_number, closed AS n_chars FROM f WHERE closed IS NOT NULL UNION ALL SELECT f.doc_id, CASE WHEN f.closed IS NULL THEN f.page ELSE f.page + 1 END, f.acc FROM f JOIN p USING (doc_id) WHERE f.i = len(p.ls) AND f.acc > 0""")
def a7(spark, d):
    docs = view(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return P.paragraphs_to_pages(docs)


@op("A8", "SELECT doc_id, pages, failed, CASE WHEN failed = pages THEN 'failed' WHEN doc_id % 37 = 0 THEN 'failed' ELSE 'indexed' END AS status FROM (SELECT doc_id, len(string_split(text, chr(10))) // 3 + CASE WHEN len(string_split(text, chr(10))) % 3 > 0 THEN 1 ELSE 0 END AS pages, len(list_filter(range(1, 1 + len(string_split(text, chr(10))) // 3 + CASE WHEN len(string_split(text, chr(10))) % 3 > 0 THEN 1 ELSE 0 END), lambda p: (doc_id + p) % 29 = 0)) AS failed FROM documents)")
def a8(spark, d):
    pages = P.split_pages(view(spark, d, "documents"))
    out = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("extraction_failed").alias("failed"))
    no_chunks = F.col("doc_id") % 37 == 0
    return out.select("doc_id", "pages", "failed", F.when((F.col("failed") == F.col("pages")) | no_chunks, "failed").otherwise("indexed").alias("status"))


STABLE = """SELECT path, min(poll_no) AS poll_no, arg_min(size, poll_no) AS size FROM (SELECT *, lag(size) OVER w AS before, lag(poll_no) OVER w AS poll_before, poll_no - row_number() OVER w AS stay FROM v_listing WHERE path LIKE 'in/%' WINDOW w AS (PARTITION BY path ORDER BY poll_no))
  WHERE size = before AND poll_before = poll_no - 1 AND poll_ts - mtime >= INTERVAL 2 DAY GROUP BY path, stay"""


@op("A9", STABLE)
def a9(spark, d):
    return S.stable_files(view(spark, d, "v_listing"))


@op("A10", f"SELECT path, concat(CASE WHEN size % 3 = 0 THEN 'failed/' ELSE 'processed/' END, regexp_replace(path, '^[^/]*/', '')) AS destination FROM ({STABLE})")
def a10(spark, d):
    status = F.when(F.col("size") % 3 == 0, "error").when(F.col("size") % 3 == 1, "duplicate").otherwise("ok")
    return S.route(a9(spark, d).select("path", status.alias("status")))


_SEG = "list_filter(string_split(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '/'), lambda s: trim(s) <> '')"


@op("A11", f"SELECT DISTINCT tenant_id, array_to_string(list_slice(s, 1, i), '/') AS folder_path, CASE WHEN i > 1 THEN array_to_string(list_slice(s, 1, i - 1), '/') END AS parent_path, SHA256(concat(tenant_id, '|', array_to_string(list_slice(s, 1, i), '/'))) AS folder_id FROM (SELECT tenant_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT page_id % 4 AS tenant_id, {_SEG} AS s FROM pages))")
def a11(spark, d):
    path = F.regexp_extract("url", r"^.*?://[^/?#]*([^?#]*)", 1)
    rows = view(spark, d, "pages").select((F.col("page_id") % 4).alias("tenant_id"), F.filter(F.split(path, "/"), lambda s: F.trim(s) != "").alias("seg"))
    return S.folder_paths(rows, F.col("seg"))


@op("A12", """WITH p AS (SELECT doc_id AS mail_id, unnest(CASE WHEN doc_id % 4 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS n, SHA256(text) AS h FROM documents),
  f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY mail_id, n) = 1 AND h NOT IN (SELECT SHA256(text) FROM documents WHERE doc_id % 9 = 2) AS fresh FROM p)
  SELECT mail_id, count(*) AS processed, count(*) FILTER (fresh) AS ingested, count(*) FILTER (NOT fresh) AS skipped, 0 AS errors, 'success' AS status FROM f GROUP BY 1""")
def a12(spark, d):
    """Mails made of documents: every fourth has its text attached twice; attachments whose hash is stored already (here
    those of every ninth mail) or came in before are left out."""
    head = F.concat(F.lit("Subject: doc\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nsee attached\n"))
    part = lambda n: F.concat(F.lit(f"--B\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\nContent-Disposition: attachment; filename={n}.txt\n\n"), F.base64(F.encode("text", "UTF-8")), F.lit("\n"))
    docs = view(spark, d, "documents")
    body = F.concat(head, part("a"), F.when(F.col("doc_id") % 4 == 0, part("b")).otherwise(F.lit("")), F.lit("--B--\n"))
    mails = docs.select(F.col("doc_id").alias("mail_id"), F.encode(body, "UTF-8").alias("raw"))
    stored = docs.filter("doc_id % 9 = 2").select(F.sha2("text", 256).alias("h")).distinct()
    found = stage(S.attachments(mails, digest=True), "attachments")  # a mail is parsed once
    # of the parts with a hash the first is taken, if it is not stored: a row for each hash, and no join of all parts
    first = found.filter("h is not null").groupBy("h").agg(F.min(F.struct(F.col("mail_id").isNull().alias("nameless"), "mail_id", "name")).alias("f"))
    taken = first.join(stored, "h", "left_anti").groupBy(F.col("f.mail_id").alias("of")).agg(F.count("*").alias("ingested"))
    counts = found.groupBy("mail_id").agg(F.count("*").alias("processed"), F.count("h").alias("hashed"), F.count("error").alias("errors"))
    out = counts.join(taken, F.col("mail_id").eqNullSafe(F.col("of")), "left").withColumn("ingested", F.coalesce("ingested", F.lit(0)))
    return out.select("mail_id", "processed", "ingested", (F.col("hashed") - F.col("ingested")).alias("skipped"), "errors", F.when(F.col("errors") > 0, "partial_success").otherwise("success").alias("status"))


@op("A13", f"WITH e AS (SELECT doc_id, file_hash, doc_id % 2 AS engine FROM v_docs), a AS (SELECT file_hash, engine, min(doc_id) AS source FROM e WHERE {STORED} GROUP BY 1, 2) SELECT e.doc_id, e.engine, a.source, a.source IS NOT NULL AS hit FROM e LEFT JOIN a USING (file_hash, engine) WHERE {NEW.replace('doc_id', 'e.doc_id')}")
def a13(spark, d):
    e = view(spark, d, "v_docs").select("doc_id", "file_hash", (F.col("doc_id") % 2).alias("engine"))
    archive = e.filter(STORED).groupBy("file_hash", "engine").agg(F.min("doc_id").alias("source"))  # the first write wins
    return e.filter(NEW).join(archive, ["file_hash", "engine"], "left").select("doc_id", "engine", "source", F.col("source").isNotNull().alias("hit"))


@op("A14", "SELECT SHA256(concat_ws(':', k, page, 'prompt')) AS cache_key, coalesce(arg_max(v, id) FILTER (over), arg_min(v, id)) AS response FROM (SELECT event_id AS id, CAST(user_id AS STRING) AS k, CAST(event_id % 3 AS STRING) AS page, event_type = 'error' AS over, concat('r', event_id) AS v FROM events) GROUP BY k, page")
def a14(spark, d):
    e = view(spark, d, "events").select(F.col("event_id").alias("id"), F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string"), F.lit("prompt")), 256).alias("cache_key"), (F.col("event_type") == "error").alias("over"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("v"))
    last = F.max_by(F.when(F.col("over"), F.col("v")), F.when(F.col("over"), F.col("id")))
    return e.groupBy("cache_key").agg(F.coalesce(last, F.min_by("v", "id")).alias("response"))


_AGAIN = "documents.n_chars % 2 = 0"
_REDONE = f"WITH {PG}, {CH}, again AS (SELECT doc_id FROM documents WHERE {_AGAIN}), good AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM pg WHERE NOT extraction_failed), n AS (SELECT doc_id, CASE WHEN doc_id IN (FROM again) THEN 32 ELSE 64 END AS size, len(t) AS len FROM good WHERE len(t) > 0)"


@op("A15", f"{_REDONE}, c AS (SELECT doc_id, CAST(sum(1 + CAST(ceil(greatest(len - size, 0) / CAST(size - 8 AS DOUBLE)) AS BIGINT)) AS BIGINT) AS chunks FROM n GROUP BY 1) SELECT d.doc_id, CASE WHEN c.chunks IS NULL THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN {_AGAIN.replace('documents', 'd')} THEN 2 ELSE 1 END AS run, coalesce(c.chunks, 0) AS chunks FROM documents AS d LEFT JOIN c USING (doc_id)")
def a15(spark, d):
    """All documents are ingested, then those of even length again in shorter chunks: these replace the old ones; a
    document whose pages all fail has none and a failed state."""
    docs = view(spark, d, "documents")
    store = chunk_store.create(spark)
    store.reingest(P.split_pages(docs), lambda pages: P.chunk(pages, 64, 8))
    store.reingest(P.split_pages(docs.filter("n_chars % 2 = 0")), lambda pages: P.chunk(pages, 32, 8))
    n = store.chunks().groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return store.states().join(n, "doc_id", "left").select("doc_id", "status", "run", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@op("A16", "SELECT doc_id FROM v_docs WHERE status = 'failed' AND NOT is_trashed AND doc_id % 4 <> 3")
def a16(spark, d):
    docs = view(spark, d, "v_docs")
    current = docs.filter("doc_id % 4 <> 3").select("doc_id")  # versions with a path
    return docs.filter("status = 'failed' AND NOT is_trashed").select("doc_id").join(current, "doc_id")


_CELL = "CASE WHEN regexp_matches({0}, '[\",\\n]') THEN concat('\"', replace({0}, '\"', '\"\"'), '\"') ELSE {0} END"
_SECTIONED = f"""n AS (SELECT DISTINCT source_node AS node FROM v_edges UNION SELECT subject_node FROM v_records),
  ln AS (SELECT node, 0 AS part, -1 AS k, 0 AS seq, '# links' AS line FROM n UNION ALL SELECT node, 0, -1, 1, 'edge_id,edge_type,status,confidence' FROM n UNION ALL SELECT node, 0, 1, 0, '' FROM n
    UNION ALL SELECT source_node, 0, 0, edge_id, concat_ws(',', CAST(edge_id AS STRING), edge_type, status, CAST(CAST(round(confidence * 100) AS BIGINT) AS STRING)) FROM v_edges
    UNION ALL SELECT node, 1, -1, 0, '# records' FROM n UNION ALL SELECT node, 1, -1, 1, 'record_id,record_type,total,priority' FROM n UNION ALL SELECT node, 1, 1, 0, '' FROM n
    UNION ALL SELECT subject_node, 1, 0, record_id, concat_ws(',', CAST(record_id AS STRING), record_type, total, {_CELL.format('priority')}) FROM v_records)"""


@op("A17", f"WITH {_SECTIONED} SELECT node, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, sha256(string_agg(concat(line, chr(10)), '' ORDER BY part, k, seq)) AS digest, concat('links=', count(*) FILTER (part = 0) - 3, ',records=', count(*) FILTER (part = 1) - 3) AS sections FROM ln GROUP BY 1")
def a17(spark, d):
    edges = view(spark, d, "v_edges").select(F.col("source_node").alias("node"), "edge_id", "edge_type", "status", F.round(F.col("confidence") * 100).cast("long").alias("confidence"))
    records = view(spark, d, "v_records").select(F.col("subject_node").alias("node"), "record_id", "record_type", "total", "priority")
    nodes = edges.select("node").union(records.select("node")).distinct()
    lines = S.sectioned_csv(nodes, "node", {"links": (edges, ["edge_id", "edge_type", "status", "confidence"], "edge_id"), "records": (records, ["record_id", "record_type", "total", "priority"], "record_id")})
    return S.write_sectioned(lines, "node", folder(spark, "evidence"))


@op("A18", "SELECT event_id, split_part(fwd, ',', 1) AS client, substring(agent, 1, 500) AS agent FROM (SELECT event_id, concat('10.0.', user_id, '.1, 10.9.9.9') AS fwd, repeat(event_type, 120) AS agent, CASE WHEN event_id % 6 = 0 THEN '/static/x' WHEN event_id % 6 = 1 THEN '/api/v1/health' ELSE '/api/v1/docs' END AS path FROM events) WHERE path = '/api/v1/docs'")
def a18(spark, d):
    path = F.when(F.col("event_id") % 6 == 0, "/static/x").when(F.col("event_id") % 6 == 1, "/api/v1/health").otherwise("/api/v1/docs")
    log = view(spark, d, "events").select("event_id", F.concat(F.lit("10.0."), F.col("user_id").cast("string"), F.lit(".1, 10.9.9.9")).alias("fwd"), F.repeat("event_type", F.lit(120)).alias("agent"), path.alias("path"))
    skip = F.lit(False)
    for p in S.SKIPPED_PATHS:
        skip = skip | F.startswith("path", F.lit(p))
    return log.filter(~skip).select("event_id", F.trim(F.split_part("fwd", F.lit(","), F.lit(1))).alias("client"), F.left("agent", F.lit(500)).alias("agent"))


@op("A19", r"SELECT page_id, t[-1] AS filename, array_to_string(list_filter(list_transform(list_slice(t, 1, len(t) - 1), lambda s: trim(s)), lambda s: s <> ''), '/') AS folder, t[-1] = '' AS skipped FROM (SELECT page_id, string_split(regexp_extract(url, '^.*?://[^/?#]*/([^?#]*)', 1), '/') AS t FROM pages) WHERE len(t) > 1")
def a19(spark, d):
    t = F.split(F.regexp_extract("url", r"^.*?://[^/?#]*/([^?#]*)", 1), "/")
    rows = view(spark, d, "pages").select("page_id", t.alias("t")).filter(F.size("t") > 1)
    folder = F.filter(F.transform(F.slice("t", 1, F.size("t") - 1), lambda s: F.trim(s)), lambda s: s != "")
    return rows.select("page_id", F.element_at("t", -1).alias("filename"), F.array_join(folder, "/").alias("folder"), (F.element_at("t", -1) == "").alias("skipped"))
