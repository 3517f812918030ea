"""I: operational analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from .registry import op
from .group_b import CH, PG, chunks
from .views import AS_OF, view


def _by_tenant(df, n=None):
    return df.groupBy("tenant_id").agg((n if n is not None else F.count("*")).alias("n"))


_PARTS = {"users": "SELECT tenant_id, count(*) AS n FROM v_users GROUP BY 1", "docs": "SELECT tenant_id, count(*) FILTER (NOT is_trashed) AS n FROM v_docs GROUP BY 1", "trashed": "SELECT tenant_id, count(*) FILTER (is_trashed) AS n FROM v_docs GROUP BY 1",
          "folders": "SELECT tenant_id, count(*) AS n FROM v_folders GROUP BY 1", "bytes": "SELECT tenant_id, sum(size_bytes) AS n FROM v_docs GROUP BY 1", "chunks": "SELECT tenant_id, count(*) AS n FROM ch JOIN v_docs USING (doc_id) GROUP BY 1",
          "audits": "SELECT tenant_id, count(*) AS n FROM v_audit GROUP BY 1", "sessions": "SELECT conv_id % 4 AS tenant_id, count(DISTINCT conv_id) AS n FROM conversations GROUP BY 1"}
_LONG = " UNION ALL ".join(f"SELECT tenant_id, '{p}' AS part, n FROM ({sql})" for p, sql in _PARTS.items())


@op("I1", f"WITH {PG}, {CH} SELECT tenant_id, {', '.join(f'CAST(coalesce(sum(n) FILTER (part = {p!r}), 0) AS BIGINT) AS {p}' for p in _PARTS)} FROM ({_LONG}) GROUP BY 1")
def i1(spark, d):
    docs = view(spark, d, "v_docs")
    convs = view(spark, d, "conversations").withColumn("tenant_id", F.col("conv_id") % 4)
    return A.overview({
        "users": _by_tenant(view(spark, d, "v_users")), "docs": _by_tenant(docs, F.count_if(~F.col("is_trashed"))), "trashed": _by_tenant(docs, F.count_if("is_trashed")), "folders": _by_tenant(view(spark, d, "v_folders")),
        "bytes": _by_tenant(docs, F.sum("size_bytes")), "chunks": _by_tenant(chunks(spark, d).select("doc_id").join(docs.select("doc_id", "tenant_id"), "doc_id")), "audits": _by_tenant(view(spark, d, "v_audit")), "sessions": _by_tenant(convs, F.count_distinct("conv_id")),
    })


@op("I2", "SELECT tenant_id, status, count(*) AS n FROM v_docs GROUP BY 1, 2")
def i2(spark, d):
    return view(spark, d, "v_docs").groupBy("tenant_id", "status").agg(F.count("*").alias("n"))


@op("I3", "SELECT lower(split_part(title, '.', 2)) AS file_type, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM v_docs GROUP BY 1")
def i3(spark, d):
    return view(spark, d, "v_docs").groupBy(T.file_type(F.col("title"), F.lit(None)).alias("file_type")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@op("I4", f"SELECT created_at AS day, count(*) AS uploads FROM v_docs WHERE created_at > DATE '{AS_OF}' - 30 GROUP BY 1")
def i4(spark, d):
    return view(spark, d, "v_docs").filter(F.col("created_at") > F.date_sub(F.lit(AS_OF).cast("date"), 30)).groupBy(F.col("created_at").alias("day")).agg(F.count("*").alias("uploads"))


@op("I5", "SELECT tenant_id, uploader_id, docs, bytes FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY docs DESC, uploader_id) AS r FROM (SELECT tenant_id, uploader_id, count(*) AS docs, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM v_docs GROUP BY 1, 2)) WHERE r <= 10")
def i5(spark, d):
    by = view(spark, d, "v_docs").groupBy("tenant_id", "uploader_id").agg(F.count("*").alias("docs"), F.sum("size_bytes").alias("bytes"))
    return A.top(by, 10, [F.desc("docs"), "uploader_id"], ["tenant_id"])


@op("I6", "SELECT v.tenant_id, count(*) AS docs, CAST(sum(size_bytes) AS BIGINT) AS bytes, any_value(u.users) AS users FROM v_docs AS v LEFT JOIN (SELECT tenant_id, count(DISTINCT user_id) AS users FROM v_users GROUP BY 1) AS u USING (tenant_id) GROUP BY 1")
def i6(spark, d):
    docs = view(spark, d, "v_docs").groupBy("tenant_id").agg(F.count("*").alias("docs"), F.sum("size_bytes").alias("bytes"))
    return docs.join(view(spark, d, "v_users").groupBy("tenant_id").agg(F.count_distinct("user_id").alias("users")), "tenant_id", "left")


@op("I7", "SELECT tenant_id, id, actor_id, action FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS r FROM v_audit) WHERE r <= 20")
def i7(spark, d):
    return A.top(view(spark, d, "v_audit"), 20, [F.desc("created_at"), F.desc("id")], ["tenant_id"]).select("tenant_id", "id", "actor_id", "action")


@op("I8", "SELECT count(*) AS total, count(*) FILTER (CAST(created_at AS DATE) = DATE '2024-01-30') AS today, round(avg(response_time_ms), 2) AS avg_ms, round(100.0 * count(*) FILTER (status_code >= 400) / count(*), 2) AS error_rate FROM v_api_log")
def i8(spark, d):
    return A.api_overview(view(spark, d, "v_api_log"), "2024-01-30")


@op("I9", "SELECT method, CASE WHEN status_code < 300 THEN '2xx' WHEN status_code < 400 THEN '3xx' WHEN status_code < 500 THEN '4xx' ELSE '5xx' END AS status, count(*) AS n FROM v_api_log GROUP BY 1, 2")
def i9(spark, d):
    return view(spark, d, "v_api_log").groupBy("method", A.status_class(F.col("status_code")).alias("status")).agg(F.count("*").alias("n"))


@op("I10", "SELECT method, path, count(*) AS calls, round(avg(response_time_ms), 2) AS avg_ms FROM v_api_log GROUP BY 1, 2 ORDER BY calls DESC, method, path LIMIT 15")
def i10(spark, d):
    return A.top(A.endpoints(view(spark, d, "v_api_log")).drop("max_ms"), 15, [F.desc("calls"), "method", "path"])


@op("I11", "SELECT CAST(hour(created_at) AS INT) AS hour, count(*) AS calls FROM v_api_log WHERE created_at > TIMESTAMP '2024-01-29 12:00:00' AND created_at <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1")
def i11(spark, d):
    log = view(spark, d, "v_api_log")
    at = F.lit("2024-01-30 12:00:00").cast(log.schema["created_at"].dataType)
    return log.filter((F.col("created_at") > at - F.expr("INTERVAL 24 HOURS")) & (F.col("created_at") <= at)).groupBy(F.hour("created_at").alias("hour")).agg(F.count("*").alias("calls"))


@op("I12", "SELECT method, path, count(*) AS calls, round(avg(response_time_ms), 2) AS avg_ms, max(response_time_ms) AS max_ms FROM v_api_log GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY avg_ms DESC, method, path LIMIT 10")
def i12(spark, d):
    return A.top(A.endpoints(view(spark, d, "v_api_log")).filter("calls >= 2"), 10, [F.desc("avg_ms"), "method", "path"])


@op("I13", "SELECT event_id, method, path, status_code FROM v_api_log ORDER BY created_at DESC, event_id DESC LIMIT 50")
def i13(spark, d):
    return A.top(view(spark, d, "v_api_log"), 50, [F.desc("created_at"), F.desc("event_id")]).select("event_id", "method", "path", "status_code")


@op("I14", "SELECT tenant_id, count(*) FILTER (NOT is_trashed) AS files, count(*) FILTER (is_starred AND NOT is_trashed) AS starred, count(*) FILTER (is_trashed) AS trashed, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(DISTINCT folder_id) AS folders FROM v_docs GROUP BY 1")
def i14(spark, d):
    return view(spark, d, "v_docs").groupBy("tenant_id").agg(
        F.count_if(~F.col("is_trashed")).alias("files"), F.count_if(F.col("is_starred") & ~F.col("is_trashed")).alias("starred"), F.count_if("is_trashed").alias("trashed"), F.sum("size_bytes").alias("bytes"), F.count_distinct("folder_id").alias("folders"))


@op("I15", f"WITH {PG}, {CH} SELECT u.user_id, u.role, f.folders, f.files, f.bytes, f.chunks, f.file_types FROM v_users AS u LEFT JOIN (SELECT uploader_id, count(DISTINCT folder_id) AS folders, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(c.n) AS BIGINT) AS chunks, string_agg(DISTINCT lower(split_part(title, '.', 2)), ',' ORDER BY lower(split_part(title, '.', 2))) AS file_types FROM v_docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM ch GROUP BY 1) AS c USING (doc_id) WHERE NOT is_trashed GROUP BY 1) AS f ON f.uploader_id = u.user_id")
def i15(spark, d):
    live = view(spark, d, "v_docs").filter("not is_trashed").withColumn("t", T.file_type(F.col("title"), F.col("doc_type")))
    live = live.join(chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    per = live.groupBy("uploader_id").agg(F.count_distinct("folder_id").alias("folders"), F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.sum("n").alias("chunks"), F.array_join(F.array_sort(F.collect_set("t")), ",").alias("file_types"))
    users = view(spark, d, "v_users")
    return users.join(per, users.user_id == per.uploader_id, "left").select("user_id", "role", "folders", "files", "bytes", "chunks", "file_types")
