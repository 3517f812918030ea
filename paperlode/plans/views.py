"""Derived views that give the driver's tables the shapes the operators work on.

Each view is one SELECT in the part of SQL that Spark and DuckDB share; `sha256(` alone is spelt differently. In Spark
a view is a DataFrame over the Parquet tables it names, so filters and columns still reach the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The one "now" of every query.
AS_OF = "2024-02-01"

VIEWS = {
    "v_docs": """
        SELECT doc_id, doc_id % 4 AS tenant_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS folder_id,
          concat('doc_', doc_id, '.', CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'txt' ELSE 'csv' END) AS title,
          lang AS doc_type, CASE WHEN doc_id % 13 = 0 THEN 'failed' WHEN doc_id % 17 = 0 THEN 'pending' WHEN doc_id % 19 = 0 THEN 'processing' ELSE 'indexed' END AS status,
          doc_id % 11 = 0 AS is_trashed, doc_id % 5 = 0 AS is_starred,
          CASE WHEN doc_id % 11 = 0 THEN DATE '2023-12-01' + CAST(doc_id % 60 AS INT) END AS trashed_at,
          CASE doc_id % 3 WHEN 0 THEN 'unclassified_permanent' WHEN 1 THEN 'operational_trash' ELSE 'statutory_record' END AS retention_class,
          sha256(text) AS file_hash, n_chars AS size_bytes, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS created_at,
          doc_id % 150 AS uploader_id, text
        FROM documents""",
    "v_lines": """
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn
        FROM lineitem""",
    "v_facts": """
        SELECT fact_id, doc_id % 4 AS tenant_id, doc_id, field_name, value, confidence, is_handwritten,
          CASE WHEN verified AND status = 'in_review' THEN 'verified' ELSE status END AS status, rn, l_linenumber
        FROM (SELECT *, CASE WHEN is_handwritten OR confidence IS NULL THEN 'in_review' WHEN confidence >= 0.85 THEN 'machine' ELSE 'in_review' END AS status
          FROM (SELECT l_orderkey * 100 + rn AS fact_id, l_orderkey % 1000 AS doc_id,
              CASE l_linenumber % 6 WHEN 0 THEN 'owner' WHEN 1 THEN 'area' WHEN 2 THEN 'village' WHEN 3 THEN 'survey_no' WHEN 4 THEN 'valuation' ELSE '_marginalia' END AS field_name,
              CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) AS value, CASE WHEN l_tax = 0 THEN NULL ELSE l_discount * 10 END AS confidence,
              l_returnflag = 'R' AS is_handwritten, l_linestatus = 'F' AND l_quantity > 40 AS verified, rn, l_linenumber
            FROM v_lines) AS a) AS b""",
    "v_regions": """
        SELECT fact_id, doc_id, 1 + fact_id % 3 AS page_number, 0.1 AS x0, (l_linenumber - 1) / 8.0 AS y0, 0.9 AS x1, (l_linenumber - 1) / 8.0 + 0.1 AS y1 FROM v_facts WHERE fact_id % 97 <> 0
        UNION ALL
        SELECT fact_id, doc_id, 2 + fact_id % 3 AS page_number, 0.1 AS x0, 0.8 AS y0, 0.9 AS x1, 0.9 AS y1 FROM v_facts WHERE fact_id % 97 <> 0 AND rn % 5 = 0""",
    "v_register": """
        SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY l_orderkey, rn) AS pos,
          CASE WHEN rn % 4 = 0 THEN NULL ELSE CAST(l_orderkey * 100 + rn AS STRING) END AS serial,
          CASE WHEN CAST(floor(l_quantity) AS BIGINT) % 3 = 0 AND page_number % 3 <> 2 THEN 'Do.' WHEN page_number % 3 = 2 THEN NULL ELSE concat('o', CAST(l_partkey % 50 AS STRING)) END AS owner,
          CASE WHEN CAST(floor(l_quantity) AS BIGINT) % 5 = 0 AND page_number % 3 <> 2 THEN ',,' WHEN page_number % 3 = 2 THEN NULL ELSE concat('v', CAST(l_partkey % 9 AS STRING)) END AS village,
          CASE WHEN page_number % 4 = 1 THEN NULL ELSE CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) END AS area,
          CASE WHEN page_number % 3 = 2 OR page_number = 5 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) END AS valuation,
          CASE WHEN l_tax = 0 THEN NULL ELSE l_discount * 10 END AS confidence, l_returnflag = 'R' AS is_handwritten,
          (l_linenumber - 1) / 8.0 AS y0, (l_linenumber - 1) / 8.0 + 0.1 AS y1
        FROM (SELECT *, l_suppkey AS doc_id, 1 + l_orderkey % 6 AS page_number FROM v_lines) AS r""",
    "v_nodes": """
        SELECT concat('c', CAST(c_custkey AS STRING)) AS node_id, c_nationkey % 4 AS tenant_id, 'person' AS entity_type, c_name AS label FROM customer
        UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), s_nationkey % 4, 'trust', s_name FROM supplier
        UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), CAST(p_partkey % 4 AS INT), 'property', p_name FROM part""",
    "v_edges": """
        SELECT edge_id, tenant_id, edge_type, tier, source_node, target_type, target_node, target_fact, confidence, evidence_fact_id,
          CASE WHEN tier <= 2 THEN 'machine' WHEN edge_id % 10 = 3 THEN 'verified' ELSE 'held' END AS status
        FROM (SELECT o_orderkey AS edge_id, o_custkey % 4 AS tenant_id, concat('rel_', lower(substring(o_orderpriority, 1, 1))) AS edge_type, 1 + o_orderkey % 4 AS tier,
            concat('c', CAST(o_custkey AS STRING)) AS source_node, CASE WHEN o_orderkey % 2 = 0 THEN 'entity' ELSE 'fact' END AS target_type,
            CASE WHEN o_orderkey % 2 <> 0 THEN NULL WHEN o_orderkey % 501 = 0 THEN concat('c', CAST(o_custkey AS STRING)) ELSE concat('s', CAST(o_orderkey % 100 AS STRING)) END AS target_node,
            CASE WHEN o_orderkey % 2 <> 0 THEN o_orderkey * 100 + 1 END AS target_fact, (o_orderkey % 100) / 100.0 AS confidence, o_orderkey * 100 + 1 AS evidence_fact_id
          FROM orders) AS e""",
    "v_records": """
        SELECT o_orderkey AS record_id, concat('c', CAST(o_custkey AS STRING)) AS subject_node, CASE WHEN o_orderkey % 2 = 0 THEN 'title' ELSE 'grant' END AS record_type,
          o_orderkey % 4 AS tenant_id, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS total, o_orderpriority AS priority, o_orderstatus AS order_status, o_orderkey * 100 + 1 AS evidence_fact_id
        FROM orders""",
    "v_amendments": """
        SELECT l_orderkey * 100 + rn AS amendment_id, l_orderkey AS record_id, CAST(l_shipdate AS DATE) AS effective_date, rn AS created_order,
          CASE WHEN rn % 2 = 0 THEN 'total' ELSE 'quantity' END AS field, CAST(CAST(floor(CASE WHEN rn % 2 = 0 THEN l_extendedprice ELSE l_quantity END) AS BIGINT) AS STRING) AS value,
          CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'under stay' WHEN l_returnflag = 'R' THEN 'set aside' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'superseded' END AS legal_status
        FROM v_lines WHERE rn >= 2""",
    "v_audit": "SELECT event_id AS id, user_id % 4 AS tenant_id, user_id AS actor_id, event_type AS action, props AS details, ts AS created_at FROM events",
    "v_api_log": """
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS method,
          concat('/', event_type, '/', CAST(event_id % 12 AS STRING)) AS path, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 10 = 0 THEN 404 ELSE 200 END AS status_code,
          value AS response_time_ms, user_id, user_id % 4 AS tenant_id, ts AS created_at
        FROM events""",
    "v_folders": """
        SELECT concat('r', CAST(r_regionkey AS STRING)) AS folder_id, CAST(NULL AS STRING) AS parent_id, r_name AS name, 0 AS tenant_id, r_regionkey = 3 AS is_trashed, DATE '2023-12-15' AS trashed_at, r_regionkey % 2 = 0 AS is_starred FROM region
        UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), n_name, 0, n_nationkey % 9 = 4, DATE '2024-01-20', n_nationkey % 3 = 0 FROM nation
        UNION ALL SELECT concat('m', CAST(c_nationkey AS STRING), '_', c_mktsegment), concat('n', CAST(c_nationkey AS STRING)), c_mktsegment, 0, false, DATE '2023-12-15', false FROM customer GROUP BY c_nationkey, c_mktsegment""",
    "v_users": """
        SELECT user_id, user_id % 4 AS tenant_id, CASE user_id % 6 WHEN 0 THEN 'it_admin' WHEN 1 THEN 'operator' WHEN 2 THEN 'reviewer' WHEN 3 THEN 'viewer' WHEN 4 THEN 'auditor' ELSE 'head' END AS role
        FROM (SELECT DISTINCT user_id FROM events) AS u""",
    "v_listing": """
        SELECT path, CAST(poll_no AS BIGINT) AS poll_no, size, CAST(mtime AS TIMESTAMP) AS mtime, CAST(poll_day AS TIMESTAMP) AS poll_ts FROM (
          SELECT concat(CASE user_id % 5 WHEN 0 THEN 'processed/' WHEN 1 THEN 'failed/' ELSE 'in/' END, 'f', CAST(user_id AS STRING), '.txt') AS path,
            extract(DAY FROM (CAST(ts AS TIMESTAMP) - CAST('2024-01-01 00:00:00' AS TIMESTAMP))) AS poll_no, CAST(ts AS DATE) + INTERVAL 1 DAY AS poll_day, size, max(CASE WHEN size = before THEN NULL ELSE ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS mtime,
            row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS back
          FROM (SELECT user_id, event_id, ts, CAST(floor(value / 400) AS BIGINT) AS size, lag(CAST(floor(value / 400) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) AS l) AS m
        WHERE back = 1""",
    "v_retention": "SELECT * FROM (VALUES ('unclassified_permanent', CAST(NULL AS INT)), ('operational_trash', 30), ('statutory_record', CAST(NULL AS INT))) AS t(class_name, retention_days)",
    "v_plans": "SELECT * FROM (VALUES ('trial', 100, 2147483648), ('starter', 2000, 53687091200), ('professional', 20000, 536870912000), ('enterprise', CAST(NULL AS INT), CAST(NULL AS BIGINT))) AS t(plan_key, max_documents, max_storage_bytes)",
    "v_calibration": "SELECT DISTINCT source AS folder_id FROM documents WHERE CAST(substring(source, 4, 9) AS INT) % 2 = 0",
    "v_metadata": """
        SELECT doc_id, 'lang' AS key, CASE doc_id % 4 WHEN 0 THEN concat('{"v":"', lang, '"}') WHEN 1 THEN concat('{"lang":"', lang, '"}') WHEN 2 THEN lang ELSE concat('["', lang, '","xx"]') END AS value FROM documents
        UNION ALL SELECT doc_id, 'source', concat('{"v":"', source, '"}') FROM documents""",
    "v_queries": """
        SELECT d.doc_id AS query_id, CAST(floor(d.doc_id / 20) AS BIGINT) % 4 AS tenant_id, lower(regexp_replace(d.head, '[^A-Za-z ]', '', 'g')) AS query,
          CASE CAST(floor(d.doc_id / 20) AS BIGINT) % 3 WHEN 0 THEN 'OWN' WHEN 1 THEN '4' ELSE d.head END AS raw, e.embedding
        FROM (SELECT doc_id, concat(split_part(split_part(text, chr(10), 1), ' ', 1), ' ', split_part(split_part(text, chr(10), 1), ' ', 2), ' ', split_part(split_part(text, chr(10), 1), ' ', 3)) AS head FROM documents WHERE doc_id % 20 = 0) AS d
        LEFT JOIN embeddings AS e ON e.vec_id = d.doc_id""",
}


def names_in(sql: str) -> list[str]:
    """The tables and views that a text reads."""
    return [n for n in [*TABLES, *VIEWS] if re.search(rf"\b{n}\b", sql)]


def spark_sql(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """sql over tables, views and given frames, in Spark."""
    needed = {n: frames[n] if n in frames else view(spark, sf_dir, n) for n in [*names_in(sql), *frames]}
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces of the text itself
    for n in sorted(needed, key=len, reverse=True):
        sql = re.sub(rf"\b{n}\b(?!\.)", f"{{{n}}}", sql)
    sql = re.sub(r"\bsha256\(([\w.]+)\)", r"sha2(\1, 256)", sql).replace(", '', 'g')", ", '')").replace("chr(10)", "'\\n'")
    return spark.sql(sql, **needed)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark_sql(spark, sf_dir, VIEWS[name])


def oracle(sql: str) -> str:
    """sql for DuckDB, with the views it needs as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in names_in(text):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                if n not in order:
                    order.append(n)

    need(sql)
    body = sql.strip()
    views = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {body[14:]}"
    return f"WITH {views}, {body[4:]}" if body.upper().startswith("WITH ") else f"WITH {views} {body}"
