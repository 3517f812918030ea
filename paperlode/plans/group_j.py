"""J: folder hierarchy and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folders as O
from .registry import op
from .views import spark_sql, view

UP = """a(folder_id, ancestor_id, depth) AS (SELECT folder_id, folder_id, 0 FROM v_folders UNION ALL SELECT a.folder_id, f.parent_id, a.depth + 1 FROM a JOIN v_folders AS f ON f.folder_id = a.ancestor_id WHERE f.parent_id IS NOT NULL)"""
MOVES = "SELECT folder_id, concat('n', CAST((length(folder_id) + length(name)) % 25 AS STRING)) AS new_parent FROM v_folders WHERE parent_id IS NULL UNION ALL SELECT folder_id, concat('r', CAST(length(name) % 5 AS STRING)) FROM v_folders WHERE substring(folder_id, 1, 1) = 'n' UNION ALL SELECT folder_id, folder_id FROM v_folders WHERE substring(folder_id, 1, 1) = 'm' AND length(name) > 8"


@op("J1", f"WITH RECURSIVE {UP}, m AS ({MOVES}) SELECT m.folder_id, m.new_parent, CASE WHEN m.folder_id = m.new_parent THEN 'self' WHEN a.folder_id IS NOT NULL THEN 'cycle' ELSE 'accepted' END AS outcome FROM m LEFT JOIN a ON a.folder_id = m.new_parent AND a.ancestor_id = m.folder_id")
def j1(spark, d):
    return O.judge_moves(spark, view(spark, d, "v_folders"), spark_sql(spark, d, MOVES))


@op("J2", """WITH RECURSIVE live AS (SELECT * FROM v_folders WHERE NOT is_trashed), t(folder_id, root_id, depth, path) AS (SELECT folder_id, folder_id, 0, name FROM live WHERE parent_id IS NULL OR parent_id NOT IN (SELECT folder_id FROM live)
  UNION ALL SELECT c.folder_id, t.root_id, t.depth + 1, concat(t.path, '/', c.name) FROM live AS c JOIN t ON c.parent_id = t.folder_id) SELECT * FROM t""")
def j2(spark, d):
    return O.tree(spark, view(spark, d, "v_folders"))


@op("J3", f"WITH RECURSIVE {UP}, g AS (SELECT DISTINCT a.folder_id FROM a JOIN v_folders AS r ON r.folder_id = a.ancestor_id AND r.is_trashed), c AS (SELECT doc_id, concat('n', CAST(doc_id % 25 AS STRING)) AS folder_id FROM v_docs) SELECT g.folder_id, c.doc_id FROM g LEFT JOIN c USING (folder_id)")
def j3(spark, d):
    """What goes with the trashed folders: every folder below them, and the documents of each."""
    folders = view(spark, d, "v_folders")
    trashed = folders.filter("is_trashed").select(F.col("folder_id").alias("ancestor_id"))
    gone = O.ancestors(spark, folders).join(trashed, "ancestor_id", "left_semi").select("folder_id").distinct()
    docs = view(spark, d, "v_docs").select("doc_id", F.concat(F.lit("n"), (F.col("doc_id") % 25).cast("string")).alias("folder_id"))
    return gone.join(docs, "folder_id", "left").select("folder_id", "doc_id")


@op("J4", "SELECT CASE WHEN is_starred THEN 'starred' WHEN parent_id IS NULL THEN 'root' ELSE 'child' END AS mode, folder_id, name, row_number() OVER (PARTITION BY CASE WHEN is_starred THEN 'starred' WHEN parent_id IS NULL THEN 'root' ELSE 'child' END ORDER BY name, folder_id) AS place FROM v_folders WHERE NOT is_trashed")
def j4(spark, d):
    from pyspark.sql import Window

    mode = F.when(F.col("is_starred"), "starred").when(F.col("parent_id").isNull(), "root").otherwise("child")
    live = view(spark, d, "v_folders").filter("not is_trashed").select(mode.alias("mode"), "folder_id", "name")
    return live.withColumn("place", F.row_number().over(Window.partitionBy("mode").orderBy("name", "folder_id")).cast("long"))


VERSIONS = "SELECT doc_id, CAST(v AS BIGINT) AS version, size_bytes + v AS bytes, v = 2 AND doc_id % 3 = 0 AS is_current FROM v_docs, (VALUES (1), (2), (3)) AS t(v) WHERE v <= 1 + doc_id % 3"


@op("J5", f"WITH ver AS ({VERSIONS}), s AS (SELECT v.*, coalesce(c.bytes, l.bytes) AS bytes FROM v_docs AS v LEFT JOIN (SELECT doc_id, bytes FROM ver WHERE is_current) AS c USING (doc_id) LEFT JOIN (SELECT doc_id, arg_max(bytes, version) AS bytes FROM ver GROUP BY 1) AS l USING (doc_id) WHERE NOT v.is_trashed), m AS (SELECT 'folder' AS listing, folder_id AS shelf, * FROM s UNION ALL SELECT 'starred', NULL, * FROM s WHERE is_starred) SELECT listing, shelf, doc_id, title, bytes, row_number() OVER (PARTITION BY listing, shelf ORDER BY created_at DESC, doc_id DESC) AS place FROM m")
def j5(spark, d):
    """Two listings: by folder (null: the root), and the starred documents of any folder."""
    from pyspark.sql import Window

    size = spark_sql(spark, d, VERSIONS).groupBy("doc_id").agg(F.coalesce(F.max(F.when(F.col("is_current"), F.col("bytes"))), F.max_by("bytes", "version")).alias("bytes"))
    docs = view(spark, d, "v_docs").filter("not is_trashed").join(size, "doc_id", "left")
    shelf = F.struct(F.lit("folder").alias("listing"), F.col("folder_id").alias("shelf"))
    starred = F.when(F.col("is_starred"), F.struct(F.lit("starred").alias("listing"), F.lit(None).cast("string").alias("shelf")))
    rows = docs.withColumn("x", F.explode(F.array_compact(F.array(shelf, starred)))).select("x.*", "doc_id", "title", "bytes", "created_at")
    order = Window.partitionBy("listing", "shelf").orderBy(F.desc("created_at"), F.desc("doc_id"))
    return rows.select("listing", "shelf", "doc_id", "title", "bytes", F.row_number().over(order).cast("long").alias("place"))


@op("J6", f"WITH ver AS ({VERSIONS}) SELECT v.doc_id, v.title, (SELECT string_agg(concat(version, ':', bytes), ',' ORDER BY version) FROM ver WHERE ver.doc_id = v.doc_id) AS versions, concat('lang=', doc_type, ',status=', status) AS metadata FROM v_docs AS v")
def j6(spark, d):
    v = spark_sql(spark, d, VERSIONS).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("version", "bytes"))).alias("x"))
    shown = F.array_join(F.transform("x", lambda r: F.concat(r["version"].cast("string"), F.lit(":"), r["bytes"].cast("string"))), ",")
    return view(spark, d, "v_docs").join(v, "doc_id", "left").select("doc_id", "title", shown.alias("versions"), F.concat(F.lit("lang="), "doc_type", F.lit(",status="), "status").alias("metadata"))
