"""M: conversations and plug-in stages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import providers as M
from .group_c import facts_without_region
from .registry import op
from .views import spark_sql, view


@op("M1a", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY 1")
def m1a(spark, d):
    return view(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))


@op("M1b", r"SELECT conv_id, CASE WHEN length(t) > 40 THEN concat(left(t, 37), '...') ELSE t END AS title FROM (SELECT conv_id, concat(upper(left(h, 1)), lower(substring(h, 2))) AS t FROM (SELECT conv_id, array_to_string(list_slice(list_filter(string_split_regex(arg_min(text, turn), '\s+'), lambda x: x <> ''), 1, 5), ' ') AS h FROM conversations WHERE role = 'user' GROUP BY 1))")
def m1b(spark, d):
    first = view(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("x"))
    head = F.array_join(F.slice(F.filter(F.split("x", r"\s+"), lambda w: w != ""), 1, 5), " ")
    first = first.select("conv_id", F.concat(F.upper(F.left(head, F.lit(1))), F.lower(F.substring(head, 2, 10**6))).alias("t"))
    return first.select("conv_id", F.when(F.length("t") > 40, F.concat(F.left("t", F.lit(37)), F.lit("..."))).otherwise(F.col("t")).alias("title"))


def _up():
    """A conversation in its order."""
    return Window.partitionBy("conv_id").orderBy("turn")


@op("M1c", "SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' AND turn % 3 <> 0 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context_turn FROM conversations")
def m1c(spark, d):
    has = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 != 0), F.col("turn"))
    return view(spark, d, "conversations").select("conv_id", "turn", F.last(has, ignorenulls=True).over(_up().rowsBetween(Window.unboundedPreceding, -1)).alias("context_turn"))


@op("M1d", "SELECT conv_id, turn, coalesce(string_agg(concat(role, ':', left(text, 20)), '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations")
def m1d(spark, d):
    said = F.concat("role", F.lit(":"), F.left("text", F.lit(20)))
    return view(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list(said).over(_up().rowsBetween(-4, -1)), "|").alias("context"))


@op("M1e", "WITH a AS (SELECT conv_id, turn % 4 AS doc, 0 AS src, turn, 1.0 / (1 + turn) AS score FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn % 4, 1, turn, 1.0 / (2 + turn) FROM conversations WHERE role = 'assistant') SELECT conv_id, doc, src, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, doc ORDER BY src, turn) AS r FROM a) WHERE r = 1 AND score >= 0.2")
def m1e(spark, d):
    c = view(spark, d, "conversations")
    side = lambda role, src, add: c.filter(F.col("role") == role).select("conv_id", (F.col("turn") % 4).alias("doc"), F.lit(src).alias("src"), "turn", (1.0 / (add + F.col("turn"))).alias("score"))
    both = side("user", 0, 1).unionByName(side("assistant", 1, 2))
    first = both.groupBy("conv_id", "doc").agg(F.min(F.struct("src", "turn", "score")).alias("x")).select("conv_id", "doc", "x.src", F.round("x.score", 6).alias("score"))
    return first.filter("score >= 0.2")


_REPLIES = "SELECT sha256(u.text) AS key, min(a.text) AS output FROM conversations AS u JOIN conversations AS a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user' AND u.conv_id % 2 = 0 GROUP BY 1"


@op("M2", f"""WITH e AS (SELECT sha256(d.text) AS key, min(e.vec_id) AS vec_id FROM documents AS d JOIN embeddings AS e ON e.vec_id = d.doc_id GROUP BY 1), r AS ({_REPLIES}),
  p AS (SELECT conv_id AS query_id, turn AS item_id, turn AS rank, CASE WHEN role = 'assistant' AND conv_id % 3 > 0 THEN 1.0 / (1 + length(text)) END AS s FROM conversations),
  k AS (SELECT *, count(s) OVER (PARTITION BY query_id) > 0 AS reranked, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank, item_id) AS place FROM p)
  SELECT 'embed' AS slot, d.doc_id AS id, 0 AS item, CAST(len(x.embedding) AS STRING) AS output, x.embedding IS NULL AS missing FROM documents AS d LEFT JOIN e ON e.key = sha256(d.text) LEFT JOIN embeddings AS x ON x.vec_id = e.vec_id
  UNION ALL SELECT 'complete', c.conv_id, c.turn, r.output, r.output IS NULL FROM conversations AS c LEFT JOIN r ON r.key = sha256(c.text) WHERE c.role = 'user'
  UNION ALL SELECT 'rerank', query_id, item_id, CAST(place AS STRING), NOT reranked FROM k WHERE place <= 2
  UNION ALL SELECT 'extract', page_id, 1, CASE WHEN page_id % 2 = 0 THEN url END, page_id % 2 <> 0 FROM pages""")
def m2(spark, d):
    """The four slots over tables of outputs made before: some rows have none and say so."""
    docs, e, c, pages = (view(spark, d, t) for t in ("documents", "embeddings", "conversations", "pages"))
    made = docs.join(e, docs.doc_id == e.vec_id).select(M.text_key("text").alias("key"), "vec_id", "embedding")
    made = made.groupBy("key").agg(F.min_by("embedding", "vec_id").cast("array<double>").alias("output"))
    embedded = M.embed(docs.select("doc_id", "text"), M.Stored(made)).select(F.lit("embed").alias("slot"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("item"), F.size("output").cast("string").alias("output"), F.col("error").isNotNull().alias("missing"))
    replied = M.complete(c.filter("role = 'user'").withColumnRenamed("text", "prompt"), M.Stored(spark_sql(spark, d, _REPLIES)))
    replied = replied.select(F.lit("complete"), "conv_id", "turn", "output", F.col("error").isNotNull())
    pairs = c.select(F.col("conv_id").alias("query_id"), F.col("conv_id").cast("string").alias("query"), F.col("turn").alias("item_id"), F.concat_ws("|", F.col("turn").cast("string"), "text").alias("content"), F.col("turn").alias("rank"), "role", "text")
    scores = pairs.filter("role = 'assistant' AND query_id % 3 > 0").select(M.text_key("query", "content").alias("key"), (1.0 / (1 + F.length("text"))).alias("output"))
    ranked = M.rerank(pairs.drop("role", "text"), M.Stored(scores), 2).select(F.lit("rerank"), "query_id", "item_id", F.col("place").cast("string"), ~F.col("reranked"))
    asked = pages.select("page_id", F.encode("html", "UTF-8").alias("content"), F.col("page_id").alias("page_number"), F.lit("the address").alias("prompt"), "url")
    archive = asked.filter("page_id % 2 = 0").select(M.text_key(F.sha2("content", 256), F.col("page_number").cast("string"), F.col("prompt")).alias("key"), F.col("url").alias("output"))
    read = M.extract(asked.drop("url"), M.Stored(archive)).select(F.lit("extract"), "page_id", F.lit(1).cast("long"), "output", F.col("error").isNotNull())
    return embedded.union(replied).union(ranked).union(read)


@op("M3", "SELECT f.fact_id FROM v_facts AS f WHERE f.fact_id NOT IN (SELECT fact_id FROM v_regions)")
def m3(spark, d):
    return facts_without_region(view(spark, d, "v_facts"), view(spark, d, "v_regions"))
