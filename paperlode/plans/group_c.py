"""C: tables rebuilt from page fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import is_ditto
from ..operators import tables as O
from ..operators.facts import classify
from .registry import op
from .views import spark_sql, view

SETS = "SELECT doc_id, page_number, list_sort(list_filter([" + ", ".join(f"max(CASE WHEN trim(coalesce({f}, '')) <> '' THEN '{f}' END)" for f in O.FIELDS) + "], lambda x: x IS NOT NULL)) AS fields FROM v_register GROUP BY 1, 2"
PAIRS = f"""SELECT doc_id, page_number, a, b, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END AS similarity,
  CASE WHEN len(b) = 0 THEN 'vertical' WHEN len(list_intersect(a, b)) / CAST(greatest(len(list_distinct(list_concat(a, b))), 1) AS DOUBLE) >= 0.7 OR len(list_concat(a, b)) = 0 THEN 'vertical' WHEN len(list_intersect(a, b)) = 0 AND len(list_distinct(list_concat(a, b))) / 5.0 >= 0.5 THEN 'horizontal' ELSE 'ambiguous' END AS relation,
  SHA256(concat(array_to_string(a, ','), '|', array_to_string(b, ','))) AS shape_hash FROM (SELECT doc_id, page_number, lag(fields) OVER (PARTITION BY doc_id ORDER BY page_number) AS a, fields AS b FROM ({SETS})) WHERE a IS NOT NULL"""
SEGMENTS = f"SELECT s.doc_id, s.page_number, sum(CASE WHEN p.relation = 'vertical' THEN 0 ELSE 1 END) OVER (PARTITION BY s.doc_id ORDER BY s.page_number) AS segment FROM ({SETS}) AS s LEFT JOIN ({PAIRS}) AS p USING (doc_id, page_number)"


def facts_without_region(facts, regions):
    return facts.select("fact_id").join(regions.select("fact_id"), "fact_id", "left_anti")


def _sets(spark, d):
    return O.field_sets(view(spark, d, "v_register"))


def _pairs(spark, d):
    return O.page_pairs(_sets(spark, d))


def _segments(spark, d):
    sets = _sets(spark, d)
    return O.segments(sets, O.page_pairs(sets))


def _rows(spark, d):
    return view(spark, d, "v_register").join(_segments(spark, d), ["doc_id", "page_number"])


@op("C1", f"SELECT doc_id, page_number, array_to_string(fields, ',') AS fields FROM ({SETS})")
def c1(spark, d):
    return _sets(spark, d).select("doc_id", "page_number", F.array_join("fields", ",").alias("fields"))


@op("C2", f"SELECT doc_id, page_number, round(similarity, 6) AS similarity FROM ({PAIRS})")
def c2(spark, d):
    return _pairs(spark, d).select("doc_id", "page_number", F.round("similarity", 6).alias("similarity"))


@op("C3", f"SELECT doc_id, page_number, shape_hash FROM ({PAIRS})")
def c3(spark, d):
    return _pairs(spark, d).select("doc_id", "page_number", "shape_hash")


@op("C4", f"SELECT doc_id, page_number, relation FROM ({PAIRS})")
def c4(spark, d):
    return _pairs(spark, d).select("doc_id", "page_number", "relation")


_EVENTS = "SELECT event_id, ts, user_id % 40 AS shape, event_type = 'signup' AS is_human, CASE event_id % 3 WHEN 0 THEN 'vertical' WHEN 1 THEN 'horizontal' ELSE 'unrelated' END AS relation FROM events"


@op("C5", f"SELECT shape, arg_max(relation, (is_human, ts, event_id)) AS relation, max(is_human) AS is_human FROM ({_EVENTS}) GROUP BY 1")
def c5(spark, d):
    return spark_sql(spark, d, _EVENTS).groupBy("shape").agg(F.max_by("relation", F.struct("is_human", "ts", "event_id")).alias("relation"), F.max("is_human").alias("is_human"))


VERDICTS = f"SELECT shape_hash, CASE WHEN length(replace(shape_hash, 'a', '')) % 2 = 0 THEN 'vertical' ELSE 'unrelated' END AS verdict, (length(replace(shape_hash, 'b', '')) % 10) / 10.0 AS confidence FROM (SELECT DISTINCT shape_hash FROM ({PAIRS}) WHERE relation = 'ambiguous')"


def _verdicts(spark, d):
    shapes = _pairs(spark, d).filter("relation = 'ambiguous'").select("shape_hash").distinct()
    return shapes.select("shape_hash", F.when(F.length(F.replace("shape_hash", F.lit("a"), F.lit(""))) % 2 == 0, "vertical").otherwise("unrelated").alias("verdict"), ((F.length(F.replace("shape_hash", F.lit("b"), F.lit(""))) % 10) / 10.0).alias("confidence"))


@op("C6", f"SELECT p.doc_id, p.page_number, CASE WHEN v.verdict <> 'unrelated' AND v.confidence >= 0.6 THEN v.verdict ELSE 'unrelated' END AS relation FROM ({PAIRS}) AS p LEFT JOIN ({VERDICTS}) AS v USING (shape_hash) WHERE p.relation = 'ambiguous'")
def c6(spark, d):
    asked = _pairs(spark, d).filter("relation = 'ambiguous'").join(_verdicts(spark, d), "shape_hash", "left")
    sure = F.coalesce((F.col("verdict") != "unrelated") & (F.col("confidence") >= 0.6), F.lit(False))
    return asked.select("doc_id", "page_number", F.when(sure, F.col("verdict")).otherwise("unrelated").alias("relation"))


@op("C7", f"SELECT doc_id, page_number, CAST(segment AS BIGINT) AS segment FROM ({SEGMENTS})")
def c7(spark, d):
    return _segments(spark, d)


@op("C8", f"SELECT doc_id % 4 AS tenant_id, shape_hash, min(doc_id * 100 + page_number) AS first_page FROM ({PAIRS}) WHERE relation = 'ambiguous' AND shape_hash NOT LIKE '%00%' GROUP BY 1, 2")
def c8(spark, d):
    asked = _pairs(spark, d).filter("relation = 'ambiguous'").withColumn("tenant_id", F.col("doc_id") % 4)
    open_ = asked.filter(F.contains("shape_hash", F.lit("00"))).select("tenant_id", "shape_hash").distinct()  # already under review
    return asked.join(open_, ["tenant_id", "shape_hash"], "left_anti").groupBy("tenant_id", "shape_hash").agg(F.min(F.col("doc_id") * 100 + F.col("page_number")).alias("first_page"))


@op("C9", f"""WITH r AS (SELECT v.*, g.segment FROM v_register AS v JOIN ({SEGMENTS}) AS g USING (doc_id, page_number)), s AS (SELECT *, sum(CASE WHEN trim(coalesce(serial, '')) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, segment ORDER BY page_number, pos) AS rec FROM r),
  l AS (SELECT *, min(rec) OVER (PARTITION BY doc_id, segment) = 0 AS unmerged FROM s)
  SELECT doc_id, CAST(segment AS BIGINT) AS segment, arg_min(page_number, (page_number, pos)) AS page_number, arg_min(pos, (page_number, pos)) AS pos, arg_min(serial, (page_number, pos)) FILTER (serial IS NOT NULL) AS serial, coalesce(trim(string_agg(nullif(trim(coalesce(owner, '')), ''), ' ' ORDER BY page_number, pos)), '') AS owner, coalesce(trim(string_agg(nullif(trim(coalesce(area, '')), ''), ' ' ORDER BY page_number, pos)), '') AS area, count(*) AS source_rows, string_agg(concat(page_number, ':', pos), ',' ORDER BY page_number, pos) AS source_index, unmerged
  FROM l GROUP BY doc_id, segment, unmerged, CASE WHEN unmerged THEN page_number * 1000000 + pos ELSE rec END""")
def c9(spark, d):
    return O.merge_continuations(_rows(spark, d), ["owner", "area"])


@op("C10", "SELECT doc_id, page_number, pos, coalesce(regexp_replace(lower(trim(owner)), '\\.$', '') IN (',,', '\"', 'do', '-do-', '″', ''''''), false) AS ditto FROM v_register")
def c10(spark, d):
    return view(spark, d, "v_register").select("doc_id", "page_number", "pos", is_ditto(F.col("owner")).alias("ditto"))


_D = "coalesce(regexp_replace(lower(trim({0})), '\\.$', '') IN (',,', '\"', 'do', '-do-', '″', ''''''), false)"
FILL = f"""WITH r AS (SELECT v.*, g.segment FROM v_register AS v JOIN ({SEGMENTS}) AS g USING (doc_id, page_number)), m AS (SELECT *, {_D.format('owner')} AS od, {_D.format('village')} AS vd FROM r),
  a AS (SELECT *, CASE WHEN NOT vd AND trim(coalesce(village, '')) <> '' THEN village END AS gv FROM m), b AS (SELECT *, last_value(gv IGNORE NULLS) OVER (PARTITION BY doc_id, segment ORDER BY page_number, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM a),
  e AS (SELECT *, sum(CASE WHEN gv <> pv THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, segment ORDER BY page_number, pos) AS era FROM b),
  f AS (SELECT *, last_value(CASE WHEN NOT od THEN row(owner) END IGNORE NULLS) OVER (PARTITION BY doc_id, segment, {{era}} ORDER BY page_number, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS oc FROM e)"""


@op("C11", FILL.format(era="0") + " SELECT doc_id, page_number, pos, CASE WHEN od AND oc IS NULL THEN owner ELSE oc[1] END AS owner FROM f")
def c11(spark, d):
    return O.expand_dittos(_rows(spark, d), ["owner"]).select("doc_id", "page_number", "pos", "owner")


@op("C12", FILL.format(era="era") + " SELECT doc_id, page_number, pos, CASE WHEN od AND oc IS NULL THEN owner ELSE oc[1] END AS owner, od AND oc IS NULL AS owner_unresolved FROM f")
def c12(spark, d):
    return O.expand_dittos(_rows(spark, d), ["owner"], anchor="village").select("doc_id", "page_number", "pos", "owner", "owner_unresolved")


@op("C13", FILL.format(era="0") + " SELECT doc_id, page_number, pos, od AND oc IS NOT NULL AS inherited, od AND oc IS NULL AS unresolved, CASE WHEN od AND oc IS NULL THEN 'in_review' WHEN is_handwritten OR confidence IS NULL THEN 'in_review' WHEN confidence >= 0.85 THEN 'machine' ELSE 'in_review' END AS status FROM f")
def c13(spark, d):
    out = O.expand_dittos(_rows(spark, d), ["owner"])
    status = F.when(F.col("owner_unresolved"), "in_review").otherwise(classify(F.col("confidence"), F.col("is_handwritten")))
    return out.select("doc_id", "page_number", "pos", F.col("owner_inherited").alias("inherited"), F.col("owner_unresolved").alias("unresolved"), status.alias("status"))


#: Facing halves: small pages, so that many pairs hold the same serials.
HALVES = "SELECT l_suppkey * 1000 + l_orderkey % 150 AS doc_id, 1 + rn % 3 AS page_number, row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 150, rn % 3 ORDER BY l_orderkey, rn) AS pos, CAST(l_orderkey % 2 AS STRING) AS no, CAST(l_partkey % 7 AS STRING) AS a, CASE WHEN rn % 3 = 1 THEN CAST(l_linenumber AS STRING) END AS b FROM v_lines"
SPREAD = f"""h AS ({HALVES}), k AS (SELECT doc_id, no, max(CASE WHEN page_number = 1 THEN 1 END) AS l, max(CASE WHEN page_number = 2 THEN 1 END) AS r, arg_max_null(a, pos) FILTER (page_number = 1) AS la, arg_max_null(b, pos) FILTER (page_number = 1) AS lb, arg_max_null(a, pos) FILTER (page_number = 2) AS ra, arg_max_null(b, pos) FILTER (page_number = 2) AS rb FROM h WHERE page_number IN (1, 2) GROUP BY 1, 2),
  bad AS (SELECT doc_id, coalesce(string_agg(no, ',' ORDER BY no) FILTER (r IS NULL), '') AS only_left, coalesce(string_agg(no, ',' ORDER BY no) FILTER (l IS NULL), '') AS only_right FROM k GROUP BY 1 HAVING count(*) FILTER (l IS NULL OR r IS NULL) > 0)"""


def _spread(spark, d):
    h = spark_sql(spark, d, HALVES)
    return O.spread_join(h.filter("page_number = 1"), h.filter("page_number = 2"), ["doc_id"], "no", ["a", "b"])


@op("C14", f"WITH {SPREAD} SELECT doc_id, no, coalesce(ra, la) AS a, coalesce(rb, lb) AS b FROM k WHERE doc_id NOT IN (SELECT doc_id FROM bad)")
def c14(spark, d):
    return _spread(spark, d)[0]


@op("C15", f"WITH p AS ({SETS}) SELECT l.doc_id, (l.page_number - 1) // 2 AS pair FROM p AS l JOIN p AS r ON r.doc_id = l.doc_id AND r.page_number = l.page_number + 1 WHERE l.page_number % 2 = 1 AND len(l.fields) > 0 AND len(r.fields) > 0")
def c15(spark, d):
    p = _sets(spark, d).filter(F.size("fields") > 0).select("doc_id", F.floor((F.col("page_number") - 1) / 2).alias("pair"), (F.col("page_number") % 2).alias("side"))
    return p.filter("side = 1").select("doc_id", "pair").join(p.filter("side = 0").select("doc_id", "pair"), ["doc_id", "pair"])


MATCH = f"""h AS ({HALVES}), l AS (SELECT doc_id, CASE WHEN pos % 5 = 0 THEN ' ' ELSE a END AS a, pos FROM h WHERE page_number = 1), r AS (SELECT doc_id, a, pos FROM h WHERE page_number = 2),
  ll AS (SELECT doc_id, a, max(pos) AS pos FROM l WHERE trim(a) <> '' GROUP BY 1, 2)"""


@op("C16", f"""WITH {MATCH} SELECT ll.doc_id, ll.pos AS left_pos, r.pos AS right_pos FROM ll JOIN r USING (doc_id, a) UNION ALL SELECT doc_id, pos, NULL FROM l WHERE trim(a) = '' UNION ALL SELECT doc_id, pos, NULL FROM ll WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = ll.doc_id AND r.a = ll.a)
  UNION ALL SELECT doc_id, NULL, pos FROM r WHERE NOT EXISTS (SELECT 1 FROM ll WHERE r.doc_id = ll.doc_id AND r.a = ll.a)""")
def c16(spark, d):
    h = spark_sql(spark, d, HALVES)
    left = h.filter("page_number = 1").withColumn("a", F.when(F.col("pos") % 5 == 0, " ").otherwise(F.col("a")))
    return O.match_by_key(left, h.filter("page_number = 2"), ["doc_id"], "a")


BOXES = "SELECT l_suppkey * 1000 + l_orderkey % 150 AS doc_id, 1 + rn % 3 AS page_number, row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 150, rn % 3 ORDER BY l_orderkey, rn) AS pos, CASE WHEN l_partkey % 40 <> 0 THEN CAST(l_linenumber % 4 AS DOUBLE) END AS y0, CASE WHEN l_partkey % 40 <> 0 THEN l_linenumber % 4 + 1.0 + (rn % 2) * 0.2 END AS y1 FROM v_lines"
CONTAIN = """x AS ({boxes}), l AS (SELECT * FROM x WHERE page_number = 1), r AS (SELECT * FROM x WHERE page_number = 2),
  n AS (SELECT doc_id, count(*) FILTER (page_number = 1) AS nl, count(*) FILTER (page_number = 2) AS nr FROM x WHERE page_number IN (1, 2) GROUP BY 1 HAVING count(*) FILTER (page_number = 1) > 0 AND count(*) FILTER (page_number = 2) > 0 AND count(*) FILTER (y0 IS NULL) = 0),
  m AS (SELECT n.doc_id, nl <= nr AS lh, nl, nr, l.pos AS left_pos, r.pos AS right_pos FROM n JOIN l USING (doc_id) JOIN r USING (doc_id) WHERE CASE WHEN nl <= nr THEN (r.y0 + r.y1) / 2 BETWEEN l.y0 AND l.y1 ELSE (l.y0 + l.y1) / 2 BETWEEN r.y0 AND r.y1 END),
  g AS (SELECT doc_id FROM (SELECT doc_id, lh, nl, nr, CASE WHEN lh THEN right_pos ELSE left_pos END AS o, count(*) AS c FROM m GROUP BY ALL) GROUP BY doc_id, lh, nl, nr HAVING max(c) = 1 AND count(*) = CASE WHEN lh THEN nr ELSE nl END)"""


def _boxes(spark, d):
    x = spark_sql(spark, d, BOXES)
    return x.filter("page_number = 1"), x.filter("page_number = 2")


@op("C17", f"WITH {CONTAIN.format(boxes=BOXES)} SELECT doc_id, left_pos, right_pos FROM m WHERE doc_id IN (SELECT doc_id FROM g)")
def c17(spark, d):
    return O.pair_by_position(*_boxes(spark, d), ["doc_id"])


_KEYED = f"SELECT *, CASE WHEN page_number = 1 AND pos % 3 <> 0 THEN concat('k', CAST(pos AS STRING)) WHEN page_number = 2 AND doc_id % 2 = 0 THEN concat(CASE WHEN doc_id % 4 = 0 THEN 'z' ELSE 'k' END, CAST(pos AS STRING)) END AS k FROM ({BOXES}) AS b WHERE page_number IN (1, 2)"


@op("C18", f"""WITH b AS ({_KEYED}), mk AS (SELECT l.doc_id, l.pos AS lp, r.pos AS rp FROM b AS l JOIN b AS r ON l.doc_id = r.doc_id AND l.k = r.k AND l.page_number = 1 AND r.page_number = 2),
  h AS (SELECT doc_id, bool_or(page_number = 1 AND k IS NOT NULL) AS lk, bool_or(page_number = 2 AND k IS NOT NULL) AS rk, (SELECT count(*) FROM mk WHERE mk.doc_id = b.doc_id) AS matched FROM b GROUP BY 1 HAVING count(DISTINCT page_number) = 2),
  e AS (SELECT b.* FROM b JOIN h USING (doc_id) WHERE NOT (lk AND rk AND matched = 0) AND NOT EXISTS (SELECT 1 FROM mk WHERE mk.doc_id = b.doc_id AND CASE WHEN b.page_number = 1 THEN mk.lp ELSE mk.rp END = b.pos)),
  {CONTAIN.format(boxes='SELECT * FROM e')}, p AS (SELECT doc_id, count(*) AS placed FROM m WHERE doc_id IN (SELECT doc_id FROM g) GROUP BY 1)
  SELECT h.doc_id, CASE WHEN lk AND rk AND matched = 0 THEN 'conflict' WHEN matched > 0 THEN 'by_key' WHEN placed > 0 THEN 'by_position' ELSE 'vetoed' END AS outcome, matched, coalesce(placed, 0) AS placed FROM h LEFT JOIN p USING (doc_id)""")
def c18(spark, d):
    """How each facing pair joins. Keys stand on the left in two rows of three, on the right in every other pair, and
    meet in half of those."""
    b = spark_sql(spark, d, _KEYED)
    return O.join_horizontally(b.filter("page_number = 1"), b.filter("page_number = 2"), ["doc_id"], "k")[1]


@op("C19", f"""WITH r AS (SELECT v.*, g.segment FROM v_register AS v JOIN ({SEGMENTS}) AS g USING (doc_id, page_number)), m AS (SELECT *, {_D.format('owner')} AS od, {_D.format('village')} AS vd FROM r),
  f AS (SELECT *, last_value(CASE WHEN NOT od THEN row(owner) END IGNORE NULLS) OVER w AS oc, last_value(CASE WHEN NOT vd THEN row(village) END IGNORE NULLS) OVER w AS vc, sum(CASE WHEN trim(coalesce(serial, '')) <> '' THEN 1 ELSE 0 END) OVER w AS rec FROM m WINDOW w AS (PARTITION BY doc_id, segment ORDER BY page_number, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  l AS (SELECT *, CASE WHEN min(rec) OVER (PARTITION BY doc_id, segment) = 0 THEN page_number * 1000000 + pos ELSE rec END AS k FROM f),
  c AS (SELECT *, unnest(['owner', 'village', 'area', 'valuation']) AS field, unnest([CASE WHEN od AND oc IS NULL THEN owner ELSE oc[1] END, CASE WHEN vd AND vc IS NULL THEN village ELSE vc[1] END, area, valuation]) AS v, unnest([od AND oc IS NULL, vd AND vc IS NULL, false, false]) AS u FROM l),
  p AS (SELECT doc_id, segment, k, min(row(page_number, pos)) AS head, string_agg(concat(page_number, ':', pos), ',' ORDER BY page_number, pos) AS source_index FROM l GROUP BY 1, 2, 3),
  g AS (SELECT doc_id, segment, k, field, string_agg(trim(v), ' ' ORDER BY page_number, pos) AS t, string_agg(concat(page_number, ':', CAST(round(y0 * 1000) AS BIGINT), '-', CAST(round(y1 * 1000) AS BIGINT)), ';' ORDER BY page_number, pos) FILTER (y0 >= 0 AND y1 > y0 AND y1 <= 1) AS regions, avg(confidence) AS confidence, bool_or(is_handwritten) AS is_handwritten, bool_or(u) AS u FROM c WHERE trim(coalesce(v, '')) <> '' GROUP BY 1, 2, 3, 4)
  SELECT doc_id, CAST(segment AS BIGINT) AS segment, head[1] AS page_number, head[2] AS pos, field, concat('{{"v":"', t, '"', CASE WHEN u THEN ',"unresolved_ditto":true' ELSE '' END, '}}') AS value, regions, round(confidence, 6) AS confidence, is_handwritten, CASE WHEN u OR is_handwritten OR confidence IS NULL THEN 'in_review' WHEN round(confidence, 9) >= 0.85 THEN 'machine' ELSE 'in_review' END AS status, source_index FROM g JOIN p USING (doc_id, segment, k) WHERE regions IS NOT NULL""")
def c19(spark, d):
    """Facts with the boxes of all rows that made them, over segments that run across pages."""
    shown = F.array_join(F.transform("regions", lambda r: F.concat(r["page_number"].cast("string"), F.lit(":"), F.round(r["y0"] * 1000).cast("long").cast("string"), F.lit("-"), F.round(r["y1"] * 1000).cast("long").cast("string"))), ";")
    return O.facts_of(_rows(spark, d), O.FIELDS[1:], ["owner", "village"]).withColumns({"regions": shown, "confidence": F.round("confidence", 6)})


@op("C20", "SELECT fact_id, CASE WHEN is_handwritten OR confidence IS NULL THEN 'in_review' WHEN confidence >= CASE field_name WHEN 'area' THEN 0.6 WHEN 'owner' THEN 0.95 ELSE 0.85 END THEN 'machine' ELSE 'in_review' END AS status FROM v_facts")
def c20(spark, d):
    band = F.when(F.col("field_name") == "area", 0.6).when(F.col("field_name") == "owner", 0.95).otherwise(0.85)
    return view(spark, d, "v_facts").select("fact_id", classify(F.col("confidence"), F.col("is_handwritten"), band).alias("status"))


@op("C21", "SELECT doc_id, page_number, pos, '_marginalia' AS field_name, village AS value, true AS is_handwritten, 'in_review' AS status FROM v_register WHERE serial IS NULL AND trim(village) <> '' AND y0 < 0.8")
def c21(spark, d):
    notes = view(spark, d, "v_register").filter("serial IS NULL AND trim(village) <> '' AND y0 < 0.8")
    return notes.select("doc_id", "page_number", "pos", F.lit("_marginalia").alias("field_name"), F.col("village").alias("value"), F.lit(True).alias("is_handwritten"), F.lit("in_review").alias("status"))


@op("C22", f"WITH {SPREAD} SELECT doc_id, '_join_mismatch' AS field_name, concat('left:', only_left, ' right:', only_right) AS value, 1.0 AS x1, 1.0 AS y1 FROM bad")
def c22(spark, d):
    return _spread(spark, d)[1].select("doc_id", F.lit("_join_mismatch").alias("field_name"), F.concat(F.lit("left:"), "only_left", F.lit(" right:"), "only_right").alias("value"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))


@op("C23", "SELECT l_suppkey AS doc_id, least(count(DISTINCT l_orderkey % 97), 25) AS pages FROM lineitem WHERE l_orderkey % 97 < 25 GROUP BY 1")
def c23(spark, d):
    pages = view(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") % 97 + 1).alias("page_number"))
    return pages.filter("page_number <= 25").groupBy("doc_id").agg(F.count_distinct("page_number").alias("pages"))
