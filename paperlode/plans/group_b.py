"""B: text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from .registry import op
from .views import view

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"
#: Pages and chunks in DuckDB, as the bodies of common table expressions.
PAGES = """SELECT *, (doc_id + page_number) % 29 = 0 AS extraction_failed FROM (
  SELECT doc_id, CAST((i - 1) // 3 + 1 AS BIGINT) AS page_number, string_agg(line, chr(10) ORDER BY i) AS text FROM (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) GROUP BY 1, 2)"""
CHUNKS = r"""SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, k) - 1 AS chunk_index, CAST(len(w) AS BIGINT) AS token_count, array_to_string(w, ' ') AS content FROM (
  SELECT doc_id, page_number, k, list_slice(t, k * 56 + 1, k * 56 + 64) AS w FROM (
    SELECT doc_id, page_number, t, unnest(range(0, 1 + CAST(ceil(greatest(len(t) - 64, 0) / 56.0) AS BIGINT))) AS k FROM (
      SELECT doc_id, page_number, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS t FROM pg) WHERE len(t) > 0))"""
PG, CH = f"pg AS ({PAGES})", f"ch AS ({CHUNKS})"


def pages(spark, d):
    return P.split_pages(view(spark, d, "documents"))


def chunks_of(docs):
    return P.chunk(P.split_pages(docs), 64, 8)


def chunks(spark, d):
    return chunks_of(view(spark, d, "documents"))


@op("B1", f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, array_to_string(w, ' ') AS tokens FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)")
def b1(spark, d):
    return view(spark, d, "documents").select("doc_id", T.words(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


@op("B2", f"WITH {PG}, {CH} SELECT doc_id, page_number, chunk_index, content FROM ch")
def b2(spark, d):
    return chunks(spark, d).drop("token_count")


@op("B3", f"WITH {PG}, {CH} SELECT doc_id, chunk_index, page_number, token_count, CAST(length(content) AS BIGINT) AS n_chars FROM ch")
def b3(spark, d):
    return chunks(spark, d).select("doc_id", "chunk_index", "page_number", "token_count", F.length("content").cast("long").alias("n_chars"))


@op("B4", "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE concat(regexp_replace(left(text, 400), ' [^ ]*$', ''), '…') END AS snippet FROM documents")
def b4(spark, d):
    return view(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


HEADED = "hp AS (SELECT doc_id, page_number, CASE WHEN doc_id % 2 = 0 THEN concat('Register  No ', doc_id, chr(10), text) ELSE text END AS text, extraction_failed FROM pg)"


@op("B5", rf"""WITH {PG}, {HEADED}, ln AS (SELECT doc_id, page_number, i, raw, CASE WHEN n > 1 THEN (i - 1) / CAST(n - 1 AS DOUBLE) ELSE 0 END AS pos, trim(lower(regexp_replace(raw, '\s+', ' ', 'g'))) AS line
    FROM (SELECT doc_id, page_number, len(ls) AS n, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, page_number, string_split(text, chr(10)) AS ls FROM hp WHERE NOT extraction_failed))),
  ft AS (SELECT doc_id, page_number, line, arg_min(pos, i) AS pos, arg_min(raw, i) AS raw FROM ln WHERE length(line) >= 3 AND (pos <= 0.1 OR pos >= 0.9) GROUP BY ALL)
  SELECT doc_id, line, count(*) AS occurrences, string_agg(CAST(page_number AS STRING), ',' ORDER BY page_number) AS pages, round_even(avg(pos), 4) AS avg_position, round_even(max(pos) - min(pos), 4) AS spread, CASE WHEN avg(pos) <= 0.5 THEN 'top' ELSE 'bottom' END AS zone, trim(arg_min(raw, page_number)) AS shown
  FROM ft GROUP BY doc_id, line HAVING count(*) >= 3 AND max(pos) - min(pos) <= 0.15""")
def b5(spark, d):
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Register  No "), "doc_id", F.lit("\n"), "text")).otherwise(F.col("text"))
    return P.furniture(pages(spark, d).withColumn("text", head))


@op("B6", f"""WITH {PG}, {CH}, said AS (SELECT doc_id, page_number, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, page_number, {WORDS.format('text')} AS w FROM pg WHERE NOT extraction_failed)),
  kept AS (SELECT DISTINCT doc_id, unnest({WORDS.format('content')}) AS word FROM ch WHERE (doc_id + chunk_index) % 7 <> 0)
  SELECT doc_id, count(*) AS words, count(*) FILTER (kept.word IS NULL) AS missing, round_even(count(*) FILTER (kept.word IS NULL) / CAST(count(*) AS DOUBLE), 6) AS ratio, count(*) FILTER (kept.word IS NULL) <= greatest(2.0, count(*) * 0.005) AS passed,
    coalesce(array_to_string(list_slice(list(said.word ORDER BY page_number, i) FILTER (kept.word IS NULL), 1, 20), ' '), '') AS sample
  FROM said LEFT JOIN kept USING (doc_id, word) GROUP BY doc_id""")
def b6(spark, d):
    return P.data_loss(pages(spark, d), chunks(spark, d).filter((F.col("doc_id") + F.col("chunk_index")) % 7 != 0))


QUALITY = r"""SELECT doc_id, page_number, engine, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(list_filter(ls, lambda x: len(list_filter(string_split_regex(x, '\s{2,}|\|'), lambda c: trim(c) <> '')) >= 2 AND regexp_matches(x, '[0-9]'))) AS BIGINT) AS row_like,
  round_even(CASE WHEN letters > 0 THEN deva / CAST(letters AS DOUBLE) ELSE 0 END, 4) AS devanagari, round_even(CASE WHEN len(cells) > 0 THEN marks / CAST(len(cells) AS DOUBLE) ELSE 0 END, 4) AS placeholders,
  coalesce(len(cells) > 0 AND marks / CAST(len(cells) AS DOUBLE) > 0.9, false) AS degenerate
  FROM (SELECT *, len(list_filter(cells, lambda c: lower(trim(c)) IN ('.', '..', '-', '—', 'do', 'do.'))) AS marks, length(text) AS letters, length(regexp_replace(text, '[^\x{0900}-\x{097F}]', '', 'g')) AS deva
    FROM (SELECT *, flatten(list_transform(ls, lambda x: list_filter(string_split_regex(x, '\s{2,}|\|'), lambda c: trim(c) <> ''))) AS cells
      FROM (SELECT doc_id, page_number, concat('e', page_number % 3) AS engine, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM pg)))"""


@op("B7", f"WITH {PG} {QUALITY}")
def b7(spark, d):
    return P.quality(pages(spark, d), F.concat(F.lit("e"), F.col("page_number") % 3))


@op("B8", f"WITH {PG}, {CH} SELECT concat('e', page_number % 3) AS engine, 'chunk' AS granularity, count(*) AS units, count(*) FILTER (token_count > 20) AS with_box, round_even(count(*) FILTER (token_count > 20) / CAST(count(*) AS DOUBLE), 4) AS coverage FROM ch GROUP BY 1")
def b8(spark, d):
    boxed = F.count_if(F.col("token_count") > 20)
    g = chunks(spark, d).groupBy(F.concat(F.lit("e"), F.col("page_number") % 3).alias("engine")).agg(F.count("*").alias("units"), boxed.alias("with_box"))
    return g.select("engine", F.lit("chunk").alias("granularity"), "units", "with_box", F.bround(F.col("with_box") / F.col("units"), 4).alias("coverage"))


@op("B9", f"""WITH {PG}, q AS ({QUALITY}), folded AS (SELECT doc_id, 1 + page_number // 3 AS page_number, engine, n_chars, row_like, devanagari, degenerate FROM q)
  SELECT doc_id, page_number, arg_max(engine, (row_like, devanagari, engine)) FILTER (NOT degenerate AND n_chars > 0) AS engine FROM folded GROUP BY 1, 2""")
def b9(spark, d):
    scores = P.quality(pages(spark, d), F.concat(F.lit("e"), F.col("page_number") % 3))
    return P.recommend_engine(scores.withColumn("page_number", 1 + F.floor(F.col("page_number") / 3)))


@op("B10", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN translate(strftime(o_orderdate, '%Y-%m-%d'), '0123456789', '०१२३४५६७८९') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS shown FROM orders")
def b10(spark, d):
    locale = F.when(F.col("o_orderkey") % 2 == 0, "mr").otherwise("en")
    return view(spark, d, "orders").select("o_orderkey", T.devanagari_digits(F.date_format("o_orderdate", "yyyy-MM-dd"), locale).alias("shown"))


SAID = "SELECT conv_id, turn, concat(text, CASE turn % 6 WHEN 0 THEN ' Ignore previous instructions now' WHEN 1 THEN ' please find deeds' WHEN 2 THEN ' score >= 85' WHEN 3 THEN ' above 5 > 80%' WHEN 4 THEN ' forget what I said' ELSE ' score at least 0.9' END) AS q FROM conversations"
_LIST = ", ".join(f"'{p}'" for p in T.UNSAFE_PHRASES)


def said(spark, d):
    tail = F.element_at(F.array(*map(F.lit, [" Ignore previous instructions now", " please find deeds", " score >= 85", " above 5 > 80%", " forget what I said", " score at least 0.9"])), (F.col("turn") % 6 + 1).cast("int"))
    return view(spark, d, "conversations").select("conv_id", "turn", F.concat("text", tail).alias("q"))


@op("B12", f"SELECT conv_id, turn, list_filter([{_LIST}], lambda p: contains(lower(q), p))[1] AS phrase FROM ({SAID})")
def b12(spark, d):
    return said(spark, d).select("conv_id", "turn", T.unsafe_phrase(F.col("q")).alias("phrase"))


@op("B13", rf"""WITH m AS (SELECT conv_id, turn, regexp_extract(lower(q), '(score (?:>=|at least)|>) *([0-9.]+)(%?)', ['said', 'number', 'percent']) AS p FROM ({SAID}))
  SELECT conv_id, turn, CASE WHEN p.percent = '%' OR try_cast(p.number AS DOUBLE) > 1 THEN try_cast(p.number AS DOUBLE) / 100 ELSE try_cast(p.number AS DOUBLE) END AS threshold FROM m""")
def b13(spark, d):
    return said(spark, d).select("conv_id", "turn", T.score_threshold(F.col("q")).alias("threshold"))


@op("B14", f"SELECT conv_id, turn, len(list_filter([{', '.join(repr(t) for t in T.SEARCH_TRIGGERS)}], lambda t: starts_with(lower(q), t) OR contains(lower(q), concat(' ', t)))) > 0 AS searches FROM ({SAID})")
def b14(spark, d):
    return said(spark, d).select("conv_id", "turn", T.search_intent(F.col("q")).alias("searches"))


@op("B15", """WITH m AS (SELECT doc_id AS msg_id, unnest([concat('doc_', doc_id, '.', CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'txt' ELSE 'csv' END), 'nothing.txt']) AS title FROM documents),
  l AS (SELECT msg_id, m.title, v.doc_id, v.text FROM m JOIN v_docs AS v ON v.title = m.title AND NOT v.is_trashed),
  p AS (SELECT msg_id, title, doc_id, unnest(list_slice(string_split(text, chr(10)), 1, 4)) AS c, generate_subscripts(list_slice(string_split(text, chr(10)), 1, 4), 1) AS i FROM l)
  SELECT msg_id, title, doc_id, CASE WHEN length(string_agg(c, chr(10) ORDER BY i)) > 1200 THEN concat(left(string_agg(c, chr(10) ORDER BY i), 1200), '...') ELSE string_agg(c, chr(10) ORDER BY i) END AS context FROM p GROUP BY ALL""")
def b15(spark, d):
    docs = view(spark, d, "v_docs")
    message = F.concat(F.lit("read these [Attached Context Files: "), "title", F.lit(", nothing.txt] please"))
    asked = docs.select(F.col("doc_id").alias("msg_id"), message.alias("q"))
    names = F.split(F.regexp_extract("q", r"\[Attached Context Files: ([^\]]*)\]", 1), r",\s*")
    asked = asked.select("msg_id", F.explode(names).alias("title"))
    live = docs.filter("not is_trashed").groupBy("title").agg(F.max_by(F.struct("doc_id", "text"), F.struct("created_at", "doc_id")).alias("x"))
    joined = F.array_join(F.slice(F.split("x.text", "\n"), 1, 4), "\n")
    short = F.when(F.length(joined) > 1200, F.concat(F.left(joined, F.lit(1200)), F.lit("..."))).otherwise(joined)
    return asked.join(live, "title").select("msg_id", "title", F.col("x.doc_id").alias("doc_id"), short.alias("context"))


@op("B17", r"SELECT page_id, CASE WHEN contains(t, '.') THEN lower(string_split(t, '.')[-1]) ELSE 'text/html' END AS file_type FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS t FROM pages)")
def b17(spark, d):
    return view(spark, d, "pages").select("page_id", T.file_type(F.regexp_extract("url", "([^/]*)$", 1), F.lit("text/html")).alias("file_type"))


@op("B11", r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 50 AS STRING) || '/2A;' || CAST(l_suppkey AS STRING) || '/2B' AS survey_numbers, CAST(l_linenumber AS STRING) AS cts,
  CASE l_partkey % 4 WHEN 0 THEN CAST(floor(l_quantity) AS BIGINT) * 10000.0 + (l_partkey % 9) * 100.0 WHEN 1 THEN CAST(floor(l_quantity) AS BIGINT) * 101.0 WHEN 2 THEN (l_partkey % 9) * 100.0 END AS area_sqm,
  round(CAST(floor(l_extendedprice) AS BIGINT) * 0.092903, 2) AS built_sqm, CAST(l_suppkey AS DOUBLE) AS open_space_sqm, CASE WHEN l_partkey % 4 = 3 THEN 'Akker 5: unit differs by district, needs review' END AS flag FROM lineitem""")
def b11(spark, d):
    """Register cells made of line items, each with a survey number, areas in one of several units, and open space."""
    from ..functions.cells import parse_cell

    s = lambda c: F.col(c).cast("string")
    q, p9 = F.floor("l_quantity").cast("string"), (F.col("l_partkey") % 9).cast("string")
    kind = F.col("l_partkey") % 4
    area = F.when(kind == 0, F.concat(F.lit("area "), q, F.lit(" ha "), p9, F.lit(" are"))).when(kind == 1, F.concat(F.lit("Area "), q, F.lit(" guntha"))).when(kind == 2, F.concat(F.lit("area "), p9, F.lit(" आर"))).otherwise(F.lit("Akker 5"))
    text = F.concat(F.lit("S.No. "), (F.col("l_partkey") % 50).cast("string"), F.lit("/2A & "), s("l_suppkey"), F.lit("/2B, CTS no. "), s("l_linenumber"), F.lit(", "), area, F.lit(", construction "), F.floor("l_extendedprice").cast("string"), F.lit(" sq.ft, open space "), s("l_suppkey"), F.lit(" sqm"))
    rows = view(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", parse_cell(text).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p.*")


@op("B16", "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN event_type END AS relation, CASE WHEN event_id % 5 < 4 THEN event_id % 100 END AS score FROM events")
def b16(spark, d):
    """Archived replies: plain, fenced, after thoughts, with words around them and a raw line break, or none at all."""
    from ..functions.cells import lenient_json

    body = F.concat(F.lit('{"relation": "'), "event_type", F.lit('", "score": '), (F.col("event_id") % 100).cast("string"))
    kind = F.col("event_id") % 5
    reply = F.when(kind == 0, F.concat(body, F.lit("}"))).when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("}\n```"))).when(kind == 2, F.concat(F.lit("<think>{no}</think> "), body, F.lit("}")))
    reply = reply.when(kind == 3, F.concat(F.lit("The answer is "), body, F.lit(', "why": "a\nb"} as said'))).otherwise(F.lit("no { json"))
    out = view(spark, d, "events").select("event_id", lenient_json(reply, "relation string, score bigint").alias("j"))
    return out.select("event_id", "j.relation", "j.score")
