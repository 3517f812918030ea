"""Small cases of the faults that reviews found, by query."""

import datetime
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from paperlode.functions import cells
from paperlode.operators import blocks, governance, graph, pages, postings, search, tables, vector_index
from paperlode.plans.registry import QUERIES
from paperlode.sources import chunk_store, files
from paperlode.streaming import jobs


def test_a1_json_is_one_value_and_nothing_after_it(spark):
    texts = {"1": True, ' {"a": [1, 2]} ': True, '"x"': True, "null": True, "4537 Thinthen oror": False, "1, 2": False, "1] 2": False, '{"a": 1} x': False, "{": False, " ": False}
    rows = spark.createDataFrame([(t, bytearray(t.encode())) for t in texts], "t string, content binary").withColumn("path", F.lit("a.json"))
    got = {r.t: r.reason is None for r in files.accept(rows).collect()}
    assert got == texts
    shown = spark.createDataFrame([("12 more",), ("[1]",)], "t string").select("t", files.json_page(F.col("t")).alias("p")).collect()
    assert {r.t: r.p.replace("\n", "").replace(" ", "") for r in shown} == {"12 more": "12more", "[1]": "[1]"}


def test_l1_a_batch_is_taken_from_the_state_once(spark, tmp_path):
    """Two readings of the state may choose different documents of one content; both sides must see the same choice."""
    spark.createDataFrame([(1, "same words"), (2, "same words"), (3, "other words")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in").withColumn("file_hash", F.sha2("text", 256))
    seen = []

    def chunks_of(df):
        seen.extend(df.inputFiles())
        return df.select("doc_id", F.col("text").alias("content"))

    chunks = jobs.ingest(stream, str(tmp_path / "out"), chunks_of)
    assert sorted(r.content for r in chunks.collect()) == ["other words", "same words"]
    assert seen and all("/fresh/batch=" in f for f in seen)


def test_d4_texts_are_dealt_once_and_blocks_lose_nothing(spark, monkeypatch):
    """Several blocks of a tenant give what one gives, and a passage is looked at only if it can reach the k-th best."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcd"), rng.integers(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words, n))
    i = spark.createDataFrame([(n, n % 2, text(rng.integers(1, 30))) for n in range(300)], "item_id long, tenant_id long, content string")
    q = spark.createDataFrame([(n, n % 2, text(n % 4)) for n in range(40)], "query_id long, tenant_id long, query string")
    q = q.unionByName(q.selectExpr("query_id + 100 AS query_id", "tenant_id", "upper(query) AS query"))
    rows = lambda: sorted(map(tuple, search.fuzzy_leg(q, i, k=5).select("query_id", "item_id", "score", "rank").collect()))
    one = rows()
    assert {r[0] for r in one} >= {101, 102} and [r[1:] for r in one if r[0] == 1] == [r[1:] for r in one if r[0] == 101]
    monkeypatch.setattr(search, "ITEMS_EACH", 20)
    monkeypatch.setattr(search, "QUERIES_EACH", 3)
    monkeypatch.setattr(search, "PLACES_EACH", 16)
    assert rows() == one


def test_d1_second_round_returns_what_can_still_enter(spark):
    x = np.random.default_rng(5).standard_normal((2000, 16))
    df = spark.createDataFrame([(n, 0, v.tolist()) for n, v in enumerate(x)], "item_id long, tenant_id long, embedding array<double>")
    q = df.filter("item_id % 50 = 0").selectExpr("item_id AS query_id", "0 AS variant", "tenant_id", "embedding")
    index = vector_index.build(df, write=False)
    first = index.score(index.nearby(q.select("query_id", F.col("variant").cast("int").alias("variant"), "tenant_id", vector_index.unit(F.col("embedding")).alias("u")), 0.1), 20).count()
    assert index.search(q, 20).count() - first <= 40 * 20


def test_d3_counts_are_shuffled_once(spark, monkeypatch):
    """Counting the words of dealt items needs no exchange by term."""
    seen = []
    terms = postings.item_terms
    monkeypatch.setattr(postings, "item_terms", lambda items: seen.append(terms(items)) or seen[-1])
    items = spark.createDataFrame([(1, 0, "land of land"), (2, 1, "owner")], "item_id long, tenant_id long, content string")
    table = postings.create(items, buckets=2)
    assert {(r.item_id, r.term, r.tf) for r in table._counts().filter("analyzer = 'simple'").collect()} == {(1, "land", 2), (1, "of", 1), (2, "owner", 1)}
    plan = seen[0].groupBy("item_id", *search.TERM).count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(item_id" in plan


def test_d6_equal_filters_are_looked_up_once(spark, monkeypatch):
    kept, write = {}, search.stage
    monkeypatch.setattr(search, "stage", lambda df, label: kept.setdefault(label, write(df, label)))
    filters = spark.createDataFrame([(q, "doc_type", "fr") for q in range(5)] + [(9, "doc_type", "fr"), (9, "document_id", "2"), (8, "owner", "x"), (8, "doc_type", "fr"), (7, "none", "x")], "query_id long, key string, wanted string")
    docs = spark.createDataFrame([(i, "fr" if i % 2 == 0 else "en") for i in range(6)], "doc_id long, doc_type string")
    metadata = spark.createDataFrame([(4, "owner", '{"v":"x"}')], "doc_id long, key string, value string")
    facts = spark.createDataFrame([(2, "owner", "x"), (3, "owner", "x")], "doc_id long, field_name string, value string")
    got = sorted(map(tuple, search.filtered(filters, docs, metadata, facts).collect()))
    assert got == sorted([(q, i) for q in range(5) for i in (0, 2, 4)] + [(9, 2), (8, 2), (8, 4)])
    assert kept["filters-held"].count() == 3 + 1 + 3  # documents of a type, of an id, of an owner


def test_e3_a_label_meets_few_others_and_loses_none(spark, monkeypatch):
    """All pairs of some hundred labels are compared by brute force; the query scores a part of them."""
    r = np.random.default_rng(7)
    labels = ["".join(r.choice(list("ab "), r.integers(0, 7))) for _ in range(60)] + ["Émil Ωx", "x ωÉ"]
    rows = [(1, "t", f"m{i:04d}", label) for i, label in enumerate(labels)] + [(0, "t", f"n{i:04d}", f"Customer#{100_000 + i:09d}") for i in range(1200)]
    scored = spark.sparkContext.accumulator(0)
    jaccard = blocks.set_jaccard

    def counted(a, b):
        scored.add(len(a) * len(b))
        return jaccard(a, b)

    monkeypatch.setattr(blocks, "set_jaccard", counted)
    got = {tuple(x) for x in graph.similar_labels(spark.createDataFrame(rows, "tenant_id int, entity_type string, node_id string, label string")).collect()}
    grams = {n: frozenset(f"  {w} "[i : i + 3] for w in re.split(r"[\W_]+", label.lower()) if w for i in range(len(w) + 1)) for _, _, n, label in rows}
    want = set()
    for t, e, n, _ in rows:
        s = [(-len(grams[n] & grams[o]) / len(grams[n] | grams[o]), o) for u, _, o, _ in rows if u == t and o != n and grams[n] | grams[o]]
        want |= {(t, e, n, o, round(-x, 4)) for x, o in sorted(s)[:5] if -x >= 0.45}
    assert got == want
    assert scored.value < 1200**2 / 3


def test_e10_rows_without_a_key_pass_by_the_join(spark):
    edges = spark.createDataFrame([(1, "a", "entity", "b", None), (2, "a", "fact", None, 7), (3, "b", "fact", None, 9)], "edge_id long, source_node string, target_type string, target_node string, target_fact long")
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "node_id string, label string")
    facts, docs = spark.createDataFrame([(7, 70)], "fact_id long, doc_id long"), spark.createDataFrame([(70, "t")], "doc_id long, title string")
    view = graph.with_titles(graph.view_360(nodes, edges), facts, docs)
    got = {tuple(r) for r in view.select("node_id", "edge_id", "direction", "other_label", "doc_id", "title").collect()}
    assert got == {("a", 1, "outgoing", "B", None, None), ("b", 1, "incoming", "A", None, None), ("a", 2, "outgoing", None, 70, "t"), ("b", 3, "outgoing", None, None, None)}
    plan = view._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(target_fact" in plan and "isnotnull(target_fact" in plan


def test_b11_a_cell_is_tidied_once(spark):
    df = spark.createDataFrame([("S.No. 7/2A & 8, area 2 ha 3 are, construction 10 sq.ft",)], "t string").select(cells.parse_cell(F.col("t")).alias("p"))
    assert tuple(df.first().p)[:5] == ("7/2A;8", None, 20300.0, 0.93, None)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_l2_states_come_with_the_rows_of_many_paths(spark, tmp_path):
    schema = "path string, poll_no long, size long, mtime timestamp, poll_ts timestamp"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    plan = jobs.stability_guard(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))._jdf.queryExecution().logical().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan


def test_l3_rows_of_a_tenant_stream_through_its_task(spark, tmp_path, monkeypatch):
    """The rows of a batch are sorted and chained by the batch operator, which keeps a hash and no rows."""
    called = []
    monkeypatch.setattr(jobs, "build_chain", lambda rows, last: called.append(1) or governance.build_chain(rows, last))
    rows = spark.range(50).selectExpr("id", "0L AS tenant_id", "timestamp_seconds(1000 - id) AS created_at", "'x' AS payload")
    rows.write.parquet(f"{tmp_path}/in")
    chain, late = jobs.audit_chain(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/out")
    assert called and chain.count() == 50 and late.count() == 0


def test_fuzzy_blocks_sum_only_passages_around_strong_words():
    r = random.Random(3)
    words = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 7))) for _ in range(60)] + ["aaaaaa", "\U00010330x"]
    items = [[r.choice(words) for _ in range(r.randrange(0, 12))] for _ in range(40)]
    block = search.Passages(items)
    grams = lambda ws: {g for w in ws for g in search.word_grams(w)}
    for m in (1, 2, 3, 5):
        for threshold in (0.3, 0.6):
            q = [r.choice(words) for _ in range(m)]
            want = {}
            for i, ws in enumerate(items):
                for at in range(max(1, len(ws) - m + 1)):
                    g = grams(ws[at : at + m])
                    s = len(g & grams(q)) / len(g | grams(q))
                    if ws and s > threshold:
                        want[i] = max(want.get(i, 0), s)
            got = block.above(frozenset(grams(q)), m, threshold, len(items))
            assert {i: round(s, 9) for i, s in got.items()} == {i: round(s, 9) for i, s in want.items()}
    # a word that begins two passages of three words puts no more than six places before the sums
    assert len(block._around(np.array([0]), 3)) <= 3 * sum(w == items[next(i for i, x in enumerate(items) if x)][0] for x in items for w in x)
    assert not block.marked.any()


def test_b6_sorts_pages_and_chunks_not_words(spark):
    said = spark.createDataFrame([(1, 1, "a b a c", False), (1, 2, "d a D", False), (1, 3, "z", True), (2, 1, " ".join(f"w{i}" for i in range(30)), False), (2, 2, None, False), (3, 1, "..", False), (None, 1, "n", False), (4, 1, "x y", False)], "doc_id long, page_number long, text string, extraction_failed boolean")
    kept = spark.createDataFrame([(1, "A c"), (1, None), (4, "y"), (4, "x"), (None, "n"), (9, "k")], "doc_id long, content string")
    got = pages.data_loss(said, kept)
    assert {tuple(x) for x in got.collect()} == {(1, 7, 3, 0.428571, False, "b d d"), (2, 30, 30, 1.0, False, " ".join(f"w{i}" for i in range(20))), (None, 1, 1, 1.0, True, "n"), (4, 2, 0, 0.0, True, "")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" in plan and "Generate" not in plan  # no row for each word


def _mail(n, *parts):
    lines = [f"Subject: {n}", "MIME-Version: 1.0", "Content-Type: multipart/mixed; boundary=B", ""]
    for name, text in parts:
        lines += ["--B", f"Content-Disposition: attachment; filename={name}", "", text]
    return bytearray("\n".join([*lines, "--B--", ""]).encode())


def test_a12_a_digest_stands_for_content_and_mails_are_parsed_once(spark, tmp_path):
    rows = [(1, _mail(1, ("a.txt", "one"), ("b.txt", "two"))), (2, _mail(2, ("a.txt", "one"))), (3, None), (4, _mail(4))]
    mails = spark.createDataFrame(rows, "mail_id long, raw binary")
    whole = [(r.mail_id, r.name, r.content and hashlib.sha256(r.content).hexdigest(), r.error) for r in files.attachments(mails).collect()]
    assert sorted(map(tuple, files.attachments(mails, digest=True).collect())) == sorted(whole)
    assert sorted(r[:2] for r in whole if r[1]) == [(1, "a.txt"), (1, "b.txt"), (2, "a.txt")] and [r[3] for r in whole if r[0] == 3] == ["TypeError"]
    # one content in many mails, two with one id, of which one has no id: one part is taken
    docs = [(1, "same"), (1, "same"), (4, "same"), (None, "same"), (2, "stored"), (8, "stored")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["A12"](spark, str(tmp_path))
    assert "MapIn" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.mail_id: (r.processed, r.ingested, r.skipped) for r in out.collect()} == {1: (2, 1, 1), 4: (2, 0, 2), None: (1, 0, 1), 2: (1, 0, 1), 8: (2, 0, 2)}


def test_a15_no_text_is_written_but_as_chunks(spark, monkeypatch):
    staged, write = [], chunk_store.stage
    monkeypatch.setattr(chunk_store, "stage", lambda df, label: staged.append(df.columns) or write(df, label))
    of = lambda ids, text: spark.createDataFrame([(i, p, f"{text} {i} {p}", False) for i in ids for p in (1, 2)], "doc_id long, page_number long, text string, extraction_failed boolean")
    store = chunk_store.create(spark, buckets=4)
    for ids, text in ((range(40), "old"), (range(0, 40, 2), "new")):
        store.reingest(of(ids, text), lambda df: pages.chunk(df, 4, 1))
    assert {(r.doc_id, r.content) for r in store.chunks().collect()} == {(i, f"{'old' if i % 2 else 'new'} {i} {p}") for i in range(40) for p in (1, 2)}
    assert staged and not any({"text", "content"} & {*c} for c in staged)
    assert store.states().filter("status = 'indexed'").count() == 40


def test_c12_eras_and_fields_need_no_sort_of_their_own(spark):
    rows = [(1, 0, 1, n, s, o, v) for n, (s, o, v) in enumerate([("1", "A", "x"), (None, "do", "x"), ("2", "do", "y"), ("3", None, "y"), (None, "do", ",,"), ("4", "B", ""), ("5", "do", "y"), ("6", "do", "x")])]
    df = spark.createDataFrame(rows, "doc_id long, segment long, page_number long, pos long, serial string, owner string, village string")
    out = tables.expand_dittos(df, ["owner"], anchor="village")
    assert [(r.owner, r.owner_inherited, r.owner_unresolved) for r in out.orderBy("pos").collect()] == [("A", False, False), ("A", True, False), ("do", False, True), (None, False, False), (None, True, False), ("B", False, False), ("B", True, False), ("do", False, True)]
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan(out).split("Initial Plan")[-1])) == 1
    sets = tables.field_sets(df, ["serial", "owner", "village"])
    assert "SortAggregate" not in plan(sets) and [list(r.fields) for r in sets.collect()] == [["owner", "serial", "village"]]


def test_c19_rows_are_dealt_once_and_repeats_count_once(spark):
    rows = [(1, 0, 1, n, str(n) if n % 2 == 0 else None, f"o{n}", 0.5, False, 0.1, 0.2) for n in range(6)]
    df = spark.createDataFrame(rows + rows[1:4], "doc_id long, segment long, page_number long, pos long, serial string, owner string, confidence double, is_handwritten boolean, y0 double, y1 double")
    out = tables.facts_of(df, ["owner"], ["owner"])
    assert sorted((r.pos, r.value, r.source_index, len(r.regions), r.confidence) for r in out.collect()) == [(n, f'{{"v":"o{n} o{n + 1}"}}', f"1:{n},1:{n + 1}", 2, 0.5) for n in (0, 2, 4)]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_d3_terms_are_counted_and_met_inside_blocks(spark, monkeypatch):
    """No row for each word, and none for each item of a frequent term: a block gives the k best of a query."""
    monkeypatch.setattr(search, "item_terms", None)
    monkeypatch.setattr(search, "ITEMS_EACH", 40)
    r = random.Random(5)
    words = ["the", "of", "owners", "owned", "landing", "deeds", "bases", "Émile"]
    items = [(n, n % 2, " ".join(r.choice(words) for _ in range(r.randrange(0, 9)))) for n in range(120)] + [(500, 0, None)]
    queries = [(n, n % 2, " ".join(r.sample(words, n % 4))) for n in range(24)] + [(90, 0, None), (91, 1, "none of")]
    got = search.keyword_leg(spark.createDataFrame(queries, "query_id long, tenant_id long, query string"), spark.createDataFrame(items, "item_id long, tenant_id long, content string"), k=3)
    forms = {"simple": lambda ws: ws, "english": lambda ws: [search.stemmed(w) for w in ws if w not in search.STOP]}
    want = set()
    for q, t, text in queries:
        best = {}
        for form in forms.values():
            asked = set(form((text or "").lower().split()))
            for i, u, content in items:
                held = form((content or "").lower().split())
                if asked and t == u and asked <= set(held):
                    best[i] = max(best.get(i, 0), round(sum(1 + np.log(held.count(a)) for a in asked), 6))
        want |= {(q, i, s, n) for n, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:3])}
    assert {(x.query_id, x.item_id, -x.score, x["rank"]) for x in got.collect()} == want and len(want) > 30
    stems = spark.createDataFrame([(w,) for w in words], "w string").select("w", search.stem(F.col("w")).alias("s")).collect()
    assert all(search.stemmed(x.w) == x.s for x in stems)


def test_d4_frequent_words_are_left_aside():
    """A passage like "ouwhea the of" has a word like the rare one: those around "the" alone need no look."""
    items = [["the", "b", "the", "c", "of", "d"] * 50, ["x", "ouwhea", "the", "y"], ["ouwheb", "the", "of"]] * 20
    block, asked = search.Passages(items), ["ouwhea", "the", "of"]
    grams = frozenset(g for w in asked for g in search.word_grams(w))
    shared = np.array([sum(g in grams for g in set(search.word_grams(w))) for w in block.words])
    worth = (shared - 0.6 / 3 * (block.sizes - shared)).astype(np.float32)
    led = [block.words[i] for i in block._leading(worth, 0.6 * len(grams), 3)]
    assert "ouwhea" in led and "the" not in led
    assert sorted(block.above(grams, 3, 0.6, 60)) == [i for i in range(60) if i % 3]


def test_d7_raw_queries_and_words_are_shared(spark, monkeypatch):
    """The keyword and fuzzy legs, and a second run, take the words of the items from one table."""
    dealt, deal = [], search.deal
    monkeypatch.setattr(search, "deal", lambda items: dealt.append(1) or deal(items))
    i = spark.createDataFrame([(1, 0, "land of land"), (2, 0, "owner of it")], "item_id long, tenant_id long, content string")
    q = spark.createDataFrame([(5, 0, "land"), (6, 0, "LAND")], "query_id long, tenant_id long, query string")
    table = search.deal(i)
    assert sorted(r.query_id for r in search.keyword_leg(q, table).collect()) == sorted(r.query_id for r in search.fuzzy_leg(q, table).collect()) == [5, 6]
    assert len(dealt) == 1


def test_l3_the_chain_goes_by_the_ordinal_over_all_files(spark, tmp_path):
    """Many files in any order, times that repeat, and ids whose ordinals have seven and eight digits."""
    ids = [0, 5, 8_999_999, 9_000_000, 9_000_001, 20, 99_000_000, 7, 3, 9_500_000] + list(range(100, 130))
    rows = [(i, datetime.datetime(2024, 1, 1 + n % 3), 4 * (n % 2), "view", 1.0, f"p{i}") for n, i in enumerate(ids)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for n, row in enumerate(reversed(rows)):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {r.id: (r.previous_hash, r.event_hash) for r in QUERIES["L3"](spark, str(tmp_path)).collect()}
    last, want = hashlib.sha256(b"genesis:0").hexdigest(), {}
    for i, _, user, action, _, props in sorted(rows, key=lambda r: (str(r[0] + 1000000), r[0])):
        want[i] = last, hashlib.sha256(f"{last}{user}|{action}|{props}".encode()).hexdigest()
        last = want[i][1]
    assert got == want


def test_l3_a_large_tenant_is_one_task_after_a_join(spark):
    """A join by tenant may split a large tenant between tasks, so the rows are dealt again behind it."""
    rows = spark.range(40).selectExpr("id % 2 AS tenant_id", "cast(id + 100 AS string) AS ordinal", "id", "concat('p', id) AS payload")
    joined = rows.join(rows.select("tenant_id").distinct().hint("merge"), "tenant_id")
    chain = governance.build_chain(joined)
    assert "REPARTITION_BY_NUM" in chain._jdf.queryExecution().executedPlan().toString()
    assert len({r.previous_hash for r in chain.collect()} - {r.event_hash for r in chain.collect()}) == 2


def test_h15_values_are_added_in_the_order_of_ids(spark, tmp_path):
    """0.1 ten times comes to less than 1, and the order decides what large values swallow, whatever file a row is in."""
    values = {1: [0.1] * 10, 2: [2.0**53, 1.0, 1.0, -(2.0**53), 3.0], 3: [None], 4: [None, 2.5, None]}
    rows = [(100 * u + n, datetime.datetime(2024, 1, 1), u, "view", v, "") for u, vs in values.items() for n, v in enumerate(vs)]
    for part in (rows[1::2], rows[::2]):
        spark.createDataFrame(part, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {r.tenant_id: (r.docs, r.bytes) for r in QUERIES["H15"](spark, str(tmp_path)).collect()}
    assert got == {1: (20, 0), 2: (10, 3_000_000), 3: (2, None), 4: (6, 2_000_000)}


def test_e1_a_vector_travels_once_to_a_group_of_lists(spark, monkeypatch):
    """Searches by threshold find what a search list by list finds, and send a query to groups instead of lists."""
    monkeypatch.setattr(vector_index, "GROUP", 4)
    monkeypatch.setattr(vector_index, "GROUP_QUERIES", 100)
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 40)
    r = np.random.default_rng(9)
    x = r.standard_normal((60, 6))[r.integers(0, 60, 500)] + 0.15 * r.standard_normal((500, 6))
    rows = [(n, n % 2, n if n % 7 else None, v.tolist()) for n, v in enumerate(x)]
    index = vector_index.build(spark.createDataFrame(rows, "item_id long, tenant_id long, first long, embedding array<double>"), lists=11, write=False)
    asking = index.items.select(F.col("item_id").alias("query_id"), F.lit(0).alias("variant"), "tenant_id", "u")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {q: sorted((-round(s[q, i], 6), i) for i in range(500) if i % 2 == q % 2 and i % 7 and s[q, i] >= 0.92)[:5] for q in range(500)}
    got = {q: [] for q in range(500)}
    for h in index.near(asking, 5, 0.92).collect():
        got[h.query_id].append((-round(h.s, 6), h.item_id))
    assert {q: sorted(h)[:5] for q, h in got.items()} == want and max(map(len, want.values())) == 5
