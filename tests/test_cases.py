"""Small worked cases of the operators' harder rules."""

import hashlib

import pytest
from pyspark.sql import functions as F

from paperlode.functions import cells, text
from paperlode.operators import analytics, blocks, facts, folders, governance, graph, pages, records, search, staging, tables
from paperlode.plans import views
from paperlode.sources import files


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_words_keep_marks_and_accents(spark):
    assert one(spark, text.words(F.lit("Hello, World! 123."))) == ["hello", "world", "123"]
    assert one(spark, text.words(F.lit("गाव मौजे Élan"))) == ["गाव", "मौजे", "élan"]


@pytest.mark.parametrize("value,want", [("Do.", True), ("DO", True), ("do.", True), (",,", True), ("-do-", True), ("done", False), ("", False), (None, False)])
def test_ditto_marks(spark, value, want):
    assert one(spark, text.is_ditto(F.lit(value).cast("string"))) is want


@pytest.mark.parametrize("q,want", [("score >= 85", 0.85), ("anything > 80%", 0.8), ("score at least 0.9", 0.9), ("no number", None)])
def test_score_threshold(spark, q, want):
    assert one(spark, text.score_threshold(F.lit(q))) == want


def test_phrase_with_a_capital_never_matches(spark):
    assert one(spark, text.unsafe_phrase(F.lit("forget what I said"))) is None
    assert one(spark, text.unsafe_phrase(F.lit("JAILBREAK it"))) == "jailbreak"


def test_snippet(spark):
    assert one(spark, text.snippet(F.lit("aa bb cc"), 400)) == "aa bb cc"
    assert one(spark, text.snippet(F.lit("aa bb cc dd"), 7)) == "aa bb…"


def test_register_cell(spark):
    cell = "S.No. 121/2A & 121/2B, CTS no. 88, area 1 ha 25 are, construction 4500 sq.ft, open space 300 sqm, Akker 5"
    x = one(spark, cells.parse_cell(F.lit(cell)))
    assert (x.survey_numbers, x.cts, x.area_sqm, x.built_sqm, x.open_space_sqm) == ("121/2A;121/2B", "88", 12500.0, 418.06, 300.0)
    assert x.flag.startswith("Akker 5")
    assert one(spark, cells.parse_cell(F.lit("S.No. 45, area 2 आर"))).area_sqm == 200.0


def test_reply_with_control_characters_or_none(spark):
    x = one(spark, cells.lenient_json(F.lit('so: {"relation": "vertical", "score": 3, "w": "a\tb"} ok'), "relation string, score bigint"))
    assert (x.relation, x.score) == ("vertical", 3)
    assert one(spark, cells.lenient_json(F.lit("none"), "relation string, score bigint")) is None


REG = "doc_id long, segment long, page_number long, pos long, no string, khatedar string, village string"


def expand(spark, rows, columns, anchor=None):
    df = frame(spark, [(1, 1, 1, i, str(20 + i), *r) for i, r in enumerate(rows, 1)], REG)
    return sorted(tables.expand_dittos(df, columns, anchor).collect(), key=lambda r: r.pos)


def test_ditto_chains(spark):
    got = expand(spark, [("A", "K"), (",,", "K"), ("Do.", "Kalamnuri"), ("B", ",,")], ["khatedar", "village"])
    assert [r.khatedar for r in got] == ["A", "A", "A", "B"] and got[3].village == "Kalamnuri"


def test_null_in_a_chain_is_inherited(spark):
    assert [r.khatedar for r in expand(spark, [("A", "v"), (None, "v"), ("Do.", "v")], ["khatedar"])] == ["A", None, None]


def test_unresolved_ditto_keeps_its_mark(spark):
    r = expand(spark, [(",,", "v")], ["khatedar"])[0]
    assert (r.khatedar, r.khatedar_inherited, r.khatedar_unresolved) == (",,", False, True)


def test_anchor_ends_chains(spark):
    got = expand(spark, [("A", "x"), (",,", "x"), (",,", "y"), (",,", "y")], ["khatedar"], anchor="village")
    assert [r.khatedar_unresolved for r in got] == [False, False, True, True]


def test_continuations(spark):
    schema = "doc_id long, segment long, page_number long, pos long, serial string, description string"
    rows = [(1, 1, 1, 1, "47", "field "), (1, 1, 1, 2, " ", "near river"), (1, 1, 1, 3, "48", "well"), (1, 2, 2, 1, None, "lost"), (1, 2, 2, 2, "50", "hill")]
    got = sorted(tables.merge_continuations(frame(spark, rows, schema), ["description"]).collect(), key=lambda r: (r.segment, r.pos))
    assert [(r.segment, r.serial, r.description, r.source_rows, r.unmerged) for r in got] == [(1, "47", "field near river", 2, False), (1, "48", "well", 1, False), (2, None, "lost", 1, True), (2, "50", "hill", 1, True)]


def test_facts_of_a_table_over_two_pages(spark):
    schema = "doc_id long, segment long, page_number long, pos long, serial string, owner string, area string, confidence double, is_handwritten boolean, y0 double, y1 double"
    rows = [
        (1, 1, 1, 8, "47", "Anna", "12", 0.9, False, 0.8, 0.9), (1, 1, 2, 1, None, "Rao", " ", 0.7, True, 0.0, 0.1), (1, 1, 2, 1, None, "Rao", " ", 0.7, True, 0.0, 0.1),
        (1, 1, 2, 2, "48", "Do.", "5", None, False, 0.2, 0.3), (1, 1, 2, 3, "49", "Bo", "7", 0.95, False, 0.9, 1.2), (2, 1, 1, 1, "1", ",,", None, 0.99, False, 0.1, 0.2),
    ]
    got = {(r.doc_id, r.page_number, r.pos, r.field): r for r in tables.facts_of(frame(spark, rows, schema), ["owner", "area"], ["owner"]).collect()}
    stitched = got[1, 1, 8, "owner"]
    assert (stitched.value, [tuple(x) for x in stitched.regions], round(stitched.confidence, 6), stitched.is_handwritten, stitched.status, stitched.source_index) == ('{"v":"Anna Rao"}', [(1, 0.8, 0.9), (2, 0.0, 0.1)], 0.8, True, "in_review", "1:8,2:1")
    assert [tuple(x) for x in got[1, 1, 8, "area"].regions] == [(1, 0.8, 0.9)] and got[1, 1, 8, "area"].status == "machine"
    assert (got[1, 2, 2, "owner"].value, got[1, 2, 2, "owner"].confidence, got[1, 2, 2, "owner"].status) == ('{"v":"Rao"}', None, "in_review")
    assert got[2, 1, 1, "owner"].value == '{"v":",,","unresolved_ditto":true}' and got[2, 1, 1, "owner"].status == "in_review"
    assert (1, 2, 3, "owner") not in got and (2, 1, 1, "area") not in got


def test_relations_of_pages(spark):
    sets = [(1, 1, ["a", "b"]), (1, 2, ["a", "b"]), (1, 3, []), (2, 1, ["a", "b"]), (2, 2, ["c", "d"]), (3, 1, ["a", "b", "c"]), (3, 2, ["a", "d"])]
    got = {(r.doc_id, r.page_number): r.relation for r in tables.page_pairs(frame(spark, sets, "doc_id long, page_number long, fields array<string>"), 5).collect()}
    assert got == {(1, 2): "vertical", (1, 3): "vertical", (2, 2): "horizontal", (3, 2): "ambiguous"}
    assert one(spark, tables.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0


def test_spread_join(spark):
    schema = "pair long, pos long, no string, a string, b string"
    left = frame(spark, [(1, 1, "12", "x", None), (1, 2, "13", "y", None), (2, 1, "12", "p", None), (2, 2, "13", "q", None), (2, 3, "13", "q2", None)], schema)
    right = frame(spark, [(1, 1, "12", None, "s"), (1, 2, "13", "Y", "t"), (2, 1, "12", None, "u")], schema)
    merged, bad = tables.spread_join(left, right, ["pair"], "no", ["a", "b"])
    assert {(r.no, r.a, r.b) for r in merged.collect()} == {("12", "x", "s"), ("13", "Y", "t")}
    assert [tuple(r) for r in bad.collect()] == [(2, "13", "")]


def test_match_by_key(spark):
    rows = lambda ks: frame(spark, [(1, i, k) for i, k in enumerate(ks)], "pair long, pos long, k string")
    got = {(r.left_pos, r.right_pos) for r in tables.match_by_key(rows(["1", "2", "2", ""]), rows(["1", "3", "2", "2", None]), ["pair"], "k").collect()}
    assert got == {(0, 0), (2, 2), (2, 3), (3, None), (None, 1), (None, 4)}


@pytest.mark.parametrize("left,right,want", [
    ([(0, 1), (1, 2)], [(0.2, 0.8), (1.2, 1.8)], {(0, 0), (1, 1)}), ([(0, 2)], [(0, 1), (1, 1.9)], {(0, 0), (0, 1)}), ([(None, None)], [(0, 1)], set()), ([(0, 1)], [(0.2, 0.8), (5, 6)], set()),
])
def test_containment(spark, left, right, want):
    rows = lambda bs: frame(spark, [(1, i, *b) for i, b in enumerate(bs)], "pair long, pos long, y0 double, y1 double")
    assert {(r.left_pos, r.right_pos) for r in tables.pair_by_position(rows([tuple(None if v is None else float(v) for v in b) for b in left]), rows([tuple(float(v) for v in b) for b in right]), ["pair"]).collect()} == want


@pytest.mark.parametrize("c,hand,want", [(None, False, "in_review"), (0.9, False, "machine"), (0.9, True, "in_review"), (0.85, False, "machine"), (0.84, False, "in_review")])
def test_confidence_status(spark, c, hand, want):
    assert one(spark, facts.classify(F.lit(c).cast("double"), F.lit(hand))) == want


def test_furniture(spark):
    rows = [(1, p, f"Head  Line\nbody {p} text\nmore {p}", False) for p in (1, 2, 3)] + [(2, 1, "Rare\nx y z\nend", False), (2, 2, "Rare\nx y z w\nend2", False)]
    got = pages.furniture(frame(spark, rows, "doc_id long, page_number long, text string, extraction_failed boolean")).collect()
    assert [(r.doc_id, r.line, r.occurrences, r.pages, r.zone) for r in got] == [(1, "head line", 3, "1,2,3", "top")]


def test_data_loss(spark):
    pg = frame(spark, [(1, 1, " ".join(f"w{i}" for i in range(501)), False), (2, 1, "a b c d e f", False), (3, 1, "gone", True)], "doc_id long, page_number long, text string, extraction_failed boolean")
    ch = frame(spark, [(1, " ".join(f"w{i}" for i in range(500))), (2, "a b")], "doc_id long, content string")
    got = {r.doc_id: (r.missing, r.passed, r.sample) for r in pages.data_loss(pg, ch).collect()}
    assert got == {1: (1, True, "w500"), 2: (4, False, "c d e f")}


def test_best_engine(spark):
    rows = [(1, 1, "a", 10, 2, 0.1, False), (1, 1, "b", 10, 2, 0.3, False), (1, 1, "c", 10, 9, 0.0, True), (2, 1, "a", 10, 2, 0.1, True)]
    df = frame(spark, rows, "doc_id long, page_number long, engine string, n_chars long, row_like long, devanagari double, degenerate boolean")
    assert {r.doc_id: r.engine for r in pages.recommend_engine(df).collect()} == {1: "b", 2: None}


def test_windows_of_tokens(spark):
    df = frame(spark, [(1, 1, " ".join(map(str, range(10)))), (1, 2, "  "), (1, 3, "x")], "doc_id long, page_number long, text string")
    got = sorted(tuple(r) for r in pages.chunk(df, 6, 2).collect())
    assert got == [(1, 1, 0, 6, "0 1 2 3 4 5"), (1, 1, 1, 6, "4 5 6 7 8 9"), (1, 3, 2, 1, "x")]


def test_glossary(spark):
    g = frame(spark, [("waqf", "waqf"), ("wakf", "waqf"), ("survey no", "s"), ("survey number", "s")], "term string, canonical_key string")
    q = frame(spark, [(1, "Waqf land"), (2, "survey no 5"), (3, "nothing"), (4, "one")], "query_id long, query string")
    assert {r.query_id: r.expansions for r in search.expand(q, g).collect()} == {1: "wakf", 2: "survey number"}


def test_fuzzy_leg_finds_a_misspelling(spark):
    q = frame(spark, [(1, 1, "Depshmukh")], "query_id long, tenant_id long, query string")
    i = frame(spark, [(10, 1, "land of Deshmukh"), (11, 2, "Deshmukh"), (12, 1, "other words")], "item_id long, tenant_id long, content string")
    assert [r.item_id for r in search.fuzzy_leg(q, i).collect()] == [10]


def test_fuzzy_leg_scores_passages(spark):
    import random

    r = random.Random(2)
    grams = lambda ws: {f"  {w} "[j : j + 3] for w in ws for j in range(len(w) + 1)}
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 6)))
    q = [(k, k % 2, " ".join(word() for _ in range(1 + k % 4))) for k in range(12)] + [(99, 0, "")]
    i = [(k, k % 2, " ".join(word() for _ in range(r.randrange(0, 25)))) for k in range(40)]
    want = set()
    for a, t, said in q:
        m, g = len(said.split()), grams(said.split())
        hits = []
        for b, u, text in i if m else []:
            w = text.split()
            s = max(len(grams(x) & g) / len(grams(x) | g) for x in (w[k : k + m] for k in range(max(len(w) - m, 0) + 1)))
            if t == u and s > 0.3:
                hits.append((-round(s, 6), b))
        want |= {(a, b, -s, k) for k, (s, b) in enumerate(sorted(hits)[:20])}
    got = search.fuzzy_leg(frame(spark, q, "query_id long, tenant_id long, query string"), frame(spark, i, "item_id long, tenant_id long, content string")).collect()
    assert {(x.query_id, x.item_id, x.score, x["rank"]) for x in got} == want and len(want) > 50


def test_many_queries_meet_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 2)
    q = frame(spark, [(i, i % 2) for i in range(9)], "query_id long, tenant_id long")
    i = frame(spark, [(k, k % 2) for k in range(30)], "item_id long, tenant_id long")
    assert sorted((x.query_id, x.item_id) for x in search.met(i, q).collect()) == [(a, b) for a in range(9) for b in range(30) if a % 2 == b % 2]


def test_metadata_forms(spark):
    forms = ['{"v":"en"}', '{"lang":"en"}', "en", '["en","x"]', '{"v":"fr"}', "english", None]
    df = frame(spark, [(i, "lang", f, "en") for i, f in enumerate(forms)], "i long, key string, value string, wanted string")
    got = {r.i: r.x for r in df.select("i", F.coalesce(F.array_contains(search.metadata_values(F.col("key"), F.col("value")), F.col("wanted")), F.lit(False)).alias("x")).collect()}
    assert [got[i] for i in range(7)] == [True, True, True, True, False, False, False]


def test_structured_leg_reads_no_wildcards(spark):
    q = frame(spark, [(1, 1, "%"), (2, 1, "42/1b")], "query_id long, tenant_id long, raw string")
    f = frame(spark, [(1, 5, "survey_no", "42/1B-Kolhapur", None), (1, 6, "_marginalia", "42/1B", 0.9)], "tenant_id long, fact_id long, field_name string, value string, confidence double")
    assert [(r.query_id, r.item_id) for r in search.structured_leg(q, f).collect()] == [(2, 5)]


def test_similar_labels_stay_within_a_type(spark):
    n = frame(spark, [("a", 1, "person", "Abdul Karim"), ("b", 1, "person", "Abdul Karin"), ("c", 1, "trust", "Abdul Karim"), ("d", 1, "person", "Zoe")], "node_id string, tenant_id long, entity_type string, label string")
    assert {(r.node_id, r.other_id) for r in graph.similar_labels(n).collect()} == {("a", "b"), ("b", "a")}


def test_claims_fold_in_order(spark):
    rows = [(1, 1, 7, "claim"), (1, 2, 8, "claim"), (1, 3, 8, "release"), (1, 4, 7, "release"), (1, 5, 8, "claim")]
    got = facts.fold_claims(frame(spark, rows, "fact_id long, acted long, user_id long, kind string")).first()
    assert (got.holder, got.conflicts) == (8, 2)


def test_edits_preview_apply(spark):
    f = frame(spark, [(1, "a", "verified", False), (2, "b", "in_review", False)], "fact_id long, value string, status string, is_handwritten boolean")
    p = facts.preview_edits(f, frame(spark, [(1, "z"), (2, "b"), (9, "q")], "fact_id long, new_value string"))
    assert {r.fact_id: r.outcome for r in p.collect()} == {1: "changed", 2: "no_op", 9: "not_found"}
    assert {(r.fact_id, r.value, r.status) for r in facts.apply_edits(f, p).collect()} == {(1, "z", "in_review"), (2, "b", "in_review")}


def test_replay_does_not_depend_on_row_order(spark):
    base = frame(spark, [(1, "value", "1000")], "record_id long, field string, value string")
    rows = [(5, 1, "2020-01-02", 2, "value", "7"), (6, 1, "2020-01-02", 3, "value", "1000000"), (7, 1, "2019-01-01", 9, "note", "x")]
    make = lambda rs: frame(spark, rs, "amendment_id long, record_id long, effective_date string, created_order long, field string, value string").withColumn("effective_date", F.to_date("effective_date"))
    a, b = (sorted(map(tuple, records.replay(base, make(r)).collect())) for r in (rows, rows[::-1]))
    assert a == b == [(1, "note", "x", "amendment 7"), (1, "value", "1000000", "amendment 6")]


@pytest.mark.parametrize("harm,reason,first", [(None, None, None), ("alter", "altered", 3), ("delete", "broken_link", 4), ("swap", "broken_link", 4)])
def test_chain_shows_tampering(spark, harm, reason, first):
    rows = frame(spark, [(i, 1, f"{i:04d}", f"p{i}") for i in range(1, 7)], "id long, tenant_id long, ordinal string, payload string")
    chain = governance.build_chain(rows).toPandas().sort_values("id")
    assert chain.previous_hash.iloc[0] == hashlib.sha256(b"genesis:1").hexdigest()
    if harm == "alter":
        chain.loc[chain.id == 3, "payload"] = "other"
    if harm == "delete":
        chain = chain[chain.id != 3]
    if harm == "swap":
        chain["ordinal"] = chain["ordinal"].replace({"0003": "0004", "0004": "0003"})
    got = governance.verify_chain(spark.createDataFrame(chain)).first()
    assert (got.reason, got.first_bad) == (reason, first)


@pytest.mark.parametrize("plan,status,ends,docs,want", [("trial", "trialing", "2024-03-01", 1, "allowed"), ("trial", "trialing", "2024-03-01", 100, "document_limit"), ("trial", "trialing", "2024-01-01", 1, "expired"), ("starter", "active", "2020-01-01", 1, "allowed"), ("enterprise", "canceled", None, 1, "canceled")])
def test_metering(spark, plan, status, ends, docs, want):
    u = frame(spark, [(1, plan, status, ends, docs, 5)], "tenant_id long, plan_key string, status string, trial_ends_at string, docs long, bytes long").withColumn("trial_ends_at", F.to_date("trial_ends_at"))
    assert governance.meter(u, spark.sql(views.VIEWS["v_plans"]), views.AS_OF).first().decision == want


def test_events_need_an_actor_and_carry_their_policy(spark):
    rows = [(1, 7, '{"k": 1}', "p2"), (2, None, '{"k": 2}', "p2"), (3, 7, "{}", "p2"), (4, 7, None, "p2"), (5, 7, '{"k": 3}', None)]
    ok, bad = governance.admit_events(frame(spark, rows, "id long, actor_id long, details string, policy_version string"))
    assert {r.id: r.details for r in ok.collect()} == {1: '{"k": 1, "policy_version": "p2"}', 3: '{"policy_version": "p2"}', 4: '{"policy_version": "p2"}', 5: '{"k": 3}'}
    assert [(r.id, r.reason) for r in bad.collect()] == [(2, "actor")]


def test_percentiles_by_nearest_rank(spark):
    x = [5.0, 1.0, 3.0, 2.0, 4.0]
    got = analytics.nearest_rank(frame(spark, [(v,) for v in x], "v0 double").withColumnRenamed("v0", "value"), "value", {"p50": 0.5, "p95": 0.95}).first()
    assert (got["min"], got.p50, got.p95, got["max"], got["mean"]) == (1.0, 3.0, 5.0, 5.0, 3.0)


def test_file_source_and_text_fallback(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes(b"\xe9")
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.csv").write_bytes(b"123456789")
    (tmp_path / "in" / "f.json").write_bytes(b'{"a":1}')
    (tmp_path / "in" / "g.json").write_bytes(b'{"a":')
    df = files.read_files(spark, f"file://{tmp_path}", max_bytes=8)
    got = {r.path[-6:]: r for r in df.withColumn("t", files.decode_text(F.col("content"))).collect()}
    assert (got["/c.exe"].reason, got["/d.csv"].reason, got["/a.txt"].reason) == ("type", "size", None)
    assert (got["/a.txt"].t, got["/b.txt"].t, got["f.json"].reason, got["g.json"].reason) == ("é", "é", None, "json")
    assert got["/a.txt"].file_hash == hashlib.sha256("é".encode()).hexdigest() and got["g.json"].file_hash is None
    assert {(r.reason, r.files, r.bytes) for r in files.outcome_counts(df).collect()} == {(None, 3, 10), ("type", 1, 1), ("size", 1, 9), ("json", 1, 5)}


def test_unreadable_file_is_a_row_of_its_own(spark):
    df = frame(spark, [("a.txt", None), ("b.txt", bytearray(b"x")), ("c.txt", bytearray())], "path string, content binary")
    assert {(r.path, r.reason, r.length) for r in files.accept(df).collect()} == {("a.txt", "unreadable", None), ("b.txt", None, 1), ("c.txt", "empty", 0)}


def test_sectioned_csv_digests_are_those_of_the_lines(spark, tmp_path):
    facts = frame(spark, [("n1", 2, 'said "so"', None), ("n1", 1, "a,b", 5), ("n2", 3, "two\nlines", 6)], "node string, id long, value string, n long")
    links = frame(spark, [("n1", 9, "held")], "node string, id long, status string")
    lines = files.sectioned_csv(frame(spark, [("n1",), ("n2",), ("n3",)], "node string"), "node", {"facts": (facts, ["id", "value", "n"], "id"), "links": (links, ["id", "status"], "id")})
    got = {r.node: r for r in files.write_sectioned(lines, "node", f"file://{tmp_path}/out").collect()}
    want = {
        "n1": '# facts\nid,value,n\n1,"a,b",5\n2,"said ""so""",\n\n# links\nid,status\n9,held\n\n',
        "n2": '# facts\nid,value,n\n3,"two\nlines",6\n\n# links\nid,status\n\n',
        "n3": "# facts\nid,value,n\n\n# links\nid,status\n\n",
    }
    for node, text in want.items():
        assert (got[node].n_bytes, got[node].digest) == (len(text), hashlib.sha256(text.encode()).hexdigest()), node
    assert got["n1"].sections == "facts=2,links=1" and got["n3"].sections == "facts=0,links=0"
    written = spark.read.parquet(f"file://{tmp_path}/out").orderBy("node", "part", "seq").collect()
    assert "".join(r.line + "\n" for r in written if r.node == "n1") == want["n1"]


def test_no_tenant_sees_another(spark):
    rows = views.view(spark, "/root/testdata/sf0.001", "v_docs")
    assert {r.tenant_id for r in rows.filter("tenant_id = 2").select("tenant_id").collect()} == {2}


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()) > 150, len(e.oracle_sql()) > 150)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0]).stdout.strip() == "True True"


def test_deep_folders_and_cycles(spark):
    deep = [(f"d{i}", f"d{i - 1}" if i else None, f"n{i}", 0, False) for i in range(1000)]
    loop = [("x", "y", "x", 0, False), ("y", "x", "y", 0, False), ("z", "y", "z", 0, False), ("o", "gone", "o", 0, False)]
    df = frame(spark, deep + loop, "folder_id string, parent_id string, name string, tenant_id long, is_trashed boolean")
    up = {(r.folder_id, r.ancestor_id): r.depth for r in folders.ancestors(spark, df).collect()}
    assert up["d999", "d0"] == 999 and sum(f == "d999" for f, _ in up) == 1000
    assert {a: d for (f, a), d in up.items() if f == "z"} == {"z": 0, "y": 1, "x": 2} and up["o", "gone"] == 1
    rows = {r.folder_id: r for r in folders.tree(spark, df).collect()}
    assert set(rows) == {f"d{i}" for i in range(1000)} | {"o"}
    assert (rows["d999"].root_id, rows["d999"].depth, rows["d999"].path) == ("d0", 999, "/".join(f"n{i}" for i in range(1000)))


def test_near_vectors_lose_no_pair(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.standard_normal((150, 16))
    x[100:] = x[:50] + r.uniform(0, 0.13, (50, 1)) * r.standard_normal((50, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, "g", v.tolist(), i) for i, v in enumerate(u)]
    df = frame(spark, rows, "id long, g string, x array<double>, least long")
    got = {(p.id, p.other) for p in blocks.best_pairs(df, ["g"], blocks.dots, 200, 0.92, block_rows=40).collect()}
    assert got == {(i, j) for i in range(150) for j in range(150) if u[i] @ u[j] >= 0.92} and len(got) > 160


def test_set_similarity_by_blocks(spark):
    assert blocks.set_jaccard([["a", "b"], []], [["b", "c"], ["a", "b"], []]).round(6).tolist() == [[0.333333, 1.0, 0.0], [0.0, 0.0, 0.0]]


def test_rows_are_numbered_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(2).alias("c"))
    assert {r.v: r.n for r in staging.numbered(df, "v").collect()} == {i: i for i in range(1000)}
    assert {r.v: r.n for r in staging.numbered(df, "v", by="c").collect()} == {i: 2 * i for i in range(1000)}


def test_manifest_does_not_depend_on_order(spark):
    a = frame(spark, [(1, "x"), (1, "y"), (2, "é")], "k long, v string")
    one, two = (sorted(map(tuple, files.manifest(d, "k").collect())) for d in (a, a.orderBy(F.desc("v"))))
    assert one == two and [r[:3] for r in one] == [(1, 2, 30), (2, 1, 16)]
    assert one != sorted(map(tuple, files.manifest(a.replace("y", "z"), "k").collect()))
