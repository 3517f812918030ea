import os

from paperlode.operators import providers as M


def counting_model(folder):
    """A model that notes each load and refuses one input."""

    def load():
        open(os.path.join(folder, f"{os.getpid()}-{os.urandom(4).hex()}"), "w").close()

        def model(texts):
            if "bad" in texts:
                raise RuntimeError("refused")
            return [[float(len(t))] for t in texts]

        return model

    return load


def test_a_model_is_loaded_once_a_worker_and_one_bad_row_costs_itself(spark, tmp_path):
    rows = spark.createDataFrame([(i, "bad" if i == 17 else "x" * i, "extra") for i in range(200)], "id long, text string, output_of string").repartition(4)
    provider = M.Loaded(f"m-{tmp_path}", counting_model(str(tmp_path)), 8)
    got = {r.id: r for r in M.embed(rows, provider).collect()}
    M.embed(rows, provider).count()
    assert all(got[i].output == [float(i)] and got[i].error is None for i in got if i != 17)
    assert (got[17].output, got[17].error) == (None, "RuntimeError") and len(got) == 200
    pids = [n.split("-")[0] for n in os.listdir(tmp_path)]
    assert len(pids) == len(set(pids))


def test_stored_outputs_are_joined_and_missing_ones_told(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id long, text string")
    made = spark.createDataFrame([("a", [1.0]), ("", [0.0]), ("a", [2.0])], "text string, output array<double>").select(M.text_key("text").alias("key"), "output")
    got = {r.id: (r.output, r.error) for r in M.embed(rows, M.Stored(made)).collect()}
    assert got == {1: ([1.0], None), 2: (None, "missing"), 3: ([0.0], None), 4: ([1.0], None)}


def test_complete_and_extract(spark):
    prompts = spark.createDataFrame([(1, "say hi"), (2, "say no")], "id long, prompt string")
    echo = M.Loaded("echo", lambda: lambda prompts: [p.upper() for p in prompts])
    assert {r.output for r in M.complete(prompts, echo).collect()} == {"SAY HI", "SAY NO"}
    pages = spark.createDataFrame([(1, 1, bytearray(b"img"), "read")], "id long, page_number long, content binary, prompt string")
    read = M.Loaded("read", lambda: lambda pairs: [f"{len(c)} {p}" for c, p in pairs])
    assert [r.output for r in M.extract(pages, read).collect()] == ["3 read"]


def test_rerank_falls_back_to_the_order_it_got(spark):
    schema = "query_id long, query string, item_id long, content string, rank long"
    pairs = spark.createDataFrame([(1, "q", 10, "aa", 0), (1, "q", 11, "a", 1), (1, "q", 12, "aaa", 2), (2, "fail", 20, "x", 0), (2, "fail", 21, "y", 1)], schema)

    def load():
        def model(pairs):
            if any(q == "fail" for q, _ in pairs):
                raise ValueError
            return [float(len(c)) for _, c in pairs]

        return model

    got = [tuple(r) for r in M.rerank(pairs, M.Loaded("rank", load, 2), top_n=2).orderBy("query_id", "place").collect()]
    assert got == [(1, 12, 3.0, 1, True), (1, 10, 2.0, 2, True), (2, 20, 0.0, 1, False), (2, 21, 0.0, 2, False)]
