import datetime
import random

from pyspark.sql import functions as F

from paperlode.operators import governance
from paperlode.operators import pages as P
from paperlode.sources import files
from paperlode.streaming import jobs

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def stream_of(spark, batches, schema, folder):
    """A stream that has one batch for each list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


EVENTS = "id long, tenant_id long, created_at timestamp, payload string"


def chain_of(spark, rows):
    df = spark.createDataFrame(rows, EVENTS).select("id", "tenant_id", F.date_format("created_at", "yyyyMMddHHmmss").alias("ordinal"), "payload")
    return sorted(map(tuple, governance.build_chain(df).select("id", "tenant_id", "previous_hash", "event_hash").collect()))


def test_shuffled_batches_within_the_delay_give_the_batch_chain(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, i % 3, at(10 * (i // 2)), f"p{i}") for i in range(90)]
    jumbled = sorted(rows, key=lambda x: x[0] + r.uniform(0, 8))
    batches = [jumbled[k : k + 15] for k in range(0, 90, 15)] + [[(None, t, at(10_000), None) for t in range(3)]]
    chain, late = jobs.audit_chain(stream_of(spark, batches, EVENTS, tmp_path), f"file://{tmp_path}/out", delay=120)
    assert sorted(map(tuple, chain.collect())) == chain_of(spark, rows)
    assert late.collect() == []


def test_late_rows_go_to_the_late_table(spark, tmp_path):
    rows = [(i, i % 2, at(10 * i), f"p{i}") for i in range(40)]
    held_back = [rows[3], rows[8]]
    timely = [x for x in rows if x not in held_back]
    batches = [timely[:15][::-1], timely[15:30], held_back + timely[30:][::-1]]
    chain, late = jobs.audit_chain(stream_of(spark, batches, EVENTS, tmp_path), f"file://{tmp_path}/out")
    assert sorted(map(tuple, chain.collect())) == chain_of(spark, timely)
    assert sorted(map(tuple, late.collect())) == [(3, 1), (8, 0)]


def test_chain_goes_on_after_a_restart(spark, tmp_path):
    rows = [(i, 1, at(i), f"p{i}") for i in range(20)]
    jobs.audit_chain(stream_of(spark, [rows[:7], rows[7:11]], EVENTS, tmp_path), f"file://{tmp_path}/out")
    chain, _ = jobs.audit_chain(stream_of(spark, [rows[11:]], EVENTS, tmp_path), f"file://{tmp_path}/out")
    assert sorted(map(tuple, chain.collect())) == chain_of(spark, rows)


POLLS = "path string, poll_no long, size long, mtime timestamp, poll_ts timestamp"
DAY = 86_400


def test_guard_equals_the_batch_over_batches(spark, tmp_path):
    r = random.Random(5)
    polls = []
    for f in range(25):
        size, mtime = 1, 0
        for day in range(24):
            if r.random() < 0.3:
                size, mtime = r.randrange(3), day * DAY - 100
            if r.random() < 0.85:  # else the file is gone at this poll
                polls.append((f"in/f{f}", day, size, at(mtime), at(day * DAY)))
    batches = [[p for p in polls if low <= p[1] < low + 6] for low in range(0, 24, 6)]
    for b in batches:
        r.shuffle(b)
    want = sorted(map(tuple, files.stable_files(spark.createDataFrame(polls, POLLS)).collect()))
    got = jobs.run(jobs.stability_guard(stream_of(spark, batches, POLLS, tmp_path)), f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 30


def test_ingest_takes_each_content_once_and_reads_no_earlier_output(spark, tmp_path):
    schema = "doc_id long, text string, file_hash string"
    rows = [(i, f"line {i % 17} of text\nmore", f"h{i % 17}") for i in range(60)]
    seen = []

    def chunks_of(df):
        seen.append(df._jdf.queryExecution().toString())
        return P.chunk(P.split_pages(df), 2, 1)

    got = jobs.ingest(stream_of(spark, [rows[:12], rows[12:30], rows[30:]], schema, tmp_path), f"file://{tmp_path}/out", chunks_of)
    assert sorted(r.file_hash for r in got.select("file_hash", "doc_id").distinct().collect()) == sorted({h for *_, h in rows})
    assert all(r.doc_id < 17 for r in got.collect())  # the first to arrive
    assert len(seen) >= 3 and not any("/out/chunks" in s for s in seen)
