"""Streams give what the batch forms give."""

import datetime as dt

from tests.conftest import rows
from tremolith.operators.protocol import chain_faults
from tremolith.streaming import ingest

SCHEMA = "id bigint, t timestamp, k bigint, v double"


def at(s):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)


def stream(spark, folder, batches, schema=SCHEMA):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    return ingest.event_stream(spark, f"{folder}/in/*", schema, files_per_trigger=1)


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


BATCHES = [[(1, at(0), 1, 1.0), (2, at(5), 1, 3.0)], [(2, at(5), 1, 3.0), (3, at(12), 1, 5.0)], [(4, at(400), 1, 0.0)]]


def test_bins_without_repeated_deliveries(spark, tmp_path):
    once = ingest.deduplicated(stream(spark, tmp_path, BATCHES), ["id"], "t", "1 minute")
    got = run(spark, ingest.tumbling(once, ["k"], "t", "v", "10 seconds", None), "bins")
    assert [(r.n, r["mean"]) for r in got.orderBy("start").collect()] == [(2, 2.0), (1, 5.0)]


def test_sessions(spark, tmp_path):
    got = run(spark, ingest.sessions(stream(spark, tmp_path, BATCHES), ["k"], "t", "30 seconds", "1 minute"), "sess")
    assert [r.n for r in got.collect()] == [4]


def test_runs_over_batches(spark, tmp_path):
    data = [[(0, at(0), 1, 2.0), (1, at(1), 1, 2.0)], [(2, at(2), 1, 2.0), (3, at(3), 1, 4.0)]]
    got = run(spark, ingest.stuck_counters(stream(spark, tmp_path, data), "k", "id", "v"), "runs", "append")
    assert rows(got.select("id", "run")) == [(0, 1), (1, 2), (2, 3), (3, 1)]


def test_chained_ledger(spark, tmp_path):
    df = stream(spark, tmp_path, [[(1, at(0), 1, 1.0), (0, at(0), 1, 1.0)], [(2, at(0), 1, 1.0)]])
    ingest.chained_sink(df.selectExpr("id", "cast(id as string) p"), f"{tmp_path}/ledger", f"{tmp_path}/cp", "p", "id").awaitTermination(120)
    ledger = spark.read.parquet(f"{tmp_path}/ledger").selectExpr("'l' as l", "sequence", "payload", "previous", "hash")
    assert rows(ledger.select("sequence", "payload")) == [(0, "0"), (1, "1"), (2, "2")]
    assert rows(chain_faults(ledger, "l")) == []


def test_sliding_windows_overlap(spark, tmp_path):
    got = run(spark, ingest.sliding(stream(spark, tmp_path, BATCHES), ["k"], "t", "v", "20 seconds", "10 seconds", "1 minute"), "slides")
    first = [(r.start.second, r.n) for r in got.orderBy("start").collect()]
    # starts at -10, 0 and 10 seconds; the reading at 5 seconds was delivered twice
    assert first == [(50, 3), (0, 4), (10, 1)]


def test_parents_arrive_before_or_after_their_children(spark, tmp_path):
    schema = "trace string, span string, parent string, service string, t timestamp"
    batches = [[("x", "c", "p", "b", at(10))], [("x", "p", None, "a", at(9)), ("x", "o", "gone", "b", at(11))], [("y", "late", None, "z", at(900))], [("y", "later", None, "z", at(1800))]]
    spans = stream(spark, tmp_path, batches, schema)
    callers = ingest.event_stream(spark, f"{tmp_path}/in/*", schema, files_per_trigger=1)
    got = run(spark, ingest.parents(spans, callers, "t", "10 seconds", "1 minute"), "parents")
    assert {(r.span, r.parent_service) for r in got.where("trace = 'x'").collect()} == {("c", "a"), ("p", None), ("o", None)}


def test_tables_of_a_stream_equal_the_batch_form(spark, tmp_path):
    df = ingest.tumbling(ingest.deduplicated(stream(spark, tmp_path, BATCHES), ["id"], "t", "1 hour"), ["k"], "t", "v", "10 seconds", None)
    got = ingest.latest_table(df, ["start", "k"], f"{tmp_path}/bins", f"{tmp_path}/cp")
    assert [(r.n, r["mean"]) for r in got.orderBy("start").collect()] == [(2, 2.0), (1, 5.0), (1, 0.0)]
