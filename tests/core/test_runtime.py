"""Ranges, positions and shards of bounded size, and what the windows over them give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from tremolith import runtime
from tremolith.operators import observations, relations, statistics


def test_written_tables_are_removed(spark):
    from pathlib import Path

    table = runtime.materialize(spark.range(5), "probe")
    path = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert path.exists() and rows(table) == [(i,) for i in range(5)]
    runtime.discard(table)
    assert not path.exists()
    parts = runtime.materialize(spark.range(6).selectExpr("id", "cast(id % 2 as int) part"), "probe", by=["part"])
    assert rows(parts) == [(i, i % 2) for i in range(6)]
    assert rows(runtime.materialize(spark.range(0).selectExpr("id", "1 part"), "probe", by=["part"])) == []


def test_ranges_numbers_and_sums(spark):
    r = random.Random(1)
    data = [(r.randrange(50), i, r.randrange(9)) for i in range(1_000)]
    df = spark.createDataFrame(data, "k int, i int, v int")
    cut = runtime.ranges(runtime.materialize(df), ["k", "i"], 100).groupBy("part").agg(F.min(F.struct("k", "i")).alias("lo"), F.max(F.struct("k", "i")).alias("hi"), F.count("*").alias("n")).orderBy("part").collect()
    assert all(a.hi < b.lo for a, b in zip(cut, cut[1:])) and max(c.n for c in cut) < 300
    assert [x.place for x in runtime.numbered(df, ["k", "i"], rows=90).orderBy("k", "i").collect()] == list(range(1, 1_001))
    total = 0
    for x in runtime.before_and_total(df, ["k", "i"], ["v"], rows=90).orderBy("k", "i").collect():
        total += x.v
        assert (x.v_upto, x.v_total) == (total, sum(v for *_, v in data))
    assert runtime.numbered(df.limit(0), ["k"]).collect() == []


@pytest.mark.parametrize("rows_", [7, 40, 10_000])
def test_windows_over_shards_equal_those_over_whole_keys(spark, rows_):
    data = [(k, q, float(q * q % 17)) for k, n in ((1, 90), (2, 5), (3, 41)) for q in range(n)]
    df = spark.createDataFrame(data, "k int, q int, v double")
    value = lambda w: F.sum("v").over(w.orderBy("q").rowsBetween(-3, 3))
    cut = runtime.sharded(df, ["k"], ["q"], rows_, 3).withColumn("s", value(Window.partitionBy("k", "__shard"))).where("__core")
    assert rows(cut.select("k", "q", "s")) == rows(df.withColumn("s", value(Window.partitionBy("k"))).select("k", "q", "s"))


def test_series_that_are_cut_give_what_whole_ones_give(spark):
    r = random.Random(2)
    data = [(s, q, q * 10.0 + r.choice([0, 0, 1, 4]), r.random() < 0.3) for s in range(3) for q in range((60, 9, 2)[s])]
    df = spark.createDataFrame(data, "s int, q int, time double, observed boolean")
    assert rows(relations.context(df, "s", "q", "observed", 2, shard_rows=8)) == rows(relations.context(df, "s", "q", "observed", 2))
    assert rows(statistics.grid_interval(df, "s", "time", "q", shard_rows=8)) == rows(statistics.grid_interval(df, "s", "time", "q"))


def test_times(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02t03:04:05.1234567+01:00", None]
    got = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_micros(observations.rfc3339(F.col("t")))).collect()]
    assert got == [1704164645000000, 1704161045123456, None]
    for bad in ("2024-01-02T03:04:05", "2024-13-02T03:04:05Z", "yesterday", ""):
        with pytest.raises(Exception, match="RFC 3339"):
            spark.createDataFrame([(bad,)], "t string").select(observations.rfc3339(F.col("t"))).collect()
    moved = observations.shift_times(spark.createDataFrame([(1.0, 2.0), (None, 0.5)], "time double, end double"), 60.0, ("time", "end"))
    assert rows(moved) == sorted([(61.0, 62.0), (None, 60.5)], key=repr)


def test_labels_at_any_depth_are_refused(spark):
    for schema in ("a struct<root_cause:int>", "a array<struct<b:map<string,struct<labels:int>>>>", "fault_type int"):
        with pytest.raises(ValueError, match="label"):
            observations.reject_label_columns(spark.createDataFrame([], schema))
    assert observations.reject_label_columns(spark.createDataFrame([], "a struct<value:int>")).columns == ["a"]


def test_owners_are_resolved_within_their_case(spark):
    seen = spark.createDataFrame([("1", "cart-1"), ("2", "cart-1"), ("3", "cart-1")], "case_id string, raw string")
    catalog = spark.createDataFrame([("1", "service:cart"), ("2", "service:cart-1"), ("2", "service:cart")], "case_id string, id string")
    assert rows(observations.resolve_owner(seen, "raw", catalog).select("case_id", "resolved")) == [("1", "service:cart"), ("2", "service:cart-1"), ("3", "service:cart")]


def test_spans_that_disagree_are_an_error(spark):
    spans = spark.createDataFrame([("t", "s", 1.0, "a"), ("t", "s", 1.0, "a"), ("t", "r", 1.0, "a"), ("t", "r", 2.0, "a")], "trace string, span string, time double, service string")
    assert rows(relations.distinct_spans(spans.where("span = 's'"), ["trace", "span"], ["time"])) == [("t", "s", 1.0, "a")]
    with pytest.raises(Exception, match="differ"):
        relations.distinct_spans(spans, ["trace", "span"], ["time"]).collect()
    assert relations.distinct_spans(spans, ["trace", "span"], ["time"], conflicts="least").count() == 2


def test_thin_references_and_weighted_vectors(spark):
    data = [("a", 1.0, True), ("a", 12.0, True), ("b", 1.0, False), ("b", 12.0, True), ("c", 1.0, True)]
    df = spark.createDataFrame([(*d, 0.0, 10.0) for d in data], "k string, time double, observed boolean, reference_start double, incident_start double")
    assert rows(statistics.thin_references(df, ["k"], 1)) == [("b", 0)]
    vectors = spark.createDataFrame([("g", [1.0, 0.0], 1.0), ("g", [0.0, 4.0], 3.0), ("g", None, 9.0), ("z", [1.0, 1.0], 0.0)], "g string, v array<double>, w double")
    assert rows(statistics.weighted_mean_vectors(vectors, ["g"], "v", F.col("w"))) == [("g", [0.25, 3.0], 4.0), ("z", None, 0.0)]


def test_positions_within_keys(spark):
    data = [(k, i) for k, n in (("a", 400), ("b", 3)) for i in range(n)]
    random.Random(3).shuffle(data)
    got = runtime.numbered_within(spark.createDataFrame(data, "k string, i int"), ["k"], ["i"], rows=50)
    assert rows(got.select("k", "i", "place")) == sorted(((k, i, i + 1) for k, i in data), key=repr)


def test_parts_of_cases_that_do_not_fit(spark):
    cases = spark.createDataFrame([("c", 0.0, 5.0, 9.0), ("d", 6.0, 5.0, 9.0)], "case_id string, reference_start double, incident_start double, incident_end double")
    entities = spark.createDataFrame([("c", "a", "service", True), ("c", "a", "service", True), ("c", "b", "service", True), ("c", "b", "host", True)], "case_id string, id string, category string, candidate boolean")
    relations = spark.createDataFrame([("c", "r", "a", "b", "call", 0.0, 9.0, [(1.0, 2.0)]), ("c", "s", "a", "x", "call", 0.0, 9.0, [(1.0, 12.0)]), ("c", "t", "a", "b", "call", 5.0, 4.0, None)], "case_id string, id string, source string, target string, kind string, start_time double, end_time double, active_intervals array<struct<a:double,b:double>>")
    readings = spark.createDataFrame([(1, 0, "c", "metric", "a", 1.0), (1, 1, "c", "metric", "a", 0.5), (2, 0, "c", "trace", "r", 1.0), (3, 0, "c", "trace", "a", 1.0), (4, 0, "c", "metric", "q", 1.0)], "series_id bigint, seq bigint, case_id string, modality string, owner string, time double")
    logs = spark.createDataFrame([(1, "c", "a", 1), (2, "c", None, 1), (3, "c", "y", 0)], "log_id bigint, case_id string, owner string, frequency bigint")
    assert rows(observations.case_faults(cases, entities, readings, logs, relations)) == sorted([
        ("d", "d", "windows out of order"), ("c", "b", "an id with several meanings"), ("c", "s", "an endpoint that isn't there"), ("c", "q", "a metric without its owner"), ("c", "a", "a trace without its relation"),
        ("c", "y", "a record without its owner"), ("c", "3", "a frequency below one"), ("c", "t", "a relation that ends before it starts"), ("c", "s", "an interval outside its relation"), ("c", "1", "a series that runs backwards"),
    ], key=repr)


@pytest.mark.parametrize("rows_", [20, 10_000])
def test_greatest_before(spark, rows_):
    r = random.Random(5)
    data = [(k, i, r.choice([None, r.randrange(100)])) for k, n in (("a", 150), ("b", 4)) for i in range(n)]
    got = runtime.greatest_before(spark.createDataFrame(data, "k string, i int, v int"), ["k"], ["i"], F.col("v"), "m", rows_)
    want = [(k, i, v, max((x for kk, j, x in data if kk == k and j < i and x is not None), default=None)) for k, i, v in data]
    assert rows(got) == sorted(want, key=repr)
