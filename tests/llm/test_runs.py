"""Runs against brute force, what a message is, and the defined edge cases."""

import itertools
import random

import pytest

from pyspark.sql import functions as F
from tests.conftest import rows
from tremolith.llm import runs
from tremolith.llm.runs import collapse_runs, message

SCHEMA = "case string, owner string, id bigint, t double, said string, n bigint"


def brute(data, least):
    seen = {}
    for case, owner, i, t, said, n in data:
        if None not in (case, owner, i, t, said):
            seen.setdefault(i, (case, owner, t, i, said, n))
    out = []
    for _, group in itertools.groupby(sorted(seen.values()), key=lambda r: r[:2]):
        for _, run in itertools.groupby(group, key=lambda r: r[4]):
            run = list(run)
            if len(run) >= least:
                out.append((run[0][3], run[-1][3], len(run), sum(1 if r[5] is None else r[5] for r in run), round(run[-1][2] - run[0][2], 6)))
    return sorted(out, key=repr)


def collapse(spark, data, least=1, shard=runs.SHARD_ROWS):
    got = collapse_runs(spark.createDataFrame(data, SCHEMA), ["case", "owner"], id="id", time="t", said="said", frequency="n", least=least, shard_rows=shard)
    return rows(got.select("first_id", "last_id", "records", "occurrences", F.round("duration", 6)))


@pytest.mark.parametrize("least", [1, 2])
@pytest.mark.parametrize("shard", [10, 1_000])
def test_random_sequences(spark, least, shard):
    r = random.Random(3)
    data = [(r.choice("cd"), r.choice(["x", "x", "y", None]), i, float(r.randrange(0, 60)), r.choice(["p", "p", "p", "q", None]), r.choice([None, 1, 5])) for i in range(300)]
    data += data[:40]
    assert collapse(spark, data, least, shard) == brute(data, least)


def test_one_long_run_over_many_shards(spark):
    data = [("c", "x", 1000 - i, float(i), "same", 1) for i in range(300)]
    assert collapse(spark, data, shard=40) == [(1000, 701, 300, 300, 299.0)]


def test_a_burst_of_one_owner_is_split(spark):
    from tremolith.runtime import materialize, ranges

    data = [("c", "x", i, 5.0, "same" if i % 50 else "other", 1) for i in range(20_000)] + [("c", "y", 30_000, 5.0, "same", 1)]
    burst = materialize(spark.createDataFrame(data, SCHEMA))
    assert max(r["count"] for r in ranges(burst, ["case", "owner", "t", "id"], 1_000).groupBy("part").count().collect()) < 3_000
    assert collapse(spark, data, least=2, shard=1_000) == brute(data, 2)


def test_equal_times_are_ordered_by_id_and_empty(spark):
    data = [("c", "x", 3, 1.0, "a", 1), ("c", "x", 1, 1.0, "a", 1), ("c", "x", 2, 1.0, "b", 1), ("c", "x", 4, float("nan"), "a", 1)]
    assert collapse(spark, data) == brute(data[:3], 1)
    assert collapse(spark, []) == []


SAME = [
    ("Connection to 192.0.2.233 opened", "connection  to 198.51.100.7:443 OPENED "),
    ("2021-06-11T03:15:00.453Z certificate 4149e612e85e142ad expires in 2 days", "certificate cffdabeef expires in 5553 days"),
    ("flushed 3 rows to segment 9 in 0.61 s", "flushed 4012 rows to segment 1 in 5ms"),
    ("cache miss ratio 9% over 9 lookups", "cache miss ratio 12.5% over 1 lookups"),
    ("pod quotefern-32e4bf7d3-984cs was evicted from host:rackd-n04", "pod a-b-32e4bf7d-984cs was evicted from host:x"),
    ("request_id=718be355-913c-9bf3-40c3-c051636d167c upstream service:userbrook timed out", "request_id=x1 upstream service:a timed out"),
    ("\tdisk queue on host:racka-n04 above 287", "disk queue on host:rackb-n01 above 3 "),
]
OTHER = [
    ("circuit for service:a is open", "circuit for service:a is half open"),
    ("pod x-32e4bf7d3-984cs is ready", "pod x-32e4bf7d3-984cs is not ready"),
    ("heap usage at 9%, collection skipped", "heap usage at 9%, collection took 3 ms"),
    ("shard 9 became leader for term 9", "shard 9 lost leadership for term 9"),
]


def test_messages(spark):
    df = spark.createDataFrame(SAME + OTHER, "a string, b string").select("a", "b", message(F.col("a")).alias("x"), message(F.col("b")).alias("y"))
    got = {(r.a, r.b): (r.x, r.y) for r in df.collect()}
    for pair in SAME:
        assert got[pair][0] == got[pair][1], got[pair]
    for pair in OTHER:
        assert got[pair][0] != got[pair][1], got[pair]
