"""Merged periods and gaps against brute force, and the defined edge cases."""

import random

import pytest

from tests.conftest import rows
from tremolith.operators.intervals import interval_gaps, interval_periods

SCHEMA = "e string, a bigint, b bigint"


def brute(intervals):
    by = {}
    for e, a, b in intervals:
        if e is not None and a is not None and b is not None and a <= b:
            by.setdefault(e, set()).add((a, b))
    periods, gaps = [], []
    for e, items in by.items():
        merged = []
        for a, b in sorted(items):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        periods += [(e, a, b) for a, b in merged]
        gaps += [(e, p[1], q[0]) for p, q in zip(merged, merged[1:])]
    return sorted(periods, key=repr), sorted(gaps, key=repr)


@pytest.mark.parametrize("shard_rows", [3, 7, 10_000])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_intervals_match_brute_force_in_any_sharding(spark, seed, shard_rows):
    r = random.Random(seed)
    data = []
    for e in "xyz":
        for _ in range({"x": 60, "y": 8, "z": 1}[e]):
            a = r.randrange(0, 1000)
            data.append((e, a, a + r.choice([0, 0, 3, 10, 40, 40, 500 if r.random() < 0.1 else 1])))
    data += data[:5]
    df = spark.createDataFrame(data, SCHEMA)
    periods, gaps = brute(data)
    assert rows(interval_periods(df, ["e"], "a", "b", shard_rows)) == periods
    assert rows(interval_gaps(df, ["e"], "a", "b", shard_rows)) == gaps


def test_nested_touching_points_and_dirt(spark):
    data = [("e", 0, 10), ("e", 2, 3), ("e", 10, 12), ("e", 15, 15), ("e", 20, 21), ("e", 30, 25), (None, 1, 2), ("e", None, 3), ("e", 4, None), ("n", 5, 5)]
    df = spark.createDataFrame([(*d, "q", 1) for d in data], SCHEMA + ", lo string, shard int")
    assert rows(interval_gaps(df, ["e"], "a", "b")) == [("e", 12, 15), ("e", 15, 20)]
    assert rows(interval_periods(df, ["e"], "a", "b")) == [("e", 0, 12), ("e", 15, 15), ("e", 20, 21), ("n", 5, 5)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(interval_gaps(df, ["e"], "a", "b")) == [] == rows(interval_periods(df, ["e"], "a", "b"))


def test_one_interval_over_all_shards_of_a_huge_entity(spark):
    data = [("e", i * 10, i * 10 + 1) for i in range(100)] + [("e", 5, 905)]
    df = spark.createDataFrame(data, SCHEMA)
    periods, gaps = brute(data)
    assert rows(interval_periods(df, ["e"], "a", "b", 9)) == periods
    assert rows(interval_gaps(df, ["e"], "a", "b", 9)) == gaps


def test_an_outlier_leaves_the_shards_of_a_huge_entity_even(spark):
    from tremolith.operators import intervals

    data = [("e", 0, 1)] + [("e", 10**12 + 7 * i, 10**12 + 7 * i + 5 + (i % 3 == 0) * 4) for i in range(60_000)]
    df = spark.createDataFrame(data, SCHEMA)
    spans = intervals._spans(df, ["e"], "a", "b")
    ordinary, shards = intervals._split(spans, ["e"], 1_000)
    assert ordinary.count() == 0 and max(r["count"] for r in shards.groupBy("part").count().collect()) < 3_000
    periods, gaps = brute(data)
    assert rows(interval_gaps(df, ["e"], "a", "b", 1_000)) == gaps
    assert rows(interval_periods(df, ["e"], "a", "b", 1_000)) == periods
