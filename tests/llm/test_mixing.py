"""The mix: shares, caps, expectations, buckets, and the defined edge cases."""

import random

import numpy as np
import pytest

from tests.conftest import rows
from tremolith.llm.mixing import mix, pivot, plan

DOC, TARGET = "doc_id bigint, source string, tokens bigint", "source string, weight double, max_repeats bigint"


def documents(seed=1):
    r = random.Random(seed)
    return [(i, r.choice(["big"] * 8 + ["mid"] * 3 + ["small"]), r.randrange(1, 60)) for i in range(600)]


TARGETS = [("big", 0.5, 1), ("mid", 0.25, 2), ("small", 0.15, 4), ("none", 0.1, 3)]


def check(data, targets, drawn, shares, total=None):
    size = {}
    for _, s, t in data:
        size[s] = size.get(s, 0) + t
    largest = max(t for *_, t in data)
    caps = {s: c for s, _, c in targets}
    tokens = {}
    for r in drawn:
        assert 1 <= r.copies <= caps[r.source]
        tokens[r.source] = tokens.get(r.source, 0) + r.copies * r.tokens
    for r in shares:
        assert r.tokens == tokens.get(r.source, 0)
        assert abs(r.tokens - r.goal) <= largest, r
    return tokens


@pytest.mark.parametrize("bucket,fan_in", [(20_000, 4_096), (25, 2)])
def test_shares_are_met_within_a_document(spark, bucket, fan_in):
    data = documents()
    drawn, shares = mix(spark.createDataFrame(data, DOC), spark.createDataFrame(TARGETS, TARGET), bucket=bucket, fan_in=fan_in)
    drawn, shares = drawn.collect(), {r.source: r for r in shares.collect()}
    check(data, TARGETS, drawn, shares.values())
    assert set(shares) == {s for s, *_ in TARGETS} and shares["none"].tokens == 0
    for source, weight, _ in TARGETS[:3]:
        assert shares[source].share == pytest.approx(weight / 0.9, abs=0.02)
    assert len({r.doc_id for r in drawn}) == len(drawn)


def test_a_given_total_is_capped(spark):
    data = documents()
    drawn, shares = mix(spark.createDataFrame(data, DOC), spark.createDataFrame(TARGETS, TARGET), total=1e6)
    by = {r.source: r for r in shares.collect()}
    for source, cap in (("big", 1), ("mid", 2), ("small", 4)):
        assert by[source].tokens == cap * sum(t for _, s, t in data if s == source)
        assert by[source].most_copies == cap


def test_pivot_keeps_the_sum_and_the_expectations():
    r = np.random.default_rng(0)
    size = r.integers(1, 50, 12).astype(float)
    share = r.random(12)
    mean = np.zeros(12)
    for _ in range(4000):
        out = pivot(share, size, r.random(12))
        assert out @ size == pytest.approx(share @ size)
        assert sum((out > 0) & (out < 1)) <= 1
        mean += out / 4000
    assert np.abs(mean - share).max() < 0.04


def test_same_seed_same_mix_and_other_partitions(spark):
    data = documents()
    a = rows(mix(spark.createDataFrame(data, DOC), spark.createDataFrame(TARGETS, TARGET), bucket=50)[0])
    b = rows(mix(spark.createDataFrame(data[::-1], DOC).repartition(7), spark.createDataFrame(TARGETS, TARGET), bucket=50)[0])
    c = rows(mix(spark.createDataFrame(data, DOC), spark.createDataFrame(TARGETS, TARGET), bucket=50, seed=1)[0])
    assert a == b != c


def test_dirt_and_empty(spark):
    data = [(1, "big", 10), (1, "big", 10), (None, "big", 5), (2, None, 5), (3, "other", 5), (4, "big", 0), (5, "big", None)]
    targets = [("big", 1.0, 2), ("bad", None, 1), ("worse", 0.5, 0), (None, 0.5, 1)]
    drawn, shares = mix(spark.createDataFrame(data, DOC), spark.createDataFrame(targets, TARGET))
    assert rows(drawn) == [(1, "big", 10, 1)]
    assert [(r.source, r.tokens, r.share) for r in shares.collect()] == [("big", 10, 1.0)]
    drawn, shares = mix(spark.createDataFrame([], DOC), spark.createDataFrame(TARGETS, TARGET))
    assert rows(drawn) == [] and all(r.tokens == 0 for r in shares.collect())


def test_what_a_tiny_source_lacks_goes_to_the_others(spark):
    data = [(i, "tiny", 40) for i in range(2)] + [(i, "a", 40) for i in range(2, 4_000)] + [(i, "b", 40) for i in range(4_000, 6_000)]
    targets = [("tiny", 0.5, 3), ("a", 0.3, 2), ("b", 0.2, 5)]
    shares = {r.source: r for r in mix(spark.createDataFrame(data, DOC), spark.createDataFrame(targets, TARGET))[1].collect()}
    total = 40 * 6_000
    assert (shares["tiny"].tokens, shares["tiny"].most_copies, shares["tiny"].full) == (240, 3, True)
    assert shares["tiny"].shortfall == pytest.approx(0.5 * total - 240)
    assert shares["a"].tokens == pytest.approx((total - 240) * 0.6, abs=40) and shares["b"].tokens == pytest.approx((total - 240) * 0.4, abs=40)
    assert sum(r.tokens for r in shares.values()) == pytest.approx(total, abs=80)


@pytest.mark.parametrize("seed", range(4))
def test_goals_fill_the_total_by_weight(spark, seed):
    r = random.Random(seed)
    names = "abcdefg"
    data = [(i, r.choice(names[:6]), r.randrange(1, 400)) for i in range(60)]
    targets = [(n, r.choice([0.01, 0.1, 0.3, 0.6]), r.choice([1, 1, 2, 8])) for n in names]
    total = r.choice([100.0, 5_000.0, 12_000.0, 1e7])
    got = {x.source: x for x in plan(spark.createDataFrame(data, DOC), spark.createDataFrame(targets, TARGET), total).collect()}
    size = {n: sum(t for _, s, t in data if s == n) for n in names}
    room, weight = {n: c * size[n] for n, _, c in targets}, {n: w for n, w, _ in targets}
    low, high = 0.0, 1e12  # goals grow with one level for all sources that aren't full
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(room[n], weight[n] * middle) for n in names) < total else (low, middle)
    for n in names:
        goal = min(room[n], weight[n] * high)
        assert got[n].goal == pytest.approx(goal, rel=1e-6, abs=1e-6) and got[n].full == (size[n] > 0 and goal >= room[n] * (1 - 1e-12))
        assert got[n].shortfall == pytest.approx(max(weight[n] / sum(weight.values()) * total - goal, 0), abs=1e-3)
