"""Implausible readings: planted cases, decoys, shard bounds and dirt."""

import random

import numpy as np

from tremolith.operators import control_chart
from tremolith.operators.control_chart import implausible_readings

SCHEMA = "k bigint, seq bigint, value double, lowest double, highest double"


def found(spark, data):
    out = implausible_readings(spark.createDataFrame(data, SCHEMA), "k").collect()
    return {(r.k, r.seq): (r.outside, r.spike, r.stuck) for r in out}


def series(k, values, lowest=None, highest=None):
    return [(k, i, float(v), lowest, highest) for i, v in enumerate(values)]


def noise(n, seed, level=50.0, scale=1.0):
    r = random.Random(seed)
    return [round(r.gauss(level, scale), 4) for _ in range(n)]


def test_spikes_alone_and_in_succession_but_no_lasting_level(spark):
    a = noise(90, 1)
    a[20], a[50], a[51], a[52] = 90.0, 20.0, 95.0, 12.0
    b = noise(45, 2) + noise(45, 3, level=80.0)
    c = noise(90, 4)
    c[0], c[89] = 200.0, 0.0
    assert set(found(spark, series(1, a) + series(2, b) + series(3, c))) == {(1, 20), (1, 50), (1, 51), (1, 52), (3, 0), (3, 89)}


def test_stuck_stretches_in_varying_series_only(spark):
    a = noise(60, 5)
    a[30:42] = [a[30]] * 12
    b = noise(60, 6)
    b[10:19] = [b[10]] * 9
    small = [random.Random(7).choice([0, 0, 0, 1]) for _ in range(20)] + [0] * 14 + [1, 0, 0, 1] * 6
    got = found(spark, series(1, a) + series(2, b) + series(3, [5.0] * 60) + series(4, small))
    assert set(got) == {(1, i) for i in range(30, 42)} and all(v == (False, False, True) for v in got.values())


def test_limits_are_inclusive_and_constant_series_may_spike(spark):
    data = series(1, [0.0, 100.0, 100.5, -0.5] + noise(40, 8), 0.0, 100.0) + series(2, [6.0] * 20 + [6000.0] + [6.0] * 20)
    got = found(spark, data)
    # both bounds lie within the limits; they are spikes here, as the rest is near 50
    assert got == {(1, 0): (False, True, False), (1, 1): (False, True, False), (1, 2): (True, False, False), (1, 3): (True, False, False), (2, 20): (False, True, False)}


def test_skewed_series(spark):
    r = random.Random(9)
    v = [round(float(np.exp(r.gauss(3, 0.5))), 3) for _ in range(400)]
    v[200] = 2000.0
    assert set(found(spark, series(1, v))) == {(1, 200)}


def test_dirt_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    a = series(1, noise(40, 10))
    a[5] = (1, 5, 500.0, None, None)
    dirty = a + a + [(1, 41, nan, 0.0, 1.0), (1, 42, inf, 0.0, 1.0), (1, 43, None, 0.0, 1.0), (None, 1, 9e9, 0.0, 1.0), (1, None, 9e9, 0.0, 1.0), (2, 0, 3.0, None, None)]
    assert set(found(spark, dirty)) == {(1, 5)}
    assert implausible_readings(spark.createDataFrame([], SCHEMA), "k").collect() == []


def test_shards_give_what_one_piece_gives(spark, monkeypatch):
    n = 3 * control_chart.SHARD // 2
    v = noise(n, 11)
    v[control_chart.SHARD - 1], v[control_chart.SHARD] = 90.0, 91.0
    v[control_chart.SHARD + 300 : control_chart.SHARD + 320] = [v[control_chart.SHARD + 300]] * 20
    v[control_chart.SHARD - 6 - 40 : control_chart.SHARD - 40 + 6] = [51.0] * 12
    expected = {(1, control_chart.SHARD - 1), (1, control_chart.SHARD)} | {(1, control_chart.SHARD + 300 + i) for i in range(20)} | {(1, control_chart.SHARD - 46 + i) for i in range(12)}
    assert set(found(spark, series(1, v))) == expected


def test_lockstep_equals_one_by_one():
    rows = [noise(n, n) for n in (12, 40, 40, 95)]
    rows[1][20] = 99.0
    value = np.concatenate(rows)
    group = np.repeat(np.arange(4), [len(r) for r in rows])
    together = control_chart.judge(group, value, np.zeros(len(value), bool))[0]
    alone = np.concatenate([control_chart.judge(np.zeros(len(r), int), np.array(r), np.zeros(len(r), bool))[0] for r in rows])
    assert (together == alone).all() and together.sum() == 1


def test_a_stuck_stretch_longer_than_a_shard_is_flagged_whole(spark):
    v = noise(20_000, 12)
    v[3_000:15_000] = [v[3_000]] * 12_000
    v[16_000:16_012] = [v[16_000]] * 12
    v[18_500] = 95.0
    got = found(spark, series(1, v) + series(2, [5.0] * 9_000) + series(3, noise(60, 13)))
    stuck = {(1, i) for i in (*range(3_000, 15_000), *range(16_000, 16_012))}
    assert {k for k, f in got.items() if f[2]} == stuck and set(got) - stuck == {(1, 18_500)}


def test_stretches_over_shards_match_one_pass(spark, monkeypatch):
    monkeypatch.setattr(control_chart, "SHARD", 5)
    r = random.Random(14)
    data = [(k, q, float(r.choice([1, 1, 1, 2, 3]))) for k in range(4) for q in sorted(r.sample(range(120), 70))] + [(9, q, 1.0) for q in range(40)]
    df = spark.createDataFrame(data, "k bigint, seq bigint, value double")
    expected = []
    for k in {d[0] for d in data}:
        mine = sorted((q, v) for kk, q, v in data if kk == k)
        begin = 0
        for i in range(1, len(mine) + 1):
            if i == len(mine) or mine[i][1] != mine[begin][1]:
                expected.append((k, mine[begin][0], mine[i - 1][0], i - begin))
                begin = i
    assert sorted(map(tuple, control_chart._equal_stretches(df).collect())) == sorted(expected)
