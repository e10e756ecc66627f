"""The regular grid against a plain piecewise cubic, shard by shard, and the defined edge cases."""

import math
import random

import pytest

from tests.conftest import rows

from tremolith.operators.regular_grid import regular_grid

READ = "s bigint, time double, value double, start double, period double, bins bigint"
SRC = "s bigint, start double, period double, bins bigint"


def slopes(x, y):
    n = len(x)
    if n == 1:
        return [0.0]
    h = [x[i + 1] - x[i] for i in range(n - 1)]
    d = [(y[i + 1] - y[i]) / h[i] for i in range(n - 1)]
    if n == 2:
        return [d[0], d[0]]

    def end(h0, h1, d0, d1):
        m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        sign = lambda v: (v > 0) - (v < 0)
        if sign(m) != sign(d0):
            return 0.0
        return 3 * d0 if sign(d0) != sign(d1) and abs(m) > 3 * abs(d0) else m

    out = [end(h[0], h[1], d[0], d[1])]
    for i in range(1, n - 1):
        if d[i - 1] * d[i] <= 0:
            out.append(0.0)
        else:
            w0, w1 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            out.append((w0 + w1) / (w0 / d[i - 1] + w1 / d[i]))
    return [*out, end(h[-1], h[-2], d[-1], d[-2])]


def brute(points, bins, max_gap):
    by = {}
    for x, y in points:
        if 0 <= x < bins and math.isfinite(y):
            by.setdefault(x, []).append(y)
    pts = sorted((x, (min(v) + max(v)) / 2) for x, v in by.items())
    segments = []
    for p in pts:
        if segments and p[0] - segments[-1][-1][0] <= max_gap:
            segments[-1].append(p)
        else:
            segments.append([p])
    out = {}
    for b in range(bins):
        inside = [p for p in pts if b <= p[0] < b + 1]
        m, value = b + 0.5, None
        for seg in segments:
            xs, ys = [p[0] for p in seg], [p[1] for p in seg]
            if len(seg) > 1 and xs[0] <= m <= xs[-1]:
                i = max(k for k in range(len(xs) - 1) if xs[k] <= m)
                s, h = slopes(xs, ys), xs[i + 1] - xs[i]
                t = (m - xs[i]) / h
                value = ys[i] * (1 + 2 * t) * (1 - t) ** 2 + h * s[i] * t * (1 - t) ** 2 + ys[i + 1] * t * t * (3 - 2 * t) + h * s[i + 1] * t * t * (t - 1)
        if value is None and inside:
            left = [p for p in inside if p[0] <= m]
            value = left[-1][1] if left else inside[0][1]
        out[b] = (value, bool(inside))
    return out


@pytest.mark.parametrize("shard", [4, 16, 4096])
def test_matches_a_plain_cubic_in_any_sharding(spark, shard):
    r = random.Random(5)
    data, sources, expected = [], [], {}
    for s in range(4):
        bins, x, points = 60, r.random() * 4, []
        while x < bins + 1:
            points.append((round(x, 3), round(r.gauss(0, 5), 3)))
            x += r.choice([0.2, 0.9, 1.0, 1.1, 3.0, 11.0 if r.random() < 0.3 else 1.0])
        expected[s] = brute(points, bins, 5)
        data += [(s, 1000 + 60 * a, b, 1000.0, 60.0, bins) for a, b in points]
        sources.append((s, 1000.0, 60.0, bins))
    data += data[:7]
    got = regular_grid(spark.createDataFrame(data, READ), spark.createDataFrame(sources, SRC), "s", max_gap=5, shard_periods=shard).collect()
    assert len(got) == 4 * 60
    for row in got:
        value, observed = expected[row.s][row.bin]
        assert row.observed == observed, (row, value)
        assert (row.value is None) == (value is None), (row, value)
        assert value is None or row.value == pytest.approx(value, abs=1e-6)
        assert row.time == 1000 + 60 * (row.bin + 0.5)
        assert row.status == ("observed" if observed else "missing" if value is None else "filled")


def test_monotone_readings_stay_monotone(spark):
    data = [(1, t, v, 0.0, 1.0, 12) for t, v in [(0.5, 0.0), (3.5, 0.1), (4.5, 9.9), (8.5, 10.0), (11.5, 10.0)]]
    got = sorted(regular_grid(spark.createDataFrame(data, READ), spark.createDataFrame([(1, 0.0, 1.0, 12)], SRC), "s").collect(), key=lambda r: r.bin)
    values = [r.value for r in got]
    assert values == sorted(values) and values[0] == 0.0 and values[-1] == 10.0


def test_unusable_readings_empty_and_dirty_sources(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, 0.0, None, 0.0, 1.0, 3), (1, 1.0, nan, 0.0, 1.0, 3), (1, 2.0, inf, 0.0, 1.0, 3), (1, None, 1.0, 0.0, 1.0, 3), (None, 1.0, 1.0, 0.0, 1.0, 3), (1, -1.0, 5.0, 0.0, 1.0, 3), (1, 3.0, 5.0, 0.0, 1.0, 3)]
    src = spark.createDataFrame([(1, 0.0, 1.0, 3), (2, 0.0, 1.0, 0), (3, None, 1.0, 3), (None, 0.0, 1.0, 3), (4, 0.0, 0.0, 3)], SRC)
    got = regular_grid(spark.createDataFrame(data, READ), src, "s").collect()
    assert sorted((r.s, r.bin, r.status, r.value) for r in got) == [(1, b, "missing", None) for b in range(3)]
    empty = regular_grid(spark.createDataFrame([], READ), spark.createDataFrame([], SRC), "s")
    assert empty.collect() == []


def test_reading_on_a_bound_belongs_to_the_later_period(spark):
    data = [(1, 1609518600.3 + 120, 7.0, 1609518600.3, 60.0, 4)]
    got = regular_grid(spark.createDataFrame(data, READ), spark.createDataFrame([(1, 1609518600.3, 60.0, 4)], SRC), "s").collect()
    assert [r.bin for r in got if r.observed] == [2]


def test_thinning_a_dense_source_changes_nothing(spark):
    import random

    r = random.Random(5)
    readings = [(1, r.choice([r.uniform(0, 12), 3.5, 4.0]), r.gauss(0, 3), 0.0, 1.0, 12) for _ in range(900)] + [(2, float(i) * 3, float(i), 0.0, 1.0, 12) for i in range(4)]
    df = spark.createDataFrame(readings, "k bigint, time double, value double, start double, period double, bins int")
    sources = spark.createDataFrame([(1, 0.0, 1.0, 12, 900), (2, 0.0, 1.0, 12, 4)], "k bigint, start double, period double, bins int, readings int")
    plain = rows(regular_grid(df, sources, "k"))
    assert rows(regular_grid(df, sources, "k", count="readings", dense=10)) == plain and len(plain) == 24
