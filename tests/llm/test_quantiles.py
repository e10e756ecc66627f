"""Exact percentiles against numpy, their merging, the bounded error, and the defined edge cases."""

import random

import numpy as np
import pytest

from tests.conftest import rows
from tremolith.llm.quantiles import Cumulative, frequencies, median_and_spread, merge

SCHEMA = "g string, h int, id bigint, v double"


def data(seed, n=400):
    r = random.Random(seed)
    return [(r.choice(["a", "a", "a", "b", None]), r.choice([1, 2]), i, r.choice([0.0, -1.5, round(r.gauss(0, 3), 2), 7.0])) for i in range(n)]


def test_percentiles_match_numpy(spark):
    d = data(1)
    df = spark.createDataFrame(d, SCHEMA)
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r.g, r.h): (r.observations, [r[f"p{i}"] for i in range(5)]) for r in Cumulative(frequencies(df, ["g", "h"], "v"), ["g", "h"]).percentiles(shares).collect()}
    keys = {(g, h) for g, h, _, _ in d}
    assert set(got) == keys
    for k in keys:
        v = [x for g, h, _, x in d if (g, h) == k]
        assert got[k][0] == len(v) and got[k][1] == pytest.approx(np.quantile(v, shares))


def test_repeated_readings_count_once_and_dirt_is_ignored(spark):
    nan, inf = float("nan"), float("inf")
    d = [("a", 1, i, float(i)) for i in range(5)] * 3 + [("a", 1, 9, nan), ("a", 1, 10, inf), ("a", 1, 11, None)]
    f = frequencies(spark.createDataFrame(d, SCHEMA), ["g"], "v", identity=["id"])
    assert rows(Cumulative(f, ["g"]).percentiles([0.5])) == [("a", 5, 2.0)]


def test_tables_of_days_combine_into_that_of_the_whole(spark):
    d = data(2)
    parts = [frequencies(spark.createDataFrame(d[i::3], SCHEMA), ["g"], "v") for i in range(3)]
    whole = frequencies(spark.createDataFrame(d, SCHEMA), ["g"], "v")
    assert rows(Cumulative(merge(*parts), ["g"]).percentiles([0.25, 0.5])) == rows(Cumulative(whole, ["g"]).percentiles([0.25, 0.5]))


def test_bounded_error(spark):
    r = random.Random(3)
    d = [("a", 1, i, r.choice([-1, 1]) * 10 ** r.uniform(-3, 6)) for i in range(3000)] + [("a", 1, -1, 0.0)]
    df = spark.createDataFrame(d, SCHEMA)
    exact = Cumulative(frequencies(df, ["g"], "v"), ["g"])
    rough = frequencies(df, ["g"], "v", relative_error=0.02)
    assert rough.select("value").distinct().count() < 1100
    for q in (0.1, 0.3, 0.7, 0.99):
        a, b = exact.percentiles([q]).first()["p0"], Cumulative(rough, ["g"]).percentiles([q]).first()["p0"]
        assert abs(a - b) <= 0.021 * abs(a)


def test_ranks_of_points_and_spread(spark):
    d = data(4)
    values, measured = median_and_spread(frequencies(spark.createDataFrame(d, SCHEMA), ["h"], "v"), ["h"])
    for r in measured.collect():
        v = np.array([x for _, h, _, x in d if h == r.h])
        assert (r.observations, r["median"], r.mad) == (len(v), pytest.approx(np.median(v)), pytest.approx(np.median(np.abs(v - np.median(v)))))
    points = [(1, 0.0), (1, -99.0), (2, 99.0), (2, 7.0), (2, None), (3, 1.0)]
    got = values.counts(spark.createDataFrame(points, "h int, c double"), "c").collect()
    assert len(got) == 4
    for r in got:
        v = [x for _, h, _, x in d if h == r.h]
        assert (r.observations, r.below, r.upto) == (len(v), sum(x < r.c for x in v), sum(x <= r.c for x in v))


def test_hot_value_and_one_value_and_empty(spark):
    d = [("a", 1, i, 5.0) for i in range(2000)] + [("b", 1, 1, 3.0)]
    f = frequencies(spark.createDataFrame(d, SCHEMA), ["g"], "v", identity=["id"])
    assert rows(Cumulative(f, ["g"]).percentiles([0.5])) == [("a", 2000, 5.0), ("b", 1, 3.0)]
    assert rows(Cumulative(frequencies(spark.createDataFrame([], SCHEMA), ["g"], "v"), ["g"]).percentiles([0.5])) == []
    with pytest.raises(ValueError):
        Cumulative(f, ["g"]).percentiles([1.5])
