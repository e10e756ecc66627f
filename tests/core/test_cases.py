"""Case tables against hand-made values."""

import numpy as np
import pytest

from tests.conftest import rows
from tremolith.operators import cases


def test_windows_pair_with_the_one_normal_window_of_their_day(spark):
    schema = "day string, kind string, start double, end double"
    good = [("d", "fault", 5.0, 6.0), ("d", "normal", 0.0, 1.0)]
    assert rows(cases.paired_windows(spark.createDataFrame(good, schema), "day", "kind").select("start", "normal_start", "normal_end")) == [(5.0, 0.0, 1.0)]
    for bad in (good[:1], [*good, good[1]]):
        with pytest.raises(Exception, match="one normal"):
            cases.paired_windows(spark.createDataFrame(bad, schema), "day", "kind").collect()


def test_cardinality_partition_retries(spark):
    labels = spark.createDataFrame([("x", ["a"]), ("x", ["a", "b"]), ("y", ["a", "a"])], "kind string, roots array<string>")
    assert rows(cases.root_cardinality(labels, "kind", "roots")) == sorted([(None, 1, 2), (None, 2, 1), ("x", 1, 1), ("x", 2, 1), ("y", 1, 1)], key=repr)
    ids = lambda s: spark.createDataFrame([(c,) for c in s], "case_id string")
    assert rows(cases.partition_faults(ids("abcd"), ids("abx"), ids("bc"))) == [("b", "both"), ("d", "neither"), ("x", "outside")]
    attempts = spark.createDataFrame([("l", 1, "c", True, False), ("l", 2, "c", True, False), ("l", 3, "c", False, True), ("l", 4, "d", False, True)], "l string, n bigint, c string, failed boolean, hit boolean")
    assert rows(cases.retry_links(attempts, "l", "n", "c", "failed").select("n", "retry_of")) == [(1, None), (2, 1), (3, 2), (4, None)]
    assert rows(cases.ledger_summary(attempts, "l", "n", "c", "failed", "hit")) == [("l", 4, 2, 2, 2, 3)]


def test_masks(spark):
    blocks = [("c", i, 2.0 if i < 3 else 0.0) for i in range(20)] + [("one", 0, 5.0)]
    got = cases.mask_blocks(spark.createDataFrame(blocks, "c string, b bigint, z double"), "c", ["b"], "z").collect()
    assert len(got) == 4 and {r.c for r in got} == {"c"}
    reasons = sorted(r.reason for r in got)
    assert reasons.count("uniform") == 2 and all(r.b < 3 for r in got if r.reason == "response")


def test_motifs_do_not_depend_on_the_order_of_vertices():
    same = [[i == j for j in range(3)] for i in range(3)]
    order = [[""] * 3 for _ in range(3)]
    a = cases.motif_code([("s",), ("s",), ("h",)], [(0, 1), (1, 2)], same, order)
    b = cases.motif_code([("h",), ("s",), ("s",)], [(2, 1), (1, 0)], same, order)
    c = cases.motif_code([("h",), ("s",), ("s",)], [(2, 1), (0, 1)], same, order)
    assert a == b != c


def test_medoids_of_six_angles():
    angle = np.radians([0, 30, 60, 120, 150, 180])
    distance = (1 - np.cos(angle[:, None] - angle[None, :])) / 2
    chosen, cost = cases.medoids(distance, 2)
    assert set(chosen) == {1, 4} and cost == pytest.approx((2 - 3**0.5) / 6)
    chosen, cost = cases.medoids(distance, 1, locked=[2])
    assert chosen == [4] and cost == pytest.approx((7 - 3 * 3**0.5) / 24)


def test_weights_come_back(spark, tmp_path):
    weights = {"a": np.arange(6.0).reshape(2, 3), "b": np.zeros(0)}
    cases.save_weights(spark, weights, str(tmp_path / "w"))
    back = cases.load_weights(spark, str(tmp_path / "w"))
    assert {k: v.shape for k, v in back.items()} == {"a": (2, 3), "b": (0,)} and (back["a"] == weights["a"]).all()
