"""The closed loop and the command line."""

import json

from tests.conftest import rows
from tremolith import __main__ as cli
from tremolith.operators import loop, schedule
from tremolith.operators.labels import Reservations


def test_rounds_cover_pay_and_train(spark, tmp_path):
    tokens = spark.createDataFrame([("a", "1", "f", [1.0, 0.0]), ("b", "2", "f", [-1.0, 0.0]), ("c", "3", "f", [0.0, 1.0]), ("d", "4", "f", [0.0, 1.0])], "case_id string, token string, family string, vec array<double>")
    priority = spark.createDataFrame([(c, float(i)) for i, c in enumerate("abcd")], "case_id string, priority double")
    answers = spark.createDataFrame([(c, ["x"]) for c in "abcd"], "case_id string, roots array<string>")
    candidates = spark.createDataFrame([(c, e) for c in "abcd" for e in "xy"], "case_id string, entity string")
    plan = schedule.Schedule(budget=3, batch=2, warm_up=1, per_round=1, tail=2)
    trained = []
    book = Reservations(spark, str(tmp_path / "book"), answers, 3)
    out = loop.run(plan, book, candidates, priority, lambda k: tokens, lambda k, stage, epochs, labels: trained.append((k, stage, epochs, labels.count())))
    # c (or d) covers most; ties go to the earlier case
    assert rows(out) == [(0, ["c", "a"]), (1, ["b"])]
    assert trained == [(0, "warm-up", 1, 2), (1, "round 2", 1, 3), (2, "tail", 2, 3)] and book.summary()["spent"] == 3


def test_smoke_and_list(spark, capsys):
    found = cli.smoke(spark, "/root/testdata/sf0.001")
    assert found["ok"] and found["cases"] > 0
    assert cli.main(["list"]) == 0 and "p3_found" in capsys.readouterr().out.split()
    json.dumps(found)
