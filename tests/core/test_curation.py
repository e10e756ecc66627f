"""Labels from raw records, inherited calls, and the rules of ledgers and query traces."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tremolith.operators import curation, ledger, topology

WINDOWS = "case_id string, source_id string"
CATALOG = [("service:a", 0), ("service:a-b", 1), ("host:n1", 2)]
H = "a" * 64


def record(case, roots, granularity="service", **more):
    return {"case_id": case, "source_id": f"s-{case}", "granularity": granularity, "raw_roots": roots, "fault_type": "net", "evidence_path": f"{case}.json", "evidence_sha256": H, "complete": True, "confirmation": "both", **more}


def frames(spark, records):
    cases = sorted({r["case_id"] for r in records})
    windows = spark.createDataFrame([(c, f"s-{c}") for c in cases], WINDOWS)
    return spark.createDataFrame(records, curation.RECORD), windows, spark.createDataFrame(CATALOG, "id string, position int")


def test_roots_take_the_order_and_the_names_of_the_catalog(spark):
    records = [record("1", ["a-b-1", "a"]), record("2", ["n1"], "node"), record("3", ["n1.a-5d4f8c9b7a-x2x4z"], "container"), record("4", ["a-b"], "pod"), record("5", ["zz"])]
    got = {r.case_id: (r.roots, r.strange) for r in curation.canonical_roots(*frames(spark, records)[::2]).collect()}
    assert got == {"1": (["service:a", "service:a-b"], []), "2": (["host:n1"], []), "3": (["service:a"], []), "4": (["service:a-b"], []), "5": ([], ["zz"])}


def test_issues_of_records(spark):
    good, windows, catalog = frames(spark, [record("1", ["a"]), record("2", ["a", "n1"], "service")])
    assert [r.issue for r in curation.record_issues(good, windows, catalog).collect()] == ["roots outside the catalog"]
    bad = [
        record("1", ["a"], complete=False), record("2", [], granularity="rack"), record("3", ["a", "a-b"], confirmation=None), record("4", ["a"], evidence_path="1.json", evidence_sha256="b" * 64),
        record("5", ["a"], source_id="other"), record("6", ["a"]), record("6", ["a"]), record("7", ["a", "a-b"]),
    ]
    records, windows, catalog = frames(spark, bad)
    windows = windows.unionByName(spark.createDataFrame([("9", "s-9")], WINDOWS))
    got = {}
    for c, i in rows(curation.record_issues(records, windows, catalog, largest=1).distinct()):
        got.setdefault(c, set()).add(i)
    assert got == {
        "1": {"incomplete roots", "two checksums of one evidence"}, "2": {"no roots", "an unknown granularity"}, "3": {"joint roots without confirmation", "more roots than allowed"},
        "4": {"two checksums of one evidence"}, "5": {"another source identity"}, "6": {"several records"}, "7": {"more roots than allowed"}, "9": {"no record"},
    }
    with pytest.raises(ValueError, match="1: incomplete"):
        curation.curated_labels(records, windows, catalog)
    fine, windows, catalog = frames(spark, [record("1", ["a"]), record("2", ["a-b", "a"])])
    labels = curation.curated_labels(fine, windows, catalog)
    assert rows(labels.select("case_id", "roots")) == [("1", ["service:a"]), ("2", ["service:a", "service:a-b"])]
    assert rows(curation.test_types(labels, spark.createDataFrame([("2",)], "case_id string")).select("case_id", "fault_type")) == [("2", "net")]


def test_raw_label_files(spark, tmp_path):
    folder = tmp_path / "raw" / "s-1"
    folder.mkdir(parents=True)
    text = json.dumps({"ground_truth": {"service": ["a"]}, "fault_type": 7})
    (folder / "injection.json").write_text(text)
    windows = spark.createDataFrame([("1", "s-1"), ("2", "s-2")], WINDOWS)
    got = curation.injection_records(spark, str(tmp_path / "raw"), windows).collect()
    assert [(r.case_id, r.raw_roots, r.fault_type, r.evidence_sha256) for r in got] == [("1", ["a"], "7", hashlib.sha256(text.encode()).hexdigest())]
    truth = spark.createDataFrame([(5, "service", "a", "cpu", "p", H), (6, "node", "n1", "io", "p", H)], "timestamp bigint, level string, cmdb_id string, failure_type string, evidence_path string, evidence_sha256 string")
    named = spark.createDataFrame([("x", "h:d:5:service:a:0"), ("y", "h:d:6:node:other:0")], WINDOWS)
    assert rows(curation.timestamp_records(truth, named).select("case_id", "raw_roots", "complete")) == [("x", ["a"], True), ("y", None, False)]


def test_static_calls_come_from_the_earliest_permitted_reference(spark):
    windows = spark.createDataFrame([("late", 50.0, 60.0), ("empty", 0.0, 0.0), ("early", 10.0, 20.0), ("barred", 1.0, 2.0)], "case_id string, reference_start double, reference_end double")
    permitted = spark.createDataFrame([("late",), ("empty",), ("early",)], "case_id string")
    reference = topology.earliest_reference(windows, permitted)
    assert rows(reference) == [("early", 10.0, 20.0)]
    spans = [("t", "p", None, "a", 11.0), ("t", "c", "p", "b", 12.0), ("t", "d", "p", "b", 12.5), ("t", "e", "p", "a", 13.0), ("u", "p", None, "a", 5.0), ("u", "c", "p", "z", 15.0), ("t", "f", "p", "q", 20.0)]
    static = topology.static_calls(spark.createDataFrame(spans, "trace string, span string, parent string, service string, time double"), reference)
    assert [(r.source, r.target, r.times) for r in static.collect()] == [("a", "b", [12.0, 12.5])]
    with pytest.raises(Exception, match="no permitted"):
        topology.earliest_reference(windows, permitted.where("case_id = 'empty'")).collect()
    cases = spark.createDataFrame([("1", 0.0, 5.0, 5.0, 9.0), ("2", 3.0, 3.0, 4.0, 6.0)], "case_id string, reference_start double, reference_end double, incident_start double, incident_end double")
    call = static.first().id
    observed = spark.createDataFrame([("1", call, "a", "b", "call", [(1.0, 1.0)]), ("1", "h", "a", "n", "hosted_on", [(0.0, 9.0)])], "case_id string, id string, source string, target string, kind string, active_intervals array<struct<a:double,b:double>>")
    got = {(r.case_id, r.id): (r.origin, [tuple(i) for i in r.active_intervals]) for r in topology.inherit(observed, static, cases).collect()}
    assert got == {("1", call): ("both", [(0.0, 5.0), (5.0, 9.0)]), ("1", "h"): ("observed", [(0.0, 9.0)]), ("2", call): ("inherited", [(4.0, 6.0)])}


ATTEMPT = "ledger string, attempt int, case_id string, stage string, status string, repeat_of int, started double, finished double, hit boolean, reason string"
ORDER = [("l", c, i + 1) for i, c in enumerate("abcd")]


def attempt(n, case, stage="search", status="scored", repeat=None, hit=False, reason=None, finished=1.0):
    return ("l", n, case, stage, status, repeat, 0.0, finished, None if status == "error" else hit, reason)


def test_attempts_follow_the_frozen_order(spark):
    order = spark.createDataFrame(ORDER, "ledger string, case_id string, place int")
    faults = lambda rows_: {(r.attempt, r.fault) for r in ledger.attempt_faults(spark.createDataFrame(rows_, ATTEMPT), order).collect()}
    sound = [attempt(1, "a", status="error", reason="x"), attempt(2, "a", "raw_retry", "error", 1, reason="y"), attempt(3, "a", "raw_retry", repeat=2), attempt(4, "b", hit=True), attempt(5, "b", "export_replay", repeat=4), attempt(6, "c")]
    assert faults(sound) == set()
    assert faults([attempt(1, "b")]) == {(1, "the search leaves the frozen order")}
    assert faults([attempt(1, "a"), attempt(2, "a")]) == {(2, "a repeated case needs a retry")}
    assert faults([attempt(1, "a"), attempt(2, "a", "raw_retry", repeat=1)]) == {(2, "a retry must link the latest failed attempt")}
    assert faults([attempt(1, "z", finished=-1.0)]) == {(1, "a case outside the frozen order"), (1, "an attempt that ends before it starts")}
    assert faults([attempt(1, "a", status="error"), attempt(3, "b", reason="x")]) == {(1, "an error without a reason"), (3, "attempts are not numbered in order"), (3, "a score with a reason for failure")}


def test_decisions_reject_earlier_hits_first(spark):
    attempts = spark.createDataFrame([attempt(1, "a", hit=True), attempt(2, "b", hit=True), attempt(3, "c")], ATTEMPT)

    def faults(*events):
        data = [("l", 3, i, c, e, "because") for i, (c, e) in enumerate(events)]
        found = ledger.decision_faults(spark.createDataFrame(data, "ledger string, attempt int, number int, case_id string, event string, reason string"), attempts)
        return sorted(r.fault for r in found.collect())

    assert faults(("a", "selected")) == [] == faults(("a", "rejected"), ("b", "selected")) == faults(("a", "selected"), ("a", "rejected"), ("b", "selected"))
    assert faults(("b", "selected")) == ["an earlier hit was not rejected"]
    assert faults(("c", "rejected")) == ["a decision without a first-rank hit"]
    assert faults(("a", "rejected"), ("a", "selected")) == ["a rejected case stays rejected"]
    assert faults(("a", "selected"), ("a", "selected")) == ["another case is selected"]


def test_query_traces(spark):
    schema = "round int, labeled array<string>, selected array<string>, accessed array<string>, completed array<string>, spent int, remaining int"
    pool = spark.createDataFrame([(c,) for c in "abcdef"], "case_id string")
    sound = [(0, [], ["c", "a"], ["c", "a"], ["c", "a"], 0, 4), (1, ["a", "c"], ["b", "f"], ["b"], [], 2, 2)]
    faults = lambda rounds: {(r["round"], r.fault) for r in ledger.trace_faults(spark.createDataFrame(rounds, schema), pool, [2, 2], 4).collect()}
    assert faults(sound) == set()
    assert [r.case_id for r in ledger.query_order(spark.createDataFrame(sound, schema)).orderBy("place").collect()] == ["c", "a"]
    assert faults([sound[0], (1, ["a"], ["b", "x"], ["x"], ["x"], 2, 2)]) == {(1, "a case outside the pool"), (1, "other labels than the rounds before gave"), (1, "the order of answers is broken")}
    assert faults([(0, [], ["c", "a"], ["c"], [], 0, 4), (1, [], ["c"], [], [], 0, 4)]) == {(0, "an open round before the last"), (1, "another number of cases than planned"), (1, "a case was asked before")}
