"""Frozen populations, manifests, repositories and run records."""

import hashlib
import json

import pytest

from tests.conftest import rows
from tremolith.sources import manifests as m


def frozen(path, text):
    path.write_text(text)
    return str(path), hashlib.sha256(text.encode()).hexdigest()


def split(tmp_path, train="abc", test="de"):
    path, sha = frozen(tmp_path / "split.json", json.dumps({"dataset": "x", "outer_train_case_ids": list(train), "outer_test_case_ids": list(test)}))
    return m.frozen_split(path, sha, (3, 2))


def test_splits_are_checked(tmp_path):
    s = split(tmp_path)
    assert s.train == ("a", "b", "c") and s.test == ("d", "e")
    for train, test in (("abc", "cd"), ("aab", "de"), ("ab", "de")):
        with pytest.raises(ValueError):
            split(tmp_path, train, test)
    with pytest.raises(ValueError, match="changed"):
        m.frozen_split(str(tmp_path / "split.json"), "0" * 64, (3, 2))


HEAD = "window_id,source_id,window_kind,day,start_ts,end_ts,fault_type\n"


def test_windows_with_lookback_or_paired(spark, tmp_path):
    text = HEAD + "a,s1,fault,d,1000,1100,never read\nb,s2,fault,d,1200,1300,x\nc,s3,fault,d,1250,1260,x\n"
    path, sha = frozen(tmp_path / "w.csv", text)
    got = m.frozen_windows(spark, path, sha, 3, lookback=300.0)
    assert rows(got.select("case_id", "reference_start", "reference_end", "evidence")) == [("a", 700.0, 1000.0, "full"), ("b", 1100.0, 1200.0, "clipped"), ("c", 1250.0, 1250.0, "overlap")]
    with pytest.raises(ValueError, match="population"):
        m.frozen_windows(spark, path, sha, 2, lookback=300.0)
    path, sha = frozen(tmp_path / "p.csv", HEAD + "a,s1,fault,d,1000,1100,x\nn,s1,normal,d,0,500,\n")
    assert rows(m.frozen_windows(spark, path, sha, 1).select("reference_start", "reference_end", "incident_start")) == [(0.0, 500.0, 1000.0)]
    path, sha = frozen(tmp_path / "q.csv", HEAD + "a,s1,fault,d,1000,1100,x\n")
    with pytest.raises(Exception, match="one normal"):
        m.frozen_windows(spark, path, sha, 1).collect()


def manifest(spark, tmp_path):
    windows = spark.createDataFrame([(c, "full") for c in "abcde"], "case_id string, evidence string")
    entities = spark.createDataFrame([("service:a", "service"), ("host:n", "host"), ("host:n", "host")], "id string, category string")
    return m.build_manifest(split(tmp_path), windows, entities, {"service": 1, "host": 1}), windows, entities


def test_manifests_come_back_and_notice_changes(spark, tmp_path):
    built, windows, entities = manifest(spark, tmp_path)
    document = json.loads(json.dumps(built.to_dict()))
    assert m.Manifest.from_dict(document).to_dict() == built.to_dict()
    assert m.windows_digest(windows) == m.windows_digest(windows.orderBy("case_id", ascending=False).repartition(3)) != m.windows_digest(windows.limit(4))
    for change in ({"windows_sha256": "0"}, {"more": 1}, {"schema": "other"}):
        with pytest.raises(ValueError):
            m.Manifest.from_dict({**document, **change})
    with pytest.raises(ValueError, match="other cases"):
        m.build_manifest(split(tmp_path), windows.limit(4), entities, {"service": 1, "host": 1})
    with pytest.raises(ValueError, match="entities"):
        m.build_manifest(split(tmp_path), windows, entities, {"service": 2})
    partition = [{"case_id": c, "role": "search", "place": i} for i, c in enumerate("ceab")] + [{"case_id": "d", "role": "demo", "place": 1}]
    assert m.bound_search(built, partition, 7)["eligible"] == ["c", "e", "a", "b"]
    with pytest.raises(ValueError):
        m.bound_search(built, partition[1:], 7)


def test_repositories_show_their_cases_and_notice_changes(spark, tmp_path):
    built, *_ = manifest(spark, tmp_path)
    table = tmp_path / "repo" / "readings"
    spark.createDataFrame([(c, 1.0) for c in "abcdez"], "case_id string, v double").coalesce(1).write.parquet(str(table))
    repository = m.Repository(spark, str(tmp_path / "repo"), built, ["readings"])
    assert rows(repository.table("readings").select("case_id")) == [(c,) for c in "abcde"]
    assert rows(repository.table("readings", "test").select("case_id")) == [("d",), ("e",)] and repository.smoke_case() == "a"
    with pytest.raises(ValueError):
        repository.smoke_case("d")
    with pytest.raises(ValueError, match="outside"):
        m.Repository(spark, str(tmp_path / "repo"), built, ["../other"])
    spark.range(1).selectExpr("'a' case_id", "2.0D v").write.mode("append").parquet(str(table))
    with pytest.raises(ValueError, match="changed"):
        repository.table("readings")


def test_snapshots_outputs_and_progress(spark, tmp_path):
    frame = lambda ids: spark.createDataFrame([(c, "0") for c in ids], "case_id string, sha256 string")
    assert rows(m.snapshot_faults(frame("abc"), frame("bcd"), least=2)) == [("a", "extra"), ("d", "missing")]
    with pytest.raises(ValueError, match="more than"):
        m.snapshot_faults(frame("abc"), frame("abc"))
    folder = tmp_path / "out"
    m.sealed_output(str(folder), {"a": 1}, frame("ab"), {"n": 2})
    assert json.loads((folder / "summary.json").read_text())["public_sha256"] == m.digest({"a": 1}) and spark.read.parquet(str(folder / "sealed")).count() == 2
    with pytest.raises(FileExistsError):
        m.sealed_output(str(folder), {}, frame("a"), {})
    with pytest.raises(ValueError):
        m.sealed_output(str(tmp_path / "bad"), {"x": float("nan")}, frame("a"), {})
    assert not (tmp_path / "bad").exists()
    progress = m.Progress(str(tmp_path / "run"))
    progress.update(epoch=1)
    progress.update(epoch=2)
    assert (tmp_path / "run" / "events.jsonl").read_text() == '{"epoch":1}\n{"epoch":2}\n' and json.loads((tmp_path / "run" / "status.json").read_text()) == {"epoch": 2}
    assert m.run_identity(spark) == m.run_identity(spark) and len(m.code_identity()) == 64 and m.code_identity() == m.code_identity()
