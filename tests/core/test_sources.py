"""Strict readers, content identities, and writers that publish whole or not at all."""

import hashlib
import json

import pytest

from tests.conftest import rows
from tremolith.sources import files

HEADER = ",".join(files.TRACE_COLUMNS)
ROW = "1651335239000,svc-0,{s},t1,20,rpc,0,op,{p}"


def test_csv(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text('﻿a,b\n1,"x, ""y"""\n2,\n', encoding="utf-8")
    df = files.strict_csv(spark, str(good), ["a"])
    assert rows(df.select("a", "b"))[0] == ("1", 'x, "y"') and df.columns == ["a", "b", "_source"]
    wide = tmp_path / "b.csv"
    wide.write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception):
        files.strict_csv(spark, str(wide)).collect()
    for text in ("a,a\n1,2\n", "b\n1\n", "root,a\n1,2\n"):
        wide.write_text(text)
        with pytest.raises(ValueError):
            files.strict_csv(spark, str(wide), ["a"])


def test_only_a_cut_last_trace_row_is_set_aside(spark, tmp_path):
    path = tmp_path / "t.csv"
    full = [ROW.format(s="s1", p=""), ROW.format(s="s2", p="s1")]
    cut = "1651335239000,svc-0,s3,t1,20,rpc,0,op"
    path.write_text("\n".join([HEADER, *full, cut]))
    kept, quarantine = files.trace_csv(spark, str(path))
    assert kept.count() == 2
    assert rows(quarantine.select("row", "sha256")) == [(cut, hashlib.sha256(cut.encode()).hexdigest())]
    for text in ([HEADER, full[0], cut, full[1]], [HEADER, full[0], cut + "\n"], [HEADER, full[0], cut.rsplit(",", 1)[0]]):
        path.write_text("\n".join(text))
        with pytest.raises(Exception):
            kept, quarantine = files.trace_csv(spark, str(path))
            quarantine.collect()


def test_parquet_kinds(spark, tmp_path):
    for phase, extra in (("normal", ""), ("abnormal", ", attr_x string")):
        values = (1, "a", "m", 1.0) + (("q",) if extra else ())
        spark.createDataFrame([values], "time bigint, service_name string, metric string, value double" + extra).write.parquet(str(tmp_path / f"{phase}_metrics.parquet"))
    df = files.parquet_observations(spark, str(tmp_path), "metrics")
    assert rows(df.select("_phase", "_modality", "attr_x")) == [("abnormal", "metrics", "q"), ("normal", "metrics", None)]
    spark.createDataFrame([(1,)], "time bigint").write.parquet(str(tmp_path / "normal_logs.parquet"))
    with pytest.raises(ValueError):
        files.parquet_observations(spark, str(tmp_path), "logs", ["normal"])


def test_json(spark, tmp_path):
    assert files.strict_json('{"a": [1, 2]}') == {"a": [1, 2]}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', "[Infinity]"):
        with pytest.raises(ValueError):
            files.strict_json(bad)
    lines = tmp_path / "ids.jsonl"
    lines.write_text('{"case_id": "x", "roots": ["never read"]}\n{"case_id": "y"}\n')
    assert rows(files.jsonl_ids(spark, str(lines))) == [("x",), ("y",)]
    lines.write_text('{"case_id": "x"}\n\n{"case_id": "y"}\n')
    with pytest.raises(Exception):
        files.jsonl_ids(spark, str(lines)).collect()
    arrays = tmp_path / "truth.json"
    arrays.write_text(json.dumps({"timestamp": [1, 2], "level": ["service", "node"]}))
    assert rows(files.parallel_arrays(spark, str(arrays), {"timestamp": "bigint", "level": "string"})) == [(1, "service"), (2, "node")]
    arrays.write_text(json.dumps({"timestamp": [1, 2], "level": ["service"]}))
    with pytest.raises(Exception):
        files.parallel_arrays(spark, str(arrays), {"timestamp": "bigint", "level": "string"}).collect()


def test_writers(spark, tmp_path):
    path = str(tmp_path / "x.json")
    files.atomic_json(path, {"b": 1, "a": "ü"})
    assert open(path, encoding="utf-8").read() == '{"a":"ü","b":1}'
    with pytest.raises(FileExistsError):
        files.atomic_json(path, {}, replace=False)
    assert [p.name for p in tmp_path.iterdir()] == ["x.json"]
    got = rows(files.content_hashes(spark, str(tmp_path)).select("length", "sha256"))
    assert got == [(16, hashlib.sha256('{"a":"ü","b":1}'.encode()).hexdigest())]
    made = []
    cache = files.CaseCache(spark, str(tmp_path / "cache"))
    for _ in range(2):
        assert rows(cache.get("a" * 64, lambda: made.append(1) or spark.range(3))) == [(0,), (1,), (2,)]
    assert made == [1]
    with pytest.raises(ValueError):
        cache.get("../x", lambda: spark.range(1))
    files.write_once(spark.range(1), str(tmp_path / "once"))
    with pytest.raises(Exception):
        files.write_once(spark.range(1), str(tmp_path / "once"))
