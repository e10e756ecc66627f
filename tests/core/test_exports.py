"""Cases from raw exports, by hand."""

import pytest

from tests.conftest import rows
from tremolith.sources import exports, files

WINDOW = "case_id string, source_id string, day string, reference_start double, reference_end double, incident_start double, incident_end double"
S = 10**9


def write(df, path):
    df.coalesce(1).write.mode("overwrite").parquet(str(path))


def test_service_cases(spark, tmp_path):
    windows = spark.createDataFrame([("c1", "one", "d", 0.0, 10.0, 10.0, 20.0), ("c2", "two", "d", 0.0, 10.0, 10.0, 20.0)], WINDOW)
    catalog = spark.createDataFrame([("c1", "service:a"), ("c1", "service:b"), ("c2", "service:a-1")], "case_id string, id string")
    for name in ("one", "two"):
        base = tmp_path / name
        base.mkdir()
        (base / "env.json").write_text("{}")
        for phase, t in (("normal", 1 * S), ("abnormal", 12 * S)):
            write(spark.createDataFrame([(t, "a-1", "cpu", 1.5, "p1"), (99 * S, "a", "cpu", 2.0, "p1")], "time bigint, service_name string, metric string, value double, pod string"), base / f"{phase}_metrics.parquet")
            write(spark.createDataFrame([(t, "b", "rx", None)], "time bigint, service_name string, metric string, value double"), base / f"{phase}_metrics_sum.parquet")
            write(spark.createDataFrame([(t, "b", "lat", 3.0, 9.0, 1.0, 5.0)], "time bigint, service_name string, metric string, count double, sum double, min double, max double"), base / f"{phase}_metrics_histogram.parquet")
            write(spark.createDataFrame([(t, "b", "hello")], "time bigint, service_name string, message string"), base / f"{phase}_logs.parquet")
            spans = [(t, "a", "t", "s1", "", 5.0), (t + S, "b", "t", "s2", "s1", 7.0), (t + S, "b", "t", "s2", "s1", 7.0), (t, "b", "t", "s3", "gone", 1.0)]
            spans = [(tt, s, f"{tr}{phase}", sp, pa, d) for tt, s, tr, sp, pa, d in spans]
            write(spark.createDataFrame(spans, "time bigint, service_name string, trace_id string, span_id string, parent_span_id string, duration double"), base / f"{phase}_traces.parquet")
    found = exports.service_cases(spark, str(tmp_path), windows, catalog)
    one = found.readings.where("case_id = 'c1'")
    assert rows(one.where("channel = 'metrics/cpu/value'").select("owner", "identity", "time", "value", "seq")) == [("service:a", "pod=p1", 1.0, 1.5, 0), ("service:a", "pod=p1", 12.0, 1.5, 1)]
    assert {r.owner for r in found.readings.where("case_id = 'c2' and channel = 'metrics/cpu/value'").collect()} == {"service:a-1"}
    assert sorted(r.channel for r in one.where("channel like 'metrics_hist%'").select("channel").distinct().collect()) == [f"metrics_histogram/lat/{s}" for s in ("count", "max", "min", "sum")]
    assert [(r.time, r.value) for r in one.where("modality = 'trace'").orderBy("time").collect()] == [(2.0, 7.0), (13.0, 7.0)]
    assert rows(found.relations.where("case_id = 'c1'").select("kind", "source", "target", "start_time", "end_time")) == [("call", "service:a", "service:b", 2.0, 13.0)]
    assert rows(found.logs.where("case_id = 'c1'").select("owner", "time", "text")) == [("service:b", 1.0, "hello"), ("service:b", 12.0, "hello")]
    audit = {r.counter: r.n for r in found.audit.where("case_id = 'c1'").collect()}
    assert audit == {"outside_declared_windows": 2, "trace_parentless_records": 2, "trace_unresolved_parent_records": 2, "trace_duplicate_records": 2, "trace_calls": 2}
    (tmp_path / "two" / "env.json").unlink()
    with pytest.raises(FileNotFoundError, match="two/env.json"):
        exports.service_cases(spark, str(tmp_path), windows, catalog)


def test_cloud_cases(spark, tmp_path):
    windows = spark.createDataFrame([("c1", "x", "d1", 0.0, 10.0, 10.0, 20.0)], WINDOW)
    catalog = spark.createDataFrame([("c1", "service:cart"), ("c1", "service:pay")], "case_id string, id string")
    base = tmp_path / "d1" / "cloudbed"
    for folder in ("metric/container", "metric/node", "log/all", "trace/all"):
        (base / folder).mkdir(parents=True)
    (base / "metric/container/a.csv").write_text("timestamp,cmdb_id,kpi_name,value\n1,n1.cart-0,cpu,5\n50,n1.cart-0,cpu,6\n")
    (base / "metric/node/b.csv").write_text("timestamp,cmdb_id,kpi_name,value\n2,n1,load,\n")
    (base / "log/all/log_filebeat-1.csv").write_text('timestamp,cmdb_id,value\n3,pay-1,"two\nlines"\n')
    head = ",".join(files.TRACE_COLUMNS)
    (base / "trace/all/trace_jaeger-span.csv").write_text(f"{head}\n4000,cart-0,s1,t,5,rpc,0,op,\n5000,pay-1,s2,t,6,rpc,0,op,s1\n6000,pay-1,s3,t,6,rpc,0,op")
    found = exports.cloud_cases(spark, str(tmp_path), windows, catalog)
    assert rows(found.readings.where("modality = 'metric'").select("owner", "channel", "time")) == [("host:n1", "node/load", 2.0), ("service:cart", "container/cpu", 1.0)]
    assert rows(found.relations.select("kind", "source", "target")) == [("call", "service:cart", "service:pay"), ("hosted_on", "service:cart", "host:n1")]
    assert rows(found.logs.select("owner", "text")) == [("service:pay", "two\nlines")]
    assert {r.counter: r.n for r in found.audit.collect()} == {"outside_declared_windows": 1, "trace_parentless_records": 1, "trace_duplicate_records": 0, "trace_calls": 1, "trace_cut_rows": 1}
