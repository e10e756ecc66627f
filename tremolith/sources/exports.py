"""Observable cases from raw exports: all cases of a data set at once, as tables of readings, logs and relations.

A window (``case_id``, ``source_id``, ``day``, ``reference_start``, ``reference_end``, ``incident_start``, ``incident_end``) names the case's
folder; rows outside its windows are counted, never kept. Owners are resolved against the case's own ``catalog`` (``case_id``, ``id``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolith.operators import observations as obs
from tremolith.operators.relations import distinct_spans, parent_links
from tremolith.runtime import materialize
from tremolith.sources.files import PARQUET_COLUMNS, reject_label_columns, strict_csv, trace_csv

METRIC_KINDS = ("metrics", "metrics_sum", "metrics_histogram")
PHASES = ("normal", "abnormal")
READINGS = ("case_id", "modality", "owner", "channel", "identity", "time", "value")


@dataclass(frozen=True)
class Cases:
    """Tables of assembled cases. ``readings`` have ``seq``, their place in the series by time and, for equal times, by file and row."""

    readings: DataFrame
    logs: DataFrame
    relations: DataFrame
    audit: DataFrame


def _windowed(rows: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Rows of every case with ``inside``."""
    w = windows.select("case_id", key, "reference_start", "reference_end", "incident_start", "incident_end")
    inside = obs.inside_windows(*(F.col(c) for c in ("time", "reference_start", "reference_end", "incident_start", "incident_end")))
    return rows.join(w, key).withColumn("inside", inside).drop("reference_start", "reference_end", "incident_start", "incident_end")


def _resolved(rows: DataFrame, raw: str, catalog: DataFrame, host: Column | None = None) -> DataFrame:
    """Rows with ``owner``: a service of the case, or the host where ``host`` holds."""
    found = obs.resolve_owner(rows, raw, catalog)
    owner = F.col("resolved") if host is None else F.when(host, F.concat(F.lit("host:"), F.regexp_replace(raw, "^host:", ""))).otherwise(F.col("resolved"))
    return found.withColumn("owner", owner).drop("resolved")


def _calls(spans: DataFrame, windows: DataFrame, key: str, catalog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readings and relations of calls, and counts of their spans. ``spans``: key, trace, span, parent, service, time, value."""
    rows = spans.select(key, "trace", "span", F.coalesce("parent", F.lit("")).alias("parent"), "service", "time", "value")
    copies = rows.groupBy(key).agg(F.count("*").alias("all"))
    once = materialize(distinct_spans(rows, [key, "trace", "span"], ["time", "service", "parent", "value"]), "spans")
    up = once.withColumns({"parent": F.when(F.col("parent") == F.col("span"), F.raise_error(F.lit("a span is its own parent"))).otherwise(F.col("parent")), "trace": F.struct(key, "trace")})
    linked = _windowed(parent_links(up), windows, key)
    audit = linked.where("inside").groupBy("case_id", F.when(F.col("link") == "parentless", "trace_parentless_records").when(F.col("link") == "unresolved", "trace_unresolved_parent_records").otherwise("trace_calls").alias("counter")).agg(F.count("*").alias("n"))
    twice = copies.join(once.groupBy(key).agg(F.count("*").alias("different")), key).join(windows.select("case_id", key), key)
    audit = audit.unionByName(twice.select("case_id", F.lit("trace_duplicate_records").alias("counter"), (F.col("all") - F.col("different")).alias("n")))
    audit = audit.unionByName(linked.where("not inside").groupBy("case_id").agg(F.count("*").alias("n")).select("case_id", F.lit("outside_declared_windows").alias("counter"), "n"))
    calls = _resolved(linked.where("inside and link = 'call'"), "service", catalog).withColumnRenamed("owner", "target")
    calls = _resolved(calls, "parent_service", catalog).withColumnRenamed("owner", "source")
    calls = calls.withColumn("id", obs.relation_id(F.lit("call"), F.col("source"), F.col("target")))
    readings = calls.select("case_id", F.lit("trace").alias("modality"), F.col("id").alias("owner"), F.lit("duration_native").alias("channel"), F.lit("").alias("identity"), "time", "value")
    return readings, calls.select("case_id", F.lit("call").alias("kind"), "source", "target", "id", "time"), audit


def _relations(edges: DataFrame) -> DataFrame:
    """One row per relation with its instants as intervals of no length."""
    grouped = edges.groupBy("case_id", "id", "kind", "source", "target").agg(F.array_sort(F.collect_set("time")).alias("t"))
    spans = F.transform("t", lambda t: F.struct(t.alias("a"), t.alias("b")))
    return grouped.select("case_id", "id", "kind", "source", "target", F.array_min("t").alias("start_time"), F.array_max("t").alias("end_time"), spans.alias("active_intervals"))


def _assembled(readings: DataFrame, logs: DataFrame, edges: DataFrame, audit: DataFrame) -> Cases:
    from pyspark.sql import Window

    series = ["case_id", "modality", "owner", "channel", "identity"]
    order = Window.partitionBy(*series).orderBy("time", "value")
    return Cases(
        readings.withColumn("seq", F.row_number().over(order) - 1), logs, _relations(edges), audit.groupBy("case_id", "counter").agg(F.sum("n").alias("n")),
    )


def _parquet(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """One kind of export of all cases and phases, with the folder's name as ``source_id``."""
    found = []
    for phase in PHASES:
        df = spark.read.option("mergeSchema", True).parquet(f"{root}/*/{phase}_{kind}.parquet")
        missing = set(PARQUET_COLUMNS[kind]) - set(df.columns)
        if missing:
            raise ValueError(f"{phase}_{kind} lacks {sorted(missing)}")
        folder = F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)/{phase}_{kind}\.parquet(/[^/]*)?$", 1)
        found.append(reject_label_columns(df).withColumn("source_id", F.url_decode(folder)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def missing_exports(spark: SparkSession, root: str, windows: DataFrame) -> DataFrame:
    """``source_id``, ``file`` of every export that a case lacks."""
    names = ["env.json", *(f"{p}_{k}.parquet" for p in PHASES for k in PARQUET_COLUMNS)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    there = files.select(F.url_decode(F.regexp_extract("path", r"/([^/]+)/((?:normal|abnormal)_[a-z_]+\.parquet|env\.json)(?:/[^/]*)?$", 1)).alias("source_id"), F.regexp_extract("path", r"/([^/]+)/((?:normal|abnormal)_[a-z_]+\.parquet|env\.json)(?:/[^/]*)?$", 2).alias("file")).distinct()
    due = windows.select("source_id", F.explode(F.array(*(F.lit(n) for n in names))).alias("file"))
    return due.join(there, ["source_id", "file"], "left_anti")


def service_cases(spark: SparkSession, root: str, windows: DataFrame, catalog: DataFrame, unit: str = "ns") -> Cases:
    """Cases of the service benchmark: ten Parquet exports and ``env.json`` in one folder per case.

    A missing file, a missing column, a label-bearing column, a metric without an owner, a log without text and copies of a
    span that differ are errors. Histograms give a channel per statistic."""
    gaps = missing_exports(spark, root, windows).limit(10).collect()
    if gaps:
        raise FileNotFoundError("; ".join(f"{r['source_id']}/{r['file']}" for r in gaps))
    seconds = obs.native_seconds(F.col("time"), unit)
    parts, audits = [], []
    for kind in METRIC_KINDS:
        raw = _parquet(spark, root, kind)
        owner = obs.metric_owner(F.col("metric"), raw.columns)
        rows = raw.select("source_id", seconds.alias("time"), "metric", owner.alias("o"), obs.physical_identity(raw.columns).alias("identity"), *(("count", "sum", "min", "max") if kind == "metrics_histogram" else ("value",)))
        rows = _windowed(rows, windows, "source_id")
        tally = F.when(~F.col("inside"), "outside_declared_windows").when(F.col("o.kind") == "namespace-only", "metric_namespace_only_records").when(F.col("o.kind") == "resource", "metric_resource_owner_fallback_records").when(F.col("o.kind") == "hubble", "metric_hubble_caller_records")
        audits.append(rows.select("case_id", tally.alias("counter")).where("counter is not null").groupBy("case_id", "counter").agg(F.count("*").alias("n")))
        kept = rows.where("inside and o.kind <> 'namespace-only'").withColumn("raw", F.col("o.owner"))
        columns = ("count", "sum", "min", "max") if kind == "metrics_histogram" else ("value",)
        value = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns))).alias("h")
        each = _resolved(kept.select("case_id", "raw", "metric", "identity", "time", value), "raw", catalog)
        parts.append(each.select("case_id", F.lit("metric").alias("modality"), "owner", F.concat_ws("/", F.lit(kind), "metric", "h.c").alias("channel"), "identity", "time", F.coalesce("h.v", F.lit(float("nan"))).alias("value")))
    raw = _parquet(spark, root, "logs")
    text = F.when(F.col("message").isNull(), F.raise_error(F.lit("a log without text"))).otherwise(F.col("message"))
    said = _windowed(raw.select("source_id", seconds.alias("time"), obs.required_text(F.col("service_name"), "service_name").alias("raw"), text.alias("text")), windows, "source_id")
    audits.append(said.where("not inside").groupBy("case_id").agg(F.count("*").alias("n")).select("case_id", F.lit("outside_declared_windows").alias("counter"), "n"))
    logs = _resolved(said.where("inside"), "raw", catalog).select("case_id", "owner", "time", "text", F.lit(1).cast("bigint").alias("frequency"))
    spans = _parquet(spark, root, "traces").select("source_id", F.col("trace_id").alias("trace"), F.col("span_id").alias("span"), F.col("parent_span_id").alias("parent"), F.col("service_name").alias("service"), seconds.alias("time"), F.col("duration").cast("double").alias("value"))
    calls, edges, counts = _calls(spans, windows, "source_id", catalog)
    return _assembled(reduce(DataFrame.unionByName, [*parts, calls]), logs, edges, reduce(DataFrame.unionByName, [*audits, counts]))


def cloud_cases(spark: SparkSession, root: str, windows: DataFrame, catalog: DataFrame) -> Cases:
    """Cases of the cloud benchmark: CSV exports of metrics, logs and traces in one folder per day, read once for all cases of
    the day.

    Containers are named ``host.pod``: their metrics belong to the pod's service, which is hosted on the host at that time.
    A day without one of its files is an error. Rows cut off at the end of a trace export are counted (``trace_cut_rows``)."""
    days = [r["day"] for r in windows.select("day").distinct().orderBy("day").collect()]  # one row per day of exports
    metrics, logs, spans, cut = [], [], [], []
    for day in days:
        base, on = f"{root}/{day}/cloudbed", lambda df, d=day: df.withColumn("day", F.lit(d))
        for scope in ("container", "node"):
            df = strict_csv(spark, f"{base}/metric/{scope}/*.csv", ("timestamp", "cmdb_id", "kpi_name", "value"))
            metrics.append(on(df.select("timestamp", "cmdb_id", "kpi_name", "value")).withColumn("scope", F.lit(scope)))
        logs.append(on(strict_csv(spark, f"{base}/log/all/log_filebeat-*.csv", ("timestamp", "cmdb_id", "value")).select("timestamp", "cmdb_id", "value")))
        kept, quarantine = trace_csv(spark, f"{base}/trace/all/trace_jaeger-span.csv")
        spans.append(on(kept))
        cut.append(on(quarantine))
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    raw = union(metrics)
    dotted = F.contains("cmdb_id", F.lit("."))
    whole = F.when((F.col("scope") == "container") & ~dotted, F.raise_error(F.lit("a container is named host.pod"))).otherwise(obs.required_text(F.col("cmdb_id"), "cmdb_id"))
    rows = _windowed(raw.select("day", "scope", "kpi_name", whole.alias("identity"), obs.native_seconds(F.col("timestamp"), "s").alias("time"), obs.number_or_nan(F.col("value")).alias("value")), windows, "day")
    audit = rows.where("not inside").groupBy("case_id").agg(F.count("*").alias("n")).select("case_id", F.lit("outside_declared_windows").alias("counter"), "n")
    inside = rows.where("inside").withColumns({"pod": F.regexp_extract("identity", r"([^.]*)$", 1), "host": F.regexp_replace("identity", r"\.[^.]*$", "")})
    inside = inside.withColumn("raw", F.when(F.col("scope") == "container", F.col("pod")).otherwise(F.col("identity")))
    owned = _resolved(inside, "raw", catalog, F.col("scope") == "node")
    readings = owned.select("case_id", F.lit("metric").alias("modality"), "owner", F.concat_ws("/", "scope", "kpi_name").alias("channel"), "identity", "time", "value")
    host = F.concat(F.lit("host:"), "host")
    hosted = owned.where("scope = 'container'").select("case_id", F.lit("hosted_on").alias("kind"), F.col("owner").alias("source"), host.alias("target"), obs.relation_id(F.lit("hosted_on"), F.col("owner"), host).alias("id"), "time")
    said = union(logs).select("day", obs.native_seconds(F.col("timestamp"), "s").alias("time"), obs.required_text(F.col("cmdb_id"), "cmdb_id").alias("raw"), F.coalesce("value", F.lit("")).alias("text"))
    said = _windowed(said, windows, "day")
    audit = audit.unionByName(said.where("not inside").groupBy("case_id").agg(F.count("*").alias("n")).select("case_id", F.lit("outside_declared_windows").alias("counter"), "n"))
    records = _resolved(said.where("inside"), "raw", catalog).select("case_id", "owner", "time", "text", F.lit(1).cast("bigint").alias("frequency"))
    tree = union(spans).select("day", F.col("trace_id").alias("trace"), F.col("span_id").alias("span"), F.col("parent_span").alias("parent"), F.col("cmdb_id").alias("service"), obs.native_seconds(F.col("timestamp"), "ms").alias("time"), obs.number_or_nan(F.col("duration")).alias("value"))
    # a day's spans serve all its cases, so they are placed in each before they are linked
    placed = tree.join(windows.select("day", "case_id"), "day").drop("day").withColumnRenamed("case_id", "source_case")
    calls, edges, counts = _calls(placed, windows.withColumn("source_case", F.col("case_id")), "source_case", catalog)
    lost = union(cut).join(windows.select("day", "case_id"), "day").groupBy("case_id").agg(F.count("*").alias("n")).select("case_id", F.lit("trace_cut_rows").alias("counter"), "n")
    return _assembled(readings.unionByName(calls), records, hosted.unionByName(edges), union([audit, counts, lost]))
