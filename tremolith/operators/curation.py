"""From raw label records to root sets: mapping to the catalog, issues of every record, and the curated labels.

A record is one row: ``case_id``, ``source_id``, ``granularity``, ``raw_roots`` (array), ``fault_type``, ``evidence_path``,
``evidence_sha256``, ``complete`` and ``confirmation`` (why several roots are simultaneous; null for none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolith.operators.observations import REPLICA_SUFFIX

RECORD = (
    "case_id string, source_id string, granularity string, raw_roots array<string>, fault_type string, "
    "evidence_path string, evidence_sha256 string, complete boolean, confirmation string"
)
#: The category that each granularity of labels stands for.
CATEGORIES = {"service": "service", "pod": "service", "container": "service", "node": "host", "host": "host"}


def category(granularity: Column) -> Column:
    """Category of a granularity; null for an unknown one."""
    out = F.lit(None).cast("string")
    for name, kind in CATEGORIES.items():
        out = F.when(granularity == name, kind).otherwise(out)
    return out


def canonical_roots(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """``records`` with ``roots``: the catalog's ids of all raw roots, in the catalog's order, and ``strange``: the raw roots that have none.

    A container is named ``host.pod``; its pod counts. A name stands for itself or, for services, for its name without
    the suffix of a replica. ``catalog``: ``id``, ``position``. It is the candidates of a data set, joined by id.
    """
    bare = F.when((F.col("granularity") == "container") & F.contains("raw", F.lit(".")), F.element_at(F.split("raw", r"\."), -1)).otherwise(F.col("raw"))
    kind = category(F.col("granularity"))
    name = F.regexp_replace(bare, "^(service|host):", "")
    each = records.select("case_id", "granularity", F.explode(F.array_distinct("raw_roots")).alias("raw"))
    each = each.select("case_id", "raw", F.concat(kind, F.lit(":"), name).alias("whole"), F.when(kind == "service", F.concat(kind, F.lit(":"), F.regexp_replace(name, REPLICA_SUFFIX, ""))).alias("short"))
    named = lambda c: catalog.select(F.col("id").alias(c), F.struct(F.col("position").alias("p"), F.col("id").alias("i")).alias(f"{c}_at"))
    found = each.join(named("whole"), "whole", "left").join(named("short"), "short", "left").withColumn("at", F.coalesce("whole_at", "short_at"))
    per_case = found.groupBy("case_id").agg(F.array_sort(F.collect_set("at")).alias("at"), F.array_sort(F.collect_set(F.when(F.col("at").isNull(), F.col("raw")))).alias("strange"))
    per_case = per_case.select("case_id", F.transform("at", lambda a: a["i"]).alias("roots"), "strange")
    none = F.array().cast("array<string>")
    return records.join(per_case, "case_id", "left").withColumns({"roots": F.coalesce("roots", none), "strange": F.coalesce("strange", none)})


def record_issues(records: DataFrame, windows: DataFrame, catalog: DataFrame, largest: int | None = None) -> DataFrame:
    """``case_id``, ``issue``: everything that is wrong with the records; empty for a sound set.

    ``windows``: ``case_id``, ``source_id`` of the frozen population, which the records must match exactly, one each.
    """
    counted = records.groupBy("case_id").agg(F.count("*").alias("n"))
    population = counted.join(windows.select("case_id", F.lit(True).alias("known")).distinct(), "case_id", "full_outer")
    people = F.when(F.col("known").isNull(), "no such window").when(F.col("n").isNull(), "no record").when(F.col("n") > 1, "several records")
    paths = records.where("evidence_path is not null").groupBy("evidence_path").agg(F.countDistinct("evidence_sha256").alias("k")).where("k > 1").select("evidence_path", F.lit(True).alias("torn"))
    rows = canonical_roots(records, catalog).join(windows.select("case_id", F.col("source_id").alias("frozen")).distinct(), "case_id").join(paths, "evidence_path", "left")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    checks = (
        (~F.col("source_id").eqNullSafe(F.col("frozen")), "another source identity"),
        (~F.coalesce("complete", F.lit(False)), "incomplete roots"),
        (blank("evidence_path"), "no evidence path"),
        (blank("fault_type"), "no fault type"),
        (~F.coalesce(F.col("evidence_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "no checksum of the evidence"),
        (F.coalesce("torn", F.lit(False)), "two checksums of one evidence"),
        (category(F.col("granularity")).isNull(), "an unknown granularity"),
        (F.coalesce(F.size("raw_roots"), F.lit(0)) < 1, "no roots"),
        (F.size("strange") > 0, "roots outside the catalog"),
        ((F.size("roots") > 1) & blank("confirmation"), "joint roots without confirmation"),
        ((F.size("roots") > largest) if largest is not None else F.lit(False), "more roots than allowed"),
    )
    found = F.explode(F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), text) for bad, text in checks))))
    return population.select("case_id", people.alias("issue")).where("issue is not null").unionByName(rows.select("case_id", found.alias("issue")))


def curated_labels(records: DataFrame, windows: DataFrame, catalog: DataFrame, largest: int | None = None) -> DataFrame:
    """``case_id``, ``fault_type``, ``roots``, ``evidence_path``, ``evidence_sha256`` of a sound set of records; any issue is an error
    that names the first of them."""
    issues = record_issues(records, windows, catalog, largest).orderBy("case_id", "issue").limit(20).collect()
    if issues:
        raise ValueError("; ".join(f"{r['case_id']}: {r['issue']}" for r in issues))
    return canonical_roots(records, catalog).select("case_id", "fault_type", "roots", "evidence_path", "evidence_sha256")


def test_types(labels: DataFrame, test_ids: DataFrame) -> DataFrame:
    """Fault types of the test cases alone, without roots."""
    return labels.join(test_ids.select("case_id"), "case_id", "left_semi").select("case_id", "fault_type", "evidence_path", "evidence_sha256")


test_types.__test__ = False  # no test, whatever its name


def injection_records(spark: SparkSession, folder: str, windows: DataFrame) -> DataFrame:
    """Label records from one ``injection.json`` per case (``<folder>/<source_id>/injection.json``), with the hash of each file.

    Files are read whole, as they are small documents; a case without a file has no record, which :func:`record_issues`
    reports. ``ground_truth.service`` must be an array."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "injection.json").option("recursiveFileLookup", True).load(folder)
    text = F.decode("content", "UTF-8")
    parsed = F.from_json(text, "ground_truth struct<service:array<string>>, fault_type string")
    rows = files.select(F.element_at(F.split("path", "/"), -2).alias("source_id"), F.col("path").alias("evidence_path"), F.sha2("content", 256).alias("evidence_sha256"), parsed.alias("p"))
    return windows.select("case_id", "source_id").join(rows, "source_id").select(
        "case_id", "source_id", F.lit("service").alias("granularity"), F.col("p.ground_truth.service").alias("raw_roots"), F.col("p.fault_type").alias("fault_type"), "evidence_path", "evidence_sha256",
        F.col("p.ground_truth.service").isNotNull().alias("complete"), F.lit("simultaneous sources").alias("confirmation"),
    )


def timestamp_records(truth: DataFrame, windows: DataFrame) -> DataFrame:
    """Label records from rows of ``timestamp``, ``level``, ``cmdb_id``, ``failure_type``, ``evidence_path``, ``evidence_sha256``.

    A window's source id is ``x:day:timestamp:level:cmdb_id:...``; level and id must agree with the row of the timestamp,
    or the record has no roots. Repeated timestamps are an error."""
    once = truth.groupBy(F.col("timestamp").cast("string").alias("t")).agg(F.count("*").alias("n"), F.first(F.struct("level", "cmdb_id", "failure_type", "evidence_path", "evidence_sha256")).alias("r"))
    row = F.when(F.col("n") == 1, F.col("r")).otherwise(F.raise_error(F.lit("a label timestamp occurs twice")).cast(once.schema["r"].dataType))
    parts = F.split("source_id", ":")
    keyed = windows.select("case_id", "source_id", F.element_at(parts, 3).alias("t"), F.element_at(parts, 4).alias("l"), F.element_at(parts, 5).alias("c"))
    joined = keyed.join(once.select("t", row.alias("r")), "t", "left")
    same = (F.col("l") == F.col("r.level")) & (F.col("c") == F.col("r.cmdb_id"))
    return joined.select(
        "case_id", "source_id", F.col("r.level").alias("granularity"), F.when(same, F.array("r.cmdb_id")).alias("raw_roots"), F.col("r.failure_type").alias("fault_type"),
        "r.evidence_path", "r.evidence_sha256", same.alias("complete"), F.lit(None).cast("string").alias("confirmation"),
    )
