"""Strict readers of observations, labels and manifests; content identities; tables and small documents written whole."""

from __future__ import annotations

import csv
import json
import os
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolith.operators.observations import reject_label_columns
from tremolith.runtime import materialize

CORRUPT = "_corrupt_record"
#: The columns of a trace export, in order, and what each kind of Parquet export must have.
TRACE_COLUMNS = ("timestamp", "cmdb_id", "span_id", "trace_id", "duration", "type", "status_code", "operation_name", "parent_span")
PARQUET_COLUMNS = {
    "metrics": ("time", "service_name", "metric", "value"),
    "metrics_sum": ("time", "service_name", "metric", "value"),
    "metrics_histogram": ("time", "service_name", "metric", "count", "sum", "min", "max"),
    "logs": ("time", "service_name", "message"),
    "traces": ("time", "service_name", "trace_id", "span_id", "parent_span_id", "duration"),
}


def _header(spark: SparkSession, path: str, required: Sequence[str]) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"empty CSV: {path}")
    names = next(csv.reader([first[0]["value"].lstrip("﻿")], strict=True))
    if len(set(names)) != len(names) or not set(required) <= set(names):
        raise ValueError(f"a CSV header has repeated columns or lacks required ones: {path}")
    return names


def _csv(spark: SparkSession, path: str, names: Sequence[str], mode: str, multiline: bool = True) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + ([T.StructField(CORRUPT, T.StringType())] if mode == "PERMISSIVE" else []))
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", multiline).option("quote", '"').option("escape", '"')
    return reader.option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT).option("nullValue", "").option("emptyValue", "").csv(path)


def strict_csv(spark: SparkSession, path: str, required: Sequence[str] = (), keep: Sequence[str] | None = None, multiline: bool = True) -> DataFrame:
    """All columns of CSV files of one header as text, with ``_source``; repeated or missing header names fail at once, rows of
    another width than the header when they are read. Label-bearing columns are refused, unless only the columns ``keep``
    are taken. ``path`` may be a pattern. Fields may span lines, so a file is read by one task; with ``multiline=False`` large
    files are split, and a field that spans lines fails as a row of another width."""
    names = _header(spark, path, required)
    df = _csv(spark, path, names, "FAILFAST", multiline).withColumn("_source", F.col("_metadata.file_path"))
    return reject_label_columns(df if keep is None else df.select(*keep, "_source"))


def trace_csv(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of trace exports and their quarantine (``file``, ``row``, ``sha256``, ``reason``).

    Only the last row of a file that lacks its last field and its line end may be set aside; any other malformed row
    fails. ``path`` may be a pattern: each file is judged by itself, and only files with a malformed row are looked at
    again, by their last bytes alone (the read fails if there are more than 10,000 such files). No field of a trace spans lines, so large files are split (unless ``multiline``).
    """
    names = _header(spark, path, TRACE_COLUMNS)
    # parsed once and written, as Spark gives malformed rows of a file no plan of their own
    rows = materialize(_csv(spark, path, names, "PERMISSIVE", multiline).withColumn("file", F.col("_metadata.file_path")), "trace-rows")
    bad = rows.where(F.col(CORRUPT).isNotNull()).select("file", F.col(CORRUPT).alias("row"))
    # files beyond the limit have no known end, so their rows fail below
    torn = [r["file"] for r in bad.groupBy("file").agg(F.max(F.octet_length("row")).alias("n")).orderBy("file").limit(10_000).collect()]
    plain = F.lit(r'^(?:[^,"\r\n]*|"(?:[^"\r\n]|"")*")(?:,(?:[^,"\r\n]*|"(?:[^"\r\n]|"")*")){7}$')
    ends = spark.createDataFrame([(f, _tail(spark, f)) for f in torn], "file string, tail string")
    judged = bad.join(ends, "file", "left").withColumn("k", F.count("*").over(Window.partitionBy("file")))
    is_tail = (F.col("k") == 1) & F.endswith("tail", F.col("row")) & ~F.col("tail").rlike(r"[\r\n]$") & F.regexp_like("row", plain) & F.lit(tuple(names) == TRACE_COLUMNS)
    quarantine = judged.select(
        "file", F.when(F.coalesce(is_tail, F.lit(False)), F.col("row")).otherwise(F.raise_error(F.concat(F.lit("a trace row has another width: "), "row"))).alias("row")
    ).withColumns({"sha256": F.sha2(F.col("row"), 256), "reason": F.lit("unterminated last row without its last field")})
    quarantine = materialize(quarantine, "trace-quarantine")
    return reject_label_columns(rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "file")), quarantine


def _tail(spark: SparkSession, path: str, size: int = 65_536) -> str:
    """The last bytes of a file as text."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path)) if "%" in path else jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    length = fs.getFileStatus(target).getLen()
    stream = fs.open(target)
    try:
        stream.seek(max(0, length - size))
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def parquet_observations(spark: SparkSession, root: str, kind: str, phases: Sequence[str] = ("normal", "abnormal")) -> DataFrame:
    """One kind of Parquet export over its phases, with ``_phase`` and ``_modality``; missing columns fail."""
    parts = []
    for phase in phases:
        df = reject_label_columns(spark.read.parquet(f"{root}/{phase}_{kind}.parquet"))
        missing = set(PARQUET_COLUMNS[kind]) - set(df.columns)
        if missing:
            raise ValueError(f"{phase}_{kind} lacks {sorted(missing)}")
        parts.append(df.withColumns({"_phase": F.lit(phase), "_modality": F.lit(kind)}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def strict_json(text: str):
    """A JSON value; repeated keys and numbers that aren't finite fail."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("a JSON object repeats a key")
        return out

    def constant(name):
        raise ValueError(f"{name} is no JSON number")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def jsonl_ids(spark: SparkSession, path: str, field: str = "case_id") -> DataFrame:
    """One text field of every line; blank lines and lines without it fail."""
    value = F.get_json_object("value", f"$.{field}")
    ok = (F.trim("value") != "") & value.isNotNull() & (F.trim(value) != "")
    return spark.read.text(path).select(F.when(ok, value).otherwise(F.raise_error(F.lit(f"a line has no {field}"))).alias(field))


def parallel_arrays(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Rows of a JSON file that holds one array per column; arrays of different lengths fail."""
    schema = T.StructType([T.StructField(n, T.ArrayType(T._parse_datatype_string(t))) for n, t in fields.items()])
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    sizes = F.array_distinct(F.array(*(F.coalesce(F.size(n), F.lit(-1)) for n in fields)))
    zipped = F.when(F.size(sizes) == 1, F.arrays_zip(*fields)).otherwise(F.raise_error(F.lit("parallel arrays differ in length")))
    return df.select(F.explode(zipped).alias("r")).select("r.*")


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``length``, ``sha256`` of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def canonical_json(columns: Sequence[str]) -> Column:
    """Canonical JSON of a row: keys in order, no blanks, nulls kept."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def write_once(df: DataFrame, path: str) -> None:
    """Write a table that must not be there yet; the committer publishes it whole or not at all."""
    df.write.mode("errorifexists").parquet(path)


class CaseCache:
    """Tables kept under the hash of what they were made from; a table is never replaced."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def get(self, binding: str, make) -> DataFrame:
        """The table of a binding (64 hex digits); made and written whole if it isn't there."""
        if len(binding) != 64 or set(binding) - set("0123456789abcdef"):
            raise ValueError("a binding is a lowercase SHA-256")
        path = f"{self.root}/{binding}"
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            staged = f"{self.root}/.{binding}-{uuid.uuid4().hex}"
            make().write.parquet(staged)
            if not fs.rename(jvm.org.apache.hadoop.fs.Path(staged), target):
                fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)  # another writer was first
        return self.spark.read.parquet(path)


def atomic_json(path: str, value, replace: bool = True) -> None:
    """A small JSON document, written whole: a temporary file in the same folder, synced, then renamed (or linked, if it
    must not replace one)."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "x", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
        f.flush()
        os.fsync(f.fileno())
    try:
        if replace:
            os.replace(temporary, path)
        else:
            os.link(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def spreadsheet_safe(c: Column) -> Column:
    """Text that no spreadsheet takes for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
