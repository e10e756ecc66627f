"""Cases as canonical JSON, JSON documents against a schema, and checkpoints of weights."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolith.sources.manifests import digest

_PAIR = "array<struct<a:double,b:double>>"
#: A case as one row; fields of every struct in the order of their names, so that equal cases have equal text.
CASE = (
    "case_id string, entities array<struct<candidate:boolean,category:string,id:string>>, incident_end double, incident_start double, "
    "logs array<struct<frequency:bigint,owner:string,text:string,time:double>>, "
    "numeric array<struct<channel:string,identity:string,modality:string,observed:array<boolean>,owner:string,times:array<double>,values:array<double>>>, "
    f"reference_start double, relations array<struct<active_intervals:{_PAIR},end_time:double,id:string,kind:string,owner:string,response:boolean,source:string,start_time:double,target:string>>"
)


def case_rows(cases: DataFrame, entities: DataFrame, readings: DataFrame, logs: DataFrame, relations: DataFrame) -> DataFrame:
    """One row per case in the form of ``CASE``: its own order of entities, series, records and relations, whatever the tables' order.

    A case's row holds the whole case, so it is for exchange and caches of single cases; analysis works on the tables."""
    listed = lambda df, name, *cols: df.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    series = readings.groupBy("case_id", "modality", "owner", "channel", "identity").agg(F.array_sort(F.collect_list(F.struct("seq", "time", "value", "observed"))).alias("r"))
    part = lambda f: F.transform("r", lambda x: x[f])
    numeric = series.select("case_id", "channel", "identity", "modality", part("observed").alias("observed"), "owner", part("time").alias("times"), part("value").alias("values"))
    out = cases.select("case_id", "reference_start", "incident_start", "incident_end")
    for df in (
        listed(entities, "entities", "candidate", "category", "id"), listed(logs, "logs", "frequency", "owner", "text", "time"),
        listed(numeric, "numeric", "channel", "identity", "modality", "observed", "owner", "times", "values"),
        listed(relations, "relations", *(F.col(c) for c in ("active_intervals", "end_time", "id", "kind", "owner", "response", "source", "start_time", "target"))),
    ):
        out = out.join(df, "case_id", "left")
    fields = T._parse_datatype_string(CASE).fields
    return out.select(*(F.coalesce(F.col(f.name).cast(f.dataType), F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields))


def to_text(rows: DataFrame) -> DataFrame:
    """``case_id``, ``text`` (canonical JSON) and ``sha256`` of rows of ``CASE``. A number that isn't finite is an error."""
    bad = F.exists("numeric", lambda s: F.exists(s["values"], lambda v: F.isnan(v) | (F.abs(v) == float("inf"))))
    text = F.when(bad, F.raise_error(F.lit("a case holds a number that isn't finite"))).otherwise(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}))
    return rows.select("case_id", text.alias("text")).withColumn("sha256", F.sha2("text", 256))


def from_text(texts: DataFrame) -> DataFrame:
    """The inverse of :func:`to_text`; a text that isn't of the schema, or isn't canonical, is an error."""
    parsed = texts.select("text", F.from_json("text", CASE, {"mode": "FAILFAST"}).alias("c"))
    names = sorted(f.name for f in T._parse_datatype_string(CASE).fields)
    again = F.to_json(F.struct(*(F.col(f"c.{n}").alias(n) for n in names)), {"ignoreNullFields": "false"})
    sure = F.when(again == F.col("text"), F.col("c")).otherwise(F.raise_error(F.lit("a case's text is not canonical")).cast(parsed.schema["c"].dataType))
    return parsed.select(sure.alias("c")).select("c.*")


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or float(value).is_integer())
    return isinstance(value, _TYPES[kind])


def schema_faults(value, schema, root: Mapping | None = None, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, message) of everything in a JSON value that its JSON Schema doesn't allow.

    Types, constants, enumerations, bounds, lengths, patterns, properties, items, local references and the combinations of
    schemas are checked; an unknown keyword is an error, so that no rule is passed over in silence.
    """
    root = schema if root is None else root
    if schema is True or schema is False:
        if schema is False:
            yield path, "nothing is allowed here"
        return
    known = {
        "$schema", "$id", "$defs", "$ref", "$comment", "title", "description", "default", "examples", "format", "type", "const", "enum", "required", "properties", "additionalProperties", "patternProperties", "minProperties",
        "items", "prefixItems", "minItems", "maxItems", "uniqueItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "allOf", "anyOf", "oneOf", "not", "if", "then", "else",
    }
    if set(schema) - known:
        raise ValueError(f"unknown keywords of a schema: {sorted(set(schema) - known)}")
    fits = lambda s: next(schema_faults(value, s, root, path), None) is None
    if "$ref" in schema:
        target = root
        for step in schema["$ref"].removeprefix("#").strip("/").split("/"):
            target = target[step.replace("~1", "/").replace("~0", "~")] if step else target
        yield from schema_faults(value, target, root, path)
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield path, f"not of type {kinds}"
        return
    if "const" in schema and value != schema["const"]:
        yield path, f"not {schema['const']!r}"
    if "enum" in schema and not any(value == e and isinstance(value, bool) == isinstance(e, bool) for e in schema["enum"]):
        yield path, "none of the allowed values"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            yield path, "a text of another length"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield path, "a text of another pattern"
    if _is(value, "number"):
        low, high = schema.get("minimum", -math.inf), schema.get("maximum", math.inf)
        if not (low <= value <= high and schema.get("exclusiveMinimum", -math.inf) < value < schema.get("exclusiveMaximum", math.inf)):
            yield path, "a number out of bounds"
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                yield path, f"{name} is missing"
        if len(value) < schema.get("minProperties", 0):
            yield path, "too few members"
        for name, item in value.items():
            rules = [schema["properties"][name]] if name in schema.get("properties", {}) else []
            rules += [s for p, s in schema.get("patternProperties", {}).items() if re.search(p, name)]
            for rule in rules or [schema.get("additionalProperties", True)]:
                yield from ((p, m if rule is not False else "an unknown member") for p, m in schema_faults(item, rule, root, f"{path}/{name}"))
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            yield path, "another number of items"
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            yield path, "repeated items"
        heads = schema.get("prefixItems", [])
        for i, item in enumerate(value):
            yield from schema_faults(item, heads[i] if i < len(heads) else schema.get("items", True), root, f"{path}/{i}")
    for rule in schema.get("allOf", ()):
        yield from schema_faults(value, rule, root, path)
    if "anyOf" in schema and not any(map(fits, schema["anyOf"])):
        yield path, "none of the alternatives"
    if "oneOf" in schema and sum(map(fits, schema["oneOf"])) != 1:
        yield path, "not exactly one of the alternatives"
    if "not" in schema and fits(schema["not"]):
        yield path, "what is ruled out"
    if "if" in schema:
        branch = "then" if fits(schema["if"]) else "else"
        if branch in schema:
            yield from schema_faults(value, schema[branch], root, path)


def conformance(documents: DataFrame, schema: Mapping, doc: str = "doc", text: str = "text") -> DataFrame:
    """``doc``, ``path``, ``message`` of all documents' departures from a JSON Schema; text that is no JSON departs at ``$``.

    Documents are judged one by one in Arrow batches. Null texts are no documents."""
    from tremolith.sources.files import strict_json

    schema = json.loads(json.dumps(schema))

    def run(batches):
        for frame in batches:
            out = []
            for d, t in zip(frame["doc"], frame["text"]):
                try:
                    value = strict_json(t)
                except ValueError as issue:
                    out.append((d, "$", f"no JSON: {issue}"))
                else:
                    out += [(d, p, m) for p, m in schema_faults(value, schema)]
            yield pd.DataFrame(out, columns=["doc", "path", "message"])

    rows = documents.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInPandas(run, "doc string, path string, message string")


def save_checkpoint(spark: SparkSession, path: str, weights: Mapping[str, np.ndarray], identity: Mapping, progress: Mapping, random_state: tuple | None = None) -> None:
    """Weights (Parquet), and beside them what they belong to: an identity, the progress, the state of a random generator, and
    a digest of it all. A checkpoint is never replaced."""
    rows = [(k, [int(s) for s in v.shape], [float(x) for x in np.asarray(v).ravel()]) for k, v in sorted(weights.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, cells array<double>").coalesce(1).write.mode("errorifexists").parquet(f"{path}/weights")
    body = {"identity": dict(identity), "progress": dict(progress), "random": None if random_state is None else [random_state[0], list(random_state[1]), random_state[2]], "weights": digest([[n, s, c] for n, s, c in rows])}
    spark.createDataFrame([(json.dumps({**body, "sha256": digest(body)}, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/record")


def inspect_checkpoint(spark: SparkSession, path: str) -> dict:
    """The record of a checkpoint, without its weights; one that was changed is an error."""
    record = json.loads(spark.read.text(f"{path}/record").first()["value"])
    if digest({k: v for k, v in record.items() if k != "sha256"}) != record["sha256"]:
        raise ValueError("the checkpoint's record has changed")
    return record


def load_checkpoint(spark: SparkSession, path: str, identity: Mapping) -> tuple[dict[str, np.ndarray], dict, tuple | None]:
    """Weights, progress and random state of a checkpoint of this identity; another identity or other weights are an error."""
    record = inspect_checkpoint(spark, path)
    if record["identity"] != json.loads(json.dumps(dict(identity))):
        raise ValueError("the checkpoint belongs to another run")
    rows = sorted((r["name"], list(r["shape"]), list(r["cells"])) for r in spark.read.parquet(f"{path}/weights").collect())
    if digest([[n, s, c] for n, s, c in rows]) != record["weights"]:
        raise ValueError("the checkpoint's weights have changed")
    state = record["random"]
    return {n: np.array(c).reshape(s) for n, s, c in rows}, record["progress"], None if state is None else (state[0], tuple(state[1]), state[2])


def final_faults(record: Mapping, expected: Mapping) -> list[str]:
    """What speaks against a finished run: fields of its progress that differ from what a whole run has (``expected``)."""
    return [f"{k}: {record['progress'].get(k)!r} instead of {v!r}" for k, v in sorted(expected.items()) if record["progress"].get(k) != v]
