"""Cases as text, documents against schemas, checkpoints, and functions on sets, maps and tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tremolith.functions import sets, tables
from tremolith.sources import documents


def tables_of_a_case(spark, reverse=False):
    order = reversed if reverse else list
    make = lambda data, schema: spark.createDataFrame(list(order(data)), schema)
    return (
        make([("c", 0.0, 5.0, 9.0), ("d", 0.0, 1.0, 2.0)], "case_id string, reference_start double, incident_start double, incident_end double"),
        make([("c", "service:a", "service", True), ("c", "host:n", "host", False)], "case_id string, id string, category string, candidate boolean"),
        make([("c", "metric", "service:a", "cpu", "", q, float(q), q * 0.1, q != 1) for q in range(3)], "case_id string, modality string, owner string, channel string, identity string, seq int, time double, value double, observed boolean"),
        make([("c", "service:a", 1.0, "hi", 1), ("c", "service:a", 0.5, "ü\n", 2)], "case_id string, owner string, time double, text string, frequency bigint"),
        make([("c", "r", "service:a", "host:n", "hosted_on", None, False, 0.0, 9.0, [(0.0, 9.0)])], "case_id string, id string, source string, target string, kind string, owner string, response boolean, start_time double, end_time double, active_intervals array<struct<a:double,b:double>>"),
    )


def test_cases_come_back_from_their_text(spark):
    built = documents.case_rows(*tables_of_a_case(spark))
    text = documents.to_text(built)
    again = documents.to_text(documents.case_rows(*tables_of_a_case(spark, reverse=True)))
    assert rows(text) == rows(again) and text.where("case_id = 'd'").count() == 1
    back = documents.from_text(text)
    assert rows(back) == rows(built) and back.schema.simpleString() == built.schema.simpleString()
    one = json.loads(text.where("case_id = 'c'").first().text)
    assert list(one) == sorted(one) and one["numeric"][0]["observed"] == [True, False, True]
    with pytest.raises(Exception, match="canonical"):
        documents.from_text(text.withColumn("text", F.concat(F.lit(" "), "text"))).collect()
    with pytest.raises(Exception):
        documents.from_text(text.withColumn("text", F.lit("{"))).collect()


SCHEMA = {
    "type": "object", "required": ["id", "kind"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^[a-z]+$", "maxLength": 4}, "kind": {"enum": ["x", "y", None]}, "n": {"type": ["integer", "null"], "minimum": 0, "exclusiveMaximum": 10},
        "items": {"type": "array", "items": {"$ref": "#/$defs/item"}, "uniqueItems": True, "minItems": 1}, "one": {"oneOf": [{"type": "string"}, {"type": "string", "minLength": 3}, {"const": 1}]},
    },
    "$defs": {"item": {"type": "object", "properties": {"v": {"type": "number"}}, "required": ["v"]}}, "if": {"properties": {"kind": {"const": "y"}}, "required": ["kind"]}, "then": {"required": ["n"]},
}


def test_documents_against_a_schema(spark):
    good = {"id": "ab", "kind": "x", "n": 3, "items": [{"v": 1}, {"v": 2.5}], "one": "ab"}
    cases = {
        "good": (json.dumps(good), set()), "null": (json.dumps({**good, "kind": None, "n": None}), set()), "missing": ('{"kind": "x"}', {"id is missing"}), "more": (json.dumps({**good, "z": 1}), {"an unknown member"}),
        "enum": (json.dumps({**good, "kind": "q"}), {"none of the allowed values"}), "pattern": (json.dumps({**good, "id": "ABCDE"}), {"a text of another pattern", "a text of another length"}),
        "type": (json.dumps({**good, "n": 2.5}), {"not of type ['integer', 'null']"}), "bounds": (json.dumps({**good, "n": 10}), {"a number out of bounds"}), "boolean": (json.dumps({**good, "n": True}), {"not of type ['integer', 'null']"}),
        "items": (json.dumps({**good, "items": [{"v": 1}, {"v": 1}, {}]}), {"repeated items", "v is missing"}), "empty": (json.dumps({**good, "items": []}), {"another number of items"}),
        "one": (json.dumps({**good, "one": "abc"}), {"not exactly one of the alternatives"}), "then": ('{"id": "a", "kind": "y"}', {"n is missing"}), "json": ('{"id": 1, "id": 2}', {"no JSON: a JSON object repeats a key"}),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()] + [("none", None)], "doc string, text string")
    found = {}
    for r in documents.conformance(df, SCHEMA).collect():
        found.setdefault(r.doc, set()).add(r.message)
    assert found == {k: v for k, (_, v) in cases.items() if v}
    with pytest.raises(ValueError, match="unknown keywords"):
        list(documents.schema_faults(1, {"dependentRequired": {}}))


def test_checkpoints(spark, tmp_path):
    path, weights = str(tmp_path / "c"), {"a": np.arange(6.0).reshape(2, 3), "b": np.zeros(0)}
    generator = random.Random(3)
    documents.save_checkpoint(spark, path, weights, {"run": 1}, {"epoch": 4}, generator.getstate())
    after = generator.random()
    back, progress, state = documents.load_checkpoint(spark, path, {"run": 1})
    generator.setstate(state)
    assert (back["a"] == weights["a"]).all() and back["b"].shape == (0,) and progress == {"epoch": 4} and generator.random() == after
    assert documents.final_faults(documents.inspect_checkpoint(spark, path), {"epoch": 170}) == ["epoch: 4 instead of 170"]
    with pytest.raises(ValueError, match="another run"):
        documents.load_checkpoint(spark, path, {"run": 2})
    with pytest.raises(Exception):
        documents.save_checkpoint(spark, path, weights, {"run": 1}, {})


def test_sets_and_maps(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], []), (None, ["a"])], "x array<string>, y array<string>")
    got = [tuple(r) for r in df.select(sets.jaccard(F.col("x"), F.col("y")), sets.overlap(F.col("x"), F.col("y")), sets.multiset_jaccard(sets.occurrences(F.col("x")), sets.occurrences(F.col("y")))).collect()]
    assert got == [(pytest.approx(1 / 3), 0.5, 0.25), (1.0, 1.0, 1.0), (None, None, None)]
    m = spark.createDataFrame([({"a": 1, "b": 5}, {"b": 2, "c": 5}), (None, {"c": 1}), ({}, {})], "p map<string,int>, q map<string,int>")
    merged = m.select(sets.merge_maps(F.col("p"), F.col("q"), lambda x, y: x + y).alias("m")).select("m", sets.top_entry(F.col("m"))).collect()
    assert [tuple(r) for r in merged] == [({"a": 1, "b": 7, "c": 5}, "b"), ({"c": 1}, "c"), ({}, None)]


def test_table_functions(spark):
    import itertools

    tables.register(spark)
    got = spark.sql("select i.s, b.bin from values (1.0D, 25.0D), (10.0D, 10.0D), (10.0D, 20.0D), (5.0D, 1.0D) as i(s, e), lateral touched_bins(i.s, i.e, 0.0D, 10.0D) b").collect()
    assert sorted(map(tuple, got)) == [(1.0, 0), (1.0, 1), (1.0, 2), (10.0, 1), (10.0, 1)]
    listed = spark.sql("select r.id, u.place, u.member from range(11) r, lateral unranked(5, 3, cast(r.id as int)) u").collect()
    found = {}
    for i, _, v in sorted(map(tuple, listed)):
        found.setdefault(i, []).append(v)
    assert list(found.values()) == [list(c) for c in itertools.combinations(range(5), 3)]
