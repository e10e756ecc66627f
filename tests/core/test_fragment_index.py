"""Numbers from degrees against the enumeration of all fragments."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tremolith.operators import fragment_index, fragments

SCHEMA = "case_id string, edge bigint, source string, target string, source_entity string, target_entity string"


@pytest.mark.parametrize("seed,events,entities,edges", [(1, 5, 5, 9), (2, 6, 3, 12), (3, 4, 4, 14), (4, 9, 5, 16), (5, 3, 2, 8), (6, 8, 8, 18)])
def test_counts_equal_the_enumeration(spark, seed, events, entities, edges):
    r = random.Random(seed)
    data = []
    for case in "cd":
        entity = {f"e{i}": f"n{r.randrange(entities)}" for i in range(events)}
        for k in range(edges):
            a, b = r.sample(sorted(entity), 2)
            data.append((case, k, a, b, entity[a], entity[b]))
    links = spark.createDataFrame(data, SCHEMA)
    got = fragment_index.counts(links)
    listed = fragments.fragments(links)
    whole = listed.groupBy("case_id", "size", "family").agg(F.count("*").alias("n"))
    assert rows(got.where("anchor is null").select("case_id", "size", "family", "fragments")) == rows(whole)
    touched = fragments.anchor_counts(listed)
    assert rows(got.where("anchor is not null").groupBy("case_id", "anchor", "family").agg(F.sum("fragments"))) == rows(touched.select("case_id", "anchor", "family", "fragments"))


def test_no_links(spark):
    assert rows(fragment_index.counts(spark.createDataFrame([], SCHEMA))) == []


def test_samples_are_audited_and_replayed(spark):
    def audit(data, cap):
        links = spark.createDataFrame(data, SCHEMA)
        kept = fragments.balanced_sample(fragments.anchor_sample(fragments.fragments(links), cap=cap), cap=6)
        return fragments.sample_audit(links, kept, fragment_index.counts(links))

    data = [("c", k, f"e{k % 4}", f"e{(k + 1) % 4}", f"n{k % 4}", f"n{(k + 1) % 4}") for k in range(6)] + [("d", 0, "a", "b", "A", "B")]
    first = audit(data, 8)
    assert {(r.case_id, r.family): (r.population, r.taken) for r in first.collect()}["d", "chain"] == (1, 1)
    assert rows(fragments.replay_faults(first, audit(data[::-1], 8))) == []
    assert rows(fragments.replay_faults(first, audit(data, 1))) in ([("c", "other numbers")], [("c", "other fragments")])
    assert rows(fragments.replay_faults(first, audit(data[:-1] + [("d", 0, "b", "a", "B", "A")], 8))) == [("d", "other links")]
