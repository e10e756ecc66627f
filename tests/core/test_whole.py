"""Queries and operators that did less than the whole job, against brute force."""

import itertools
import re

from pyspark.sql import functions as F

from tests.conftest import rows
from tremolith.operators import cases, fragments, observations


def test_all_catalog_ids_of_a_case_are_masked(spark):
    ids = {"c": ["service:a", "service:a-b", "host:n.1", "ENTITY"], "d": ["service:z"]}
    texts = ["service:a-b calls service:a", "xservice:a on host:n.1, host:nx1", "service:z", "service:a_b service:a\u00e9 10.1.2.3", "ENTITY"]
    records = [(c, i, t) for c in "cde" for i, t in enumerate(texts)]

    def brute(case, text):
        for name in sorted(ids.get(case, ()), key=len, reverse=True):
            text = re.sub(r"(?<!\w)" + re.escape(name) + r"(?!\w)", "<ENTITY>", text)
        return re.sub(r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>", text)

    catalog = spark.createDataFrame([(c, i) for c, names in ids.items() for i in names], "case_id string, id string")
    found = observations.sanitize_by_catalog(spark.createDataFrame(records, "case_id string, n int, text string"), catalog)
    assert rows(found.select("case_id", "n", "text")) == sorted(((c, n, brute(c, t)) for c, n, t in records), key=repr)


def test_sanitized_logs_mask_names_outside_the_fixed_five(spark):
    from tremolith.plans.reference import entities, logs, sanitized_logs

    sf = "/root/testdata/sf0.001"
    named = logs(spark, sf).join(entities(spark, sf), "case_id").where(F.contains("text", F.col("id"))).select("log_id", "id")
    ids = {(r.log_id, r.id) for r in named.collect()}
    texts = dict(sanitized_logs(spark, sf).collect())
    assert ids
    assert not [i for n, i in ids if re.search(r"(?<!\w)" + re.escape(i) + r"(?!\w)", texts[n])]


def test_source_sets_hold_every_single_candidate_prefixes_and_seeded_extras(spark):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 13}
    ranked = [(c, f"e{(5 * i) % n:02d}" if n == 13 else f"e{i:02d}", i + 1) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(ranked, "case_id string, entity string, rank int")
    found = rows(cases.source_sets(df))
    assert found == rows(cases.source_sets(df.repartition(3))) and len(set(map(repr, found))) == len(found)
    for c, n in sizes.items():
        order = [e for k, e, _ in ranked if k == c]
        sets = [frozenset(s) for k, s in found if k == c]
        assert {s for s in sets if len(s) == 1} == {frozenset([e]) for e in order}
        assert {frozenset(order[:k]) for k in range(2, min(9, n) + 1)} <= set(sets)
        assert len(sets) == n + min(16, 2**n - 1 - n)
    pairs = [frozenset(s) for k, s in rows(cases.source_sets(df, largest=2)) if k == "d" and len(s) > 1]
    assert len(set(pairs)) == 16 and {len(s) for s in pairs} == {2}


def test_labeled_source_sets_hold_the_truth_and_others_of_its_size(spark):
    rows_ = [(c, f"e{i:02d}", i < 2) for c, n in (("x", 3), ("y", 12)) for i in range(n)]
    found = rows(cases.labeled_source_sets(spark.createDataFrame(rows_, "case_id string, entity string, is_root boolean")))
    for c, n in (("x", 3), ("y", 17)):
        sets = {frozenset(s): t for k, s, t in found if k == c}
        assert len(sets) == n and [s for s, t in sets.items() if t] == [frozenset(["e00", "e01"])] and {len(s) for s in sets} == {2}


def test_motifs_differ_by_order_state_and_edge_and_not_by_names(spark):
    link = {"edge": 1, "source": "a/1", "target": "b/4", "source_entity": "a", "target_entity": "b", "source_bin": 1, "target_bin": 4, "source_state": "service|l|u", "target_state": "host|h|u", "state": "call|false|[2,4)|r;u"}
    variants = [
        {}, {"source": "x/1", "target": "c/4", "source_entity": "x", "target_entity": "c"}, {"target_bin": 2}, {"source_bin": 9}, {"source_state": "service|r|u"}, {"source_state": "service|l|h"},
        {"state": "call|true|[2,4)|r;u"}, {"state": "call|false|unknown|r;u"}, {"state": "hosted_on|false|[2,4)|r;u"}, {"state": "call|false|[2,4)|h;u"},
    ]
    df = spark.createDataFrame([{**link, **v, "case_id": str(i)} for i, v in enumerate(variants)])
    codes = dict(cases.motif_codes(fragments.fragments(df, carry=cases.MOTIF)).collect())
    assert codes["0"] == codes["1"] and len(set(codes.values())) == len(variants) - 1


def test_motif_code_is_the_least_over_all_orders():
    import json
    import random

    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(2, 4)
        nodes, cell = [(rng.choice(["s", "s|l", "h"]),) for _ in range(n)], [[rng.choice(["before", "unknown"]) for _ in range(n)] for _ in range(n)]
        same, edges = [[rng.random() < 0.5 for _ in range(n)] for _ in range(n)], [(rng.randrange(n), rng.randrange(n), rng.choice("xy")) for _ in range(3)]
        texts = []
        for o in itertools.permutations(range(n)):
            at = {v: i for i, v in enumerate(o)}
            full = [[list(nodes[v]) for v in o], [[same[a][b] for b in o] for a in o], [[cell[a][b] for b in o] for a in o], sorted([at[a], at[b], x] for a, b, x in edges)]
            texts.append(json.dumps(full, separators=(",", ":")))
        assert cases.motif_code(nodes, edges, same, cell) == min(texts)


def test_mask_blocks_are_of_the_whole_case_with_logs(spark):
    import math
    from collections import Counter, defaultdict

    from tremolith.plans import graphs, reference

    sf = "/root/testdata/sf0.001"
    delta = reference.statistics.grid_interval(reference._pool(reference.samples(spark, sf)), "series_id", "time", "seq").first().delta
    window = {r.case_id: r for r in reference.cases(spark, sf).collect()}
    z = defaultdict(float)
    inside = lambda r: window[r.case_id].reference_start <= r.time < window[r.case_id].incident_end
    at = lambda r: math.floor((r.time - window[r.case_id].reference_start) / delta)
    for r in reference._scaled(spark, sf).where("supported").select("case_id", "modality", "owner", "time", "z").collect():
        if inside(r):
            k = (r.case_id, "node" if r.modality == "metric" else "edge", r.owner, at(r))
            z[k] = max(z[k], abs(r.z))
    for r in reference.logs(spark, sf).select("case_id", "owner", "time").collect():
        if r.case_id in window and inside(r):
            z[r.case_id, "node", r.owner, at(r)] += 0.0
    found = graphs.mask_block_sample(spark, sf).collect()
    assert Counter(r.case_id for r in found) == {c: math.ceil(0.2 * n) for c, n in Counter(k[0] for k in z).items() if n > 1}
    assert all((z[r.case_id, r.unit, r.owner, r.bin] > 1) >= (r.reason == "response") and (r.case_id, r.unit, r.owner, r.bin) in set(z) for r in found)


def test_every_anchor_keeps_its_share_of_fragments(spark):
    ends = [("h", f"x{i}") for i in range(12)] + [("r", "q"), ("q", "p")]
    links = [("c", i, f"{a}/0", f"{b}/0", a, b) for i, (a, b) in enumerate(ends)]
    found = fragments.fragments(spark.createDataFrame(links, "case_id string, edge bigint, source string, target string, source_entity string, target_entity string"))
    kept = rows(fragments.anchor_sample(found))
    assert len({tuple(e) for _, e, _ in kept}) == len(kept)
    of = lambda sets: {a: sum(any(a in ends[i] for i in e) for e in sets) for a in "hrqp"}
    every, mine = of([r.edges for r in found.collect()]), of([e for _, e, _ in kept])
    assert all(mine[a] >= min(8, every[a]) for a in mine) and (mine["r"], mine["q"], mine["p"]) == (2, 3, 2)
    assert len(kept) <= 8 * 16 < found.count()


def test_long_paths_are_sound_and_cycles_of_any_component_are_found(spark):
    from tremolith.operators import annotations

    def doc(name, pairs, paths):
        edges = [{"id": str(i), "source_event": a, "target_event": b, "temporal_order": "before"} for i, (a, b) in enumerate(pairs)]
        return {"doc": name, "fragments": [{"id": "g", "event_ids": sorted({v for p in pairs for v in p}), "ordered_paths": paths, "edges": edges}]}

    long = [f"v{i:02d}" for i in range(41)]
    docs = [
        doc("long", list(zip(long, long[1:])), [long]), doc("short", list(zip(long, long[1:])), [long[:17]]),
        doc("apart", [("a", "b"), ("x", "y"), ("y", "x")], [["a", "b"]]), doc("fork", [("a", "b"), ("a", "c"), ("a", "b")], [["a", "c"], ["a", "b"]]), doc("none", [], []),
    ]
    full = [{f: d.get(f) for f in spark.createDataFrame([], annotations.SCHEMA).columns} for d in docs]
    found = {r.doc: r.message for r in annotations.ordered_paths(spark.createDataFrame(full, annotations.SCHEMA)).collect()}
    assert found == {"short": "not all maximal paths, or others", "apart": "the order has a cycle"}


def test_ledgers_hold_every_log_record(spark):
    from tremolith.plans import graphs, reference

    sf = "/root/testdata/sf0.001"
    failed, want = {}, []
    for r in sorted(reference.logs(spark, sf).collect(), key=lambda r: r.log_id):
        key = (r.case_id, r.owner, r.log_id % 7)
        want.append((r.case_id, r.owner, r.log_id, failed.get(key, -1)))
        if r.log_id % 3 == 0:
            failed[key] = r.log_id
    assert rows(graphs.retry_links(spark, sf)) == sorted(want, key=repr)
    assert sum(r.attempts for r in graphs.ledger_summary(spark, sf).collect()) == len(want)
