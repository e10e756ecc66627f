"""Hand-calculated values of the incident-analysis operators."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tremolith.functions import vectors
from tremolith.operators import fragments, labels, observations, protocol, relations, schedule, selection, statistics


def test_scale_ladder(spark):
    data = [("mad", float(v)) for v in (1, 2, 3, 4, 100)] + [("std", v) for v in [0.0] * 9 + [10.0]] + [("one", 7.0)] + [("huge", v) for v in [0.0] * 9 + [1e200]]
    big = 14329019392.0
    data += [("level", v) for v in [big] * 12 + [2 * big] * 3]
    got = {r.g: (r.center, r.scale, r.observations) for r in statistics.robust_scale(spark.createDataFrame(data, "g string, v double"), ["g"], "v").collect()}
    assert got["mad"] == (3.0, pytest.approx(1.4826), 5)
    assert got["std"] == (0.0, pytest.approx(3.0), 10)
    assert got["one"] == (7.0, 1.0, 1)
    assert got["huge"] == (0.0, pytest.approx(3e199), 10)
    assert got["level"][1] == pytest.approx(0.4 * big)


def test_percentiles_of_mixed_signs(spark):
    import numpy as np

    v = [-5.0, -1e-9, 0.0, 1e-12, 3.5, 3.5, 3.5000001, 1e9, -1e9]
    got = statistics.exact_percentiles(spark.createDataFrame([(1, x) for x in v], "g int, v double"), ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.77}).first()
    assert [got.a, got.b, got.c] == pytest.approx(np.quantile(v, [0.1, 0.5, 0.77]))


def test_grid_interval(spark):
    data = [("a", 0.0, 0), ("a", 1.0, 1), ("a", 2.0, 2), ("b", 0.0, 0), ("b", 9.0, 1)]
    assert rows(statistics.grid_interval(spark.createDataFrame(data, "s string, t double, q int"), "s", "t", "q")) == [(1.0, 1)]


ACTIVE = [  # intervals, begin, until, active
    ([(1.0, 1.0)], 1.0, 2.0, True), ([(1.0, 1.0)], 0.0, 1.0, False), ([(1.0, 2.0)], 2.0, 3.0, False), ([(1.0, 2.0)], 0.0, 1.0, False), ([(1.0, 2.0)], 1.5, 1.6, True),
    ([(1.0, 2.0), (5.0, 6.0)], 3.0, 4.0, False), ([(1.0, 2.0), (5.0, 6.0)], 3.0, 5.5, True), ([], 3.0, 4.0, True), (None, 11.0, 12.0, False), ([(1.0, 2.0)], 1.5, 1.5, False),
]


def test_is_active(spark):
    df = spark.createDataFrame([(i, x, 0.0, 10.0, b, u) for i, (x, b, u, _) in enumerate(ACTIVE)], "i int, x array<struct<a:double,b:double>>, s double, e double, b double, u double")
    got = dict(df.select("i", observations.is_active(*(F.col(c) for c in "xsebu"))).collect())
    assert got == {i: want for i, (*_, want) in enumerate(ACTIVE)}


def test_owners_of_metrics(spark):
    cases = [
        ({"metric": "cpu", "service_name": " a "}, ("a", "direct")), ({"metric": "cpu", "replicaset_name": "a-56b9db98d8"}, ("a", "resource")),
        ({"metric": "cpu", "pod": "ts0/a-56b9db98d8-p9rq8"}, ("a", "resource")), ({"metric": "hubble_http_requests_total", "source_workload": "ts0/a-56b9db98d8", "destination_workload": "ts0/b", "service_name": "b"}, ("a", "hubble")),
        ({"metric": "k8s.namespace.phase", "attr.k8s.namespace.name": "n"}, (None, "namespace-only")), ({"metric": "cpu", "deployment_name": "d-56b9db98d8"}, ("d-56b9db98d8", "resource")),
    ]
    for row, want in cases:
        names = list(row)
        df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{n}` string" for n in names))
        assert tuple(df.select(observations.metric_owner(F.col("metric"), names).alias("o")).select("o.*").first()) == want
    with pytest.raises(Exception, match="no owner"):
        spark.createDataFrame([("cpu",)], "metric string").select(observations.metric_owner(F.col("metric"), ["metric"])).collect()
    with pytest.raises(ValueError):
        observations.reject_label_columns(spark.createDataFrame([(1,)], "Root_Cause_x int"))


def test_numbers_units_and_texts(spark):
    one = spark.range(1)
    got = one.select(observations.native_seconds(F.lit("4125"), "ms"), observations.number_or_nan(F.lit("")), observations.first_text(F.lit(" "), F.lit(" x ")), observations.workload_service(F.lit("ns/a-56b9db98d8-p9rq8"))).first()
    assert got[0] == 4.125 and got[1] != got[1] and got[2:] == ("x", "a")
    for bad in (observations.native_seconds(F.lit(None).cast("string"), "s"), observations.number_or_nan(F.lit("x")), observations.required_text(F.lit(" "), "id")):
        with pytest.raises(Exception):
            one.select(bad).collect()


def test_sanitize(spark):
    text = "service:checkout failed at 10.1.2.3 request_id=abc123 for 718be355-913c-9bf3-40c3-c051636d167c in xservice:checkout"
    got = spark.createDataFrame([(text,)], "t string").select(observations.sanitize(F.col("t"), ["service:checkout"])).first()[0]
    assert got == "<ENTITY> failed at <IP> request_id=<REQUEST> for <UUID> in xservice:checkout"


def test_span_join(spark):
    spans = [("t", "p", "0", "a", 0.5), ("t", "c", "p", "b", 0.625), ("t", "o", "gone", "b", 1.0), ("u", "q", None, "a", 5.0), ("u", "r", "q", "b", 5.25)]
    linked = relations.parent_links(spark.createDataFrame(spans, "trace string, span string, parent string, service string, time double"))
    assert rows(linked.select("span", "link", "parent_service")) == [("c", "call", "a"), ("o", "unresolved", None), ("p", "parentless", None), ("q", "parentless", None), ("r", "call", "a")]


CHAIN = [("c", 1, "e0", "e1", "A", "B"), ("c", 2, "e1", "e2", "B", "C"), ("c", 3, "e2", "e3", "C", "D")]
STAR = [("c", i, "e0", f"e{i}", "A", f"X{i}") for i in (1, 2, 3)]


@pytest.mark.parametrize("links,want", [
    (CHAIN, {("chain", 1): 3, ("chain", 2): 2, ("chain", 3): 1}), (STAR, {("chain", 1): 3, ("branch", 2): 3, ("branch", 3): 1}),
    ([("c", 1, "a", "c", "A", "C"), ("c", 2, "b", "c", "B", "C"), ("c", 3, "c", "d", "C", "D")], {("chain", 1): 3, ("chain", 2): 2, ("convergence", 2): 1, ("convergence", 3): 1}),
    ([("c", 1, "a", "b", "A", "A"), ("c", 2, "a", "d", "A", "D")], {("revisit", 1): 1, ("chain", 1): 1, ("revisit", 2): 1}),
])
def test_fragments(spark, links, want):
    df = spark.createDataFrame(links, "case_id string, edge bigint, source string, target string, source_entity string, target_entity string")
    assert {(r.family, r.size): r["count"] for r in fragments.fragments(df).groupBy("family", "size").count().collect()} == want


def test_occurrence_weights_and_cover(spark):
    tokens = [("a", "1", "chain", [1.0, 0.0]), ("a", "2", "chain", [1.0, 0.0]), ("a", "3", "branch", [1.0, 0.0]), ("b", "4", "chain", [1.0, 0.0])]
    df = spark.createDataFrame(tokens, "case_id string, token string, family string, vec array<double>")
    assert rows(selection.occurrence_weights(df).select("token", "weight")) == [("1", 0.125), ("2", 0.125), ("3", 0.5), ("4", 0.25)]
    t = spark.createDataFrame([("a", "1", [1.0, 0.0]), ("b", "2", [-1.0, 0.0]), ("both", "3", [1.0, 0.0]), ("both", "4", [-1.0, 0.0])], "case_id string, token string, vec array<double>")
    maxima = selection.case_maxima(t.withColumnRenamed("token", "occurrence"), t)
    weights = spark.createDataFrame([(str(i), 0.25) for i in range(1, 5)], "occurrence string, weight double")
    priority = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("both", 2.0)], "case_id string, priority double")
    assert [tuple(r) for r in selection.greedy_cover(spark, maxima, weights, priority, 2).collect()] == [(0, "both", 1.0), (1, "a", 0.0)]
    assert [r.case_id for r in selection.greedy_cover(spark, maxima, weights, priority, 2, labeled=["both"]).collect()] == ["a", "b"]


def test_time_spread_and_motifs(spark):
    cases = spark.createDataFrame([("left", 0.0, 0.0), ("middle", 2.0, 1.0), ("right", 10.0, 2.0), ("absent", None, 3.0)], "case_id string, t double, p double")
    assert [r.case_id for r in selection.time_spread(spark, cases, "t", "p", 3).collect()] == ["middle", "right", "left"]
    codes = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "z"), ("c", "z")], "case_id string, code string")
    priority = spark.createDataFrame([("c", 0.0), ("a", 1.0), ("b", 2.0)], "case_id string, priority double")
    assert [tuple(r)[1:] for r in selection.motif_cover(spark, codes, priority, 2).collect()] == [("a", 2.0), ("c", 1.0)]


def test_ranking_metrics(spark):
    scores = [("x", e, s, e in "cb") for e, s in (("a", 2.0), ("b", 2.0), ("c", 1.0))]
    ranked = selection.ranking(spark.createDataFrame(scores, "case_id string, entity string, score double, is_root boolean"))
    assert rows(ranked.select("entity", "rank")) == [("a", 1), ("b", 2), ("c", 3)]
    hits = selection.case_hits(ranked).first()
    assert [hits[f"hit_{k}"] for k in range(1, 6)] == [0, 1, 1, 1, 1]
    table = [(f"{case}", e, float(-ord(e)), e in roots) for case, roots in (("1", "a"), ("2", "ce")) for e in "abcdefgh"]
    m = selection.metric_summary(selection.case_hits(selection.ranking(spark.createDataFrame(table, "case_id string, entity string, score double, is_root boolean")))).first()
    assert (m.top135, m.avg5, m.mrr, m.root_recall_3, m.all_roots_3, m.all_roots_5) == pytest.approx((5 / 6, 0.8, 2 / 3, 0.75, 0.5, 1.0))


def test_quotas(spark):
    def quotas(sizes):
        df = spark.createDataFrame([(f"s{i}",) for i, n in enumerate(sizes) for _ in range(n)], "s string")
        return [r.quota for r in protocol.hamilton_quotas(df, "s", 30, "d", 1).orderBy("s").collect()]

    assert quotas([30, 22, 19, 1]) == [13, 9, 8, 0]
    rare = quotas([97, 1, 1, 1])
    assert rare[0] == 29 and sorted(rare[1:]) == [0, 0, 1]


def test_losses_and_diagnostics(spark):
    entries = spark.createDataFrame([("metric", "u", 1.0)] * 3 + [("metric", "v", 3.0), ("text", "w", 0.0), ("text", "w", 2.0)], "m string, u string, e double")
    # metric: (0.5 + 2.5) / 2; text: (0 + 1.5) / 2
    assert protocol.hierarchical_huber(entries, ["m", "u"], F.col("e")).first()[0] == pytest.approx((1.5 + 0.75) / 2)
    pairs = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], True), ([1.0, 0.0], [1.0, 0.0], False)], "a array<double>, b array<double>, f boolean")
    assert {r.f: r.relative for r in protocol.representation_change(pairs, "a", "b", "f").collect()} == {True: pytest.approx(2**0.5), False: 0.0}
    gap = [("one", "m", 0.2, True), ("one", "m", 0.5, False), ("one", "m", 0.7, False), ("two", "m", 0.5, True), ("two", "m", 0.3, False), ("three", "m", 1.0, False)]
    got = rows(protocol.completion_gap(spark.createDataFrame(gap, "c string, m string, e double, t boolean"), "c", "m", "e", "t"))
    assert got == [("one", pytest.approx(0.4)), ("two", pytest.approx(-0.2))]


def test_chain_faults(spark):
    chained = protocol.chain(spark.createDataFrame([("l", i, f"p{i}") for i in range(4)], "l string, s bigint, p string"), "l", "s", "p")
    assert rows(protocol.chain_faults(chained, "l")) == []
    assert rows(protocol.chain_faults(chained.withColumn("payload", F.when(F.col("sequence") == 2, "x").otherwise(F.col("payload"))), "l")) == [("l", 2, "hash")]
    assert [r.fault for r in protocol.chain_faults(chained.where("sequence <> 1"), "l").orderBy("sequence").collect()] == ["sequence", "sequence"]


def test_reservations_are_paid_before_they_are_seen(spark, tmp_path):
    answers = spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("bad", ["z"]), ("c", ["x"])], "case_id string, roots array<string>")
    candidates = spark.createDataFrame([(c, e) for c in ("a", "b", "bad", "c") for e in "xy"], "case_id string, entity string")
    ids = lambda *cs: spark.createDataFrame([(c,) for c in cs], "case_id string")
    table = labels.Reservations(spark, str(tmp_path / "labels"), answers, 3)
    table.reserve(ids("a"))
    again = labels.Reservations(spark, str(tmp_path / "labels"), answers, 3)
    assert again.summary() == {"reserved": 1, "revealed": 0, "refused": 0, "next": 1, "spent": 1} and rows(again.revealed()) == []
    with pytest.raises(ValueError, match="open"):
        again.reserve(ids("b"))
    again.reserve(ids("a"))
    assert rows(again.settle(candidates)) == [("a", ["x"])] == rows(table.settle(candidates))
    with pytest.raises(ValueError, match="first"):
        table.reserve(ids("b"), step=1)
    with pytest.raises(ValueError, match="no label"):
        table.reserve(ids("none"))
    table.reserve(ids("bad"))
    with pytest.raises(ValueError, match="outside the candidates"):
        table.settle(candidates)
    with pytest.raises(ValueError, match="closed"):
        again.reserve(ids("b"))
    with pytest.raises(ValueError, match="other labels"):
        labels.Reservations(spark, str(tmp_path / "labels"), answers, 4).summary()
    with pytest.raises(ValueError, match="budget"):
        labels.Reservations(spark, str(tmp_path / "none"), answers, 1, open_cases=5).reserve(ids("a", "b"))


def test_schedules_and_orders():
    s = schedule.Schedule()
    assert s.batches() == [5] * 6 and s.epochs() == 170 and schedule.Schedule(budget=12).batches() == [5, 5, 2]
    assert [round(s.soft(e), 2) for e in (4, 5, 6, 7, 8, 9, 20)] == [0.0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.1]
    assert schedule.seeded_priority(["c", "a", "b"], 42) == ["b", "a", "c"]
    assert [schedule.Schedule.update_slots(n) for n in (995, 169)] == [249, 43]
    assert s.stage_at(19) == ("warm-up", 19) and s.stage_at(20) == ("round 2", 0) and s.stage_at(169) == ("tail", 49)
    assert s.loss_weights(0)["U_soft"] == 0.0 and s.loss_weights(169)["U_soft"] == 0.1 and s.loss_weights(169, "A6")["U_soft"] == 0.0
    with pytest.raises(ValueError):
        s.stage_at(170)


def test_variants():
    on = lambda v: {c for c, w in schedule.Schedule().loss_weights(169, v).items() if w}
    assert on("A0") == {"pn"} and on("A1") == {"pn", "local_recovery"} and on("A2") == {"pn", "local_recovery", "process_recovery", "invariance"}
    assert on("A3") == on("A4") == on("A5") == set(schedule.COMPONENTS) and on("A6") == set(schedule.COMPONENTS) - {"U_soft"}


def test_sampled_ranks(spark):
    strata = spark.createDataFrame([("huge", 10**12, 50), ("all", 3, 3), ("none", 5, 0), ("half", 40, 20)], "s string, n bigint, k int")
    got = {}
    for r in schedule.sampled_ranks(strata, ["s"], "n", "k", seed=1).collect():
        got.setdefault(r.s, []).append(r["rank"])
    assert {k: len(set(v)) for k, v in got.items()} == {"huge": 50, "all": 3, "half": 20} and sorted(got["all"]) == [0, 1, 2]
    assert all(0 <= r < 10**12 for r in got["huge"]) and max(got["half"]) < 40
    with pytest.raises(Exception, match="no larger"):
        schedule.sampled_ranks(spark.createDataFrame([("x", 2, 3)], "s string, n bigint, k int"), ["s"], "n", "k").collect()
    spread = schedule.sampled_ranks(spark.range(4_000).selectExpr("id", "9 n", "1 k"), ["id"], "n", "k").groupBy("rank").count().collect()
    assert len(spread) == 9 and all(330 < r["count"] < 560 for r in spread)


def test_ranks_are_found_in_their_blocks(spark):
    blocks = spark.createDataFrame([("k", "a", 3), ("k", "b", 0), ("k", "c", 2), ("m", "a", 1)], "g string, b string, n bigint")
    ranks = spark.createDataFrame([("k", r) for r in (0, 2, 2, 3, 4, 5)] + [("m", 0), ("none", 0)], "g string, rank bigint")
    got = schedule.located_ranks(blocks, ranks, ["g"], ["b"], "n")
    assert rows(got) == sorted([("k", 0, "a", 0), ("k", 2, "a", 2), ("k", 2, "a", 2), ("k", 3, "c", 0), ("k", 4, "c", 1), ("m", 0, "a", 0)])


def test_decks_deal_every_case_once_a_round(spark):
    ids = spark.createDataFrame([(f"c{i}",) for i in range(9)], "case_id string")
    dealt = schedule.shuffled_decks(ids, 3).collect()
    orders = [[r.case_id for r in sorted((r for r in dealt if r["round"] == k), key=lambda r: r.place)] for k in range(3)]
    assert all(sorted(o) == sorted(orders[0]) for o in orders) and len({tuple(o) for o in orders}) == 3


def test_vectors(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]],)], "x array<array<double>>")
    got = df.select(vectors.signature_order_two(F.col("x"), 2).alias("s"), vectors.cosine(F.lit([1.0, 0.0]), F.lit([1.0, 1.0])).alias("c"), vectors.softmax_pool(F.lit([0.0, 0.0]), F.lit([1.0, 3.0])).alias("p")).first()
    assert got.s.first == [1.0, 1.0] and got.s.second == [0.5, 1.0, 0.0, 0.5] and got.c == pytest.approx(0.5**0.5) and got.p == 2.0
