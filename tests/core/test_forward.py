"""Forward passes: invariances, masks, and vectorised forms against loops."""

import itertools

import numpy as np
import pytest

from tremolith.operators import forward, neural

TYPES, KINDS, CHANNELS, TEXT = 2, 3, 4, 6


def series(edge, owner, channel, n, seed, bins):
    r = np.random.default_rng(seed)
    t = np.sort(r.uniform(0, bins * 10.0, n))
    return {"edge": edge, "owner": owner, "channel": channel, "time": t, "bin": (t // 10).astype(int), "visible": r.random(n) < 0.8, "value": r.normal(size=n)}


@pytest.fixture
def case():
    bins, r = 4, np.random.default_rng(3)
    fragment = {"entity": [0, 1, 2], "bin": [0, 1, 3], "start": [0.0, 10.0, 30.0], "end": [9.0, 19.0, 39.0], "category": [0, 0, 1], "source": [0, 1], "target": [1, 2], "kind": [0, 1], "response": [False, False], "owner": [0, -1]}
    return {
        "types": np.array([0, 0, 1]), "candidate": np.array([True, True, False]), "relations": np.array([[0, 1, 0], [1, 2, 1], [0, 2, 1]]), "active": np.array([[1, 1, 1, 1], [0, 1, 1, 0], [0, 0, 0, 0]], bool), "delta": 10.0,
        "series": [series(False, 0, 0, 9, 1, bins), series(False, 0, 1, 9, 2, bins), series(False, 2, 0, 3, 4, bins), series(True, 0, 2, 12, 5, bins)],
        "logs": {"owner": np.array([1, 1]), "bin": np.array([0, 2]), "vector": r.normal(size=(2, TEXT)), "frequency": np.array([1.0, 3.0]), "elapsed": np.array([4.0, 26.0])}, "fragments": [fragment],
    }


@pytest.fixture
def w():
    return forward.weights(TYPES, KINDS, CHANNELS, TEXT, seed=1)


def test_batches_of_a_length_equal_one_by_one(w):
    r = np.random.default_rng(0)
    xs = [r.normal(size=(n, 3)) for n in (5, 1, 5, 9)]
    for x, y in zip(xs, forward.convolved(xs, w, "metric")):
        once = neural.gelu(neural.conv(x, w["metric_k1"], w["metric_k1_b"]))
        assert np.allclose(y, neural.gelu(neural.conv(once, w["metric_k2"], w["metric_k2_b"])))


def test_what_is_missing_is_zero_and_marked(case, w):
    front = forward.frontend(case, w, KINDS)
    assert front["h"].shape == (3, 4, forward.WIDTH) and np.isfinite(front["h"]).all()
    assert (front["h"][~front["availability"].any(-1)] == 0).all() and (front["local"][~front["local_seen"]] == 0).all()
    assert front["availability"][1, :, 1].tolist() == [True, False, True, False]
    bare = {**case, "series": [], "logs": {k: v[:0] for k, v in case["logs"].items()}, "active": np.zeros((3, 4), bool)}
    assert not forward.frontend(bare, w, KINDS)["h"].any()


def shuffled(f, order, edges):
    at = {old: new for new, old in enumerate(order)}
    out = {k: [f[k][i] for i in order] for k in ("entity", "bin", "start", "end", "category")}
    return out | {k: [at[f[k][i]] for i in edges] for k in ("source", "target")} | {k: [f[k][i] for i in edges] for k in ("kind", "response", "owner")}


def test_tokens_do_not_depend_on_the_order_of_events_and_edges(case, w):
    front, f = forward.frontend(case, w, KINDS), case["fragments"][0]
    z, role = forward.token(f, front, w, TYPES, KINDS, candidate=1)
    assert np.linalg.norm(z) == pytest.approx(1)
    for order in itertools.permutations(range(3)):
        for edges in itertools.permutations(range(2)):
            y, other = forward.token(shuffled(f, order, edges), front, w, TYPES, KINDS, candidate=1)
            assert np.allclose(y, z) and np.allclose(other, role)
    assert not np.allclose(forward.token(f, front, w, TYPES, KINDS)[0], z)
    assert forward.time_paths(f) == [(0, 1)] and forward.time_paths({**f, "start": [0.0, 5.0, 30.0]}) == [(1,)]


def test_codes_are_the_least_over_all_orders():
    f = {"entity": [7, 8, 7], "start": [0, 1, 5], "end": [1, 2, 6], "category": [0, 1, 0], "source": [0, 0], "target": [1, 2], "kind": [1, 0], "response": [True, False]}
    code, mappings = forward.structural_code(f, TYPES, KINDS)
    codes = {tuple(forward.structural_code({**f, **{k: v for k, v in shuffled(f | {"bin": [0] * 3, "owner": [0] * 2}, p, (0, 1)).items() if k in f}}, TYPES, KINDS)[0]) for p in itertools.permutations(range(3))}
    assert codes == {tuple(code)} and len(mappings) == 1 and len(code) == forward.shapes(TYPES, KINDS, CHANNELS, TEXT)["role"][1]


def test_scores_and_processes(case, w):
    found = forward.scores(case, w, KINDS)
    assert found["score"].shape == (2,) and np.isfinite(found["score"]).all() and found["tokens"].shape == (1, forward.WIDTH)
    assert forward.process_at(found, case, w, 0, 5.0).shape == (forward.WIDTH,) and set(found["marked"]) == {0, 1, 2}
    alone = forward.scores({**case, "fragments": []}, w, KINDS)
    assert forward.process_at(alone, case, w, 0, 5.0) is None and not np.allclose(alone["score"], found["score"])


def test_decoding_spreads_from_sources_only_along_active_relations(case, w):
    h, visible = np.random.default_rng(2).normal(size=(3, 4, forward.WIDTH)), np.ones((3, 4), bool)
    sets = np.array([[1, 0, 0], [0, 0, 1], [0, 0, 0]], bool)
    states = forward.decoded(h, visible, case["types"], case["relations"], case["active"], sets, w)
    assert states[0, 0].any() and states[0, 1].any() and not states[2].any()
    assert not states[1, :2].any() and states[1, 2].any()  # nothing leads away from the third entity
    assert states[0, 2, 1].any() and not states[0, 2, 0].any()  # it is reached from bin 1 on
    got = forward.heads(states, case["relations"], w)
    assert got["trace"].shape == (3, 3, 4, CHANNELS) and not got["metric"][2].any()


def loop(states, edges, logits):
    """Transport entity by entity, bin by bin."""
    out = np.zeros_like(states)
    for v in range(states.shape[0]):
        for t in range(states.shape[1]):
            pairs = [(e, j) for e in np.flatnonzero(edges[:, 1] == v) for j, lag in enumerate(forward.LAGS) if lag <= t]
            if pairs:
                share = neural.softmax(np.array([logits[e, j] for e, j in pairs]))
                out[v, t] = sum(x * states[edges[e, 0], t - forward.LAGS[j]] for x, (e, j) in zip(share, pairs))
    return out


def test_transport_equals_the_loop():
    r = np.random.default_rng(6)
    states, edges, logits = r.normal(size=(4, 11, 3)), np.array([[0, 1], [2, 1], [1, 3], [0, 1]]), r.normal(size=(4, 5)) * 20
    assert np.allclose(neural.transport(states, edges, logits), loop(states, edges, logits))


def test_shares_of_one_step_equal_the_loop(case, w):
    """With the injection alone as state, one layer's message is the transport of the loop form."""
    rel, active = case["relations"][:2], np.ones((2, 4), bool)
    w = {**w, "carry": np.stack([np.eye(forward.WIDTH)] * KINDS), "self": np.zeros((forward.WIDTH, forward.WIDTH)), "attend2": np.zeros((1, forward.WIDTH))}
    h, visible, sets = np.random.default_rng(4).normal(size=(3, 4, forward.WIDTH)), np.ones((3, 4), bool), np.ones((1, 3), bool)
    injected = forward.decoded(h, visible, case["types"], rel, active, sets, w, layers=0)[0]
    one = forward.decoded(h, visible, case["types"], rel, active, sets, w, layers=1)[0]
    assert np.allclose(one, injected + np.tanh(loop(injected, rel, np.zeros((2, len(forward.LAGS))))))


def test_losses_by_hand():
    found = {"score": np.array([0.0, 0.0])}
    got = forward.case_losses(found, [0], np.array([1.0, 1.0]), np.array([[1, 0], [0, 1]], float), true=0)
    assert got["pn"] == pytest.approx(np.log(2)) and got["source"] == pytest.approx(1 + np.log(2)) and got["U_soft"] == pytest.approx(1.0)
    assert forward.case_losses(found, None, None, None) == {"pn": None, "source": None, "U_soft": None}


def test_symptoms_of_a_frontend(spark, case, w):
    from tremolith.operators.selection import symptom_tokens

    front = forward.frontend(case, w, KINDS)
    found = forward.symptom_rows("c", front, ["a", "b", "h"], ["r", "s", "t"])
    assert len(found) == front["local_seen"].sum() + front["edge_seen"].sum() and {r["kind"] for r in found} == {"node", "edge"}
    tokens = symptom_tokens(spark.createDataFrame(found, "case_id string, kind string, provenance string, vec array<double>, observed boolean"))
    assert tokens.count() == len(found) and all(np.linalg.norm(r.vec) == pytest.approx(1) for r in tokens.collect())
    with pytest.raises(ValueError):
        forward.symptom_rows("c", front, ["a", "a", "h"], ["r", "s", "t"])
