"""Forward passes against loops."""

import numpy as np

from tremolith.operators import neural


def test_conv_and_pooling():
    r = np.random.default_rng(0)
    x, k, b = r.normal(size=(6, 2)), r.normal(size=(3, 2, 3)), r.normal(size=3)
    want = np.array([[b[o] + sum(k[o, i, w] * x[t + w - 1, i] for i in range(2) for w in range(3) if 0 <= t + w - 1 < 6) for o in range(3)] for t in range(6)])
    assert np.allclose(neural.conv(x, k, b), want)
    mean, valid, coverage = neural.bin_states(np.array([[1.0], [3.0], [9.0]]), np.array([0, 0, 2]), np.array([True, True, False]), 3)
    assert mean[0, 0] == 2.0 and valid.tolist() == [True, False, False] and coverage.tolist() == [1.0, 0.0, 0.0]


def test_graph_layer_means_active_neighbours():
    nodes = np.array([[[1.0]], [[3.0]], [[10.0]]])
    edges, kinds = np.array([[0, 2], [1, 2], [2, 0]]), np.array([0, 0, 1])
    out = neural.graph_layer(nodes, edges, kinds, np.array([[True], [True], [False]]), np.zeros((1, 1)), np.array([[[1.0]], [[1.0]]]))
    assert np.allclose(out[:, 0, 0], neural.gelu(np.array([0.0, 0.0, 2.0])))


def test_transport_and_attention():
    states = np.arange(6, dtype=float).reshape(2, 3, 1)
    out = neural.transport(states, np.array([[0, 1]]), np.array([[0.0, 0.0, -50.0, -50.0, -50.0]]))
    assert np.allclose(out[1, :, 0], [0.0, 0.5, 1.5]) and (out[0] == 0).all()
    assert np.allclose(neural.attention(np.zeros(2), np.ones((2, 2)), np.array([[1.0], [3.0]])), [2.0])
    assert neural.attention(np.zeros(2), np.ones((0, 2)), np.zeros((0, 3))).tolist() == [0, 0, 0]


def test_encode_series(spark):
    rows = [(1, i, 10.0 * i, 0.1 * i, i != 2, 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, "series_id bigint, seq bigint, time double, z double, observed boolean, reference_start double")
    weights = neural.seeded({"k1": (4, 3, 3), "b1": (4,), "k2": (4, 4, 3), "b2": (4,)})
    got = {r.bin: (len(r.state), r.coverage) for r in neural.encode_series(df, weights, 20.0).collect()}
    assert got == {0: (4, 1.0), 1: (4, 0.5), 2: (4, 1.0)}
