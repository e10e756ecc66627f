"""Forward passes of the learned parts, as array functions over one case, and their grouped-map form.

Weights are plain arrays, supplied by the caller or seeded; a case's tensors are bounded by its catalog and bins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def seeded(shapes: dict[str, Sequence[int]], seed: int = 0) -> dict[str, np.ndarray]:
    """Normal weights scaled by fan-in; vectors are 0."""
    r = np.random.default_rng(seed)
    return {k: r.normal(0, 1 / np.sqrt(np.prod(s[1:])), tuple(s)) if len(s) > 1 else np.zeros(tuple(s)) for k, s in shapes.items()}


def gelu(x: np.ndarray) -> np.ndarray:
    """x times the normal distribution function (tanh form)."""
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    """Softmax without overflow."""
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def conv(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Convolution of [time, in] with [out, in, width], padded so that the length stays."""
    width = kernel.shape[2]
    padded = np.pad(x, ((width // 2, width // 2), (0, 0)))
    windows = np.stack([padded[i : i + len(x)] for i in range(width)], axis=2)
    return np.einsum("tiw,oiw->to", windows, kernel) + bias


def series_states(value: np.ndarray, visible: np.ndarray, elapsed: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """States of a series: masked value, visibility and elapsed time through two convolutions."""
    x = np.stack([np.where(visible, value, 0.0), visible.astype(float), np.log1p(np.maximum(elapsed, 0))], axis=1)
    return gelu(conv(gelu(conv(x, weights["k1"], weights["b1"])), weights["k2"], weights["b2"]))


def bin_states(states: np.ndarray, bins: np.ndarray, visible: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean state, validity and coverage per bin over the visible positions."""
    out, seen, total = np.zeros((n, states.shape[1])), np.zeros(n), np.zeros(n)
    np.add.at(out, bins[visible], states[visible])
    np.add.at(seen, bins[visible], 1)
    np.add.at(total, bins, 1)
    return out / np.maximum(seen, 1)[:, None], seen > 0, seen / np.maximum(total, 1)


def graph_layer(nodes: np.ndarray, edges: np.ndarray, kinds: np.ndarray, active: np.ndarray, own: np.ndarray, by_kind: np.ndarray) -> np.ndarray:
    """One typed layer: a node's own state and, per kind of edge, the mean of its active in-neighbours, per bin.

    ``nodes`` [node, bin, width], ``edges`` [edge, 2], ``active`` [edge, bin], ``by_kind`` [kind, out, width].
    """
    out = nodes @ own.T
    for k in range(len(by_kind)):
        chosen = np.flatnonzero(kinds == k)
        total, count = np.zeros_like(nodes), np.zeros(nodes.shape[:2])
        np.add.at(total, edges[chosen, 1], nodes[edges[chosen, 0]] * active[chosen][:, :, None])
        np.add.at(count, edges[chosen, 1], active[chosen].astype(float))
        out = out + (total / np.maximum(count, 1)[:, :, None]) @ by_kind[k].T
    return gelu(out)


def attention(query: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values weighted by the softmax of their keys' products with the query; 0 without keys."""
    if not len(keys):
        return np.zeros(values.shape[1])
    return softmax(keys @ query / np.sqrt(len(query))) @ values


def transport(states: np.ndarray, edges: np.ndarray, logits: np.ndarray, lags: Sequence[int] = (0, 1, 2, 4, 8)) -> np.ndarray:
    """One lagged transport step: every node and bin mixes its sources' states at the lags, weighted by a softmax over
    all (edge, lag) that reach it. ``states`` [node, bin, width], ``logits`` [edge, lag]."""
    nodes, bins, _ = states.shape
    at = edges[:, 1]
    reach = np.stack([np.arange(bins) >= lag for lag in lags])
    x = np.where(reach[None], logits[:, :, None], -np.inf)
    top = np.full((nodes, bins), -np.inf)
    np.maximum.at(top, at, x.max(1))
    e = np.exp(x - np.where(np.isfinite(top), top, 0.0)[at][:, None])
    total = np.zeros((nodes, bins))
    np.add.at(total, at, e.sum(1))
    share = e / np.maximum(total, 1e-300)[at][:, None]
    out = np.zeros_like(states)
    for j, lag in enumerate(lags):
        if lag < bins:
            np.add.at(out, (at, slice(lag, None)), states[edges[:, 0], : bins - lag] * share[:, j, lag:, None])
    return out


def per_case(df: DataFrame, forward: Callable[[pd.DataFrame], pd.DataFrame], schema: str, case: str = "case_id") -> DataFrame:
    """Runs a forward pass on every case; a case is bounded by its catalog and bins."""
    return df.groupBy(case).applyInPandas(forward, schema)


def encode_series(samples: DataFrame, weights: dict[str, np.ndarray], delta: float) -> DataFrame:
    """``series_id``, ``bin``, ``state`` (array), ``coverage`` of every bin with visible readings; one series at a time."""

    def forward(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["time", "seq"])
        t = frame["time"].to_numpy()
        visible = frame["observed"].to_numpy(bool)
        bins = np.floor((t - frame["reference_start"].to_numpy()) / delta).astype(int)
        low = bins.min()
        states = series_states(frame["z"].to_numpy(float), visible, np.diff(t, prepend=t[0]), weights)
        mean, valid, coverage = bin_states(states, bins - low, visible, int(bins.max() - low) + 1)
        keep = np.flatnonzero(valid)
        return pd.DataFrame({"series_id": frame["series_id"].iloc[0], "bin": keep + low, "state": list(mean[keep]), "coverage": coverage[keep]})

    return samples.groupBy("series_id").applyInPandas(forward, "series_id bigint, bin bigint, state array<double>, coverage double")
