"""Composed forward passes over one case: frontend, structural tokens of fragments, candidate scores, source decoding, losses.

A case is a dictionary of arrays, bounded by its catalog, its bins and its sampled fragments:

* ``types`` [N] categories of entities, ``candidate`` [N]; ``relations`` [E, 3] (source, target, kind), ``active`` [E, T];
* ``series``: dictionaries with ``edge`` (a relation's, not an entity's), ``owner``, ``channel``, ``time``, ``bin``, ``visible``, ``value`` (z-scores);
* ``logs``: ``owner``, ``bin``, ``vector``, ``frequency``, ``elapsed`` arrays;
* ``fragments``: dictionaries with ``entity``, ``bin``, ``start``, ``end``, ``category`` of their events and ``source``, ``target``, ``kind``,
  ``response``, ``owner`` of their edges (positions in the fragment; owner -1 for none).

Weights are a dictionary of arrays; :func:`shapes` names them. Nothing here is trained.
"""

from __future__ import annotations

import itertools
import json
from collections import defaultdict
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from tremolith.operators.neural import gelu, seeded, softmax

WIDTH, ROLE, EVENTS, EDGES, Q = 64, 32, 4, 3, 8
LAGS = (0, 1, 2, 4, 8)
PENALTY = 0.5


def shapes(types: int, kinds: int, channels: int, text: int = 384) -> dict[str, tuple[int, ...]]:
    """Names and shapes of all weights."""
    code = EVENTS * types + 2 * kinds * EVENTS**2 + EVENTS**2 + 4 * EVENTS**2 + 4 * EVENTS + EVENTS + EDGES
    edge = WIDTH + 4
    step = 2 * WIDTH + edge + kinds + ROLE + 12
    token = 2 * WIDTH + 1 + 2 * WIDTH + EDGES * edge + ROLE + 6 * EVENTS
    out: dict[str, tuple[int, ...]] = {}

    def linear(name: str, to: int, frm: int, bias: bool = True) -> None:
        out[name] = (to, frm)
        if bias:
            out[f"{name}_b"] = (to,)

    for m in ("metric", "trace"):
        out |= {f"{m}_k1": (WIDTH, 3, 3), f"{m}_k1_b": (WIDTH,), f"{m}_k2": (WIDTH, WIDTH, 3), f"{m}_k2_b": (WIDTH,), f"{m}_channel": (channels, WIDTH)}
        linear(f"{m}_pool", WIDTH, 2 * WIDTH)
    linear("mix", WIDTH, WIDTH * (1 + 2 * kinds)); linear("log1", WIDTH, text + 2); linear("log2", WIDTH, WIDTH)  # noqa: E702
    linear("topology", WIDTH, types + 2 * kinds); linear("local", WIDTH, 2 * WIDTH); linear("fusion", WIDTH, 3 * WIDTH + 6)  # noqa: E702
    for layer in range(2):
        linear(f"own{layer}", WIDTH, WIDTH)
        out[f"kind{layer}"] = (kinds, WIDTH, WIDTH)
    linear("role", ROLE, code); linear("step1", 64, step); linear("step2", Q - 1, 64); linear("path1", 64, 1 + Q + Q * Q + ROLE + 1); linear("path2", WIDTH, 64)  # noqa: E702
    linear("token1", 64, token); linear("token2", WIDTH, 64)  # noqa: E702
    for r, extra in (("read", 0), ("timed", 3)):
        linear(f"{r}_z", 64, WIDTH, False); linear(f"{r}_role", 64, ROLE, False); linear(f"{r}_logit", 1, 64, False); linear(f"{r}_value", WIDTH, WIDTH + ROLE + extra)  # noqa: E702
    linear("timed_time", 64, 3, False)
    linear("rank1", 64, 3 * WIDTH + 7); linear("rank2", 1, 64)  # noqa: E702
    linear("driver1", 16, WIDTH, False); linear("driver2", 8, 16, False); linear("self", WIDTH, WIDTH, False)  # noqa: E702
    out |= {"inject": (types, WIDTH, 8), "carry": (kinds, WIDTH, WIDTH)}
    linear("attend1", WIDTH, 5 * kinds + 2 * types + len(LAGS) + 1, False); linear("attend2", 1, WIDTH, False)  # noqa: E702
    linear("head_metric", channels, WIDTH, False); linear("head_log", 1, WIDTH, False); linear("head_text", text, WIDTH, False); linear("head_trace", channels, 2 * WIDTH, False)  # noqa: E702
    return out


def weights(types: int, kinds: int, channels: int, text: int = 384, seed: int = 0) -> dict[str, np.ndarray]:
    """Seeded weights; the same seed and vocabulary sizes give the same ones."""
    return seeded(shapes(types, kinds, channels, text), seed)


def _linear(w: dict, name: str, x: np.ndarray) -> np.ndarray:
    y = x @ w[name].T
    return y + w[f"{name}_b"] if f"{name}_b" in w else y


def _norm(x: np.ndarray) -> np.ndarray:
    """Layer normalisation."""
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


def convolved(inputs: Sequence[np.ndarray], w: dict, modality: str) -> list[np.ndarray]:
    """Two convolutions of width three over sequences [time, 3]; those of one length go together, none is padded by another."""
    by_length = defaultdict(list)
    for i, x in enumerate(inputs):
        by_length[len(x)].append(i)
    out: list[np.ndarray] = [np.empty(0)] * len(inputs)
    for members in by_length.values():
        x = np.stack([inputs[i] for i in members])
        for k in ("k1", "k2"):
            windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (1, 1), (0, 0))), 3, axis=1)
            x = gelu(np.einsum("btiw,oiw->bto", windows, w[f"{modality}_{k}"]) + w[f"{modality}_{k}_b"])
        for i, y in zip(members, x):
            out[i] = y
    return out


def _numeric(case: dict, w: dict, edge: bool, owners: int, bins: int) -> dict[str, np.ndarray]:
    """Per owner and bin: ``state`` from visible positions, ``recovery`` from those with a visible one within two, ``seen``,
    ``context`` and ``coverage``. Channels are pooled by mean and maximum."""
    modality = "trace" if edge else "metric"
    series = [s for s in case["series"] if bool(s["edge"]) == edge and len(s["time"])]
    inputs = [np.stack([np.where(s["visible"], s["value"], 0.0), s["visible"].astype(float), np.diff(s["time"], prepend=s["time"][0])], 1) for s in series]
    total, seen = np.zeros((owners, bins)), np.zeros((owners, bins))
    channels = {"state": defaultdict(list), "recovery": defaultdict(list)}
    for s, h in zip(series, convolved(inputs, w, modality)):
        h = h + w[f"{modality}_channel"][s["channel"]]
        near = np.convolve(s["visible"].astype(int), np.ones(5, int), "same")[: len(h)] > 0 if len(h) >= 5 else np.array([s["visible"][max(0, j - 2) : j + 3].any() for j in range(len(h))])
        np.add.at(total, (s["owner"], s["bin"]), 1)
        np.add.at(seen, (s["owner"], s["bin"]), s["visible"].astype(float))
        for name, keep in (("state", s["visible"]), ("recovery", near)):
            for b in np.unique(s["bin"][keep]):
                channels[name][s["owner"], int(b)].append(h[keep & (s["bin"] == b)].mean(0))
    out = {"seen": seen > 0, "coverage": seen / np.maximum(total, 1)}
    for name, held in channels.items():
        pooled, there = np.zeros((owners, bins, WIDTH)), np.zeros((owners, bins), bool)
        for (v, b), hs in held.items():
            pooled[v, b] = _linear(w, f"{modality}_pool", np.r_[np.mean(hs, 0), np.max(hs, 0)])
            there[v, b] = True
        out[name] = pooled
        out["context" if name == "recovery" else "valid"] = there
    return out


def pooled_logs(case: dict, w: dict, n: int, bins: int, radius: float) -> dict[str, np.ndarray]:
    """Frequency-weighted means of encoded logs per entity and bin, and of those within ``radius`` bins of a bin's middle."""
    logs = case["logs"]
    x = gelu(_linear(w, "log2", gelu(_linear(w, "log1", np.c_[logs["vector"], np.log1p(logs["frequency"]), logs["elapsed"]])))) if len(logs["owner"]) else np.zeros((0, WIDTH))
    state, wide = np.zeros((n, bins, WIDTH)), np.zeros((n, bins, WIDTH))
    mass, reach = np.zeros((n, bins)), np.zeros((n, bins))
    f = np.asarray(logs["frequency"], float)
    np.add.at(state, (logs["owner"], logs["bin"]), x * f[:, None])
    np.add.at(mass, (logs["owner"], logs["bin"]), f)
    near = np.abs(np.asarray(logs["elapsed"])[:, None] / case["delta"] - (np.arange(bins) + 0.5)) <= radius
    for j in range(len(f)):
        wide[logs["owner"][j], near[j]] += x[j] * f[j]
        reach[logs["owner"][j], near[j]] += f[j]
    return {"state": state / np.maximum(mass, 1e-300)[..., None] * (mass > 0)[..., None], "seen": mass > 0, "recovery": wide / np.maximum(reach, 1e-300)[..., None] * (reach > 0)[..., None], "context": reach > 0}


def frontend(case: dict, w: dict, kinds: int, radius: float = 2.0) -> dict[str, np.ndarray]:
    """Fused states ``h`` [N, T, width] and what they were made of.

    Numbers of an entity and of its active, measured relations are mixed; topology runs through two layers of typed means;
    logs are pooled. What isn't there is 0 and marked in ``availability`` and ``coverage`` (numbers, logs, topology)."""
    types, rel, active = case["types"], np.asarray(case["relations"], int).reshape(-1, 3), case["active"]
    n, bins = len(types), active.shape[1]
    metric, trace = _numeric(case, w, False, n, bins), _numeric(case, w, True, len(rel), bins)
    logs = pooled_logs(case, w, n, bins, radius)
    measured = active & trace["seen"]
    pieces, seen, coverage, degree = [metric["state"] * metric["seen"][..., None]], [metric["seen"]], [metric["coverage"]], []
    for end in (1, 0):  # arriving, leaving
        for k in range(kinds):
            mine = np.flatnonzero(rel[:, 2] == k)
            count, attached, total, cov = np.zeros((n, bins)), np.zeros((n, bins)), np.zeros((n, bins, WIDTH)), np.zeros((n, bins))
            np.add.at(attached, rel[mine, end], active[mine].astype(float))
            np.add.at(count, rel[mine, end], measured[mine].astype(float))
            np.add.at(total, rel[mine, end], trace["state"][mine] * measured[mine][..., None])
            np.add.at(cov, rel[mine, end], trace["coverage"][mine] * measured[mine])
            pieces.append(total / np.maximum(count, 1)[..., None]); seen.append(count > 0); coverage.append(cov / np.maximum(count, 1)); degree.append(attached)  # noqa: E702
    has_numbers = np.any(seen, 0)
    numeric = _linear(w, "mix", np.concatenate(pieces, -1)) * has_numbers[..., None]
    has_topology = np.any(np.array(degree) > 0, 0)
    onehot = np.broadcast_to(np.eye(w["topology"].shape[1] - 2 * kinds)[types][:, None], (n, bins, w["topology"].shape[1] - 2 * kinds))
    top = _linear(w, "topology", np.concatenate([onehot, np.log1p(np.stack(degree, -1))], -1))
    for layer in range(2):
        out = _linear(w, f"own{layer}", top)
        for k in range(kinds):
            mine = np.flatnonzero(rel[:, 2] == k)
            total, count = np.zeros_like(top), np.zeros((n, bins))
            np.add.at(total, rel[mine, 1], top[rel[mine, 0]] * active[mine][..., None])
            np.add.at(count, rel[mine, 1], active[mine].astype(float))
            out = out + (total / np.maximum(count, 1)[..., None]) @ w[f"kind{layer}"][k].T
        top = gelu(out) * has_topology[..., None]
    availability = np.stack([has_numbers, logs["seen"], has_topology], -1)
    covered = np.stack([np.mean(coverage, 0), logs["seen"], has_topology], -1).astype(float)
    h = _norm(_linear(w, "fusion", np.concatenate([numeric, logs["state"], top, availability, covered], -1))) * availability.any(-1)[..., None]
    local_seen, local_near = metric["seen"] | logs["seen"], metric["context"] | logs["context"]
    return {
        "h": h, "availability": availability, "coverage": covered, "edge": trace["state"], "edge_seen": trace["seen"], "edge_recovery": trace["recovery"], "edge_context": trace["context"],
        "local": _linear(w, "local", np.concatenate([metric["state"], logs["state"]], -1)) * local_seen[..., None], "local_seen": local_seen,
        "recovery": _linear(w, "local", np.concatenate([metric["recovery"], logs["recovery"]], -1)) * local_near[..., None], "context": local_near, "log_context": logs["context"], "telemetry": has_numbers | logs["seen"],
    }


@lru_cache(maxsize=8)
def _orders(n: int) -> np.ndarray:
    return np.array(list(itertools.permutations(range(n))))


def structural_code(f: dict, types: int, kinds: int, candidate: int | None = None, ends: tuple[int, int] | None = None, branch: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_structural_code` of what the code depends on, which recurs and is kept for a bounded number of structures."""
    start, end, entity = (np.asarray(f[c], float) for c in ("start", "end", "entity"))
    order = np.where(end[:, None] < start[None], 0, np.where(end[None] < start[:, None], 1, 2))
    mine = entity == candidate if candidate is not None else np.zeros(len(entity), bool)
    whole = lambda a: tuple(int(x) for x in np.ravel(a))
    return _structural_code(types, kinds, whole(f["category"]), whole(entity[:, None] == entity[None]), whole(order), whole(f["source"]), whole(f["target"]), whole(f["kind"]), whole(f["response"]), whole(mine), ends, tuple(sorted(branch)))


@lru_cache(maxsize=2_048)
def _structural_code(types: int, kinds: int, category: tuple, equal: tuple, relation: tuple, source: tuple, target: tuple, kind: tuple, response: tuple, mine: tuple, ends: tuple | None, branch: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The least code of a fragment over all orders of its events, and the orders that give it.

    A code holds categories, typed adjacency, equality of entities, order in time, marks and what is there; no names. All
    orders are written at once as the rows of one matrix, whose least row is found by sorting."""
    n = len(category)
    p = _orders(n)
    categories = np.zeros((len(p), EVENTS, types), int)
    categories[:, :n] = np.eye(types, dtype=int)[np.array(category)][p]
    links = np.zeros((n, n, 2 * kinds), int)
    np.add.at(links, (list(source), list(target), 2 * np.array(kind) + np.array(response)), 1)
    adjacency = np.zeros((len(p), EVENTS, EVENTS, 2 * kinds), int)
    adjacency[:, :n, :n] = links[p[:, :, None], p[:, None, :]]
    same = np.zeros((len(p), EVENTS, EVENTS), int)
    same[:, :n, :n] = np.reshape(equal, (n, n))[p[:, :, None], p[:, None, :]]
    order = np.full((len(p), EVENTS, EVENTS), 3)
    order[:, :n, :n] = np.reshape(relation, (n, n))[p[:, :, None], p[:, None, :]]
    at = np.arange(n)
    flags = np.stack([np.array(mine), at == (ends[0] if ends else -1), at == (ends[1] if ends else -1), np.isin(at, list(branch))], -1).astype(int)
    marks = np.zeros((len(p), EVENTS, 4), int)
    marks[:, :n] = flags[p]
    there = np.r_[np.arange(EVENTS) < n, np.arange(EDGES) < len(source)].astype(int)
    flat = np.concatenate([a.reshape(len(p), -1) for a in (categories, adjacency, same, np.eye(4, dtype=int)[order], marks)] + [np.tile(there, (len(p), 1))], 1)
    least = flat[np.lexsort(flat.T[::-1])[0]]
    return least, p[(flat == least).all(1)]


def time_paths(f: dict) -> list[tuple[int, ...]]:
    """Edges of every maximal path along edges whose source ends before their target starts."""
    start, end = f["start"], f["end"]
    ahead = [k for k, (s, t) in enumerate(zip(f["source"], f["target"])) if end[s] < start[t]]
    begins = [k for k in ahead if all(f["target"][j] != f["source"][k] for j in ahead)]
    done, open_ = [], [(k,) for k in begins]
    while open_:
        path = open_.pop()
        more = [k for k in ahead if f["source"][k] == f["target"][path[-1]]]
        open_ += [(*path, k) for k in more]
        if not more:
            done.append(path)
    return sorted(done)


def signature(steps: np.ndarray) -> np.ndarray:
    """1, first and second order of the signature of a path with these increments [steps, q]."""
    before = np.cumsum(steps, 0) - steps
    return np.r_[1.0, steps.sum(0), (before.T @ steps + 0.5 * steps.T @ steps).ravel()]


def token(f: dict, front: dict, w: dict, types: int, kinds: int, candidate: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The unit vector of a fragment, and its role code's projection; ``candidate`` marks an entity.

    The mean over all orders of events that give the least code, and of parallel edges that nothing tells apart."""
    roles: dict = {}

    def role(ends=None, branch=()):
        key = (ends, tuple(sorted(branch)))
        if key not in roles:
            roles[key] = _linear(w, "role", structural_code(f, types, kinds, candidate, ends, branch)[0].astype(float))
        return roles[key]

    _, mappings = structural_code(f, types, kinds, candidate)
    v, b = np.asarray(f["entity"]), np.asarray(f["bin"])
    h, avail, cover = front["h"][v, b], front["availability"][v, b].astype(float), front["coverage"][v, b]
    middle = (np.asarray(f["start"]) + np.asarray(f["end"])) / 2
    k_edges = len(f["source"])
    paths = time_paths(f)
    outputs = []
    for mapping in mappings:
        place = np.empty(len(v), int)
        place[mapping] = np.arange(len(v))
        slots = []
        for s, t, o, back in zip(f["source"], f["target"], f["owner"], f["response"]):
            now = 1.0 if place[s] <= place[t] else -1.0
            state, extra = np.zeros(WIDTH), [0.0, 0.0, 0.0, now]
            if o >= 0:
                lo, hi = sorted((b[s], b[t]))
                ok = front["edge_seen"][o, lo : hi + 1]
                extra[2] = now * (-1.0 if back else 1.0)
                if ok.any():
                    state, extra[0], extra[1] = front["edge"][o, lo : hi + 1][ok].mean(0), 1.0, ok.mean()
            slots.append(np.r_[state, extra])
        branches = []
        for path in paths:
            steps = []
            for k in path:
                s, t = f["source"][k], f["target"][k]
                x = np.r_[h[s], h[t], slots[k], np.eye(kinds)[f["kind"][k]], role((s, t)), avail[s], avail[t], cover[s], cover[t]]
                steps.append(np.r_[_linear(w, "step2", gelu(_linear(w, "step1", x))), middle[t] - middle[s]])
            on = {x for k in path for x in (f["source"][k], f["target"][k])}
            branches.append(_linear(w, "path2", gelu(_linear(w, "path1", np.r_[signature(np.array(steps)), role(branch=on), 1.0]))))
        pooled = np.r_[np.mean(branches, 0), np.max(branches, 0), len(branches)] if branches else np.zeros(2 * WIDTH + 1)
        local = front["local"][v, b][mapping][avail[mapping][:, :2].any(1)]
        locals_ = np.r_[local.mean(0), local.max(0)] if len(local) else np.zeros(2 * WIDTH)
        pad = lambda a: np.r_[a[mapping], np.zeros((EVENTS - len(v), 3))].ravel()
        key = lambda k: (place[f["source"][k]], place[f["target"][k]], f["kind"][k], bool(f["response"][k]))
        groups = [list(g) for _, g in itertools.groupby(sorted(range(k_edges), key=key), key=key)]
        for chosen in itertools.product(*(itertools.permutations(g) for g in groups)):
            edges = [slots[k] for g in chosen for k in g] + [np.zeros(WIDTH + 4)] * (EDGES - k_edges)
            outputs.append(_linear(w, "token2", gelu(_linear(w, "token1", np.r_[pooled, locals_, np.concatenate(edges), role(), pad(avail), pad(cover)]))))
    y = np.mean(outputs, 0)
    length = np.linalg.norm(y)
    return (y / length if length > 1e-12 else np.eye(WIDTH)[0]), role()


def _readout(w: dict, name: str, z: np.ndarray, roles: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    key = _linear(w, f"{name}_z", z) + _linear(w, f"{name}_role", roles) + (0 if times is None else _linear(w, f"{name}_time", times))
    a = softmax(_linear(w, f"{name}_logit", np.tanh(key))[:, 0])
    return a @ _linear(w, f"{name}_value", np.concatenate([z, roles] + ([] if times is None else [times]), 1))


def scores(case: dict, w: dict, kinds: int) -> dict:
    """Scores of the candidates (``score``, in order of position), unmarked ``tokens`` of the fragments, ``marked`` ones by entity."""
    front, types = frontend(case, w, kinds), w["topology"].shape[1] - 2 * kinds
    fragments = case["fragments"]
    marked = defaultdict(list)
    for i, f in enumerate(fragments):
        for v in sorted(set(f["entity"])):
            marked[v].append((*token(f, front, w, types, kinds, v), i))
    out = []
    for v in np.flatnonzero(case["candidate"]):
        local = front["local"][v][front["local_seen"][v]]
        pooled = np.r_[local.mean(0), local.max(0)] if len(local) else np.zeros(2 * WIDTH)
        process = _readout(w, "read", np.stack([z for z, _, _ in marked[v]]), np.stack([r for _, r, _ in marked[v]])) if v in marked else np.zeros(WIDTH)
        x = np.r_[pooled, process, front["availability"][v].mean(0), front["coverage"][v].mean(0), v in marked]
        out.append(_linear(w, "rank2", gelu(_linear(w, "rank1", x)))[0])
    return {"score": np.array(out), "front": front, "tokens": np.array([token(f, front, w, types, kinds)[0] for f in fragments]).reshape(-1, WIDTH), "marked": dict(marked)}


def symptom_rows(case_id: str, front: dict, entities: Sequence[str], relations: Sequence[str]) -> list[dict]:
    """Observed local states of entities and relations, one row per bin: ``case_id``, ``kind``, ``provenance``, ``vec``, ``observed``, as
    ``selection.symptom_tokens`` takes them. Names are provenance only; nothing fused, predicted or structural is read."""
    out = []
    for kind, states, seen, names in (("node", front["local"], front["local_seen"], entities), ("edge", front["edge"], front["edge_seen"], relations)):
        if len(set(names)) != len(names) or len(names) != len(states):
            raise ValueError("states need one name each")
        for v, b in zip(*np.nonzero(seen)):
            out.append({"case_id": case_id, "kind": kind, "provenance": json.dumps([kind, names[v], int(b)], separators=(",", ":")), "vec": states[v, b].tolist(), "observed": True})
    return out


def process_at(found: dict, case: dict, w: dict, entity: int, time: float) -> np.ndarray | None:
    """An entity's process as seen from a time; None where no fragment has it."""
    if entity not in found["marked"]:
        return None
    z, roles, at = zip(*found["marked"][entity])
    relative = []
    for i in at:
        d = (np.asarray(case["fragments"][i]["start"]) + np.asarray(case["fragments"][i]["end"])) / 2 - time
        relative.append([d.mean(), d.min(), d.max()])
    return _readout(w, "timed", np.stack(z), np.stack(roles), np.array(relative))


def decoded(h: np.ndarray, visible: np.ndarray, types: np.ndarray, relations: np.ndarray, active: np.ndarray, sources: np.ndarray, w: dict, layers: int = 3) -> np.ndarray:
    """States [sets, N, T, width] that spread from the entities of each source set along active relations.

    One driver, pooled over what is visible, is injected at the sources; each layer mixes the sources' states at the lags,
    weighted by a softmax over all (relation, lag) that reach an entity and bin, from structure alone."""
    n, bins, _ = h.shape
    rel = np.asarray(relations, int).reshape(-1, 3)
    n_types, kinds = w["inject"].shape[0], w["carry"].shape[0]
    pooled = (h * visible[..., None]).sum(0) / np.maximum(visible.sum(0), 1)[:, None]
    driver = np.tanh(_linear(w, "driver2", np.tanh(_linear(w, "driver1", pooled))))
    injected = np.einsum("nwd,td->ntw", w["inject"][types], driver)[None] * sources[:, :, None, None]
    degree = np.zeros((n, 2 * kinds))
    np.add.at(degree, (rel[:, 1], rel[:, 2]), 1)
    np.add.at(degree, (rel[:, 0], kinds + rel[:, 2]), 1)
    degree = np.log1p(degree)
    context = np.concatenate([np.eye(kinds)[rel[:, 2]], np.eye(n_types)[types[rel[:, 0]]], np.eye(n_types)[types[rel[:, 1]]], degree[rel[:, 0]], degree[rel[:, 1]]], 1)
    x = np.concatenate([np.repeat(context[:, None], len(LAGS), 1), np.broadcast_to(np.eye(len(LAGS)), (len(rel), len(LAGS), len(LAGS))), np.ones((len(rel), len(LAGS), 1))], 2)
    logits = _linear(w, "attend2", np.tanh(_linear(w, "attend1", x)))[..., 0]
    # weight of every (relation, lag, bin): exponentials, divided by their sum per receiving entity and bin
    open_ = np.stack([active & (np.arange(bins) >= lag) for lag in LAGS], 1)
    e = np.exp(logits - logits.max() if logits.size else logits)[..., None] * open_
    total = np.zeros((n, bins))
    np.add.at(total, rel[:, 1], e.sum(1))
    share = e / np.maximum(total, 1e-300)[rel[:, 1]][:, None]
    states = injected
    for _ in range(layers):
        message = np.zeros_like(states)
        carried = np.stack([states @ w["carry"][k].T for k in range(kinds)])
        for k in range(kinds):
            mine = np.flatnonzero(rel[:, 2] == k)
            for j, lag in enumerate(LAGS):
                if lag < bins:
                    sent = carried[k][:, rel[mine, 0], : bins - lag] * share[mine, j, lag:][None, :, :, None]
                    np.add.at(message, (slice(None), rel[mine, 1], slice(lag, None)), sent)
        states = injected + np.tanh(_linear(w, "self", states) + message)
    return states


def heads(states: np.ndarray, relations: np.ndarray, w: dict) -> dict[str, np.ndarray]:
    """What states predict: metrics, log frequency and text per entity, traces per relation; without biases, so nothing from nothing."""
    rel = np.asarray(relations, int).reshape(-1, 3)
    pair = np.concatenate([states[:, rel[:, 0]], states[:, rel[:, 1]]], -1)
    return {m: _linear(w, f"head_{m}", x) for m, x in (("metric", states), ("log", states), ("text", states), ("trace", pair))}


def case_losses(found: dict, roots: Sequence[int] | None, energies: np.ndarray | None, sets: np.ndarray | None, true: int | None = None, temperature: float = 1.0) -> dict[str, float | None]:
    """Loss components of one case that follow from its scores and source energies; None where there is nothing to compare.

    ``pn``: mean softplus over roots and over the others, averaged; ``source``: the true set's energy and its lead over each
    wrong one; ``U_soft``: minus the soft minimum of energies under the scores' own belief in each set."""
    soft = lambda x: np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))
    s = found["score"]
    out: dict[str, float | None] = {"pn": None, "source": None, "U_soft": None}
    if roots is not None:
        root = np.isin(np.arange(len(s)), list(roots))
        out["pn"] = float(np.mean([soft(sign * s[m]).mean() for m, sign in ((root, -1), (~root, 1)) if m.any()]))
    if energies is not None and true is not None:
        wrong = np.delete(energies, true)
        out["source"] = float(energies[true] + (soft(energies[true] - wrong).mean() if len(wrong) else 0.0))
    if energies is not None and sets is not None:
        a = sets @ s - PENALTY * sets.sum(1)
        b = a - a.max() - np.log(np.exp(a - a.max()).sum()) - energies / temperature
        out["U_soft"] = float(-temperature * (b.max() + np.log(np.exp(b - b.max()).sum())))
    return out
