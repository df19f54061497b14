"""Linear-chain conditional random fields in numpy: training, marginals and best labels.

Sequences of any length are cut into chunks. The step matrices of a chunk are multiplied
for all chunks at once, the chunks of a sequence are chained, and each chunk is then
finished alone from the vectors at its edges; the result is that of one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CHUNK = 32


@dataclass
class Chain:
    """Feature weights (features x labels) and transition scores (from x to)."""

    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Label scores of tokens; ``features`` is flat, token t has those from offsets[t] to offsets[t + 1]; none is empty."""
        if len(offsets) < 2:
            return np.zeros((0, self.weights.shape[1]))
        return np.add.reduceat(self.weights[features], offsets[:-1], axis=0)


def chunked(emissions: np.ndarray, lengths: np.ndarray) -> tuple:
    """(chunks x CHUNK x labels scores, mask, first chunk and number of chunks of each sequence, where tokens went)."""
    lengths = np.asarray(lengths, np.int64)
    per = -(-lengths // CHUNK)
    first = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    where = np.repeat(first * CHUNK - start, lengths) + np.arange(lengths.sum())
    total = int(per.sum())
    scores = np.zeros((total * CHUNK, emissions.shape[1]), np.float64)
    scores[where] = emissions
    mask = np.zeros(total * CHUNK, bool)
    mask[where] = True
    return scores.reshape(total, CHUNK, -1), mask.reshape(total, CHUNK), first, per, where


def marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Probability of every label at every token, by forward-backward."""
    k = emissions.shape[1]
    if not len(emissions):
        return np.zeros((0, k))
    scores, mask, first, per, where = chunked(emissions, lengths)
    a = np.exp(transitions - transitions.max())
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    n = len(e)
    product = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(CHUNK):
        step = (product @ a) * e[:, t, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        product = np.where(mask[:, t, None, None], step, product)
    entry, leave = np.full((n, k), 1.0 / k), np.full((n, k), 1.0 / k)
    active = np.flatnonzero(per > 1)
    for c in range(1, int(per.max())):
        active = active[per[active] > c]
        at = first[active] + c
        v = (entry[at - 1][:, None, :] @ product[at - 1])[:, 0]
        entry[at] = v / v.sum(1, keepdims=True)
    active = np.flatnonzero(per > 1)
    for c in range(1, int(per.max())):
        active = active[per[active] > c]
        at = first[active] + per[active] - 1 - c
        v = (product[at + 1] @ leave[at + 1][:, :, None])[:, :, 0]
        leave[at] = v / v.sum(1, keepdims=True)
    forward = np.empty((n, CHUNK, k))
    v = entry
    for t in range(CHUNK):
        step = (v @ a) * e[:, t]
        step /= step.sum(1, keepdims=True)
        v = np.where(mask[:, t, None], step, v)
        forward[:, t] = v
    v = leave
    for t in range(CHUNK - 1, -1, -1):
        forward[:, t] *= v
        step = (v * e[:, t]) @ a.T
        step /= step.sum(1, keepdims=True)
        v = np.where(mask[:, t, None], step, v)
    forward /= forward.sum(2, keepdims=True)
    return forward.reshape(-1, k)[where]


def best_labels(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Viterbi labels, by max-plus products; the first of equally good labels at the last token, then the first best before it."""
    k = emissions.shape[1]
    if not len(emissions):
        return np.zeros(0, np.int64)
    scores, mask, first, per, where = chunked(emissions, lengths)
    n = len(scores)
    product = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(n, 0)
    for t in range(CHUNK):
        step = (product[:, :, :, None] + transitions).max(axis=2) + scores[:, t, None, :]
        product = np.where(mask[:, t, None, None], step, product)
    entry = np.zeros((n, k))
    active = np.flatnonzero(per > 1)
    for c in range(1, int(per.max())):
        active = active[per[active] > c]
        at = first[active] + c
        entry[at] = (entry[at - 1][:, :, None] + product[at - 1]).max(axis=1)
    pointers = np.empty((n, CHUNK, k), np.int64)
    v = entry
    for t in range(CHUNK):
        options = v[:, :, None] + transitions
        pointers[:, t] = options.argmax(axis=1)
        v = np.where(mask[:, t, None], options.max(axis=1) + scores[:, t], v)
    labels = np.zeros((n, CHUNK), np.int64)
    # Trace back all last chunks, then all chunks before them, and so on.
    state = np.zeros(len(per), np.int64)
    active = np.flatnonzero(per > 0)
    for c in range(int(per.max())):
        active = active[per[active] > c]
        at = first[active] + per[active] - 1 - c
        s = v[at].argmax(axis=1) if c == 0 else state[active]
        for t in range(CHUNK - 1, -1, -1):
            on = mask[at, t]
            labels[at, t] = s
            s = np.where(on, pointers[at, t, s], s)
        state[active] = s
    return labels.reshape(-1)[where]


def train(windows: list[tuple[list[np.ndarray], np.ndarray]], n_features: int, k: int, epochs: int = 4, batch: int = 32, rate: float = 0.3, ridge: float = 1e-5, seed: int = 3) -> Chain:
    """Maximum likelihood by AdaGrad over windows (feature ids of each token, labels)."""
    w, a = np.zeros((n_features, k)), np.zeros((k, k))
    gw, ga = np.full((n_features, 1), 1e-6), np.full((k, k), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            part = [windows[i] for i in order[at : at + batch]]
            tokens = [f for features, _ in part for f in features]
            flat, sizes = np.concatenate(tokens), np.array([len(f) for f in tokens])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            lengths = np.array([len(y) for _, y in part])
            y = np.concatenate([y for _, y in part])
            e = np.add.reduceat(w[flat], offsets[:-1], axis=0)
            p = marginals(e, lengths, a)
            expected = pairs(e, lengths, a)
            inner = np.ones(len(y), bool)
            inner[np.cumsum(lengths) - 1] = False
            seen = np.zeros((k, k))
            here = np.flatnonzero(inner)
            np.add.at(seen, (y[here], y[here + 1]), 1)
            d = p
            d[np.arange(len(y)), y] -= 1
            rows, place = np.unique(flat, return_inverse=True)
            g = np.zeros((len(rows), k))
            np.add.at(g, place, np.repeat(d, sizes, axis=0))
            g = g / len(part) + ridge * w[rows]
            gw[rows] += (g * g).sum(1, keepdims=True)
            w[rows] -= rate * g / np.sqrt(gw[rows])
            g = (expected - seen) / len(part) + ridge * a
            ga += g * g
            a -= rate * g / np.sqrt(ga)
    return Chain(w, a)


def pairs(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected number of each transition between neighbours, over short sequences."""
    k, longest, n = emissions.shape[1], int(lengths.max()), len(lengths)
    e, a = np.ones((n, longest, k)), np.exp(transitions)
    mask = np.arange(longest) < lengths[:, None]
    e[mask] = np.exp(emissions - emissions.max(1, keepdims=True))
    alpha, beta = np.empty((n, longest, k)), np.ones((n, longest, k))
    v = np.full((n, k), 1.0 / k)
    for t in range(longest):
        v = (v @ a) * e[:, t]
        v /= v.sum(1, keepdims=True)
        alpha[:, t] = v
    for t in range(longest - 2, -1, -1):
        v = (beta[:, t + 1] * e[:, t + 1]) @ a.T
        v /= v.sum(1, keepdims=True)
        beta[:, t] = np.where(mask[:, t + 1, None], v, 1.0)
    total = np.zeros((k, k))
    for t in range(longest - 1):
        joint = alpha[:, t, :, None] * a * (e[:, t + 1] * beta[:, t + 1])[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        total += joint[mask[:, t + 1]].sum(0)
    return total
