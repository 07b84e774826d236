"""Linear-chain conditional random fields in numpy: batched training, Viterbi decoding.

Chains of one batch are stepped together, longest first, so that a step is a few numpy calls for all
chains that are still running.
"""

from __future__ import annotations

import numpy as np


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-lengths, kind="stable")
    return order, -lengths[order]


def viterbi(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of chains whose emission scores (rows by labels) follow one another in emit.

    Ties take the smaller label."""
    n, k = emit.shape
    back, labels = np.zeros((n, k), np.int8), np.zeros(n, np.int64)
    starts = np.cumsum(lengths) - lengths
    order, neg = _by_length(lengths)
    score = emit.copy()
    longest = int(lengths.max(initial=0))
    for t in range(1, longest):
        at = starts[order[: np.searchsorted(neg, -t, "left")]] + t
        step = score[at - 1][:, :, None] + trans[None]
        back[at] = step.argmax(axis=1)
        score[at] += step.max(axis=1)
    some = np.flatnonzero(lengths > 0)
    labels[starts[some] + lengths[some] - 1] = score[starts[some] + lengths[some] - 1].argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        at = starts[order[: np.searchsorted(neg, -t, "left")]] + t
        labels[at - 1] = back[at, labels[at]]
    return labels


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Label marginals of each row, summed transition marginals, and the log partition sum."""
    n, k = emit.shape
    starts = np.cumsum(lengths) - lengths
    order, neg = _by_length(lengths)
    fwd, bwd = emit.copy(), np.zeros((n, k))
    longest = int(lengths.max(initial=0))
    live = [starts[order[: np.searchsorted(neg, -t, "left")]] + t for t in range(longest)]
    for at in live[1:]:
        fwd[at] += _lse(fwd[at - 1][:, :, None] + trans[None], 1)
    for at in live[:0:-1]:
        bwd[at - 1] = _lse(trans[None] + (emit[at] + bwd[at])[:, None, :], 2)
    some = lengths > 0
    z = np.zeros(len(lengths))
    z[some] = _lse(fwd[(starts + lengths - 1)[some]], 1)
    of = np.repeat(z, lengths)
    p = np.exp(fwd + bwd - of[:, None])
    pairs = np.zeros((k, k))
    for at in live[1:]:
        pairs += np.exp(fwd[at - 1][:, :, None] + trans[None] + (emit[at] + bwd[at])[:, None, :] - of[at][:, None, None]).sum(axis=0)
    return p, pairs, float(z.sum())


def train(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, n_labels: int, rounds: int = 80, rate: float = 0.15, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features by labels) and transitions of the penalised maximum likelihood, by Adam from
    zero: the same data give the same weights."""
    w, trans = np.zeros((x.shape[1], n_labels)), np.zeros((n_labels, n_labels))
    onehot = np.eye(n_labels)[y]
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(y), bool)
    inner[starts[lengths > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros_like(trans)
    np.add.at(seen, (y[at - 1], y[at]), 1)
    state = [np.zeros_like(a) for a in (w, trans, w, trans)]
    n = max(1, len(y))
    for step in range(1, rounds + 1):
        p, pairs, _ = marginals(x @ w, lengths, trans)
        for k, (param, grad) in enumerate(((w, x.T @ (p - onehot) / n + ridge * w), (trans, (pairs - seen) / n + ridge * trans))):
            m, v = state[k], state[k + 2]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, trans
