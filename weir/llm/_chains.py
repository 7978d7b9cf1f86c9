"""Exact chain inference over many sequences at once.

Sequences are cut into lanes of equal width that advance together, one vector step
for all lanes. A first sweep gives each lane's transfer matrix, a short sweep over
lanes in order gives what enters each, and a last sweep fills in the steps. The results
are those of running each sequence whole.
"""

from __future__ import annotations

import numpy as np

WIDTH = 128


class Lanes:
    """Lanes of the rows ``first[d]:first[d + 1]`` of each sequence d."""

    def __init__(self, first: np.ndarray, width: int = WIDTH):
        size = np.diff(first)
        parts = -(-size // width)
        doc = np.repeat(np.arange(len(size)), parts)
        order = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = first[:-1][doc] + order * width
        length = np.minimum(width, first[1:][doc] - start)
        by = np.argsort(-length, kind="stable")
        self.start, self.length, self.doc, self.order = start[by], length[by], doc[by], order[by]
        self.n_docs, self.most = len(size), int(parts.max()) if len(parts) else 0
        self.longest = int(self.length[0]) if len(self.length) else 0
        self.live = np.searchsorted(-self.length, -np.arange(self.longest), side="left")  # lanes longer than t
        rank = np.argsort(self.order, kind="stable")
        cuts = np.searchsorted(self.order[rank], np.arange(self.most + 1))
        self.waves = [rank[cuts[k] : cuts[k + 1]] for k in range(self.most)]


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row of ``score`` (rows, labels), where a change of label costs ``penalty``."""
    n, k = score.shape
    out = np.zeros(n, np.int16)
    lanes = Lanes(first)
    if not n or k == 1:
        return out
    m = len(lanes.start)
    move = np.full((m, k, k), -np.inf, np.float32)
    move[:, np.arange(k), np.arange(k)] = 0
    for t in range(lanes.longest):
        a = lanes.live[t]
        x = move[:a]
        np.maximum(x, x.max(axis=2, keepdims=True) - penalty, out=x)
        x += score[lanes.start[:a] + t][:, None, :]
    enter = np.zeros((m, k), np.float32)
    now = np.zeros((lanes.n_docs, k), np.float32)
    for wave in lanes.waves:
        d = lanes.doc[wave]
        enter[wave] = now[d]
        v = (now[d][:, :, None] + move[wave]).max(axis=1)
        now[d] = v - v.max(axis=1, keepdims=True)
    stay = np.zeros((lanes.longest, m, k), bool)
    top = np.zeros((lanes.longest, m), np.int16)
    v = enter
    for t in range(lanes.longest):
        a = lanes.live[t]
        x = v[:a]
        best = x.argmax(axis=1)
        jump = x[np.arange(a), best][:, None] - penalty
        stay[t, :a], top[t, :a] = x >= jump, best
        np.maximum(x, jump, out=x)
        x += score[lanes.start[:a] + t]
        x -= x.max(axis=1, keepdims=True)
    path = np.zeros((lanes.longest, m, k), np.int16)
    state = np.tile(np.arange(k, dtype=np.int16), (m, 1))
    for t in range(lanes.longest - 1, -1, -1):
        a = lanes.live[t]
        s = state[:a]
        path[t, :a] = s
        state[:a] = np.where(np.take_along_axis(stay[t, :a], s.astype(np.int64), axis=1), s, top[t, :a, None])
    end = now.argmax(axis=1).astype(np.int64)
    final = np.zeros(m, np.int64)
    for wave in reversed(lanes.waves):
        d = lanes.doc[wave]
        final[wave] = end[d]
        end[d] = state[wave, end[d]]
    for t in range(lanes.longest):
        a = lanes.live[t]
        out[lanes.start[:a] + t] = path[t, np.arange(a), final[:a]]
    return out


def marginals(weight: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward label probabilities of each row; ``weight`` (rows, labels), ``start`` and ``step`` are positive factors.

    To ``pairs`` (labels, labels) are added the expected counts of transitions.
    """
    n, k = weight.shape
    out = np.zeros((n, k))
    lanes = Lanes(first)
    if not n:
        return out
    m = len(lanes.start)
    move = np.tile(np.eye(k), (m, 1, 1))
    for t in range(lanes.longest):
        a = lanes.live[t]
        x = np.matmul(move[:a], step) * weight[lanes.start[:a] + t][:, None, :]
        move[:a] = x / x.sum(axis=(1, 2), keepdims=True)
    # what enters a lane stands before its first transition; a sequence's start takes the place of one
    begin = np.linalg.solve(step.T, start)
    now = np.tile(begin, (lanes.n_docs, 1))
    enter = np.zeros((m, k))
    for wave in lanes.waves:
        d = lanes.doc[wave]
        enter[wave] = now[d]
        v = np.matmul(now[d][:, None, :], move[wave])[:, 0]
        now[d] = v / np.abs(v).sum(axis=1, keepdims=True)
    leave = np.ones((m, k))
    back = np.ones((lanes.n_docs, k))
    for wave in reversed(lanes.waves):
        d = lanes.doc[wave]
        leave[wave] = back[d]
        v = np.matmul(move[wave], back[d][:, :, None])[:, :, 0]
        back[d] = v / v.sum(axis=1, keepdims=True)
    v = enter.copy()
    for t in range(lanes.longest):
        a = lanes.live[t]
        rows = lanes.start[:a] + t
        x = np.matmul(v[:a][:, None, :], step)[:, 0] * weight[rows]
        v[:a] = x / x.sum(axis=1, keepdims=True)
        out[rows] = v[:a]
    v = leave
    for t in range(lanes.longest - 1, -1, -1):
        a = lanes.live[t]
        rows = lanes.start[:a] + t
        x = out[rows] * v[:a]
        if pairs is not None:
            came = out[rows - 1] if t else enter[:a]
            e = came[:, :, None] * step * (weight[rows] * v[:a])[:, None, :]
            e = e if t else e[lanes.order[:a] > 0]
            pairs += (e / e.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        out[rows] = x / x.sum(axis=1, keepdims=True)
        x = np.matmul(step, (weight[rows] * v[:a])[:, :, None])[:, :, 0]
        v[:a] = x / x.sum(axis=1, keepdims=True)
    return out
