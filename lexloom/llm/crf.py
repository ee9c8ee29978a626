"""Inference in linear-chain conditional random fields, over batches of sequences of about the same length."""

from __future__ import annotations

import numpy as np


def forward_backward(emissions: list[np.ndarray], move: np.ndarray, pairs: bool = False) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Posteriors of sequences of about the same length, the expected transitions, and the log partition."""
    labels = len(move)
    n, t = len(emissions), max(map(len, emissions), default=0)
    expected = np.zeros((labels, labels))
    if not t:
        return [np.zeros((0, labels), np.float32)] * n, expected, 0.0
    e = np.zeros((t, n, labels), np.float32)
    length = np.array([len(x) for x in emissions])
    for i, x in enumerate(emissions):
        e[: len(x), i] = x
    top = e.max(2, keepdims=True)
    e = np.exp(e - top)
    live = np.arange(t)[:, None] < length
    a = np.empty_like(e)
    scale = np.ones((t, n), np.float32)
    for k in range(t):
        v = e[k] if k == 0 else (a[k - 1] @ move) * e[k]
        z = np.maximum(v.sum(1), 1e-30)
        a[k] = v / z[:, None]
        scale[k] = z
    b = np.ones((n, labels), np.float32)
    post = np.empty_like(e)
    for k in range(t - 1, -1, -1):
        v = a[k] * b
        post[k] = v / np.maximum(v.sum(1, keepdims=True), 1e-30)
        if k:
            w = e[k] * b
            if pairs:
                x = (a[k - 1][:, :, None] * move) * w[:, None, :]
                x /= np.maximum(x.sum((1, 2), keepdims=True), 1e-30)
                expected += x[live[k]].sum(0)
            w = w @ move.T
            b = np.where(live[k][:, None], w / np.maximum(w.max(1, keepdims=True), 1e-30), 1.0)
    log_z = float((np.log(scale) + top[..., 0])[live].sum())
    return [post[: length[i], i] for i in range(n)], expected, log_z


def viterbi(emissions: list[np.ndarray], moves: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """The likeliest labels of each sequence; moves and start are logarithms."""
    labels, n, t = len(moves), len(emissions), max(map(len, emissions), default=0)
    if not t:
        return [np.zeros(0, np.int64)] * n
    e = np.zeros((t, n, labels), np.float32)
    length = np.array([len(x) for x in emissions])
    for i, x in enumerate(emissions):
        e[: len(x), i] = x
    back = np.zeros((t, n, labels), np.int8)
    v = e[0] + start
    for k in range(1, t):
        w = v[:, :, None] + moves
        back[k] = w.argmax(1)
        v = np.where((k < length)[:, None], np.take_along_axis(w, back[k][:, None, :].astype(np.int64), 1)[:, 0] + e[k], v)
    path = np.zeros((t, n), np.int64)
    y = v.argmax(1)
    rows = np.arange(n)
    for k in range(t - 1, -1, -1):
        path[k] = y
        inside = k < length
        y = np.where(inside, back[k][rows, y], y)
    return [path[: length[i], i] for i in range(n)]
